"""The registered queries, and the pipeline stage by stage against plain versions."""

from pathlib import Path

import duckdb
import plain_llm as plain
import pytest
from test_documents import check_pieces

import __spark_entry__ as entry
import corpus_pipeline
from tidegauge.llm import langid, registry, secrets
from tidegauge.llm.common import distilled, materialize, read_table, shared_dir


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    got = entry.queries()[name](spark, small)
    cols = sorted(got.columns)
    want = con.sql(f"select {', '.join(cols)} from ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select(*cols).collect())


def test_stages_equal_plain_versions(spark, small):
    docs = read_table(spark, small, "documents")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    bench = [(r.item_id, r.text) for r in read_table(spark, small, "benchmark").collect()]
    model = langid.train(langid.train_split(docs))
    text = {d: r.text for d, r in rows.items()}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, small), name)
        if name == "language_id":
            text = {d: t for d, t in text.items() if (x := langid.label(t, model, 20.0))[0] != "und" and x[1] >= 0.3}
        elif name == "near_dedup":
            stays = set(plain.near_classes(list(text.items())).values())
            text = {d: t for d, t in text.items() if d in stays}
        elif name == "decontaminate":
            text = {d: t for d, t in text.items() if not plain.contamination(t, bench)[1]}
        elif name == "secret_scan":
            ratios = secrets.train(secrets.labelled_samples())
            for d, t in text.items():
                spans = sorted(plain.base_spans(t) + secrets.model_spans(t, ratios, plain.base_spans(t), 12.0, 0.4))
                for s, _, e in reversed(spans):
                    t = t[:s] + "[secret]" + t[e:] if all(not (a < s < b) for a, _, b in spans) else t
                text[d] = t
        if name != "packing":
            assert docs.columns == columns
            assert {r.doc_id: r.text for r in docs.collect()} == text
    assert check_pieces(docs.collect(), list(text.items())) == 0
    assert len(text) > 0.5 * len(rows)


def test_stages_on_odd_documents(spark, odd_docs, small):
    """Nulls in every column, repeated rows, long texts and clashing columns go through all stages."""
    docs, columns = odd_docs, odd_docs.columns
    before = None
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, small), name)
        if name == "packing":
            break
        assert docs.columns == columns
        rows = docs.select("doc_id", "text").collect()
        if name == "language_id":
            assert all(r.text is not None and any(c.isalpha() for c in r.text) for r in rows)
        if name == "near_dedup":
            assert len({r.text for r in rows}) == len(rows) and all(r.text in {x.text for x in before} for r in rows)
        if before is not None and name in ("decontaminate", "secret_scan"):
            assert len(rows) == len(before)
        before = rows
    assert check_pieces(docs.collect(), [(r.doc_id, r.text) for r in before]) == 0


def test_pipeline_on_an_empty_table(spark, no_docs, small):
    docs = no_docs
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, small), name)
    assert docs.count() == 0


def test_tables_written_on_the_way_are_deleted(spark):
    folder = Path(shared_dir(spark).removeprefix("file:"))

    def inner():
        kept = materialize(materialize(spark.range(5), "way_a"), "way_b")
        return kept.where("id > 2")

    def outer():
        return distilled(spark, inner, "way_c").union(materialize(spark.range(2), "way_d"))

    out = distilled(spark, outer, "way_e")
    assert sorted(r.id for r in out.collect()) == [0, 1, 3, 4]
    assert [p.name[:5] for p in folder.glob("way_*")] == ["way_e"]

    def fails():
        materialize(spark.range(1), "way_f")
        raise ValueError

    with pytest.raises(ValueError):
        distilled(spark, fails, "way_g")
    assert sorted(p.name[:5] for p in folder.glob("way_*")) == ["way_e", "way_f"]


def test_pipeline_leaves_one_table(spark, small):
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir()) if folder.exists() else set()
    out = corpus_pipeline.run(spark, small)
    assert [p.name[:7] for p in set(folder.iterdir()) - before] == ["packing"]
    assert out.count() > 0
