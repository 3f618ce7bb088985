"""Collocations against a plain count of all phrases."""

import re
from collections import Counter

from tidegauge.llm import collocations
from tidegauge.llm.common import read_table


def plain_phrases(docs, least=10, top=2000):
    """docs of (lang, text) -> rows (lang, rank, phrase, a, l, r, n, score)."""
    f = {}
    for lang, text in docs:
        own = f.setdefault("und" if lang is None else lang, Counter())
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            own.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        n = sum(x for p, x in c.items() if len(p) == 1)
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in candidates.items():
            if len(p) == 3:
                for q in (p[:2], p[1:]):
                    longer[q] = max(longer[q], a)
        rows = []
        for p, a in candidates.items():
            if len(p) == 2 and longer[p] and 100 * longer[p] >= 50 * a:
                continue
            score, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            phrase = " ".join(p)
            rows.append((-score, -a, phrase.encode(), phrase, c[p[:k]], c[p[k:]]))
        out += [(lang, i, x[3], -x[1], x[4], x[5], n, -x[0]) for i, x in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r[c] for c in "lang rank phrase a l r n score".split()) for r in df.collect())


def test_collocations_equal_plain_counts_over_many_shards(spark, small):
    docs = read_table(spark, small, "documents").repartition(3)
    want = plain_phrases([(r.lang, r.text) for r in docs.collect()], least=4)
    assert found(collocations.collocations(docs, least=4, shard_words=3_000)) == want
    assert len({r[0] for r in want}) == 4
    few = plain_phrases([(r.lang, r.text) for r in docs.collect()], least=3, top=7)
    assert found(collocations.collocations(docs, least=3, top=7)) == few


def test_collocation_edges(spark, odd_docs, no_docs):
    texts = ["Big RED dog. big red dog, big red cat", "a a a a", "tab\tand  blank\x0bcut\x00zero nul", "Éa Éb Éa", "漢 字 漢 字; 漢 字", "x\xa0y z x\xa0y z", None, "", "\x1ca b \x1ca b"]
    rows = [(k, t, lang, "s", 1) for k, (t, lang) in enumerate((t, lang) for t in texts for lang in ("en", None, "und", ""))] * 4
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(rows, odd_docs.select("doc_id", "text", "lang", "source", "n_chars").schema))
    for extra in ("n", "phrase", "id", "shard", "word", "rank", "a"):
        docs = docs.selectExpr("*", f"'clash' as {extra}")
    want = plain_phrases([(r.lang, r.text) for r in docs.collect()])
    got = found(collocations.collocations(docs, shard_words=50))
    assert got == want and {r[0] for r in want} >= {"en", "und", ""}
    assert collocations.collocations(no_docs).count() == 0


def test_cut_scores_are_exact_past_64_bits(spark):
    rows = [(3_037_000_500, 3_037_000_501, 9_000_000_007), (10**14, 10**14 + 1, 10**14 + 3), (10, 10, 10), (12, 10**12, 12)]
    got = spark.createDataFrame(rows, "a bigint, l bigint, r bigint").select(collocations.cut_score("a", "l", "r").alias("s")).collect()
    assert [r.s for r in got] == [10**6 * a * a // (left * right) for a, left, right in rows]


def test_a_full_bit_field_changes_nothing(spark, small, monkeypatch):
    docs = read_table(spark, small, "documents").limit(60)
    want = found(collocations.collocations(docs, least=2))
    monkeypatch.setattr(collocations, "bit_field", lambda pairs: __import__("numpy").full(collocations.SLOTS // 8 + 4, 255, "uint8"))
    assert found(collocations.collocations(docs, least=2)) == want
