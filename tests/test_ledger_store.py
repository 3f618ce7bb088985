"""A stored ledger that is continued batch by batch."""

import pytest
from plain import random_events, unique
from pyspark.sql import functions as F

import cli
from tidegauge.functions.normalize import normalize
from tidegauge.operators import ledger, ledger_store, replay
from tidegauge.sources.telemetry import from_events


@pytest.fixture(scope="module")
def blocks(spark):
    return ledger.bodies(replay.process(normalize(from_events(spark, random_events(80, 5)))[0])).cache()


def chained(rows):
    return sorted((r.chain, r.audit_id, r.body, r.prev_hash, r.current_hash) for r in rows.collect())


@pytest.mark.parametrize("scope", ["sensor", "global"])
def test_batches_make_the_chain_of_all(spark, blocks, tmp_path, scope):
    at = str(tmp_path / "ledger")
    for k in range(4):  # the third batch is empty
        part = blocks.where(f"seq >= {k * 30} and seq < {(k + 1) * 30}") if k != 2 else blocks.limit(0)
        if k == 3:
            part = blocks.where("seq >= 60")
        assert ledger_store.append(part, at, f"batch-{k}", scope)
    stored = ledger_store.load(spark, at)
    assert chained(stored) == chained(ledger.build(blocks, scope))
    assert ledger_store.verify(spark, at) == (True, None)
    assert [b for _, b in ledger_store.commits(spark, at)] == [f"batch-{k}" for k in range(4)]
    assert not ledger_store.append(blocks, at, "batch-1", scope)
    assert stored.count() == ledger_store.load(spark, at).count() == blocks.count()


def test_an_interrupted_commit_is_replaced(spark, blocks, tmp_path):
    at = str(tmp_path / "ledger")
    assert ledger_store.append(blocks.where("seq < 40"), at, "a")
    lost = ledger.build(blocks.where("seq >= 60"), after=ledger_store.heads(spark, at))
    lost.withColumn("bucket", F.lit(3)).write.partitionBy("bucket").parquet(f"{at}/blocks/commit=000002")
    assert ledger_store.verify(spark, at) == (True, None) and ledger_store.load(spark, at).count() == blocks.where("seq < 40").count()
    assert ledger_store.append(blocks.where("seq >= 40"), at, "b")
    assert chained(ledger_store.load(spark, at)) == chained(ledger.build(blocks))
    with pytest.raises(ValueError):
        ledger_store.append(blocks, at, "../x")
    ledger_store.reset(spark, at)
    assert ledger_store.heads(spark, at) is None
    with pytest.raises(FileNotFoundError):
        ledger_store.load(spark, at)


def test_faults_of_a_stored_ledger(spark, blocks, tmp_path):
    at = str(tmp_path / "ledger")
    ledger_store.append(blocks.where("seq < 50"), at, "a")
    ledger_store.append(blocks.where("seq >= 50"), at, "b")
    whole = ledger_store.load(spark, at).cache()
    whole.count()
    last = whole.groupBy("chain").agg(F.max("audit_id").alias("n")).orderBy("chain").first()
    cut = whole.where(~((F.col("chain") == last["chain"]) & (F.col("audit_id") == last["n"]) & (F.col("commit") == 2)))
    cut.where("commit = 2").drop("commit").write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/blocks/commit=000002")
    holds, fault = ledger_store.verify(spark, at)
    assert not holds and (fault["chain"], fault["reason"]) == (last["chain"], "Chain ends elsewhere")
    whole.unpersist()


def test_pages_are_read_by_range(spark, blocks, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger_store, "RUN", 4)
    at = str(tmp_path / "ledger")
    ledger_store.append(blocks.where("seq < 50"), at, "a")
    ledger_store.append(blocks.where("seq >= 50"), at, "b")
    own = [r.current_hash for r in ledger.build(blocks).where("chain = 'S1'").orderBy("audit_id").collect()]
    got = lambda **k: [r.current_hash for r in ledger_store.page(spark, at, "S1", **k).collect()]
    assert got() == own and got(limit=3, offset=2) == own[2:5] and got(limit=4, newest_first=True) == own[::-1][:4]
    assert got(limit=5, offset=len(own) - 2) == own[-2:] and got(offset=len(own)) == [] and got(newest_first=True, offset=len(own) - 1) == own[:1]
    assert ledger_store.page(spark, at, "nobody").count() == 0
    plan = ledger_store.page(spark, at, "S1", limit=3, offset=2)._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert "EqualTo(chain,S1)" in plan and "GreaterThanOrEqual(audit_id,3)" in plan


def test_command_line_continues_a_ledger(spark, tmp_path, monkeypatch, capsys):
    import json

    monkeypatch.setattr(cli, "session", lambda _: spark)
    (tmp_path / "f.json").write_text(json.dumps(random_events(20, 9)))
    at = str(tmp_path / "ledger")
    for batch in (["--batch", "x"], ["--batch", "y"], ["--batch", "x"], []):
        assert cli.main(["replay", "--fixture", str(tmp_path / "f.json"), "--persist", at, *batch]) == 0
    assert capsys.readouterr().out.count("the ledger has this batch") == 1
    assert cli.main(["audit-verify", "--ledger", at]) == 0
    assert ledger_store.load(spark, at).count() == 3 * len(unique(random_events(20, 9)))
