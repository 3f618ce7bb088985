"""Ranked search and posting lists, against a plain version that scores every document."""

import math
from collections import Counter

import numpy as np
import plain_llm as plain
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegauge.llm import postings, ranked_search
from tidegauge.llm.common import read_table


def plain_ranks(docs, items, top=20):
    """Rows (item_id, rank, doc_id, score); every document is scored for every item."""
    docs = [(d, plain.bench_words(t)) for d, t in docs]
    docs = [(d, Counter(w), len(w)) for d, w in docs if w]
    n_docs, n_words = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item_id, text in dict.fromkeys(items):
        scored = []
        for d, c, n in docs:
            m = 100 - 25 + 25 * n * n_docs // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in plain.bench_words(text) if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item_id, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:top], 1)]
    return out


def rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**62)))
def test_posting_bytes_round_trip(values):
    packed, ends = postings.squeeze(np.array(values, np.int64))
    assert postings.expand(packed).tolist() == values
    assert len(packed) == (ends[-1] if values else 0)
    assert all(postings.expand(packed[a:b]).tolist() == [v] for a, b, v in zip([0, *ends[:-1]], ends, values))


def test_ranks_equal_brute_force_over_many_shards(spark, small, monkeypatch):
    monkeypatch.setattr(ranked_search, "RANGE", 7)
    docs, bench = read_table(spark, small, "documents").repartition(3), read_table(spark, small, "benchmark")
    want = plain_ranks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert rows(ranked_search.ranked(docs, bench, shard_words=5_000, block_words=300)) == sorted(want, key=str)


def test_rank_edges(spark, odd_docs, no_docs):
    items = [(1, "alpha1 alpha2 ALPHA3, alpha1"), (1, "alpha1 alpha2 ALPHA3, alpha1"), (1, "漢字 tail"), (2, None), (3, " ,; "), (None, "w1x1 x"), (4, "nowhere")]
    bench = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "'clash' as rank", "1 as score")
    want = plain_ranks([(r.doc_id, r.text) for r in odd_docs.collect()], items)
    got = ranked_search.ranked(odd_docs, bench)
    assert rows(got) == sorted(want, key=str)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert [r.doc_id for r in got.where("item_id = 1 and score > 0").orderBy("rank").collect()][-1] is None
    for a, b in ((no_docs, bench), (odd_docs, bench.limit(0)), (no_docs, bench.limit(0))):
        assert ranked_search.ranked(a, b).count() == 0


@pytest.mark.parametrize("top", [1, 3])
def test_pruned_merge_equals_full_scoring(top):
    rng = np.random.default_rng(top)
    for _ in range(40):
        n = int(rng.integers(1, 9000))
        lists = []
        for _ in range(int(rng.integers(1, 6))):
            docs = np.flatnonzero(rng.random(n) < rng.choice([0.001, 0.1, 0.9]))
            if len(docs):
                lists.append((docs, rng.integers(0, 4, len(docs)) * int(rng.choice([1, 10**6, 2**50]))))
        if not lists:
            continue
        ids = sorted(rng.integers(0, n, n).tolist())
        best = ranked_search.Best(top)
        best.offer(2, n)  # left by another shard
        sums = np.zeros(n, object)
        for d, s in lists:
            sums[d] += s
        ranked_search.answer(lists, ids, best)
        want = sorted([(int(s), -i) for s, i in zip(sums, ids) if s > 0] + [(2, -n)], reverse=True)[:top]
        assert sorted(best.heap, reverse=True) == want


def test_blocks_hold_every_item_once_and_stay_small(spark):
    rows = [(7, "same words " * 5)] * 3000 + [(k, f"item {k} of words") for k in range(200)] + [(None, None), (8, None), (9, "long " * 500)]
    found = list(postings.item_blocks(spark.createDataFrame(rows, "item_id bigint, text string"), 100))
    assert sorted((x for b in found for x in b), key=str) == sorted({(None if i is None else str(i), t) for i, t in rows}, key=str)
    sizes = [[len((t or "").split()) for _, t in b] for b in found]
    assert max(sum(s) - max(s) for s in sizes) <= 200
