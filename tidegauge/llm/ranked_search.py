"""Ranked lexical search: documents at a time, over compressed postings by shard.

`build_index` writes shards: a shard is a bounded run of documents sorted by doc_id, with, for every
term in them, its list of (document, occurrences) in that order, as differences of 7 bits a byte.
`search` takes the test items in blocks of bounded size. For a block the document frequencies of its
terms are added up over all shards; then every shard answers all items of the block: a k-way heap merge
runs over the lists of an item's terms, document by document, into a heap of the best `top` results keyed
by score, then doc_id. Lists whose largest scores together can't reach the worst of a full heap are not
merged, but looked up for the documents that are met (no result is lost: a document in none of the merged
lists can't reach the heap). A task keeps its heaps from one shard to the next; the best of all tasks are
merged in two steps, so that no task gets the results of all shards.

The score is whole numbers but for the weight of a term (see `weights`), so it does not depend on the
order of the shards.

Edge cases: a null or empty text has no terms: it does not count in N, and as an item it has no results;
items of equal item_id and text are one item, two texts of one item_id are two; repeated rows are documents
of their own; among equal scores the lesser doc_id comes first, a null one last; very long texts make a
shard of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table, slim_batches
from .decontaminate import words
from .postings import expand, item_blocks, squeeze

INDEX = "doc_ids array<long>, lengths array<long>, terms array<binary>, dfs array<int>, ends array<long>, postings binary"
TYPES = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]
LAST_ID = (1 << 63) - 1  # stands for a null doc_id in the order of equal scores
RANGE = 2048  # documents of a shard between two looks at which lists are merged


def shard_row(ids: list[int | None], found: list[list[bytes]]) -> list:
    """A shard of documents and their terms, as a row of the index."""
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
    number: dict[bytes, int] = {}
    parts = [np.array([number.setdefault(w, len(number)) for w in found[k]], dtype=np.int64) for k in order]
    lengths = np.array([len(p) for p in parts], np.int64)
    n = max(1, len(order))
    keys, times = np.unique(np.concatenate([*parts, np.zeros(0, np.int64)]) * n + np.repeat(np.arange(len(parts)), lengths), return_counts=True)
    term, doc = keys // n, keys % n
    new = np.append(True, term[1:] != term[:-1]) if len(term) else np.zeros(0, bool)
    gap = np.where(new, doc, np.diff(doc, prepend=0))
    packed, ends = squeeze(np.stack([gap, times], axis=1).ravel())
    last = np.append(np.flatnonzero(new)[1:], len(term)) - 1 if len(term) else np.zeros(0, np.int64)
    return [[ids[k] for k in order], lengths, list(number), np.bincount(term, minlength=len(number)).astype(np.int32), ends[2 * last + 1], packed]


def build_index(docs: DataFrame, shard_words: int = 1_000_000) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found, n = [], [], 0

        def shard() -> pa.RecordBatch:
            row = shard_row(ids, found)
            ids.clear()
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, TYPES)], names=[c.split()[0] for c in INDEX.split(", ")])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                own = words(text.as_py())
                if not own:
                    continue
                if found and n + len(own) > shard_words:
                    yield shard()
                    n = 0
                ids.append(doc_id)
                found.append(own)
                n += len(own)
        if found:
            yield shard()

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, INDEX)


def frequencies(index: DataFrame, terms: list[bytes]) -> dict[bytes, int]:
    """Documents that hold each of the terms; what comes back is as long as the list of terms."""
    wanted = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.array(wanted.value, pa.binary())
        sums = np.zeros(len(terms), np.int64)
        for b in batches:
            for k in range(b.num_rows):
                at = pc.index_in(terms, value_set=b.column(0)[k].values)
                there = np.flatnonzero(at.is_valid())
                sums[there] += np.asarray(b.column(1)[k].values)[at.drop_null()]
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], names=["term", "df"])

    rows = index.select("terms", "dfs").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    wanted.destroy()
    return {terms[r["term"]]: r["df"] for r in rows}


def weights(n_docs: int, df: dict[bytes, int]) -> dict[bytes, int]:
    """floor(1000 ln((2N + 2) / (2 df + 1))) of each term that occurs."""
    return {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}


class Best:
    """The best `top` of (score, doc_id): a heap whose root is the worst of them."""

    def __init__(self, top: int):
        self.top = top
        self.heap: list[tuple[int, int]] = []  # (score, -doc_id)

    @property
    def floor(self) -> int:
        """A lower score than this has no place."""
        return self.heap[0][0] if len(self.heap) == self.top else 1

    def offer(self, score: int, doc_id: int) -> None:
        if len(self.heap) < self.top:
            heapq.heappush(self.heap, (score, -doc_id))
        elif (score, -doc_id) > self.heap[0]:
            heapq.heapreplace(self.heap, (score, -doc_id))


def answer(lists: list[tuple[np.ndarray, np.ndarray]], doc_ids: list[int], best: Best) -> None:
    """Offer all documents of a shard to an item's heap. lists: places of documents and their scores, by term."""
    lists = sorted(lists, key=lambda x: int(x[1].max()))
    bounds = np.cumsum([int(s.max()) for _, s in lists])
    bits = max(int(s.max()) for _, s in lists).bit_length()  # an entry of a list: a document's place above so many bits of score
    kind = np.int64 if bits + len(doc_ids).bit_length() < 63 else object
    cuts = list(range(0, len(doc_ids), RANGE)) + [len(doc_ids)]
    at = [np.searchsorted(d, cuts).tolist() for d, _ in lists]
    for r in range(len(cuts) - 1):
        rest = int(np.searchsorted(bounds, best.floor))  # lists that can't reach the floor, even together
        merged = [((d[a[r] : a[r + 1]].astype(kind) << bits) | s[a[r] : a[r + 1]].astype(kind)).tolist() for (d, s), a in zip(lists[rest:], at[rest:]) if a[r] < a[r + 1]]
        if not merged:
            continue
        docs, sums = [], []
        last = -1
        for x in heapq.merge(*merged) if len(merged) > 1 else merged[0]:
            doc = x >> bits
            if doc == last:
                sums[-1] += x - (doc << bits)
            else:
                docs.append(doc)
                sums.append(x - (doc << bits))
                last = doc
        places, scores = np.array(docs, np.int64), np.array(sums, np.int64)
        for (d, s), bound in zip(lists[:rest][::-1], bounds[:rest][::-1]):
            could = scores + bound >= best.floor  # bound: of this list and all below it
            places, scores = places[could], scores[could]
            where = np.minimum(np.searchsorted(d, places), len(d) - 1)
            scores = scores + np.where(d[where] == places, s[where], 0)
        good = scores >= best.floor
        for p, s in zip(places[good].tolist(), scores[good].tolist()):
            best.offer(s, doc_ids[p])


def search(index: DataFrame, items: list[tuple[str | None, str | None]], n_docs: int, n_words: int, top: int = 20) -> DataFrame:
    """item (its number in items), doc_id, score: the best of each task, for one block of items."""
    asked = [Counter(words(text)) for _, text in items]
    terms = sorted(set().union(*asked)) if asked else []
    weight = weights(n_docs, frequencies(index, terms)) if terms else {}
    known = [t for t in terms if weight.get(t)]  # a term of weight 0 adds nothing
    number = {t: k for k, t in enumerate(known)}
    plan = [[(number[t], times) for t, times in a.items() if t in number] for a in asked]
    shared = index.sparkSession.sparkContext.broadcast((known, np.array([weight[t] for t in known], np.int64), plan))  # bounded by the block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight, plan = shared.value
        known = pa.array(known, pa.binary())
        heaps = [Best(top) for _ in plan]
        for b in batches:
            for k in range(b.num_rows):
                doc_ids = [LAST_ID if x is None else x for x in b.column(0)[k].as_py()]
                length = np.asarray(b.column(1)[k].values)
                ends = np.asarray(b.column(3)[k].values)
                packed = memoryview(b.column(4)[k].as_buffer())
                m = 75 + 25 * length * n_docs // n_words
                at = pc.index_in(known, value_set=b.column(2)[k].values).to_pylist()
                lists: list[tuple[np.ndarray, np.ndarray] | None] = []
                for t, w in zip(at, weight.tolist()):
                    if t is None:
                        lists.append(None)
                        continue
                    pairs = expand(packed[ends[t - 1] if t else 0 : ends[t]])
                    docs, tf = np.cumsum(pairs[::2]), pairs[1::2]
                    lists.append((docs, w * (1_000_000_000 * tf // (1000 * tf + 12 * m[docs]))))
                for item, best in zip(plan, heaps):
                    own = [(lists[t][0], lists[t][1] * times) for t, times in item if lists[t] is not None]
                    if own:
                        answer(own, doc_ids, best)
        rows = [(k, -d, s) for k, best in enumerate(heaps) for s, d in best.heap]
        item, doc, score = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array([None if d == LAST_ID else d for d in doc], pa.int64()), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return index.select("doc_ids", "lengths", "terms", "ends", "postings").mapInArrow(run, "item long, doc_id long, score long")


def ranked(docs: DataFrame, benchmark: DataFrame, top: int = 20, block_words: int = 200_000, shard_words: int = 1_000_000) -> DataFrame:
    """item_id, rank, doc_id, score of the `top` best documents of each item."""
    spark = docs.sparkSession
    slim_batches(spark)
    kind = benchmark.schema["item_id"].dataType
    index = materialize(build_index(docs, shard_words), "ranked_index")
    n_docs, n_words = index.select(F.sum(F.size("doc_ids")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    best_first = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    out = None
    for items in item_blocks(benchmark, block_words) if n_docs else ():
        found = search(index, items, n_docs, n_words, top).withColumn("part", F.spark_partition_id() % 64)
        some = found.withColumn("nth", F.row_number().over(Window.partitionBy("item", "part").orderBy(*best_first))).where(F.col("nth") <= top)
        final = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best_first))).where(F.col("rank") <= top)
        names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(items)], "item long, item_id string")
        one = materialize(final.join(names, "item").select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score"), "ranked")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "item_id string, rank int, doc_id long, score long").select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP12_SQL = """
with d as (select row_number() over () rid, doc_id, [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') if x <> ''] w from documents),
dw as (select rid, doc_id, len(w) n from d where len(w) > 0),
s as (select count(*) nn, sum(n)::bigint l from dw),
tf as (select rid, term, count(*) tf from (select rid, unnest(w) term from d) group by rid, term),
wt as (select term, floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1)))::bigint wt from tf, s group by term, nn),
q as (select item_id, unnest([x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') if x <> '']) term from benchmark),
qt as (select item_id, term, count(*) times from q group by item_id, term),
r as (select item_id, dw.rid, doc_id, sum(times * wt * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // l))))::bigint score
 from qt join wt using (term) join tf using (term) join dw on dw.rid = tf.rid, s group by item_id, dw.rid, doc_id),
k as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) rank, doc_id, score from r where score > 0)
select item_id, rank::int rank, doc_id, score from k where rank <= 20
"""
