"""Benchmark decontamination with a positional inverted index.

`build_index` stores token postings in segments: a segment is a bounded run of documents with, for
every word in them, the sorted positions where it occurs. Segments are rows of a written table, so the
index is distributed by document and is searched as often as needed. `search` sends test windows to
the segments: within one, each window starts from the list of its rarest term, and keeps the
offset-adjusted positions that are in the list of its next rarest term, and so on. What is left is an
exact phrase. A window whose three terms that are rarest among the test items occur within `slop` words
of their places without an exact match is a proximity match, whatever its other words.

The different test items are dealt to blocks of bounded size in Spark; the driver and the tasks hold one
block at a time, as arrays of word numbers, and a block's results are the documents with a match. Within a segment, windows are searched some at a time, so
that their candidate positions are bounded too.

Edge cases: a null or empty text has no words and no hits; an item without words has no window and
one of fewer than `width` words is a single window; the words of an item with a null item_id count as hit
and contaminate, but add no item; repeated rows are indexed as rows of their own; a document longer
than a segment gets a segment to itself; empty tables give no rows or no hits; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table, slim_batches
from .postings import ItemBlocks

#: Letters in lower case; what separates words becomes a blank. Bytes from 0x80 belong to words.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
GAP = 16  # unused positions between documents; a phrase or a near match never crosses them
INDEX = "doc_ids array<long>, digests array<binary>, n_words array<long>, starts array<long>, terms array<binary>, list_starts array<long>, positions binary"
CANDIDATES = 2_000_000  # positions that are looked at together


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


def build_index(docs: DataFrame, segment_words: int = 200_000) -> DataFrame:
    """Segments of docs (doc_id, text) with the postings of all their words; digests tell texts of one
    doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = {}
        doc_ids, digests, counts, starts, parts = [], [], [], [], []
        at = 0

        def segment() -> pa.RecordBatch:
            ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            where = np.flatnonzero(ids >= 0)
            order = where[np.argsort(ids[where], kind="stable")].astype(np.int32)
            first = np.searchsorted(ids[order], np.arange(len(number) + 1))
            row = [doc_ids[:], digests[:], counts[:], starts[:], list(number), first.tolist(), order.tobytes()]
            types = [pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary()]
            for x in (doc_ids, digests, counts, starts, parts, number):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=[c.split()[0] for c in INDEX.split(", ")])

        pad = np.full(GAP, -1, dtype=np.int32)
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                found = words(text.as_py())
                if parts and at + len(found) > segment_words:
                    yield segment()
                    at = 0
                doc_ids.append(doc_id)
                digests.append(hashlib.md5((text.as_py() or "").encode()).digest())
                counts.append(len(found))
                starts.append(at)
                parts += [np.array([number.setdefault(w, len(number)) for w in found], dtype=np.int32), pad]
                at += len(found) + GAP
        if doc_ids:
            yield segment()

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, INDEX)


@dataclass
class Windows:
    """The different windows of a block of test items."""

    terms: list[bytes]
    matrix: np.ndarray  # windows x width: numbers of terms, -1 past the end of a short one
    rare: np.ndarray  # windows x 3: places of the terms that are rarest in the items
    items: list[str]
    owners: np.ndarray  # numbers of items, of one window after the other
    first: np.ndarray  # where each window's owners begin


def windows_of(items: list[tuple], width: int, all_items: ItemBlocks | None = None) -> Windows:
    """all_items: where rarity is counted if these are not all."""
    number: dict[bytes, int] = {}
    names: dict[str, int] = {}
    rows, of = [], []
    for item_id, text in items:
        ids = np.array([number.setdefault(w, len(number)) for w in words(text)], dtype=np.int32)
        if len(ids):
            padded = np.pad(ids, (0, max(0, width - len(ids))), constant_values=-1)
            rows.append(np.lib.stride_tricks.sliding_window_view(padded, width))
            of.append(np.full(len(rows[-1]), -1 if item_id is None else names.setdefault(str(item_id), len(names))))
    if not rows:
        return Windows([], np.zeros((0, width), np.int32), np.zeros((0, 3), np.int64), [], np.zeros(0, np.int64), np.zeros(1, np.int64))
    matrix, window = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
    pairs = np.unique(np.stack([window.ravel(), np.concatenate(of)], axis=1), axis=0)
    pairs = pairs[pairs[:, 1] >= 0]
    terms = list(number)
    if all_items is None:
        times = np.bincount(np.concatenate([r[:, 0] for r in rows] + [r[-1, 1:][r[-1, 1:] >= 0] for r in rows]), minlength=len(terms))
    else:
        often = all_items.times(terms)
        times = [often[t] for t in terms]
    rank = np.empty(len(terms) + 1, dtype=np.int64)  # in one order for all segments and blocks: rare in the items, then by the word
    rank[sorted(range(len(terms)), key=lambda t: (times[t], terms[t]))] = np.arange(len(terms))
    rank[-1] = len(terms)
    rare = np.argsort(rank[matrix], axis=1, kind="stable")[:, :3]
    return Windows(terms, matrix, rare, list(names), pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(matrix) + 1)))


def portions(n: np.ndarray) -> Iterator[slice]:
    """Runs of windows with so many candidates, or one window with more."""
    sums = np.cumsum(n)
    at = 0
    while at < len(n):
        stop = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + CANDIDATES, "right")))
        yield slice(at, stop)
        at = stop


def intersect(keys: np.ndarray, span: int, lists: np.ndarray, sizes: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows and starts of exact matches.

    keys: term * span + position over all postings, sorted. lists, sizes: where each term's list
    begins in keys, and its length. matrix: the windows' terms, -1 past the end of a short one."""
    size = np.where(matrix >= 0, sizes[matrix], np.iinfo(np.int64).max)
    order = np.argsort(size, axis=1, kind="stable")  # rarest term first
    rare = np.take_along_axis(matrix, order[:, :1], axis=1)[:, 0]
    wins, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for part in portions(sizes[rare]):
        n = sizes[rare[part]]
        win = np.repeat(np.arange(part.start, part.stop), n)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = keys[lists[rare][win] + nth] - rare[win] * span - order[win, 0]
        for r in range(1, matrix.shape[1]):
            off = order[win, r]
            term = matrix[win, off]
            want = term * span + start + off
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            keep = (term < 0) | (keys[at] == want)
            win, start = win[keep], start[keep]
        wins.append(win)
        starts.append(start)
    return np.concatenate(wins), np.concatenate(starts)


def near(keys: np.ndarray, span: int, lists: np.ndarray, sizes: np.ndarray, terms: np.ndarray, places: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows and positions of their first term where all three terms occur within slop of their places."""
    wins, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for part in portions(sizes[terms[:, 0]]):
        n = sizes[terms[part, 0]]
        win = np.repeat(np.arange(part.start, part.stop), n)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = keys[lists[terms[:, 0]][win] + nth] - terms[win, 0] * span - places[win, 0]
        for r in (1, 2):
            term = terms[win, r]
            want = term * span + start + places[win, r]
            keep = np.searchsorted(keys, want + slop, "right") > np.searchsorted(keys, np.maximum(want - slop, term * span))
            win, start = win[keep], start[keep]
        wins.append(win)
        starts.append(start + places[win, 0])
    return np.concatenate(wins), np.concatenate(starts)


def search(index: DataFrame, shared: Broadcast[Windows], slop: int = 3) -> DataFrame:
    """Per indexed document with a match: doc_id, digest, the hit positions as intervals, the items with a
    phrase in it and those with near matches only. shared: the windows of one block of items."""
    schema = "doc_id long, digest binary, hits array<struct<start:long,end:long>>, items array<string>, near_items array<string>"
    interval = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def segment(doc_ids, digests, counts, starts, terms, list_starts, positions) -> pa.RecordBatch:
        known = shared.value
        counts, starts = np.array(counts, np.int64), np.array(starts, np.int64)
        hits = [[] for _ in doc_ids]
        items_of = [set() for _ in doc_ids]
        near_of = [set() for _ in doc_ids]
        number = {w: k for k, w in enumerate(terms)}
        own = np.array([number.get(w, -2) for w in known.terms] + [-1], dtype=np.int64)  # -2: not in the segment
        matrix = own[known.matrix]
        lists = np.array(list_starts, np.int64)
        sizes = np.diff(lists)
        pos = np.frombuffer(positions, dtype=np.int32).astype(np.int64)
        span = int(starts[-1] + counts[-1]) + 2 * GAP
        keys = np.repeat(np.arange(len(terms)), sizes) * span + pos
        document = lambda start: np.searchsorted(starts, start, "right") - 1
        owners = lambda w: known.owners[known.first[w] : known.first[w + 1]].tolist()
        usable = np.flatnonzero((matrix != -2).all(axis=1))
        if len(usable):
            win, start = intersect(keys, span, lists, sizes, matrix[usable])
            order = np.argsort(start, kind="stable")
            win, start = usable[win[order]], start[order]
            length = (matrix >= 0).sum(axis=1)
            for w, s, d in zip(win.tolist(), start.tolist(), document(start).tolist()):
                a, e = s - int(starts[d]), s - int(starts[d]) + int(length[w])
                if hits[d] and a <= hits[d][-1]["end"]:
                    hits[d][-1]["end"] = max(e, hits[d][-1]["end"])
                else:
                    hits[d].append({"start": a, "end": e})
                items_of[d].update(owners(w))
        if slop and len(matrix) and known.rare.shape[1] == 3:
            terms3 = np.take_along_axis(matrix, known.rare, axis=1)
            usable = np.flatnonzero((terms3 >= 0).all(axis=1))
            win, at = near(keys, span, lists, sizes, terms3[usable], known.rare[usable], slop)
            for w, d in set(zip(usable[win].tolist(), document(at).tolist())):
                near_of[d].update(owners(w))
        names = lambda x: sorted(known.items[k] for k in x)
        met = [d for d in range(len(doc_ids)) if hits[d] or near_of[d]]
        columns = [
            pa.array([doc_ids[d] for d in met], pa.int64()),
            pa.array([digests[d] for d in met], pa.binary()),
            pa.array([hits[d] for d in met], pa.list_(interval)),
            pa.array([names(items_of[d]) for d in met], pa.list_(pa.string())),
            pa.array([names(near_of[d] - items_of[d]) for d in met], pa.list_(pa.string())),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "hits", "items", "near_items"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                yield segment(*(b.column(c)[k].as_py() for c in range(7)))

    return index.mapInArrow(run, schema)


def matches(index: DataFrame, benchmark: DataFrame, width: int, slop: int, block_words: int) -> DataFrame | None:
    """The results of search over all blocks of items, with repeated rows; None without items. Each block's
    windows are broadcast while its results are written."""
    spark = index.sparkSession
    slim_batches(spark)  # a few segments at a time
    items = ItemBlocks(benchmark, block_words)
    found = None
    for part in items:
        shared = spark.sparkContext.broadcast(windows_of(part, width, items if items.several and slop else None))
        one = materialize(search(index, shared, slop), "matches")
        shared.destroy()
        found = one if found is None else found.union(one)
    return found


def same(a: str, b: str) -> Column:
    """Whether two sides are of one doc_id and text."""
    return (F.col(f"{a}.digest") == F.col(f"{b}.digest")) & F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, slop: int = 3, block_words: int = 500_000) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items,
    near_items. The index is written once and searched once per block of test items."""
    index = materialize(build_index(docs), "index")
    each = index.select(F.explode(F.arrays_zip("doc_ids", "digests", "n_words")).alias("d")).select(F.col("d.doc_ids").alias("doc_id"), F.col("d.digests").alias("digest"), F.col("d.n_words").alias("n_words"))
    found = matches(index, benchmark, width, slop, block_words)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "doc_id long, digest binary, hits array<struct<start:long,end:long>>, items array<string>, near_items array<string>")
    # Equal documents have equal results; of several blocks' rows one per document is put together.
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    joined = found.groupBy("doc_id", "digest").agg(union("hits").alias("hits"), union("items").alias("items"), union("near_items").alias("near_items"))
    both = each.alias("d").join(joined.alias("f"), same("d", "f"), "left")
    none = lambda c: F.coalesce(c, F.array().cast(joined.schema[c].dataType))
    merged = both.select("d.doc_id", "n_words", none("hits").alias("hits"), none("items").alias("items"), F.array_except(none("near_items"), none("items")).alias("near_items"))
    # Intervals are sorted by start: each adds what lies past the furthest end so far.
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(a["end"], x["start"]))).alias("n"), F.greatest(a["end"], x["end"]).alias("end")),
        lambda a: a["n"],
    )
    return merged.select(
        "doc_id",
        "n_words",
        covered.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        "items",
        "near_items",
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_words: int = 500_000) -> DataFrame:
    """docs without the rows that hold an exact phrase of a test item; columns stay. A row is known by
    doc_id and the digest of its text."""
    found = matches(materialize(build_index(docs), "index"), benchmark, width, 0, block_words)
    if found is None:
        return docs
    dirty = found.where(F.size("hits") > 0).select("doc_id", "digest").distinct()
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce(docs["text"].cast("string"), F.lit("")))).alias("digest"))
    clean = packed.alias("d").join(dirty.alias("f"), same("d", "f"), "left_anti")
    return clean.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("items").withColumn("near_items", F.array_join("near_items", ","))


OP5_SQL = """
with d as (select doc_id, row_number() over () rid, [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') if x <> ''] w from documents),
b as (select item_id, [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') if x <> ''] w from benchmark),
bw as (select item_id, len(w) n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') g from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i from b where len(w) > 0)),
sizes as (select distinct least(n, 10) s from bw),
dw as (select rid, i, s, array_to_string(w[i:i + s - 1], ' ') g from (select rid, w, s, unnest(range(1, len(w) - s + 2)) i from d, sizes where len(w) >= s)),
hit as (select rid, i, s, item_id from dw join bw on dw.g = bw.g and dw.s = least(bw.n, 10)),
n as (select rid, count(distinct i + k) n_hit from hit, range(10) t(k) where k < s group by rid),
bi as (select item_id, w from b where len(w) > 2),
times as (select t, count(*) c from (select unnest(w) t from b) group by t),
slots as (select item_id, i, unnest(range(least(10, len(w)))) k, w[i + k] t from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i from bi)),
rare as (select item_id, i, list({'k': k, 't': t} order by c, t, k) r from slots join times using (t) group by item_id, i),
dp as materialized (select rid, unnest(range(1, len(w) + 1)) p, unnest(w) t from d),
first as materialized (select rid, item_id, t2, t3, p - k1 + k2 p2, p - k1 + k3 p3 from (select item_id, r[1].t t, r[1].k k1, r[2].t t2, r[2].k k2, r[3].t t3, r[3].k k3 from rare) join dp using (t)),
second as materialized (select distinct f.rid, item_id, t3, p3 from (select *, unnest(range(-3, 4)) o from first) f join dp on dp.rid = f.rid and dp.t = t2 and dp.p = p2 + o),
close as (select distinct rid, item_id from (select *, unnest(range(-3, 4)) o from second) f join (select rid r, p, t from dp) g on g.r = f.rid and g.t = t3 and g.p = p3 + o),
near as (select rid, string_agg(item_id::varchar, ',' order by item_id::varchar) near_items from close anti join hit on hit.rid = close.rid and hit.item_id = close.item_id group by rid),
it as (select rid, count(distinct item_id) n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) items from hit group by rid)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated, coalesce(near_items, '') near_items
from d left join n using (rid) left join it using (rid) left join near using (rid)
"""
