"""Near-duplicate classes with Order MinHash.

A text is its sequence of words, in lower case and without the punctuation around them, and its k-word
shingles are each labelled with how often they occurred before. Every band takes the `picks` smallest
labelled shingles under its own hash and keeps them in text order; texts that agree in a band meet in a
bucket; the texts of a bucket of more than `small` also meet in smaller ones, by one shingle more. Candidate pairs are verified by banded alignment of their words: the longest common subsequence
inside the band of shifts that the threshold allows. The similarity is the share of the longer text's words
that is aligned, and a link needs `threshold`.

Buckets can be huge, so links are sought in rounds, each bounded by what it finds:
1. each member with its bucket's hub (the member whose buckets hold most texts: the common original
   of a group of copies), and all pairs of buckets of up to `small` members;
2. where members of a larger bucket are still in different classes, pairs across classes, found by
   the exact prefix filter: their rarest shingles, in one order for all, must meet early enough for
   a share of `shared` common shingles. A text outside the main class meets a few members of another class first, then 16
   times as many, and so on to all of them; as soon as one link is found, the two are one class and
   the rest of their pairs is not looked at.
Pairs inside one class need no further look. Exact copies are one text throughout. All pairs of a
text and a class are compared only if the text might reach the threshold with each of them and
does with none. So all pairs of a bucket with that share of common shingles are linked; less similar ones
are by a hub or a small bucket (recall is measured in the tests).

Edge cases: a null text counts as empty, and equal (also empty) texts are copies; texts of fewer
than k words are a single shingle; a class takes the least doc_id in it (nulls are ignored unless
there is nothing else); repeated rows are copies; very long texts are handled whole; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import distilled, materialize, read_table
from .components import components
from .words import MIX, WordHasher, bare, grams, mix

K, THRESHOLD, BANDS, PICKS = 5, 0.8, 16, 2
SHARED = 0.8  # of the shingles, from which the search across classes is exact
SMALL_BUCKET = 8
SLOTS = 1 << 20  # of the table of shingle counts
MARKS = 1 << 26  # bits of the table of wanted texts
STEP = 16  # a round across classes meets so many times the members of the round before


def hasher() -> WordHasher:
    return WordHasher(fold=bare)


def labelled(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the shingles of hashed words, each with its number of earlier occurrences."""
    g = grams(words, k)
    if len(g) > 1:
        order = np.argsort(g, kind="stable")
        ranked = g[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        if not new.all():
            place = np.arange(len(g))
            nth = (place - np.maximum.accumulate(np.where(new, place, 0))).astype(np.uint64)
            g = g.copy()
            # A first occurrence keeps its hash, whether or not anything in the text is repeated.
            g[order] = np.where(nth > 0, mix(ranked + nth * MIX), ranked)
    return g


def sketch_keys(g: np.ndarray, seeds: np.ndarray, picks: int) -> np.ndarray:
    """Two bucket keys per band, from the smallest shingles in text order: `picks` of them, and one more."""
    deep = min(picks + 1, len(g))
    chosen = np.empty((len(seeds), deep), dtype=np.uint64)
    few = np.empty((len(seeds), min(picks, len(g))), dtype=np.uint64)
    for band, seed in enumerate(seeds):
        rank = (g ^ seed) * MIX
        rank ^= rank >> np.uint64(31)
        at = np.argpartition(rank, deep - 1)[:deep]
        at = at[np.argsort(rank[at])]
        few[band] = g[np.sort(at[:picks])]
        chosen[band] = g[np.sort(at)]
    out = []
    for columns in (few, chosen):
        keys = seeds
        for column in columns.T:
            keys = mix(keys * MIX + column)
        out.append(keys)
    return np.concatenate(out)


def alignment(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """Share of the longer text's words in the longest common subsequence within the band, or 0 below the
    threshold. A row of the alignment is one number whose zero bits are its steps."""
    n, m = len(a), len(b)
    need = math.ceil(threshold * max(n, m) - 1e-9)
    if min(n, m) < need:
        return 0.0
    words, of = np.unique(np.concatenate([a, b]), return_inverse=True)
    have = [np.bincount(x, minlength=len(words)) for x in (of[:n], of[n:])]
    if np.minimum(*have).sum() < need:  # not enough words in common in any order
        return 0.0
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    full = row = (1 << n) - 1
    ahead, behind = n - need, m - need  # a wider shift leaves too many unaligned
    for j, y in enumerate(b.tolist()):
        met = places.get(y)
        if met is not None:
            low = max(0, j - behind)
            met = (met >> low & (1 << j + ahead + 1 - low) - 1) << low
            step = row & met
            row = (row + step | row - step) & full
    common = n - row.bit_count()
    return common / max(n, m) if common >= need else 0.0


def digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def signatures(docs: DataFrame, k: int, bands: int, picks: int) -> DataFrame:
    """doc_id, rid (digest of the text), n shingles, the bands' keys and then their deeper ones."""
    seeds = mix((np.arange(1, bands + 1, dtype=np.uint64)) * MIX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = hasher()
        for b in batches:
            n, keys = [], []
            for text in b.column(2):
                g = labelled(hashed((text.as_py() or "").split()), k)
                n.append(len(g))
                keys.append(sketch_keys(g, seeds, picks).view(np.int64) if len(g) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "rid", "n", "keys"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), digest(docs["text"]).alias("rid"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, rid binary, n int, keys array<long>")


def sized(members: DataFrame, name: str) -> DataFrame:
    """key, size of the buckets with company."""
    # Tables of their own on the small side of a join let Spark split a hot key on the other side.
    return materialize(members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), name)


def bucketed(sigs: DataFrame, small: int) -> DataFrame:
    """key, size, whole, node, n of every text in a bucket with company; the texts of a bucket of more than `small`
    are in it and, with whole false, in those of their deeper keys too. A node is the text's digest behind a number that is least for the texts that
    share most buckets: hubs come first in any order."""
    texts = sigs.where("n > 0").groupBy("rid").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    bands = F.size("keys") / 2
    both = F.arrays_zip(F.slice("keys", 1, bands.cast("int")).alias("key"), F.slice("keys", bands.cast("int") + 1, bands.cast("int")).alias("deeper"))
    members = texts.select("rid", "n", F.explode(both).alias("k")).select("rid", "n", F.col("k.key").alias("key"), F.col("k.deeper").alias("deeper"))
    # A merge at any size: members and sizes both grow with the corpus.
    met = materialize(members.join(sized(members, "sizes").hint("merge"), "key"), "met")
    crowd = met.where(F.col("size") > small).select("rid", "n", F.col("deeper").alias("key"))
    split = crowd.join(sized(crowd, "deep_sizes"), "key").select("key", "size", F.lit(False).alias("whole"), "rid", "n")
    famous = met.select("key", "size", F.lit(True).alias("whole"), "rid", "n").union(split).withColumn("fame", F.sum("size").over(Window.partitionBy("rid")))
    rank = F.to_binary(F.lpad(F.hex(F.lit(1 << 62) - F.col("fame")), 16, "0"), F.lit("hex"))
    return famous.select("key", "size", "whole", F.concat(rank, "rid").alias("node"), "n")


def digest_of(node: str) -> Column:
    return F.substring(node, 9, 16)


def near_length(threshold: float, more: int = 0) -> Column:
    """Whether texts of n and n2 shingles (words: so many more) can reach the threshold."""
    return F.least("n", "n2") + more >= threshold * (F.greatest("n", "n2") + more) - 1e-9


def marked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows (rid, ...) whose rid may be in wanted (rid), by a table of MARKS bits: all that are, and few others."""
    slot = F.pmod(F.xxhash64("rid"), F.lit(MARKS))
    bits = wanted.groupBy(F.bitmap_bucket_number(slot).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    place = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = rows.withColumn("part", F.bitmap_bucket_number(slot)).join(F.broadcast(bits), "part")
    return met.where(F.getbit(byte, (place % 8).cast("int")) == 1).select(*rows.columns)


def worded(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, words (hashes) of the wanted nodes. Both sides grow with the corpus, so the join
    is a merge at any size; most texts that nobody wants are left out before it."""
    texts = docs.select(digest(docs["text"]).alias("rid"), docs["text"].cast("string").alias("text"))
    wanted = materialize(wanted.select("node", digest_of("node").alias("rid")), "wanted")
    # One row per text is left before the texts are read a second time.
    texts = marked(texts, wanted).hint("merge").join(wanted, "rid").dropDuplicates(["rid"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = hasher()
        for b in batches:
            words = [hashed((t.as_py() or "").split()).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.int64()))], names=["node", "words"])

    return texts.select("node", "text").mapInArrow(run, "node binary, words array<long>")


def lists(column: pa.ListArray) -> list[np.ndarray]:
    values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[s:e] for s, e in zip(offsets[:-1], offsets[1:])]


def token_counts(rest: DataFrame, k: int) -> np.ndarray:
    """In how many texts of rest (words, ...) the shingles of each of 2^20 slots occur, added up over tasks in two
    steps: a table of fixed size, however many texts there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(SLOTS, np.uint32)
        for b in batches:
            for w in lists(b.column(0)):
                sums += np.bincount((labelled(w.view(np.uint64), k) % SLOTS).astype(np.int64), minlength=SLOTS).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 64], pa.int32()), pa.array([zlib.compress(sums.tobytes(), 1)], pa.binary())], names=["part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        sums = np.zeros(SLOTS, np.uint32)
        for x in table.column("counts"):
            sums += np.frombuffer(zlib.decompress(x.as_py()), np.uint32)
        return pa.table({"part": pa.array([0], pa.int32()), "counts": pa.array([zlib.compress(sums.tobytes(), 1)], pa.binary())})

    out = "part int, counts binary"
    found = rest.select("words").mapInArrow(count, out).groupBy("part").applyInArrow(add, out).groupBy("part").applyInArrow(add, out).first()
    return np.frombuffer(zlib.decompress(found["counts"]), np.uint32) if found else np.zeros(SLOTS, np.uint32)


def prefixes(rest: DataFrame, k: int, shared: float) -> DataFrame:
    """rest (node, n, class, outside, words) -> token, texts, node, n, class, outside, place for a text's rarest
    shingles, so many that two texts with that share in common must have one of them both. In the order for all,
    shingles come by the count of their slot, which is an upper bound of their own; those that are in one text
    only are counted in the places, but need no row."""
    counts = rest.sparkSession.sparkContext.broadcast(token_counts(rest, k))  # SLOTS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counts.value
        for b in (b for b in batches if b.num_rows):
            rows, tokens, texts, places = [], [], [], []
            for at, w in enumerate(lists(b.column(4))):
                g = labelled(w.view(np.uint64), k)
                times = known[(g % SLOTS).astype(np.int64)]
                order = np.lexsort((g, times))[: len(g) - math.ceil(shared * len(g) - 1e-9) + 1]
                first = int(np.searchsorted(times[order], 2))
                rows.append(np.full(len(order) - first, at))
                places.append(np.arange(first, len(order)))
                tokens.append(g[order[first:]].view(np.int64))
                texts.append(times[order[first:]].astype(np.int64))
            take = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(texts)), *(b.column(c).take(take) for c in range(4)), pa.array(np.concatenate(places).astype(np.int32))], names=["token", "texts", "node", "n", "class", "outside", "place"])

    return rest.select("node", "n", "class", "outside", "words").mapInArrow(run, "token long, texts long, node binary, n int, class binary, outside boolean, place int")


def mixed(filed: DataFrame) -> DataFrame:
    """The rows of prefixes whose token is in several classes and in a text outside: no other pair is looked at."""
    tokens = filed.groupBy("token").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.max("outside").alias("any")).where("low <> high and any").select("token")
    return materialize(filed.join(materialize(tokens, "tokens"), "token"), "filed")


def verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b, ...) of nodes whose texts align."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("words").alias("wa")), "a").join(texts.select(F.col("node").alias("b"), F.col("words").alias("wb")), "b")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pa.array([alignment(x, y, threshold) > 0 for x, y in zip(lists(b.column(b.num_columns - 2)), lists(b.column(b.num_columns - 1)))], pa.bool_())
            yield b.select(["a", "b", *rest]).filter(keep)

    return both.select("a", "b", *rest, "wa", "wb").mapInArrow(align, pairs.select("a", "b", *rest).schema)


def across_classes(filed: DataFrame, texts: DataFrame, threshold: float, shared: float) -> DataFrame | None:
    """Links (u, v) between classes of texts that, by their prefixes, may have that share of shingles in common."""
    most = filed.agg(F.max("texts")).first()[0]
    if most is None:
        return None
    links = None
    share = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / float(1 << 30)
    rounds = max(0, int(np.ceil(np.log(most) / np.log(STEP))) - 1)
    for r in range(rounds, -1, -1):
        rows = filed.drop("texts")
        if links is not None:  # a class with a link is called by the least class that it is linked with
            names = links.groupBy("u").agg(F.min("v").alias("name"))
            rows = rows.join(names.withColumnRenamed("u", "class"), "class", "left").withColumn("class", F.coalesce("name", "class")).drop("name")
        some = rows.where((share < float(STEP) ** -r) & ((share >= float(STEP) ** -(r + 1)) | F.lit(r == rounds)))
        theirs = some.select("token", F.col("node").alias("b"), F.col("n").alias("n2"), F.col("class").alias("class2"), F.col("place").alias("place2"))
        # What two texts can still have in common from their first common shingle on must be enough.
        need = shared / (1 + shared) * (F.col("n") + F.col("n2")) - 1e-9
        reach = F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2")) >= need
        met = rows.where("outside").withColumnRenamed("node", "a").join(theirs, "token").where((F.col("class") != F.col("class2")) & reach & near_length(shared))
        pairs = materialize(met.select("a", "b", F.greatest("class", "class2").alias("u"), F.least("class", "class2").alias("v")).distinct(), "across")
        found = verify(pairs, texts, threshold).select("u", "v").distinct()
        links = materialize(found if links is None else links.union(found), "linked")
    return links


def classes_of(docs: DataFrame, sigs: DataFrame, k: int = K, threshold: float = THRESHOLD, small: int = SMALL_BUCKET, shared: float = SHARED) -> DataFrame:
    """rid, component: the classes of texts that have links."""
    buckets = distilled(docs.sparkSession, lambda: bucketed(sigs, small), "buckets")
    hubs = materialize(buckets.groupBy("key").agg(F.min(F.struct("node", "n")).alias("hub")), "hubs")
    starred = buckets.join(hubs, "key").select(F.col("hub.node").alias("a"), F.col("node").alias("b"), "n", F.col("hub.n").alias("n2"))
    few = buckets.where((F.col("size") > 2) & (F.col("size") <= small)).select("key", "node", "n")
    other = few.select("key", F.col("node").alias("b"), F.col("n").alias("n2"))
    close = few.withColumnRenamed("node", "a").join(other, "key").select("a", "b", "n", "n2")
    first = materialize(starred.union(close).where((F.col("a") < F.col("b")) & near_length(threshold, k - 1)).select("a", "b").distinct(), "pairs")
    large = buckets.where(F.col("whole") & (F.col("size") > small)).select("key", "node", "n")
    wanted = first.select(F.explode(F.array("a", "b")).alias("node")).union(large.select("node")).distinct()
    texts = materialize(worded(docs, wanted), "words")
    found = components(verify(first, texts, threshold).select(F.col("a").alias("u"), F.col("b").alias("v")))

    # Larger buckets whose members are in several classes; outside: not in the largest of them.
    classed = materialize(large.join(found, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("class")), "classed")
    counts = classed.groupBy("key", "class").agg(F.count(F.lit(1)).alias("c"))
    split = materialize(counts.groupBy("key").agg(F.count(F.lit(1)).alias("classes"), F.max(F.struct("c", "class"))["class"].alias("main")).where("classes > 1").select("key", "main"), "split")
    rest = classed.join(split, "key").groupBy("node").agg(F.first("n").alias("n"), F.first("class").alias("class"), F.max(F.col("class") != F.col("main")).alias("outside"))
    rest = materialize(rest.join(texts, "node"), "rest")
    more = across_classes(mixed(materialize(prefixes(rest, k, shared), "prefixes")), texts, threshold, shared)
    if more is not None:
        merged = components(more)
        found = found.join(merged.select(F.col("node").alias("component"), F.col("component").alias("whole")), "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
        # Classes of a single text are in no component of the first round.
        found = found.union(merged.join(found.select("node"), "node", "left_anti").select("node", "component"))
    return found.select(digest_of("node").alias("rid"), "component")


def text_classes(docs: DataFrame, sigs: DataFrame, k: int, threshold: float) -> DataFrame:
    """rid, first_doc, class_id, class_docs, n_copies, chosen: one row per text."""
    found = materialize(classes_of(docs, sigs, k, threshold), "classes")
    texts = sigs.groupBy("rid").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n_copies")).join(found, "rid", "left")
    # A text without links is a class of its own.
    texts = materialize(texts.withColumn("component", F.coalesce("component", "rid")), "texts")
    order = F.struct(F.col("first_doc").isNull().alias("none"), "first_doc", "rid")
    classes = materialize(texts.groupBy("component").agg(F.min("first_doc").alias("class_id"), F.sum("n_copies").alias("class_docs"), F.min(order)["rid"].alias("chosen")), "summed")
    return texts.join(classes, "component").select("rid", "first_doc", "class_id", "class_docs", "n_copies", (F.col("chosen") == F.col("rid")).alias("chosen"))


def near_duplicates(docs: DataFrame, k: int = K, threshold: float = THRESHOLD, bands: int = BANDS, picks: int = PICKS) -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id of its class), class_docs, n_copies (rows
    with the same text), and `stays`: whether its text is the class's chosen one. Also rid, the
    text's digest."""
    sigs = materialize(signatures(docs, k, bands, picks), "signatures")
    per_text = distilled(docs.sparkSession, lambda: text_classes(docs, sigs, k, threshold), "per_text")
    out = sigs.select("doc_id", "rid").join(per_text, "rid")
    return out.select("doc_id", "class_id", "class_docs", "n_copies", (F.col("chosen") & F.col("doc_id").eqNullSafe(F.col("first_doc"))).alias("stays"), "rid")


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """docs with one document of each class: the row with the least doc_id; columns stay."""
    found = near_duplicates(docs, **parameters).where("stays").select(F.col("doc_id").alias("_stays_id"), F.col("rid").alias("_stays_rid")).distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("_id"), digest(docs["text"]).alias("_rid"))
    kept = rows.join(found, (F.col("_rid") == F.col("_stays_rid")) & F.col("_id").eqNullSafe(F.col("_stays_id")), "left_semi")
    # Of rows with one doc_id and text the least stays, by all their columns.
    kept = kept.groupBy("_rid").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).drop("rid")
