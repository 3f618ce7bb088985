"""Phrase collocations by vertical positional inverted lists.

Texts are cut into pieces and words, and the words of a bounded run of documents are a shard: for every
(lang, word) in it the list of its positions, as differences of 7 bits a byte, with unused positions
between pieces. A list's length is the shard's count; added up over the shards it is exact. Phrases grow
by a word at a time:
1. the words with `least` occurrences in a language get a number each; their lists stay, the others go;
2. in every shard the lists of the frequent words are merge-joined with themselves at the next position,
   which gives the lists of two words; their lengths are added up over the shards;
3. the lists of two words that are frequent are merge-joined with the lists of the next word.
Which pairs are frequent is told to the shards by a bit field of fixed size: a pair whose bit is set without
being frequent costs work, but can't pass, as all counts are exact.

Scores: for every way to cut a phrase in two, a^2 / (l r) in millionths, rounded down, in decimals of 38
digits; the least counts. A phrase goes if a longer candidate that contains it has half of its occurrences.

Edge cases: a null or empty text has no words; a null lang is `und`; a word may hold any characters but
those that cut; ties go to the phrase that is less as UTF-8 bytes; repeated rows count each time; very long
texts make a shard of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table, slim_batches
from .postings import expand, squeeze

BREAK = b"\xff"  # in no UTF-8 text
#: A-Z in lower case; what cuts pieces becomes BREAK, a tab a blank.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else 0xFF if chr(c) in ".,;:!?\n\x0b\x0c\r" else 0x20 if c == 9 else c for c in range(256))
LISTS = "shard string, langs array<string>, words array<string>, counts array<long>, positions binary"
#: Numbers of the bit field's slots: a prime near 2^25, so 4 MB of bits.
SLOTS = 33_554_393
MIX = 7_368_787


def pieces(text: str) -> list[bytes]:
    """The words, with BREAK where a piece ends."""
    return text.encode().translate(FOLD).replace(BREAK, b" \xff ").split()


class Numbers(dict):
    """Numbers of one language's words, in the order of all languages' words."""

    def __init__(self, counter: Iterator[int], names: list[tuple[str, bytes]], lang: str):
        super().__init__({BREAK: -1})
        self.counter, self.names, self.lang = counter, names, lang

    def __missing__(self, word: bytes) -> int:
        n = self[word] = next(self.counter)
        self.names.append((self.lang, word))
        return n


def build_lists(docs: DataFrame, shard_words: int = 1_000_000) -> DataFrame:
    """A row per shard: its words and their position lists, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), count()
        names, parts, numbers, n = [], [], {}, 0
        counter = count()

        def shard() -> pa.RecordBatch:
            nonlocal counter
            ids = np.concatenate(parts)
            where = np.flatnonzero(ids >= 0)
            order = where[np.argsort(ids[where], kind="stable")]
            ids = ids[order]
            new = np.append(True, ids[1:] != ids[:-1])
            packed, _ = squeeze(np.where(new, order, np.diff(order, prepend=0)))
            row = [f"{task}-{next(made)}", [x for x, _ in names], [w.decode() for _, w in names], np.bincount(ids, minlength=len(names)), packed]
            types = [pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]
            for x in (names, parts, numbers):
                x.clear()
            counter = count()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=[c.split()[0] for c in LISTS.split(", ")])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                found = pieces(text.as_py() or "")
                if names and n + len(found) > shard_words:
                    yield shard()
                    n = 0
                own = numbers.get(lang)
                if own is None:
                    own = numbers[lang] = Numbers(counter, names, lang)
                parts.append(np.array([*map(own.__getitem__, found), -1], np.int32))
                n += len(found)
        if names:
            yield shard()

    return docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")), docs["text"].cast("string")).mapInArrow(run, LISTS)


def merge_join(starts: np.ndarray, phrases: np.ndarray, length: int, where: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of phrases (starts, sorted) followed by a word of the postings (where, sorted): starts,
    phrases and words of the longer phrases."""
    at = np.minimum(np.searchsorted(where, starts + length), len(where) - 1)
    met = where[at] == starts + length
    return starts[met], phrases[met], words[at[met]]


def lengths(phrases: np.ndarray, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different (phrase, word), the lengths of their lists, and which of them each occurrence is."""
    keys, of, sizes = np.unique(phrases * n + words, return_inverse=True, return_counts=True)
    return keys // n, keys % n, sizes, of.ravel()


def postings_of(row: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shard's postings of frequent words by position: where, number in the shard; and the words' ids."""
    return np.cumsum(expand(row.column(2)[k].as_buffer())), expand(row.column(1)[k].as_buffer()), np.asarray(row.column(0)[k].values)


def local_words(lists: DataFrame) -> DataFrame:
    """shard, local (the word's number there), lang, word, n."""
    each = F.posexplode(F.arrays_zip("langs", "words", "counts")).alias("local", "w")
    return lists.select("shard", each).select("shard", "local", F.col("w.langs").alias("lang"), F.col("w.words").alias("word"), F.col("w.counts").alias("n"))


def frequent_postings(lists: DataFrame, words: DataFrame) -> DataFrame:
    """ids array<long>, of binary, steps binary: per shard the postings of its frequent words by position, squeezed."""
    known = local_words(lists).select("shard", "local", "lang", "word").join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("shard").agg(F.collect_list(F.struct("local", "id")).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                counts, steps = np.asarray(b.column(0)[k].values), expand(b.column(1)[k].as_buffer())
                pairs = b.column(2)[k].values
                own = np.full(len(counts), -1)
                own[np.asarray(pairs.field("local"))] = np.arange(len(pairs))
                sums = np.cumsum(steps)
                first = np.cumsum(counts) - counts  # a list's first entry is a position, the others are steps
                where = sums - np.repeat(sums[first] - steps[first], counts)
                of = np.repeat(own, counts)
                where, of = where[of >= 0], of[of >= 0]
                order = np.argsort(where)
                yield pa.RecordBatch.from_arrays([pa.array([np.asarray(pairs.field("id"))], pa.list_(pa.int64())), pa.array([squeeze(of[order])[0]], pa.binary()), pa.array([squeeze(np.diff(where[order], prepend=0))[0]], pa.binary())], names=["ids", "of", "steps"])

    return lists.select("shard", "counts", "positions").join(known, "shard").select("counts", "positions", "known").mapInArrow(run, "ids array<long>, of binary, steps binary")


def slot(first: Column | np.ndarray, second: Column | np.ndarray) -> Column | np.ndarray:
    """A pair's slot of the bit field: by remainders, so that no product passes 64 bits."""
    return (first % SLOTS * MIX + second % SLOTS) % SLOTS


def pairs_of(frequent: DataFrame) -> DataFrame:
    """w1, w2, n by shard: the lengths of the lists of two words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                where, of, ids = postings_of(b, k)
                _, first, second = merge_join(where, of, 1, where, of)
                w1, w2, n, _ = lengths(first, second, len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(ids[w1]), pa.array(ids[w2]), pa.array(n)], names=["w1", "w2", "n"])

    return frequent.select("ids", "of", "steps").mapInArrow(run, "w1 long, w2 long, n long")


def triples_of(frequent: DataFrame, field: np.ndarray) -> DataFrame:
    """w1, w2, w3, n by shard: the lists of two words whose bits are set, extended by a third."""
    shared = frequent.sparkSession.sparkContext.broadcast(field)  # SLOTS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for b in batches:
            for k in range(b.num_rows):
                where, of, ids = postings_of(b, k)
                starts, first, second = merge_join(where, of, 1, where, of)
                at = slot(ids[first], ids[second])
                often = (field[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
                starts, first, second = starts[often], first[often], second[often]
                p1, p2, _, phrase = lengths(first, second, len(ids))
                if len(starts):
                    # The pair of the second and third word has to be frequent, too: it starts one further.
                    tail = merge_join(starts, phrase, 1, starts, second)
                    _, phrase, third = tail
                    p, w3, n, _ = lengths(phrase, third, len(ids))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[p1[p]]), pa.array(ids[p2[p]]), pa.array(ids[w3]), pa.array(n)], names=["w1", "w2", "w3", "n"])

    return frequent.select("ids", "of", "steps").mapInArrow(run, "w1 long, w2 long, w3 long, n long")


def bit_field(pairs: DataFrame) -> np.ndarray:
    """The slots of all pairs, as bytes: SLOTS bits, however many pairs there are."""
    at = slot(F.col("w1"), F.col("w2"))
    found = pairs.select(F.shiftright(at, 5).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 32).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(SLOTS // 32 + 1, np.uint32)
    out[np.asarray(found["word"])] = np.asarray(found["bits"]).astype(np.uint32)
    return out.view(np.uint8)


def cut_score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)), exact for counts below 10^15."""
    wide = lambda c: f"cast({c} as decimal(18,0))"
    return F.expr(f"(cast(1000000 as decimal(7,0)) * ({wide(a)} * {wide(a)})) div ({wide(left)} * {wide(right)})")


def named(phrases: DataFrame, words: DataFrame, size: int) -> DataFrame:
    """phrases with t1.. and f1.., the words and their counts, and lang."""
    for k in range(1, size + 1):
        own = words.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"t{k}"), F.col("n").alias(f"f{k}"), *([F.col("lang")] if k == 1 else []))
        phrases = phrases.join(own, f"w{k}")
    return phrases


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, shard_words: int = 1_000_000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of each language."""
    slim_batches(docs.sparkSession)
    lists = materialize(build_lists(docs, shard_words), "lists")
    often = f"n >= {least}"
    words = materialize(local_words(lists).groupBy("lang", "word").agg(F.sum("n").alias("n")).where(often).withColumn("id", F.monotonically_increasing_id()), "frequent_words")
    totals = local_words(lists).groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = materialize(frequent_postings(lists, words), "frequent_lists")
    pairs = materialize(pairs_of(frequent).groupBy("w1", "w2").agg(F.sum("n").alias("n")).where(often), "pairs")
    triples = materialize(triples_of(frequent, bit_field(pairs)).groupBy("w1", "w2", "w3").agg(F.sum("n").alias("n")).where(often), "triples")

    inside = triples.select(F.explode(F.array(F.struct("w1", "w2", "n"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "n"))).alias("p"))
    longer = inside.groupBy(F.col("p.w1").alias("w1"), F.col("p.w2").alias("w2")).agg(F.max("p.n").alias("longer"))
    alone = pairs.join(longer, ["w1", "w2"], "left").where("longer is null or 100 * longer < 50 * n")
    two = named(alone, words, 2).select("lang", F.concat_ws(" ", "t1", "t2").alias("phrase"), F.col("n").alias("a"), F.col("f1").alias("l"), F.col("f2").alias("r"), cut_score("n", "f1", "f2").alias("score"))
    head = pairs.select("w1", "w2", F.col("n").alias("f12"))
    tail = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("n").alias("f23"))
    three = named(triples.join(head, ["w1", "w2"]).join(tail, ["w2", "w3"]), words, 3)
    three = three.withColumn("s1", cut_score("n", "f1", "f23")).withColumn("s2", cut_score("n", "f12", "f3"))
    early = F.col("s1") <= F.col("s2")
    three = three.select("lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), F.col("n").alias("a"), F.when(early, F.col("f1")).otherwise(F.col("f12")).alias("l"), F.when(early, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))

    # Two steps, so that no task ranks the candidates of all others.
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    both = two.union(three).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = both.withColumn("nth", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("nth") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    # One row per language.
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


OP13_SQL = """
with p as (select coalesce(lang, 'und') lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece from documents),
w as (select lang, [x for x in string_split_regex(piece, '[\x20\x09]+') if x <> ''] ws from p),
u as (select lang, t, count(*) f from (select lang, unnest(ws) t from w) group by lang, t),
n as (select lang, sum(f)::bigint n from u group by lang),
b as (select lang, t1, t2, count(*) f from (select lang, ws[i] t1, ws[i + 1] t2 from (select lang, ws, unnest(range(1, len(ws))) i from w)) group by lang, t1, t2 having count(*) >= 10),
t as (select lang, t1, t2, t3, count(*) f from (select lang, ws[i] t1, ws[i + 1] t2, ws[i + 2] t3 from (select lang, ws, unnest(range(1, len(ws) - 1)) i from w)) group by lang, t1, t2, t3 having count(*) >= 10),
x as (select lang, t1, t2, max(f) longer from (select lang, t1, t2, f from t union all select lang, t2, t3, f from t) group by lang, t1, t2),
two as (select b.lang, b.t1 || ' ' || b.t2 phrase, b.f a, u1.f l, u2.f r, (1000000::hugeint * b.f * b.f) // (u1.f::hugeint * u2.f) score
 from b join u u1 on u1.lang = b.lang and u1.t = b.t1 join u u2 on u2.lang = b.lang and u2.t = b.t2 left join x on x.lang = b.lang and x.t1 = b.t1 and x.t2 = b.t2 where longer is null or 100 * longer < 50 * b.f),
three as (select t.lang, t.t1 || ' ' || t.t2 || ' ' || t.t3 phrase, t.f a, u1.f f1, b1.f f12, b2.f f23, u3.f f3, (1000000::hugeint * t.f * t.f) // (u1.f::hugeint * b2.f) s1, (1000000::hugeint * t.f * t.f) // (b1.f::hugeint * u3.f) s2
 from t join u u1 on u1.lang = t.lang and u1.t = t.t1 join u u3 on u3.lang = t.lang and u3.t = t.t3
 join b b1 on b1.lang = t.lang and b1.t1 = t.t1 and b1.t2 = t.t2 join b b2 on b2.lang = t.lang and b2.t1 = t.t2 and b2.t2 = t.t3),
c as (select * from two union all select lang, phrase, a, case when s1 <= s2 then f1 else f12 end, case when s1 <= s2 then f23 else f3 end, least(s1, s2) from three),
k as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from c)
select k.lang, rank::bigint rank, phrase, a::bigint a, l::bigint l, r::bigint r, n.n, score::bigint score from k join n on n.lang = k.lang where rank <= 2000
"""
