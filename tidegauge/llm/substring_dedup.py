"""Removal of long passages that repeat across documents, with suffix automata.

A passage is a run of at least `window` words. Every word covered by a window that also starts in a
document with a smaller doc_id is removed.

The reference of a document is every document before it, so reference shards are cut by content and
meet the documents by shuffle: each window is filed under the first of the word runs (of `anchor`
words) in it, in one order for all. Runs that occur very often come last in that order, else by hash: a
window that reaches over the end of a common line is filed under its own surroundings, and only what
lies inside the line under the line, where all documents hold the same. Neighbouring windows filed
under the same run form a snippet, and any two documents that share a window share its shard. Shards
of one document, and shards in which all snippets are equal, need no search. In the others a suffix
automaton is built of the snippets in doc_id order: each snippet is streamed through it for matching
statistics, the windows matched by earlier ones are noted, and only the rest is added. Shards of more
than `max_snippets` different snippets or of too many words are cut into finer ones by longer anchors,
at last by the whole window, where each piece is one window (or a run of equal ones) and the least
doc_id that holds it decides.

Often is: in one of FILES equal files of runs by hash, whose occurrences in all documents are a 2000th of
the documents at least. So the table has the same size for any corpus; a rare run that shares its file
with a common one comes late too, which changes who finds a repeat, not what is found.

`remove_known` is the plain form for a reference of bounded size: its automata are broadcast.

Edge cases: a null text has no words; rows with a null doc_id keep all words and remove none; rows
of one doc_id never remove each other's words; repeated rows have equal results; a document of fewer
than `window` words is kept whole; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table
from .words import MIX, WordHasher, grams, mix

WINDOW, ANCHOR = 50, 8
MAX_SNIPPETS = 256
MAX_SHARD_BYTES = 400_000  # eight a word; bounds an automaton
FILES, OFTEN = 1 << 22, 2000
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
BLANKS = bytes(0x20 if c == 0x20 or 9 <= c <= 13 else c for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(BLANKS).split(b" ") if text else []


def word_list(text: str | None) -> list[bytes]:
    return [w for w in words(text) if w]


class SuffixAutomaton:
    """Of word sequences, separated by marks that no sequence holds."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.last, self.marks = 0, 0

    def _extend(self, c) -> None:
        nxt, link, length = self.next, self.link, self.length
        cur = len(nxt)
        nxt.append({})
        length.append(length[self.last] + 1)
        link.append(0)
        p = self.last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        self.last = cur

    def add(self, sequence: list) -> None:
        for c in sequence:
            self._extend(c)
        self.marks += 1
        self._extend(("mark", self.marks))

    def statistics(self, sequence: list) -> np.ndarray:
        """For each place, the longest run ending there that the automaton knows."""
        nxt, link, length = self.next, self.link, self.length
        state = matched = 0
        out = np.zeros(len(sequence), dtype=np.int64)
        for i, c in enumerate(sequence):
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                matched += 1
            else:
                matched = 0
            out[i] = matched
        return out


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and past-the-last index of each run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least value in each run of w, in about log w passes."""
    have, out = 1, x
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    n = len(x) - w + 1
    return np.minimum(out[:n], out[w - have : w - have + n])


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of MIX and of its inverse, modulo 2^64."""
    inverse = np.uint64(pow(int(MIX), -1, 1 << 64))
    up, down = np.full(n, MIX, dtype=np.uint64), np.full(n, inverse, dtype=np.uint64)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def content(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the words in each [start, end)."""
    up, down = powers(len(hashes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[:-1], dtype=np.uint64)])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * MIX)


def file_of(runs_: np.ndarray) -> np.ndarray:
    return (runs_ >> np.uint64(40)) % np.uint64(FILES)


def snippets_of(hashes: np.ndarray, window: int, anchor: int, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shard, content hash, first window and number of windows of each snippet of a document. common:
    whether a file's runs come last."""
    if len(hashes) < window:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    anchors = grams(hashes, anchor)
    if common is not None:
        anchors = anchors >> np.uint64(1) | common[file_of(anchors)].astype(np.uint64) << np.uint64(63)
    least = sliding_min(anchors, window - anchor + 1)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    count = np.diff(np.append(first, len(least)))
    return least[first].view(np.int64), content(hashes, first, first + count + window - 1).view(np.int64), first, count


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, th (tells texts of one doc_id apart), text."""
    text = docs["text"].cast("string")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), text.alias("text"))


def common_files(docs: DataFrame, anchor: int) -> np.ndarray:
    """Which files of runs are common: one flag for each. A task sends the files that are common in its
    own share of the documents, a few of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        have, parts, held, docs_seen = np.zeros(FILES, dtype=np.int32), [], 0, 0

        def add():
            nonlocal have, held
            if parts:
                have += np.bincount(np.concatenate(parts), minlength=FILES).astype(np.int32)
                parts.clear()
                held = 0

        for b in batches:
            docs_seen += b.num_rows
            for text in b.column(0):
                hashes = hasher(word_list(text.as_py()))
                if len(hashes) >= anchor:
                    parts.append(file_of(grams(hashes, anchor)).astype(np.int64))
                    held += len(hashes)
                if held > 2_000_000:
                    add()
        add()
        at = np.flatnonzero(have >= max(4, docs_seen // OFTEN))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(have[at], docs_seen).astype(np.int64))], names=["file", "n"])

    sums = docs.select(docs["text"].cast("string")).mapInArrow(run, "file long, n long").groupBy("file").agg(F.sum("n").alias("n"))
    # File -1 has the documents. What comes to the driver is OFTEN times the mean words of a document at most.
    sums = materialize(sums, "files")
    total = sums.where("file = -1").agg(F.sum("n")).first()[0] or 0
    flags = np.zeros(FILES, dtype=bool)
    flags[sums.where((F.col("file") >= 0) & (F.col("n") >= max(32, total // OFTEN))).select("file").toPandas()["file"].to_numpy(dtype=np.int64)] = True
    return flags


def file_snippets(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(common_files(docs, anchor)))  # FILES bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        common = np.unpackbits(shared.value).astype(bool)
        names = ["doc_id", "th", "shard", "content", "start", "count"]
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                rows, cols = [], [[], [], [], []]
                for text in part.column(2):
                    found = snippets_of(hasher(word_list(text.as_py())), window, anchor, common)
                    rows.append(len(found[0]))
                    for c, x in zip(cols, found):
                        c.append(x)
                at = pa.array(np.repeat(np.arange(part.num_rows), rows))
                arrays = [part.column(0).take(at), part.column(1).take(at), *(pa.array(np.concatenate(c).astype(np.int64)) for c in cols)]
                yield pa.RecordBatch.from_arrays([*arrays[:4], arrays[4].cast(pa.int32()), arrays[5].cast(pa.int32())], names=names)

    rows = _texts(docs).where("doc_id is not null")
    return rows.mapInArrow(run, "doc_id long, th long, shard long, content long, start int, count int")


def snippet_words(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """wanted (shard, content, doc_id, th, start, count) with the words' hashes."""
    per_doc = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("shard", "content", "start", "count")).alias("snippets"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for b in batches:
            for k in range(b.num_rows):
                doc_id, th = b.column(0)[k].as_py(), b.column(1)[k].as_py()
                hashes = hasher(word_list(b.column(2)[k].as_py()))
                found = b.column(3)[k].as_py()
                if found:
                    tokens = [hashes[s["start"] : s["start"] + s["count"] + window - 1].tobytes() for s in found]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([s["shard"] for s in found], pa.int64()), pa.array([s["content"] for s in found], pa.int64()), pa.array([doc_id] * len(found), pa.int64()),
                         pa.array([th] * len(found), pa.int64()), pa.array([s["start"] for s in found], pa.int32()), pa.array(tokens, pa.binary())],
                        names=["shard", "content", "doc_id", "th", "start", "tokens"],
                    )

    texts = _texts(docs).join(per_doc, ["doc_id", "th"]).select("doc_id", "th", "text", "snippets")
    return texts.mapInArrow(run, "shard long, content long, doc_id long, th long, start int, tokens binary")


def search_shards(tokens: DataFrame, window: int) -> DataFrame:
    """(shard, content, s, e): the windows [s, e), counted from the snippet's start, that a snippet of
    a smaller doc_id in its shard holds. Shards are read sorted, one automaton at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, automaton = None, SuffixAutomaton()
        late: list[list] = []  # snippets of the current doc_id, added when the next one comes
        doc = None
        for b in batches:
            out = []
            for sh, ct, doc_id, tok in zip(*(b.column(c).to_pylist() for c in range(4))):
                if sh != shard:
                    shard, automaton, late, doc = sh, SuffixAutomaton(), [], None
                if doc_id != doc:
                    for part in late:
                        automaton.add(part)
                    late, doc = [], doc_id
                sequence = np.frombuffer(tok, np.uint64).tolist()
                known = automaton.statistics(sequence)[window - 1 :] >= window
                out += [(sh, ct, s, e) for s, e in runs(known)]
                late += [sequence[s : e + window - 1] for s, e in runs(~known)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["shard", "content", "s", "e"])

    dealt = tokens.select("shard", "content", "doc_id", "tokens").repartition("shard").sortWithinPartitions("shard", "doc_id", "content")
    return dealt.select("shard", "content", "doc_id", "tokens").mapInArrow(run, "shard long, content long, s int, e int")


def refile(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """rows (shard, content, doc_id, tokens) cut anew by longer anchors: shard, content, doc_id, off
    (first window), count, and sub, sub_content, sub_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "content", "doc_id", "off", "count", "sub", "sub_content", "sub_tokens"]
        for b in batches:
            pieces, cols, tokens = [], [[], [], [], []], []
            for tok in b.column(3):
                h = np.frombuffer(tok.as_py(), np.uint64)
                sub, content_of, first, count = snippets_of(h, window, anchor)
                pieces.append(len(sub))
                for c, x in zip(cols, (first, count, sub, content_of)):
                    c.append(x)
                tokens += [h[f : f + n + window - 1].tobytes() for f, n in zip(first.tolist(), count.tolist())]
            if tokens:
                at = pa.array(np.repeat(np.arange(b.num_rows), pieces))
                off, count, sub, content_of = (np.concatenate(c) for c in cols)
                arrays = [*(b.column(c).take(at) for c in range(3)), pa.array(off.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(sub), pa.array(content_of), pa.array(tokens, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.select("shard", "content", "doc_id", "tokens").mapInArrow(run, "shard long, content long, doc_id long, off int, count int, sub long, sub_content long, sub_tokens binary")


def settle(rows: DataFrame, window: int, anchors: tuple[int, ...], max_snippets: int) -> DataFrame:
    """rows (shard, content, doc_id, tokens), one per different snippet and with its least doc_id ->
    (shard, content, s, e): the windows [s, e) that a row of a smaller doc_id holds. Crowded shards
    are cut by the first of anchors; the last anchor is the window itself, where a sub is one window,
    known to all rows but those of its least doc_id."""
    size = F.sum(F.octet_length("tokens"))
    crowds = rows.groupBy("shard").agg((F.count(F.lit(1)) > max_snippets).alias("many"), (size > MAX_SHARD_BYTES).alias("long"))
    sized = rows.join(crowds.select("shard", (F.col("many") | F.col("long")).alias("crowded")), "shard")
    searched = search_shards(sized.where(~F.col("crowded")), window)
    sub = materialize(refile(sized.where("crowded"), window, anchors[0]), "refiled")
    shared = sub.groupBy("sub").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    if len(anchors) == 1:
        # Runs of one word differ in length, and so in content, but their windows are the same.
        placed = sub.drop("sub_tokens").join(shared.select("sub", "low"), "sub").where(F.col("doc_id") > F.col("low"))
        return materialize(searched.union(placed.select("shard", "content", F.col("off").alias("s"), (F.col("off") + F.col("count")).alias("e"))), "settled")
    sub = sub.join(shared.select("sub"), "sub")
    owners = sub.groupBy("sub", "sub_content").agg(F.min("doc_id").alias("owner"))
    placed = sub.drop("sub_tokens").join(owners, ["sub", "sub_content"])
    found = placed.where(F.col("doc_id") > F.col("owner")).select("shard", "content", F.col("off").alias("s"), (F.col("off") + F.col("count")).alias("e"))
    firsts = sub.groupBy("sub", "sub_content").agg(F.min("doc_id").alias("doc_id"), F.first("sub_tokens").alias("tokens"))
    several = firsts.groupBy("sub").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sub")
    firsts = materialize(firsts.join(several, "sub").select(F.col("sub").alias("shard"), F.col("sub_content").alias("content"), "doc_id", "tokens"), "firsts")
    inner = settle(firsts, window, anchors[1:], max_snippets).select(F.col("shard").alias("sub"), F.col("content").alias("sub_content"), "s", "e")
    own = placed.where(F.col("doc_id") == F.col("owner")).join(inner, ["sub", "sub_content"])
    found = found.union(own.select("shard", "content", (F.col("off") + F.col("s")).alias("s"), (F.col("off") + F.col("e")).alias("e")))
    return materialize(searched.union(found), "settled")


def repeated_intervals(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, max_snippets: int = MAX_SNIPPETS) -> DataFrame:
    """(doc_id, th, s, e): the words [s, e) to remove, intervals may overlap."""
    filed = materialize(file_snippets(docs, window, anchor), "snippets")
    shards = filed.groupBy("shard").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("shard")
    shared = materialize(filed.join(shards, "shard"), "shared")
    per_content = shared.groupBy("shard", "content").agg(F.min(F.struct("doc_id", "th", "start", "count")).alias("first"))
    crowd = per_content.groupBy("shard").agg(F.count(F.lit(1)).alias("contents"))
    firsts = materialize(per_content.join(crowd, "shard").select("shard", "content", "first.*", "contents"), "firsts")
    tokens = materialize(snippet_words(docs, firsts.where("contents > 1").select("shard", "content", "doc_id", "th", "start", "count"), window), "tokens")
    early = settle(tokens, window, (max(anchor, window * 2 // 3), window), max_snippets)

    owners = firsts.select("shard", "content", F.col("doc_id").alias("owner"))
    placed = shared.join(owners, ["shard", "content"])
    later = placed.where(F.col("doc_id") > F.col("owner")).select("doc_id", "th", F.col("start").alias("s"), (F.col("start") + F.col("count") + window - 1).alias("e"))
    own = placed.where(F.col("doc_id") == F.col("owner")).join(early, ["shard", "content"])
    own = own.select("doc_id", "th", (F.col("start") + F.col("s")).alias("s"), (F.col("start") + F.col("e") + window - 1).alias("e"))
    return later.union(own)


def _cut(text: str | None, intervals: list[dict] | None) -> tuple[int, list[bytes]]:
    w = word_list(text)
    if not intervals:
        return len(w), w
    gone = np.zeros(len(w) + 1, dtype=np.int64)
    np.add.at(gone, [x["s"] for x in intervals], 1)
    np.add.at(gone, [x["e"] for x in intervals], -1)
    keep = np.cumsum(gone)[:-1] == 0
    return len(w), [x for x, k in zip(w, keep.tolist()) if k]


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, max_snippets: int = MAX_SNIPPETS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words left, joined by a blank) for each row."""
    found = repeated_intervals(docs, window, anchor, max_snippets).groupBy("doc_id", "th").agg(F.collect_set(F.struct("s", "e")).alias("intervals"))
    joined = _texts(docs).join(found, ["doc_id", "th"], "left").select("doc_id", "text", "intervals")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, sha, kept = [], [], [], []
            for text, intervals in zip(b.column(1), b.column(2)):
                total, left = _cut(text.as_py(), intervals.as_py())
                body = b" ".join(left)
                n.append(total)
                removed.append(total - len(left))
                sha.append(hashlib.sha256(body).hexdigest())
                kept.append(body.decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def remove_known(docs: DataFrame, reference: DataFrame, window: int = WINDOW, max_words: int = 2_000_000) -> DataFrame:
    """docs without the runs of at least `window` words that occur in reference (text), whose
    automata, one per shard of rows, are broadcast; more than max_words in it is an error."""
    lists, total = [], 0
    for r in reference.select(F.col("text").cast("string")).toLocalIterator():
        lists.append(word_list(r[0]))
        total += len(lists[-1])
        if total > max_words:
            raise ValueError(f"the reference has more than {max_words} words; use remove_repeats")
    shared = docs.sparkSession.sparkContext.broadcast([lists[k::8] for k in range(min(8, len(lists)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = []
        for shard in shared.value:
            automata.append(SuffixAutomaton())
            for sequence in shard:
                automata[-1].add(sequence)
        for b in batches:
            kept, removed = [], []
            for text in b.column(1):
                w = word_list(text.as_py())
                intervals = []
                for a in automata if len(w) >= window else []:
                    intervals += [{"s": s, "e": e + window - 1} for s, e in runs(a.statistics(w)[window - 1 :] >= window)]
                left = _cut(text.as_py(), intervals)[1]
                removed.append(len(w) - len(left))
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_removed", "kept"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, "doc_id long, n_removed long, kept string")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents")).drop("kept")


OP6_SQL = """
with d as (select doc_id, row_number() over () rid, [x for x in string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') if x <> ''] w from documents),
g as (select rid, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) h from (select rid, doc_id, w, unnest(range(1, len(w) - 48)) i from d where len(w) >= 50)),
m as (select h, min(doc_id) low, max(doc_id) high from g group by h having min(doc_id) < max(doc_id)),
r as (select distinct g.rid, g.i + k i from g join m on g.h = m.h and m.low < g.doc_id, range(50) t(k)),
k as (select d.rid, count(r.i) n_removed, coalesce(string_agg(x.word, ' ' order by x.i) filter (where r.i is null), '') kept
 from d, unnest(d.w) with ordinality x(word, i) left join r on r.rid = d.rid and r.i = x.i group by d.rid)
select doc_id, len(w)::bigint n_words, coalesce(n_removed, 0)::bigint n_removed, sha256(coalesce(kept, '')) kept_sha256 from d left join k using (rid)
"""
