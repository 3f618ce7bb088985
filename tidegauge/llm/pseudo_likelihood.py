"""Document scores by masked pseudo-likelihood.

A window network predicts every token from the tokens on both sides: embeddings of `radius`
neighbours left and right, each weighted by place, are summed, passed through a tanh layer, and three
softmax layers give the token's class, its part of the class and the token within the part. A document's
score is the sum over its tokens of log P(token | both sides).

Tokens are words and punctuation. Their vocabulary comes from the counts over all documents and grows
with the corpus: the most frequent ones, up to twice the root of the number of tokens, never under
4096 if there are so many and never over MOST_VOCAB, have a number of their own; the others, all less frequent, are spread by hash
over further numbers, and the probability of such a number is divided by its different tokens, so that no
rare token gets the probability of a frequent one. The start has the logs of the counts as biases.

All documents are used for training: split into tokens once, they are dealt by hash to shards of about
`shard_tokens` tokens (64 for each number of the vocabulary at least), and the shards to about as many
rounds as there are shards in a round. In a round each shard is trained on by itself with numpy (Adagrad, one
pass), from the model of the round before. The shards' changes are then added up and divided, parameter by
parameter, by a power of the number of shards that moved it, as its squared gradients tell: what one shard
knows alone is kept whole, what all of them say is averaged in part. So more shards give a better model (see
the tests). The number of shards, and so what is gathered, grows with the corpus; the model that reaches the
driver and is broadcast has a fixed bound, MOST_VOCAB numbers (about 40 MB, and as much for the gradients).

Edge cases: a null or empty text has no tokens, a sum of 0 and a null mean; repeated rows have equal
results and count as often as they occur; very long texts are scored in slices whose windows reach
over the cuts; an empty table gives no rows (an untrained model); other columns are ignored.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import distilled, materialize, read_table, slim_batches
from .words import MIX, mix

SPACE = re.compile(r"\s")
CLASSES, DIM, RADIUS = 10, 16, 2  # classes where no vocabulary is given
PAD = CLASSES**3  # beside and between documents: the number after the last
LEAST_VOCAB, MOST_VOCAB = 4096, 1 << 18
MOST_ROUNDS = 16
SHARED_POWER = 0.7  # of the shards that moved a parameter, by which the sum of its changes is divided
FIRST_SUM = 1e-2  # of squared gradients
BLOCK = 8192  # parameters a row when models are averaged
TOGETHER = 256  # shards whose changes to a block are added up at once
SLICE = 32_768
PIECE = 200_000  # characters that are split into tokens at once
DRAFT = 2_000_000  # tokens of a draft, from which it ends
ROWS = 128  # of a product: small enough that BLAS stays on one thread, as more only wait for each other
WIDE_FROM, WIDTHS = np.array([1, 5, 9, 17, 33, 512]), np.array([4, 8, 16, 32, 64, 128])  # tokens of a group, and of its chunks
LONG = 8  # rows of a run that are not cut
FAR = 60.0  # logits beyond are not given to exp as they are
BESIDE = np.array([d for d in range(-RADIUS, RADIUS + 1) if d])


@dataclass
class Vocabulary:
    side: int  # numbers: side x side x side
    known: dict[int, int]  # hash -> number
    counts: np.ndarray  # tokens of each number
    sizes: np.ndarray  # different tokens of each number

    def number(self, h: int) -> int:
        own = self.known.get(h)
        spare = self.side**3 - len(self.known)
        return own if own is not None else len(self.known) + h % spare if spare else h % len(self.known)

    def numbers(self) -> Callable[[np.ndarray], np.ndarray]:
        """number() of many hashes."""
        known = np.fromiter(self.known, np.int64, len(self.known))
        own = np.fromiter(self.known.values(), np.int64, len(self.known))
        by = np.argsort(known)
        known, own = known[by], own[by]
        spare = self.side**3 - len(known)

        def of(h: np.ndarray) -> np.ndarray:
            out = len(known) + h % spare if spare else h % len(known)
            if len(known):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                out = np.where(known[at] == h, own[at], out)
            return out

        return of


@cache
def kinds() -> np.ndarray:
    """Of each code point: 0 space, 1 part of a word, 2 a token by itself."""
    every = "".join(map(chr, range(sys.maxunicode + 1)))
    out = np.full(len(every), 2, np.uint8)
    for kind, pattern in enumerate((r"\s+", r"\w+")):
        for m in re.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def powers(n: int, known: list[np.ndarray] = [np.ones(1, np.uint64)]) -> np.ndarray:  # noqa: B006
    """MIX**k for k under n at least; computed once."""
    if len(known[0]) < n:
        known[0] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, MIX)]))
    return known[0]


def split(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the tokens of a text begin, and their hashes (signed, as Spark's long): the matches of \\w+|[^\\w\\s]."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = kinds()[points]
    own = np.flatnonzero(kind)
    if not len(own):
        return own, own
    kind = kind[own]
    begins = np.ones(len(own), bool)
    begins[1:] = (own[1:] - own[:-1] > 1) | (kind[1:] == 2) | (kind[:-1] == 2)
    first = np.flatnonzero(begins)
    sizes = np.diff(np.append(first, len(own)))
    place = np.arange(len(own)) - np.repeat(first, sizes)
    h = np.add.reduceat((points[own] + np.uint64(1)) * powers(sizes.max())[place], first)
    return own[first], mix(h * MIX).view(np.int64)


def token_hash(token: str) -> int:
    return int(split(token)[1][0])


def texts_at_once(texts: list[str | None]) -> Iterator[tuple[np.ndarray, str]]:
    """Whole texts joined to about PIECE characters, with each one's place; longer ones are cut where space is."""
    held: list[tuple[int, str]] = []
    size = 0
    for k, text in enumerate(texts):
        at = 0
        while text and at < len(text):
            cut = SPACE.search(text, at + PIECE)
            end = cut.start() if cut else len(text)
            held.append((k, text[at:end]))
            size += end - at
            at = end
            if size > PIECE:
                yield np.array([[k, len(t) + 1] for k, t in held]), "\n".join(t for _, t in held)
                held, size = [], 0
    if held:
        yield np.array([[k, len(t) + 1] for k, t in held]), "\n".join(t for _, t in held)


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Each text's number of tokens, and the hashes of all of them."""
    n, out = np.zeros(len(texts), np.int64), [np.zeros(0, np.int64)]
    for pieces, text in texts_at_once(texts):
        at, hashes = split(text)
        ends = np.searchsorted(at, np.cumsum(pieces[:, 1]))
        np.add.at(n, pieces[:, 0], np.diff(ends, prepend=0))
        out.append(hashes)
    return n, np.concatenate(out)


def one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def drafted(docs: DataFrame) -> DataFrame:
    """Texts as numbers before there is a vocabulary, so that they are split into tokens once: a row per some
    documents, with their doc_ids and numbers of tokens, ids (binary, unsigned 32 bit: places in words), words
    (binary, 64 bit: hashes of the different tokens) and counts (binary, 64 bit: of each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def draft() -> pa.RecordBatch:
            words, ids, counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
            columns = [one_list(pa.concat_arrays(own)), one_list(pa.array(np.concatenate(lengths)))]
            columns += [pa.array([x.tobytes()], pa.binary()) for x in (ids.astype(np.uint32), words, counts)]
            return pa.RecordBatch.from_arrays(columns, names=["doc_ids", "lengths", "ids", "words", "counts"])

        own, lengths, hashes, held = [], [], [], 0
        for b in batches:
            n, found = hashed(b.column(1).to_pylist())
            own.append(b.column(0))
            lengths.append(n)
            hashes.append(found)
            held += len(found)
            if held > DRAFT:
                yield draft()
                own, lengths, hashes, held = [], [], [], 0
        if own:
            yield draft()

    out = "doc_ids array<long>, lengths array<long>, ids binary, words binary, counts binary"
    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, out)


def count_tokens(drafts: DataFrame) -> DataFrame:
    """h (hash of a token), n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*b.columns):
                words, counts = (np.frombuffer(x.as_py(), np.int64) for x in row)
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(counts)], names=["h", "n"])

    return drafts.select("words", "counts").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def build_vocabulary(docs: DataFrame, least: int = LEAST_VOCAB) -> Vocabulary:
    return vocabulary_of(drafted(docs), least)


def vocabulary_of(drafts: DataFrame, least: int = LEAST_VOCAB) -> Vocabulary:
    """Of counts over all documents; what reaches the driver is as long as the vocabulary."""
    counted = materialize(count_tokens(drafts).withColumn("band", F.floor(F.log2("n") * 8)), "counts")
    bands = sorted(counted.groupBy("band").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).collect(), reverse=True)
    limit = min(MOST_VOCAB, max(least, 2 * math.isqrt(sum(b["n"] for b in bands))))
    from_band, have = None, 0
    for b in bands:
        if have + b["words"] > limit:
            break
        from_band, have = b["band"], have + b["words"]
    rare = have < sum(b["words"] for b in bands)
    side = 2
    while side**3 < have + (limit // 4 if rare else 0):
        side += 1
    top = F.lit(False) if from_band is None else F.col("band") >= from_band
    own = sorted(((r["n"], r["h"]) for r in counted.where(top).collect()), key=lambda x: (-x[0], x[1]))
    counts, sizes = np.zeros(side**3), np.ones(side**3)
    counts[:have] = [n for n, _ in own]
    if rare:
        spread = counted.where(~top).groupBy(F.pmod("h", F.lit(side**3 - have)).alias("k")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"))
        for r in spread.collect():
            counts[have + r["k"]], sizes[have + r["k"]] = r["n"], r["words"]
    return Vocabulary(side, {h: k for k, (_, h) in enumerate(own)}, counts, sizes)


def id_type(side: int) -> type:
    return np.uint16 if side**3 < 1 << 16 else np.uint32


def start_model(seed: int = 5, side: int = CLASSES, counts: np.ndarray | None = None) -> dict[str, np.ndarray]:
    n = (np.ones(side**3) if counts is None else counts + 0.5).reshape(side, side, side)
    rng = np.random.default_rng(seed)
    small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    model = {
        "embed": small(side**3 + 1, DIM),
        "place": np.ones((2 * RADIUS, DIM), np.float32),
        "hidden": (np.eye(DIM) + small(DIM, DIM)).astype(np.float32),
        "hidden_bias": np.zeros(DIM, np.float32),
    }
    for k, level in enumerate((n.sum(axis=(1, 2))[None], n.sum(axis=2), n.reshape(side * side, side))):
        model[f"level{k}"] = small(len(level), DIM, side)
        model[f"level{k}_bias"] = np.log(level / level.sum(axis=1, keepdims=True)).astype(np.float32)
    return model


def pack(model: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([x.ravel() for x in model.values()])


def shapes(side: int) -> dict[str, tuple[int, ...]]:
    out = {"embed": (side**3 + 1, DIM), "place": (2 * RADIUS, DIM), "hidden": (DIM, DIM), "hidden_bias": (DIM,)}
    for k in range(3):
        out |= {f"level{k}": (side**k, DIM, side), f"level{k}_bias": (side**k, side)}
    return out


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    side = 2
    while sum(math.prod(x) for x in shapes(side).values()) < flat.size:
        side += 1
    out, at = {}, 0
    for name, shape in shapes(side).items():
        out[name] = flat[at : at + math.prod(shape)].reshape(shape).astype(np.float32)
        at += math.prod(shape)
    return out


def times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w, some rows at a time."""
    n = len(x) // ROWS * ROWS
    if not n:
        return x @ w
    out = np.empty((len(x), w.shape[1]), np.float32)
    np.matmul(x[:n].reshape(-1, ROWS, x.shape[1]), w, out=out[:n].reshape(-1, ROWS, w.shape[1]))
    out[n:] = x[n:] @ w
    return out


def cross(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x.T @ y, some rows at a time."""
    n = len(x) // ROWS * ROWS
    out = x[n:].T @ y[n:]
    if n:
        out += np.matmul(x[:n].reshape(-1, ROWS, x.shape[1]).transpose(0, 2, 1), y[:n].reshape(-1, ROWS, y.shape[1])).sum(axis=0)
    return out


def sums_of_runs(rows: np.ndarray, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of places (at, run k from first[k] on) from the longest to the shortest, and the sums of the rows there. The
    second rows of all runs are added at once, then the third ones, and so on; long runs are cut, and their pieces' sums
    added up likewise."""
    sizes = np.diff(np.append(first, len(at)))
    if sizes.max() > LONG:
        pieces = -(-sizes // LONG)
        begin = np.cumsum(pieces) - pieces
        order, rows = sums_of_runs(rows, at, np.repeat(first - begin * LONG, pieces) + np.arange(pieces.sum()) * LONG)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        return sums_of_runs(rows, place, begin)
    order = np.argsort(-sizes.astype(np.int16), kind="stable")
    first = first[order]
    longer = np.cumsum(np.bincount(sizes, minlength=LONG + 1)[::-1])[::-1]  # runs of so many rows or more
    out = rows.take(at[first], axis=0)
    for k in range(1, sizes.max()):
        out[: longer[k + 1]] += rows.take(at[first[: longer[k + 1]] + k], axis=0)
    return order, out


class Network:
    """Tokens of a batch are worked on in the order of their numbers, so that those of a group (a class, a part) are
    neighbours: they are cut into chunks of one width, whose products numpy makes in one call."""

    def __init__(self, model: dict[str, np.ndarray], rate: float = 0.15, sums: dict[str, np.ndarray] | None = None):
        self.rate = rate
        self.side = model["level0"].shape[2]
        self.m, self.levels = self._joint(model)
        if rate:
            self.sums, self.level_sums = self._joint(sums or {k: np.full_like(v, FIRST_SUM) for k, v in model.items()})
        self.rooms: dict[str, np.ndarray] = {}

    @staticmethod
    def _joint(model: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], list[np.ndarray]]:
        """The model, and its levels with the bias as a last row of the weights; the model's are views of these."""
        out, levels = dict(model), []
        for k in range(3):
            levels.append(both := np.concatenate([model[f"level{k}"], model[f"level{k}_bias"][:, None]], axis=1))
            out[f"level{k}"], out[f"level{k}_bias"] = both[:, :DIM], both[:, DIM]
        return out, levels

    def _room(self, name: str, *shape: int) -> np.ndarray:
        """Memory that batch after batch uses again: to ask for it anew costs more than to fill it."""
        size = math.prod(shape)
        if (have := self.rooms.get(name)) is None or have.size < size:
            have = self.rooms[name] = np.empty(size + size // 4, np.float32)
        return have[:size].reshape(shape)

    def _take(self, name: str, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        return rows.take(at, axis=0, out=self._room(name, *at.shape, *rows.shape[1:]), mode="clip")

    def _forward(self, ids: np.ndarray, at: np.ndarray):
        m, n = self.m, len(at)
        order = np.argsort(ids[at].astype(id_type(self.side)), kind="stable")
        at = at[order]
        near = ids[at[:, None] + BESIDE]
        rows = self._take("rows", m["embed"], near).reshape(n, -1)
        mixed = (m["place"][:, :, None] * m["hidden"]).reshape(-1, DIM)  # places and hidden layer in one product
        x = times(rows, mixed)
        x += m["hidden_bias"]
        np.tanh(x, out=x)
        h = self._room("h", n + 1, DIM + 1)  # with a 1 for the bias; the last row is for empty places
        h[:n, :DIM], h[:n, DIM], h[n] = x, 1, 0
        return order, ids[at], near, rows, mixed, x, h

    def _level(self, k: int, h: np.ndarray, target: np.ndarray):
        """Inputs and logits of a level by chunks, each token's row there and its label, and the chunks by width: their
        rows, width, groups, each group's first chunk and the chunks' weights."""
        n, s = len(target), self.side
        group, label = np.divmod(target // s ** (2 - k), s)
        sizes = np.bincount(group, minlength=s**k)
        present = np.flatnonzero(sizes)
        sizes = sizes[present]
        tier = np.searchsorted(WIDE_FROM, sizes, side="right") - 1
        chunks = -(-sizes // WIDTHS[tier])
        rows = chunks * WIDTHS[tier]
        by = np.argsort(tier, kind="stable")
        begin = np.empty_like(rows)
        begin[by] = np.cumsum(rows[by]) - rows[by]
        spot = np.arange(n) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)
        x, z = h[:n], self._room("z", rows.sum(), s)
        if len(z) > n or tier.min() < tier.max():  # else the chunks are h as it is
            of = np.full(len(z), n)
            of[spot] = np.arange(n)
            x = self._take("x", h, of)
        parts = []
        for t in np.flatnonzero(np.bincount(tier)).tolist():
            own, width = np.flatnonzero(tier == t), int(WIDTHS[t])
            here = slice(begin[own[0]], begin[own[-1]] + rows[own[-1]])
            w = self._take(f"w{t}", self.levels[k], np.repeat(present[own], chunks[own]))
            np.matmul(x[here].reshape(-1, width, DIM + 1), w, out=z[here].reshape(-1, width, s))
            parts.append((here, width, present[own], np.cumsum(chunks[own]) - chunks[own], w))
        if z.max() > FAR or z.min() < -FAR:  # else exp is safe as it is
            z -= z.max(axis=1, keepdims=True)
        return x, z, spot, label, parts

    def _totals(self, z: np.ndarray, parts: list) -> np.ndarray:
        out, one = self._room("totals", len(z)), np.ones(self.side, np.float32)
        for here, width, *_ in parts:
            np.matmul(z[here].reshape(-1, width, self.side), one, out=out[here].reshape(-1, width))
        return out

    def log_probs(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log P of ids[at] from their neighbours; ids has RADIUS pads at either end."""
        order, target, *_, h = self._forward(ids, at)
        total = np.zeros(len(at), np.float32)
        for k in range(3):
            _, z, spot, label, parts = self._level(k, h, target)
            total += z.ravel()[spot * self.side + label]
            np.exp(z, out=z)
            total -= np.log(self._totals(z, parts)[spot])
        out = np.empty_like(total)
        out[order] = total
        return out

    def _step(self, value: np.ndarray, sums: np.ndarray, grad: np.ndarray, where: np.ndarray) -> None:
        """grad is used up."""
        now = self._take("now", sums, where)
        square = self._room("square", *grad.shape)
        now += np.multiply(grad, grad, out=square)
        sums[where] = now
        grad *= self.rate
        grad /= np.sqrt(now, out=now)
        old = self._take("square", value, where)
        old -= grad
        value[where] = old

    def learn(self, ids: np.ndarray, at: np.ndarray) -> None:
        m, n = self.m, len(at)
        _, target, near, rows, mixed, hidden, h = self._forward(ids, at)
        dh = self._room("dh", n, DIM)
        dh[:] = 0
        for k in range(3):
            x, z, spot, label, parts = self._level(k, h, target)
            np.exp(z, out=z)
            z *= (1 / (n * self._totals(z, parts)))[:, None]
            z.ravel()[spot * self.side + label] -= np.float32(1 / n)
            back = self._room("back", len(z), DIM)
            for here, width, own, first, w in parts:
                p = z[here].reshape(-1, width, self.side)
                np.matmul(p, w[:, :DIM].transpose(0, 2, 1), out=back[here].reshape(-1, width, DIM))
                grad = np.matmul(x[here].reshape(-1, width, DIM + 1).transpose(0, 2, 1), p, out=self._room("grad", len(p), DIM + 1, self.side))
                if len(own) < len(p):
                    order, grad = sums_of_runs(grad, np.arange(len(p)), first)
                    own = own[order]
                self._step(self.levels[k], self.level_sums[k], grad, own)
            dh += self._take("own", back, spot)
        dh *= 1 - hidden * hidden
        dmixed = cross(rows, dh).reshape(-1, DIM, DIM)
        drows = times(dh, mixed.T).reshape(-1, DIM)
        dplace, dhidden = (dmixed * m["hidden"]).sum(axis=2), (dmixed * m["place"][:, :, None]).sum(axis=0)
        flat = near.ravel()
        by = np.argsort(flat.astype(id_type(self.side)), kind="stable")
        ranked = flat[by]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        order, dembed = sums_of_runs(drows, by, first)
        for name, grad in (("hidden", dhidden), ("hidden_bias", dh.sum(axis=0)), ("place", dplace)):
            self._step(m[name], self.sums[name], grad, np.arange(len(grad)))
        self._step(m["embed"], self.sums["embed"], dembed, ranked[first[order]])


def encode(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """doc_id, ids (binary, unsigned 16 bit, or 32 for a vocabulary of more numbers), n. Without a
    vocabulary all tokens are spread by hash over PAD numbers."""
    return numbered(drafted(docs), vocabulary or Vocabulary(CLASSES, {}, np.ones(PAD), np.ones(PAD)))


def numbered(drafts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The documents of drafts as encode() has them."""
    shared = drafts.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        number, kind = vocabulary.numbers(), id_type(vocabulary.side)
        for b in batches:
            for doc_ids, lengths, ids, words in zip(*b.columns):
                n = lengths.values.to_numpy()
                of = number(np.frombuffer(words.as_py(), np.int64)).astype(kind)
                own = of[np.frombuffer(ids.as_py(), np.uint32)]
                ends = np.concatenate([[0], np.cumsum(n * own.itemsize)]).astype(np.int32)
                whole = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(own)])
                yield pa.RecordBatch.from_arrays([doc_ids.values, whole, lengths.values], names=["doc_id", "ids", "n"])

    return drafts.select("doc_ids", "lengths", "ids", "words").mapInArrow(run, "doc_id long, ids binary, n long")


def joined(parts: list[np.ndarray], end: int = PAD) -> tuple[np.ndarray, np.ndarray]:
    """Documents in a row with pads between, and the places of their tokens."""
    pad = np.full(RADIUS, end, dtype=np.int32)
    row = [pad]
    for p in parts:
        row += [p.astype(np.int32), pad]
    ids = np.concatenate(row)
    return ids, np.flatnonzero(ids != end)


def packed_shards(encoded: DataFrame, shards: int, rounds: int, end: int) -> DataFrame:
    """shard, round, ids: a row per shard, its documents with pads between. Written once, a file a shard, of which
    a round reads its own."""
    kind = np.uint16 if end < 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([joined(parts, end)[0].astype(kind).tobytes()], pa.binary()), pa.array([shard % rounds], pa.int32())], names=["shard", "ids", "round"])

        shard, parts = None, []
        for b in batches:
            for s, ids in zip(b.column(0).to_pylist(), b.column(1)):
                if s != shard and parts:
                    yield pack()
                    parts = []
                shard = s
                parts.append(np.frombuffer(ids.as_py(), kind))
        if parts:
            yield pack()

    # Ranges of shard numbers: by hash, several shards would meet in one task and none in others.
    dealt = encoded.where("n > 0").select(F.pmod(F.xxhash64("doc_id", "ids"), F.lit(shards)).alias("shard"), "ids").repartitionByRange(int(shards), "shard").sortWithinPartitions("shard", "ids")
    return materialize(dealt.mapInArrow(run, "shard long, ids binary, round int"), "shards", "round")


def one_round(shards: DataFrame, n_shards: int, model: np.ndarray, sums: np.ndarray, side: int, batch: int) -> tuple[np.ndarray, np.ndarray]:
    """The model and its sums of squared gradients after the shards were trained on side by side."""
    shared = shards.sparkSession.sparkContext.broadcast((model, sums))
    kind = np.uint16 if side**3 < 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, slot, added = 0, 0, []  # of a task's shards, so that fewer numbers are moved
        for b in batches:
            model, sums = shared.value
            for shard, row in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.frombuffer(row.as_py(), kind).astype(np.int32)
                at = np.random.default_rng(shard).permutation(np.flatnonzero(ids != side**3).astype(np.int32))
                net = Network(unpack(model.copy()), sums=unpack(sums.copy()))
                for k in range(0, len(at), batch):
                    net.learn(ids, at[k : k + batch])
                own = [pack(net.m) - model, np.maximum(pack(net.sums) - sums, 0) + np.float32(1e-12)]
                if n == 1:
                    added.append(added[1].astype(np.float64) ** 2)
                if n:
                    own.append(own[1].astype(np.float64) ** 2)
                    added = [x.astype(np.float64) + y for x, y in zip(added, own)]
                else:
                    added, slot = own, shard % slots
                n += 1
        if n:
            blocks = range(-(-len(added[0]) // BLOCK))
            cut = [pa.array([x[k * BLOCK : (k + 1) * BLOCK].astype(np.float32).tobytes() for k in blocks], pa.binary()) for x in added]
            same = (pa.array([x] * len(blocks), pa.int32()) for x in (slot, n))
            columns = [pa.array(blocks, pa.int32()), *same, *cut, *[pa.nulls(len(blocks), pa.binary())] * (3 - len(cut))]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "slot", "n", "moved", "mass", "squared"])

    def sums_of(table: pa.Table) -> pa.Table:
        """Sums over the shards of a block: changes, masses, squared masses (not given for a single shard)."""
        moved, mass = (np.stack([np.frombuffer(x.as_py(), np.float32) for x in table.column(c)]).astype(np.float64) for c in ("moved", "mass"))
        squared = [np.frombuffer(x.as_py(), np.float32) if x.is_valid else own * own for x, own in zip(table.column("squared"), mass)]
        return row_of(table, sum(table.column("n").to_pylist()), np.stack([moved.sum(axis=0), mass.sum(axis=0), np.sum(squared, axis=0, dtype=np.float64)]))

    def add_up(table: pa.Table) -> pa.Table:
        return row_of(table, sum(table.column("n").to_pylist()), sum(np.frombuffer(x.as_py(), np.float64) for x in table.column("sums")))

    def row_of(table: pa.Table, n: int, sums: np.ndarray) -> pa.Table:
        return pa.table({"block": pa.array(table.column("block").to_pylist()[:1], pa.int32()), "n": [n], "sums": pa.array([sums.tobytes()], pa.binary())})

    slots = -(-n_shards // TOGETHER)
    out = "block int, n long, sums binary"
    # In two steps if there are many shards, so that no group has the block of all of them.
    tasks = shards.coalesce(shards.sparkSession.sparkContext.defaultParallelism)
    changes = tasks.mapInArrow(run, "block int, slot int, n int, moved binary, mass binary, squared binary").groupBy("block", "slot").applyInArrow(sums_of, out)
    added = changes.groupBy("block").applyInArrow(add_up, out) if slots > 1 else changes
    rows = sorted(added.collect(), key=lambda r: r["block"])  # as many as the model has blocks
    shared.destroy()
    parts = [np.frombuffer(r["sums"], np.float64).reshape(3, -1) for r in rows]
    moved, mass, squared = np.concatenate(parts, axis=1)
    movers = np.maximum(1.0, mass * mass / squared)
    return (model + moved / movers**SHARED_POWER).astype(np.float32), (sums + mass / rows[0]["n"]).astype(np.float32)


def train(encoded: DataFrame, shard_tokens: int = 2_000_000, batch: int = 16_384, seed: int = 5, vocabulary: Vocabulary | None = None) -> np.ndarray:
    """The parameters after all rounds."""
    side, counts = (vocabulary.side, vocabulary.counts) if vocabulary else (CLASSES, None)
    total = encoded.agg(F.sum("n")).first()[0] or 0
    model = pack(start_model(seed, side, counts))
    if not total:
        return model
    shards = -(-total // max(shard_tokens, 64 * side**3 if vocabulary else 0))
    rounds = min(MOST_ROUNDS, math.isqrt(shards - 1) + 1)
    dealt = packed_shards(encoded, shards, rounds, side**3)
    sums = np.full_like(model, FIRST_SUM)
    for r, n in sorted(dealt.groupBy("round").count().collect()):
        own = dealt.where(F.col("round") == r).select("shard", "ids")
        model, sums = one_round(own, n, model, sums, side, batch)
    return model


def score(encoded: DataFrame, parameters: np.ndarray, vocabulary: Vocabulary | None = None) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (sum), mean_log_likelihood."""
    shared = encoded.sparkSession.sparkContext.broadcast((parameters.astype(np.float32), np.log(vocabulary.sizes) if vocabulary else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, spread = shared.value
        net = Network(unpack(flat), rate=0)
        for b in batches:
            sums = np.zeros(b.num_rows)
            lengths = np.array(b.column(2).to_pylist(), dtype=np.int64)
            at_doc = 0
            while at_doc < b.num_rows:  # some documents at a time
                stop = at_doc + max(1, int(np.searchsorted(np.cumsum(lengths[at_doc:]), 8 * SLICE)))
                ids, at = joined([np.frombuffer(b.column(1)[k].as_py(), id_type(net.side)) for k in range(at_doc, min(stop, b.num_rows))], net.side**3)
                logs = np.concatenate([net.log_probs(ids, at[k : k + SLICE]) for k in range(0, len(at), SLICE)] or [np.zeros(0)])
                if spread is not None:
                    logs = logs - spread[ids[at]]
                own = np.repeat(np.arange(at_doc, min(stop, b.num_rows)), lengths[at_doc : min(stop, b.num_rows)])
                sums += np.bincount(own, weights=logs, minlength=b.num_rows)
                at_doc = stop
            mean = pa.array([s / n if n else None for s, n in zip(sums.tolist(), lengths.tolist())], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(sums), mean], names=["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"])

    return encoded.select("doc_id", "ids", "n").mapInArrow(run, "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double")


def pseudo_likelihood(docs: DataFrame, shard_tokens: int = 2_000_000) -> DataFrame:
    slim_batches(docs.sparkSession)
    found = []

    def numbers() -> DataFrame:
        drafts = materialize(drafted(docs), "drafts")
        found.append(vocabulary_of(drafts))
        return numbered(drafts, found[0])

    encoded = distilled(docs.sparkSession, numbers, "encoded")
    vocabulary = found[0]
    return score(encoded, train(encoded, shard_tokens, vocabulary=vocabulary), vocabulary)


def op1_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(read_table(spark, sf_dir, "documents"))
