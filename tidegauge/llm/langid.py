"""Language identification of whole, possibly mixed-language texts.

Training counts hashed character trigrams of words, and letters by script, per language over every
training row (dense counts per task, summed in Spark; at most languages x 65,536 numbers reach the
driver). For prediction, a word's script narrows the languages to those that were seen to use it;
each remaining language gives the word a log-likelihood; a Viterbi pass over the words, with a
penalty for every switch, labels spans. The pass is skipped where a bound shows that no switch can
pay, and made for many documents at once. The document's language is the one with most letters.

Edge cases: a null text, or one without letters, is `und` with score 0; letters of a script that no
training language uses leave all languages tied, and ties go to the language with most training
letters; repeated rows get equal results; very long texts are handled in slices of words whose
scores are joined before the pass; an empty table gives no rows; without training rows everything
is `und`; other columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

BUCKETS = 1 << 16
#: First and last code point of the scripts told apart (the Unicode block ranges).
SCRIPTS = [
    (0x41, 0x24F), (0x1E00, 0x1EFF), (0x370, 0x3FF), (0x400, 0x52F), (0x530, 0x58F), (0x590, 0x5FF),
    (0x600, 0x6FF), (0x900, 0x97F), (0x980, 0x9FF), (0xB80, 0xBFF), (0xE00, 0xE7F), (0x10A0, 0x10FF),
    (0x1100, 0x11FF), (0x3040, 0x309F), (0x30A0, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF),
]
N_SCRIPTS = len(SCRIPTS) + 1  # the last is every other script
#: White space of any kind separates words, and so does whatever is no letter.
CHUNK = 200_000


@lru_cache(maxsize=1)
def char_tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: its lower case if it is a letter, else 0; its script."""
    points = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    lower = points.copy()
    keep = np.zeros(len(points), dtype=bool)
    for p in range(len(points)):
        c = chr(p)
        if unicodedata.category(c)[0] == "L" and not 0xD800 <= p < 0xE000:
            keep[p] = True
            small = c.lower()
            if len(small) == 1:
                lower[p] = ord(small)
    lower[~keep] = 0
    script = np.full(len(points), N_SCRIPTS - 1, dtype=np.uint8)
    for k, (first, last) in enumerate(SCRIPTS):
        script[first : last + 1] = 0 if k == 1 else k  # the second Latin range
    return lower, script


def features(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text's words: first letter's index, length, script, and per letter the trigram's bucket
    (previous letter or 0, letter, next letter or 0), letters of all words in a row."""
    lower, script = char_tables()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = np.concatenate([[0], lower[codes], [0]]).astype(np.uint32)
    at = np.flatnonzero(low)
    if not len(at):
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, empty
    grams = ((low[at - 1] * np.uint32(2654435761)) ^ (low[at] * np.uint32(2246822519)) ^ (low[at + 1] * np.uint32(3266489917))) * np.uint32(668265263)
    grams = (grams >> np.uint32(16)).astype(np.int64)
    first = np.flatnonzero(low[at - 1] == 0)
    length = np.diff(np.append(first, len(at)))
    return at[first] - 1, length, script[codes[at[first] - 1]].astype(np.int64), grams


def train(docs: DataFrame) -> dict:
    """A model from docs (text, lang); rows with a null text or lang are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1).to_pylist()):
                _, length, script, g = features(text.as_py())
                have = grams.setdefault(lang, np.zeros(BUCKETS + N_SCRIPTS, dtype=np.int64))
                if len(g):
                    have += np.concatenate([np.bincount(g, minlength=BUCKETS), np.bincount(script, weights=length, minlength=N_SCRIPTS).astype(np.int64)])
        for lang, have in grams.items():
            idx = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(idx), pa.string()), pa.array(idx, pa.int64()), pa.array(have[idx], pa.int64())], names=["lang", "bucket", "n"])

    rows = docs.where("text is not null and lang is not null").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    sums = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    return fit(sums)


def fit(sums: pd.DataFrame) -> dict:
    sums = sums[sums["n"] > 0]
    langs = sorted(sums["lang"].unique(), key=lambda x: (-int(sums.loc[(sums["lang"] == x) & (sums["bucket"] >= BUCKETS), "n"].sum()), x))
    counts = np.zeros((BUCKETS + N_SCRIPTS, max(1, len(langs))))
    for k, lang in enumerate(langs):
        own = sums[sums["lang"] == lang]
        counts[own["bucket"].to_numpy(dtype=np.int64), k] = own["n"].to_numpy(dtype=np.float64)
    grams, scripts = counts[:BUCKETS] + 0.2, counts[BUCKETS:]
    share = scripts / np.maximum(scripts.sum(axis=0), 1)
    allowed = share >= 0.01
    allowed[~allowed.any(axis=1)] = True
    return {"langs": langs, "logs": np.log(grams / grams.sum(axis=0)).astype(np.float32), "allowed": allowed}


def word_scores(text: str, model: dict, floor: float = 12.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First letters, lengths, and a row of scores per word: the log-likelihoods against the best
    language's, not below -floor."""
    starts, lengths, scores = [], [], []
    at = 0
    while at < len(text):  # slices end at a blank where there is one
        end = at + CHUNK
        if end < len(text):
            cut = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
            end = cut + 1 if cut > at else end
        first, length, script, grams = features(text[at:end])
        if len(first):
            s = np.add.reduceat(model["logs"][grams], np.concatenate([[0], np.cumsum(length)[:-1]]), axis=0)
            s[~model["allowed"][script]] = -1e9
            s -= s.max(axis=1, keepdims=True)
            starts.append(first + at)
            lengths.append(length)
            scores.append(np.maximum(s, -floor))
        at = end
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(model["langs"])), np.float32)
    return np.concatenate(starts), np.concatenate(lengths), np.concatenate(scores)


def one_label(scores: np.ndarray, penalty: float) -> int | None:
    """The label of all words, if it is certain that no switch pays."""
    sums = np.cumsum(scores, axis=0, dtype=np.float64)
    best = int(np.argmax(sums[-1]))
    gain = np.concatenate([np.zeros((1, scores.shape[1])), sums - sums[:, [best]]])
    # m switches make m + 1 stretches at most: if none gains over half the penalty, one label for all.
    return best if (gain - np.minimum.accumulate(gain, axis=0)).max() <= penalty / 2 else None


def viterbi_many(parts: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """The best label of every word where each change of label costs penalty, for several documents
    (arrays of words x labels, none empty): they advance together, a word of each at a time."""
    if not parts:
        return []
    order = sorted(range(len(parts)), key=lambda d: -len(parts[d]))
    lengths = np.array([len(parts[d]) for d in order])
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # documents longer than i
    begin = np.concatenate([[0], np.cumsum(active)])
    k = parts[0].shape[1]
    steps = np.empty((begin[-1], k))  # by place, and there by document
    for r, d in enumerate(order):
        steps[begin[: lengths[r]] + r] = parts[d]
    back = np.empty((begin[-1], k), dtype=np.int32)
    value, own = steps[: active[0]].copy(), np.arange(k, dtype=np.int32)
    for i in range(1, int(lengths[0])):
        v = value[: active[i]]
        top = v.argmax(axis=1)
        least = v[np.arange(len(v)), top][:, None] - penalty
        stay = v >= least
        back[begin[i] : begin[i + 1]] = np.where(stay, own, top[:, None])
        np.maximum(v, least, out=v)
        v += steps[begin[i] : begin[i + 1]]
    last = value.argmax(axis=1)
    paths = [np.empty(0)] * len(parts)
    ranks = np.arange(len(order))
    state = np.zeros(len(order), dtype=np.int64)
    labels = np.empty(begin[-1], dtype=np.int64)
    for i in range(int(lengths[0]) - 1, -1, -1):
        n = active[i]
        more = active[i + 1] if i + 1 < len(active) else 0
        if more:
            state[:more] = back[begin[i + 1] + ranks[:more], state[:more]]
        state[more:n] = last[more:n]
        labels[begin[i] : begin[i + 1]] = state[:n]
    for r, d in enumerate(order):
        paths[d] = labels[begin[: lengths[r]] + r]
    return paths


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """As viterbi_many, for one document."""
    best = one_label(scores, penalty)
    return np.full(len(scores), best) if best is not None else viterbi_many([scores], penalty)[0]


Label = tuple[str, float, list[tuple[int, int, str]]]


def label_many(texts: list[str | None], model: dict, penalty: float, together: int = 400_000) -> list[Label]:
    """Language, score, and (start, end, language) of the spans in code points, of each text; so many
    words, or one longer text, are held at a time."""
    out: list[Label] = [("und", 0.0, [])] * len(texts)
    held: list[tuple] = []

    def finish() -> None:
        found = [one_label(h[3], penalty) for h in held]
        paths = iter(viterbi_many([h[3] for h, one in zip(held, found) if one is None], penalty))
        for (at, starts, lengths, scores), one in zip(held, found):
            out[at] = summary(next(paths) if one is None else np.full(len(scores), one), starts, lengths, scores, model)
        held.clear()

    words = 0
    for at, text in enumerate(texts):
        if text and model["langs"]:
            found = word_scores(text, model)
            if len(found[0]):
                if held and words + len(found[0]) > together:
                    finish()
                    words = 0
                held.append((at, *found))
                words += len(found[0])
    finish()
    return out


def summary(path: np.ndarray, starts: np.ndarray, lengths: np.ndarray, scores: np.ndarray, model: dict) -> Label:
    letters = np.bincount(path, weights=lengths, minlength=len(model["langs"]))
    top = int(np.argmax(letters))
    total = scores.sum(axis=0, dtype=np.float64)
    odds = np.exp(np.clip(total - total.max(), -60, 0))
    certain = odds[top] / odds.sum() if (path == top).all() else 1.0
    change = np.flatnonzero(np.diff(path)) + 1
    begin, stop = np.concatenate([[0], change]), np.concatenate([change, [len(path)]]) - 1
    spans = [(int(starts[a]), int(starts[b] + lengths[b]), model["langs"][path[a]]) for a, b in zip(begin, stop)]
    return model["langs"][top], float(letters[top] / letters.sum() * certain), spans


def label(text: str | None, model: dict, penalty: float) -> Label:
    return label_many([text], model, penalty)[0]


def _labels(column: pa.Array, model: dict, penalty: float) -> list[pa.Array]:
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])
    langs, scores, spans = [], [], []
    for lang, score, found in label_many(column.to_pylist(), model, penalty):
        langs.append(lang)
        scores.append(score)
        spans.append([{"start": s, "end": e, "lang": x} for s, e, x in found])
    return [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(span))]


def identify(docs: DataFrame, model: dict, penalty: float = 20.0) -> DataFrame:
    """docs (doc_id, text) -> doc_id, lang_pred, score, spans array<struct<start, end, lang>>."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x 65,536 floats at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *_labels(b.column(1), shared.value, penalty)], names=["doc_id", "lang_pred", "score", "spans"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>")


def keep_known(docs: DataFrame, model: dict, penalty: float = 20.0, min_score: float = 0.3) -> DataFrame:
    """The rows of docs whose language is found with min_score at least; columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))  # the text travels once
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [lang != "und" and score >= min_score for lang, score, _ in label_many(b.column(0).flatten()[place].to_pylist(), shared.value, penalty)]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, pa.bool_()))], names=["row"])

    done = packed.mapInArrow(run, packed.schema)
    return done.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def train_split(docs: DataFrame) -> DataFrame:
    """Rows to learn from; a null doc_id has no remainder and is left out."""
    return docs.where(~held_out())


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = identify(docs, train(train_split(docs)))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "spans")
