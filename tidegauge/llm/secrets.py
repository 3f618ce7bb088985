"""Secret scan: fixed patterns, and two character Markov models compared by log-likelihood ratio.

One first-order model is trained on random strings, the other on ordinary identifiers, both from
labelled samples (text, label 1 or 0). A run of token characters is a finding of kind `markov` if
the random model beats the ordinary one by `min_ratio` nats in all and `min_mean` nats a step, and
it touches no pattern finding. The default samples come from a seeded generator: keys over the
usual alphabets against identifiers joined from common programming words and corpus words.

Edge cases: a null or empty text has no findings (the digest of an empty string); rows are judged
one by one, so repeated rows give repeated results; very long texts are scanned whole; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Words that identifiers are made of.
WORDS = (
    "get set read write open close user name index count value list map table column row page file path line text time date "
    "start end total number size length buffer stream request response client server session token handler service manager factory "
    "config option default error message event queue worker thread process memory cache store key hash node tree graph edge query "
    "result filter sort merge split join update delete insert create remove validate parse format convert build render draw image "
    "color width height margin border layout button input output print debug test check verify compute average maximum minimum "
    "installation documentation international communication transaction authentication configuration representation the and that "
    "with from this have their would there which about tion ment ing est pour dans avec les des une nicht und der die das eine para los con"
).split()


def labelled_samples(n: int = 6000, seed: int = 11) -> list[tuple[str, int]]:
    """n random strings (label 1) and n ordinary identifiers (label 0)."""
    rng = random.Random(seed)
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = ["0123456789abcdef", lower + digits, lower + lower.upper() + digits, lower.upper() + digits, lower + lower.upper() + digits + "+/", lower + lower.upper() + digits + "-_"]
    out = []
    for k in range(n):
        out.append(("".join(rng.choices(alphabets[k % len(alphabets)], k=rng.randint(16, 48))), 1))
        words = rng.choices(WORDS, k=rng.randint(2, 6))
        style = k % 6
        if style == 0:
            text = "_".join(words)
        elif style == 1:
            text = words[0] + "".join(w.title() for w in words[1:])
        elif style == 2:
            text = "-".join(words)
        elif style == 3:
            text = "/".join(words)
        elif style == 4:
            text = "_".join(words).upper()
        else:
            text = "".join(words)
        out.append((text + (str(rng.randint(0, 2100)) if k % 5 == 0 else ""), 0))
    return out


def train(samples: Iterable[tuple[str, int]], smoothing: float = 0.5) -> np.ndarray:
    """128 x 128 log-likelihood ratios of a step between two ASCII characters; row 0 is the start."""
    counts = np.full((2, 128, 128), 0.0)
    seen = np.zeros(128, dtype=bool)
    for text, label in samples:
        codes = np.frombuffer((text or "").encode("ascii", "replace"), dtype=np.uint8)
        seen[codes] = True
        np.add.at(counts[int(label)], (np.concatenate([[0], codes[:-1]])[: len(codes)], codes), 1.0)
    counts += smoothing
    counts[:, :, ~seen] = smoothing
    logs = np.log(counts) - np.log(counts.sum(axis=2, keepdims=True))
    return (logs[1] - logs[0]).astype(np.float32)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted."""
    low = text.lower()
    found = []
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def model_spans(text: str, ratios: np.ndarray, taken: list[tuple[int, int, int]], min_ratio: float, min_mean: float) -> list[tuple[int, int, int]]:
    found = []
    for m in RUN.finditer(text):
        codes = np.frombuffer(m.group().encode(), dtype=np.uint8)
        steps = ratios[np.concatenate([[0], codes[:-1]]), codes]
        total = float(steps.sum())
        if total >= min_ratio and total >= min_mean * len(codes) and not any(s < m.end() and m.start() < e for s, _, e in taken):
            found.append((m.start(), 3, m.end()))
    return found


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, samples: Iterable[tuple[str, int]] | None = None, min_ratio: float = 12.0, min_mean: float = 0.4, mask: str | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov, and
    `findings` array<struct<kind, start, end, text>>. With mask, also `masked`: the text with every
    finding replaced by that string (null stays null)."""
    ratios = train(samples if samples is not None else labelled_samples())
    finding = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())])
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long, findings array<struct<kind:string,start:long,end:long,text:string>>"
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.list_(finding)]
    if mask is not None:
        schema, types = schema + ", masked string", [*types, pa.string()]
    names = [re.match(r"\w+", c)[0] for c in re.split(r", (?=\w+ )", schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                rows = []
                for doc_id, given in zip(part.column(0).to_pylist(), part.column(1)):
                    given = given.as_py()
                    text = given or ""
                    base = base_spans(text)
                    spans = sorted(base + model_spans(text, ratios, base, min_ratio, min_mean))
                    kinds = [x[1] for x in spans]
                    row = [doc_id, kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(digest(base).encode()).hexdigest(), digest(spans), kinds.count(3)]
                    row.append([{"kind": KINDS[x], "start": s, "end": e, "text": text[s:e]} for s, x, e in spans])
                    if mask is not None:
                        out, at = [], 0
                        for s, _, e in spans:
                            if s >= at:
                                out += [text[at:s], mask]
                            at = max(at, e)
                        row.append(None if given is None else "".join([*out, text[at:]]))
                    rows.append(row)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, schema)


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """docs with every finding masked in `text` and `n_chars` brought up to date; the columns stay.
    The other columns travel beside the text, so no join is needed."""
    names = docs.columns
    others = F.struct(*[docs[c] for c in names if c != "text"])
    ratios = train(labelled_samples())
    packed = docs.select(others.alias("row"), docs["text"].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            masked = []
            for given in b.column(1):
                text = given.as_py()
                if text:
                    base = base_spans(text)
                    out, at = [], 0
                    for s, _, e in sorted(base + model_spans(text, ratios, base, 12.0, 0.4)):
                        if s >= at:
                            out += [text[at:s], mask]
                        at = max(at, e)
                    text = "".join([*out, text[at:]])
                masked.append(text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(masked, pa.string())], names=["row", "text"])

    done = packed.mapInArrow(run, packed.schema)
    cols = {c: F.col(f"row.`{c}`") for c in names if c != "text"} | {"text": F.col("text")}
    if "n_chars" in names:
        cols["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return done.select(*[cols[c].alias(c) for c in names])


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))
