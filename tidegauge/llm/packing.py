"""Cost-balanced packing of token sequences.

A sequence's cost is estimated as linear * n + quadratic * n^2 summed over the pieces in it
(attention stays inside a piece). Every document is cut into full sequences and one remainder;
the remainders of a block of documents are placed in descending order, each on the lowest-cost
sequence whose remaining token capacity holds it. A remainder that no sequence holds whole is
cut over the roomiest. A block opens floor(total / size) sequences of the
full size plus one sequence for each bit of the rest, so that all of them end up full.

Packing happens where the rows are read: no shuffle, and memory is bounded by the block.

Ids are those of `tokenizers` and its JSON file. Given the ranks of the same vocabulary, texts of up to
LONG code points are encoded by `tiktoken`, which gives the same ids in a sixth of the time; longer ones, and any
that it can't split, by `tokenizers` itself.

Edge cases: a null or empty text is the single end-of-document id; a repeated row is packed again;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import read_table

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
SPECIAL = "<|endoftext|>"
LONG = 200_000


class Encoder:
    """Ids of a text by a tokenizer's JSON file. The special token's string in a text is that token."""

    def __init__(self, tokenizer_path: str, ranks_path: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.quick = None
        if ranks_path:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.quick = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})

    def __call__(self, text: str) -> np.ndarray:
        if self.quick and len(text) <= LONG:
            try:
                return self.quick.encode_to_numpy(text, allowed_special="all").astype("<u4")
            except ValueError:  # its pattern gives up on some very long runs
                pass
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")


def place(lengths: np.ndarray, size: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(item, start in item, length, sequence, offset) for every piece of a block of remainders."""
    total = int(lengths.sum())
    rest = total % size
    room = np.array([size] * (total // size) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1], dtype=np.int64)
    fill, cost = np.zeros_like(room), np.zeros(len(room))
    out = []
    for item in np.argsort(-lengths, kind="stable").tolist():
        left, start = int(lengths[item]), 0
        while left:
            fits = room >= left
            seq = int(np.argmin(np.where(fits, cost, np.inf))) if fits.any() else int(np.argmax(room))
            n = min(left, int(room[seq]))
            out.append((item, start, n, seq, int(fill[seq])))
            room[seq] -= n
            fill[seq] += n
            cost[seq] += linear * n + quadratic * n * n
            start, left = start + n, left - n
    return out


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, size: int = 1024, linear: float = 1.0, quadratic: float = 1.0 / 1024, end_id: int = 0, block_docs: int = 2048) -> DataFrame:
    """One row per piece of docs (doc_id, text); see the module's text. block_docs bounds what a
    task holds: so many remainders, each shorter than size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path, ranks_path)
        base = TaskContext.get().partitionId() << 40
        state = {"next": base}
        rows: list[tuple] = []
        held: list[tuple] = []  # doc_id, start, ids, doc_tokens

        def piece(doc_id, start, ids, doc_tokens, seq, offset):
            rows.append((doc_id, start, len(ids), zlib.crc32(ids), doc_tokens, seq, offset))

        def flush():
            if held:
                lengths = np.array([len(h[2]) for h in held], dtype=np.int64)
                last = 0
                for item, start, n, seq, offset in place(lengths, size, linear, quadratic):
                    doc_id, at, ids, doc_tokens = held[item]
                    piece(doc_id, at + start, ids[start : start + n], doc_tokens, state["next"] + seq, offset)
                    last = max(last, seq + 1)
                state["next"] += last
                held.clear()

        def batch():
            cols = zip(*rows) if rows else [()] * 7
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[c.split()[0] for c in SCHEMA.split(", ")])
            rows.clear()
            return out

        for b in batches:
            ids_col, text_col = b.column(0), b.column(1)
            for i in range(b.num_rows):
                doc_id, text = ids_col[i].as_py(), text_col[i].as_py() or ""
                ids = np.append(encoder(text), np.array([end_id], dtype="<u4"))
                n = len(ids)
                for k in range(0, n - n % size, size):
                    piece(doc_id, k, ids[k : k + size], n, state["next"], 0)
                    state["next"] += 1
                if n % size:
                    held.append((doc_id, n - n % size, ids[n - n % size :].copy(), n))
                if len(held) >= block_docs:
                    flush()
                if len(rows) >= 20_000:
                    yield batch()
        flush()
        yield batch()

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, SCHEMA)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
