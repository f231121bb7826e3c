"""Concatenate-and-cut packing: all documents' tokens in one long row, cut every 1024 tokens.

Pass one tokenizes each partition, numbers its documents' tokens from the partition's start and writes both to the
shared folder with the partition's total. Prefix sums over the totals (one number for each partition) are the
partitions' global offsets. Pass two cuts each document at the multiples of the window and writes a boundary record
for each piece. Only the last sequence is padded.

Defined cases: a null or empty text is the single end id; text that spells a special token is tokenized as the
tokenizer file says; a document of any length is cut across as many sequences as it needs; repeated rows are packed
each for itself; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, slices

WINDOW = 1024
END_ID = 0
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_TOKENIZED = "doc_id long, part int, at long, tokens binary, n_tokens long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Coder:
    """Ids as the tokenizer file gives them.

    A plain byte-level BPE file whose ids follow its merges is run by a faster engine from the same vocabulary; its
    ids are compared with the file's own engine on a probe first. Texts with very long words or blanks, and all other
    kinds of files, are left to the file's own engine.
    """

    PROBE = "It's 12 naïve  words,\n\n\tÄÖ — 漢字 \U0001f600!? we'll<|endoftext|> end "
    LONG = 1000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.fast = self._fast(path)
        if self.fast and self.fast.encode(self.PROBE, allowed_special="all") != self.own.encode(self.PROBE, add_special_tokens=False).ids:
            self.fast = None

    @staticmethod
    def _fast(path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec["normalizer"]
        if not plain or model.get("ignore_merges") or model.get("unk_token"):
            return None
        import public_tokenizers
        import tiktoken

        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*printable}))}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merged = [model["vocab"][a + b] for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        if merged != sorted(merged):
            return None
        ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        if self.fast:
            lengths = list(map(len, text.split()))
            if max(lengths, default=0) < self.LONG and len(text) - sum(lengths) < len(lengths) + self.LONG:
                return self.fast.encode_to_numpy(text, allowed_special="all")
        return np.array(self.own.encode(text, add_special_tokens=False).ids, np.uint32)


def _tokenize(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(path or default_tokenizer())
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            for first, texts in slices(b.column(1), 1 << 20):
                ids = [np.append(coder.ids(t), np.uint32(END_ID)).astype("<u4") for t in texts.to_pylist()]
                counts = np.array([len(x) for x in ids], np.int64)
                ends = at + np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(texts)), pa.array(np.full(len(counts), part), pa.int32()), pa.array(ends - counts), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(counts)],
                    ["doc_id", "part", "at", "tokens", "n_tokens"],
                )
                at = int(ends[-1])

    return run


def _cut(window: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc_id, at, tokens, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                view = memoryview(tokens.as_buffer())
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, window)
                    length = min(window - offset, n - start)
                    ids = view[4 * start : 4 * (start + length)]
                    out.append((doc_id, start, length, zlib.crc32(ids), n, sequence, offset, *((bytes(ids),) if keep_ids else ())))
                    start += length
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else [])]
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "ids" else pa.int64()) for k, c in zip(names, columns, strict=True)], names)

    return run


def tokenized(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Pass one: every document's ids (little-endian 32-bit), its partition, and the partition's tokens before it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return settle(rows.mapInArrow(_tokenize(tokenizer), _TOKENIZED))


def with_offsets(rows: DataFrame) -> DataFrame:
    """Adds the global offset of each document's first token. One number a partition passes through the driver."""
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total")).orderBy("part").collect()
    bases, base = [], 0
    for r in totals:
        bases.append((r.part, base))
        base += r.total
    known = rows.sparkSession.createDataFrame(bases, "part int, base long")
    return rows.join(F.broadcast(known), "part").withColumn("at", F.col("base") + F.col("at"))


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence. keep_ids: with the piece's token ids (little-endian 32-bit)."""
    placed = with_offsets(tokenized(docs, tokenizer))
    return placed.select("doc_id", "at", "tokens", "n_tokens").mapInArrow(_cut(window, keep_ids), PIECES + (", ids binary" if keep_ids else ""))
