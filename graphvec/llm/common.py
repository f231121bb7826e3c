"""Helpers that the training-data operators share: tables, durable intermediates and Arrow word columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import in_order, passing, scratch_dir, settle

__all__ = ["bucket_of", "class_sample", "coded", "in_order", "one_of_each_id", "passing", "scratch_dir", "settle", "slices", "spread", "sums", "table", "train_once", "unused", "words"]

#: Text bytes that a Python worker turns into arrays at once.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) in runs of about ``limit`` bytes; a longer text stands alone. Nulls become empty texts."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield at, texts.slice(at, to - at)
        at = to


def words(texts: pa.Array, lower: bool) -> tuple[pa.Array, np.ndarray]:
    """All words (runs without ASCII white space) of the texts in a row, and the offset of each text's first word (n + 1 entries)."""
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
    keep = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))]).astype(np.int64)
    return flat.filter(keep), kept[offsets]


def coded(flat: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """A number for each word, and the distinct words as UTF-8."""
    d = flat.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.cast(pa.binary()).to_pylist()


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each run offsets[i]:offsets[i + 1] (0 for empty runs)."""
    out = np.zeros(len(offsets) - 1, dtype=np.result_type(values.dtype, np.int64) if values.dtype != np.float64 else np.float64)
    full = offsets[1:] > offsets[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, offsets[:-1][full], dtype=out.dtype)
    return out


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def class_sample(rows: DataFrame, label: str, per_class: int) -> DataFrame:
    """Rows of about ``per_class`` ids of each label (all of a smaller class), whose hash is below a share. Nulls have no label.

    Ids are counted, not rows (to a few percent), so that an id with very many rows doesn't thin out the others.
    """
    rows = rows.filter(F.col(label).isNotNull())
    counts = rows.groupBy(label).agg(F.approx_count_distinct("doc_id").alias("_n"))
    below = F.ceil(F.lit(per_class) / F.col("_n") * (1 << 30))
    picked = F.shiftrightunsigned(F.xxhash64("doc_id"), 34) < F.col("_below")
    return rows.join(F.broadcast(counts.select(F.col(label).alias("_label"), below.alias("_below"))), F.col(label) == F.col("_label")).filter(picked).drop("_label", "_below")


def one_of_each_id(rows: DataFrame, label: str) -> DataFrame:
    """(doc_id, label, text): of each id and label the row whose text has the smallest hash.

    An id that a large share of all rows have thus adds one row to a sample; map tasks drop the others before the shuffle.
    """
    least = F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("t")))
    return rows.groupBy("doc_id", label).agg(least.alias("_least")).select("doc_id", label, F.col("_least.t").alias("text"))


def spread(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Feature numbers below 2 ** bits from 64-bit hashes."""
    return (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def train_once(features: DataFrame, fit, schema: str) -> DataFrame:
    """Runs ``fit`` (all batches of one bounded sample -> one batch) in a single task that can be repeated anywhere."""
    return features.repartition(1).mapInArrow(fit, schema)

