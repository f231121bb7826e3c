"""Durable intermediates: tables in a folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    Without that setting a temporary folder serves local sessions only.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="graphvec-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        base = f"file://{base}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/graphvec-{uuid.uuid4().hex}"


#: Paths of the tables that each open scope will remove.
_scopes: list[list[str]] = []


def _remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that are settled inside go when it ends, but for those settled with ``keep``."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _remove(spark, path)


#: Whether a query's shuffle files go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go as soon as each is done, as nobody reads them again; the driver's garbage collection
    would let them lie for long. Those of persisted tables stay."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def settle(df: DataFrame, instead_of: DataFrame | None = None, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: later stages neither recompute it nor depend on one executor.

    The table goes with the innermost ``passing`` around it (unless ``keep``), or when the driver ends. ``instead_of``: a settled table that nobody
    reads any more once this one is written; it goes then.
    """
    spark = df.sparkSession
    path = scratch_dir(spark)
    with brief_shuffles(spark):
        df.write.parquet(path, compression="zstd")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    if _scopes and not keep:
        _scopes[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_in = path
    if hasattr(instead_of, "settled_in"):
        _remove(spark, instead_of.settled_in)
    return out


def in_order(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The rows numbered 0, 1, ... by ``keys`` over the whole table, in column ``at``.

    Rows are range-partitioned, sorted and written; only each partition's number of rows passes through the driver. A
    group of any size may span partitions.
    """
    return numbered(rows.repartitionByRange(*keys).sortWithinPartitions(*keys), at)


def numbered(rows: DataFrame, at: str) -> DataFrame:
    """The rows numbered 0, 1, ... in the order of their partitions, in column ``at``. They are written with their numbers and stay so."""
    placed = settle(rows.withColumn(at, F.monotonically_increasing_id()))
    part, mask = F.shiftright(at, 33).cast("int"), (1 << 33) - 1
    counts = {r.part: r.n for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    bases, base = [], 0
    for p in range(max(counts, default=0) + 1):
        bases.append(F.lit(base).cast("long"))
        base += counts.get(p, 0)
    return placed.withColumn(at, F.element_at(F.array(*bases), part + 1) + F.col(at).bitwiseAND(F.lit(mask)))
