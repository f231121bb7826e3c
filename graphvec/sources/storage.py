"""Where a mutable graph's snapshots are kept.

A storage gives the latest snapshot and adds the next one if nobody else has: any object with ``load`` and ``commit`` will do.

A snapshot is a pile of layers. Each commit adds one, which holds just the rows that were added or changed (with the version that wrote
them, in column ``at``) and the ids that it took away: a row is hidden by a later layer that names its id, and an edge by the death of
either end. One scan reads a table's files of all layers; without ids taken away there is no join. ``GraphStore.compact`` makes the
pile one layer again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import TransactionConflict
from ..functions.values import BAG
from ..plans.catalog import Catalog
from .scratch import brief_shuffles, settle

NODES, EDGES = f"id bigint, label string, props {BAG}", f"id bigint, src bigint, dst bigint, label string, props {BAG}"

#: Tables of a layer: rows, ids that they replace or that are deleted, and deleted nodes, whose edges go.
_TABLES = {"nodes": NODES, "edges": EDGES, "gone_nodes": "id bigint", "gone_edges": "id bigint", "dead": "id bigint"}
_SORTED = {"nodes": ("label", "id"), "edges": ("label", "src")}


@dataclass(frozen=True)
class Change:
    """What a commit adds to the snapshot before it; the fields are a layer's tables."""

    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    gone_nodes: DataFrame | None = None
    gone_edges: DataFrame | None = None
    dead: DataFrame | None = None


@dataclass(frozen=True)
class Layer:
    version: int
    #: Where each table is that the layer has.
    paths: dict[str, str]


@dataclass(frozen=True)
class Snapshot:
    version: int
    nodes: DataFrame
    edges: DataFrame
    catalog: Catalog = field(default_factory=Catalog)
    next_node: int = 1
    next_edge: int = 1
    #: The last micro-batch of each stream that was loaded, by its checkpoint.
    loaded: dict[str, int] = field(default_factory=dict)
    #: How it differs from the snapshot before; none: in all rows.
    change: Change | None = None
    layers: tuple[Layer, ...] = ()


def _add_layer(snapshot: Snapshot, write: Callable[[str, DataFrame], str]) -> tuple[Layer, ...]:
    """Writes what the snapshot changes, or all its rows if it doesn't tell."""
    change = snapshot.change or Change(snapshot.nodes, snapshot.edges)
    paths = {}
    for name in _TABLES:
        if (rows := getattr(change, name)) is not None:
            # sorted by label, so that row groups of other labels are skipped
            paths[name] = write(name, rows.withColumn("at", F.lit(snapshot.version).cast("bigint")).sortWithinPartitions(*_SORTED.get(name, ("id",))))
    return (*(snapshot.layers if snapshot.change else ()), Layer(snapshot.version, paths))


def _read_layers(spark: SparkSession, layers: Sequence[Layer]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that no later layer hides."""

    def scan(name: str) -> DataFrame | None:
        paths = [x.paths[name] for x in layers if name in x.paths]
        return spark.read.schema(f"{_TABLES[name]}, at bigint").parquet(*paths) if paths else None

    out, dead = [], scan("dead")
    for name, schema in (("nodes", NODES), ("edges", EDGES)):
        rows, gone = scan(name), scan(f"gone_{name}")
        if rows is None:
            out.append(spark.createDataFrame([], schema))
            continue
        if gone is not None:
            gone = gone.select(F.col("id").alias("_id"), F.col("at").alias("_at"))
            rows = rows.join(gone, (F.col("id") == F.col("_id")) & (F.col("at") < F.col("_at")), "left_anti")
        if name == "edges" and dead is not None:
            ends = dead.select(F.col("id").alias("_id"))
            rows = rows.join(ends, F.col("src") == F.col("_id"), "left_anti").join(ends, F.col("dst") == F.col("_id"), "left_anti")
        out.append(rows.drop("at"))
    return out[0], out[1]


class Storage(Protocol):
    def load(self, spark: SparkSession) -> Snapshot: ...

    def commit(self, spark: SparkSession, snapshot: Snapshot, data_changed: bool) -> Snapshot: ...


class MemoryStorage:
    """Snapshots of one session, gone with it."""

    def __init__(self) -> None:
        self._now: Snapshot | None = None

    def load(self, spark: SparkSession) -> Snapshot:
        if self._now is None:
            self._now = Snapshot(0, spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))
        return self._now

    def commit(self, spark: SparkSession, snapshot: Snapshot, data_changed: bool) -> Snapshot:
        if snapshot.version != self.load(spark).version + 1:
            raise TransactionConflict(f"version {snapshot.version} was committed by another writer")
        if data_changed:
            layers = _add_layer(snapshot, lambda _, rows: settle(rows, keep=True).settled_in)
            nodes, edges = _read_layers(spark, layers)
            snapshot = replace(snapshot, nodes=nodes, edges=edges, layers=layers, change=None)
        self._now = snapshot
        return snapshot


class ParquetStorage:
    """Immutable Parquet layers under one path of any Hadoop file system, and a manifest for each version that lists its layers.

    A version is committed by renaming its complete manifest, which fails if there is one: of two writers one gets a conflict, and
    readers see whole manifests only. The file system must rename without replacing in one step, as HDFS does; object stores need one with a
    conditional put below the same interface. Old versions stay until removed by hand.
    """

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _fs(self, spark: SparkSession):
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), root

    def versions(self, spark: SparkSession) -> list[int]:
        _, fs, root = self._fs(spark)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def load(self, spark: SparkSession, version: int | None = None) -> Snapshot:
        versions = self.versions(spark)
        if not versions:
            return Snapshot(0, spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))
        version = versions[-1] if version is None else version
        data = json.loads("\n".join(r.value for r in spark.read.text(f"{self.path}/manifest-{version}.json", wholetext=True).collect()))
        layers = tuple(Layer(x["version"], {t: f"{self.path}/{x['folder']}/{t}" for t in x["tables"]}) for x in data["layers"])
        nodes, edges = _read_layers(spark, layers)
        return Snapshot(version, nodes, edges, Catalog.from_json(data["catalog"]), data["next_node"], data["next_edge"], data["loaded"], layers=layers)

    def commit(self, spark: SparkSession, snapshot: Snapshot, data_changed: bool) -> Snapshot:
        jvm, fs, root = self._fs(spark)
        if (last := self.versions(spark)) and last[-1] != snapshot.version - 1:
            raise TransactionConflict(f"version {snapshot.version} was committed by another writer")
        layers = snapshot.layers
        if data_changed:

            def write(name: str, rows: DataFrame) -> str:
                with brief_shuffles(spark):
                    rows.write.parquet(f"{folder}/{name}")
                return f"{folder}/{name}"

            folder = f"{self.path}/v={snapshot.version}-{uuid.uuid4().hex[:8]}"
            layers = _add_layer(snapshot, write)
        listed = [{"version": x.version, "folder": next(iter(x.paths.values())).split("/")[-2], "tables": list(x.paths)} for x in layers if x.paths]
        manifest = {"layers": listed, "catalog": snapshot.catalog.to_json(), "next_node": snapshot.next_node, "next_edge": snapshot.next_edge, "loaded": snapshot.loaded}
        hadoop = jvm.org.apache.hadoop.fs
        target, aside = (hadoop.Path(root, n) for n in (f"manifest-{snapshot.version}.json", f"_{uuid.uuid4().hex}"))
        out = fs.create(aside, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        never = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            hadoop.FileContext.getFileContext(root.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(aside), fs.makeQualified(target), never)
        except Exception as e:
            fs.delete(aside, False)
            if fs.exists(target):
                raise TransactionConflict(f"version {snapshot.version} was committed by another writer") from e
            raise
        return self.load(spark, snapshot.version)
