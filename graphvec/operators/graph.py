"""The property graph: label views, the catalog, point reads, statistics and index commands."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DuplicateKey, EdgeNotFound, InvalidVectorDim, LabelNotFound, NodeNotFound
from ..functions.similarity import VectorConfig
from ..functions.values import BAG, VECTOR, from_bag
from ..plans.catalog import Catalog
from ..sources.views import EDGE_KEYS, NODE_KEYS, View
from .queries import EdgeQuery, NodeQuery
from .traversal import NodeRef


@dataclass(frozen=True)
class Node:
    id: int
    label: str
    properties: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Edge:
    id: int
    src: int
    dst: int
    label: str
    properties: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class LabelStats:
    label: str
    node_count: int
    edge_count: int


@dataclass(frozen=True)
class GraphStats:
    node_count: int
    edge_count: int
    labels: list[LabelStats]
    node_indexes: dict[str, list[str]]
    edge_indexes: dict[str, list[str]]


_NODE_SCHEMA = f"id bigint, label string, props {BAG}"
_EDGE_SCHEMA = f"id bigint, src bigint, dst bigint, label string, props {BAG}"
SCHEMAS = {"node": _NODE_SCHEMA, "edge": _EDGE_SCHEMA}
_KEYS = {"node": NODE_KEYS, "edge": EDGE_KEYS}


def to_record(kind: str, row: Any) -> Node | Edge:
    props = {p: from_bag(v) for p, v in sorted((row.props or {}).items())}
    return Node(row.id, row.label, props) if kind == "node" else Edge(row.id, row.src, row.dst, row.label, props)


class PropertyGraph:
    """Nodes and edges either as typed label views (``from_views``) or as tables of tagged bags (``from_bags``)."""

    def __init__(self, spark: SparkSession, catalog: Catalog | None = None):
        self.spark = spark
        self.catalog = catalog or Catalog()
        self._views: dict[str, Mapping[str, View]] = {"node": {}, "edge": {}}
        self._bags: dict[str, DataFrame] | None = None

    @staticmethod
    def from_views(spark: SparkSession, nodes: Iterable[View] | Mapping[str, View], edges: Iterable[View] | Mapping[str, View], catalog: Catalog | None = None) -> PropertyGraph:
        """Views, or mappings of label to view such as ``Deferred``."""
        out = PropertyGraph(spark, catalog)
        out._views = {k: v if isinstance(v, Mapping) else {x.label: x for x in v} for k, v in (("node", nodes), ("edge", edges))}
        return out

    @staticmethod
    def from_bags(spark: SparkSession, nodes: DataFrame, edges: DataFrame, catalog: Catalog | None = None) -> PropertyGraph:
        """nodes: id, label, props; edges: id, src, dst, label, props (props of type ``values.BAG``)."""
        out = PropertyGraph(spark, catalog)
        out._bags = {"node": nodes, "edge": edges}
        return out

    def index_everything(self) -> PropertyGraph:
        """Registers all properties of all typed views."""
        for kind, views in self._views.items():
            for v in views.values():
                self.catalog.props(kind).update((v.label, p) for p, k in (v.kinds or {}).items() if k != VECTOR)
        return self

    # plans

    def view(self, kind: str, label: str) -> View | None:
        """Where a label's rows are; none if a typed graph has no such label."""
        if self._bags is None:
            return self._views[kind].get(label)
        rows = self._bags[kind].filter(F.col("label") == label)
        return View(label, rows.drop("label"), None, keys=_KEYS[kind])

    def _union(self, kind: str, parts: list[DataFrame], schema: str) -> DataFrame:
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def bare(self, kind: str, label: str | None = None) -> DataFrame:
        """Keys and label of all items, or of those of one label."""
        keys = _KEYS[kind]
        if self._bags is not None:
            rows = self._bags[kind].select(*keys, "label")
            return rows if label is None else rows.filter(F.col("label") == label)
        views = [v for v in self._views[kind].values() if label is None or v.label == label]
        return self._union(kind, [v.bare() for v in views], ", ".join(f"{k} bigint" for k in keys) + ", label string")

    def records(self, kind: str) -> DataFrame:
        if self._bags is not None:
            return self._bags[kind]
        return self._union(kind, [v.records() for v in self._views[kind].values()], SCHEMAS[kind])

    def adjacency(self, label: str | None) -> DataFrame:
        """(src, dst) of the edges of one label, or of all."""
        return self.bare("edge", label).select("src", "dst")

    # queries

    def nodes(self) -> NodeQuery:
        return NodeQuery(self)

    def edges(self) -> EdgeQuery:
        return EdgeQuery(self)

    def node(self, node_id: int) -> NodeRef:
        return NodeRef(self, node_id)

    def load(self, kind: str, ids: Sequence[int], label: str | None = None) -> list[Any]:
        """The records of ``ids`` in their order, as often as named; unknown ids are left out. ``label``: of all ids, so that only
        that label's table is read."""
        if not ids:
            return []
        view = None if label is None else self.view(kind, label)
        rows = (self.records(kind) if view is None else view.records()).filter(F.col("id").isin(sorted(set(ids)))).collect()
        found = {r.id: to_record(kind, r) for r in rows}
        return [found[i] for i in ids if i in found]

    def _get(self, kind: str, ids: Sequence[int]) -> list[Any]:
        found = self.load(kind, ids)
        if len(found) < len(ids):
            known = {x.id for x in found}
            missing = next(i for i in ids if i not in known)
            raise (NodeNotFound if kind == "node" else EdgeNotFound)(f"{kind} {missing} not found")
        return found

    def get_node(self, node_id: int) -> Node:
        return self._get("node", [node_id])[0]

    def get_edge(self, edge_id: int) -> Edge:
        return self._get("edge", [edge_id])[0]

    def get_nodes(self, ids: Sequence[int]) -> list[Node]:
        return self._get("node", list(ids))

    def get_edges(self, ids: Sequence[int]) -> list[Edge]:
        return self._get("edge", list(ids))

    def get_df(self, kind: str, ids: Sequence[int]) -> DataFrame:
        """(pos, id, label) for each wanted id in order; label is null if the id is unknown."""
        wanted = self.spark.createDataFrame([(p, i) for p, i in enumerate(ids)], "pos int, id bigint")
        rows = self.bare(kind).filter(F.col("id").isin(sorted(set(ids)))).select("id", "label")
        return wanted.join(rows, "id", "left").select("pos", "id", "label").orderBy("pos")

    # statistics

    def label_counts(self) -> DataFrame:
        """(label, node_count, edge_count), in label order."""
        nodes = self.bare("node").groupBy("label").agg(F.count("*").alias("node_count"))
        edges = self.bare("edge").groupBy("label").agg(F.count("*").alias("edge_count"))
        return nodes.join(edges, "label", "full_outer").select("label", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("node_count", "edge_count"))).orderBy("label")

    def stats(self) -> GraphStats:
        labels = [LabelStats(r.label, r.node_count, r.edge_count) for r in self.label_counts().collect()]
        return GraphStats(sum(x.node_count for x in labels), sum(x.edge_count for x in labels), labels, self.catalog.listed("node"), self.catalog.listed("edge"))

    # index commands

    def indexes(self) -> Indexes:
        return Indexes(self)

    def value_key(self, view: View, prop: str) -> Column:
        """What unique constraints compare: kind and value, null if missing or not indexable."""
        if view.kinds is not None:
            column, kind = F.col(prop), view.kinds.get(prop)
            if kind is None or kind == VECTOR:
                return F.lit(None).cast("string")
            return F.when(~F.isnan(column), column + F.lit(0.0)) if kind == 4 else column
        value = F.col("props").getItem(prop)
        fine = (value.getField("k") < VECTOR) & ~((value.getField("k") == 4) & F.coalesce(F.isnan(value.getField("f")), F.lit(False)))
        fields = [value.getField(n) for n in ("k", "s", "i", "b", "y")]
        return F.when(fine, F.struct(*(f.alias(n) for f, n in zip(fields, "ksiby", strict=True)), (value.getField("f") + F.lit(0.0)).alias("f")))

    def duplicates(self, kind: str, label: str, prop: str) -> DataFrame:
        """(value, n) of the values that several items of a label share."""
        view = self.view(kind, label)
        if view is None:
            return self.spark.createDataFrame([], "value string, n bigint")
        keyed = view.df.select(self.value_key(view, prop).alias("value")).filter("value is not null")
        return keyed.groupBy("value").agg(F.count("*").alias("n")).filter("n > 1")


class Indexes:
    def __init__(self, graph: PropertyGraph):
        self._graph = graph

    def nodes(self) -> PropertyIndexes:
        return PropertyIndexes(self._graph, "node")

    def edges(self) -> PropertyIndexes:
        return PropertyIndexes(self._graph, "edge")

    def vectors(self) -> VectorIndexes:
        return VectorIndexes(self._graph)


class PropertyIndexes:
    def __init__(self, graph: PropertyGraph, kind: str):
        self._graph, self._kind = graph, kind

    def _need_label(self, label: str) -> None:
        if self._graph.bare(self._kind, label).isEmpty():
            raise LabelNotFound(f"label {label!r} not found")

    def create_property(self, label: str, prop: str) -> None:
        self._need_label(label)
        self._graph.catalog.add_property(self._kind, label, prop)

    def create_unique(self, label: str, prop: str) -> None:
        self._need_label(label)
        trial = self._graph.catalog.copy()
        trial.add_unique(self._kind, label, prop)
        if not self._graph.duplicates(self._kind, label, prop).isEmpty():
            raise DuplicateKey(f"duplicate values for {label}::{prop}")
        self._graph.catalog.add_unique(self._kind, label, prop)

    def drop_property(self, label: str, prop: str) -> None:
        self._graph.catalog.drop_property(self._kind, label, prop)


class VectorIndexes:
    def __init__(self, graph: PropertyGraph):
        self._graph = graph

    def create(self, label: str, prop: str, dim: int, config: VectorConfig | None = None) -> None:
        trial = self._graph.catalog.copy()
        trial.add_vector(label, prop, dim, config or VectorConfig())
        view = self._graph.view("node", label)
        if view is not None:
            vector = view.vector(prop)
            wrong = view.df.filter(vector.isNotNull() & (F.size(vector) != dim)).select(F.size(vector).alias("n")).head()
            if wrong is not None:
                raise InvalidVectorDim(f"expected {dim} dimensions, got {wrong.n}")
        self._graph.catalog.add_vector(label, prop, dim, config or VectorConfig())

    def drop(self, label: str, prop: str) -> None:
        self._graph.catalog.drop_vector(label, prop)
