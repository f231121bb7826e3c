"""The mutable graph: transactions over immutable snapshots.

A transaction collects its changes by id in the driver, checks them against the snapshot it started from and its own changes,
and commits them as the next snapshot in one step: only added and changed rows are written, and the ids that they replace. An error in
between leaves nothing behind, ids included. ``bulk_load`` takes whole tables without passing the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import replace
from typing import Any, TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DuplicateKey, EdgeNotFound, InvalidVectorDim, NodeNotFound, StorageError
from ..functions.values import VECTOR, bag_value, canonical, index_key, kind_of
from ..plans.predicates import make, tagged
from ..sources.scratch import numbered, passing
from ..sources.storage import EDGES, NODES, Change, MemoryStorage, ParquetStorage, Snapshot, Storage
from .graph import Edge, Indexes, Node, PropertyGraph, PropertyIndexes, VectorIndexes, to_record

Result = TypeVar("Result")
Props = Mapping[str, Any] | Sequence[tuple[str, Any]]
_MOST = (1 << 63) - 1


class GraphStore:
    def __init__(self, spark: SparkSession, storage: Storage | None = None):
        self.spark = spark
        self.storage = storage or MemoryStorage()
        self._snapshot = self.storage.load(spark)

    @staticmethod
    def open(spark: SparkSession, path: str) -> GraphStore:
        return GraphStore(spark, ParquetStorage(path))

    def close(self) -> None:
        """Nothing is held open; the storage keeps all committed versions."""

    @property
    def path(self) -> str | None:
        return getattr(self.storage, "path", None)

    @property
    def version(self) -> int:
        return self._snapshot.version

    def refresh(self) -> GraphStore:
        """Sees versions that others have committed."""
        self._snapshot = self.storage.load(self.spark)
        return self

    @property
    def graph(self) -> PropertyGraph:
        """The current snapshot; it stays as it is when others are committed."""
        s = self._snapshot
        return PropertyGraph.from_bags(self.spark, s.nodes, s.edges, s.catalog.copy())

    # reads

    def nodes(self):
        return self.graph.nodes()

    def edges(self):
        return self.graph.edges()

    def node(self, node_id: int):
        return self.graph.node(node_id)

    def get_node(self, node_id: int) -> Node:
        return self.graph.get_node(node_id)

    def get_edge(self, edge_id: int) -> Edge:
        return self.graph.get_edge(edge_id)

    def get_nodes(self, ids: Sequence[int]) -> list[Node]:
        return self.graph.get_nodes(ids)

    def get_edges(self, ids: Sequence[int]) -> list[Edge]:
        return self.graph.get_edges(ids)

    def stats(self):
        return self.graph.stats()

    def read(self, what: Callable[[PropertyGraph], Result]) -> Result:
        """Several reads of one snapshot."""
        return what(self.graph)

    # writes

    def compact(self) -> None:
        """Writes all rows as one layer, so that reads no longer put layers together. Worth it after many small commits or deletions."""
        after = replace(self._snapshot, version=self._snapshot.version + 1, change=None)
        self._snapshot = self.storage.commit(self.spark, after, True)

    def batch(self, what: Callable[[Transaction], Result]) -> Result:
        """Runs ``what`` and commits all its changes, or none if it raises."""
        tx = Transaction(self)
        out = what(tx)
        if tx.changed:
            self._snapshot = self.storage.commit(self.spark, tx.snapshot(), True)
        return out

    def add_node(self, label: str, props: Props = ()) -> int:
        return self.batch(lambda tx: tx.add_node(label, props))

    def add_edge(self, src: int, dst: int, label: str, props: Props = ()) -> int:
        return self.batch(lambda tx: tx.add_edge(src, dst, label, props))

    def delete_node(self, node_id: int) -> None:
        self.batch(lambda tx: tx.delete_node(node_id))

    def delete_edge(self, edge_id: int) -> None:
        self.batch(lambda tx: tx.delete_edge(edge_id))

    def update_node(self, node_id: int) -> Update:
        return Update(lambda ops: self.batch(lambda tx: tx.apply("node", node_id, ops)))

    def update_edge(self, edge_id: int) -> Update:
        return Update(lambda ops: self.batch(lambda tx: tx.apply("edge", edge_id, ops)))

    def bulk_load(self, nodes: DataFrame | None = None, edges: DataFrame | None = None, batch: tuple[str, int] | None = None) -> None:
        """Appends tables (label, props and for edges src, dst; ids are given in the order of the tables' partitions) in one commit.

        Endpoints, unique constraints and vector lengths are checked by joins and aggregations. ``batch``: the stream and number of a
        micro-batch; one that the graph has is skipped.
        """
        with passing(self.spark):
            self._bulk_load(nodes, edges, batch)

    def _bulk_load(self, nodes: DataFrame | None, edges: DataFrame | None, batch: tuple[str, int] | None) -> None:
        s = self._snapshot
        if batch and s.loaded.get(batch[0], -1) >= batch[1]:
            return
        new, counts = {}, {}
        for kind, df, first in (("node", nodes, s.next_node), ("edge", edges, s.next_edge)):
            if df is None:
                continue
            keys = ["label"] if kind == "node" else ["src", "dst", "label"]
            placed = numbered(df.select(*(F.col(k).cast("bigint").alias(k) for k in keys[:-1]), "label", "props"), "_at")
            new[kind] = placed.select((F.col("_at") + first).alias("id"), *keys, "props")
            counts[kind] = placed.count()
        after_nodes = s.nodes.unionByName(new["node"]) if "node" in new else s.nodes
        after_edges = s.edges.unionByName(new["edge"]) if "edge" in new else s.edges
        if "edge" in new:
            ends = new["edge"].select(F.explode(F.array("src", "dst")).alias("id")).distinct()
            lost = ends.join(after_nodes.select("id"), "id", "left_anti").head()
            if lost is not None:
                raise NodeNotFound(f"node {lost.id} not found")
        graph = PropertyGraph.from_bags(self.spark, after_nodes, after_edges, s.catalog)
        for kind in new:
            for label, prop in sorted(s.catalog.unique(kind)):
                if not graph.duplicates(kind, label, prop).isEmpty():
                    raise DuplicateKey(f"duplicate values for {label}::{prop}")
        for (label, prop), (dim, _) in sorted(s.catalog.vectors.items()):
            vector = F.col("props").getItem(prop).getField("v")
            if "node" in new and not new["node"].filter((F.col("label") == label) & vector.isNotNull() & (F.size(vector) != dim)).isEmpty():
                raise InvalidVectorDim(f"expected {dim} dimensions for {label}::{prop}")
        after = replace(
            s, version=s.version + 1, nodes=after_nodes, edges=after_edges, next_node=s.next_node + counts.get("node", 0), next_edge=s.next_edge + counts.get("edge", 0),
            loaded=s.loaded | dict([batch] if batch else []), change=Change(new.get("node"), new.get("edge")),
        )
        self._snapshot = self.storage.commit(self.spark, after, True)

    # indexes

    def indexes(self) -> StoreIndexes:
        return StoreIndexes(self)

    def change_catalog(self, what: Callable[[Indexes], None]) -> None:
        graph = self.graph
        what(graph.indexes())
        after = replace(self._snapshot, version=self._snapshot.version + 1, catalog=graph.catalog)
        self._snapshot = self.storage.commit(self.spark, after, False)


class _Committed:
    """Index commands that are committed with the catalog."""

    def __init__(self, store: GraphStore, pick: Callable[[Indexes], PropertyIndexes | VectorIndexes]):
        self._store, self._pick = store, pick

    def __getattr__(self, name: str):
        return lambda *a, **b: self._store.change_catalog(lambda indexes: getattr(self._pick(indexes), name)(*a, **b))


class StoreIndexes:
    def __init__(self, store: GraphStore):
        self._store = store

    def nodes(self):
        return _Committed(self._store, Indexes.nodes)

    def edges(self):
        return _Committed(self._store, Indexes.edges)

    def vectors(self):
        return _Committed(self._store, Indexes.vectors)


class Update:
    """Changes to one item, applied in call order."""

    def __init__(self, run: Callable[[list[tuple]], None]):
        self._run, self._ops = run, []

    def _add(self, *op: Any) -> Update:
        self._ops.append(op)
        return self

    def set_label(self, label: str) -> Update:
        return self._add("label", label)

    def set_from(self, node_id: int) -> Update:
        return self._add("src", node_id)

    def set_to(self, node_id: int) -> Update:
        return self._add("dst", node_id)

    def set_property(self, prop: str, value: Any) -> Update:
        return self._add("set", prop, canonical(value))

    def remove_property(self, prop: str) -> Update:
        return self._add("remove", prop)

    def replace_properties(self, props: Props) -> Update:
        return self._add("replace", {p: canonical(v) for p, v in dict(props).items()})

    def apply(self) -> None:
        self._run(self._ops)


class Transaction:
    """Changes on top of a snapshot, visible to the transaction itself."""

    def __init__(self, store: GraphStore):
        self._store, self._base = store, store._snapshot
        self._catalog = self._base.catalog
        #: Changed items by id; none: deleted.
        self._items: dict[str, dict[int, Any]] = {"node": {}, "edge": {}}
        self._dead: set[int] = set()
        #: Nodes of the base that are known to exist there.
        self._seen: set[int] = set()
        #: Unique values (kind of item, label, property, key) that no item of the base has, and items of the transaction by theirs.
        self._free: set[tuple] = set()
        self._holders: dict[tuple, set[int]] = {}
        self._next = {"node": self._base.next_node, "edge": self._base.next_edge}

    @property
    def changed(self) -> bool:
        return bool(self._items["node"] or self._items["edge"])

    def _table(self, kind: str) -> DataFrame:
        return self._base.nodes if kind == "node" else self._base.edges

    def _find(self, kind: str, item_id: int) -> Any | None:
        if item_id in self._items[kind]:
            return self._items[kind][item_id]
        if not 0 < item_id <= _MOST:
            return None
        row = self._table(kind).filter(F.col("id") == item_id).head()
        if row is None or kind == "edge" and (row.src in self._dead or row.dst in self._dead):
            return None
        return to_record(kind, row)

    def get_node(self, node_id: int) -> Node:
        found = self._find("node", node_id)
        if found is None:
            raise NodeNotFound(f"node {node_id} not found")
        return found

    def get_edge(self, edge_id: int) -> Edge:
        found = self._find("edge", edge_id)
        if found is None:
            raise EdgeNotFound(f"edge {edge_id} not found")
        return found

    def get_nodes(self, ids: Sequence[int]) -> list[Node]:
        return [self.get_node(i) for i in ids]

    def get_edges(self, ids: Sequence[int]) -> list[Edge]:
        return [self.get_edge(i) for i in ids]

    def _check(self, kind: str, label: str, props: dict[str, Any], own: int | None) -> None:
        if kind == "node":
            for p, v in props.items():
                if (label, p) in self._catalog.vectors and kind_of(v) == VECTOR and len(v) != self._catalog.vectors[label, p][0]:
                    raise InvalidVectorDim(f"expected {self._catalog.vectors[label, p][0]} dimensions, got {len(v)}")
        for unique_label, p in sorted(self._catalog.unique(kind)):
            if unique_label != label or p not in props or (key := index_key(props[p])) is None:
                continue
            items = self._items[kind]
            if any(i != own and (x := items[i]) is not None and x.label == label and p in x.properties and index_key(x.properties[p]) == key for i in self._holders.get((kind, label, p, key), ())):
                raise DuplicateKey(f"{label}::{p} already has the value {props[p]!r}")
            if (kind, label, p, key) in self._free:
                continue
            same = self._table(kind).filter((F.col("label") == label) & tagged(make("eq", p, props[p]), F.col("props").getItem(p)))
            same = same.filter(~F.col("id").isin([*items, *([own] if own else [])])) if items or own else same
            if kind == "edge" and self._dead:
                same = same.filter(~F.col("src").isin(sorted(self._dead)) & ~F.col("dst").isin(sorted(self._dead)))
            if not same.isEmpty():
                raise DuplicateKey(f"{label}::{p} already has the value {props[p]!r}")

    def _new_id(self, kind: str) -> int:
        out = self._next[kind]
        if out > _MOST:
            raise StorageError(f"no {kind} id left")
        self._next[kind] = out + 1
        return out

    def add_node(self, label: str, props: Props = ()) -> int:
        props = {p: canonical(v) for p, v in dict(props).items()}
        self._check("node", label, props, None)
        node_id = self._new_id("node")
        self._put("node", Node(node_id, label, props))
        return node_id

    def _put(self, kind: str, item: Node | Edge) -> None:
        self._items[kind][item.id] = item
        for label, p in self._catalog.unique(kind):
            if label == item.label and p in item.properties and (key := index_key(item.properties[p])) is not None:
                self._holders.setdefault((kind, label, p, key), set()).add(item.id)

    def _look_up_unique(self, kind: str, items: Iterable[tuple[str, Props]]) -> None:
        """Notes the unique values among ``items`` that the base doesn't have: one job for each unique property."""
        items = [(label, dict(props)) for label, props in items]
        spark = self._store.spark
        for label, p in sorted(self._catalog.unique(kind)):
            keys = {key: props[p] for own, props in items if own == label and p in props and (key := index_key(props[p])) is not None}
            if not keys:
                continue
            ends = (0, 0) if kind == "edge" else ()
            wanted = spark.createDataFrame([(i, *ends, label, {p: bag_value(v)}) for i, v in enumerate(keys.values())], NODES if kind == "node" else EDGES)
            graphs = [PropertyGraph.from_bags(spark, rows, rows) for rows in (wanted, self._table(kind))]
            views = [g.view(kind, label) for g in graphs]
            ours, theirs = (v.df.select(*extra, g.value_key(v, p).alias("value")) for g, v, extra in zip(graphs, views, (["id"], []), strict=True))
            taken = {r.id for r in ours.join(theirs, "value", "left_semi").select("id").collect()}
            self._free |= {(kind, label, p, key) for i, key in enumerate(keys) if i not in taken}

    def add_nodes(self, nodes: Iterable[tuple[str, Props]]) -> list[int]:
        """Adds many nodes; their unique values are looked up together."""
        nodes = list(nodes)
        self._look_up_unique("node", nodes)
        return [self.add_node(*n) for n in nodes]

    def add_edge(self, src: int, dst: int, label: str, props: Props = ()) -> int:
        for end in (src, dst):
            if end in self._items["node"] or end not in self._seen:
                self.get_node(end)
                self._seen.add(end)
        props = {p: canonical(v) for p, v in dict(props).items()}
        self._check("edge", label, props, None)
        edge_id = self._new_id("edge")
        self._put("edge", Edge(edge_id, src, dst, label, props))
        return edge_id

    def add_edges(self, edges: Iterable[tuple[int, int, str, Props]]) -> list[int]:
        """Adds many edges; all ends that the transaction doesn't know yet are looked up together, and so are unique values."""
        edges = list(edges)
        self._look_up_unique("edge", ((label, props) for *_, label, props in edges))
        ends = {i for src, dst, *_ in edges for i in (src, dst)} - self._items["node"].keys() - self._seen
        wanted = sorted(i for i in ends if 0 < i <= _MOST)
        if wanted:
            rows = self._store.spark.createDataFrame([(i,) for i in wanted], "id bigint")
            self._seen |= {r.id for r in rows.join(self._base.nodes.select("id"), "id", "left_semi").collect()}
        return [self.add_edge(*e) for e in edges]

    def delete_node(self, node_id: int) -> None:
        """Also deletes all edges from and to the node."""
        self.get_node(node_id)
        self._items["node"][node_id] = None
        self._dead.add(node_id)
        edges = self._items["edge"]
        for i, e in list(edges.items()):
            if e is not None and node_id in (e.src, e.dst):
                edges[i] = None

    def delete_edge(self, edge_id: int) -> None:
        self.get_edge(edge_id)
        self._items["edge"][edge_id] = None

    def update_node(self, node_id: int) -> Update:
        return Update(lambda ops: self.apply("node", node_id, ops))

    def update_edge(self, edge_id: int) -> Update:
        return Update(lambda ops: self.apply("edge", edge_id, ops))

    def apply(self, kind: str, item_id: int, ops: list[tuple]) -> None:
        item = self.get_node(item_id) if kind == "node" else self.get_edge(item_id)
        if not ops:
            return
        label, props, ends = item.label, dict(item.properties), {}
        for op, *args in ops:
            if op == "label":
                label = args[0]
            elif op == "set":
                props[args[0]] = args[1]
            elif op == "remove":
                props.pop(args[0], None)
            elif op == "replace":
                props = dict(args[0])
            elif kind == "edge":
                ends[op] = args[0]
            else:
                raise TypeError("nodes have no ends")
        for end in ("src", "dst"):
            if end in ends:
                self.get_node(ends[end])
        self._check(kind, label, props, item_id)
        self._put(kind, replace(item, label=label, properties=props, **ends))

    def snapshot(self) -> Snapshot:
        """The base without changed rows, and the changed ones; beside them the change alone."""
        spark, tables, change = self._store.spark, {}, {}
        for kind, schema in (("node", NODES), ("edge", EDGES)):
            rows, items = self._table(kind), self._items[kind]
            first = self._base.next_node if kind == "node" else self._base.next_edge
            if old := [(i,) for i in sorted(items) if i < first]:
                gone = change[f"gone_{kind}s"] = spark.createDataFrame(old, "id bigint").coalesce(1)
                rows = rows.join(gone, "id", "left_anti")
            if kind == "edge" and (lost := [(i,) for i in sorted(self._dead) if i < self._base.next_node]):
                change["dead"] = spark.createDataFrame(lost, "id bigint").coalesce(1)
                dead = change["dead"].withColumnRenamed("id", "dead")
                rows = rows.join(dead, F.col("src") == F.col("dead"), "left_anti").join(dead, F.col("dst") == F.col("dead"), "left_anti")
            kept = [x for x in items.values() if x is not None]
            if kept:
                data = [(x.id, *((x.src, x.dst) if kind == "edge" else ()), x.label, {p: bag_value(v) for p, v in x.properties.items()}) for x in kept]
                change[f"{kind}s"] = spark.createDataFrame(data, schema).coalesce(1)
                rows = rows.unionByName(change[f"{kind}s"])
            tables[f"{kind}s"] = rows
        return replace(self._base, version=self._base.version + 1, **tables, next_node=self._next["node"], next_edge=self._next["edge"], change=Change(**change))
