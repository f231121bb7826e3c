"""Traversals as joins of edges with frontiers.

One hop from a node is a filter on the edges, one result per edge. Further hops form one lazy plan: each hop is a semi-join of the edges
with the frontier, then distinct targets. No hop runs by itself, and no set of visited nodes is kept.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import IndexNotFound, InvalidCursor
from ..plans import paging
from ..plans.paging import Page
from .queries import Filtered

if TYPE_CHECKING:
    from .graph import PropertyGraph

OUT, IN = "out", "in"
_NEAR, _FAR = {OUT: "src", IN: "dst"}, {OUT: "dst", IN: "src"}


@dataclass(frozen=True)
class Hop:
    direction: str
    label: str | None


class NodeRef:
    """A node to start from; it need not exist."""

    def __init__(self, graph: PropertyGraph, node_id: int):
        self._graph, self._id = graph, node_id

    def outgoing(self, label: str) -> Traversal:
        return Traversal(self._graph, self._id, Hop(OUT, label))

    def incoming(self, label: str) -> Traversal:
        return Traversal(self._graph, self._id, Hop(IN, label))

    def outgoing_any(self) -> Traversal:
        return Traversal(self._graph, self._id, Hop(OUT, None))

    def incoming_any(self) -> Traversal:
        return Traversal(self._graph, self._id, Hop(IN, None))

    def _chain(self) -> MultiHop:
        return MultiHop(self._graph, [self._id], ())

    def then_outgoing(self, label: str) -> MultiHop:
        return self._chain().then_outgoing(label)

    def then_incoming(self, label: str) -> MultiHop:
        return self._chain().then_incoming(label)

    def then_outgoing_any(self) -> MultiHop:
        return self._chain().then_outgoing_any()

    def then_incoming_any(self) -> MultiHop:
        return self._chain().then_incoming_any()


class Traversal(Filtered):
    """One hop from one node."""

    def __init__(self, graph: PropertyGraph, node_id: int, hop: Hop):
        self._graph, self._id, self._hop = graph, node_id, hop
        self._filters = []
        self._limit: int | None = None
        self._after: str | None = None

    def _rows(self) -> DataFrame:
        """Matching edges as (id, src, dst, label)."""
        near = F.col(_NEAR[self._hop.direction]) == self._id
        if self._hop.label is None:
            if self._filters:
                raise IndexNotFound("property filters need a label")
            return self._graph.bare("edge").filter(near)
        for f in self._filters:
            self._graph.catalog.require("edge", self._hop.label, f.prop)
        view = self._graph.view("edge", self._hop.label)
        if view is None:
            return self._graph.bare("edge").limit(0)
        return self._matching(view, "edge").filter(near).select("id", "src", "dst", F.lit(view.label).alias("label"))

    def _order(self) -> list:
        return [F.octet_length("label"), F.col("label"), F.col("id")] if self._hop.label is None else [F.col("id")]

    def edges_df(self) -> DataFrame:
        out = self._rows().orderBy(*self._order())
        return out if self._limit is None else out.limit(self._limit)

    def nodes_df(self) -> DataFrame:
        """(edge_id, id, label): the node at the far end of each edge, once per edge."""
        far = _FAR[self._hop.direction]
        edges = self.edges_df().select(F.col("id").alias("edge_id"), F.col(far).alias("id"))
        view = self._graph.view("edge", self._hop.label) if self._hop.label is not None else None
        label = view.ends[1 if far == "dst" else 0] if view else None
        nodes = self._graph.bare("node", label)
        return edges.join(nodes, "id").select("edge_id", "id", "label")

    def edges(self) -> list[Any]:
        paging.no_cursor(self._after)
        return self._graph.load("edge", [r.id for r in self.edges_df().select("id").collect()])

    def _far_ids(self, rows: DataFrame) -> list[tuple[int, int]]:
        far = _FAR[self._hop.direction]
        return [(r.id, r[far]) for r in rows.select("id", far).collect()]

    def nodes(self) -> list[Any]:
        paging.no_cursor(self._after)
        return self._graph.load("node", [far for _, far in self._far_ids(self.edges_df())])

    def count(self) -> int:
        """All matching edges, whatever the limit."""
        paging.no_cursor(self._after)
        return self._rows().count()

    def first_edge(self) -> Any | None:
        found = self.limit(1).edges()
        return found[0] if found else None

    def first_node(self) -> Any | None:
        found = self.limit(1).nodes()
        return found[0] if found else None

    def _page(self, size: int) -> tuple[list[tuple[int, int]], str | None]:
        paging.check(self._limit, size)
        rows = self._rows()
        if self._after is not None:
            at = paging.decode("e", self._after)
            found = rows.filter(F.col("id") == at).head() if at < 1 << 63 else None
            if found is None:
                raise InvalidCursor("cursor not found in result set")
            if self._hop.label is None:
                here = F.struct(F.octet_length("label").alias("n"), "label", "id")
                rows = rows.filter(here > F.struct(F.lit(len(found.label.encode())).alias("n"), F.lit(found.label).alias("label"), F.lit(at).cast("bigint").alias("id")))
            else:
                rows = rows.filter(F.col("id") > at)
        got = self._far_ids(rows.orderBy(*self._order()).limit(size + 1))
        return got[:size], paging.encode("e", got[size - 1][0]) if len(got) > size else None

    def edges_page(self, size: int) -> Page:
        rows, cursor = self._page(size)
        return Page(self._graph.load("edge", [e for e, _ in rows]), cursor)

    def nodes_page(self, size: int) -> Page:
        """The cursor is that of the last edge."""
        rows, cursor = self._page(size)
        return Page(self._graph.load("node", [n for _, n in rows]), cursor)

    def _chain(self, keep_filters: bool = False) -> MultiHop:
        """Without ``keep_filters`` the hop's property filters and cursor are dropped."""
        starts = [self._id]
        if keep_filters and self._filters:
            far = self._rows().select(F.col(_FAR[self._hop.direction]).alias("id")).distinct()
            return MultiHop(self._graph, far, (), self._limit)
        return MultiHop(self._graph, starts, (self._hop,), self._limit)

    def then_outgoing(self, label: str, keep_filters: bool = False) -> MultiHop:
        return self._chain(keep_filters).then_outgoing(label)

    def then_incoming(self, label: str, keep_filters: bool = False) -> MultiHop:
        return self._chain(keep_filters).then_incoming(label)

    def then_outgoing_any(self, keep_filters: bool = False) -> MultiHop:
        return self._chain(keep_filters).then_outgoing_any()

    def then_incoming_any(self, keep_filters: bool = False) -> MultiHop:
        return self._chain(keep_filters).then_incoming_any()


class MultiHop:
    """A chain of hops; results are distinct nodes in id order."""

    def __init__(self, graph: PropertyGraph, starts: Sequence[int] | DataFrame, hops: tuple[Hop, ...], limit: int | None = None):
        self._graph, self._starts, self._hops, self._limit = graph, starts, hops, limit

    def _then(self, direction: str, label: str | None) -> MultiHop:
        return MultiHop(self._graph, self._starts, (*self._hops, Hop(direction, label)), self._limit)

    def then_outgoing(self, label: str) -> MultiHop:
        return self._then(OUT, label)

    def then_incoming(self, label: str) -> MultiHop:
        return self._then(IN, label)

    def then_outgoing_any(self) -> MultiHop:
        return self._then(OUT, None)

    def then_incoming_any(self) -> MultiHop:
        return self._then(IN, None)

    def limit(self, n: int) -> MultiHop:
        return MultiHop(self._graph, self._starts, self._hops, n)

    def frontier(self) -> DataFrame:
        """The distinct ids that the chain reaches, without order."""
        starts, hops = self._starts, self._hops
        if isinstance(starts, DataFrame):
            at = starts
        elif hops:
            first = hops[0]
            at = self._graph.adjacency(first.label).filter(F.col(_NEAR[first.direction]).isin(list(starts))).select(F.col(_FAR[first.direction]).alias("id")).distinct()
            hops = hops[1:]
        else:
            at = self._graph.spark.range(0).select("id").unionByName(self._graph.spark.createDataFrame([(i,) for i in starts], "id bigint")).distinct()
        for hop in hops:
            edges, near = self._graph.adjacency(hop.label), _NEAR[hop.direction]
            at = edges.join(at, F.col(near) == F.col("id"), "left_semi").select(F.col(_FAR[hop.direction]).alias("id")).distinct()
        return at

    def to_df(self) -> DataFrame:
        out = self.frontier().orderBy("id")
        return out if self._limit is None else out.limit(self._limit)

    def nodes_df(self) -> DataFrame:
        """(id, label) of the nodes reached."""
        last = self._graph.view("edge", self._hops[-1].label) if self._hops and self._hops[-1].label is not None else None
        label = last.ends[1 if self._hops[-1].direction == OUT else 0] if last else None
        return self._graph.bare("node", label).join(self.to_df(), "id", "left_semi").orderBy("id")

    def ids(self) -> list[int]:
        return [r.id for r in self.to_df().collect()]

    def nodes(self) -> list[Any]:
        return self._graph.load("node", self.ids())

    def count(self) -> int:
        """All nodes reached, whatever the limit."""
        return self.frontier().count()

    def first_node(self) -> Any | None:
        found = self.limit(1).nodes()
        return found[0] if found else None
