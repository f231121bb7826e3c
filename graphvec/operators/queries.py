"""Lazy node and edge queries.

A builder only notes what is asked for; ``to_df`` gives one DataFrame plan and the terminals run it. Results are in ascending id
order unless a vector search ranks them.
"""

from __future__ import annotations

import copy
from collections.abc import Iterable, Sequence
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import InvalidConfig, InvalidCursor, InvalidVectorDim, StorageError
from ..functions.similarity import as_query, ascending, score
from ..plans import paging
from ..plans.paging import Page
from ..plans.predicates import Filter, conjunction, make
from ..sources.scratch import numbered

if TYPE_CHECKING:
    from ..sources.views import View
    from .graph import PropertyGraph

#: Candidates that a filtered vector search looks at, for each result asked for.
OVERFETCH = 10


class Filtered:
    """Builder methods that all filterable queries share."""

    _graph: PropertyGraph
    _filters: list[Filter]

    def _with(self, **changes: Any):
        out = copy.copy(self)
        out._filters = list(self._filters)
        for k, v in changes.items():
            setattr(out, k, v)
        return out

    def _filter(self, op: str, prop: str, value: Any):
        return self._with(_filters=[*self._filters, make(op, prop, value)])

    def eq(self, prop: str, value: Any):
        return self._filter("eq", prop, value)

    def ne(self, prop: str, value: Any):
        return self._filter("ne", prop, value)

    def gt(self, prop: str, value: Any):
        return self._filter("gt", prop, value)

    def gte(self, prop: str, value: Any):
        return self._filter("gte", prop, value)

    def lt(self, prop: str, value: Any):
        return self._filter("lt", prop, value)

    def lte(self, prop: str, value: Any):
        return self._filter("lte", prop, value)

    def in_(self, prop: str, values: Iterable[Any]):
        return self._filter("in", prop, list(values))

    def limit(self, n: int):
        return self._with(_limit=n)

    def after(self, cursor: str):
        return self._with(_after=cursor)

    def _matching(self, view: View, kind: str) -> DataFrame:
        for f in self._filters:
            self._graph.catalog.require(kind, view.label, f.prop)
        return view.df.filter(conjunction([view.condition(f) for f in self._filters])) if self._filters else view.df


class ItemQuery(Filtered):
    """Nodes or edges of the graph."""

    _kind = "node"
    _cursor = "n"

    def __init__(self, graph: PropertyGraph):
        self._graph = graph
        self._label: str | None = None
        self._filters = []
        self._limit: int | None = None
        self._after: str | None = None

    def label(self, label: str):
        return self._with(_label=label)

    def _view(self) -> View | None:
        return self._graph.view(self._kind, self._label)

    def _check_filters(self) -> None:
        for f in self._filters:
            self._graph.catalog.require(self._kind, self._label, f.prop)

    def _all(self) -> DataFrame:
        """Everything that matches, without order or limit."""
        self._check_filters()
        if self._label is None:
            return self._graph.bare(self._kind)
        view = self._view()
        return self._graph.bare(self._kind).limit(0) if view is None else self._matching(view, self._kind)

    def to_df(self) -> DataFrame:
        """The matching rows (a label's columns; without a label keys and label) in order, up to the limit."""
        out = self._all().orderBy("id")
        return out if self._limit is None else out.limit(self._limit)

    def _ordered_ids(self, rows: DataFrame) -> list[int]:
        return [r.id for r in rows.select("id").collect()]

    def ids(self) -> list[int]:
        paging.no_cursor(self._after)
        return self._ordered_ids(self.to_df())

    def collect(self) -> list[Any]:
        paging.no_cursor(self._after)
        return self._graph.load(self._kind, self._ordered_ids(self.to_df()), self._label)

    def count(self) -> int:
        """All matches, whatever the limit."""
        paging.no_cursor(self._after)
        return self._all().count()

    def first(self) -> Any | None:
        found = self.limit(1).collect()
        return found[0] if found else None

    def _rest(self) -> DataFrame:
        """What matches after the cursor."""
        rows = self._all()
        if self._after is None:
            return rows
        at = paging.decode(self._cursor, self._after)
        if at >= 1 << 63 or rows.filter(F.col("id") == at).isEmpty():
            raise InvalidCursor("cursor not found in result set")
        return rows.filter(F.col("id") > at)

    def page_df(self, size: int) -> DataFrame:
        """One row more than the page, to tell whether another follows."""
        return self._rest().orderBy("id").limit(size + 1)

    def pages_df(self, size: int) -> DataFrame:
        """All pages from here on as one table: id, label, pos (from 0), page (from 0), and the page's cursor and next_cursor.

        These are the pages that ``page(size)`` gives when each is asked for ``after`` the cursor of the one before, but cut from
        one distributed order: neither the jobs nor the driver's memory grow with their number."""
        paging.check(self._limit, size)
        rows, by = self._rest(), F.col("id").asc_nulls_last()
        rows = rows.select("id", "label" if self._label is None else F.lit(self._label).alias("label"))
        rows = numbered(rows.repartitionByRange(by).sortWithinPartitions(by), "pos").withColumn("page", F.expr(f"pos div {size}"))
        ends = rows.filter((F.col("pos") + 1) % size == 0).select("page", F.concat(F.lit(f"{self._cursor}:"), "id").alias("next_cursor"))
        begins = ends.select((F.col("page") + 1).alias("page"), F.col("next_cursor").alias("cursor"))
        more = F.col("page") < (rows.count() - 1) // size
        out = rows.join(begins, "page", "left").join(ends.filter(more), "page", "left")
        if self._after is not None:
            out = out.withColumn("cursor", F.when(F.col("page") == 0, F.lit(self._after)).otherwise(F.col("cursor")))
        return out.select("id", "label", "pos", "page", "cursor", "next_cursor")

    def page(self, size: int) -> Page:
        paging.check(self._limit, size)
        ids = self._ordered_ids(self.page_df(size))
        items = self._graph.load(self._kind, ids[:size], self._label)
        return Page(items, paging.encode(self._cursor, ids[size - 1]) if len(ids) > size else None)


class EdgeQuery(ItemQuery):
    _kind, _cursor = "edge", "e"


class NodeQuery(ItemQuery):
    def __init__(self, graph: PropertyGraph):
        super().__init__(graph)
        self._nearest: tuple[str, Sequence[float], int] | None = None
        self._prefilter = False

    def nearest(self, prop: str, query: Sequence[float], k: int, prefilter: bool = False):
        """The k nodes most similar to ``query``. Filters apply to the best candidates only (ten for each result asked for, at
        most ef_search), unless ``prefilter`` has them applied to all nodes first."""
        return self._with(_nearest=(prop, [float(x) for x in query], k), _prefilter=prefilter)

    def ranked(self) -> DataFrame:
        """The hits with score and rank (from 1), best first."""
        prop, query, k = self._nearest
        if self._label is None:
            raise StorageError("vector search requires a label")
        dim, config = self._graph.catalog.vector(self._label, prop)
        if len(query) != dim:
            raise InvalidVectorDim(f"expected {dim} dimensions, got {len(query)}")
        self._check_filters()
        view = self._view()
        if view is None:
            return self._graph.bare("node").limit(0).select("id", F.lit(0.0).cast("float").alias("score"), F.lit(1).alias("rank"))
        vector = view.vector(prop)
        condition = conjunction([view.condition(f) for f in self._filters])
        early = self._filters and self._prefilter
        rows = view.df.filter(vector.isNotNull() & (F.size(vector) == dim))
        rows = rows.filter(condition) if early else rows
        late = self._filters and not self._prefilter
        order = F.col("score").asc() if ascending(config.similarity) else F.col("score").desc()
        number = F.nanvl(score(vector, as_query(query), config.similarity), F.lit(float("inf") if ascending(config.similarity) else float("-inf")).cast("float"))
        rows = rows.select("id", number.alias("score"), *([condition.alias("_kept")] if late else []))
        rows = rows.orderBy(order, "id").limit(min(OVERFETCH * k if late else k, config.ef_search))
        if late:
            rows = rows.filter("_kept").drop("_kept")
        n = k if self._limit is None else min(k, self._limit)
        rank = F.row_number().over(W.orderBy(order, "id"))
        return rows.orderBy(order, "id").limit(n).withColumn("rank", rank)

    def to_df(self) -> DataFrame:
        return self.ranked().orderBy("rank") if self._nearest else super().to_df()

    def count(self) -> int:
        if self._nearest:
            paging.no_cursor(self._after)
            return self._with(_limit=None).ranked().count()
        return super().count()

    def pages_df(self, size: int) -> DataFrame:
        if self._nearest:
            raise InvalidConfig("pages_df() doesn't rank; page() gives the hits of a vector search")
        return super().pages_df(size)

    def page(self, size: int) -> Page:
        if not self._nearest:
            return super().page(size)
        paging.check(self._limit, size)
        ids = self._ordered_ids(self.ranked().orderBy("rank"))
        begin = 0
        if self._after is not None:
            at = paging.decode(self._cursor, self._after)
            if at not in ids:
                raise InvalidCursor("cursor not found in result set")
            begin = ids.index(at) + 1
        items = ids[begin : begin + size]
        return Page(self._graph.load("node", items, self._label), paging.encode("n", items[-1]) if len(ids) > begin + size else None)
