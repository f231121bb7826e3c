"""Label views: where the nodes and edges of a label are, and how their properties are read.

A typed view has a column for each property (null: missing), so filters and projections reach the file scan. A bag view
has one ``props`` map of tagged values, for properties of several kinds and for the mutable store.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import BAG, FIELDS, VALUE, conform, kind_of_type
from ..plans.predicates import Filter, tagged, typed

NODE_KEYS, EDGE_KEYS = ("id",), ("id", "src", "dst")


@dataclass(frozen=True)
class View:
    """The rows of one label. ``ends``: the labels of an edge view's sources and targets, if each is one."""

    label: str
    df: DataFrame
    kinds: dict[str, int] | None = None
    ends: tuple[str | None, str | None] = (None, None)
    keys: tuple[str, ...] = field(default=NODE_KEYS)

    def condition(self, f: Filter) -> Column:
        if self.kinds is None:
            return tagged(f, F.col("props").getItem(f.prop))
        return typed(f, F.col(f.prop), self.kinds[f.prop]) if f.prop in self.kinds else F.lit(False)

    def vector(self, prop: str) -> Column:
        if self.kinds is None:
            return F.col("props").getItem(prop).getField("v")
        return F.col(prop) if self.kinds.get(prop) == 5 else F.lit(None).cast("array<float>")

    def renamed(self, names: dict[str, str]) -> View:
        """The view with properties of other names."""
        return replace(self, df=self.df.withColumnsRenamed(names), kinds={names.get(p, p): k for p, k in (self.kinds or {}).items()})

    def bare(self) -> DataFrame:
        return self.df.select(*self.keys, F.lit(self.label).alias("label"))

    def records(self) -> DataFrame:
        """Keys, label and the properties as a bag."""
        if self.kinds is None:
            return self.df.select(*self.keys, F.lit(self.label).alias("label"), "props")
        entries = []
        for p, kind in self.kinds.items():
            fields = [(F.col(p) if k == kind else F.lit(None)).cast(t).alias(n) for k, (n, t) in FIELDS.items()]
            entries += [F.lit(p), F.when(F.col(p).isNotNull(), F.struct(F.lit(kind).cast("tinyint").alias("k"), *fields)).cast(VALUE)]
        bag = F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull()) if entries else F.lit(None)
        props = bag.cast(BAG) if entries else F.create_map().cast(BAG)
        return self.df.select(*self.keys, F.lit(self.label).alias("label"), props.alias("props"))


class Deferred(Mapping):
    """Views by label, each built when first asked for."""

    def __init__(self, makers: Mapping[str, Callable[[], View]]):
        self._makers, self._built = dict(makers), {}

    def __getitem__(self, label: str) -> View:
        if label not in self._built:
            self._built[label] = self._makers[label]()
        return self._built[label]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def typed_view(label: str, df: DataFrame, keys: tuple[str, ...], ends: tuple[str | None, str | None] = (None, None)) -> View:
    """A view of a table that has the key columns; all others become properties."""
    props = [f for f in df.schema.fields if f.name not in keys]
    df = df.select(*(F.col(k).cast("bigint").alias(k) for k in keys), *(conform(F.col(f.name), f.dataType).alias(f.name) for f in props))
    return View(label, df, {f.name: kind_of_type(df.schema[f.name].dataType) for f in props}, ends, keys)
