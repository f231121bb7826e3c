"""Type-strict property filters compiled to columns.

On a typed column, a literal of another kind decides the filter when the plan is built: such a comparison matches nothing, and "not
equal" matches every present value. Rows with a missing property, NaN or a vector never match. Spark's implicit casts are never
used, so the remaining conjuncts reach the file scan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.values import FIELDS, FLOAT, VECTOR, canonical, indexable, kind_of, literal

EQ, NE, GT, GTE, LT, LTE, IN = "eq", "ne", "gt", "gte", "lt", "lte", "in"


@dataclass(frozen=True)
class Filter:
    op: str
    prop: str
    value: Any


def make(op: str, prop: str, value: Any) -> Filter:
    if op == IN:
        return Filter(op, prop, tuple(canonical(x) if not isinstance(x, tuple) else x for x in value))
    return Filter(op, prop, canonical(value))


def _compare(op: str, column: Column, value: Any) -> Column:
    if kind_of(value) == FLOAT and value == 0 and math.copysign(1, value) < 0:
        # bounds order -0.0 below 0.0, and stored zeros are 0.0
        op = {GT: GTE, LTE: LT}.get(op, op)
        value = 0.0
    x = literal(value)
    return {EQ: column == x, GT: column > x, GTE: column >= x, LT: column < x, LTE: column <= x}[op]


def _kind_matches(f: Filter, column: Column, kind: int, present: Column) -> Column:
    """The filter on values of one kind. ``present`` holds where the column has an indexable value of that kind."""
    if f.op == IN:
        same = [x for x in f.value if indexable(x) and kind_of(x) == kind]
        return column.isin(*same) & present if same and kind != 3 else reduce(lambda a, b: a | b, (column == literal(x) for x in same)) & present if same else F.lit(False)
    fits = indexable(f.value) and kind_of(f.value) == kind
    if f.op == NE:
        return present & (column != literal(f.value)) if fits else present
    return present & _compare(f.op, column, f.value) if fits else F.lit(False)


def typed(f: Filter, column: Column, kind: int) -> Column:
    """The filter on a column of one kind (null: missing)."""
    if kind == VECTOR:
        return F.lit(False)
    present = column.isNotNull()
    if kind == FLOAT:
        present = present & ~F.isnan(column)
    return _kind_matches(f, column, kind, present)


def tagged(f: Filter, value: Column) -> Column:
    """The filter on a bag's value: each row is judged by its own kind."""
    k = value.getField("k")
    present = value.isNotNull() & (k < VECTOR) & ~((k == FLOAT) & F.coalesce(F.isnan(value.getField("f")), F.lit(False)))
    if f.op == NE:
        if not indexable(f.value):
            return present
        kind = kind_of(f.value)
        return present & ~((k == kind) & value.getField(FIELDS[kind][0]).eqNullSafe(literal(f.value)))
    values = f.value if f.op == IN else (f.value,)
    kinds = sorted({kind_of(x) for x in values if indexable(x)})
    parts = [(k == kind) & _kind_matches(f, value.getField(FIELDS[kind][0]), kind, present) for kind in kinds]
    return F.coalesce(reduce(lambda a, b: a | b, parts), F.lit(False)) if parts else F.lit(False)


def conjunction(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns) if columns else F.lit(True)
