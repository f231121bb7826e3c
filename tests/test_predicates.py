"""Filters on typed columns and on tagged bags agree with a plain model of the rules."""

import math

import pytest
from pyspark.sql import functions as F

from graphvec.functions.values import BAG, bag_value, index_key, indexable, kind_of
from graphvec.plans.predicates import make, tagged, typed

VALUES = [1, 1.0, 0, 0.0, -0.0, -3, 2.5, float("nan"), float("inf"), "1", "a", "B", "", True, False, b"\x01", b"\xff", [1.0, 0.0]]


def model(op, stored, x):
    """Whether a present value matches."""
    if not indexable(stored):
        return False
    key = index_key(stored)
    if op == "in":
        return any(indexable(v) and index_key(v) == key for v in x)
    if op == "ne":
        return not indexable(x) or index_key(x) != key
    if not indexable(x) or kind_of(x) != key[0]:
        return False
    if op == "eq":
        return index_key(x) == key
    a, b = key[1], x
    if isinstance(b, float) and b == 0 and math.copysign(1, b) < 0:  # -0.0 as a bound stands below 0.0
        return {"gt": a >= 0, "gte": a >= 0, "lt": a < 0, "lte": a < 0}[op]
    return {"gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b}[op]


CASES = [(op, x) for op in ("eq", "ne", "gt", "gte", "lt", "lte") for x in VALUES] + [("in", [1, "a", 2.5]), ("in", []), ("in", [float("nan")]), ("in", [b"\x01", True, -0.0])]


def test_tagged_filters_match_the_model(spark):
    rows = [(i, {"p": bag_value(v)}) for i, v in enumerate(VALUES)] + [(len(VALUES), {})]
    df = spark.createDataFrame(rows, f"id int, props {BAG}").cache()
    columns = [tagged(make(op, "p", x), F.col("props").getItem("p")).alias(f"c{k}") for k, (op, x) in enumerate(CASES)]
    got = df.select("id", *columns).collect()
    for r in got:
        for k, (op, x) in enumerate(CASES):
            wanted = r.id < len(VALUES) and model(op, VALUES[r.id], x)
            assert bool(r[f"c{k}"]) == wanted, (op, x, VALUES[r.id] if r.id < len(VALUES) else "absent")


@pytest.mark.parametrize("kind,sql", [(0, "string"), (1, "bigint"), (2, "boolean"), (3, "binary"), (4, "double")])
def test_typed_filters_match_the_model(spark, kind, sql):
    own = [v for v in VALUES if kind_of(v) == kind]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*own, None])], f"id int, p {sql}")
    columns = [typed(make(op, "p", x), F.col("p"), kind).alias(f"c{k}") for k, (op, x) in enumerate(CASES)]
    for r in df.select("id", *columns).collect():
        for k, (op, x) in enumerate(CASES):
            wanted = r.id < len(own) and model(op, own[r.id], x)
            assert bool(r[f"c{k}"]) == wanted, (op, x, own[r.id] if r.id < len(own) else "absent")


def test_integers_beyond_64_bits_are_rejected():
    with pytest.raises(ValueError):
        make("eq", "p", 1 << 63)
