"""The star-schema test tables as a property graph.

Ids are ordinal * 1e9 + key + 1, so that labels have ranges of their own and no id is 0. The edges from ``lineitem`` have no
key: they are numbered by all columns, and only if ``edge_ids`` asks for it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import PropertyGraph
from ..plans.catalog import Catalog
from .scratch import in_order
from .views import EDGE_KEYS, NODE_KEYS, Deferred, View, typed_view

LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
NODE_LABELS = {"Region": 1, "Nation": 2, "Customer": 3, "Supplier": 4, "Part": 5, "Order": 6, "User": 7, "Event": 8, "Chunk": 9, "Document": 10}
EDGE_LABELS = {"IN_REGION": 1, "CUSTOMER_IN": 2, "SUPPLIER_IN": 3, "PLACED": 4, "CONTAINS": 5, "SHIPPED_BY": 6, "EMITTED": 7}


def node_id(label: str, key: str | Column) -> Column:
    return F.lit(NODE_LABELS[label] * 1_000_000_000 + 1) + (F.col(key) if isinstance(key, str) else key).cast("bigint")


def graph(spark: SparkSession, sf_dir: str, edge_ids: bool = False) -> PropertyGraph:
    """The whole graph; a table is opened when a query first needs it."""

    @cache
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    @cache
    def lines() -> DataFrame:
        return in_order(read("lineitem"), LINE_ORDER, "_at") if edge_ids else read("lineitem").withColumn("_at", F.lit(None).cast("bigint"))

    def documents() -> DataFrame:
        marks = read("labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("toxic").alias("toxic"))
        return read("documents").join(marks, "doc_id", "left")

    catalog, nodes, edges = Catalog(), {}, {}

    def add_nodes(name: str, df: Callable[[], DataFrame], key: str, props: str = "", **names: str) -> None:
        nodes[name] = lambda: typed_view(name, df().select(node_id(name, key).alias("id"), *props.split()), NODE_KEYS).renamed(names)
        catalog.node_props.update((name, names.get(p, p)) for p in props.split() if p != "embedding")

    def add_edges(label: str, df: Callable[[], DataFrame], number: str, src: tuple[str, str], dst: tuple[str, str], props: str = "") -> None:
        def make() -> View:
            ident = F.lit(EDGE_LABELS[label] * 1_000_000_000 + 1) + F.col(number).cast("bigint")
            return typed_view(label, df().select(ident.alias("id"), node_id(*src).alias("src"), node_id(*dst).alias("dst"), *props.split()), EDGE_KEYS, (src[0], dst[0]))

        edges[label] = make
        catalog.edge_props.update((label, p) for p in props.split())

    add_nodes("Region", lambda: read("region"), "r_regionkey", "r_name")
    add_nodes("Nation", lambda: read("nation"), "n_nationkey", "n_name")
    add_nodes("Customer", lambda: read("customer"), "c_custkey", "c_name c_acctbal c_mktsegment")
    add_nodes("Supplier", lambda: read("supplier"), "s_suppkey", "s_name s_acctbal")
    add_nodes("Part", lambda: read("part"), "p_partkey", "p_name p_brand p_type p_size p_retailprice")
    add_nodes("Order", lambda: read("orders"), "o_orderkey", "o_orderstatus o_totalprice o_orderdate o_orderpriority")
    add_nodes("User", lambda: read("events").select("user_id").distinct(), "user_id")
    add_nodes("Event", lambda: read("events"), "event_id", "ts event_type value")
    add_nodes("Chunk", lambda: read("embeddings"), "vec_id", "embedding label", label="cluster")
    add_nodes("Document", documents, "doc_id", "lang source n_chars quality toxic")
    add_edges("IN_REGION", lambda: read("nation"), "n_nationkey", ("Nation", "n_nationkey"), ("Region", "n_regionkey"))
    add_edges("CUSTOMER_IN", lambda: read("customer"), "c_custkey", ("Customer", "c_custkey"), ("Nation", "c_nationkey"))
    add_edges("SUPPLIER_IN", lambda: read("supplier"), "s_suppkey", ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"))
    add_edges("PLACED", lambda: read("orders"), "o_orderkey", ("Customer", "o_custkey"), ("Order", "o_orderkey"), "o_orderpriority o_totalprice")
    add_edges("CONTAINS", lines, "_at", ("Order", "l_orderkey"), ("Part", "l_partkey"), "l_quantity l_extendedprice l_discount l_returnflag l_linestatus l_shipdate")
    add_edges("SHIPPED_BY", lines, "_at", ("Order", "l_orderkey"), ("Supplier", "l_suppkey"), "l_quantity l_returnflag")
    add_edges("EMITTED", lambda: read("events"), "event_id", ("User", "user_id"), ("Event", "event_id"), "event_type value")
    return PropertyGraph.from_views(spark, Deferred(nodes), Deferred(edges), catalog)
