"""Every registered graph query against its SQL, and the plans of the important ones."""

import duckdb
import pytest

import __spark_entry__
from graphvec import queries as graph_queries
from graphvec.sources.testdata import graph

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(graph_queries.queries()))
def test_query_equals_sql(spark, sf_dir, sql, name):
    got = graph_queries.queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    wanted = sql.sql(graph_queries.oracle_sql()[name])
    assert sorted(wanted.columns) == columns
    a = sorted(repr(tuple(r)) for r in got.select(*columns).collect())
    b = sorted(repr(r) for r in wanted.select(*(f'"{c}"' for c in columns)).fetchall())
    assert a == b


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    q = graph(spark, sf_dir).nodes().label("Customer").eq("c_mktsegment", "BUILDING").gt("c_acctbal", 5000.0)
    text = plan(q.to_df().select("id"))
    assert "EqualTo(c_mktsegment,BUILDING)" in text and "GreaterThan(c_acc" in text and "c_name" not in text


def test_hops_are_semi_joins_and_limits_top_k(spark, sf_dir):
    chain = graph(spark, sf_dir).node(3000000001).outgoing("PLACED").then_outgoing("CONTAINS").limit(5).to_df()
    assert "LeftSemi" in plan(chain) and "TakeOrderedAndProject" in plan(chain)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_batch_search_asks_every_twentieth_vector(spark, tmp_path):
    import numpy as np

    # over one block of queries, and many equal vectors
    vectors = np.random.default_rng(1).normal(size=(21_000, 4)).round(1).astype("float32")
    vectors[::3] = vectors[0]
    spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors.tolist())], "vec_id bigint, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = graph_queries.queries()["knn_batch_all"](spark, str(tmp_path)).toPandas()
    assert len(got) == 1050 * 5 and set(got.query_id) == set(range(0, 21_000, 20))
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1)[:, None]
    found = unit[got.id - 9000000001]
    for q, own in got.assign(s=(found * unit[got.query_id]).sum(axis=1)).groupby("query_id"):
        best = np.sort(unit @ unit[q])[::-1][:5]
        assert np.allclose(own.sort_values("rank").s, best, atol=1e-9)


def test_all_indexes_are_listed(spark, sf_dir):
    catalog = graph(spark, sf_dir).catalog
    got = {tuple(r) for r in graph_queries.queries()["stats_indexes_all"](spark, sf_dir).collect()}
    assert got == {(kind, *x) for kind in ("node", "edge") for x in catalog.props(kind)}
    assert {"Customer", "Document", "Event", "Order", "Supplier", "CONTAINS", "PLACED"} <= {label for _, label, _ in got}


def test_all_pages_take_the_same_few_jobs_and_one_table(spark, tmp_path):
    """Of 30 and of 300 pages, in a folder that has no other table; ids in no order, some customers without a balance."""
    jobs, tracker = [], spark.sparkContext.statusTracker()
    for n in (6_000, 60_000):
        balance = "CASE WHEN id % 7 = 0 THEN NULL WHEN id % 7 = 1 THEN -1.0D ELSE 1.0D END AS c_acctbal"
        spark.range(n).selectExpr("id * 7919 % 60013 AS c_custkey", "'x' AS c_name", balance, "'y' AS c_mktsegment", "0L AS c_nationkey").repartition(3).write.parquet(f"{tmp_path}/{n}/customer.parquet")
        spark.sparkContext.setJobGroup(f"pages{n}", "")
        got = graph_queries.queries()["pages_by_cursor"](spark, f"{tmp_path}/{n}").collect()
        jobs.append(len(tracker.getJobIdsForGroup(f"pages{n}")))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        ids = sorted(3_000_000_001 + k * 7919 % 60013 for k in range(n) if k % 7 > 1)
        assert sorted((r.pos, r.id, r.label) for r in got) == [(p, i, "Customer") for p, i in enumerate(ids)]
    assert jobs[0] <= 20 and jobs[1] <= 20


def test_a_page_reads_only_its_label(spark, tmp_path):
    spark.createDataFrame([(k, "x", float(k), "y", 0) for k in range(9)], "c_custkey long, c_name string, c_acctbal double, c_mktsegment string, c_nationkey long").write.parquet(f"{tmp_path}/customer.parquet")
    page = graph(spark, str(tmp_path)).nodes().label("Customer").gt("c_acctbal", 0.0).page(3)
    assert [(n.id - 3_000_000_001, n.properties["c_acctbal"]) for n in page.items] == [(1, 1.0), (2, 2.0), (3, 3.0)] and page.next_cursor == "n:3000000004"
