"""Behaviour of queries, traversals, vector search, indexes and transactions on small graphs."""

import pytest

from graphvec import DOT, EUCLIDEAN, GraphStore, ParquetStorage, VectorConfig
from graphvec.errors import (
    CodecError, DuplicateKey, EdgeNotFound, IndexNotFound, InvalidConfig, InvalidCursor, InvalidVectorDim, LabelNotFound, NodeNotFound, StorageError, TransactionConflict, VectorIndexNotFound,
)


def build(spark, nodes, edges=(), props=(), edge_props=()):
    """nodes: (label, props); edges: (src, dst, label, props) by position from 1."""
    store = GraphStore(spark)

    def fill(tx):
        for label, p in nodes:
            tx.add_node(label, p)
        for e in edges:
            tx.add_edge(*e)

    store.batch(fill)
    for label, p in props:
        store.indexes().nodes().create_property(label, p)
    for label, p in edge_props:
        store.indexes().edges().create_property(label, p)
    return store


@pytest.fixture(scope="module")
def people(spark):
    nodes = [("User", {"name": n, "age": a}) for n, a in (("Alice", 30), ("Bob", 25), ("Alice", 35), ("Cara", -10), ("Dan", 40))] + [("Post", {"name": "Alice"}), ("", {})]
    edges = [(1, 2, "knows", {"since": 2020, "weight": 0.5}), (1, 3, "knows", {"since": 2024, "weight": 1.5}), (1, 3, "knows", {"weight": 2.5}), (2, 4, "knows", {}), (3, 4, "knows", {}), (5, 4, "follows", {}), (5, 5, "self", {})]
    return build(spark, nodes, edges, [("User", "name"), ("User", "age"), ("Post", "name")], [("knows", "since"), ("knows", "weight")])


def test_scans_and_filters(people):
    q = people.nodes()
    assert q.ids() == [1, 2, 3, 4, 5, 6, 7]
    assert q.label("User").ids() == [1, 2, 3, 4, 5]
    assert q.label("nobody").ids() == []
    assert q.label("").ids() == [7]
    users = q.label("User")
    assert users.eq("name", "Alice").ids() == [1, 3]
    assert q.label("Post").eq("name", "Alice").ids() == [6]
    assert users.gt("age", 25).lt("age", 40).ids() == [1, 3]
    assert users.ne("name", "Alice").count() == 3
    assert users.in_("name", ["Alice", "Cara"]).ids() == [1, 3, 4]
    assert users.eq("age", 30.0).ids() == [] and users.ne("age", 30.0).count() == 5
    assert users.gte("age", 30).limit(1).count() == 3
    assert users.limit(0).ids() == []
    assert users.first().properties == {"age": 30, "name": "Alice"}
    assert q.label("nobody").first() is None


def test_filter_guards(people):
    with pytest.raises(IndexNotFound):
        people.nodes().eq("name", "x").ids()
    with pytest.raises(IndexNotFound):
        people.nodes().label("User").eq("city", "x").ids()
    with pytest.raises(IndexNotFound):
        people.edges().label("follows").eq("since", 1).count()
    with pytest.raises(IndexNotFound):
        people.node(1).outgoing_any().eq("since", 1).edges()


def test_edges(people):
    q = people.edges()
    assert q.ids() == list(range(1, 8))
    assert q.label("knows").eq("since", 2024).collect()[0].dst == 3
    assert q.label("knows").gt("weight", 1.0).ids() == [2, 3]
    assert q.label("knows").ne("since", 2024).ids() == [1]


def test_one_hop(people):
    node = people.node
    assert [e.id for e in node(1).outgoing("knows").edges()] == [1, 2, 3]
    assert [n.id for n in node(1).outgoing("knows").nodes()] == [2, 3, 3]
    assert [e.id for e in node(4).incoming("knows").edges()] == [4, 5]
    assert node(5).outgoing("self").count() == node(5).incoming("self").count() == 1
    assert node(99).outgoing("knows").edges() == [] and node(99).outgoing_any().nodes() == []
    assert node(1).outgoing("knows").limit(1).count() == 3
    assert node(1).outgoing("knows").limit(0).edges() == []
    assert [n.id for n in node(1).outgoing("knows").eq("since", 2024).nodes()] == [3]
    assert node(1).outgoing("knows").first_node().id == 2 and node(1).outgoing("knows").first_edge().id == 1


def test_any_order_is_by_label_length_then_bytes(spark):
    labels = ["b", "aa", "é", "zzz", ""]
    store = build(spark, [("A", {}), ("B", {})], [(1, 2, label, {}) for label in labels])
    found = [e.label for e in store.node(1).outgoing_any().edges()]
    assert found == ["", "b", "aa", "é", "zzz"]
    page = store.node(1).outgoing_any().edges_page(2)
    rest = store.node(1).outgoing_any().after(page.next_cursor).edges_page(9)
    assert [e.label for e in page.items + rest.items] == found and rest.next_cursor is None


def test_chains(people):
    node = people.node
    assert node(1).outgoing("knows").then_outgoing("knows").ids() == [4]
    assert node(1).then_outgoing("knows").then_outgoing("knows").count() == 1
    assert node(1).then_outgoing("knows").ids() == [2, 3]
    assert node(5).outgoing("follows").then_incoming("knows").ids() == [2, 3]
    assert node(1).outgoing("knows").eq("since", 2020).then_outgoing("knows").ids() == [4]
    assert node(1).outgoing("knows").eq("since", 1999).then_outgoing("knows").ids() == [4]  # filters are dropped
    assert node(1).outgoing("knows").eq("since", 1999).then_outgoing("knows", keep_filters=True).ids() == []
    assert node(5).outgoing_any().then_outgoing_any().ids() == [4, 5]
    assert node(1).outgoing("knows").then_outgoing("knows").then_outgoing("knows").ids() == []
    assert [n.label for n in node(1).then_outgoing("knows").limit(1).nodes()] == ["User"]
    assert node(2).then_incoming("knows").then_outgoing_any().first_node().id == 2


def test_pages(people):
    q = people.nodes().label("User")
    first = q.page(2)
    second = q.after(first.next_cursor).page(2)
    third = q.after(second.next_cursor).page(2)
    assert [[n.id for n in p.items] for p in (first, second, third)] == [[1, 2], [3, 4], [5]] and third.next_cursor is None
    for cursor in ("n:999999", "e:1", "n:x", "n:-1", f"n:{1 << 64}"):
        with pytest.raises(InvalidCursor):
            q.after(cursor).page(2)
    for bad in (lambda: q.limit(1).page(1), lambda: q.page(0), lambda: q.after("n:1").ids(), lambda: q.after("n:1").count(), lambda: people.node(1).outgoing("knows").after("e:1").edges()):
        with pytest.raises(InvalidConfig):
            bad()
    hops = people.node(1).outgoing("knows").nodes_page(2)
    assert [n.id for n in hops.items] == [2, 3] and hops.next_cursor == "e:2"
    assert [n.id for n in people.node(1).outgoing("knows").after("e:2").nodes_page(2).items] == [3]


def test_all_pages_are_those_of_the_chain_of_cursors(people):
    nodes, edges = people.nodes(), people.edges()
    for q in (nodes.label("User"), nodes.label("User").gt("age", 30), nodes, edges.label("knows"), nodes.label("User").after("n:2"), edges.after("e:3"), nodes.label("none"), nodes.label("User").after("n:5")):
        for size in (2, 5):
            wanted, ask, pos = [], q, 0
            for number in range(99):
                page = ask.page(size)
                wanted += [(x.id, x.label, pos + k, number, ask._after, page.next_cursor) for k, x in enumerate(page.items)]
                pos += len(page.items)
                if page.next_cursor is None:
                    break
                ask = q.after(page.next_cursor)
            assert [tuple(r) for r in q.pages_df(size).orderBy("pos").collect()] == wanted
    with pytest.raises(InvalidCursor):
        nodes.label("User").after("n:999999").pages_df(2)
    for bad in (lambda: nodes.limit(1).pages_df(1), lambda: nodes.pages_df(0), lambda: nodes.label("User").nearest("v", [1.0], 1).pages_df(1)):
        with pytest.raises(InvalidConfig):
            bad()


def test_point_reads(people):
    assert [n.id for n in people.get_nodes([3, 1, 3])] == [3, 1, 3]
    assert people.get_edge(6).label == "follows"
    with pytest.raises(NodeNotFound):
        people.get_nodes([1, 77])
    with pytest.raises(EdgeNotFound):
        people.get_edge(77)


def test_stats(people):
    s = people.stats()
    assert (s.node_count, s.edge_count) == (7, 7)
    assert [(x.label, x.node_count, x.edge_count) for x in s.labels] == [("", 1, 0), ("Post", 1, 0), ("User", 5, 0), ("follows", 0, 1), ("knows", 0, 5), ("self", 0, 1)]
    assert s.node_indexes == {"Post": ["name"], "User": ["age", "name"]}


def test_vector_search(spark):
    vectors = [[1, 0, 0], [0.9, 0.1, 0], [0, 2, 0], [0, 0, 1], [3, 3, 0]]
    status = ["active", "archived", "active", "active", "active"]
    store = build(spark, [("Chunk", {"embedding": [float(x) for x in v], "status": s}) for v, s in zip(vectors, status, strict=True)] + [("Chunk", {"status": "active"})], props=[("Chunk", "status")])
    q = store.nodes().label("Chunk")
    with pytest.raises(VectorIndexNotFound):
        q.nearest("embedding", [1, 0, 0], 2).ids()
    with pytest.raises(InvalidVectorDim):
        store.indexes().vectors().create("Chunk", "embedding", 2)
    store.indexes().vectors().create("Chunk", "embedding", 3)
    q = store.nodes().label("Chunk")
    assert q.nearest("embedding", [1, 0, 0], 3).ids() == [1, 2, 5]
    assert q.nearest("embedding", [1, 0, 0], 3).limit(2).ids() == [1, 2] and q.nearest("embedding", [1, 0, 0], 9).count() == 5
    assert q.eq("status", "active").nearest("embedding", [1, 0, 0], 2).ids() == [1, 5]
    with pytest.raises(InvalidVectorDim):
        q.nearest("embedding", [1, 0], 2).ids()
    with pytest.raises(StorageError):
        store.nodes().nearest("embedding", [1, 0, 0], 2).ids()
    page = q.nearest("embedding", [1, 0, 0], 5).page(2)
    assert [n.id for n in page.items] == [1, 2]
    assert [n.id for n in q.nearest("embedding", [1, 0, 0], 5).after(page.next_cursor).page(2).items] == [5, 3]
    with pytest.raises(DuplicateKey):
        store.indexes().vectors().create("Chunk", "embedding", 3)
    with pytest.raises(InvalidVectorDim):
        store.add_node("Chunk", {"embedding": [1.0]})
    for similarity, best in ((DOT, [5, 1, 2]), (EUCLIDEAN, [1, 2, 4])):
        store.indexes().vectors().drop("Chunk", "embedding")
        store.indexes().vectors().create("Chunk", "embedding", 3, VectorConfig(similarity=similarity))
        assert store.nodes().label("Chunk").nearest("embedding", [1, 0, 0], 3).ids() == best
    store.delete_node(1)
    assert store.nodes().label("Chunk").nearest("embedding", [1, 0, 0], 9).count() == 4
    store.indexes().vectors().drop("Chunk", "embedding")
    with pytest.raises(IndexNotFound):
        store.indexes().vectors().drop("Chunk", "embedding")
    with pytest.raises(CodecError):
        store.indexes().vectors().create("Chunk", "embedding", 3, VectorConfig(similarity=max))
    with pytest.raises(InvalidConfig):
        VectorConfig(m=1)


def test_candidate_cap_and_postfilter(spark):
    store = build(spark, [("C", {"v": [1.0, i / 100], "odd": i % 2 == 1, "late": i >= 55}) for i in range(60)], props=[("C", "odd"), ("C", "late")])
    store.indexes().vectors().create("C", "v", 2)
    q = store.nodes().label("C")
    assert q.nearest("v", [1, 0], 60).count() == 50
    assert q.eq("late", True).nearest("v", [1, 0], 3).count() == 0
    assert q.eq("late", True).nearest("v", [1, 0], 3, prefilter=True).ids() == [56, 57, 58]


def test_unique_and_index_commands(spark):
    store = build(spark, [("User", {"email": "a", "x": 1}), ("User", {"email": "b", "x": 1.0})])
    nodes = store.indexes().nodes()
    nodes.create_unique("User", "email")
    nodes.create_unique("User", "x")
    with pytest.raises(DuplicateKey):
        nodes.create_unique("User", "email")
    with pytest.raises(DuplicateKey):
        nodes.create_property("User", "email")
    with pytest.raises(LabelNotFound):
        nodes.create_property("Ghost", "email")
    with pytest.raises(DuplicateKey):
        store.add_node("User", {"email": "a"})
    with pytest.raises(DuplicateKey):
        store.update_node(2).set_property("email", "a").apply()
    store.update_node(2).set_property("email", "b").apply()
    assert store.add_node("Other", {"email": "a"}) == 3
    store.add_node("User", {"email": float("nan")})
    store.add_node("User", {"email": float("nan")})
    store.add_node("User", {"x": 0.0})
    with pytest.raises(DuplicateKey):
        store.add_node("User", {"x": -0.0})
    nodes.drop_property("User", "email")
    assert store.add_node("User", {"email": "a"})
    with pytest.raises(DuplicateKey):
        nodes.create_unique("User", "email")
    with pytest.raises(IndexNotFound):
        nodes.drop_property("User", "email")


def test_transactions(spark):
    store = GraphStore(spark)

    def change(tx):
        a, b = tx.add_node("User", [("name", "x"), ("name", "a")]), tx.add_node("User", {"name": "b"})
        e = tx.add_edge(a, b, "knows", {"since": 2024})
        tx.update_node(a).set_property("age", 29).set_property("age", 30).apply()
        assert tx.get_node(a).properties == {"name": "a", "age": 30}
        tx.delete_node(b)
        with pytest.raises(EdgeNotFound):
            tx.get_edge(e)
        return a

    assert store.batch(change) == 1
    assert (store.stats().node_count, store.stats().edge_count) == (1, 0)

    def broken(tx):
        tx.add_node("User")
        tx.add_edge(1, 999, "knows")

    before = store.version
    with pytest.raises(NodeNotFound):
        store.batch(broken)
    assert store.version == before and store.add_node("User") == 3
    old = store.graph
    store.add_edge(1, 3, "knows")
    store.add_edge(3, 3, "self")
    store.add_edge(3, 1, "knows")
    assert old.edges().count() == 0 and store.edges().count() == 3
    store.update_edge(2).set_to(1).set_label("knows").apply()
    assert store.get_edge(2).dst == 1
    with pytest.raises(NodeNotFound):
        store.update_edge(2).set_from(99).apply()
    store.update_node(1).replace_properties({"z": b"\x00", "v": [1.0, 2.0]}).remove_property("q").set_label("Person").apply()
    assert store.get_node(1).properties == {"v": [1.0, 2.0], "z": b"\x00"} and store.nodes().label("User").ids() == [3]
    store.update_node(1).apply()
    store.delete_node(3)
    assert store.edges().ids() == [2]
    with pytest.raises(NodeNotFound):
        store.delete_node(3)
    with pytest.raises(EdgeNotFound):
        store.delete_edge(1)
    assert store.read(lambda g: (g.get_node(1).label, g.nodes().count())) == ("Person", 1)


def test_snapshots_on_disk(spark, tmp_path):
    path = f"file://{tmp_path}/graph"
    store = GraphStore.open(spark, path)
    a = store.add_node("2024", {"i": 1, "f": 1.0, "b": True})
    other = GraphStore.open(spark, path)
    store.add_edge(a, a, "")
    store.indexes().nodes().create_property("2024", "i")
    with pytest.raises(TransactionConflict):
        other.add_node("late")
    again = GraphStore.open(spark, path)
    assert again.get_node(a).properties == {"b": True, "f": 1.0, "i": 1} and again.nodes().label("2024").eq("i", 1).ids() == [1]
    assert again.edges().label("").count() == 1
    assert ParquetStorage(path).load(spark, 1).edges.count() == 0
    assert other.refresh().add_node("late") == 2


def test_bulk_load_checks_as_well(spark):
    from graphvec.functions.values import BAG, bag_value

    store = GraphStore(spark)
    rows = [("User", {"email": bag_value(x)}) for x in "abc"]
    store.bulk_load(nodes=spark.createDataFrame(rows, f"label string, props {BAG}"))
    assert store.nodes().ids() == [1, 2, 3]
    store.indexes().nodes().create_unique("User", "email")
    with pytest.raises(DuplicateKey):
        store.bulk_load(nodes=spark.createDataFrame(rows[:1], f"label string, props {BAG}"))
    edges = f"src bigint, dst bigint, label string, props {BAG}"
    with pytest.raises(NodeNotFound):
        store.bulk_load(edges=spark.createDataFrame([(1, 9, "x", {})], edges))
    store.bulk_load(edges=spark.createDataFrame([(1, 2, "x", {}), (2, 3, "x", {})], edges))
    assert store.node(1).outgoing("x").then_outgoing("x").ids() == [3]


def test_streaming_ingest(spark, tmp_path):
    from pyspark.sql import functions as F

    from graphvec.functions.values import BAG
    from graphvec.streaming import ingest_nodes

    spark.createDataFrame([("A",), ("B",)], "label string").write.parquet(f"{tmp_path}/in")
    store = GraphStore(spark)
    stream = spark.readStream.schema("label string").parquet(f"{tmp_path}/in")
    query = ingest_nodes(store, stream, f"{tmp_path}/check", lambda b: b.withColumn("props", F.create_map().cast(BAG))).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert store.refresh().nodes().count() == 2


def test_workers_need_no_copy_of_the_package(tmp_path):
    """A driver elsewhere on the path, with workers that can't import the package."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    import graphvec

    shutil.copytree(Path(graphvec.__file__).parent, tmp_path / "only_driver" / "graphvec", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = f"""
import sys
sys.path.insert(0, {str(tmp_path / "only_driver")!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
from graphvec import NODE_KEYS, typed_view
from graphvec.operators.knn import batch_nearest
view = typed_view("V", spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id bigint, v array<float>"), NODE_KEYS)
try:
    spark.range(1).mapInArrow(lambda x: [__import__("graphvec")] and x, "id bigint").collect()
    raise SystemExit("workers have the package")
except Exception:
    pass
print("nearest", [r.id for r in batch_nearest(view, "v", [(7, [1.0, 0.1])], 1).collect()])
"""
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "nearest [1]" in run.stdout, run.stdout + run.stderr[-2000:]


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    from graphvec.functions.values import BAG
    from graphvec.sources.storage import ParquetStorage

    for storage in (None, ParquetStorage(f"{tmp_path}/graph")):
        store = GraphStore(spark, storage)
        rows = spark.createDataFrame([("A",), ("B",)], "label string").withColumn("props", F.create_map().cast(BAG))
        for number in (0, 0, 1, 0, 1):
            store.refresh().bulk_load(nodes=rows, batch=("stream", number))
        store.add_node("C")
        store.refresh().bulk_load(nodes=rows, batch=("stream", 1))
        store.refresh().bulk_load(nodes=rows, batch=("other", 0))
        assert store.nodes().count() == 7


def test_a_manifest_is_whole_or_absent(spark, tmp_path):
    import os

    from graphvec.sources.storage import ParquetStorage

    store = GraphStore.open(spark, f"{tmp_path}/graph")
    store.add_node("A")
    late = GraphStore.open(spark, f"{tmp_path}/graph")
    store.add_node("B")
    with pytest.raises(TransactionConflict):
        late.add_node("C")
    names = [n for n in os.listdir(tmp_path / "graph") if not n.startswith(("v=", "."))]
    assert sorted(names) == ["manifest-1.json", "manifest-2.json"] and all(os.path.getsize(tmp_path / "graph" / n) for n in names)
    assert ParquetStorage(f"{tmp_path}/graph").load(spark).version == 2
    # a writer that saw the older version only finds its manifest taken when it renames its own
    storage, base = late.storage, late._snapshot
    storage.versions = lambda _: [1]
    with pytest.raises(TransactionConflict):
        storage.commit(spark, type(base)(2, base.nodes, base.edges, base.catalog, base.next_node, base.next_edge), False)


def test_many_edges_take_few_jobs(spark):
    store = GraphStore(spark)
    ids = store.batch(lambda tx: [tx.add_node("V") for _ in range(200)])
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    sc.setJobGroup("edges", "")
    try:
        store.batch(lambda tx: tx.add_edges((a, b, "E", {}) for a in ids[:60] for b in ids[60:100]))
        jobs = len(tracker.getJobIdsForGroup("edges"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert store.edges().count() == 2400 and jobs < 30
    with pytest.raises(NodeNotFound):
        store.batch(lambda tx: tx.add_edges([(ids[0], ids[1], "E", {}), (ids[0], 10**6, "E", {})]))
    with pytest.raises(NodeNotFound):
        store.batch(lambda tx: (tx.add_edge(ids[0], ids[1], "E"), tx.delete_node(ids[1]), tx.add_edge(ids[0], ids[1], "E")))
    assert store.edges().count() == 2400


def _data_files(path):
    import glob

    return sorted(f[len(str(path)):] for f in glob.glob(f"{path}/**/part-*.parquet", recursive=True))


def test_a_small_commit_writes_a_small_file(spark, tmp_path):
    import os

    from graphvec.functions.values import BAG, bag_value

    path = tmp_path / "graph"
    store = GraphStore.open(spark, f"file://{path}")
    store.bulk_load(nodes=spark.createDataFrame([("Old", {"n": bag_value(i)}) for i in range(20_000)], f"label string, props {BAG}"))
    before = _data_files(path)
    new = store.add_node("New", {"n": 1})
    added = [f for f in _data_files(path) if f not in before]
    assert len(added) == 1 and "/nodes/" in added[0] and os.path.getsize(f"{path}{added[0]}") < 8_000
    before = _data_files(path)
    store.add_edge(new, 1, "E")
    store.delete_node(1)
    added = [f for f in _data_files(path) if f not in before]
    assert [f.split("/")[2] for f in added] == ["edges", "dead", "gone_nodes"]
    assert (store.nodes().count(), store.edges().count(), store.nodes().label("Old").count()) == (20_000, 0, 19_999)


@pytest.mark.parametrize("disk", [False, True])
def test_layers_give_what_whole_tables_would(spark, tmp_path, disk):
    import random

    rng = random.Random(7)
    path = f"file://{tmp_path}/graph"
    store = GraphStore.open(spark, path) if disk else GraphStore(spark)
    nodes, edges, past = {}, {}, []

    def step(tx):
        for _ in range(3):
            nodes[tx.add_node("V", {"x": 0})] = 0
        for _ in range(4):
            a, b = rng.choice(sorted(nodes)), rng.choice(sorted(nodes))
            edges[tx.add_edge(a, b, "E", {"x": 0})] = (a, b, 0)
        n, e = rng.choice(sorted(nodes)), rng.choice(sorted(edges))
        nodes[n] += 1
        tx.update_node(n).set_property("x", nodes[n]).apply()
        a, b, x = edges[e]
        edges[e] = (a, rng.choice(sorted(nodes)), x + 1)
        tx.update_edge(e).set_to(edges[e][1]).set_property("x", x + 1).apply()
        gone = rng.choice(sorted(edges))
        del edges[gone]
        tx.delete_edge(gone)
        if rng.random() < 0.6:
            gone = rng.choice(sorted(nodes))
            tx.delete_node(gone)
            del nodes[gone]
            for i in [i for i, (a, b, _) in edges.items() if gone in (a, b)]:
                del edges[i]

    def same(graph, nodes, edges):
        assert {n.id: n.properties["x"] for n in graph.nodes().collect()} == nodes
        assert {e.id: (e.src, e.dst, e.properties["x"]) for e in graph.edges().collect()} == edges

    for k in range(6):
        store.batch(step)
        past.append((store.graph, dict(nodes), dict(edges)))
        if k == 3:
            store.compact()
            assert len(store._snapshot.layers) == 1
    for old in past:
        same(*old)
    if disk:
        same(GraphStore.open(spark, path).graph, nodes, edges)


def test_many_unique_values_take_few_jobs(spark):
    store = GraphStore(spark)
    store.batch(lambda tx: [tx.add_node("V", {"key": i}) for i in range(5)])
    store.indexes().nodes().create_unique("V", "key")
    sc = spark.sparkContext
    sc.setJobGroup("unique", "")
    try:
        ids = store.batch(lambda tx: tx.add_nodes(("V", {"key": i}) for i in range(5, 1005)))
        jobs = len(sc.statusTracker().getJobIdsForGroup("unique"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(ids) == 1000 and jobs < 20
    for more in ([{"key": 2}], [{"key": -1}, {"key": -1}], [{"key": 1004}]):
        with pytest.raises(DuplicateKey):
            store.batch(lambda tx, more=more: tx.add_nodes(("V", p) for p in more))
    assert store.batch(lambda tx: (tx.delete_node(3), tx.add_nodes([("V", {"key": 2}), ("V", {"key": 2.0}), ("V", {"key": float("nan")}), ("V", {"key": float("nan")})]))) and store.nodes().count() == 1008
    store.batch(lambda tx: (tx.update_node(4).set_property("key", -7).apply(), tx.add_nodes([("V", {"key": 3})])))
    with pytest.raises(DuplicateKey):
        store.add_node("V", {"key": -7})


def test_settled_tables_leave_no_shuffle_files(spark):
    import glob
    import time

    from graphvec.sources.scratch import settle

    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    files = lambda: {f for d in local for f in glob.glob(f"{d.getPath()}/**/shuffle_*.data", recursive=True)}
    before = files()
    out = settle(spark.range(1000).groupBy("id").count())
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and out.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None
