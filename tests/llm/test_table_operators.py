"""Operators that look at whole tables: sharding, packing, near-duplicates, chat formatting and the pipeline."""

import os
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from graphvec.llm import chat_format, common, decontaminate, language_id, packing, quality_classifier, sharding, simhash_dedup

from graphvec.sources import scratch

from .conftest import CLASHES, ODD
from .test_text_operators import lower, words

# sharding


def check_shards(docs, rows, shards=40):
    got = sharding.shard_documents(docs, shards=shards).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = {}
    for r in got:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    size = Counter()
    for r in got:
        size[r.shard] += r.size
    return got, size


def test_shards_of_odd_rows(make):
    check_shards(make(ODD, clash=True), [(i, t) for i, t in ODD])
    assert sharding.shard_documents(make([])).count() == 0
    assert set(CLASHES) - {"size", "shard"} <= set(sharding.shard_documents(make(ODD, clash=True)).columns)


def test_shards_are_near_equal(sample):
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    _, size = check_shards(sample, rows, 8)
    largest = max(len((t or "").encode()) + 16 for _, t in rows)
    assert len(size) == 8 and max(size.values()) - min(size.values()) <= 2 * largest + sum(size.values()) / 8 * 0.01


def test_a_hot_group_of_copies_is_divided(make):
    rows = [(i, "the same text " * 5) for i in range(1500)] + [(5000 + i, f"text {i} " * 10) for i in range(3000)]
    _, size = check_shards(make(rows), rows)
    mean = sum(size.values()) / 40
    assert len(size) == 40 and max(abs(v - mean) for v in size.values()) < 0.03 * mean + 200


@pytest.mark.parametrize("hot", [(1, "same text of all these rows"), (None, None), (3, ""), (None, "text without id")])
def test_equal_rows_are_divided(make, hot):
    rows = [hot] * 2000 + [(10 + i, f"words {i:04d}") for i in range(2000)] + [(9, "twice the same")] * 2
    got, size = check_shards(make(rows, clash=True).repartition(7), rows)
    mean = sum(size.values()) / 40
    assert len(size) == 40 and max(size.values()) <= 1.05 * mean
    assert {r.at for r in got} == {"x"}


def test_two_hot_rows_in_many_parts(make):
    rows = [(1, "a" * 40)] * 900 + [(2, "b" * 30)] * 700 + [(3, "long " * 200), (None, None)] + [(i, f"t{i}") for i in range(4, 60)]
    got, size = check_shards(make(rows).repartition(5), rows, 8)
    mean = sum(size.values()) / 8
    assert len(size) == 8 and max(abs(n - mean) for n in size.values()) <= 0.01 * mean + 1016


@pytest.mark.parametrize("histogram", [8, 256])
def test_splitters_do_not_depend_on_the_histogram(make, sample, monkeypatch, histogram):
    def place():
        return {r.doc_id: (r.shard, r.slot) for r in sharding.shard_documents(sample, tolerance=0.0).collect()}

    wanted, collected, count = place(), [], sharding._counts
    monkeypatch.setattr(sharding, "HISTOGRAM", histogram)
    monkeypatch.setattr(sharding, "_counts", lambda keyed, opened, *a: collected.append((len(opened), sum(map(len, (out := count(keyed, opened, *a)).values())))) or out)
    assert place() == wanted
    assert all(n <= max(histogram, 2 * k) for k, n in collected)


# packing


def check_pieces(got, rows, window=1024):
    coder = packing.Coder(packing.default_tokenizer())
    total = 0
    places = {}
    for r in got:
        assert r.length > 0 and r.offset + r.length <= window
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for at in places.values():
        at.sort()
        assert at[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(at, at[1:], strict=False))
    lengths = sorted(sum(n for _, n in at) for at in places.values())
    assert all(n == window for n in lengths[1:])
    pieces = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got)
    by_doc = {}
    for (i, start, n, crc, tokens), k in pieces.items():
        by_doc.setdefault((i, tokens), []).extend([(start, n, crc)] * k)
    for i, text in rows:
        ids = np.array([*coder.own.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        own, at = by_doc[i, len(ids)], 0
        while at < len(ids):  # repeated rows may be cut anywhere: some chain of their pieces spells the ids
            match = next(p for p in own if p[0] == at and p[2] == zlib.crc32(ids[at : at + p[1]].tobytes()))
            own.remove(match)
            at += match[1]
    assert total == sum(r.length for r in got) and not any(by_doc.values())


def test_pieces(make, sample):
    rows = [*ODD, (60, "x<|endoftext|>y"), (61, " " * 5000), (62, "<|endoftext|")]
    docs = make(rows, clash=True).repartition(3)
    check_pieces(packing.pack(docs).collect(), rows)
    check_pieces(packing.pack(docs, window=7).collect(), rows, 7)
    check_pieces(packing.pack(sample).collect(), [(r.doc_id, r.text) for r in sample.collect()])
    assert packing.pack(make([])).count() == 0


def test_kept_ids_are_the_pieces(make):
    for r in packing.pack(make([(1, "some words here"), (2, "more of them")]), window=4, keep_ids=True).collect():
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32


_CODER = []


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_fast_engine_gives_the_files_ids(text):
    if not _CODER:
        _CODER.append(packing.Coder(packing.default_tokenizer()))
    assert _CODER[0].fast is not None
    assert _CODER[0].ids(text).tolist() == _CODER[0].own.encode(text, add_special_tokens=False).ids


# near-duplicates


def fingerprint(text):
    w = words(lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def classes(values):
    """Root of each value among those linked at two bits or fewer."""
    values = sorted(set(values))
    up = {v: v for v in values}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for k, a in enumerate(values):
        for b in values[:k]:
            if (a ^ b).bit_count() <= 2:
                up[root(a)] = root(b)
    return {v: root(v) for v in values}


def test_near_duplicates(make, sample):
    rows = [*ODD, *((r.doc_id + 1000, r.text) for r in sample.collect())]
    got = simhash_dedup.near_duplicates(make(rows, clash=True)).collect()
    prints = {t: fingerprint(t) for _, t in rows}
    root, least = classes(prints.values()), {}
    for i, t in rows:
        if i is not None:
            least[root[prints[t]]] = min(i, least.get(root[prints[t]], i))
    wanted = Counter((i, f"{prints[t]:016x}", least.get(root[prints[t]])) for i, t in rows)
    assert Counter(map(tuple, got)) == wanted
    assert simhash_dedup.near_duplicates(make([])).count() == 0


@pytest.mark.parametrize("crowd", [0, 3, 64])
def test_links_of_close_and_crowded_fingerprints(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash_dedup, "CROWD", crowd)
    rng = np.random.default_rng(3)
    values = set()
    for centre in rng.integers(0, 1 << 63, 6, dtype=np.uint64).tolist():
        at = centre
        for _ in range(40):  # a walk of one to three flips: chains, balls and gaps
            values.add(at)
            for bit in rng.choice(64, rng.integers(1, 4), replace=False):
                at ^= 1 << int(bit)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    fps = spark.createDataFrame(signed, "fp bigint")
    edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash_dedup.links(fps).collect()]
    assert all(0 < (a ^ b).bit_count() <= 2 for a, b in edges)
    roots = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash_dedup.components(simhash_dedup.links(fps)).collect()}
    wanted = classes(values)
    groups = {}
    for v in values:
        groups.setdefault(wanted[v], set()).add(roots.get(v, v))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([((i * 37) % 101, ((i + 1) * 37) % 101) for i in range(100)], "a bigint, b bigint").selectExpr("least(a, b) AS a", "greatest(a, b) AS b")
    assert {r.root for r in simhash_dedup.components(edges).collect()} == {0}
    assert simhash_dedup.components(edges.limit(0)).count() == 0


def test_one_of_each_stays(make):
    docs = make(ODD, clash=True)
    kept = simhash_dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    # a text that only rows without id have keeps one of those
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7, 8, 9, 10]


def test_one_of_each_stays_where_ids_are_missing_or_repeated(make, sample):
    texts = [r.text for r in sample.filter("text is not null and length(text) > 300").dropDuplicates(["text"]).orderBy("doc_id").limit(40).collect()]
    apart = [t for i, t in enumerate(texts) if all(bin((_fp(t) ^ _fp(o)) & (1 << 64) - 1).count("1") > 2 for o in texts[:i])][:12]
    rows = [(None, t) for t in apart[:6]] + [(None, apart[0])] * 3 + [(1, t) for t in apart[6:12]] + [(1, apart[7]), (None, apart[8]), (0, apart[5])]
    kept = [(r.doc_id, r.text) for r in simhash_dedup.keep_one_of_each(make(rows)).collect()]
    assert sorted(t for _, t in kept) == sorted(apart)
    # an id goes before none
    assert dict((t, i) for i, t in kept) == {**dict.fromkeys(apart[:5]), apart[5]: 0, **dict.fromkeys(apart[6:], 1)}
    assert simhash_dedup.keep_one_of_each(make([])).count() == 0


def _fp(text):
    return int(simhash_dedup.text_fingerprints(pa.array([text]))[0])


# chat


MAIL = [
    (1, 0, "user", "Hello there.\nHow are   you?"),
    (1, 1, "assistant", "I am fine.\nWhat about you?"),
    (1, 2, "user", "> I am fine.\n> what about  YOU?\n\nAlso fine."),
    (1, 3, "assistant", ">> I am fine.\n> Also fine.\nGood."),
    (1, 4, "user", "> How are you?\nlate answer"),
    (1, 5, "assistant", "> late answer\nok"),
    (1, 6, "user", "> what about you?\nanother"),
    (1, 7, "user", ">late answer\n>>deep\nnested branch"),
    (2, 0, "user", "> nothing known\nhi"),
    (2, 1, None, "hi again"),
    (None, 0, "user", None),
]
CHAT = "conv_id bigint, turn bigint, role string, text string"


def test_conversations_in_reply_order(spark):
    got = chat_format.format_conversations(spark.createDataFrame(MAIL, CHAT).selectExpr("*", "'x' AS at", "'y' AS units")).collect()
    order = sorted((r.conv_id or 0, r.position, r.turn, r.reply_turn, r.text) for r in got)
    assert order == [
        (0, 0, 0, None, ""),
        (1, 0, 0, None, "Hello there.\nHow are   you?"),
        (1, 1, 1, None, "I am fine.\nWhat about you?"),
        (1, 2, 2, 1, "Also fine."),
        (1, 3, 3, 2, "Good."),
        (1, 4, 6, 1, "another"),
        (1, 5, 4, 0, "late answer"),
        (1, 6, 5, 4, "ok"),
        (1, 7, 7, 4, "nested branch"),
        (2, 0, 0, None, "hi"),
        (2, 1, 1, None, "hi again"),
    ]
    assert {(r.conv_id, r.turn): (r.n_quotes, r.n_linked) for r in got if r.n_quotes} == {(1, 2): (1, 1), (1, 3): (2, 2), (1, 4): (1, 1), (1, 5): (1, 1), (1, 6): (1, 1), (1, 7): (2, 1), (2, 0): (1, 0)}
    assert next(r.message for r in got if r.text == "Good.") == "<|assistant|>\nGood.\n"
    assert all(">" not in r.text for r in got)


def test_replies_follow_their_originals(spark):
    rng = np.random.default_rng(9)
    rows, said = [], []
    for turn in range(120):
        own = f"message number {turn}"
        quote = int(rng.integers(0, turn)) if turn and rng.random() < 0.6 else None
        rows.append((7, turn, "user", (f"> {said[quote]}\n" if quote is not None else "") + own))
        said.append(own)
        rows.append((7000 + turn, 0, "user", "the same first turn"))
    # a branch nested in branches, each three messages long
    got = {r.turn: r for r in chat_format.format_conversations(spark.createDataFrame(rows, CHAT)).collect() if r.conv_id == 7}
    assert sorted(r.position for r in got.values()) == list(range(120))
    for turn, r in got.items():
        quoted = rows[2 * turn][3].startswith("> ")
        assert (r.reply_turn is not None) == quoted
        if quoted:
            assert rows[2 * turn][3].split("\n")[0] == f"> message number {r.reply_turn}" and got[r.reply_turn].position < r.position
    # depth-first order by a plain recursion
    children = {}
    for turn in range(1, 120):
        parent = got[turn].reply_turn if got[turn].reply_turn is not None else turn - 1
        children.setdefault(parent, []).append(turn)
    out, todo = [], [0]
    while todo:
        at = todo.pop()
        out.append(at)
        todo += sorted(children.get(at, []), reverse=True)
    assert [t for t, _ in sorted(got.items(), key=lambda x: x[1].position)] == out


@pytest.mark.parametrize("shape", ["nested", "hub", "mixed"])
def test_deep_and_wide_branches(spark, monkeypatch, shape):
    n, rng, written, settle = 1600, np.random.default_rng(4), [], chat_format.settle

    def counted(df, **more):
        out = settle(df, **more)
        written.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(chat_format, "settle", counted)
    quoted = {"nested": lambda k: k - 2 if k > 1 else None, "hub": lambda k: 0 if k > 1 else None, "mixed": lambda k: int(rng.integers(max(0, k - 9), k)) if k and rng.random() < 0.7 else None}[shape]
    parent = [quoted(k) for k in range(n)]
    rows = [(5, k, "user", (f"> message {q}\n" if q is not None else "") + f"message {k}") for k, q in enumerate(parent)]
    got = chat_format.format_conversations(spark.createDataFrame(rows + [(6, 0, "user", "> message 3\nalone"), (6, 1, "user", "second")], CHAT)).collect()
    children = {}
    for k in range(1, n):
        children.setdefault(k - 1 if parent[k] is None else parent[k], []).append(k)
    out, todo = [], [0]
    while todo:
        out.append(todo.pop())
        todo += sorted(children.get(out[-1], []), reverse=True)
    assert [r.turn for r in sorted(got, key=lambda r: r.position) if r.conv_id == 5] == out
    assert [(r.turn, r.position) for r in sorted(got, key=lambda r: r.turn) if r.conv_id == 6] == [(0, 0), (1, 1)]
    # every round holds two elements of each run, and no element holds a list
    assert all(k <= 2 * n for _, k in written) and {"id", "next", "sum"} in [set(c) for c, _ in written]
    assert sum({"id", "next", "sum"} == set(c) for c, _ in written) <= 14


def test_odd_conversations(spark):
    rows = [(1, 0, "u", "a"), (1, 0, "u", "a"), (1, None, None, None), (None, None, None, None), (2, 0, "u", "> "), (2, 1, "u", ">\n>>\n"), (3, 0, "u", "long " * 50000), (3, 1, "u", "> " + "long " * 50000)]
    got = chat_format.format_conversations(spark.createDataFrame(rows, CHAT)).collect()
    assert len(got) == len(rows) and next(r.reply_turn for r in got if (r.conv_id, r.turn) == (3, 1)) == 0
    assert chat_format.format_conversations(spark.createDataFrame([], CHAT)).count() == 0


# pipeline


def test_pipeline_equals_its_stages_by_hand(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    found = {r.doc_id: r.lang_pred for r in language_id.identify_language(docs).collect()}
    left = {i: t for i, t in rows.items() if found[i] != "und"}
    known = docs.filter(docs.doc_id.isin(list(left)))
    good = {r.doc_id for r in quality_classifier.score_quality(known, labels).collect() if r.score >= 0.7}
    left = {i: t for i, t in left.items() if i in good}
    prints = {i: fingerprint(t) for i, t in left.items()}
    root = classes(prints.values())
    least = {}
    for i in sorted(left):
        least.setdefault(root[prints[i]], i)
    left = {i: left[i] for i in least.values()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    block = decontaminate.Items(*map(list, zip(*items, strict=True)))
    texts = list(left)
    h, offsets, _ = decontaminate._hashes(pa.array([left[i] for i in texts]))
    for k, i in enumerate(texts):
        text = h[offsets[k] : offsets[k + 1]].tolist()
        if any(decontaminate.best_fit(w, text)[0] <= decontaminate.allowed(len(w)) for w in block.lists):
            del left[i]
    assert 0 < len(left) < len(rows)
    check_pieces(corpus_pipeline.run(spark, sf_dir).collect(), list(left.items()))


def test_pieces_of_the_pipeline_spell_the_documents(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    coder, spelt = packing.Coder(packing.default_tokenizer()), {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        spelt[r.doc_id] = spelt.get(r.doc_id, b"") + bytes(r.ids)
    assert len(spelt) > 50
    for i, ids in spelt.items():
        assert np.frombuffer(ids, "<u4").tolist() == [*coder.own.encode(texts[i], add_special_tokens=False).ids, 0]


def test_pipeline_on_odd_and_empty_tables(spark, make, tmp_path, sf_dir):
    real = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").filter("length(text) > 400").collect()]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark")}
    odd = make([*((None if i is None else i + 10**6, t) for i, t in ODD), *real, *real[:5], (None, real[0][1])], clash=True)
    left = {}
    for name, docs, labels, benchmark in (
        ("odd", odd, tables["labels"], tables["benchmark"]), ("empty", odd.limit(0), tables["labels"], tables["benchmark"]),
        ("unlabelled", odd, tables["labels"].limit(0), tables["benchmark"]), ("no_benchmark", odd, tables["labels"], tables["benchmark"].limit(0)), ("nothing", odd.limit(0), tables["labels"].limit(0), tables["benchmark"].limit(0)),
    ):
        for t, df in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
            df.write.parquet(f"{tmp_path}/{name}/{t}.parquet")
        left[name] = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
    assert not left["empty"] and not left["unlabelled"] and not left["nothing"]
    firsts = {k: [(r.doc_id, r.ids_crc32) for r in v if r.start == 0] for k, v in left.items()}
    # repeated rows leave one, those without a letter none
    assert len(firsts["odd"]) > 30 and len(set(firsts["odd"])) == len(firsts["odd"])
    assert {i for i, _ in firsts["odd"]} <= {i for i, _ in firsts["no_benchmark"]} and not {i for i, _ in firsts["no_benchmark"]} & {10**6 + 1, 10**6 + 2, 10**6 + 3}
    # of the rows without id the copy goes, the text of its own may stay
    assert sum(i is None for i, _ in firsts["odd"]) <= 1


def test_stages_leave_no_tables_behind(spark, sf_dir):
    base = scratch.scratch_dir(spark).rpartition("/")[0].removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(base))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        with scratch.passing(spark):
            docs = scratch.settle(stage(spark, docs, sf_dir), instead_of=docs, keep=True)
    assert docs.count() > 0 and len(set(os.listdir(base)) - before) == 1


def test_stages_keep_the_columns(spark, sf_dir, make):
    odd = make([(i if i is None else i + 10**6, t, "en") for i, t in ODD], clash=True)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, sf_dir)
        assert out.columns == odd.columns and out.count() <= len(ODD)
        assert stage(spark, odd.limit(0), sf_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, odd, sf_dir).count() > 0


def test_an_id_of_most_rows_adds_one_row_to_a_sample(spark):
    rows = [(7, f"copy {i % 50}", "aa") for i in range(3000)] + [(i, f"text {i}", "aa") for i in range(100, 400)] + [(i, None, "bb") for i in range(500, 520)]
    picked = common.one_of_each_id(common.class_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "lang", 60), "lang").collect()
    assert len({r.doc_id for r in picked}) == len(picked)
    assert sum(r.lang == "bb" and r.text is None for r in picked) == 20
    assert 30 <= sum(r.lang == "aa" for r in picked) <= 90
    assert {(r.doc_id, r.text, r.lang) for r in picked} <= set(rows)


def test_classifiers_learn_beside_an_id_of_most_rows(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    hot = labels.filter("quality = 0").agg({"doc_id": "min"}).first()[0]
    many = docs.unionByName(docs.filter(f"doc_id = {hot}").selectExpr("*", "explode(sequence(1, 400)) as copy").drop("copy"))
    names, weights, _ = language_id.train(docs)
    assert (language_id.train(many)[0], np.array_equal(language_id.train(many)[1], weights)) == (names, True)
    assert np.array_equal(quality_classifier.train(many, labels), quality_classifier.train(docs, labels))


@pytest.mark.parametrize("n", [2400, 2800, 5300])
def test_a_sample_is_near_its_size_just_above_it(spark, n):
    rows = spark.range(n).selectExpr("id as doc_id", "'aa' as lang")
    assert abs(common.class_sample(rows, "lang", 2400).count() - 2400) <= 300
