"""Operators that look at one text at a time: rules, language model, language, quality, decontamination, extraction."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphvec.llm import decontaminate, html_extract, language_id, lm_score, quality_classifier, quality_rules
from graphvec.llm import queries as llm

from .conftest import CLASHES, ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# rules


def rule_counts(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen, count = set(), Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(3)}
    dup = 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_rule_statistics(make):
    rows = [*ODD, (20, "a\n\x0b\na\na \na"), (21, "x y z q x y z y z q x"), (22, "#*$%&|<>")]
    out = quality_rules.with_statistics(make(rows, clash=True))
    assert set(CLASHES) <= set(out.columns)
    for r in out.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == rule_counts(r.text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_cascade_order_changes_no_verdict(make, sample):
    rules = quality_rules.default_rules()
    a = {r.doc_id: r.kept for r in quality_rules.cascade(sample, rules).collect()}
    b = {r.doc_id: r.kept for r in quality_rules.cascade(sample, rules[::-1], sample_rows=20).collect()}
    assert a == b and len(set(a.values())) == 2
    assert quality_rules.cascade(make([])).count() == 0
    assert not any(r.kept for r in quality_rules.cascade(make(ODD[:4])).collect())


def test_estimates_rank_by_rejection_per_cost(sample):
    rules = quality_rules.default_rules()
    found = quality_rules.estimate(sample, rules, sample_rows=10**9)
    gains = [share / seconds for _, share, seconds in found]
    assert gains == sorted(gains, reverse=True) and len(found) == len(rules)
    # of all rows the shares are exact; more work costs more, jobs cost nothing
    texts = [r.text or "" for r in sample.collect()]
    by = {r.name: (share, seconds) for r, share, seconds in found}
    assert by["too_short"][0] == pytest.approx(sum(len(words(t)) < 50 for t in texts) / len(texts))
    assert by["repeated_windows"][0] == pytest.approx(sum(100 * rule_counts(t)[4] > 50 * rule_counts(t)[0] for t in texts) / len(texts))
    assert by["repeated_windows"][1] > 2 * by["too_short"][1] > 0 and by["repeated_windows"][1] < 0.05
    same = [quality_rules.Rule(n, rules[0].rejects) for n in "abc"]
    assert [r.name for r, _, _ in quality_rules.estimate(sample.limit(0), same)] == list("abc")


def test_later_rules_are_not_evaluated_on_rejected_rows(spark, make):
    import uuid

    run = uuid.uuid4().hex
    rows = [(i, "bad" if i % 3 else "good") for i in range(60)]
    looks = quality_rules.Rule("looks", F.expr(f"reflect('java.lang.System', 'setProperty', concat('{run}-', doc_id), 'x') = 'never'"))
    kept = quality_rules.in_cascade(make(rows), [quality_rules.Rule("bad", F.col("text") == "bad"), looks]).collect()
    seen = [i for i, _ in rows if spark._jvm.java.lang.System.getProperty(f"{run}-{i}") is not None]
    assert seen == [i for i, t in rows if t == "good"]
    assert {(r.doc_id, r.failed_rule, r.kept) for r in kept} == {(i, "bad" if t == "bad" else None, t == "good") for i, t in rows}


@pytest.mark.parametrize("hot", [7, None])
def test_an_id_of_most_rows_does_not_fill_the_sample(make, hot):
    docs = make([(hot, f"text {i}") for i in range(3000)] + [(100 + i, "other") for i in range(100)])
    share = {r.name: k for r, k, _ in quality_rules.estimate(docs, [quality_rules.Rule("other", F.col("text") == "other"), quality_rules.Rule("any", F.lit(True))], sample_rows=300)}
    assert share["any"] == 1 and share["other"] < 0.2
    seen = docs.sample(300 / 3100, seed=42).count()
    assert 200 < seen < 400


def test_rules_on_clashing_columns(make):
    docs = make(ODD).withColumns({c: F.lit("x") for c in ("failed_rule", "kept", "_words", "n_words", "t0", "a", "r", "w", "base_failed")})
    got = quality_rules.with_statistics(quality_rules.cascade(docs)).collect()
    assert len(got) == len(ODD) and all(r.kept is False and r.failed_rule != "x" and r.n_words == rule_counts(r.text)[0] and r._words == "x" for r in got)


def test_rules_equal_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = llm.op8_quality_rules(spark, sf_dir)
    wanted = con.sql(llm.oracle_sql()["op8_quality_rules"])
    assert got.columns == wanted.columns and sorted(map(tuple, got.collect())) == sorted(wanted.fetchall())


# language model


def model(rows, mass, order):
    """(score of a text, probability of a token after a context) by plain recursion."""
    counts, begins = Counter(), 0
    for i, t in rows:
        if zlib.crc32(str('' if i is None else i).encode()) % 10:
            w = [0, *words(lower(t)), None]
            counts.update(tuple(w[k : k + n]) for n in range(1, order + 1) for k in range(len(w) - n + 1) if (k, n) != (0, 1))
            begins += 1
    total, distinct = sum(c for g, c in counts.items() if len(g) == 1), sum(len(g) == 1 for g in counts)

    def p(w, context):
        if not context:
            return (counts[w,] + 0.1) / (total + 0.1 * (distinct + 1))
        seen = begins if context == (0,) else counts[context]
        m = mass[min(len(context), len(mass)) - 1]
        return (counts[(*context, w)] + m * p(w, context[1:])) / (seen + m)

    def score(t):
        w = [0, *words(lower(t)), None]
        walk = sum(math.log10(p(x, tuple(w[max(0, k - order + 1) : k]))) for k, x in enumerate(w) if k)
        return len(w) - 1, sum(counts[x,] > 0 for x in w[1:]), total, sum(math.log10(p(x, ())) for x in w[1:]), walk

    return score, p, {g[0] for g in counts if len(g) == 1}


@pytest.mark.parametrize("block,bucket,order,segment", [(100, 50_000, 3, 2048), (32 << 20, 50_000, 3, 7), (3000, 20_000, 4, 5), (32 << 20, 12 << 20, 2, 2048), (2000, 3000, 3, 100)])
def test_language_model(make, monkeypatch, block, bucket, order, segment):
    monkeypatch.setattr(lm_score, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(lm_score, "ORDER", order)
    monkeypatch.setattr(lm_score, "SEGMENT", segment)
    if bucket == 3000:  # several slices
        monkeypatch.setattr(lm_score, "BUCKETS", 20)
        monkeypatch.setattr(lm_score, "RANGES", 3)
    rows = [*ODD, *((100 + i, f"The cat {i % 3} sat on THE mat {i} ^ end") for i in range(30)), (200, "the cat 1 sat on the mat"), (201, "x y z x y w x y z")]
    score, _, _ = model(rows, (7.0, 2.0), order)
    got = lm_score.score_documents(make(rows, clash=True), mass=(7.0, 2.0), block_bytes=block).collect()
    assert len(got) == len(rows)
    by = sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, r.held_out, r.base_score, r.score) for r in got)
    wanted = sorted((i or -1, *(s := score(t))[:3], zlib.crc32(str('' if i is None else i).encode()) % 10 == 0, *s[3:]) for i, t in rows)
    for a, b in zip(by, wanted, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])


def automaton(rows, texts, mass=(5.0, 3.0)):
    """The operator's automaton for some texts, with counts of ``rows``."""
    import numpy as np

    counts, begins = Counter(), 0
    vocabulary = sorted({w for t in texts for w in t} | {None}, key=str)
    hashes = np.sort(np.array([int(lm_score._END) if w is None else lm_score.xxhash.xxh3_64_intdigest(w.encode()) for w in vocabulary], np.uint64))
    code = {w: int(np.searchsorted(hashes, np.uint64(int(lm_score._END) if w is None else lm_score.xxhash.xxh3_64_intdigest(w.encode())))) for w in vocabulary}
    for r in rows:
        w = ["^", *r, None]
        counts.update(tuple(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1) if (k, n) != (0, 1))
        begins += 1
    lengths = np.array([len(t) + 1 for t in texts])
    codes = np.array([code[w] for t in texts for w in [*t, None]])
    flat = [[("^", *t, None)[max(0, k + 2 - n) : k + 2] for k in range(len(t) + 1)] for n in (1, 2, 3) for t in texts]
    found = [np.array([counts[w,] for w in sorted(code, key=code.get)], float)]
    for n, (positions, grams) in enumerate(lm_score._grams(lengths, codes, hashes), 2):
        own = [g for k in range(len(texts)) for g in flat[(n - 1) * len(texts) + k]]
        _, first = np.unique(grams, return_index=True)
        found.append(np.array([counts[tuple(own[i])] for i in positions[first]], float))
    n, v = sum(c for g, c in counts.items() if len(g) == 1), sum(len(g) == 1 for g in counts)
    return lm_score.Automaton(lengths, codes, hashes, found, n, v, begins, mass), code


def test_arcs_of_every_state_sum_to_one():
    import numpy as np

    rows = [r.split() for r in ("a b a c", "a a b", "c", "a b b c a")]
    seen = sorted({w for r in rows for w in r} | {"zzz"})
    # all texts of up to three words, so that the block holds the whole automaton
    machine, code = automaton(rows, [list(t) for n in range(4) for t in itertools.product(seen, repeat=n)])
    tokens = np.array([code[w] for w in [*seen, None]])
    assert len(machine.back) > 10
    for state in range(len(machine.back)):
        _, weight = machine.step(np.full(len(tokens), state), tokens)
        assert (10**weight).sum() == pytest.approx(1)
    # the walk carries the state: after "a b" it is that context's, after an unseen pair that of the last word, after an unseen word the root
    state = np.array([1])
    path = [int((state := machine.step(state, np.array([code[w]]))[0])[0]) for w in ("a", "b", "zzz", "c", "c")]
    assert machine.back_to[path[1]] == machine.to[code["b"]] > 0 and path[2] == 0 and path[3] == path[4] == machine.to[code["c"]]


def test_copies_are_told_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) > 300").dropDuplicates(["text"])
    copy = docs.filter("doc_id % 5 = 0").withColumn("doc_id", F.col("doc_id") + 10_000_000)
    got = lm_score.score_documents(docs.unionByName(copy)).collect()
    twice = {r.doc_id - 10_000_000 for r in got if r.doc_id >= 10_000_000 and not r.held_out}
    alone = [r.score / r.n_tokens for r in got if r.held_out and r.doc_id % 5]
    again = [r.score / r.n_tokens for r in got if r.held_out and r.doc_id in twice]
    assert len(again) > 5 and min(again) > sorted(alone)[int(len(alone) * 0.95)]


def test_language_model_without_training_texts(make):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    assert lm_score.score_documents(make([])).count() == 0
    r = lm_score.score_documents(make([(held, "a b")])).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)


# language and quality


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = [r for r in language_id.identify_language(docs, per_language=150).collect() if r.held_out and r.lang]
    assert len(got) > 150 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97


def test_language_odd_rows(make, sample):
    docs = sample.unionByName(make([(10_000 + k, t) for k, (_, t) in enumerate(ODD)] + [(20_000, "123 !!")]))
    got = {r.doc_id: r for r in language_id.identify_language(docs).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].ambiguous for i in (10_000, 10_001, 10_002, 20_000))
    assert all(0 <= r.score <= 1 for r in got.values()) and got[10_003].lang_pred != "und"
    kept = language_id.keep_identified(make(ODD, clash=True))
    assert set(CLASHES) <= set(kept.columns)
    assert language_id.identify_language(make([])).count() == 0
    assert {r.lang_pred for r in language_id.identify_language(make([(1, "abc")])).collect()} == {"und"}
    one = [(i, "hello there", "xx") for i in range(12)]
    assert {(r.lang_pred, r.score) for r in language_id.identify_language(make(one)).collect()} == {("xx", 1.0)}


def fold_letters(text):
    return [b if b >= 128 or chr(b).isalpha() else 32 for b in lower(text).encode()]


def language_features(text):
    """Share of each byte bigram and trigram, by plain loops; two blanks follow the text."""
    b, n = fold_letters(text), len((text or "").encode())
    b += [32, 32]
    out = Counter(b[i] * 256 + b[i + 1] for i in range(n))
    out.update((((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761 & 0xFFFFFFFF) >> 16) + 65536 for i in range(n))
    return {k: c * 20 / max(1, n) for k, c in out.items()}


def plain_languages(train, texts):
    """(best language, share) of each text: adaptive gradient steps for each bit and loss-weighted decoding, without arrays."""
    names = sorted({y for _, y, _ in train})
    words = [[1 if s >> i & 1 else -1 for s in range(1, 1 << (len(names) - 1))] for i in range(len(names))]
    data = [({**language_features(t), "bias": 1.0}, words[names.index(y)]) for _, y, t in train]
    bits, models = len(words[0]), []
    for bit in range(bits):
        w, squares, right = Counter(), Counter(), 0
        for epoch in range(6):
            for x, code in data:
                y = code[bit]
                f = sum(v * w[k] for k, v in x.items())
                right += epoch == 5 and f * y > 0
                for k, v in x.items():
                    g = v * -y / (1 + math.exp(max(-30, min(30, y * f))))
                    squares[k] += g * g
                    w[k] -= 0.5 * g / math.sqrt(1e-6 + squares[k])
        accuracy = min(0.999, max(0.5, right / len(data)))
        models.append((w, math.log(accuracy / (1 - accuracy)) / math.log(999)))
    out = []
    for t in texts:
        x = {**language_features(t), "bias": 1.0}
        f = [sum(v * w[k] for k, v in x.items()) for w, _ in models]
        loss = [sum(trust * math.log1p(math.exp(-max(-30, min(30, v * b)))) for v, b, (_, trust) in zip(f, code, models, strict=True)) for code in words]
        share = [math.exp(min(loss) - x) for x in loss]
        out.append((names[loss.index(min(loss))], max(share) / sum(share)))
    return out


def test_languages_equal_a_plain_version(spark, make):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("lang is not null and length(text) between 100 and 3000").orderBy("doc_id").limit(60).collect()]
    rows += [(5000, "Le", None), (5001, "x" * 30000, None), (5002, "été ñandú", None), (rows[0][0], rows[0][1], rows[0][2]), (5003, "zz", None)]
    h = {r.doc_id: r.h for r in make(rows).selectExpr("doc_id", "xxhash64(doc_id) as h").collect()}
    train = sorted({(h[i], y, t) for i, t, y in rows if y and zlib.crc32(str(i).encode()) % 4 != 2}, key=lambda r: r[0])
    got = language_id.identify_language(make(rows, clash=True)).collect()
    wanted = dict(zip([t for _, t, _ in rows], plain_languages(train, [t for _, t, _ in rows]), strict=True))
    assert len(got) == len(rows) and len({r.lang_pred for r in got}) > 2
    for r in got:
        assert r.score == pytest.approx(wanted[r.text][1], abs=2e-3)
        assert r.lang_pred == wanted[r.text][0]
    first = [r.score for r in got if r.doc_id == rows[0][0]]
    assert len(first) == 2 and first[0] == first[1]


def quality_features(text):
    """{feature: value} by plain loops."""
    import xxhash

    size, mask, w = 1 << 18, (1 << 64) - 1, words(text)
    number = lambda h: ((h & mask) * 0x9E3779B97F4A7C15 & mask) >> 46
    names = [xxhash.xxh3_64_intdigest(x.encode(), 1) for x in w]
    shapes = [xxhash.xxh3_64_intdigest(quality_classifier._shape(x.encode()), 2) for x in w]
    kinds = []
    for h in (names, shapes):
        kinds += [[number(x) for x in h], [number(a * 3 + b * 0x5851F42D4C957F2D) for a, b in itertools.pairwise(h)]]
    seen, marks = set(), []
    for k in range(len(w)):
        window = tuple(w[k - 2 : k + 1]) if k > 1 else None
        marks.append(number(11 + (window is not None and window in seen)))
        seen.add(window)
    out = Counter()
    for kind in (*kinds, marks):
        for x in kind:
            out[x] += 8.0 / len(kind)
    out[number(101 + len(w).bit_length())] += 1.0
    assert all(0 <= k < size for k in out)
    return out


def plain_quality(train, texts):
    """Scores by follow-the-regularised-leader with dictionaries."""
    z, n, data = Counter(), Counter(), [({**quality_features(t), "bias": 1.0}, y) for _, y, t in train]
    share = {y: len(data) / 2 / sum(b == y for _, b in data) for y in (0, 1)}

    def weight(k):
        return 0.0 if abs(z[k]) <= 0.02 else -(z[k] - math.copysign(0.02, z[k])) / ((1 + math.sqrt(n[k])) / 0.5 + 0.05)

    for _ in range(4):
        for x, y in data:
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(w[k] * v for k, v in x.items())))))
            for k, v in x.items():
                g = (p - y) * v * share[y]
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / 0.5 * w[k]
                n[k] += g * g
    return [1 / (1 + math.exp(-max(-30, min(30, sum(weight(k) * v for k, v in {**quality_features(t), "bias": 1.0}.items()))))) for t in texts]


def test_quality_equals_a_plain_version(spark, make):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) between 50 and 2500").orderBy("doc_id").limit(300).collect()}
    marked = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect() if r.doc_id in docs}
    picked = [i for y in (0, 1) for i in sorted(i for i in marked if marked[i] == y)[:15]]
    labels = spark.createDataFrame([(i, marked[i], 0) for i in picked], "doc_id bigint, quality int, toxic int")
    rows = [(i, docs[i]) for i in picked] + [(9000, "a b c a b c a b c"), (9001, None), (9002, "word " * 3000), (9003, "!!! 12 Ab-c")]
    h = {r.doc_id: r.h for r in make(rows).selectExpr("doc_id", "xxhash64(doc_id) as h").collect()}
    train = sorted((h[i], marked[i], docs[i]) for i in picked if zlib.crc32(str(i).encode()) % 4 != 2)
    wanted = dict(zip([i for i, _ in rows], plain_quality(train, [t for _, t in rows]), strict=True))
    got = quality_classifier.score_quality(make(rows, clash=True), labels).collect()
    assert {y for _, y, _ in train} == {0, 1} and len(got) == len(rows)
    for r in got:
        assert r.score == pytest.approx(wanted[r.doc_id], abs=1e-4)
        assert r.predicted == (r.score >= 0.7)


def test_codewords_are_distinct_and_decoding_corrects_an_error():
    import numpy as np

    for k in (2, 3, 4, 7, 8, 30):
        code = language_id.code(k)
        assert len({tuple(r) for r in code}) == k
    code = language_id.code(4)
    values = code[2] * 3.0
    values[1] *= -0.3
    assert language_id.decode(values[None, :], 4, np.ones(code.shape[1]))[0][0] == 2


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality_classifier.score_quality(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    good = [r.score for r in got if r.quality == 1]
    bad = [r.score for r in got if r.quality == 0]
    assert sum(a > b for a in good for b in bad) / (len(good) * len(bad)) > 0.97
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.95


def test_quality_odd_rows(spark, make):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality_classifier.score_quality(make([]), none).count() == 0
    got = quality_classifier.score_quality(make(ODD, clash=True), none).collect()
    assert len(got) == len(ODD) and {r.score for r in got} == {0.5} and {r.predicted for r in got} == {0}
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 0), (4, None, 0), (5, 1, 1), (None, 1, 0), (7, 1, 0), (8, 1, 0), (9, 0, 0)], none.schema)
    got = quality_classifier.score_quality(make(ODD), labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert len(set(CLASHES) - set(quality_classifier.keep_good(make(ODD, clash=True), labels).columns)) == 0


def test_the_whole_shape_of_a_word_counts():
    head = "a-0-" * 8
    a, b = (quality_classifier._features(pa.array([head + tail])) for tail in ("A%", "0_"))
    assert a[2][0].tolist() != b[2][0].tolist()


# decontamination


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_best_fit_is_the_least_edit_distance_of_any_run():
    rng = random.Random(5)
    for _ in range(300):
        item = [rng.randint(1, 4) for _ in range(rng.randint(1, 7))]
        text = [rng.randint(1, 4) for _ in range(rng.randint(0, 10))]
        least = min(edits(item, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
        assert decontaminate.best_fit(item, text)[0] == least


def test_recall_against_brute_force():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [" ".join(rng.choices(vocabulary, k=n)) for n in range(5, 65) for _ in range(2)]
    block = decontaminate.Items(list(range(len(items))), items)
    texts, wanted = [], []
    for _ in range(800):
        i = rng.randrange(len(items))
        w = items[i].split()
        for _ in range(decontaminate.allowed(len(w))):
            at, kind = rng.randrange(len(w)), rng.random()
            if kind < 0.4:
                w[at] = rng.choice(vocabulary)
            elif kind < 0.7:
                del w[at]
            else:
                w.insert(at, rng.choice(vocabulary))
        texts.append(" ".join(rng.choices(vocabulary, k=rng.randint(0, 80)) + w + rng.choices(vocabulary, k=rng.randint(0, 80))))
        wanted.append(i)
    found = [{m["item_id"] for m in r} for r in block.search(pa.array(texts))]
    assert sum(i in f for i, f in zip(wanted, found, strict=True)) / len(texts) >= decontaminate.RECALL
    codes, offsets, _ = decontaminate._hashes(pa.array(texts))
    for k in range(0, 800, 8):
        text = codes[offsets[k] : offsets[k + 1]].tolist()
        exact = {i for i, w in enumerate(block.lists) if decontaminate.best_fit(w, text)[0] <= decontaminate.allowed(len(w))}
        assert found[k] <= exact


def test_contaminated_documents(spark, make):
    item = "The quick brown fox jumps over the lazy dog near the old river bank today"
    benchmark = spark.createDataFrame([(1, item), (2, item), (3, "too short"), (4, None), (5, ""), (6, "x1 x2 x3 x4 x5")], "item_id bigint, text string")
    rows = [*ODD, (50, f"Before it. {item.upper()}!\nAnd after."), (51, item.replace("lazy ", "")), (52, "clean " * 40), (53, item), (53, item), (54, "x1 x2, x3\nx4 x5")]
    got = Counter((r.doc_id, r.item_id, r.edits, r.first_word, r.n_words) for r in decontaminate.contaminated(make(rows), benchmark).collect())
    assert got == Counter({(50, 1, 0, 2, 15): 1, (50, 2, 0, 2, 15): 1, (51, 1, 1, 0, 14): 1, (51, 2, 1, 0, 14): 1, (53, 1, 0, 0, 15): 2, (53, 2, 0, 0, 15): 2, (54, 6, 0, 0, 5): 1})
    clean = decontaminate.clean(make(rows, clash=True), benchmark)
    assert set(CLASHES) <= set(clean.columns) and clean.count() == len(ODD) + 1
    assert decontaminate.contaminated(make([]), benchmark).count() == 0
    assert decontaminate.clean(make(rows), benchmark.limit(0)).count() == len(rows)


def test_blocks_of_items_are_searched_one_after_another(spark, make, monkeypatch):
    items = [f"item {i} has these words of its own number {i * 7} and ends here {i}" for i in range(9)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    rows = [*ODD, *((100 + i, f"before {items[i]} between {items[(i * 2) % 9]} after") for i in range(9)), (100, items[0])]
    alone = decontaminate.contaminated(make(rows), benchmark)
    wanted = sorted((r.doc_id, r.item_id, r.edits, r.first_word, r.n_words) for r in alone.collect())
    whole = sorted((r.doc_id or 0, sorted(m.item_id for m in r.matches)) for r in decontaminate.with_matches(make(rows), benchmark).collect())
    left = sorted(r.doc_id or 0 for r in decontaminate.clean(make(rows), benchmark).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 2)
    found = decontaminate.contaminated(make(rows), benchmark)
    assert sorted((r.doc_id, r.item_id, r.edits, r.first_word, r.n_words) for r in found.collect()) == wanted and len(wanted) > 15
    # a plan searches for one block: what the others found is read from where it was written
    searches = [x._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") for x in (alone, found)]
    assert searches[0] == searches[1] > 0
    assert sorted((r.doc_id or 0, sorted(m.item_id for m in r.matches)) for r in decontaminate.with_matches(make(rows, clash=True), benchmark).collect()) == whole
    cleaned = decontaminate.clean(make(rows, clash=True), benchmark)
    assert sorted(r.doc_id or 0 for r in cleaned.collect()) == left and set(CLASHES) <= set(cleaned.columns)


def test_items_of_few_words_are_found_exactly(spark, make):
    benchmark = spark.createDataFrame([(1, "What is it?"), (2, "Paris"), (3, "今天天气怎么样？"), (4, "what is IT"), (5, "one two three four"), (6, "…"), (7, "水")], "item_id bigint, text string")
    rows = [(1, "So: what\nis it? Well, what is it."), (2, "what is not it, parisian"), (3, "(PARIS)"), (4, "他问今天 天气怎么样？我说好"), (5, "two three four one"), (6, "zero one two three four five"), (7, "What is"), (8, "it? Paris"), (9, None), (10, "喝水吧 水")]
    got = sorted((r.doc_id, r.item_id, r.edits, r.first_word, r.n_words) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), benchmark).collect())
    assert got == [(1, 1, 0, 1, 3), (1, 4, 0, 1, 3), (3, 2, 0, 0, 1), (4, 3, 0, 0, 2), (6, 5, 0, 1, 4), (8, 2, 0, 1, 1), (10, 7, 0, 1, 1)]
    assert sorted(r.doc_id for r in decontaminate.clean(spark.createDataFrame(rows, "doc_id bigint, text string"), benchmark).collect()) == [2, 5, 7, 9]


# extraction


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>";</script></head><body class="has-sidebar">
<header><a href="/">Home</a> Site</header><nav><ul><li><a href="/a">A</a></li><li>B</ul></nav><div class="cookie-notice">We use cookies</div>
<div id="sidebar"><p>Side text that goes on for a long while so that it looks like content to a naive reader of pages.</p></div>{}
<section class="comments"><article><p>First comment with many words that could be taken for the article by mistake if one is careless.</p></article></section>
<form><p>Your mail</p><input></form><footer>&copy; Someone &middot; imprint</footer></body></html>"""


def test_main_text():
    body = "<article><h1>T &amp; x</h1><p>One  two\n three <b>four<br>five</b><p>Six <a href='x>y'>seven</a> eight nine ten.<!-- p --><ul><li>a<li>b &#x41;</ul></article>"
    text = "T & x\nOne two three four five\nSix seven eight nine ten.\na\nb A"
    assert html_extract.main_text(PAGE.format(body)) == text
    assert html_extract.main_text(PAGE.format(body.replace("article", "div"))) == text
    assert html_extract.main_text(PAGE.format("")) == "" or "Side text" not in html_extract.main_text(PAGE.format(""))
    for cut in range(0, len(PAGE), 37):
        html_extract.main_text(PAGE.format(body)[:cut])


@pytest.mark.parametrize("element", ["article", "main", "div"])
def test_links_of_an_article_stay(element):
    said = "Plain words of the article, which go on for a line or two so that the density of the body is high. " * 3
    links = [f"Source number {i} with a title" for i in range(5)]
    parts = "".join(f"<p>{said}</p>" for _ in range(8)), "".join(f'<li><a href="/{i}">{x}</a>' for i, x in enumerate(links))
    body = f'<{element}><div><h1><a href="/t">A headline of thirty letters</a></h1></div>{parts[0]}<table><caption><a href="/c">Its caption</a><tr><td><a href="/d">Its cell</a></table><ul>{parts[1]}</ul><div class="related"><a href="/x">Elsewhere</a></div></{element}>'
    wanted = ["A headline of thirty letters", *[said.strip()] * 8, "Its caption", "Its cell", *links]
    assert html_extract.main_text(PAGE.format(body)).split("\n") == wanted
    bar = '<div><a href="/1">One place</a> <a href="/2">Another place</a></div>'
    got = html_extract.main_text(PAGE.format(body.replace("<table>", bar + "<table>"))).split("\n")
    assert got == (wanted if element == "div" else wanted[:9] + ["One place Another place"] + wanted[9:])


SAID = "Plain words of the article, which go on for a line or two so that the density of the body is high."


@pytest.mark.parametrize("inside,text", [
    (f"<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</p><p>{SAID}</article>", f"Let x=1 be\n{SAID}"),
    (f"<article><section><p>{SAID}<p>{SAID}<p>{SAID}</section><section><h2>Sources</h2><ul>{''.join(f'<li><a href=/{i}>Source {i}</a>' for i in range(9))}</ul></section></article>", "\n".join([SAID] * 3 + ["Sources", *(f"Source {i}" for i in range(9))])),
    (f"<article><p>{SAID}</p><table><tr><td><a href=/a>one</a><td><a href=/b>two</a></table></article>", f"{SAID}\none\ntwo"),
    (f'<article><p>{SAID}</p><section class="related-work"><h2>Related work</h2><p>{SAID}</section></article>', f"{SAID}\nRelated work\n{SAID}"),
    (f'<div id="social-history"><p>{SAID}<p>{SAID}</div>', f"{SAID}\n{SAID}"),
    (f'<article><p>{SAID}</p><section id="discussion"><p>It was discussed.</section><div class="notice">Down on Sunday</div><section id="post-comments"><p>{SAID}</section></article>', f"{SAID}\nIt was discussed."),
    (f'<div class="notice"><p>{SAID}<p>{SAID}<p>Short.</div><div>Elsewhere</div>', f"{SAID}\n{SAID}\nShort."),
    (f'<div class="site-header"><h1>Site</h1></div><div class="ad-slot-3">{SAID}</div><div class="newsletterSignup">{SAID}</div><div><h1>Title</h1><p>{SAID}<p>{SAID}</div>', f"Title\n{SAID}\n{SAID}"),
])
def test_marks_are_whole_names_and_content_stays(inside, text):
    assert html_extract.main_text(PAGE.format(inside)) == text


LINKS = "".join(f'<li><a href="/{i}">Some place {i}</a>' for i in range(12))
#: Pages whose noise no element, role or class names.
UNNAMED = [
    (f"<div><div><ul>{LINKS}</ul></div><div><h1>T</h1><div>By me</div><div><p>{SAID}<p>{SAID}<p>{SAID}</div></div></div>", "\n".join(["T", "By me", *[SAID] * 3])),
    (f"<h1>T</h1><div>Read this too: more</div><div><p>{SAID}<p>{SAID}<p>Short.</div><div>A teaser in plain words</div>", f"T\n{SAID}\n{SAID}\nShort."),
    (f"<main><div>Read this too: more</div><h1>T</h1><div><p>{SAID}<p>{SAID}<p>Short.</div><div>A teaser</div></main>", f"T\n{SAID}\n{SAID}\nShort."),
    (f"<article><p>A teaser of another one.</article><article><h1>T</h1><p>{SAID}<p>{SAID}<p>{SAID}</article><div>Elsewhere</div>", "\n".join(["T", *[SAID] * 3])),
]


@pytest.mark.parametrize("inside,text", UNNAMED)
def test_density_decides(inside, text, monkeypatch):
    page = f"<html><body>{inside}</body></html>"
    assert html_extract.main_text(page) == text
    monkeypatch.setattr(html_extract, "_densest", lambda nodes: nodes[0])
    assert html_extract.main_text(page) != text


def plain_density(page):
    """(text, density of each element in document order, number of the densest subtree) of a well-formed page, by recursion."""
    import xml.etree.ElementTree as ET

    def count(e, linked=False):
        """(characters, tags, characters in links, links) inside an element; only blocks are tags, and ``a`` is a link."""
        linked |= e.tag == "a"
        c = sum(len(t.replace(" ", "")) for t in (e.text or "",))
        total = [c, 0, c if linked else 0, 0]
        for x in e:
            inner = count(x, linked)
            tail = len((x.tail or "").replace(" ", ""))
            total = [total[0] + inner[0] + tail, total[1] + inner[1] + (x.tag not in ("a", "b")), total[2] + inner[2] + (tail if linked else 0), total[3] + inner[3] + (x.tag == "a")]
        return total

    def density(c, t, lc, lt):
        if not c:
            return 0.0
        t = max(t, 1)
        return c / t * math.log(1 + max(1.0, c / max(lc, 1) * t / max(lt, 1))) / math.log(1 + math.log(c / max(c - lc, 1) * lc + ratio * c + math.e))

    root = ET.fromstring(page)
    whole = count(root)
    ratio = whole[2] / max(1, whole[0])
    blocks = [e for e in root.iter() if e.tag not in ("a", "b")]

    def own(e):
        """Text of a block outside of its inner blocks, and of that in links."""
        c = lc = 0
        parts = [(e.text or "", False)]
        for x in e:
            if x.tag in ("a", "b"):
                parts.append(("".join(x.itertext()), x.tag == "a"))
            parts.append((x.tail or "", False))
        for t, linked in parts:
            c += len(t.replace(" ", ""))
            lc += len(t.replace(" ", "")) * linked
        return c, lc

    densities = [density(*count(e)) for e in blocks]
    of = dict(zip(blocks, densities, strict=True))
    totals = []
    for e in blocks:
        c, lc = own(e)
        totals.append(density(c, 1, lc, 1 if lc else 0) + sum(of[x] for x in e if x in of))
    best = max(range(len(blocks)), key=lambda k: totals[k])
    above = {x: e for e in blocks for x in e}
    path = [blocks[best]]
    while path[-1] in above:
        path.append(above[path[-1]])
    least = min(of[e] for e in path)
    node = [e for e in path if of[e] >= math.sqrt(least * of[path[0]]) or e is path[0]][-1]
    lines, line = [], []

    def flush():
        if "".join(line).split():
            lines.append(" ".join("".join(line).split()))
        line.clear()

    def kept(e):
        return any(x.tag in ("p", "li", "ul", "h2") and count(x)[0] for x in e.iter())

    def walk(e, top):
        if e.tag not in ("a", "b"):
            flush()
            c, _, lc, _ = count(e)
            if not top and not kept(e) and lc * 2 > c and of[e] < least:
                return
        line.append(e.text or "")
        for x in e:
            walk(x, False)
            line.append(x.tail or "")
        if e.tag not in ("a", "b"):
            flush()

    walk(node, True)
    return "\n".join(lines), densities, best


def test_densities_equal_brute_force():
    rng = random.Random(3)

    def block(depth):
        text = " ".join(rng.choices(["some", "words", "x", "of", "lengths"], k=rng.choice((0, 1, 4, 40))))
        if rng.random() < 0.4:
            text += f"<a>{' '.join(rng.choices(['to', 'there'], k=rng.choice((1, 5, 20))))}</a> <b>bold</b>"
        inner = "".join(block(depth - 1) for _ in range(rng.randint(0, 4))) if depth else ""
        name = rng.choice(("div", "section", "div", "ul")) if inner else rng.choice(("p", "div", "section"))
        return f"<{name}>{text}{inner}</{name}>"

    differ = 0
    for _ in range(400):
        page = f"<html><body>{''.join(block(3) for _ in range(rng.randint(1, 4)))}</body></html>"
        text, densities, best = plain_density(page)
        nodes = html_extract._ordered(html_extract._tree(page))
        html_extract._measure(nodes)
        assert [n.density for n in nodes] == pytest.approx(densities)
        if nodes[best].chars:
            assert nodes.index(html_extract._densest(nodes)) == best
            assert html_extract.main_text(page) == text
            differ += text != "\n".join(html_extract.main_text(f"<article>{page}</article>").split("\n"))
    assert differ > 100


@pytest.mark.parametrize("page,text", [(None, ""), ("", ""), ("<p>", ""), ("just text", "just text"), ("<article></article>", ""), ("a<b", "a"), ("<div class=ad>buy <article><p>real text</article>", "real text"), ("&lt;p&gt; &am", "<p> &am"), ("<td>x</td></p></div>", "x"), ("<!-- open", "")])
def test_broken_pages(page, text):
    assert html_extract.main_text(page) == text


def test_pages_table(spark):
    pages = spark.createDataFrame([(1, "u", "<p>é\U0001f600 x"), (2, None, None), (2, None, None), (3, "v", "<div>" * 3000 + "deep" + "</div>" * 10)], "page_id bigint, url string, html string").selectExpr("*", "'clash' AS text", "1 AS n_chars")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_extract.extract_pages(pages).collect())
    assert got == [(1, "é\U0001f600 x", 4), (2, "", 0), (2, "", 0), (3, "deep", 4)]
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


def test_articles_of_the_test_data(spark, sf_dir):
    import html as entities

    for r in llm.op1_html_extract(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", re.sub(r"<!--.*?(-->|$)", "", r.html, flags=re.S), re.S)
        blocks = [" ".join(entities.unescape(re.sub("<[^>]*>?", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner[1] if inner else "")]
        assert r.text == "\n".join(b for b in blocks if b)
