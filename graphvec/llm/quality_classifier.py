"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Each word gives three tokens: the word itself, its shape (letters and digits as classes, runs shortened, other
characters as they are) and whether its three-word window stood earlier in the text. Word and shape unigrams and
bigrams, the repeat marks and the length class are hashed to 2 ** BITS features. A text's vector holds each kind's
relative frequencies, so a score is one sparse dot product that needs no sorting.

Training takes labelled documents outside the held-out fold, about ``PER_CLASS`` ids of each label at most and one row
of each id, in one pass order fixed by the id's hash; whole texts are used. Labels, language, source and id are no inputs.

Defined cases: null and empty texts are scored by bias and length class; several labels of one id count as the smallest;
without both labels every score is the labels' mean (0.5 if there are none); repeated rows get equal scores, as do texts with equal
features; a text of any length counts whole; a null id has no label; empty tables give no rows; columns named like results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, class_sample, coded, one_of_each_id, slices, spread, sums, train_once, words

BITS = 18
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
#: Labelled rows of each class that training takes, about.
PER_CLASS = 2500
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
#: Weight of each kind of feature in a text's vector.
SCALE = 8.0
_RUN = re.compile(r"(.)\1+")
_SHAPES = ((re.compile(r"[^\W\d_]*[a-zß-ÿ][^\W\d_]*"), lambda m: "Aa" if m[0][0].isupper() else "a"), (re.compile(r"[^\W\d_]+"), "A"), (re.compile(r"\d+"), "0"))


def _shape(word: bytes) -> str:
    s = word.decode()
    if s.isalpha() and s.islower():
        return "a"
    for pattern, to in _SHAPES[1:] if s.isupper() else _SHAPES:
        s = pattern.sub(to, s)
    return _RUN.sub(r"\1", s)


def _features(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(feature numbers, offsets by text) of each kind."""
    flat, offsets = words(texts, lower=False)
    codes, vocabulary = coded(flat)
    names = np.fromiter((xxhash.xxh3_64_intdigest(w, 1) for w in vocabulary), np.uint64, len(vocabulary))
    shapes = np.fromiter((xxhash.xxh3_64_intdigest(_shape(w), 2) for w in vocabulary), np.uint64, len(vocabulary))
    n = np.diff(offsets)
    owner = np.repeat(np.arange(len(n)), n)
    joined = owner[1:] == owner[:-1] if len(owner) else np.zeros(0, bool)
    pair_offsets = np.concatenate([[0], np.cumsum(np.maximum(n - 1, 0))])
    out = []
    for values in (names, shapes):
        h = values[codes]
        out.append((spread(h, BITS), offsets))
        pairs = (h[:-1] * np.uint64(3) + h[1:] * np.uint64(0x5851F42D4C957F2D))[joined] if len(h) else h
        out.append((spread(pairs, BITS), pair_offsets))
    marks = np.zeros(len(codes), np.uint64)
    if len(codes) > 2:
        inside = owner[2:] == owner[:-2]
        h = names[codes]
        windows = (h[:-2] * np.uint64(5) + h[1:-1] * np.uint64(0x5851F42D4C957F2D) + h[2:] * np.uint64(0x14057B7EF767814F) + owner[2:].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = np.flatnonzero(inside)
        _, first = np.unique(windows[at], return_index=True)
        again = np.ones(len(at), bool)
        again[first] = False
        marks[at[again] + 2] = 1
    out.append((spread(marks + np.uint64(11), BITS), offsets))
    lengths = np.array([int(k).bit_length() for k in n], np.uint64)
    out.append((spread(lengths + np.uint64(101), BITS), np.arange(len(n) + 1)))
    return out


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, label, ids, values) of each labelled text."""
    for b in batches:
        for first, texts in slices(b.column(2)):
            kinds = _features(texts)
            ids, values = [], []
            for i in range(len(texts)):
                found = {}
                for k, (numbers, offsets) in enumerate(kinds):
                    own, counts = np.unique(numbers[offsets[i] : offsets[i + 1]], return_counts=True)
                    share = (SCALE if k < len(kinds) - 1 else 1.0) / max(1, counts.sum())
                    for x, c in zip(own.tolist(), counts.tolist(), strict=True):
                        found[x] = found.get(x, 0.0) + c * share
                ids.append(np.fromiter(found, "<u4", len(found)).tobytes())
                values.append(np.fromiter(found.values(), "<f4", len(found)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), b.column(1).slice(first, len(texts)), pa.array(ids, pa.binary()), pa.array(values, pa.binary())], ["h", "label", "ids", "vals"])


def _ftrl(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: weights (the last one is the bias) as float32."""
    rows = sorted(((h, y, i, v) for b in batches for h, y, i, v in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: (r[0], r[2]))
    size = 1 << BITS
    z, n, w = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1, np.float32)
    labels = {r[1] for r in rows}
    mean = float(np.mean([r[1] for r in rows])) if rows else 0.5
    if labels != {0, 1}:
        w[size] = np.log((mean + 1e-6) / (1 - mean + 1e-6))
    else:
        bias = np.array([size])
        data = [(np.concatenate([np.frombuffer(i, "<u4").astype(np.int64), bias]), np.concatenate([np.frombuffer(v, "<f4").astype(float), [1.0]]), y) for _, y, i, v in rows]
        weight = {y: len(rows) / 2 / sum(r[1] == y for r in rows) for y in (0, 1)}
        for _ in range(EPOCHS):
            for i, x, y in data:
                zi, ni = z[i], n[i]
                wi = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
                p = 1 / (1 + np.exp(-np.clip(wi @ x, -30, 30)))
                g = (p - y) * x * weight[y]
                z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * wi
                n[i] = ni + g * g
        w[:] = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], ["weights"])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> np.ndarray:
    """Weights learnt from the labelled documents outside the held-out fold."""
    known = labels.filter(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("label"))
    known = class_sample(known.filter(bucket_of("doc_id", FOLDS) != HELD_OUT), "label", per_class)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    vectors = one_of_each_id(texts, "label").select(F.xxhash64("doc_id").alias("h"), "label", "text").mapInArrow(_vectors, "h long, label int, ids binary, vals binary")
    fitted = train_once(vectors, _ftrl, "weights binary").first()
    return np.frombuffer(fitted[0], np.float32) if fitted else np.zeros((1 << BITS) + 1, np.float32)


def scorer(weights):
    """Column function: quality of each text, from a broadcast of ``train``'s weights."""

    def run(texts: pa.Array) -> pa.Array:
        w = np.asarray(weights.value)
        out = np.empty(len(texts))
        for first, part in slices(texts):
            kinds, total = _features(part), np.full(len(part), float(w[-1]))
            for k, (numbers, offsets) in enumerate(kinds):
                scale = SCALE if k < len(kinds) - 1 else 1.0
                total += scale * sums(w[numbers].astype(np.float64), offsets) / np.maximum(1, np.diff(offsets))
            out[first : first + len(part)] = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return pa.array(out, pa.float64())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double")


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The rows with held_out, score and predicted (columns of these names are replaced)."""
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class))
    out = docs.drop("held_out", "score", "predicted").withColumn("score", scorer(weights)(F.col("text").cast("string")))
    return out.withColumns({"held_out": bucket_of("doc_id", FOLDS) == HELD_OUT, "predicted": (F.col("score") >= THRESHOLD).cast("int")})


def keep_good(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The documents that are predicted to be good, with their own columns."""
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class))
    return docs.filter(scorer(weights)(F.col("text").cast("string")) >= THRESHOLD)
