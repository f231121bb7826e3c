"""Language identification by error-correcting output codes over byte n-grams.

Every language has a codeword of -1/+1 bits; one binary logistic classifier predicts each bit from the text's hashed
byte bigrams and trigrams (A-Z lower-cased, other ASCII as one blank). Decoding adds each bit's logistic loss, weighted
by how well that bit was learnt; the codeword with the least loss is the prediction, its share against the others the
score. A text is flagged ambiguous if the two best codewords are closer than ``MARGIN``.

Up to seven languages use all distinct splits (2 ** (k - 1) - 1 bits); more use fixed pseudo-random codewords.
Training takes about ``PER_LANGUAGE`` ids of each language at most, outside the held-out fold, and one row of each id; whole texts are used.

Defined cases: a null id counts as empty text when folds are dealt, so its rows may be learnt from; a null text and one without a letter is ``und`` with score 0, as is every text if nothing was learnt;
with one language, all other texts have that one with score 1; a text of any length counts whole; of equal losses or shares the
first language by name wins; repeated rows agree; empty tables give no rows; columns named like results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, class_sample, one_of_each_id, slices, sums, train_once, unused

FOLDS, HELD_OUT = 4, 2
PER_LANGUAGE = 600
UNDETERMINED = "und"
MARGIN = 0.1
TRIGRAM_BITS = 16
EPOCHS, RATE = 6, 0.5
_SIZE = 65536 + (1 << TRIGRAM_BITS)
_SCALE = 20.0


def _fold() -> np.ndarray:
    """Byte classes: lower-case letters, bytes of other characters, one blank for the rest."""
    t = np.arange(256, dtype=np.uint32)
    ascii_letter = np.zeros(256, bool)
    ascii_letter[ord("a") : ord("z") + 1] = ascii_letter[ord("A") : ord("Z") + 1] = True
    t[:128][~ascii_letter[:128]] = 32
    t[ord("A") : ord("Z") + 1] += 32
    return t


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of all bigrams, of all trigrams (both by their first byte), and the first byte and the end of each text. Two
    blanks stand after a text, so that no n-gram reaches into the next one."""
    binary = texts.cast(pa.binary())
    lengths = pc.binary_length(binary).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths + 2) - 2
    raw = np.frombuffer(b"  ".join(binary.to_pylist()) + b"    ", np.uint8)
    b = _fold()[raw]
    pairs = b[:-2] * 256 + b[1:-1]
    triples = (((pairs * 256 + b[2:]) * np.uint32(2654435761)) >> np.uint32(32 - TRIGRAM_BITS)) + np.uint32(65536)
    return pairs, triples, ends - lengths, ends


def has_letter(texts: pa.Array) -> np.ndarray:
    found = pc.match_substring_regex(texts, "[A-Za-z]").to_numpy(zero_copy_only=False).copy()
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in texts[i].as_py())
    return found


def code(k: int) -> np.ndarray:
    """Codewords of k classes, one row each."""
    if k < 2:
        return np.ones((k, 1))
    if k <= 7:
        splits = np.arange(1, 1 << (k - 1))
        return np.array([np.where(splits >> i & 1, 1.0, -1.0) for i in range(k)])
    return np.where(np.random.default_rng(7).random((k, 16 + 8 * int(np.ceil(np.log2(k))))) < 0.5, -1.0, 1.0)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for first, texts in slices(b.column(2)):
            pairs, triples, starts, ends = _grams(texts)
            ids, values = [], []
            for lo, hi in zip(starts, ends, strict=True):
                own, counts = np.unique(np.concatenate([pairs[lo:hi], triples[lo:hi]]), return_counts=True)
                ids.append(own.astype("<u4").tobytes())
                values.append((counts * (_SCALE / max(1, hi - lo))).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), b.column(1).slice(first, len(texts)), pa.array(ids, pa.binary()), pa.array(values, pa.binary())], ["h", "label", "ids", "vals"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: languages, weights (feature x bit, the last row is the bias) and the bits' weights in decoding."""
    rows = sorted(((h, y, i, v) for b in batches for h, y, i, v in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: (r[0], r[2]))
    names = sorted({r[1] for r in rows})
    words = code(len(names))
    bits = words.shape[1] if names else 1
    w = np.zeros((_SIZE + 1, bits), np.float32)
    trust = np.ones(bits)
    if len(names) > 1:
        squares = np.full((_SIZE + 1, bits), 1e-6, np.float32)
        bias = np.array([_SIZE])
        data = [(np.concatenate([np.frombuffer(i, "<u4").astype(np.int64), bias]), np.concatenate([np.frombuffer(v, "<f4"), [np.float32(1)]]).astype(np.float32), words[names.index(y)]) for _, y, i, v in rows]
        right = np.zeros(bits)
        for epoch in range(EPOCHS):
            for i, x, y in data:
                f = x @ w[i]
                if epoch == EPOCHS - 1:
                    right += f * y > 0
                g = (x[:, None] * (-y / (1 + np.exp(np.clip(y * f, -30, 30))))[None, :]).astype(np.float32)
                squares[i] += g * g
                w[i] -= RATE * g / np.sqrt(squares[i])
        accuracy = np.clip(right / len(data), 0.5, 0.999)
        trust = np.log(accuracy / (1 - accuracy)) / np.log(999)
    yield pa.RecordBatch.from_arrays([pa.array([names], pa.list_(pa.string())), pa.array([w.tobytes()], pa.binary()), pa.array([trust.astype("<f8").tobytes()], pa.binary())], ["names", "weights", "trust"])


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray, np.ndarray]:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = class_sample(rows.filter(F.col("text").isNotNull() & (bucket_of("doc_id", FOLDS) != HELD_OUT)), "lang", per_language)
    vectors = one_of_each_id(rows, "lang").select(F.xxhash64("doc_id").alias("h"), F.col("lang").alias("label"), "text").mapInArrow(_vectors, "h long, label string, ids binary, vals binary")
    fitted = train_once(vectors, _fit, "names array<string>, weights binary, trust binary").first()
    if fitted is None:  # no training row, hence no task
        return [], np.zeros((_SIZE + 1, 1), np.float32), np.ones(1)
    names, weights, trust = fitted
    return list(names), np.frombuffer(weights, np.float32).reshape(_SIZE + 1, -1), np.frombuffer(trust, "<f8")


def decode(values: np.ndarray, names: int, trust: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best class, its share, margin to the next) for each row of classifier outputs."""
    words = code(names)
    margins = np.clip(values[:, None, :] * words[None, :, :], -30, 30)
    loss = (np.log1p(np.exp(-margins)) * trust).sum(axis=2)
    share = np.exp(loss.min(axis=1, keepdims=True) - loss)
    share /= share.sum(axis=1, keepdims=True)
    best = loss.argmin(axis=1)
    top = np.sort(share, axis=1)
    return best, top[:, -1], top[:, -1] - (top[:, -2] if names > 1 else 0)


def predictor(model):
    """Column function: struct of lang_pred, score and ambiguous, from a broadcast of ``train``'s result."""

    def run(texts: pa.Array) -> pa.Array:
        names, w, trust = model.value
        langs, scores, unclear = [], [], []
        for _, part in slices(texts, 1 << 20):
            known = has_letter(part) if names else np.zeros(len(part), bool)
            if names:
                pairs, triples, starts, ends = _grams(part)
                n = np.maximum(1, ends - starts)[:, None]
                runs = np.append(np.column_stack([starts, ends]).reshape(-1), len(pairs))
                values = np.column_stack([sums((w[pairs, k] + w[triples, k]).astype(np.float64), runs)[::2] for k in range(w.shape[1])]) * _SCALE / n + w[-1]
                best, share, margin = decode(values, len(names), trust)
            for i in range(len(part)):
                langs.append(names[best[i]] if known[i] else UNDETERMINED)
                scores.append(float(share[i]) if known[i] else 0.0)
                unclear.append(bool(not known[i] or margin[i] < MARGIN))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(unclear, pa.bool_())], ["lang_pred", "score", "ambiguous"])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "lang_pred string, score double, ambiguous boolean")


def identify_language(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The rows with held_out, lang_pred, score and ambiguous (columns of these names are replaced)."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, per_language))
    out = docs.drop("held_out", "lang_pred", "score", "ambiguous")
    free = unused(out, "_found")
    out = out.withColumn(free, predictor(model)(F.col("text").cast("string")))
    found = {k: F.col(f"{free}.{k}") for k in ("lang_pred", "score", "ambiguous")}
    return out.withColumns({"held_out": bucket_of("doc_id", FOLDS) == HELD_OUT, **found}).drop(free)


def keep_identified(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The documents whose language can be told, with their own columns; those without a letter are rejected."""
    free = unused(docs, "_found")
    model = docs.sparkSession.sparkContext.broadcast(train(docs, per_language))
    return docs.withColumn(free, predictor(model)(F.col("text").cast("string"))).filter(F.col(f"{free}.lang_pred") != UNDETERMINED).drop(free)
