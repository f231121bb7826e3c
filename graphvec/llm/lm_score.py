r"""Language-model scoring with a weighted backoff automaton of smoothed word n-grams.

Tokens are words ``[^\x20\x09-\x0D]+`` with A-Z lower-cased, then one end. The model is learnt from all documents outside the
held-out fold; an n-gram's probability lends mass from that of its suffix:

    P(w)       = (c(w) + 0.1) / (N + 0.1 (V + 1))
    P(w | u v) = (c(u v w) + m P(w | v)) / (c(u v) + m), and so for each order up to ORDER, m being the order's MASS

As an automaton: every seen context of fewer than ORDER words is a state, the empty one is the root. A seen n-gram is an arc from its
context that weighs the log of its probability and leads to its longest suffix that is a state; the failure arc of a context weighs
log(m / (c + m)) and leads to the context without its first word. The root has an arc for each word. A text is walked once
from left to right, beginning in the state of a text's beginning: where the carried state has no arc for the next
token, failure arcs are followed until one has, and all weights are added up. Many texts walk side by side; a text of more than
SEGMENT tokens walks in segments, each led in by the ORDER - 1 tokens before it, which fix the state whatever came earlier.

The model is as large as the corpus, so it is never in one place. Documents are grouped in blocks of about BLOCK_BYTES.
Each block asks, bucket by bucket of the n-grams' hashes, for the counts of just those n-grams that it holds, and
brings its own training counts along; a bucket adds them over all blocks and answers every block. From the answers a
block builds its part of the automaton, which scores its texts as the whole would. There are at most BUCKETS buckets, so that the number of requests
grows with the number of blocks alone. A larger corpus divides the blocks in slices as well: a slice's part of a bucket is summed first,
the partial sums meet in finer ranges of hashes, and the totals go back the same way; no group grows with the corpus. Only N, V and the number of
training texts pass through the driver. Words are told apart by 64-bit hashes, longer n-grams by 56 bits.

Defined cases: a null or empty text is just the end token; a null id counts as empty text when folds are dealt, so its rows are held out; with no training text P(w) = 1 / (V + 1) with V = 0; a text longer than a
block is a block of its own; repeated rows count as often as they occur and get equal scores (ties in a sum's order aside); empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, coded, settle, slices, sums, words

FOLDS, HELD_OUT = 10, 0
#: Words of the longest n-grams.
ORDER = 3
#: What unseen words count as, and the mass that a context of one, two (and so on; the last is for all longer) words lends to the shorter one.
UNSEEN, MASS = 0.1, (100.0, 2.0)
#: Tokens that one lane of the walk reads at most.
SEGMENT = 2048
BLOCK_BYTES = 4 << 20
#: Text bytes for each bucket of n-grams.
BUCKET_BYTES = 12 << 20
#: Most buckets, and ranges that a bucket's partial sums are divided in.
BUCKETS, RANGES = 4096, 1024
#: Hashes of the end token and of the state before the first word; no word has them but by a hash collision.
_END, _BEGIN = np.uint64(0x656E645F6F665F74), np.uint64(0x626567696E5F6F66)
_BLOCKS = "block long, doc_ids binary, flags binary, lengths binary, codes binary, vocabulary binary"
_REQUESTS = "block long, slice long, bucket int, n int, hashes binary, counts binary"
_ANSWERS = "block long, bucket int, n int, counts binary, total long, distinct long"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _packed(values: np.ndarray) -> bytes:
    """Compressed bytes, the same byte of all values together."""
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes())


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1).T.copy().view(kind).reshape(-1)


def _sorted_packed(hashes: np.ndarray) -> bytes:
    return _packed(np.diff(hashes, prepend=np.uint64(0)))


def _sorted_unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data, np.uint64), dtype=np.uint64)


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of bigrams from those of their words."""
    x = (left * np.uint64(0x9E3779B97F4A7C15)) ^ (right * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _to_blocks(block_bytes: int):
    def block(number: int, held: list) -> pa.RecordBatch:
        ids, flags, texts = (pa.concat_arrays(x) for x in zip(*held, strict=True))
        flat, offsets = words(texts, lower=True)
        codes, vocabulary = coded(flat)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary))
        values, inverse = np.unique(np.concatenate([hashes, [_END]]), return_inverse=True)
        n = np.diff(offsets)
        ends = np.cumsum(n + 1) - 1
        out = np.empty(len(codes) + len(n), np.uint32)
        inner = np.ones(len(out), bool)
        inner[ends] = False
        out[inner] = inverse[:-1][codes]
        out[ends] = inverse[-1]
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        doc_ids = ids.fill_null(0).to_numpy().astype(np.int64)
        marks = flags.to_numpy(zero_copy_only=False).astype(np.uint8) | (~known).astype(np.uint8) << 1
        columns = [doc_ids.tobytes(), marks.tobytes(), (n + 1).astype(np.int64).tobytes(), _packed(out), _sorted_packed(values)]
        return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() << 32 | number], pa.int64()), *(pa.array([c], pa.binary()) for c in columns)], ["block", "doc_ids", "flags", "lengths", "codes", "vocabulary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = 0, [], 0
        for b in batches:
            for first, texts in slices(b.column(2), min(block_bytes, 1 << 20)):
                if held and size + texts.nbytes > block_bytes:
                    yield block(number, held)
                    number, held, size = number + 1, [], 0
                held.append((b.column(0).slice(first, len(texts)), b.column(1).slice(first, len(texts)), texts))
                size += texts.nbytes
        if held:
            yield block(number, held)

    return run


def _read(row: dict) -> tuple[np.ndarray, ...]:
    """(ids, flags, lengths, codes, vocabulary)."""
    ids, flags, lengths = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["flags"], np.uint8), np.frombuffer(row["lengths"], np.int64)
    return ids, flags, lengths, _unpacked(row["codes"], np.uint32).astype(np.int64), _sorted_unpacked(row["vocabulary"])


def _grams(lengths: np.ndarray, codes: np.ndarray, vocabulary: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, hashes) of the n-grams of two words, of three and so on, by the position of their last token. The beginning counts
    as a word before the first."""
    at = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    right = vocabulary[codes]
    last = np.where(at == 0, _BEGIN, np.roll(right, 1))
    for n in range(2, ORDER + 1):
        hashes = _pairs(last, right) >> np.uint64(8)
        positions = np.flatnonzero(at >= n - 2)
        yield positions, hashes[positions]
        last = np.roll(hashes, 1)


def _requests(buckets: int, slices: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                _, flags, lengths, codes, vocabulary = _read(row)
                train = np.repeat((flags & 1) == 0, lengths)
                part = hash(row["block"]) % slices
                yield _asked(row["block"], part, 1, vocabulary, np.bincount(codes[train], minlength=len(vocabulary)), buckets)
                for n, (positions, hashes) in enumerate(_grams(lengths, codes, vocabulary), 2):
                    known, inverse = np.unique(hashes, return_inverse=True)
                    yield _asked(row["block"], part, n, known, np.bincount(inverse[train[positions]], minlength=len(known)), buckets)

    return run


def _asked(block: int, part: int, n: int, hashes: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row for each bucket that has some of the sorted ``hashes``."""
    cuts = np.searchsorted(_bucket(hashes, n, buckets), np.arange(buckets + 1))
    full = np.flatnonzero(cuts[1:] > cuts[:-1]).tolist()
    columns = [[block] * len(full), [part] * len(full), full, [n] * len(full), [_sorted_packed(hashes[cuts[k] : cuts[k + 1]]) for k in full], [_packed(counts[cuts[k] : cuts[k + 1]].astype(np.uint32)) for k in full]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["block", "slice", "bucket", "n", "hashes", "counts"])


def _bucket(hashes: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """Grows with the hash, so that sorted hashes are sorted by bucket."""
    return ((hashes >> np.uint64(32 if n == 1 else 24)) * np.uint64(buckets)) >> np.uint64(32)


def _total(group: pa.Table, kind: type) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(each row's hashes, all of them in order, the place of each row's ones there, sums of their counts)."""
    own = [_sorted_unpacked(x.as_py()) for x in group["hashes"]]
    values, inverse = np.unique(np.concatenate(own), return_inverse=True)
    counts = np.concatenate([_unpacked(x.as_py(), kind) for x in group["counts"]])
    return own, values, inverse, np.bincount(inverse, weights=counts, minlength=len(values)).astype(np.uint64)


def _replies(own: list[np.ndarray], inverse: np.ndarray, totals: np.ndarray) -> pa.Array:
    ends = np.cumsum([len(x) for x in own])
    return pa.array([_packed(totals[inverse[e - len(x) : e]]) for x, e in zip(own, ends, strict=True)], pa.binary())


def _answer(kind: type, keys: tuple[str, ...]):
    """Adds the counts of one bucket (or range) and order, and answers each row; the first row of words tells their total and number."""

    def run(group: pa.Table) -> pa.Table:
        own, _, inverse, totals = _total(group, kind)
        first = [i == 0 and group["n"][0].as_py() == 1 for i in range(len(own))]
        return pa.table({k: group[k] for k in keys} | {
            "counts": _replies(own, inverse, totals),
            "total": pa.array([int(totals.sum()) if f else 0 for f in first], pa.int64()), "distinct": pa.array([int((totals > 0).sum()) if f else 0 for f in first], pa.int64()),
        })

    return run


def _partial(buckets: int, ranges: int):
    """Adds the counts of one slice's part of a bucket, and divides them in ranges."""

    def run(group: pa.Table) -> pa.Table:
        _, values, _, totals = _total(group, np.uint32)
        part, bucket, n = (group[k][0].as_py() for k in ("slice", "bucket", "n"))
        place = _bucket(values, n, buckets * ranges)
        edges = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        ends = [*edges[1:].tolist(), len(values)]
        return pa.table({
            "slice": pa.array([part] * len(edges), pa.int64()), "bucket": pa.array([bucket] * len(edges), pa.int32()), "n": pa.array([n] * len(edges), pa.int32()), "range": pa.array(place[edges].astype(np.int64)),
            "hashes": pa.array([_sorted_packed(values[a:b]) for a, b in zip(edges, ends, strict=True)], pa.binary()),
            "counts": pa.array([_packed(totals[a:b]) for a, b in zip(edges, ends, strict=True)], pa.binary()),
        })

    return run


def _hand_down(asked: pa.Table, answered: pa.Table) -> pa.Table:
    """Gives the totals of one slice's part of a bucket to its blocks."""
    own, _, inverse, _ = _total(asked, np.uint32)
    rows = sorted(answered.to_pylist(), key=lambda r: r["range"])
    totals = np.concatenate([_unpacked(r["counts"], np.uint64) for r in rows])
    zeros = [0] * (len(own) - 1)
    return pa.table({
        "block": asked["block"], "bucket": asked["bucket"], "n": asked["n"], "counts": _replies(own, inverse, totals),
        "total": pa.array([sum(r["total"] for r in rows), *zeros], pa.int64()), "distinct": pa.array([sum(r["distinct"] for r in rows), *zeros], pa.int64()),
    })


def _answers(asked: DataFrame, buckets: int, slices: int) -> DataFrame:
    if slices == 1:
        return asked.groupBy("bucket", "n").applyInArrow(_answer(np.uint32, ("block", "bucket", "n")), _ANSWERS)
    asked = settle(asked)
    partial = asked.groupBy("slice", "bucket", "n").applyInArrow(_partial(buckets, RANGES), "slice long, bucket int, n int, range long, hashes binary, counts binary")
    told = partial.groupBy("range", "n").applyInArrow(_answer(np.uint64, ("slice", "bucket", "n", "range")), "slice long, bucket int, n int, range long, counts binary, total long, distinct long")
    return asked.groupBy("slice", "bucket", "n").cogroup(told.groupBy("slice", "bucket", "n")).applyInArrow(_hand_down, _ANSWERS)


class Automaton:
    """The part of the model's automaton that a block's texts may use. State 0 is the root, state 1 that of a text's beginning."""

    def __init__(self, lengths: np.ndarray, codes: np.ndarray, vocabulary: np.ndarray, counts: list[np.ndarray], n: int, v: int, texts: int, masses: tuple[float, ...]):
        mass, *longer = (*masses, *[masses[-1]] * ORDER)[: ORDER]
        self.size = len(vocabulary)
        end = np.searchsorted(vocabulary, _END)
        self.root = (counts[0] + UNSEEN) / (n + UNSEEN * (v + 1))
        context = (counts[0] > 0) & (np.arange(self.size) != end)
        self.to = np.where(context, np.cumsum(context) + 1, 0)
        back, back_to = [np.array([0.0, np.log10(mass / (texts + mass))]), np.log10(mass / (counts[0][context] + mass))], [np.zeros(2 + int(context.sum()), np.int64)]
        used = len(back_to[0])
        begins = np.zeros(len(codes), bool)
        begins[np.cumsum(lengths) - lengths] = True
        # of the n-grams that end at each token: the state (0: none), the count and the probability
        at_state, at_count, at_p = self.to[codes], counts[0][codes], self.root[codes]
        keys, weights, goals = [], [], []
        for k, (positions, hashes) in enumerate(_grams(lengths, codes, vocabulary), 2):
            _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            c = counts[k - 1]
            p = positions[first]
            left_state = np.where(begins[p], 1, at_state[p - 1]) if k == 2 else at_state[p - 1]
            left_count = np.where(begins[p], texts, at_count[p - 1]) if k == 2 else at_count[p - 1]
            below, mass = mass, longer[k - 2]
            probability = (c + below * at_p[p]) / (left_count + below)
            seen = c > 0
            context = seen & (codes[p] != end) & (k < ORDER)
            own = np.where(context, np.cumsum(context) + used - 1, 0)
            keys.append(left_state[seen] * self.size + codes[p][seen])
            weights.append(np.log10(probability[seen]))
            goals.append(np.where(context, own, at_state[p])[seen])
            back.append(np.log10(mass / (c[context] + mass)))
            back_to.append(at_state[p][context])
            used += int(context.sum())
            if k < ORDER:
                at_state, at_count, at_p = (np.zeros(len(codes), x.dtype) for x in (at_state, at_count, at_p))
                at_state[positions], at_count[positions], at_p[positions] = own[inverse], c[inverse], probability[inverse]
            del positions, hashes, first, inverse
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        self.keys, self.weights, self.goals = np.append(keys[order], np.iinfo(np.int64).max), np.concatenate(weights)[order], np.concatenate(goals)[order]
        self.back, self.back_to = np.concatenate(back), np.concatenate(back_to)
        self.root = np.log10(self.root)

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(new states, weights) of reading one token in each state."""
        weight, goal = np.zeros(len(state)), np.zeros(len(state), np.int64)
        here = np.arange(len(state))
        for _ in range(ORDER - 1):
            key = state * self.size + token
            at = np.searchsorted(self.keys, key)
            hit = (self.keys[at] == key) & (state > 0)
            found = here[hit]
            weight[found] += self.weights[at[hit]]
            goal[found] = self.goals[at[hit]]
            miss = ~hit
            here, state, token = here[miss], state[miss], token[miss]
            # the root fails to itself at no cost
            weight[here] += self.back[state]
            state = self.back_to[state]
            if not len(here):
                return goal, weight
        weight[here] += self.root[token]
        goal[here] = self.to[token]
        return goal, weight

    def walk(self, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Log10 probability of each text."""
        starts = np.cumsum(lengths) - lengths
        parts = -(-lengths // SEGMENT)
        owner = np.repeat(np.arange(len(lengths)), parts)
        inside = (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)) * SEGMENT
        lead = np.where(inside > 0, ORDER - 1, 0)
        begin = starts[owner] + inside - lead
        length = np.minimum(SEGMENT, lengths[owner] - inside) + lead
        longest = np.argsort(-length, kind="stable")
        owner, lead, begin, length = owner[longest], lead[longest], begin[longest], length[longest]
        state, total = np.where(lead > 0, 0, 1), np.zeros(len(owner))
        live = np.searchsorted(-length, -np.arange(length.max(initial=0)), side="left")
        for k, n in enumerate(live.tolist()):
            state[:n], weight = self.step(state[:n], codes[begin[:n] + k])
            total[:n] += weight * (lead[:n] <= k) if k < ORDER - 1 else weight
        return np.bincount(owner, weights=total, minlength=len(lengths))


def _score(n: int, v: int, texts: int, mass: tuple[float, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                ids, flags, lengths, codes, vocabulary = _read(row)
                answers = sorted(row.pop("answers"), key=lambda a: (a["n"], a["bucket"]))
                counts = [np.concatenate([np.zeros(0, np.uint64), *(_unpacked(a["counts"], np.uint64) for a in answers if a["n"] == k)]).astype(float) for k in range(1, ORDER + 1)]
                del answers
                machine = Automaton(lengths, codes, vocabulary, counts, n, v, texts, mass)
                offsets = np.concatenate([[0], np.cumsum(lengths)])
                null = (flags & 2) > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64(), mask=null), pa.array((flags & 1) > 0), pa.array(lengths), pa.array(sums(counts[0][codes] > 0, offsets), pa.int64()), pa.array(sums(machine.root[codes], offsets)), pa.array(machine.walk(lengths, codes))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    return run


def score_documents(docs: DataFrame, mass: tuple[float, ...] = MASS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    held = bucket_of("doc_id", FOLDS) == HELD_OUT
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), text.alias("text"))
    size, training = rows.agg(F.sum(F.octet_length("text").cast("long")), F.sum((~F.col("held")).cast("long"))).first()
    wanted = 1 + (size or 0) // BUCKET_BYTES
    buckets, slices_of_blocks = min(wanted, BUCKETS), -(-wanted // BUCKETS)
    blocks = settle(rows.mapInArrow(_to_blocks(block_bytes), _BLOCKS))
    answers = settle(_answers(blocks.mapInArrow(_requests(buckets, slices_of_blocks), _REQUESTS), buckets, slices_of_blocks))
    n, v = answers.agg(F.sum("total"), F.sum("distinct")).first()
    gathered = answers.groupBy("block").agg(F.collect_list(F.struct("n", "bucket", "counts")).alias("answers"))
    scored = blocks.join(gathered, "block").select("block", "doc_ids", "flags", "lengths", "codes", "vocabulary", "answers").mapInArrow(_score(n or 0, v or 0, training or 0, mass), _SCORES)
    return scored.withColumn("train_tokens", F.lit(n or 0).cast("long")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
