"""Benchmark decontamination: CGK embeddings, bit-sampling LSH and exact edit verification.

A document is contaminated by an item of W words if some run of its words is at most floor(W * EDITS) word
edits (insertions, deletions, substitutions) away from the item. Words are compared with A-Z lower-cased and
punctuation at their ends removed.

Search. A window of W words starts at every word. A run within k edits keeps W - 1 - 2k of the item's word pairs, so
windows with fewer pairs of items of their length are left aside; this loses nothing. Of neighbouring windows those with
the most such pairs go on. For them, several CGK random
walks embed windows and items: a walk copies the word under its head and advances or stays by a random bit that depends
on the step and the word, which turns edit distance into Hamming distance. Each table hashes SAMPLED positions of a
walk; WALKS * TABLES tables reach the target recall (RECALL, measured against brute force in the tests). Items that
share a table entry with a window are verified exactly by semi-global edit distance on the words around the window.

Items of fewer than LEAST_WORDS words, which EDITS allows no edits, are looked up exactly: their words in a row, or, if they
have characters of a script without blanks, their characters anywhere in the text without its blanks.

Items come in blocks of at most BLOCK_ITEMS items and BLOCK_BYTES bytes. Blocks are searched for one after another, each in a pass of its own whose
result is written before the next, so that a worker holds one block whatever the benchmark's size.

Defined cases: null and empty texts contain no item; items without a word are not searched;
equal items are reported each, as are items in each of repeated documents; documents of any length are searched whole; of several places the one with the fewest edits, then the
first, is reported; empty tables give no matches; other columns travel along, a column named ``matches`` is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import coded, settle, slices, unused, words

EDITS = 0.2
LEAST_WORDS = 5
RECALL = 0.99
WALKS, TABLES, SAMPLED = 6, 16, 2
BLOCK_ITEMS, BLOCK_BYTES = 2000, 4 << 20
#: Text bytes searched at once.
SLICE = 12 << 20
_BLOCK = 8
_MATCH = "array<struct<item_id:bigint,edits:int,first_word:bigint,n_words:bigint>>"
#: Characters of an item or text that are hashed at once to find places for characters of an item.
_ANCHOR = 8
_WORD = re.compile(r"[^ \t-\r]+")
_NO_BLANKS = re.compile(r"[\u0e00-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9d\U00020000-\U0003ffff]")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _hashes(texts: pa.Array, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each normalised word, the offset of each text's first one, and whether the sorted ``known`` has the hash."""
    flat, offsets = words(texts, lower=True)
    codes, vocabulary = coded(flat)
    strip = _PUNCTUATION.encode()
    h = np.fromiter((xxhash.xxh3_64_intdigest(w.strip(strip) or w) | 1 for w in vocabulary), np.uint64, len(vocabulary))
    if not len(codes):
        return np.zeros(0, np.uint64), offsets, np.zeros(0, bool)
    return h[codes], offsets, np.isin(h, known)[codes] if known is not None else np.ones(len(codes), bool)


def _mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return left * np.uint64(0x9E3779B97F4A7C15) ^ (right * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))


def _joined(words: list[str]) -> str:
    return "".join(words).translate(_LOWER)


def _windows(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` values in a row."""
    n = max(0, len(values) - size + 1)
    out = values[:n].copy()
    for j in range(1, size):
        out = _mix(out, values[j : j + n])
    return out


def allowed(n_words: int) -> int:
    return int(n_words * EDITS + 1e-9)


def embed(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, steps: int, walk: int) -> np.ndarray:
    """CGK walk over each run h[start:end]: (runs x steps) symbols, 0 after the end."""
    factors = np.random.default_rng(1000 + walk).integers(1, 1 << 63, steps, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros((len(starts), steps), np.uint64)
    at = starts.astype(np.int64).copy()
    for j in range(steps):
        live = at < ends
        symbol = np.where(live, h[np.minimum(at, len(h) - 1)], np.uint64(0))
        out[:, j] = symbol
        at += live & ((symbol * factors[j]) >> np.uint64(63)).astype(bool)
    return out


def signatures(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, n_words: int) -> Iterator[np.ndarray]:
    """Each table's entry of each run."""
    steps = 2 * n_words
    for walk in range(WALKS):
        symbols = embed(h, starts, ends, steps, walk)
        picks = np.random.default_rng(5000 + walk).integers(0, steps, (TABLES, SAMPLED))
        for t in range(TABLES):
            entry = np.zeros(len(starts), np.uint64)
            for p in picks[t]:
                entry = (entry ^ symbols[:, p]) * np.uint64(0xD6E8FEB86659FD93)
                entry ^= entry >> np.uint64(32)
            yield entry


def best_fit(item: list[int], text: list[int]) -> tuple[int, int]:
    """(edits, end): the run of ``text`` nearest to the item, by bit-parallel dynamic programming; the first end wins."""
    m = len(item)
    mask, high = (1 << m) - 1, 1 << (m - 1)
    where: dict[int, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    plus, minus, score = mask, 0, m
    best = (m, 0)
    for j, w in enumerate(text):
        eq = where.get(w, 0)
        xv = eq | minus
        xh = ((((eq & plus) + plus) ^ plus) | eq) & mask
        up = minus | ~(xh | plus) & mask
        down = plus & xh
        score += bool(up & high) - bool(down & high)
        up, down = up << 1 & mask, down << 1 & mask
        plus = (down | ~(xv | up)) & mask
        minus = up & xv
        if score < best[0]:
            best = (score, j + 1)
    return best


class Short:
    """Items of few words, ready to be looked up. ``places`` are their numbers in the block."""

    def __init__(self, places: list[int], words: list[np.ndarray], texts: list[str]):
        #: By number of words: sorted hashes, the words and the items that have them.
        self.runs: dict[int, tuple[np.ndarray, np.ndarray, list[list[int]]]] = {}
        grouped: dict[int, dict[tuple, list[int]]] = {}
        for place, w in zip(places, words, strict=True):
            grouped.setdefault(len(w), {}).setdefault(tuple(w.tolist()), []).append(place)
        for size, groups in grouped.items():
            rows = np.array(list(groups), np.uint64)
            keys = np.array([_windows(r, size)[0] for r in rows], np.uint64)
            order = np.argsort(keys, kind="stable")
            owners = list(groups.values())
            self.runs[size] = keys[order], rows[order], [owners[i] for i in order]
        #: By number of hashed characters: the characters and items of each hash.
        self.chars: dict[int, dict[int, list[tuple[str, int]]]] = {}
        for place, text in zip(places, texts, strict=True):
            joined = _joined(_WORD.findall(text)).strip(_PUNCTUATION + "。、，．？！：；「」『』（）《》〈〉【】…・")
            if _NO_BLANKS.search(joined):
                size = min(len(joined), _ANCHOR)
                key = int(_windows(np.frombuffer(joined[:size].encode("utf-32-le"), "<u4").astype(np.uint64), size)[0])
                self.chars.setdefault(size, {}).setdefault(key, []).append((joined, place))

    def search(self, texts: pa.Array, h: np.ndarray, offsets: np.ndarray, found: list[dict[int, tuple]]) -> None:
        """Adds (edits, first word, words) of the first place of each item."""
        owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
        for size, (keys, rows, owners) in self.runs.items():
            if len(h) < size:
                continue
            windows = _windows(h, size)
            entry = np.minimum(np.searchsorted(keys, windows), len(keys) - 1)
            # equal hashes of different items are neighbours
            same = [np.flatnonzero((keys[np.minimum(entry + d, len(keys) - 1)] == windows) & (entry + d < len(keys)) & (owner[: len(windows)] == owner[size - 1 :])) for d in range(int(np.unique(keys, return_counts=True)[1].max()))]
            for d, at in enumerate(same):
                e = entry[at] + d
                right = (h[at[:, None] + np.arange(size)] == rows[e]).all(axis=1)
                at, e = at[right], e[right]
                _, first = np.unique(owner[at] * np.int64(len(keys)) + e, return_index=True)
                for p, k in zip(at[first].tolist(), e[first].tolist(), strict=True):
                    for place in owners[k]:
                        found[owner[p]][place] = (0, p - int(offsets[owner[p]]), size)
        if not self.chars:
            return
        for doc, text in enumerate(texts.to_pylist()):
            if not text or not _NO_BLANKS.search(text):
                continue
            parts = _WORD.findall(text)
            joined = _joined(parts)
            starts = np.cumsum([0, *(len(w) for w in parts)])
            codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
            for size, wanted in self.chars.items():
                windows = _windows(codes, size)
                for at in np.flatnonzero(np.isin(windows, np.fromiter(wanted, np.uint64, len(wanted)))).tolist():
                    for item, place in wanted[int(windows[at])]:
                        if place not in found[doc] and joined.startswith(item, at):
                            first, last = (int(np.searchsorted(starts, x, side="right")) - 1 for x in (at, at + len(item) - 1))
                            found[doc][place] = (0, first, last - first + 1)


class Items:
    """One block of benchmark items, ready to be searched for."""

    def __init__(self, ids: list, texts: list[str]):
        h, offsets, _ = _hashes(pa.array(texts, pa.string()))
        long = np.diff(offsets) >= LEAST_WORDS
        self.all_ids, few = ids, np.flatnonzero((np.diff(offsets) > 0) & ~long).tolist()
        self.short = Short(few, [h[offsets[i] : offsets[i + 1]] for i in few], [texts[i] for i in few]) if few else None
        #: Number in the block of each item of enough words.
        self.places = np.flatnonzero(long).tolist()
        self.ids = [i for i, k in zip(ids, long, strict=True) if k]
        self.words = [h[a:b] for a, b, k in zip(offsets[:-1], offsets[1:], long, strict=True) if k]
        self.lists = [w.tolist() for w in self.words]
        self.sizes = sorted({len(w) for w in self.words})
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.words]))
        pairs, owners, self.tables = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], {}
        for c, size in enumerate(self.sizes):
            own = np.array([i for i, w in enumerate(self.words) if len(w) == size])
            flat = np.concatenate([self.words[i] for i in own])
            starts = np.arange(len(own)) * size
            self.tables[size] = []
            for entry in signatures(flat, starts, starts + size, size):
                order = np.argsort(entry, kind="stable")
                self.tables[size].append((entry[order], own[order]))
            for i in own:
                p = _mix(self.words[i][:-1], self.words[i][1:])
                pairs.append(p)
                owners.append(np.full(len(p), c))
        self.pairs, inverse = np.unique(np.concatenate(pairs), return_inverse=True)
        #: Which lengths of items have a pair; the last row stands for unknown pairs.
        self.member = np.zeros((len(self.pairs) + 1, len(self.sizes)), bool)
        self.member[inverse, np.concatenate(owners)] = True
        self.least = [s - 1 - 2 * allowed(s) for s in self.sizes]
        #: Some run of _BLOCK pairs inside any wanted window has so many known ones.
        self.dense = max(1, min((-(-need // -(-(s - 1) // _BLOCK)) for s, need in zip(self.sizes, self.least, strict=True)), default=1))

    def search(self, texts: pa.Array) -> list[list[dict]]:
        h, offsets, known = _hashes(texts, self.vocabulary)
        found = [{self.places[i]: x for i, x in f.items()} for f in self._search(h, offsets, known)]
        if self.short:
            self.short.search(texts, h, offsets, found)
        return [[{"item_id": self.all_ids[i], "edits": e, "first_word": a, "n_words": n} for i, (e, a, n) in sorted(f.items())] for f in found]

    def _search(self, h: np.ndarray, offsets: np.ndarray, known: np.ndarray) -> list[dict[int, tuple]]:
        """(edits, first word, words) of the items of enough words in each text."""
        found: list[dict[int, tuple]] = [{} for _ in range(len(offsets) - 1)]
        if not self.ids or len(h) < 2:
            return found
        owner = np.repeat(np.arange(len(found), dtype=np.int32), np.diff(offsets))
        at = np.flatnonzero(known[1:] & known[:-1] & (owner[1:] == owner[:-1]))
        pairs = _mix(h[at], h[at + 1])
        found_at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        same = self.pairs[found_at] == pairs
        code = np.full(len(h) - 1, len(self.pairs), np.int32)
        code[at[same]] = found_at[same]
        hit = code < len(self.pairs)
        total = np.concatenate([[0], np.cumsum(hit)])
        reach = np.minimum(np.arange(len(hit)) + _BLOCK, len(hit))
        dense = np.flatnonzero(total[reach] - total[:-1] >= self.dense)
        if not len(dense):
            return found
        widest = self.sizes[-1]
        edge = np.zeros(len(h) + 1, np.int64)
        np.add.at(edge, np.maximum(dense - widest, 0), 1)
        np.add.at(edge, np.minimum(dense + _BLOCK + widest, len(h)), -1)
        zone = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        zone_code = np.concatenate([code, [len(self.pairs)]])[zone]
        ends = offsets[1:][owner[zone]]
        candidates: dict[tuple[int, int], set[int]] = {}
        for c, (size, need) in enumerate(zip(self.sizes, self.least, strict=True)):
            ours = np.concatenate([[0], np.cumsum(self.member[zone_code, c])])
            stop = np.searchsorted(zone, np.minimum(zone + size - 1, ends - 1))
            inside = ours[stop] - ours[: len(zone)]
            keep = (inside >= need) & (inside >= np.append(inside[1:], 0)) & (inside >= np.insert(inside[:-1], 0, 0))
            starts = zone[keep]
            if not len(starts):
                continue
            to = np.minimum(starts + size, ends[keep])
            for entry, (sorted_entries, items) in zip(signatures(h, starts, to, size), self.tables[size], strict=True):
                lo = np.searchsorted(sorted_entries, entry)
                for k in np.flatnonzero(sorted_entries[np.minimum(lo, len(items) - 1)] == entry):
                    for i in items[lo[k] : np.searchsorted(sorted_entries, entry[k], side="right")]:
                        candidates.setdefault((int(owner[starts[k]]), int(i)), set()).add(int(starts[k]))
        for (doc, i), starts in candidates.items():
            size, k = len(self.lists[i]), allowed(len(self.lists[i]))
            begin, done = int(offsets[doc]), int(offsets[doc + 1])
            for lo, hi in _merged(sorted(starts), size + 2 * k):
                lo, hi = max(begin, lo - 2 * k), min(done, hi + size + 2 * k)
                text = h[lo:hi].tolist()
                edits, end = best_fit(self.lists[i], text)
                if edits <= k and (i not in found[doc] or edits < found[doc][i][0]):
                    _, back = best_fit(self.lists[i][::-1], text[:end][::-1])
                    found[doc][i] = (edits, lo - begin + end - back, back)
        return found


def _merged(starts: list[int], gap: int) -> Iterator[tuple[int, int]]:
    lo = hi = starts[0]
    for s in starts[1:]:
        if s > hi + gap:
            yield lo, hi
            lo = s
        hi = s
    yield lo, hi


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text is not null").orderBy("item_id", "text")
    for i, text in rows.toLocalIterator():
        if ids and (len(ids) == BLOCK_ITEMS or size + len(text) > BLOCK_BYTES):
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(i)
        texts.append(text)
        size += len(text)
    if ids:
        yield ids, texts


def _finder(block):
    ready: list[Items] = []

    def run(texts: pa.Array) -> pa.Array:
        if not ready:
            ready.append(Items(*block.value))
        out: list[list[dict]] = []
        for _, part in slices(texts, SLICE):
            out += ready[0].search(part)
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("first_word", pa.int64()), ("n_words", pa.int64())]))
        return pa.array(out, kind)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, _MATCH)


def _passes(docs: DataFrame, benchmark: DataFrame, search: Callable[[DataFrame, Column], DataFrame], carry: bool) -> list[DataFrame]:
    """What ``search`` makes of the documents and the matches of each block of items; carry: it goes on with the result of the block before."""
    sc, out, blocks = docs.sparkSession.sparkContext, [], _blocks(benchmark)
    block = next(blocks, None)
    while block:
        held = sc.broadcast(block)
        found = search(docs, _finder(held)(F.col("text").cast("string")))
        block = next(blocks, None)
        if block:
            found = settle(found)
            held.unpersist()
        docs = found if carry else docs
        out.append(found)
    return out


def with_matches(docs: DataFrame, benchmark: DataFrame, name: str = "matches") -> DataFrame:
    """The rows with a column of each item that a text contains, with edits, first word and number of words."""
    docs = docs.withColumn(name, F.array().cast(_MATCH))
    return [docs, *_passes(docs, benchmark, lambda rows, found: rows.withColumn(name, F.concat(F.col(name), found)), True)][-1]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item it contains: doc_id, item_id, edits, first_word, n_words."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = _passes(rows, benchmark, lambda rows, found: rows.withColumn("matches", found).select("doc_id", F.inline("matches")), False)
    if not found:
        return rows.select("doc_id", F.inline(F.array().cast(_MATCH)))
    return reduce(DataFrame.unionByName, found)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that contain no item, with their own columns. What one block of items has found isn't searched for the next."""
    free = unused(docs, "_matches")
    return [docs, *_passes(docs, benchmark, lambda rows, found: rows.withColumn(free, found).filter(F.size(free) == 0).drop(free), True)][-1]
