"""SimHash near-duplicates found by pigeonring filtering.

Texts become 64-bit fingerprints of their three-word shingles; fingerprints that differ in at most two bits are
linked, and linked documents form components. All work runs on distinct fingerprints, so copies cost nothing.

Search. The 64 bits form a ring of three segments. If two fingerprints differ in at most ``BUDGET`` bits, some chain
of consecutive segments keeps every prefix within its proportional share (l segments: at most l * BUDGET / 3 bits).
The first segment must therefore agree and the first two may differ in one bit, so one half of the second segment
agrees as well. (segment, half) is the bucket key; the chain's other lengths prune the pairs of a bucket before
the full Hamming check.

Crowded buckets (more than ``CROWD`` fingerprints) are not paired. Each of their fingerprints names the 65 values at
distance 0 or 1; those that name the same value differ in two bits at most, and any two that are linked share such a
value. Linking each to the smallest of its value gives the same components in linear space: no link is lost.

Defined cases: null or empty text and text without a word has fingerprint zero and is linked like any other;
one or two words form a single shingle; repeated rows share their component; a null id never names a component
unless all its members have null ids; a text of any length is read whole; equal counts of set and unset
hashes leave a bit 0, and of equal fingerprints the smallest id stands for all; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, slices, unused, words

SHINGLE = 3
SEED = 42
BUDGET = 2
#: First bit and width of the ring's segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of a bucket beyond which its links go through shared neighbours.
CROWD = 64
#: A fingerprint of more than 1 / HOT of all rows is joined by broadcast.
HOT = 1000
_BLOCK = 1 << 18


def text_fingerprints(texts: pa.Array) -> np.ndarray:
    """Fingerprint of each text as a signed 64-bit number."""
    out = np.zeros(len(texts), np.uint64)
    for first, part in slices(texts):
        flat, offsets = words(part, lower=True)
        n_words = np.diff(offsets)
        votes = np.zeros((len(part), 64), np.int64)
        totals = np.maximum(n_words - (SHINGLE - 1), np.minimum(n_words, 1))
        if len(flat) >= SHINGLE:
            starts = np.ones(len(flat) - SHINGLE + 1, bool)
            for back in range(1, SHINGLE):
                cut = offsets[1:-1] - back
                starts[cut[(cut >= 0) & (cut < len(starts))]] = False
            owner = np.repeat(np.arange(len(part)), n_words)[: len(starts)][starts]
            rows = pa.array(np.flatnonzero(starts))
            for at in range(0, len(rows), _BLOCK):
                here = rows.slice(at, _BLOCK)
                joined = pc.binary_join_element_wise(*(flat.take(pc.add(here, k)) for k in range(SHINGLE)), " ")
                hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in joined.cast(pa.binary()).to_pylist()), np.uint64, len(here))
                _vote(votes, owner[at : at + _BLOCK], hashes)
        for i in np.flatnonzero((n_words > 0) & (n_words < SHINGLE)):
            whole = b" ".join(flat.slice(offsets[i], n_words[i]).cast(pa.binary()).to_pylist())
            _vote(votes, np.array([i]), np.array([xxhash.xxh64_intdigest(whole, SEED)], np.uint64))
        bits = (votes * 2 > totals[:, None]).astype(np.uint8)
        out[first : first + len(part)] = np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1)
    return out.view(np.int64)


def _vote(votes: np.ndarray, owner: np.ndarray, hashes: np.ndarray) -> None:
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    edges = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    votes[owner[edges]] += np.add.reduceat(bits, edges, axis=0, dtype=np.int32)


def _map_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(text_fingerprints(b.columns[-1]), pa.int64())], [*b.schema.names[:-1], "fp"])


def _identity(docs: DataFrame) -> tuple[Column, Column]:
    """What tells rows apart where ids are missing or repeated: the id (0 if null) and a hash of the text that knows a null id."""
    doc_id = F.col("doc_id").cast("long")
    return F.coalesce(doc_id, F.lit(0).cast("long")), F.xxhash64(doc_id.isNull(), F.col("text").cast("string"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_map_fingerprints, "doc_id long, fp long")


def _segment(fp: Column, i: int) -> Column:
    first, width = SEGMENTS[i % 3]
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))


def _keys(fp: Column) -> Column:
    """The six bucket keys of a fingerprint: ring start, its segment, and either half of the next one."""
    keys = []
    for i in range(3):
        here, follow = _segment(fp, i), _segment(fp, i + 1)
        for half, part in enumerate((follow.bitwiseAND(F.lit((1 << 10) - 1)), F.shiftrightunsigned(follow, 10))):
            keys.append(F.lit((i * 2 + half) << 40).bitwiseOR(F.shiftleft(here, 12)).bitwiseOR(part))
    return F.array(*keys)


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all links; ``fps`` has column fp."""
    keyed = settle(fps.select("fp", F.explode(_keys(F.col("fp"))).alias("key")))
    sizes = settle(keyed.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1"))
    left = keyed.join(sizes.filter(F.col("members") <= CROWD), "key")
    a, b = left.select("key", F.col("fp").alias("a")), left.select("key", F.col("fp").alias("b"))
    start = F.shiftrightunsigned(F.col("key"), 41).cast("int")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    within = [F.bit_count(_segment(differ, i + 1)) <= BUDGET * 2 // 3 for i in range(3)]
    chain = F.when(start == 0, within[0]).when(start == 1, within[1]).otherwise(within[2])
    pairs = a.join(b, "key").filter("a < b").filter(chain).filter(F.bit_count(differ) <= BUDGET).select("a", "b")
    crowded = keyed.join(sizes.filter(F.col("members") > CROWD), "key", "left_semi").select("fp").distinct()
    near = F.array(F.lit(0).cast("long"), *(F.lit((1 << k) - (1 << 64 if k == 63 else 0)).cast("long") for k in range(64)))
    named = crowded.select("fp", F.explode(near).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    least = named.groupBy("value").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1")
    stars = named.join(least, "value").filter("a < fp").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of the edges with the smallest node of its component.

    Alternates large-star and small-star until nothing changes; every round is written to the shared folder.
    """
    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first())

    edges = settle(edges.select("a", "b"))
    seen = state(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.explode(F.array("a", "b")).alias("b"), F.col("m").alias("a")).filter("a < b").distinct()
        edges = settle(small.select("a", "b"), instead_of=edges)
        now = state(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _rooted(first: DataFrame) -> DataFrame:
    """(fp, root, rep) of the linked fingerprints; ``first`` has each fingerprint once, with what stands for it as ``rep``."""
    roots = components(links(first))
    return roots.join(first, roots.node == first.fp).select("fp", "root", "rep")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id it reaches)."""
    marked = settle(fingerprints(docs))
    first = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_docs")))
    grouped = _rooted(first)
    least = grouped.groupBy("root").agg(F.min("rep").alias("component"))
    named = grouped.join(least, "root").select("fp", "component")
    reps = settle(first.join(named, "fp", "left").select("fp", F.coalesce("component", "rep").alias("component_id"), "n_docs"))
    return _labelled(marked, reps).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _labelled(marked: DataFrame, reps: DataFrame) -> DataFrame:
    """Every row with its fingerprint's component. The few fingerprints with a large share of all rows are broadcast (less
    than ``HOT`` of them can exist); the others are joined by shuffle."""
    hot = F.broadcast(reps.filter(F.col("n_docs") * HOT > marked.count()).select(F.col("fp").alias("hot_fp"), F.col("component_id").alias("hot_component")))
    told = marked.join(hot, F.col("fp") == F.col("hot_fp"), "left")
    rest = told.filter("hot_fp is null").select("doc_id", "fp").join(reps.select("fp", "component_id"), "fp")
    return told.filter("hot_fp is not null").select("doc_id", "fp", F.col("hot_component").alias("component_id")).unionByName(rest)


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest id (rows without id only where no other is in the
    component); of several such rows the one with the smallest hash of its text, of equal rows the first."""
    same_id, same_text = unused(docs, "_same_id"), unused(docs, "_same_text")
    known, content = _identity(docs)
    rows = docs.select(F.col("doc_id").isNull().alias("no_id"), known.alias("id"), content.alias("content"), F.col("text").cast("string").alias("text"))
    marked = rows.mapInArrow(_map_fingerprints, "no_id boolean, id long, content long, fp long")
    first = settle(marked.groupBy("fp").agg(F.min(F.struct("no_id", "id", "content")).alias("rep")))
    grouped = settle(_rooted(first))
    alone = first.join(grouped, "fp", "left_anti").select("rep")
    kept = alone.unionByName(grouped.groupBy("root").agg(F.min("rep").alias("rep")).select("rep"))
    kept = kept.select(F.col("rep.id").alias(same_id), F.col("rep.content").alias(same_text))
    told = docs.withColumns({same_id: known, same_text: content})
    return told.join(kept, [same_id, same_text], "left_semi").dropDuplicates([same_id, same_text]).drop(same_id, same_text)
