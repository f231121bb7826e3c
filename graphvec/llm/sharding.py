"""Shards of near-equal bytes by histogram sort, in DataFrame operations only.

Rows are ordered by a 63-bit key: 40 bits of the text's hash, then 23 bits of the id's. Equal texts are neighbours,
yet a group of copies of any size can be cut between its rows. Splitters are found by rounds of counting: every open
interval of keys is divided by equally spaced probes, one aggregation counts the exact bytes and rows between all
probes, and the intervals that hold a wanted boundary and exceed the tolerance are divided again. A boundary inside the rows
of a single key, as equal rows have it, is a number of those rows: the rows of such keys (there are fewer than boundaries) are
written and numbered by partition counts, so that they part like others. When all boundaries
are known the rows move once, to the part of a shard that their key names; the counts below each part give its
first slot, so that slots need no pass over a whole shard.

A round collects a histogram of about ``HISTOGRAM`` counts at most, whatever the input's size and the number of boundaries.

Defined cases: a null text counts as empty (size 16, crc32 0); equal rows, and rows without id or text, are divided like
others; ties of keys are cut by number; a text of any length stays whole, so a shard may exceed the mean by half a text at either end; an
empty table gives no rows; extra columns travel along, except that columns with the
names of this operator's results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settle, unused

SHARDS = 40
#: Fixed bytes that each document takes besides its text.
OVERHEAD = 16
KEY_BITS = 63
#: Bits that one round of probes resolves.
ROUND_BITS = 11
#: Counts that one round collects at most, if two probes for each open interval are fewer.
HISTOGRAM = 1 << 16
#: A boundary may miss its target by this share of a shard's bytes.
TOLERANCE = 0.001
#: Parts that a shard is written in; more for larger inputs.
PARTS = 4
#: Rows that one part should hold at most, and most parts of a shard.
PART_ROWS, MOST_PARTS = 2_000_000, 64


def sort_key(text: Column, doc_id: Column) -> Column:
    low = F.xxhash64(doc_id).bitwiseAND(F.lit((1 << 23) - 1))
    return F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 24), 23).bitwiseOR(low)


@dataclass(frozen=True, order=True)
class Cut:
    """The first row of a part: number ``tie`` of the rows of ``key``; with the bytes and rows before it."""

    key: int
    tie: int
    bytes: int
    rows: int


def _counts(keyed: DataFrame, opened: list[int], bits: int, next_bits: int) -> dict[int, list[tuple[int, int, int]]]:
    """Exact (probe, bytes, rows) of each open interval; an interval is named by its keys' leading bits."""
    step = KEY_BITS - next_bits
    rows = keyed.withColumn("prefix", F.shiftrightunsigned("key", KEY_BITS - bits) if bits else F.lit(0).cast("long"))
    if bits:
        rows = rows.filter(F.col("prefix").isin(opened))
    found = rows.groupBy("prefix", F.shiftrightunsigned("key", step).alias("probe")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    out: dict[int, list[tuple[int, int, int]]] = {}
    for r in sorted(found, key=lambda r: r.probe):
        out.setdefault(r.prefix, []).append((r.probe << step, r.bytes, r.n))
    return out


def splitters(keyed: DataFrame, total: int, shards: int, parts: int, tolerance: float) -> list[Cut]:
    """The cut before every part of every shard but the first. ``keyed``: key, size; ``total``: their bytes."""
    if not total:
        return []
    allowed = total / shards * tolerance
    targets = [total * i / (shards * parts) for i in range(1, shards * parts)]
    known: dict[int, Cut] = {}
    #: prefix -> (first key, bytes below, rows below, targets inside)
    opened = {0: (0, 0, 0, list(range(len(targets))))}
    bits = 0
    while opened:
        width = min(ROUND_BITS, max(1, (HISTOGRAM // len(opened)).bit_length() - 1))
        after, next_bits = {}, min(bits + width, KEY_BITS)
        counts = _counts(keyed, list(opened), bits, next_bits)
        for prefix, (_, below, rows_below, inside) in opened.items():
            waiting = list(inside)
            for key, size, n in counts.get(prefix, []):
                here = [i for i in waiting if targets[i] < below + size]
                waiting = [i for i in waiting if targets[i] >= below + size]
                end = key + (1 << (KEY_BITS - next_bits))
                deeper = []
                for i in here:
                    before, behind = targets[i] - below, below + size - targets[i]
                    main = (i + 1) % parts == 0
                    if min(before, behind) <= (allowed if main else allowed * 20) or n == 1:
                        known[i] = Cut(key, 0, below, rows_below) if before <= behind else Cut(end, 0, below + size, rows_below + n)
                    elif next_bits == KEY_BITS:
                        tie = round(before * n / size)
                        known[i] = Cut(key, tie, below + size * tie // n, rows_below + tie)
                    else:
                        deeper.append(i)
                if deeper:
                    after[key >> (KEY_BITS - next_bits)] = (key, below, rows_below, deeper)
                below, rows_below = below + size, rows_below + n
            for i in waiting:  # rounding at the very end
                known[i] = Cut(1 << KEY_BITS, 0, below, rows_below)
        opened, bits = after, next_bits
    return [known[i] for i in range(len(targets))]


def _place(key: Column, tie: Column | None, cuts: list[Cut]) -> Column:
    """How many of the sorted ``cuts`` are at or before the row: a balanced tree of comparisons."""
    def before(cut: Cut) -> Column:
        here = F.lit(cut.key).cast("decimal(20,0)" if cut.key >= 1 << 63 else "long")
        return (key < here) if tie is None or not cut.tie else (key < here) | ((key == here) & (tie < cut.tie))

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(before(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(cuts))


def _numbered(rows: DataFrame, key: str, tie: str) -> DataFrame:
    """The rows with their number within their key, in column ``tie``, by the counts of each partition."""
    rows = settle(rows.sortWithinPartitions(key).withColumn(tie, F.monotonically_increasing_id()))
    p, other, k, first, before = (unused(rows, c) for c in ("_p", "_p2", "_k", "_first", "_before"))
    rows = rows.withColumn(p, F.shiftright(tie, 33))
    stats = rows.groupBy(F.col(key).alias(k), F.col(p).alias(other)).agg(F.min(tie).alias(first), F.count("*").alias("n"))
    earlier = W.partitionBy(k).orderBy(other).rowsBetween(W.unboundedPreceding, -1)
    stats = stats.withColumn(before, F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    out = rows.join(stats, (F.col(key) == F.col(k)) & (F.col(p) == F.col(other)))
    return out.withColumn(tie, F.col(tie) - F.col(first) + F.col(before)).drop(p, other, k, first, before)


def shard_documents(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """The rows of ``docs`` with size, text_crc32, law, shard, slot and grown_shard."""
    docs = docs.drop("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = (F.octet_length(text) + OVERHEAD).cast("long")
    keyed = docs.select(size.alias("size"), sort_key(text, F.col("doc_id")).alias("key"))
    rows, total = keyed.agg(F.count("*"), F.sum("size")).first()
    parts = max(PARTS, min(MOST_PARTS, -(-rows // (shards * PART_ROWS))))
    cuts = splitters(keyed, total, shards, parts, tolerance)
    at, piece, tie = unused(docs, "_key"), unused(docs, "_part"), unused(docs, "_tie")
    first_slot, below = [], [0, *(c.rows for c in cuts)]
    for p in range(shards * parts if cuts else 1):
        first_slot.append(below[p] - below[p - p % parts])
    placed = docs.withColumns({"size": size, "text_crc32": F.crc32(text.cast("binary")), at: sort_key(text, F.col("doc_id"))})
    divided = sorted({c.key for c in cuts if c.tie})
    if divided:
        mine = F.col(at).isin(divided)
        apart = _numbered(placed.filter(mine), at, tie).withColumn(piece, _place(F.col(at), F.col(tie), cuts)).drop(tie)
        placed = placed.filter(~mine).withColumn(piece, _place(F.col(at), None, cuts)).unionByName(apart)
    else:
        placed = placed.withColumn(piece, _place(F.col(at), None, cuts))
    order = W.partitionBy(piece).orderBy(at, "doc_id", "text_crc32")
    return placed.withColumns({
        "law": F.lit("bytes"),
        "shard": F.floor(F.col(piece) / parts).cast("int"),
        "slot": F.element_at(F.array(*(F.lit(x).cast("long") for x in first_slot)), F.col(piece) + 1) + F.row_number().over(order) - 1,
        "grown_shard": F.lit(None).cast("int"),
    }).drop(at, piece)
