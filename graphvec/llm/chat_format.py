"""Chat formatting by quotation linking, in DataFrame operations only.

Each message's lines are read as nested quotes: the leading ``>`` marks give the level, and a run of lines of one level is a
passage. Passages and their lines are normalised (lower case, single blanks) and hashed. A hash is joined to the
original of its conversation, the first earlier message that has it in its own words (whole body, unquoted run or line). Among a
message's links the lowest level, then the longest passage, then the latest original decides what it replies to.

The conversation is then put in reply order: a message without a link, or one that answers the message before it,
continues; another one branches off. Branches follow the run of messages that they branch from, the deeper ones first, so each reply
stands after its original. A run's place is the sum of all runs before it on a walk around the tree of runs, found by doubling:
each round adds what the next element has summed up and jumps as far, so that a round is as large as the number of
runs, however deep they are nested. Quoted lines are dropped from the text, and each message is rendered with its role.

Conversations are numbered by range partitions and joined by (conversation, hash), so that one that holds a third
of all messages is spread like any other; nothing collects a conversation in one place.

Defined cases: a null text is an empty message; messages are ordered by turn, then role and text (nulls first); rows that are
equal in all of these are equal messages in a row; a null conv_id is a conversation of its own; quotes without an original are dropped
like others but link nothing; a text or conversation of any length is linked whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import in_order, settle

_QUOTE = r"^((?:[ \\t]*>)+)"
_NORMAL = r"lower(trim(regexp_replace({}, '\\s+', ' ')))"
#: Lines as (level, own text, normalised text).
_LINES = f"transform(split(text, '\\n'), l -> struct(length(regexp_replace(regexp_extract(l, '{_QUOTE}', 1), '[^>]', '')) as level, l as line, {_NORMAL.format(f"regexp_replace(l, '{_QUOTE}', '')")} as normal))"
#: Runs of one level as (level, normalised text of the run, its lines).
_RUNS = "transform(starts, (s, i) -> struct(lines[s].level as level, slice(lines, s + 1, coalesce(get(starts, i + 1), size(lines)) - s) as run))"
_STARTS = "filter(sequence(0, size(lines) - 1), i -> i = 0 or lines[i].level <> lines[i - 1].level)"
_UNITS = "transform(runs, r -> struct(r.level as level, concat(array(array_join(filter(r.run.normal, n -> n <> ''), ' ')), r.run.normal) as units))"


def has_quotes() -> Column:
    return F.col("text").contains(">") & F.col("text").rlike(r"(?:\A|\n)[ \t]*>")


def parsed(messages: DataFrame) -> DataFrame:
    """Adds ``units``: level, normalised passage and lines of each run."""
    out = messages.withColumn("lines", F.expr(_LINES)).withColumn("starts", F.expr(_STARTS)).withColumn("runs", F.expr(_RUNS))
    return out.withColumn("units", F.expr(_UNITS)).drop("lines", "starts", "runs")


def unquoted() -> Column:
    """The message without its quoted lines."""
    own = F.when(has_quotes(), F.expr(f"array_join(filter(split(text, '\\n'), l -> NOT (l RLIKE '{_QUOTE}')), '\\n')")).otherwise(F.col("text"))
    return F.regexp_replace(own, r"^\n+|\n+$", "")


def linked(messages: DataFrame) -> DataFrame:
    """(at, parent, n_quotes, n_linked) of messages with quotes; ``messages``: conv, at and text.

    Only conversations with a quote are searched for originals. Both sides are written first, or the optimizer would parse all
    messages below the join to drop those without units.
    """
    quoting = settle(messages.filter(has_quotes()))
    asking = parsed(quoting).select("conv", "at", F.explode("units").alias("u")).filter("u.level > 0")
    sources = parsed(settle(messages.join(quoting.select("conv").distinct(), "conv", "left_semi")))
    own = sources.select("conv", "at", F.explode("units").alias("u")).filter("u.level = 0").select("conv", "at", F.explode("u.units").alias("unit"))
    whole = sources.select("conv", "at", F.expr(_NORMAL.format("array_join(flatten(transform(filter(units, u -> u.level = 0), u -> array(u.units[0]))), ' ')")).alias("unit"))
    first = own.unionByName(whole).filter("unit <> ''").groupBy("conv", F.xxhash64("unit").alias("hash"), F.length("unit").alias("size")).agg(F.min("at").alias("original"))
    quoted = asking.select("conv", "at", F.col("u.level").alias("level"), F.posexplode("u.units").alias("k", "unit")).filter("unit <> ''")
    quoted = quoted.select("conv", "at", "level", "k", F.xxhash64("unit").alias("hash"), F.length("unit").alias("size"))
    found = quoted.join(first, ["conv", "hash", "size"], "left").withColumn("original", F.expr("if(original < at, original, null)"))
    best = F.max(F.when(F.col("original").isNotNull(), F.struct(-F.col("level"), "size", "original"))).alias("best")
    per = found.groupBy("at").agg(best, F.count_if(F.col("k") == 0).alias("n_quotes"), F.count_if((F.col("k") == 0) & F.col("original").isNotNull()).alias("n_linked"))
    return per.select("at", F.col("best.original").alias("parent"), "n_quotes", "n_linked")


def _walk(branches: DataFrame, lengths: DataFrame) -> DataFrame:
    """(head, behind): the messages from each run to the end of its conversation in reply order.

    ``branches``: head, above (head of the run that it branches from) and step (the message there); ``lengths``: head and n of the
    runs. A walk around the tree enters a run (element 2 head), walks around its branches and leaves it (2 head + 1). Branches of one run are
    numbered in a global order, so that a run of any number of branches is spread.
    """
    order = in_order(branches.withColumn("back", -F.col("step")), ["above", "back", "head"], "place")
    following = order.select((F.col("place") - 1).alias("place"), F.col("above").alias("above2"), F.col("head").alias("sibling"))
    siblings = order.join(following, "place", "left").select("head", "above", F.when(F.col("above") == F.col("above2"), F.col("sibling")).alias("sibling"))
    first = order.groupBy(F.col("above").alias("head")).agg(F.min(F.struct("place", "head")).alias("first")).select("head", F.col("first.head").alias("child"))
    runs = lengths.join(first, "head", "left").join(siblings, "head", "left")
    enter, leave = F.col("head") * 2, F.col("head") * 2 + 1
    ways = F.array(
        F.struct(enter.alias("id"), F.coalesce(F.col("child") * 2, leave).alias("next"), F.col("n").alias("sum")),
        F.struct(leave.alias("id"), F.coalesce(F.col("sibling") * 2, F.col("above") * 2 + 1).alias("next"), F.lit(0).cast("long").alias("sum")),
    )
    known = settle(runs.select(F.inline(ways)))
    while not known.filter("next is not null").isEmpty():
        ahead = known.select(F.col("id").alias("next"), F.col("next").alias("after"), F.col("sum").alias("more"))
        known = settle(known.join(ahead, "next", "left").select("id", F.col("after").alias("next"), (F.col("sum") + F.coalesce("more", F.lit(0))).alias("sum")), instead_of=known)
    return known.filter("id % 2 = 0").select(F.expr("id div 2").alias("head"), F.col("sum").alias("behind"))


def _segments(rows: DataFrame) -> DataFrame:
    """Adds ``head``, the latest head at or before each message; ``rows`` has at and is_head, and message 0 is a head."""
    size = 1 << 12
    rows = rows.withColumn("block", F.floor(F.col("at") / size))
    latest = rows.filter("is_head").groupBy("block").agg(F.sort_array(F.collect_list("at")).alias("heads"))
    # the last head before a block: from the last block that has one; blocks are one row for 4096 messages
    last = latest.select("block", F.element_at("heads", -1).alias("last"))
    blocks = rows.select("block").distinct().join(last, "block", "left")
    wide = F.floor(F.col("block") / size).alias("wide")
    # one row for 16 million messages, in order
    tops = blocks.groupBy(wide).agg(F.max("last").alias("top")).select("wide", F.max("top").over(W.orderBy("wide").rowsBetween(W.unboundedPreceding, -1)).alias("top"))
    lower = blocks.select("block", wide, "last").join(tops, "wide")
    before = F.max("last").over(W.partitionBy("wide").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    carried = lower.select("block", F.coalesce(before, "top").alias("carry")).join(latest, "block", "left")
    here = F.expr("element_at(filter(heads, h -> h <= at), -1)")
    return rows.join(carried, "block", "left").withColumn("head", F.coalesce(here, F.col("carry"))).drop("block", "carry", "heads")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), text, F.lit("\n"))


def format_conversations(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, reply_turn, position, n_quotes, n_linked, text and message."""
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = in_order(rows.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(""))), ["conv", "turn", "role", "text"], "at")
    firsts = rows.groupBy("conv").agg(F.min("at").alias("begin"), F.count("*").alias("n_messages"))
    quoting = settle(linked(rows.select("conv", "at", "text")))
    told = rows.join(firsts, "conv").join(quoting, "at", "left")
    turns = rows.select(F.col("at").alias("parent"), F.col("turn").alias("reply_turn"))
    told = told.join(turns, "parent", "left").withColumn("body", unquoted())
    branching = quoting.filter("parent < at - 1").select("at", "parent")
    rank = F.col("at") - F.col("begin")
    if not branching.isEmpty():
        heads = rows.select("conv", "at").join(firsts, "conv").join(branching.select("at", F.lit(True).alias("off")), "at", "left")
        segments = settle(_segments(heads.select("at", F.expr("off is not null or at = begin").alias("is_head"))).select("at", "head"))
        branches = settle(branching.join(segments.select(F.col("at").alias("parent"), F.col("head").alias("above")), "parent").select(F.col("at").alias("head"), "above", F.col("parent").alias("step")))
        within = branches.select(F.explode(F.array("head", "above")).alias("head")).distinct()
        lengths = segments.groupBy("head").agg(F.count("*").alias("n")).join(within, "head", "left_semi")
        told = told.join(segments, "at").join(_walk(branches, lengths), "head", "left")
        # a run without branches in a conversation without any has no place on a walk
        rank = F.when(F.col("behind").isNull(), rank).otherwise(F.col("n_messages") - F.col("behind") + F.col("at") - F.col("head"))
    told = told.withColumn("rank", rank)
    return told.select(
        "conv_id", "turn", "role", F.col("rank").alias("position"), "reply_turn", F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.col("body").alias("text"), rendered(F.col("role"), F.col("body")).alias("message"),
    )
