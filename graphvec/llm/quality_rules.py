r"""Quality rules as a short-circuit cascade, in DataFrame operations only.

Each rule is a condition that rejects a text, and does its own counting in it. On a sample of about ``SAMPLE_ROWS`` rows every
rule's share of rejected rows and its cost are estimated: the clock is read before and after the rule in every row, so that neither
starting jobs nor reading rows count. Rules then run in order
of rejection per cost in one CASE expression, which stops at the first that rejects: later rules aren't evaluated on that row. The order changes the work done
and the name of the rule that is reported, never the verdict.

Words are runs ``[^\x20\x09-\x0D]+``. Three-word windows are compared by 64-bit hashes within a text.

Defined cases: a null, empty or blank text has no words and is rejected as too short; a text of any length is counted whole, in the task that reads it; equal
rows get equal verdicts, and the sample takes rows, not ids, so that one id of many rows doesn't fill it; rules of equal rejection per cost keep their
listed order, as all do on an empty table, which gives no rows; columns of the input with the names of results are replaced, others travel along.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that costs and rejections are estimated on; verdicts use all rows.
SAMPLE_ROWS = 1000
MIN_WORDS = 50
MOST_REPEATED = 50
#: Columns that ``with_statistics`` adds, for reports; functions of the same names compute them.
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_TEXT = "coalesce(cast(text as string), '')"


def _let(value: str, name: str, body: str) -> str:
    """Evaluates ``value`` once and names it in ``body``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


_BLANK = r"\\x20\\x09-\\x0D"
_WORDS = f"regexp_extract_all({_TEXT}, '[^{_BLANK}]+', 0)"
_COVERED = "aggregate(p, named_struct('n', 0L, 'last', -3), (a, i) -> named_struct('n', a.n + least(3, i - a.last), 'last', i), a -> a.n)"
_SORTED = _let("sort_array(transform(h, (x, i) -> struct(x as x, i as i)))", "s", "sort_array(transform(filter(s, (e, j) -> coalesce(get(s, j - 1).x = e.x, false) or coalesce(get(s, j + 1).x = e.x, false)), e -> e.i))")
_REPEATS = _let("transform(sequence(0, size(w) - 3), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)))", "h", f"if(size(array_distinct(h)) = size(h), 0L, {_let(_SORTED, 'p', _COVERED)})")


def n_words() -> Column:
    return F.expr(f"cast(size({_WORDS}) as long)")


def n_repeat_words() -> Column:
    """Words inside any three-word window that the text has twice or more."""
    return F.expr(_let(_WORDS, "w", f"if(size(w) < 4, 0L, {_REPEATS})"))


def word_chars() -> Column:
    return F.expr(f"cast(length(regexp_replace({_TEXT}, '[{_BLANK}]+', '')) as long)")


def _occurrences(characters: str) -> Column:
    return F.expr(f"cast(regexp_count({_TEXT}, '[{characters}]') as long)")


def n_symbols() -> Column:
    return _occurrences("#*$%&|<>")


def n_dup_lines() -> Column:
    """Lines with a word that equal an earlier line."""
    return F.expr(_let(f"filter(split({_TEXT}, '\\\\n'), l -> l rlike '[^{_BLANK}]')", "l", "cast(size(l) - size(array_distinct(l)) as long)"))


def n_lines() -> Column:
    return F.expr(f"cast(size(split({_TEXT}, '\\\\n')) as long)")


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def default_rules() -> list[Rule]:
    words, chars, symbols, dup_lines, repeats = n_words(), word_chars(), n_symbols(), n_dup_lines(), n_repeat_words()
    return [
        Rule("too_short", words < MIN_WORDS),
        Rule("repeated_windows", repeats * 100 > words * MOST_REPEATED),
        Rule("symbols", symbols * 10 > chars),
        Rule("repeated_lines", dup_lines * 2 > n_lines()),
        Rule("capitals", _occurrences("A-Z") * 2 > chars),
        # more than 20 or fewer than 2 characters a word, counted once
        Rule("word_length", F.abs(F.try_divide(chars, words) - 11) > 9),
    ]


_CLOCK = "cast(reflect('java.lang.System', 'nanoTime') as long)"


def _timed(rule: Rule) -> Column:
    """Whether the rule rejects (r), and the clock before it, after it, and after it again. A function of an array evaluates these in
    order and keeps them from sharing parts."""
    clock = F.expr(_CLOCK)
    return F.get(F.transform(F.array(F.lit(0)), lambda _: F.struct(clock.alias("a"), rule.rejects.alias("r"), clock.alias("b"), rule.rejects.alias("s"), clock.alias("c"))), 0)


def estimate(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, rejected share, seconds for each row) on the sample, by rejection per cost."""
    n_rows = docs.count()
    if not n_rows or not rules:
        return [(r, 0.0, 0.0) for r in rules]
    sample = docs.sample(min(1.0, sample_rows / n_rows), seed=42)
    timed = sample.select(*(_timed(r).alias(f"t{i}") for i, r in enumerate(rules)))
    sums = [F.struct(F.sum(F.col(f"t{i}.r").cast("int")), F.sum(F.least(F.expr(f"t{i}.b - t{i}.a"), F.expr(f"t{i}.c - t{i}.b")))) for i in range(len(rules))]
    n, *found = timed.agg(F.count("*"), *sums).first()
    out = [(r, (k or 0) / max(n, 1), (t or 0) / max(n, 1) / 1e9) for r, (k, t) in zip(rules, found, strict=True)]
    return sorted(out, key=lambda x: -x[1] / max(x[2], 1e-9)) if n else out


def in_cascade(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows with failed_rule, the first of the rules that rejects (else null), and kept."""
    verdict = F.lit(None).cast("string")
    for r in reversed(rules):
        verdict = F.when(r.rejects, F.lit(r.name)).otherwise(verdict)
    return docs.drop("failed_rule", "kept").withColumn("failed_rule", verdict).withColumn("kept", F.col("failed_rule").isNull())


def cascade(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows with failed_rule and kept, by the rules in order of rejection per cost."""
    rules = default_rules() if rules is None else rules
    return in_cascade(docs, [r for r, _, _ in estimate(docs, rules, sample_rows)])


def with_statistics(docs: DataFrame) -> DataFrame:
    """The rows with the counts that the default rules make, and base_failed. The cascade doesn't need them."""
    counts = (n_words(), word_chars(), n_symbols(), n_dup_lines(), n_repeat_words())
    out = docs.drop(*STATISTICS, "base_failed").withColumns(dict(zip(STATISTICS, counts, strict=True)))
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED))
