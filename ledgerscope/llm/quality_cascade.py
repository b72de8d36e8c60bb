"""Quality rules as a short-circuit cascade (op4). DataFrame functions only.

A rule is a condition that rejects a document. On a sample of about ``sample_rows`` rows every rule's cost (time of
a job that evaluates it alone, less that of an empty one) and selectivity (share of rows it rejects) are measured;
rules run in the order of rejections per cost, best first, as the branches of one CASE, so a document pays only for
the rules up to the first that rejects it. The verdict does not depend on the order.

The counts are made inside a row with array functions, without a shuffle. A word is covered by repetition when a
three-word window around it occurs at least twice in its text. Windows carry a hash in front of their words, so
sorting compares words only where hashes agree, and the result is exact. A text whose window hashes all differ
skips the sort.

Rows: null text has no words and fails. Very long texts take memory in proportion to the one text. Repeated rows
are judged each; an empty table gives an empty result; all given columns are kept by ``keep_good``, also if they are
named like the counts.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.session import materialize

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
Measure = Callable[[str], Column]


@dataclass(frozen=True)
class Rule:
    """``reject`` builds the rejecting condition from measures asked for by name."""

    name: str
    reject: Callable[[Measure], Column]


# The first two are the fixed base; the others are this cascade's own.
RULES = [
    Rule("few_words", lambda m: m("n_words") < 50),
    Rule("repetition", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
    Rule("symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule("capitals", lambda m: 2 * m("n_capitals") > m("word_chars")),
    Rule("repeated_lines", lambda m: (m("n_lines") >= 5) & (10 * m("n_dup_lines") > 7 * m("n_lines"))),
    Rule("long_words", lambda m: m("word_chars") > 20 * m("n_words")),
]
BASE = {"few_words", "repetition"}


def without(text: Column, chars: str) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), chars, text)


def words(text: Column) -> Column:
    one_gap = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), SPACES[1:], text)
    return F.array_remove(F.split(one_gap, " "), "")


def lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.length(without(x, SPACES)) > 0)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def n_repeat_words(ws: Column) -> Column:
    """Words inside three-word windows that occur at least twice in the array."""

    def per_window(x: Column, make: Callable[[Column, Column, Column, Column], Column]) -> Column:
        starts = F.slice(x, F.lit(1), F.greatest(F.size(x) - 2, F.lit(0)))
        return F.transform(starts, lambda w, i: make(w, F.get(x, i + 1), F.get(x, i + 2), i))

    def repeated(s: Column) -> Column:
        def same(v: Column, o: Column) -> Column:
            return F.coalesce((v["h"] == o["h"]) & (v["a"] == o["a"]) & (v["b"] == o["b"]) & (v["c"] == o["c"]), F.lit(False))

        met = F.transform(s, lambda v, i: F.when(same(v, F.get(s, i + 1)) | same(v, F.get(s, i - 1)), v["p"]))
        return F.sort_array(F.array_compact(met))

    def covered(p: Column) -> Column:
        # Each window covers three words, less those the next one covers again.
        new = F.transform(p, lambda v, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - v, F.lit(3))))
        return F.aggregate(new, F.lit(0).cast("long"), lambda s, v: s + v)

    def exact(x: Column) -> Column:
        windows = per_window(
            x,
            lambda a, b, c, i: F.struct(
                F.xxhash64(a, b, c).alias("h"), a.alias("a"), b.alias("b"), c.alias("c"), i.alias("p")
            ),
        )
        return bind(F.sort_array(windows), lambda s: bind(repeated(s), covered))

    def quick(x: Column, marks: Column) -> Column:
        return F.when(F.size(F.array_distinct(marks)) == F.size(marks), F.lit(0).cast("long")).otherwise(exact(x))

    return bind(ws, lambda x: bind(per_window(x, lambda a, b, c, i: F.xxhash64(a, b, c)), lambda m: quick(x, m)))


def measures(text: Column, ws: Column) -> dict[str, Column]:
    """Every measure by its name, over the text (not null) and its words."""
    return {
        "n_words": F.size(ws).cast("long"),
        "word_chars": F.length(without(text, SPACES)).cast("long"),
        "n_symbols": (F.length(text) - F.length(without(text, SYMBOLS))).cast("long"),
        "n_capitals": (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))).cast("long"),
        "n_lines": F.size(lines(text)).cast("long"),
        "n_dup_lines": bind(lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "n_repeat_words": n_repeat_words(ws),
    }


def prepared(docs: DataFrame, text: str) -> DataFrame:
    """``row``: the columns as given; ``text`` without nulls; ``words``."""
    base = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return base.withColumn("words", words(F.col("text")))


def lazily() -> Measure:
    made = measures(F.col("text"), F.col("words"))
    return made.__getitem__


def seconds(df: DataFrame, condition: Column) -> tuple[float, int]:
    """Time and rejected rows of one job over the sample; the better of two runs."""
    took = []
    for _ in range(2):
        start = time.perf_counter()
        rejected = df.agg(F.count_if(condition)).first()[0]
        took.append(time.perf_counter() - start)
    return min(took), rejected


def plan(docs: DataFrame, rules: list[Rule] = RULES, sample_rows: int = 2000, seed: int = 4, text: str = "text") -> list[Rule]:
    """The rules by rejections per cost on a sample, best first. The sample is drawn over the whole table."""
    total = docs.select(F.lit(1)).count()
    if total == 0:
        return list(rules)
    drawn = docs.select(F.col(text).alias("text")).sample(fraction=min(1.0, sample_rows / total), seed=seed)
    sample = materialize(drawn, "rule-sample")
    rows = max(1, sample.count())
    base, _ = seconds(prepared(sample, "text"), F.size("words") < 0)
    rated = []
    for rule in rules:
        cost, rejected = seconds(prepared(sample, "text"), rule.reject(lazily()))
        rated.append((rejected / rows / max(cost - base, 1e-3), rule))
    return [rule for _, rule in sorted(rated, key=lambda x: -x[0])]


def first_rejecting(order: list[Rule], measure: Measure) -> Column:
    """Name of the first rule of the order that rejects; null for a document all rules pass."""
    return F.coalesce(*[F.when(rule.reject(measure), F.lit(rule.name)) for rule in order])


def judge(docs: DataFrame, rules: list[Rule] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) per row.

    All counts are returned, so they are made once for every row and the cascade reads them.
    """
    order = plan(docs, rules, text=text)
    base = prepared(docs, text)
    made = measures(F.col("text"), F.col("words"))
    counted = base.select(F.col("row").getField(doc_id).alias("doc_id"), *[c.alias(n) for n, c in made.items()])
    bases = [r for r in rules if r.name in BASE]
    failed = reduce(lambda a, b: a | b, [r.reject(F.col) for r in bases]) if bases else F.lit(False)
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), first_rejecting(order, F.col).isNull().alias("kept"),
    )


def keep_good(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text") -> DataFrame:
    """The rows no rule rejects, with their columns. A rule's measures are made only where the cascade gets to it."""
    order = plan(docs, rules, text=text)
    return prepared(docs, text).where(first_rejecting(order, lazily()).isNull()).select("row.*")
