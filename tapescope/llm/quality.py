"""Quality rules: a table of thresholds compiled into one projection.

Every measure is a built-in expression over the text, every rule a comparison of
a measure with a number; the rules of a table become one boolean column.  No
user function and no shuffle.

The words of a text are interned once as an array.  Repeated five-word windows
are found by sorting (window, position) pairs inside the row, so a text of n
words costs n log n whatever it repeats.  Windows are compared by a 64-bit hash.

Defined cases: null and empty texts have no words and fail the base rule; ratios
whose denominator is 0 are 0; repeated rows each get their own row; columns of
the input other than doc_id and text are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Frequent function words of the four languages; a text in any of them has some.
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "that", "for", "with", "der", "die", "und", "das", "von", "ist", "zu", "le", "la", "les", "de",
              "et", "des", "un", "que", "el", "los", "en", "y", "una", "por")


@dataclass(frozen=True)
class Rule:
    """Documents whose ``measure`` lies outside [low, high] fail."""

    measure: str
    low: float | None = None
    high: float | None = None
    least_words: int = 0  # texts with fewer words pass


#: Wide limits: they reject junk, not unusual prose.
RULES = (
    Rule("mean_word_chars", 2.0, 20.0),
    Rule("symbol_ratio", high=0.30),
    Rule("dup_line_ratio", high=0.50),
    Rule("stop_words", low=1, least_words=50),
)


def repeated_words(words: Column, n: int = 5) -> Column:
    """Number of words inside ``n``-word windows that occur at least twice in ``words``."""
    def by_sorting(w: Column) -> Column:
        keys = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.struct(
            F.xxhash64(*[F.element_at(w, i + k) for k in range(n)]).alias("h"), i.alias("i")))
        ordered = F.array_sort(keys)

        def marked(pairs: Column) -> Column:
            same = F.filter(pairs, lambda x, j: (F.get(pairs, j - 1)["h"] == x["h"]) | F.coalesce(F.get(pairs, j + 1)["h"] == x["h"], F.lit(False)))
            return F.array_sort(F.transform(same, lambda x: x["i"]))

        # each window adds the words that the one before has not covered
        return F.aggregate(marked_let(ordered, marked), F.struct(F.lit(0).alias("n"), F.lit(-1_000_000_000).alias("last")), lambda acc, i: F.struct(
            (acc["n"] + F.least(F.lit(n), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"])

    return F.when(F.size(words) > n, by_sorting(words)).otherwise(F.lit(0)).cast("long")


def marked_let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id with every measure of the text; the array of words stays inside the row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.translate(line, SPACE, "") != "")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_text"), words.alias("_words"), lines.alias("_lines"))
    stops = F.array(*map(F.lit, STOP_WORDS))
    n = found.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        F.size(F.array_intersect(F.col("_words"), stops)).cast("long").alias("stop_words"))
    return n.withColumns({
        "mean_word_chars": _ratio("word_chars", "n_words"),
        "symbol_ratio": _ratio("n_symbols", "word_chars"),
        "dup_line_ratio": _ratio("n_dup_lines", "n_lines")})


def _ratio(above: str, below: str) -> Column:
    return F.when(F.col(below) > 0, F.col(above) / F.col(below)).otherwise(F.lit(0.0))


def compiled(rules: tuple[Rule, ...]) -> Column:
    """True where no rule is broken."""
    def passes(rule: Rule) -> Column:
        value = F.col(rule.measure)
        tests = [value >= rule.low] if rule.low is not None else []
        tests += [value <= rule.high] if rule.high is not None else []
        return reduce(lambda a, b: a & b, tests, F.lit(True)) | (F.col("n_words") < rule.least_words)

    return reduce(lambda a, b: a & b, map(passes, rules), F.lit(True))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures of every document, ``base_failed`` and ``kept``."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measures(docs).withColumn("base_failed", base).withColumn("kept", ~base & compiled(rules))
