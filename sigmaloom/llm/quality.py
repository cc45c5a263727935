"""Operator 2, quality rules: a short-circuit cascade.

Every rule is a Boolean column that says reject. On a bounded sample each rule is run by itself: that gives the share
of texts it rejects and, by the clock, its cost (in powers of two, so that noise seldom changes the order). Rules
run in the order of rejection per cost; a text leaves at the first rule that rejects it, later rules are not
evaluated for it (nested CASE). The order changes the work and the name of the first failed rule, never which
texts are kept.

Defined results: a null text is an empty one (0 words, fails the base rule); ties between rules go by name;
an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import math
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, words_of, written

SYMBOLS = "#*$%&|<>"
#: At most about so many rows are read to order the rules.
SAMPLE_ROWS = 2000
#: Times a rule runs over the sample while its cost is taken, and the least seconds that count.
REPEATS, LEAST_SECONDS = 10, 1 / 64


def once(value: Column, use) -> Column:
    """``use`` of ``value`` inside an expression, evaluated once: a lambda variable is bound, not repeated."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that stand twice or more in ``words``: windows sort as (hash, place), equal neighbours repeat."""
    last = F.size(words) - 3
    windows = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    twice = lambda s: F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
    places = F.transform(once(F.sort_array(windows), twice), lambda x: x["i"])
    covered = F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(i, i + 1, i + 2))))
    return F.when(last < 1, F.lit(0)).otherwise(F.size(covered))


def base_measures(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words), by built-in functions and without a shuffle."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    by_word = once(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words")))
    by_line = once(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    d = d.select("doc_id", "text", by_word.alias("w"), by_line.alias("l"))
    return d.select(
        "doc_id", "text", "w.n_words", "w.n_repeat_words", "l.n_lines", "l.n_dup_lines",
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Name -> rejects; some use the measures, others read the text."""
    n, text = F.col("n_words"), F.col("text")
    upper = F.length(F.regexp_replace(text, r"[^\p{Lu}]+", ""))
    lower = F.length(F.regexp_replace(text, r"[^\p{Ll}]+", ""))
    return {
        "symbols": 100 * F.col("n_symbols") > 10 * n,
        "duplicate_lines": 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
        "word_length": (F.col("word_chars") < 3 * n) | (F.col("word_chars") > 12 * n),
        "repeated_words": 100 * F.col("n_repeat_words") > 30 * n,
        "shouting": upper > lower,
        "exclamations": 10 * F.length(F.regexp_replace(text, "[^!]+", "")) > n,
        "few_letters": 2 * (upper + lower) < F.col("word_chars"),
    }


def rejected_and_cost(sample: DataFrame, found: dict[str, Column]) -> dict[str, tuple[float, float]]:
    """Name -> (share of the sample that the rule rejects, seconds that it takes), each rule run by itself; seconds without those of an idle rule."""
    many = sample.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def ran(rule: Column) -> tuple[float, float]:
        began = time.perf_counter()
        share = many.agg(F.avg(F.coalesce(rule, F.lit(False)).cast("int"))).first()[0]
        return share or 0.0, time.perf_counter() - began

    ran(F.col("_again") < 0)  # the first run compiles and reads
    idle = ran(F.col("_again") < 0)[1]
    took = {k: ran(rule) for k, rule in found.items()}
    return {k: (share, max(LEAST_SECONDS, seconds - idle)) for k, (share, seconds) in took.items()}


def cascade_order(measured: dict[str, tuple[float, float]]) -> list[str]:
    """Rule names by rejected share per cost (the nearest power of two), highest first, then by name."""
    return sorted(measured, key=lambda k: (-measured[k][0] / 2.0 ** round(math.log2(measured[k][1])), k))


def first_failed(found: dict[str, Column], order: list[str]) -> Column:
    """Name of the first rule in ``order`` that rejects, else null."""
    out = F.lit(None).cast("string")
    for name in reversed(order):
        out = F.when(found[name], F.lit(name)).otherwise(out)
    return out


def quality_cascade(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, measures, base_failed, failed_rule, kept): base rule first, then the cascade."""
    measured = base_measures(docs).withColumn("base_failed", base_failed())
    found = rules()
    rows = docs.select("doc_id").count()
    sample = docs if rows <= sample_rows else docs.sample(fraction=sample_rows / rows, seed=7)
    sample = base_measures(sample.select("doc_id", "text")).withColumn("base_failed", base_failed()).filter("not base_failed")
    order = cascade_order(rejected_and_cost(written(sample, "quality-sample"), found))
    failed = F.when(F.col("base_failed"), F.lit("base")).otherwise(first_failed(found, order))
    out = measured.withColumn("failed_rule", failed)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rule", F.col("failed_rule").isNull().alias("kept"))
