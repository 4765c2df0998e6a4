"""Quality rules with risk-controlled cut-offs, in DataFrame functions only.

Each rule rejects a text whose ratio (symbols, repeats, ...) exceeds a cut-off.  Cut-offs are chosen
per stratum on labelled documents: going from lenient to strict through a fixed grid, a cut-off is
certified if the exact binomial bound shows its false rejection rate of good documents to be under
``risk / rules`` with confidence ``1 - fail / (rules * strata)``; the last one certified before the
first that isn't is used (fixed-sequence testing within a rule, Bonferroni over rules and strata).
So with confidence ``1 - fail`` no stratum loses more than ``risk`` of its good documents to these
rules.  Strata with fewer than ``LEAST_GOOD`` labelled good documents, for which nothing can be certified, are one stratum
together: there the guarantee is for the good documents of all of them as one population, not for each, and a small
stratum unlike the others can lose more.  Where labels are too few even so, nothing is rejected by these rules.

Defined results: null text has no words and fails the base rule; a null stratum is a stratum of its
own; repeated rows are repeated; the empty table gives an empty result; other columns are dropped.
Words of a window are compared by a 64-bit hash of the window within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

# What a word, a symbol and the base rule are.
GAP = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
LEAST_WORDS = 50
MOST_REPEATED = 50  # per 100 words

#: Ratios in parts of 10,000, as (numerator, denominator), and the grid of cut-offs, lenient first.
RULES = {
    "symbols": ("n_symbols", "n_words"),
    "marks": ("n_marks", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
}
LEAST_GOOD = 600
GRID = [9000, 8000, 7000, 6000, 5000, 4500, 4000, 3500, 3000, 2500, 2000, 1500, 1000, 700, 500]


def statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", stratum: str | None = "lang") -> DataFrame:
    """Counts per text, in one pass without shuffle.

    Windows of three words are hashed, and only texts in which two hashes are equal sort theirs with
    their places; each run of covered words is then counted once.  No step is quadratic in a text.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("null")) if stratum else F.lit("=")
    x = docs.select(F.col(id_column), key.alias("stratum"), F.coalesce(text_column, F.lit("")).alias("t"))
    x = x.withColumn("w", F.array_remove(F.split("t", GAP), ""))
    x = x.withColumn("lines", F.filter(F.split("t", "\n"), lambda s: s.rlike("[^\\x20\\x09-\\x0D]")))
    x = x.withColumn("g", F.transform("w", lambda v: F.xxhash64(v)))
    # the last two windows are short, so they equal none before them
    x = x.withColumn("h", F.transform("g", lambda v, i: F.xxhash64(v, F.get("g", i + 1), F.get("g", i + 2))))
    x = x.select(
        id_column, "stratum",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit("[!?]")).cast("long").alias("n_marks"),
        F.regexp_count("t", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda v, i: F.struct(v.alias("v"), i.alias("i"))))).alias("s"),
    )
    twice = F.filter("s", lambda e, i: (F.get("s", i + 1)["v"] == e["v"]) | ((i > 0) & (F.get("s", F.greatest(i - 1, F.lit(0)))["v"] == e["v"])))
    x = x.withColumn("at", F.sort_array(F.transform(twice, lambda e: e["i"])))
    covered = F.aggregate("at", F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")), lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])
    return x.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("s", "at")


def ratio(rule: str) -> Column:
    """A rule's ratio in parts of 10,000, rounded down; 0 without words."""
    top, below = RULES[rule]
    return F.coalesce(F.floor(F.expr(f"10000 * ({top}) / nullif({below}, 0)")), F.lit(0)).cast("long")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def binomial_tail(k: str, n: str, p: float) -> Column:
    """P(X <= k) for X of n trials at rate p, summed term by term in logarithms; 1 where k / n is over p."""
    term = f"(named_struct('t', a.t + case when j = 0 then 0D else ln((n - j + 1D) / j) + ln({p}D) - ln(1D - {p}D) end, 's', a.s))"
    step = term.replace("'s', a.s", f"'s', a.s + exp(a.t + case when j = 0 then 0D else ln((n - j + 1D) / j) + ln({p}D) - ln(1D - {p}D) end)")
    step = step.replace("n - j", f"{n} - j")
    return F.expr(f"case when {k} > {p}D * {n} then 1D else aggregate(sequence(0L, {k}), named_struct('t', {n} * ln(1D - {p}D), 's', 0D), (a, j) -> {step}, a -> a.s) end")


def pooled(stats: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``stats`` with the stratum ``''`` for all strata of few labelled good documents."""
    good = stats.join(labels.where("quality = 1").select(id_column).distinct(), id_column, "left_semi")
    large = good.groupBy("stratum").count().where(F.col("count") >= LEAST_GOOD).select("stratum", F.lit(True).alias("large"))
    return stats.join(large, "stratum", "left").withColumn("stratum", F.when(F.col("large"), F.col("stratum")).otherwise("")).drop("large")


def cutoffs(stats: DataFrame, labels: DataFrame, id_column: str = "doc_id", risk: float = 0.08, fail: float = 0.05) -> DataFrame:
    """One row per stratum with a certified cut-off per rule, null where none is.

    Counts of rejected good documents for every rule and cut-off come from one partial aggregation.
    """
    good = stats.join(labels.where("quality = 1").select(id_column).distinct(), id_column, "left_semi")
    counts = [F.count_if(ratio(r) > c).alias(f"{r}_{c}") for r in RULES for c in GRID]
    per = good.groupBy("stratum").agg(F.count("*").alias("n"), *counts)
    per = per.withColumn("strata", F.count("*").over(Window.partitionBy(F.lit(0))))  # as many rows as strata
    long = per.select("stratum", "strata", "n", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(i).alias("i"), F.lit(c).cast("long").alias("cut"), F.col(f"{r}_{c}").alias("k")) for r in RULES for i, c in enumerate(GRID)))).alias("x")).select("stratum", "strata", "n", "x.*")
    tested = long.withColumn("ok", binomial_tail("k", "n", risk / len(RULES)) <= F.lit(fail) / (len(RULES) * F.col("strata")))
    stops = tested.groupBy("stratum", "rule").agg(F.coalesce(F.min(F.when(~F.col("ok"), F.col("i"))), F.lit(len(GRID))).alias("stop"))
    grid = F.array(*(F.lit(c).cast("long") for c in GRID))
    chosen = stops.withColumn("cut", F.get(grid, F.when(F.col("stop") > 0, F.col("stop") - 1)))
    return chosen.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cut"))).alias(f"cut_{r}") for r in RULES))


def quality_rules(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", stratum: str | None = "lang", risk: float = 0.08, fail: float = 0.05) -> DataFrame:
    """Counts, base verdict and verdict of the certified rules per document."""
    stats = pooled(stash(statistics(docs, id_column, text_column, stratum), "rules"), labels, id_column)
    cuts = cutoffs(stats, labels, id_column, risk, fail)
    rejected = [F.coalesce(ratio(r) > F.col(f"cut_{r}"), F.lit(False)) for r in RULES]
    out = stats.join(cuts, "stratum", "left").withColumn("base_failed", base_failed())
    verdict = ~F.col("base_failed")
    for x in rejected:
        verdict = verdict & ~x
    rule = F.array_compact(F.array(*(F.when(x, F.lit(r)) for r, x in zip(RULES, rejected))))
    return out.select(id_column, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict.alias("kept"), F.array_join(rule, ",").alias("failed_rules"))
