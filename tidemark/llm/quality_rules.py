"""Quality rules with risk-controlled cutoffs, in DataFrame operations only.

Signals are counted natively over whole texts. Fixed base rules reject short and self-repeating texts. Further rules
compare a ratio with a cutoff that labelled documents select: for each stratum (a class of text length, so there is a
fixed number of them) and rule, the candidate cutoffs of a fixed grid are tested from the loosest on. The null hypothesis
"this cutoff rejects more than ``alpha`` of the good documents of the stratum" has the exact binomial p-value
P(Binomial(n, alpha) <= false rejections). A cutoff counts only if all looser ones were rejected too (fixed-sequence
testing holds the error over a rule's grid), at level ``delta`` / (strata x rules) (Bonferroni over the rest). With
``alpha`` = ``total_alpha`` / rules, in every stratum at most ``total_alpha`` of the good documents fail any rule, for all
strata at once with probability 1 - ``delta``. A rule without a certified cutoff rejects nothing.

Nulls: a null text has no words; documents without a label only take part in scoring. Repeated rows are scored
each, and a document with several labels counts for each. Empty tables give no rows, and empty labels certify nothing. Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of

#: What a split leaves between words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
REPEAT_PERCENT = 50
#: Strata by number of words: below each bound, and the rest.
STRATA = (50, 200, 1000)
#: Rule: numerator, denominator, and the cutoffs from the loosest to the tightest; a text fails if the ratio is above.
RULES = {
    "symbols": ("n_symbols", "n_words", (2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "dup_lines": ("n_dup_lines", "n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2)),
    "repeats": ("n_repeat_words", "n_words", (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15)),
    "word_length": ("word_chars", "n_words", (40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 12.0)),
}


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row: a lambda variable is not inlined."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found at least twice: equal windows are neighbours once sorted.

    Windows are sorted as one long each, 43 bits of a hash over 21 bits of position, and neighbours with equal hashes are
    compared word by word. Where such a comparison fails, or a text has too many words for the position, the
    windows themselves are sorted, so the count is exact.
    """
    tail = lambda a, k: F.slice(a, k, F.greatest(F.size(a), F.lit(1)))
    covered = lambda pairs: F.size(F.array_distinct(F.flatten(F.transform(pairs, lambda p: F.array(p[0], p[0] + 1, p[0] + 2, p[1], p[1] + 1, p[1] + 2)))))
    adjacent = lambda s, same: F.filter(F.zip_with(F.slice(s, 1, F.size(s) - 1), tail(s, 2), same), lambda p: p.isNotNull())

    def by_text(w: Column) -> Column:
        windows = F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.struct(F.concat_ws(" ", x, w[i + 1], w[i + 2]).alias("w"), i.alias("i")))
        return _let(F.sort_array(windows), lambda s: covered(adjacent(s, lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])))))

    def by_hash(w: Column) -> Column:
        windows = F.slice(F.arrays_zip(w, tail(w, 2), tail(w, 3)), 1, F.size(w) - 2)
        keys = F.sort_array(F.transform(windows, lambda x, i: F.shiftleft(F.xxhash64(x), 21).bitwiseOR(i.cast("long"))))
        place = lambda a: a.bitwiseAND(F.lit((1 << 21) - 1)).cast("int")
        pairs = _let(keys, lambda s: adjacent(s, lambda a, b: F.when(F.shiftright(a, 21) == F.shiftright(b, 21), F.array(place(a), place(b)))))
        equal = lambda p: (w[p[0]] == w[p[1]]) & (w[p[0] + 1] == w[p[1] + 1]) & (w[p[0] + 2] == w[p[1] + 2])
        return _let(pairs, lambda p: F.when(F.size(p) == 0, 0).when(F.forall(p, equal), covered(p)).otherwise(by_text(w)))

    return _let(words, lambda w: F.when(F.size(w) < 4, 0).when(F.size(w) < (1 << 21), by_hash(w)).otherwise(by_text(w)))


def signals(docs: DataFrame) -> DataFrame:
    """Counts of every whole text, with ``base_failed`` and the stratum; one row per row of ``docs``."""
    text = text_of(docs)
    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\f\r")) != "")
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup"))).alias("l"),
        _let(words, lambda w: F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("n_chars"), _repeat_words(w).alias("n_repeat"))).alias("w"),
    )
    rows = rows.select("doc_id", F.col("w.n_words").cast("long").alias("n_words"), F.col("w.n_chars").cast("long").alias("word_chars"), "n_symbols", F.col("l.n_dup").cast("long").alias("n_dup_lines"), F.col("w.n_repeat").cast("long").alias("n_repeat_words"), F.col("l.n_lines").cast("long").alias("n_lines"))
    stratum = F.lit(len(STRATA))
    for i, bound in reversed(list(enumerate(STRATA))):
        stratum = F.when(F.col("n_words") < bound, i).otherwise(stratum)
    return rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))).withColumn("stratum", stratum)


def _ratio(rule: str) -> Column:
    over, under, _ = RULES[rule]
    return F.coalesce(F.try_divide(F.col(over).cast("double"), F.col(under).cast("double")), F.lit(0.0))


def _binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), summed in logarithms so that large n do not underflow."""
    import math

    first = F.struct((n * math.log1p(-p)).alias("term"), F.exp(n * math.log1p(-p)).alias("total"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double")) + F.lit(math.log(p) - math.log1p(-p))
        return F.struct(term.alias("term"), (acc["total"] + F.exp(term)).alias("total"))

    below = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(below, first, step, lambda acc: acc["total"])


def certify(rows: DataFrame, labels: DataFrame, total_alpha: float, delta: float) -> DataFrame:
    """The tightest certified cutoff for each (stratum, rule); at most strata x rules rows."""
    alpha = total_alpha / len(RULES)
    level = delta / (len(RULES) * (len(STRATA) + 1))
    good = rows.join(labels.where(labels["quality"] == 1).select(labels["doc_id"].cast("long").alias("doc_id")), "doc_id")
    # False rejections at each cutoff, as one partial aggregation: a row per stratum.
    counts = [F.sum((_ratio(r) > c).cast("long")).alias(f"{r}_{i}") for r in RULES for i, c in enumerate(RULES[r][2])]
    by_stratum = good.where(~F.col("base_failed")).groupBy("stratum").agg(F.count("*").alias("n"), *counts)
    steps = [F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(float(c)).alias("cutoff"), F.col(f"{r}_{i}").alias("k")) for r in RULES for i, c in enumerate(RULES[r][2])]
    tests = by_stratum.select("stratum", "n", F.explode(F.array(*steps)).alias("t")).select("stratum", "n", "t.*")
    tests = tests.withColumn("p_value", _binomial_cdf(F.col("k"), F.col("n"), alpha)).withColumn("passed", F.col("p_value") <= level)
    stop = tests.groupBy("stratum", "rule").agg(F.min(F.when(~F.col("passed"), F.col("step"))).alias("stop"))
    kept = tests.join(stop, ["stratum", "rule"]).where(F.col("stop").isNull() | (F.col("step") < F.col("stop")))
    return kept.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def quality(docs: DataFrame, labels: DataFrame, total_alpha: float = 0.08, delta: float = 0.05) -> DataFrame:
    """Signals, verdicts and the rules that failed (``failed_rules``) of every document."""
    rows = materialize(signals(docs), "signals")
    cutoffs = certify(rows, labels, total_alpha, delta)
    # One row with a map of at most strata x rules cutoffs: a table of proven size.
    table = cutoffs.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("/", F.col("stratum").cast("string"), "rule"), "cutoff"))).alias("cutoffs"))
    failed = F.array_compact(F.array(*[F.when(_ratio(r) > F.col("cutoffs")[F.concat(F.col("stratum").cast("string"), F.lit(f"/{r}"))], F.lit(r)) for r in RULES]))
    scored = rows.crossJoin(F.broadcast(table)).withColumn("failed_rules", failed)
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), "stratum", "failed_rules")
