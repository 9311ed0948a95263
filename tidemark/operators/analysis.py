"""Conditional markouts, rules, thresholds and feature statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators.asof import indexed
from tidemark.operators.lineage import written
from tidemark.operators.markout import metrics_of_sums, weighted_mean
from tidemark.operators.quantiles import exact_quantiles, quantile


def quantile_breaks(rows: DataFrame, by: list[str], x: str, n: int) -> DataFrame:
    """``by, breaks``: the distinct exact quantiles at 1/n .. (n-1)/n of the finite values."""
    return exact_quantiles(rows, by, x, [k / n for k in range(1, n)], "breaks").withColumn("breaks", F.array_distinct("breaks"))


def with_bucket(rows: DataFrame, by: list[str], x: str, n: int) -> DataFrame:
    """``rows`` with a finite ``x``, and ``bucket``: the number of breaks below it, so that buckets are closed on the right."""
    breaks = F.broadcast(quantile_breaks(rows, by, x, n))  # a row of at most n - 1 numbers for each group
    return rows.where(X.finite(F.col(x))).join(breaks, by).withColumn("bucket", X.place(F.col("breaks"), F.col(x), n)).drop("breaks")


def conditional_markout(rows: DataFrame, by: list[str], x: str, pnl: str, n: int = 5) -> DataFrame:
    """Per bucket of ``x``: its range, rows, and weighted mean markout."""
    return with_bucket(rows, by, x, n).groupBy(*by, "bucket").agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count("*").alias("n"), weighted_mean(F.col(pnl), F.col("w")).alias("wpnl"))


def edge(rows: DataFrame, by: list[str], x: str, pnl: str, n: int = 5) -> DataFrame:
    """``by, edge, trend``: top bucket less bottom one, and the correlation of bucket and mean if all are known."""
    m = conditional_markout(rows, by, x, pnl, n)
    at = lambda k: F.max(F.when(F.col("bucket") == k, F.col("wpnl")))
    return m.groupBy(*by).agg((at(n - 1) - at(0)).alias("edge"), F.when(F.count("wpnl") == n, X.pearson(F.col("bucket").cast("double"), F.col("wpnl"))).alias("trend"))


def month_survival(rows: DataFrame, by: list[str], x: str, pnl: str, train: Column) -> DataFrame:
    """``by, months, survived``: months, and those whose edge has the sign of the training edge."""
    base = edge(rows.where(train), by, x, pnl).select(*by, F.signum("edge").alias("base"))
    monthly = edge(rows.withColumn("month", X.month(F.col("t"))), [*by, "month"], x, pnl)
    return monthly.join(base, by).groupBy(*by).agg(F.count("*").alias("months"), F.count_if(F.signum("edge") == F.col("base")).alias("survived"))


def weighted_sums(x: Column, y: Column, w: Column) -> dict[str, Column]:
    ok = X.finite(x) & X.finite(y)
    part = lambda v: F.sum(F.when(ok, v))
    return {"sw": part(w), "sx": part(w * x), "sy": part(w * y), "sxy": part(w * x * y), "sxx": part(w * x * x), "syy": part(w * y * y)}


def weighted_corr(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """``by, corr, direction``: the weighted correlation, and the sign of the covariance (+1 for zero)."""
    s = rows.groupBy(*by).agg(*[v.alias(k) for k, v in weighted_sums(F.col(x), F.col(y), F.col("w")).items()])
    cov = F.expr("sxy / sw - (sx / sw) * (sy / sw)")
    sd = lambda a, aa: F.sqrt(F.greatest(F.expr(f"{aa} / sw - ({a} / sw) * ({a} / sw)"), F.lit(0.0)))
    return s.where("sw > 0").select(*by, (cov / (sd("sx", "sxx") * sd("sy", "syy") + 1e-12)).alias("corr"), F.when(cov >= 0, 1).otherwise(-1).alias("direction"))


def missingness(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """``by, feature, missing``: the share of rows without a finite value."""
    shares = rows.groupBy(*by).agg(*[F.avg((~X.finite(F.col(c))).cast("double")).alias(c) for c in columns])
    return shares.unpivot(by, columns, "feature", "missing")


def fit_keep_best(train: DataFrame, by: list[str], x: str, pnl: str, keep: float) -> DataFrame:
    """``by, direction, cut``: the rule that keeps the best share ``keep`` by the signed feature."""
    direction = F.broadcast(weighted_corr(train, by, x, pnl).select(*by, "direction"))
    signed = train.join(direction, by).withColumn("_signed", F.col("direction") * F.col(x))
    return quantile(signed, [*by, "direction"], "_signed", 1 - keep, "cut")


def apply_keep_best(rows: DataFrame, rule: DataFrame, by: list[str], x: str) -> DataFrame:
    return rows.join(F.broadcast(rule), by).withColumn("f", X.keep_below(F.col("direction") * F.col(x), F.col("cut"))).drop("direction", "cut")


def threshold_curve(rows: DataFrame, by: list[str], score: str, spec, n: int = 50, scale: float = 1.0) -> DataFrame:
    """Metrics of the rule "filter below the cut" at ``n`` quantiles of the score, equal ones once.

    Each row is dealt once, between the cuts; what a cut keeps is then a sum over at most n + 1 bins.
    """
    known = rows.where(X.finite(F.col(score)) & X.finite(F.col("pnl"))).select(*by, "t", "w", "pnl", F.col(score).alias("_score"))
    cuts = exact_quantiles(known, by, "_score", [k / n for k in range(n)], "cuts").withColumn("cuts", F.array_distinct("cuts"))
    days = F.broadcast(known.groupBy(*by).agg(F.count_distinct(X.day(F.col("t"))).alias("n_days")))
    bins = known.join(F.broadcast(cuts), by).groupBy(*by, "cuts", X.place(F.col("cuts"), F.col("_score"), n, up_to=True).alias("bin")).agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("pnl")).alias("wp"))
    tried = bins.select(*by, "bin", "n", "w", "wp", F.posexplode("cuts").alias("at", "thr")).withColumn("keep", F.col("bin") > F.col("at"))
    part = lambda c: F.sum(F.when(F.col("keep"), F.col(c)))
    sums = tried.groupBy(*by, "thr").agg(F.sum("n").alias("n"), F.sum("w").alias("sw"), F.sum("wp").alias("swp"), F.coalesce(part("n"), F.lit(0)).alias("kn"), part("w").alias("kw"), part("wp").alias("kwp"))
    return sums.join(days, by).select(*by, "thr", *metrics_of_sums(spec, scale), "n_days")


def threshold_cv(rows: DataFrame, by: list[str], score: str, spec, n_splits: int = 5, n_candidates: int = 60, min_keep: float = 0.05, scale: float = 1.0, embargo_us: int | None = None) -> DataFrame:
    """``by, thr, cv``: the cut with the best mean score over contiguous blocks of time, purged at their inner edges.

    Rows with finite score and markout are cut into ``n_splits`` blocks of equal count by (t, seq); rows within the embargo of an
    inner edge of their block go. A candidate counts only if in every block it keeps enough turnover and enough rows. Of
    equal ones the smallest wins. A group without such rows has no row; if no candidate counts, the lowest one with -inf.
    """
    embargo = spec.embargo_us if embargo_us is None else embargo_us
    known = written(indexed(rows.where(X.finite(F.col(score)) & X.finite(F.col("pnl"))).select(*by, "t", "seq", "w", "pnl", F.col(score).alias("score")), by, spec.bucket_us))
    sizes = known.groupBy(*by).agg(F.count("*").alias("n_all"))
    cuts = exact_quantiles(known, by, "score", [k * 0.99 / (n_candidates - 1) for k in range(n_candidates)], "cuts").withColumn("cuts", F.array_distinct("cuts"))
    fixed = F.broadcast(sizes.join(cuts, by))  # a row for each group
    k = lambda i: F.floor(F.col("n_all") * i / n_splits)
    block = sum(((F.col("idx") >= k(i)).cast("int") for i in range(1, n_splits)), F.lit(0))
    rows_ = known.join(fixed, by).withColumn("blk", block)
    ends = F.broadcast(rows_.groupBy(*by, "blk").agg(F.min("t").alias("t0"), F.max("t").alias("t1")))
    inner = ((F.col("blk") == 0) | (F.col("t") - F.col("t0") >= embargo)) & ((F.col("blk") == n_splits - 1) | (F.col("t1") - F.col("t") >= embargo))
    purged = rows_.join(ends, [*by, "blk"]).where(inner)
    # One row per bin and day: a cut's sums are those of the bins above it.
    bins = purged.groupBy(*by, "blk", "cuts", X.place(F.col("cuts"), F.col("score"), n_candidates, up_to=True).alias("bin"), X.day(F.col("t")).alias("day")).agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("pnl")).alias("wp"))
    tried = bins.select(*by, "blk", "bin", "day", "n", "w", "wp", F.posexplode("cuts").alias("at", "thr")).withColumn("keep", F.col("bin") > F.col("at"))
    part = lambda c: F.sum(F.when(F.col("keep"), F.col(c)))
    grid = tried.groupBy(*by, "blk", "thr").agg(F.sum("n").alias("n_blk"), F.count_distinct("day").alias("days"), F.sum("w").alias("sw"), F.sum("wp").alias("swp"), part("n").alias("n_kept"), part("w").alias("kw"), part("wp").alias("kwp"))
    ok = F.coalesce((F.col("kw") * scale / F.col("days") >= spec.turnover_min_per_day) & (F.col("n_kept") / F.col("n_blk") >= min_keep) & (F.col("kw") > 0), F.lit(False))
    scored = grid.groupBy(*by, "thr").agg(F.avg(X.ratio(F.col("kwp"), F.col("kw")) - X.ratio(F.col("swp"), F.col("sw"))).alias("cv"), F.min(ok.cast("int")).alias("ok"))
    value = F.when(F.col("ok") == 1, F.col("cv")).otherwise(float("-inf"))
    return scored.groupBy(*by).agg(F.max_by(F.struct("thr", value.alias("cv")), F.struct(value, -F.col("thr"))).alias("b")).select(*by, "b.thr", "b.cv")


def calibration(rows: DataFrame, by: list[str], score: str, pnl: str, n: int = 10) -> DataFrame:
    """Mean score against the weighted mean markout of each score bucket."""
    both = rows.where(X.finite(F.col(pnl)))
    return with_bucket(both, by, score, n).groupBy(*by, "bucket").agg(F.avg(score).alias("mean_score"), weighted_mean(F.col(pnl), F.col("w")).alias("wpnl"), F.count("*").alias("n"))


def regime_by_month(rows: DataFrame, x: str, vol: str, taus: tuple[int, ...]) -> DataFrame:
    """Per symbol and month: rows, median volatility, and for each horizon the mean markout and the quintile edge of ``x``."""
    monthly = rows.withColumn("month", X.month(F.col("t")))
    out = monthly.groupBy("sym", "month").agg(F.count("*").alias("n"), *[weighted_mean(F.col(f"pnl_{t}"), F.col("w")).alias(f"pnl_all_{t}") for t in taus])
    out = out.join(quantile(monthly, ["sym", "month"], vol, 0.5, "median_vol"), ["sym", "month"], "left")
    for t in taus:
        out = out.join(edge(monthly, ["sym", "month"], x, f"pnl_{t}").select("sym", "month", F.col("edge").alias(f"edge_{t}")), ["sym", "month"], "left")
    return out


def summarize(folds: DataFrame, by: list[str]) -> DataFrame:
    """Walk-forward results: mean, sample deviation and worst score, number of folds, and whether all met the constraint."""
    return folds.groupBy(*by).agg(F.avg("score").alias("mean_score"), F.stddev_samp("score").alias("std_score"), F.min("score").alias("min_score"), F.count("*").alias("n_folds"), F.every("constraint_ok").alias("all_ok"))


def pick_n(sweep: DataFrame, tol: float = 0.02) -> DataFrame:
    """The smallest set whose score is within ``tol`` of the best: columns ``n_selected, internal_score``."""
    best = sweep.agg(F.max("internal_score").alias("best"))
    return sweep.crossJoin(F.broadcast(best)).where(F.col("internal_score") >= F.col("best") - tol).orderBy("n_selected").limit(1).drop("best")


def select_features(importance: DataFrame, n: int) -> DataFrame:
    """The best feature of each cluster, the ``n`` most important of them: columns ``feature, cluster, importance``."""
    rank = Window.partitionBy("cluster").orderBy(F.desc("importance"), "feature")
    return importance.withColumn("r", F.row_number().over(rank)).where("r = 1").drop("r").orderBy(F.desc("importance"), "feature").limit(n)
