"""Markouts, weighted scores and baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators.asof import mids_at
from tidemark.sources.feeds import Feeds


def markouts(feeds: Feeds, taus: tuple[int, ...] | None = None) -> DataFrame:
    """Trades with ``pnl_<tau>``: the markout at each horizon, NULL where the mid is not known."""
    spec = feeds.spec
    taus = taus or spec.taus
    mids = mids_at(feeds.trades, "trade_id", feeds.book, spec, {f"m_{tau}": spec.us(tau) for tau in taus})
    rows = feeds.trades.join(mids, "trade_id", "left")
    return rows.withColumns({f"pnl_{tau}": X.markout_bps(F.col("price"), F.col("s"), F.col(f"m_{tau}"), spec.rebate_bps) for tau in taus}).drop(*[f"m_{tau}" for tau in taus])


def by_horizon(rows: DataFrame, taus: tuple[int, ...]) -> DataFrame:
    """One row per trade and horizon: ``tau, pnl`` instead of the columns ``pnl_<tau>``."""
    return rows.withColumn("_h", F.explode(F.array(*[F.struct(F.lit(t).alias("tau"), F.col(f"pnl_{t}").alias("pnl")) for t in taus]))).select(*[c for c in rows.columns if not c.startswith("pnl_")], "_h.tau", "_h.pnl")


def weighted_mean(x: Column, w: Column, where: Column | None = None) -> Column:
    """Sum of w x over sum of w where x is finite (and ``where`` holds); NULL without weight."""
    ok = X.finite(x) if where is None else X.finite(x) & where
    den = F.sum(F.when(ok, w))
    return F.when(den != 0, F.sum(F.when(ok, w * x)) / den)


def filter_metrics(pnl: Column, w: Column, f: Column, n_days: Column, spec, scale: float = 1.0) -> list[Column]:
    """Aggregates of a 0/1 filter ``f`` (1: not quoted): means with and without, score, kept turnover and shares.

    ``n_days`` counts all rows of the subset; sums only take rows with a finite markout.
    """
    ok = X.finite(pnl)
    keep = f == 0
    kept_w = F.sum(F.when(ok & keep, w))
    turnover = F.when(n_days > 0, F.coalesce(kept_w, F.lit(0.0)) * scale / n_days)
    all_, kept = weighted_mean(pnl, w), weighted_mean(pnl, w, keep)
    return [
        all_.alias("pnl_all"),
        kept.alias("pnl_kept"),
        weighted_mean(pnl, w, ~keep).alias("pnl_filtered"),
        (kept - all_).alias("score"),
        turnover.alias("turnover_per_day"),
        F.coalesce(turnover >= spec.turnover_min_per_day, F.lit(False)).alias("constraint_ok"),
        X.ratio(F.coalesce(F.sum(F.when(ok & ~keep, w)), F.lit(0.0)), F.sum(F.when(ok, w))).alias("frac_w"),
        X.ratio(F.count_if(ok & ~keep).cast("double"), F.count_if(ok)).alias("frac_n"),
        F.count_if(ok).alias("n"),
    ]


def metrics_of_sums(spec, scale: float = 1.0) -> list[Column]:
    """The columns of ``filter_metrics`` from sums over rows with a finite markout: ``n, sw, swp`` of all, ``kn, kw, kwp`` of those kept."""
    c = F.col
    turnover = F.when(c("n_days") > 0, F.coalesce(c("kw"), F.lit(0.0)) * scale / c("n_days"))
    all_, kept = X.ratio(c("swp"), c("sw")), X.ratio(c("kwp"), c("kw"))
    gone_w, gone_wp = c("sw") - F.coalesce(c("kw"), F.lit(0.0)), c("swp") - F.coalesce(c("kwp"), F.lit(0.0))
    return [
        all_.alias("pnl_all"),
        kept.alias("pnl_kept"),
        F.when(c("kn") < c("n"), X.ratio(gone_wp, gone_w)).alias("pnl_filtered"),
        (kept - all_).alias("score"),
        turnover.alias("turnover_per_day"),
        F.coalesce(turnover >= spec.turnover_min_per_day, F.lit(False)).alias("constraint_ok"),
        F.when(c("kn") < c("n"), X.ratio(gone_w, c("sw"))).otherwise(0.0).alias("frac_w"),
        X.ratio((c("n") - c("kn")).cast("double"), c("n")).alias("frac_n"),
        c("n"),
    ]


def evaluate_filter(rows: DataFrame, by: list[str], spec, scale: float = 1.0, pnl: str = "pnl", f: str = "f") -> DataFrame:
    """``filter_metrics`` of each group; ``n_days`` is the number of distinct calendar days of its rows."""
    days = F.count_distinct(X.day(F.col("t")))
    return rows.groupBy(*by).agg(*filter_metrics(F.col(pnl), F.col("w"), F.col(f), days, spec, scale), days.alias("n_days"))


def baselines(rows: DataFrame, spec, splits: tuple[str, ...] = ("train", "val")) -> DataFrame:
    """Per symbol, split and horizon: all-trade markout and turnover. Days count every trade of the split."""
    tall = by_horizon(rows.withColumn("split", X.split_label(F.col("t"), spec)).where(F.col("split").isin(*splits)), spec.taus)
    ok = X.finite(F.col("pnl"))
    days = F.count_distinct(X.day(F.col("t")))
    total = F.sum(F.when(ok, F.col("w")))
    return tall.groupBy("sym", "split", "tau").agg(F.count_if(ok).alias("n"), days.alias("n_days"), X.rounded(weighted_mean(F.col("pnl"), F.col("w"))).alias("pnl_all"), X.rounded(total / days, 0).alias("turnover_per_day"), X.rounded(total).alias("turnover"))
