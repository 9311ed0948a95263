"""Folds, walk-forward runs, and the scoring entry point."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators import ml
from tidemark.operators.analysis import threshold_cv
from tidemark.operators.lineage import written
from tidemark.operators.markout import evaluate_filter
from tidemark.operators.quantiles import quantile
from tidemark.sources import feeds as sources
from tidemark.sources.feeds import Feeds
from tidemark.spec import Spec, midnight

Fold = tuple[int, int, int, int]
#: From training rows, horizon and step to (scored rows of any panel, threshold by symbol).
FitFn = Callable[[DataFrame, int, int], tuple[Callable[[DataFrame], DataFrame], DataFrame]]


def month_starts(first: int, end: int) -> list[int]:
    """First moments of the months in [first, end), and ``end`` itself."""
    at = datetime.fromtimestamp(first / 1e6, UTC)
    year, month, out = at.year, at.month, []
    while (t := midnight(f"{year:04d}-{month:02d}-01")) < end:
        if t >= first:
            out.append(t)
        year, month = (year + 1, 1) if month == 12 else (year, month + 1)
    return [*out, end]


def walk_forward_folds(first: int, end: int, spec: Spec, n_oos: int = 3) -> list[Fold]:
    """Expanding training up to each of the last ``n_oos`` months, less the embargo; a partial month counts.

    A month with nothing before it cannot be tested, so only those that begin after ``first`` count.
    """
    edges = month_starts(first, end)
    months = [(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if a > first]
    return [(first, a - spec.embargo_us, a, b) for a, b in months[-n_oos:]]


def model_fit_fn(features: list[str], spec: Spec, kind: str = "mse", **options) -> FitFn:
    def fit_fn(train: DataFrame, tau: int, step: int):
        model = ml.fit(train, features, f"pnl_{tau}", kind, **options)
        scored = ml.predict(model, train, "score").withColumn("pnl", F.col(f"pnl_{tau}"))
        return lambda rows: ml.predict(model, rows, "score"), threshold_cv(scored, ["sym"], "score", spec, scale=step)

    return fit_fn


def run_walk_forward(panel: DataFrame, tau: int, fit_fn: FitFn, folds: list[Fold], spec: Spec, step: int = 1) -> DataFrame | None:
    """One row of metrics for each symbol and fold; folds without rows on either side are left out."""
    out = None
    for first, train_end, a, b in folds:
        train = panel.where((F.col("t") >= first) & (F.col("t") < train_end))
        test = panel.where((F.col("t") >= a) & (F.col("t") < b))
        if train.isEmpty() or test.isEmpty():
            continue
        predict, cuts = fit_fn(train, tau, step)
        scored = predict(test).join(F.broadcast(cuts.select("sym", "thr")), "sym", "left").withColumns({"f": X.keep_below(F.col("score"), F.coalesce("thr", F.lit(0.0))), "pnl": F.col(f"pnl_{tau}")})
        rows = evaluate_filter(scored.drop("score"), ["sym"], spec, step).withColumn("fold", F.lit(datetime.fromtimestamp(a / 1e6, UTC).strftime("%Y-%m")))
        out = rows if out is None else out.unionByName(rows)
    return out


def infer_symbol(*frames: DataFrame) -> str | None:
    """By the first ticker's name in any of the frames, else by the price level of the first; None without either."""
    for frame in frames:
        if "ticker" in frame.columns:
            row = frame.where("ticker is not null").select("ticker").first()
            for symbol in ("btc", "eth"):
                if row is not None and symbol in row["ticker"].lower():
                    return symbol
    price = quantile(frames[0].withColumn("_one", F.lit(1)), ["_one"], "price", 0.5, "price").first()
    return None if price is None else "btc" if price["price"] > 10_000 else "eth"


def time_unit(value: int, low: str = "2009-01-01", high: str = "2100-01-01") -> str | None:
    """The unit in which a timestamp lies between two dates: seconds, milliseconds, microseconds or nanoseconds."""
    for unit, per_us in (("seconds", 1_000_000), ("milliseconds", 1_000), ("microseconds", 1), ("nanoseconds", 0.001)):
        if midnight(low) <= value * per_us < midnight(high):
            return unit
    return None


def to_micros(timestamp, unit: str):
    """A timestamp column of a unit in microseconds."""
    return {"seconds": timestamp * 1_000_000, "milliseconds": timestamp * 1_000, "microseconds": timestamp, "nanoseconds": X.floor_div(timestamp, 1_000)}[unit].cast("long")


def model_path(folder: str, symbol: str, tau: int) -> str:
    return f"{folder}/model_{symbol}_{tau}"


def signal_frames(trades: DataFrame, bbo: DataFrame, liq_binance: DataFrame, liq_bybit: DataFrame, spec: Spec, models: str | None = None, filter_fn=None, thresholds: dict[int, float] | None = None, cost: float = 0.0, symbol: str | None = None) -> DataFrame:
    """``signal`` on the four raw frames of one symbol: ``seq`` (place of the trade in its frame), ``f_30``, ``f_120``, ``f_300``.

    ``models`` is a folder of ``ml.save``; the symbol is inferred where it is not given. Times of any unit are brought to microseconds.
    """
    sym = symbol or infer_symbol(trades, bbo)

    def placed(frame: DataFrame) -> DataFrame:
        first = frame.select("timestamp").first()
        unit = "microseconds" if first is None else time_unit(first["timestamp"]) or "microseconds"
        rows = frame.withColumns({"timestamp": to_micros(F.col("timestamp"), unit), "sym": F.lit(sym or ""), "seq": F.monotonically_increasing_id()})
        return written(rows)  # places are fixed once

    feeds = Feeds(sources.trades(placed(trades), spec), sources.book(placed(bbo)), sources.liquidations(placed(liq_binance), "binance", spec), sources.liquidations(placed(liq_bybit), "bybit", spec), spec)
    found = {}
    if models is not None and sym is not None and filter_fn is None:
        found = {tau: ml.load(trades.sparkSession, model_path(models, sym, tau))[0] for tau in spec.taus}
        found = {tau: m for tau, m in found.items() if m is not None}
    return signal(feeds, found, filter_fn, thresholds, cost).withColumnRenamed("trade_id", "seq")


def signal(feeds: Feeds, models: dict[int, ml.Model] | None = None, filter_fn=None, thresholds: dict[int, float] | None = None, cost: float = 0.0) -> DataFrame:
    """``trade_id, f_30, f_120, f_300``: 1 where a trade is filtered out.

    A ``filter_fn(feeds, tau)`` gives (trade_id, f) itself and must cover every trade once. Without it and without a model for
    each horizon all trades are kept.
    """
    taus, ids = feeds.spec.taus, feeds.trades.select("trade_id")
    if filter_fn is not None:
        n, out = ids.count(), ids
        for tau in taus:
            own = filter_fn(feeds, tau).select("trade_id", F.col("f").cast("tinyint").alias(f"f_{tau}"))
            if own.count() != n or own.join(ids, "trade_id", "left_semi").distinct().count() != n:
                raise ValueError(f"the filter for {tau} s does not give one value for each of the {n} trades")
            out = out.join(own, "trade_id")
        return out
    if not models or any(tau not in models for tau in taus):
        return ids.select("trade_id", *[F.lit(0).cast("tinyint").alias(f"f_{tau}") for tau in taus])
    from tidemark.operators.features import features

    rows = feeds.trades.join(features(feeds), "trade_id")
    for tau in taus:
        cut = (thresholds or {}).get(tau, models[tau].threshold)
        rows = ml.predict(models[tau], rows, f"score_{tau}").withColumn(f"f_{tau}", X.keep_below(F.col(f"score_{tau}"), F.lit(cost if cut is None else cut)).cast("tinyint"))
    return rows.select("trade_id", *[f"f_{tau}" for tau in taus])


def write_artifact(df: DataFrame, path: str) -> None:
    """Panels and grids are stored by symbol, so that a reader of one symbol reads only its files."""
    df.write.mode("overwrite").partitionBy("sym").parquet(path)


def read_artifact(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def markdown_table(df: DataFrame, limit: int = 200) -> str:
    """A report table; reports are summaries, so ``limit`` bounds what is printed, not what is computed."""
    rows = df.limit(limit).collect()
    cells = [[("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)) for v in r] for r in rows]
    head = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join(c) + " |" for c in cells])


def pivot_methods(scores: DataFrame, by: list[str], methods: list[str]) -> DataFrame:
    return scores.groupBy(*by).pivot("method", methods).agg(F.first("score"))
