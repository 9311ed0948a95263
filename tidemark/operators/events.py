"""Operators over event sequences: streaks, z-scores, recency, staleness, cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators.asof import asof, indexed, rolling_blocks, windowed
from tidemark.sources.feeds import Feeds

BLOCK = 100_000


def run_length(feed: DataFrame, by: list[str]) -> DataFrame:
    """``feed`` with ``idx`` and ``runlen``: the length, signed by side, of the same-side streak that ends at each event.

    The streak begins at the last change of side, found as of each event by its index.
    """
    rows = indexed(feed, by)
    dealt = rolling_blocks(rows, "idx", BLOCK, 1)
    before = F.lag("sgn").over(Window.partitionBy(*by, "blk").orderBy("idx"))
    marked = dealt.withColumn("_p", before).where("not ghost").drop("blk", "ghost")
    changes = marked.where(F.col("_p").isNull() | (F.col("_p") != F.col("sgn"))).select(*by, F.col("idx").alias("t"), F.lit(0).alias("seq"), F.col("idx").alias("begin"))
    found = asof(marked.drop("_p"), changes, ["begin"], by, "idx", BLOCK)
    return found.withColumn("runlen", ((F.col("idx") - F.col("begin") + 1) * F.col("sgn")).cast("long")).drop("begin", "state_t")


def zscore(feed: DataFrame, value: str, by: list[str], window: int = 200, least: int = 20) -> DataFrame:
    """``feed`` with ``z``: (x - mean) / sd over the last ``window`` events, this one included; NULL before ``least`` of them."""
    rows = rolling_blocks(indexed(feed, by), "idx", BLOCK, window - 1)
    w = Window.partitionBy(*by, "blk").orderBy("idx").rowsBetween(-(window - 1), 0)
    x = F.col(value)
    z = F.when(F.count(x).over(w) >= least, X.ratio(x - F.avg(x).over(w), F.stddev_samp(x).over(w)))
    return rows.withColumn("z", z).where("not ghost").drop("blk", "ghost")


def liquidation_windows(feeds: Feeds, venue: str, windows: tuple[int, ...] | None = None) -> DataFrame:
    """``trade_id`` and net, abs and count of a venue's liquidations over (t - w, t] for each window."""
    spec = feeds.spec
    values = {"net": F.col("signed"), "abs": F.col("notional"), "cnt": F.lit(1).cast("long")}
    return windowed(feeds.trades, "trade_id", feeds.liquidations(venue), values, {str(w): spec.us(w) for w in windows or spec.liq_s}, ["sym"], spec.bucket_us)


def seconds_since(queries: DataFrame, key: str, feed: DataFrame, spec) -> DataFrame:
    """``key`` and ``since``: logical seconds since the last event at or before ``t``; NULL if there was none."""
    found = asof(queries.select(key, "sym", "t").withColumn("qt", F.col("t")), feed, [], ["sym"], "qt", spec.bucket_us)
    return found.select(key, ((F.col("qt") - F.col("state_t")) / float(spec.us_per_s)).alias("since"))


def last_state(feeds: Feeds, venue: str) -> DataFrame:
    """``trade_id`` with recency, streak, z-score and price of the venue's last liquidation at or before each trade."""
    spec = feeds.spec
    rows = run_length(feeds.liquidations(venue), ["sym"]).drop("idx")
    rows = zscore(rows, "notional", ["sym"]).select("sym", "t", "seq", "runlen", "z", F.col("price").alias("liq_price"))
    found = asof(feeds.trades.select("trade_id", "sym", F.col("t").alias("qt")), rows, ["runlen", "z", "liq_price"], ["sym"], "qt", spec.bucket_us)
    return found.select("trade_id", ((F.col("qt") - F.col("state_t")) / float(spec.us_per_s)).alias("since"), "runlen", "z", "liq_price")


def basis_bps(price, mid, since, stale_s: int):
    """Last liquidation price against the mid; 0 without one or when it is stale."""
    return F.coalesce(F.when(since <= stale_s, (price - mid) / mid * 1e4), F.lit(0.0))


def cascades(feeds: Feeds) -> DataFrame:
    """Sessions of both venues' liquidations by gap: ``sym, cascade, begin_t, end_t, n, sgn, n_sell``.

    A new session begins when the gap exceeds ``cascade_gap_s``; those under ``cascade_min_events`` events are dropped.
    """
    spec = feeds.spec
    events = tagged(feeds)
    out = events.groupBy("sym", "cascade").agg(F.min("t").alias("begin_t"), F.max("t").alias("end_t"), F.count("*").alias("n"), F.when(F.sum("sgn") >= 0, 1).otherwise(-1).alias("sgn"), F.count_if(F.col("side") == "sell").alias("n_sell"))
    return out.where(F.col("n") >= spec.cascade_min_events)


def tagged(feeds: Feeds) -> DataFrame:
    """Liquidations of both venues with ``cascade``, the time of the first event of their session."""
    spec = feeds.spec
    both = feeds.both().withColumn("seq", F.col("seq") * 2 + (F.col("venue") == "bybit").cast("long"))
    rows = indexed(both, ["sym"], spec.bucket_us)
    dealt = rolling_blocks(rows, "idx", BLOCK, 1)
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("sym", "blk").orderBy("idx"))
    marked = dealt.withColumn("_gap", gap).where("not ghost").drop("blk", "ghost")
    starts = marked.where(F.col("_gap").isNull() | (F.col("_gap") > spec.us(spec.cascade_gap_s))).select("sym", F.col("idx").alias("at"), F.col("t").alias("cascade"))
    found = asof(marked.drop("_gap"), starts.select("sym", F.col("at").alias("t"), F.lit(0).alias("seq"), "cascade"), ["cascade"], ["sym"], "idx", BLOCK)
    return found.drop("state_t", "idx")
