"""Bars, histograms, audits, event studies and cascade anatomy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators.asof import asof, asof_mid, at_offsets, mids_at
from tidemark.operators.events import cascades, tagged
from tidemark.operators.grid import spine
from tidemark.operators.lineage import written
from tidemark.operators.markout import weighted_mean
from tidemark.operators.quantiles import quantile
from tidemark.sources.feeds import Feeds, validate_sorted


def _ohlc(x: str, prefix: str = "") -> list:
    order = F.struct("t", "seq")
    return [F.min_by(x, order).alias(f"{prefix}first"), F.max_by(x, order).alias(f"{prefix}last"), F.min(x).alias(f"{prefix}min"), F.max(x).alias(f"{prefix}max")]


def minute_bars_trades(feeds: Feeds) -> DataFrame:
    buy = F.col("side") == "buy"
    return feeds.trades.groupBy("sym", X.minute(F.col("t")).alias("minute")).agg(F.count("*").alias("n"), F.sum("amount").alias("amount"), F.sum("notional").alias("notional"), F.count_if(buy).alias("buy_n"), F.coalesce(F.sum(F.when(buy, F.col("notional"))), F.lit(0.0)).alias("buy_notional"), *_ohlc("price", "px_"))


def minute_bars_book(feeds: Feeds) -> DataFrame:
    rel = F.col("spread") / F.col("mid")
    return feeds.book.groupBy("sym", X.minute(F.col("t")).alias("minute")).agg(F.count("*").alias("n"), *_ohlc("mid", "mid_"), F.avg("spread").alias("spread"), F.avg(rel).alias("rel_spread"), F.avg("bid_amount").alias("bid_amount"), F.avg("ask_amount").alias("ask_amount"), F.count_if(F.col("bid_price") >= F.col("ask_price")).alias("crossed"), F.count_if(F.col("bid_price") == F.col("ask_price")).alias("locked"))


def log_histogram(rows: DataFrame, x: str, by: list[str]) -> DataFrame:
    """Exact counts in ten bins a decade, with the bins' edges."""
    return rows.where(F.col(x) > 0).groupBy(*by, X.log_bin(F.col(x)).alias("bin")).agg(F.count("*").alias("n")).withColumns({"bin_lo": F.pow(F.lit(10.0), F.col("bin") / 10.0), "bin_hi": F.pow(F.lit(10.0), (F.col("bin") + 1) / 10.0)})


def spread_histogram(feeds: Feeds) -> DataFrame:
    """Spread in basis points, clipped to 0 .. 50, in bins of 0.1."""
    bps = F.col("spread") / F.col("mid") * 1e4
    return feeds.book.groupBy("sym", F.floor(F.greatest(F.lit(0.0), F.least(bps, F.lit(50.0))) * 10 + 0.5).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def sampled_quantiles(rows: DataFrame, x: str, by: list[str], step: int, points: tuple[float, ...]) -> DataFrame:
    """Quantiles (linear) of every ``step``-th row in (t, seq) order."""
    from tidemark.operators.asof import indexed

    some = indexed(rows, by).where(F.col("idx") % step == 0)
    return some.groupBy(*by).agg(*[F.percentile(x, F.lit(p)).alias(f"q{round(p * 1000):03d}") for p in points])


def missing_minutes(feeds: Feeds) -> DataFrame:
    """Minutes between a symbol's first and last trade in which nothing traded."""
    present = feeds.trades.select("sym", X.minute(F.col("t")).alias("sec")).distinct()
    ends = present.groupBy("sym").agg(F.min("sec").alias("s0"), F.max("sec").alias("s1"))
    return spine(ends, "s0", "s1").join(present, ["sym", "sec"], "left_anti").withColumnRenamed("sec", "minute")


def anomalies(rows: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """Rows, equal times, exact duplicates over ``key``, and backward steps of time in the order of the feed."""
    each = rows.groupBy(*by, "t").agg(F.count("*").alias("c"), F.count_distinct(*key).alias("d"))
    found = each.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.col("c") - 1).alias("collisions"), F.sum(F.col("c") - F.col("d")).alias("duplicates"))
    return found.join(validate_sorted(rows, by=tuple(by)), by)


def daily_from_bars(bars: DataFrame) -> DataFrame:
    day = X.floor_div(F.col("minute"), 1440)
    return bars.groupBy("sym", day.alias("day")).agg(F.sum("n").alias("n"), F.sum("notional").alias("notional"), (F.sum("buy_notional") / F.sum("notional")).alias("buy_frac"))


def hourly_from_bars(bars: DataFrame) -> DataFrame:
    """Mean trades and notional a minute by hour of day."""
    return bars.groupBy("sym", F.pmod(X.floor_div(F.col("minute"), 60), F.lit(24)).alias("hour")).agg(F.avg("n").alias("mean_n"), F.avg("notional").alias("mean_notional"))


def burstiness(bars: DataFrame) -> DataFrame:
    return bars.groupBy("sym").agg(F.min("n").alias("min_n"), F.median("n").alias("median_n"), F.percentile("n", F.lit(0.99)).alias("p99_n"), F.max("n").alias("max_n"))


def venue_minutes(feeds: Feeds) -> DataFrame:
    """Notional by minute of both venues, zero where one is silent, over every minute from the first to the last."""
    one = lambda f, name: f.groupBy("sym", X.minute(F.col("raw_t")).alias("sec")).agg(F.sum("notional").alias(name))
    both = one(feeds.binance, "binance").join(one(feeds.bybit, "bybit"), ["sym", "sec"], "full")
    ends = both.groupBy("sym").agg(F.min("sec").alias("s0"), F.max("sec").alias("s1"))
    return spine(ends, "s0", "s1").join(both, ["sym", "sec"], "left").fillna(0.0).withColumnRenamed("sec", "minute")


def venue_corr(feeds: Feeds) -> DataFrame:
    return venue_minutes(feeds).groupBy("sym").agg(X.pearson(F.log1p("binance"), F.log1p("bybit")).alias("corr"), F.count("*").alias("minutes"))


def liquidation_markouts(feeds: Feeds, horizons: tuple[int, ...] = (30, 120, 300)) -> DataFrame:
    """Each liquidation with its signed move from the mid when it became known: ``ret_<h>`` in basis points."""
    spec = feeds.spec
    rows = feeds.both().withColumn("id", F.concat_ws("/", "venue", F.col("seq").cast("string")))
    mids = mids_at(rows, "id", feeds.book, spec, {"m0": 0} | {f"m{h}": spec.us(h) for h in horizons})
    out = rows.join(mids, "id")
    return out.withColumns({f"ret_{h}": F.col("sgn") * (F.col(f"m{h}") - F.col("m0")) / F.col("m0") * 1e4 for h in horizons}).drop("m0", *[f"m{h}" for h in horizons])


def liquidation_summary(feeds: Feeds, horizons: tuple[int, ...] = (30, 120, 300)) -> DataFrame:
    """Notional-weighted mean move by venue and symbol, for each side and for both (``ALL``)."""
    rows = liquidation_markouts(feeds, horizons).withColumn("h", F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"ret_{h}").alias("ret")) for h in horizons]))).select("venue", "sym", "side", "notional", "h.h", "h.ret")
    keys = [F.col(c) for c in ("venue", "sym", "side", "h")]
    grouped = rows.groupingSets([keys, [k for k in keys if k is not keys[2]]], *keys)
    return grouped.agg(F.count("ret").alias("n"), weighted_mean(F.col("ret"), F.col("notional")).alias("mean_ret")).withColumn("side", F.coalesce("side", F.lit("ALL")))


def liquidation_profile(feeds: Feeds, offsets_s: tuple[float, ...]) -> DataFrame:
    """Mean and median move of the mid against that at the event's own time, by venue, side and offset."""
    spec = feeds.spec
    rows = feeds.both().withColumn("id", F.concat_ws("/", "venue", F.col("seq").cast("string"))).select("id", "sym", "venue", "side", F.col("raw_t").alias("t"))
    base = asof_mid(rows.withColumn("qt", F.col("t")), feeds.book, spec).select("id", F.col("mid").alias("m0"))
    tall = asof_mid(at_offsets(rows, {str(o): spec.us(o) for o in offsets_s}), feeds.book, spec).join(base, "id")
    move = (F.col("mid") - F.col("m0")) / F.col("m0") * 1e4
    tall, by = tall.select("venue", "sym", "side", F.col("off").cast("double").alias("offset"), move.alias("move")), ["venue", "sym", "side", "offset"]
    return tall.groupBy(*by).agg(F.count("move").alias("n"), F.avg("move").alias("mean")).join(quantile(tall, by, "move", 0.5, "median"), by, "left")


def impact_by_size(feeds: Feeds, edges: tuple[float, ...], offsets_s: tuple[int, ...], least: int = 50) -> DataFrame:
    """Mean signed move by size of the liquidation and offset; buckets with fewer than ``least`` moves are left out."""
    rows = liquidation_markouts(feeds, offsets_s)
    size = sum(((F.col("notional") >= e).cast("int") for e in edges), F.lit(0))
    tall = rows.withColumn("size", size).unpivot(["size"], [f"ret_{o}" for o in offsets_s], "offset", "move")
    return tall.groupBy("size", F.regexp_extract("offset", "[0-9]+", 0).cast("int").alias("offset")).agg(F.count("move").alias("n"), F.avg("move").alias("mean")).where(F.col("n") >= least)


def trade_impact(feeds: Feeds, trades: DataFrame, offsets_s: tuple[float, ...]) -> DataFrame:
    """Signed move of the mid around trades against that at the trade, by symbol, side and offset."""
    spec = feeds.spec
    mids = mids_at(trades, "trade_id", feeds.book, spec, {"m0": 0} | {f"o{i}": spec.us(o) for i, o in enumerate(offsets_s)})
    rows = trades.select("trade_id", "sym", "side", "s").join(mids, "trade_id")
    tall = rows.unpivot(["sym", "side", "s", "m0"], [f"o{i}" for i in range(len(offsets_s))], "name", "m")
    move = F.col("s") * (F.col("m") - F.col("m0")) / F.col("m0") * 1e4
    offset = F.get(F.array(*[F.lit(float(o)) for o in offsets_s]), F.substring("name", 2, 9).cast("int"))
    return tall.withColumns({"move": move, "offset": offset}).groupBy("sym", "side", "offset").agg(F.count("move").alias("n"), F.avg("move").alias("mean"))


# Phases of a cascade, as window and centre in seconds from its begin.
PHASES = {"pre": (-30, 0, -12.0), "begin": (0, 5, 2.5), "middle": (5, 12, 8.0), "end": (12, 30, 18.0), "after": (30, 300, 120.0)}


def valid_cascades(feeds: Feeds) -> DataFrame:
    """Cascades with the mid at their begin; those without one are dropped."""
    rows = cascades(feeds).withColumn("qt", F.col("begin_t"))
    return asof_mid(rows, feeds.book, feeds.spec).withColumnRenamed("mid", "m0").where("m0 is not null").drop("qt")


def _around(feeds: Feeds, all_: DataFrame, points: list[tuple[str, float, int, int]]) -> DataFrame:
    """Means over cascades at points (name, centre, from, to) relative to their begin, in seconds.

    Book figures are read at the centre, trade and flow rates over the whole seconds [from, to), own notional over offsets
    [from, to). Denominators differ: moves count cascades with a valid mid there, book figures those with any quote, the
    rest all cascades.
    """
    from tidemark.operators.asof import windowed
    from tidemark.operators.grid import BLOCK, flow_grid

    spec = feeds.spec
    rows = written(all_.withColumn("id", F.concat_ws("/", "sym", F.col("cascade").cast("string"))).select("id", "sym", "cascade", "sgn", "m0", "begin_t"))
    at = F.array(*[F.struct(F.lit(n).alias("point"), F.lit(spec.us(c)).cast("long").alias("d"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for n, c, lo, hi in points])
    tall = rows.withColumn("_p", F.explode(at)).select("id", "sym", "sgn", "m0", "begin_t", "_p.point", "_p.lo", "_p.hi", (F.col("begin_t") + F.col("_p.d")).alias("qt"))
    found = asof(tall, feeds.book, ["mid", "spread", "bid_amount", "ask_amount"], ["sym"], "qt", spec.bucket_us)
    last = F.broadcast(feeds.book.groupBy("sym").agg(F.max("t").alias("last_t")))
    move = F.when(F.col("qt") <= F.col("last_t"), F.col("sgn") * (F.col("mid") - F.col("m0")) / F.col("m0") * 1e4)
    depth = F.col("bid_amount") + F.col("ask_amount")
    obi = F.col("sgn") * (F.col("bid_amount") - F.col("ask_amount")) / F.greatest(depth, F.lit(1e-9))
    book = found.join(last, "sym").groupBy("sym", "point").agg(F.avg(move).alias("move"), F.avg(F.col("spread") / F.col("mid") * 1e4).alias("spread_bps"), F.avg(depth * F.col("mid")).alias("depth_usd"), F.avg(obi).alias("obi_signed"), F.count("*").alias("n"))
    seconds = flow_grid(feeds).withColumns({"t": F.col("sec"), "seq": F.lit(0)})
    values = {"cnt": F.col("cnt").cast("long"), "vol": F.col("signed_vol")}
    ends = tall.withColumn("sec", X.second(F.col("begin_t"), spec)).withColumn("end", F.explode(F.array("lo", "hi"))).select(F.concat_ws("|", "id", "point", F.col("end").cast("string")).alias("key"), "id", "sym", "point", "sgn", "lo", "hi", "end", (F.col("sec") + F.col("end") - 1).alias("t"))
    totals = windowed(ends, "key", seconds, values, {"all": 1 << 40}, ["sym"], BLOCK)
    up_to = ends.join(totals, "key")
    sign = F.when(F.col("end") == F.col("hi"), 1).otherwise(-1)
    span = F.greatest(F.col("hi") - F.col("lo"), F.lit(1))
    rates = up_to.groupBy("sym", "point").agg(F.sum(sign * F.col("cnt_all") / span).alias("trades"), F.sum(sign * F.col("sgn") * F.col("vol_all") / span).alias("flow"))
    own = tagged(feeds).join(rows.select("sym", "cascade", "begin_t"), ["sym", "cascade"]).withColumn("off", (F.col("t") - F.col("begin_t")) / float(spec.us_per_s))
    spans = F.broadcast(feeds.trades.sparkSession.createDataFrame([(n, float(lo), float(hi), n == points[-1][0] and len(points) > len(PHASES)) for n, _, lo, hi in points], "point string, lo double, hi double, closed boolean"))
    inside = (F.col("off") >= F.col("lo")) & ((F.col("off") < F.col("hi")) | (F.col("closed") & (F.col("off") == F.col("hi"))))
    flows = own.join(spans, inside).groupBy("sym", "point").agg(*[F.sum(F.when(F.col("venue") == v, F.col("notional"))).alias(v) for v in ("binance", "bybit")])
    return book.join(rates, ["sym", "point"], "left").join(flows, ["sym", "point"], "left").fillna(0.0, ["binance", "bybit"])


def cascade_profile(feeds: Feeds, lo_s: int = -60, hi_s: int = 300, step_s: int = 5) -> DataFrame:
    """Figures of ``_around`` in bins of offset; the last bin of own notional is closed on the right."""
    points = [(str(o), o + step_s / 2, o, o + step_s) for o in range(lo_s, hi_s, step_s)]
    rows = _around(feeds, valid_cascades(feeds), points)
    return rows.select("sym", F.col("point").cast("int").alias("offset"), "move", "spread_bps", "depth_usd", "obi_signed", (F.col("trades") / F.col("n")).alias("trade_rate"), (F.col("flow") / F.col("n")).alias("flow_signed"), *[(F.col(v) / F.col("n")).alias(v) for v in ("binance", "bybit")], "n")


def cascade_phases(feeds: Feeds) -> DataFrame:
    """Figures of ``_around`` for the five phases; own notional is a sum."""
    rows = _around(feeds, valid_cascades(feeds), [(p, c, lo, hi) for p, (lo, hi, c) in PHASES.items()])
    return rows.select("sym", F.col("point").alias("phase"), "move", "spread_bps", "depth_usd", "obi_signed", (F.col("trades") / F.col("n")).alias("trade_rate"), (F.col("flow") / F.col("n")).alias("flow_signed"), "binance", "bybit")


def cascade_meta(feeds: Feeds) -> DataFrame:
    """Number of cascades, share of selling ones, median span, and median of the 5-second bin with most own notional."""
    spec = feeds.spec
    all_ = valid_cascades(feeds)
    own = tagged(feeds).join(all_.select("sym", "cascade", "begin_t"), ["sym", "cascade"])
    bins = F.least(F.floor((F.col("t") - F.col("begin_t")) / float(spec.us(5))), F.lit(59)).cast("long")
    own = own.where(F.col("t") - F.col("begin_t") <= spec.us(300))
    tops = own.groupBy("sym", "cascade", bins.alias("bin")).agg(F.sum("notional").alias("v")).groupBy("sym", "cascade").agg(F.max_by("bin", F.struct("v", -F.col("bin"))).alias("climax"))
    rows = all_.join(tops, ["sym", "cascade"])
    span = (F.col("end_t") - F.col("begin_t")) / float(spec.us_per_s)
    return rows.groupBy("sym").agg(F.count("*").alias("n"), F.avg((F.col("sgn") < 0).cast("double")).alias("sell_share"), F.median(span).alias("median_span"), F.median(F.col("climax") * 5 + 2.5).alias("median_climax"))


def phase_tags(feeds: Feeds, trades: DataFrame) -> DataFrame:
    """``trades`` with ``phase``: where a trade lies after the last begin of a cascade, or before the next one, which takes precedence."""
    spec = feeds.spec
    begins = cascades(feeds).select("sym", F.col("begin_t").alias("t"), F.lit(0).cast("long").alias("seq"), F.col("begin_t").alias("begin_t"))
    back = asof(trades.withColumn("qt", F.col("t")), begins, ["begin_t"], ["sym"], "qt", spec.bucket_us).drop("state_t")
    both = asof(back, begins.withColumnRenamed("begin_t", "next_t"), ["next_t"], ["sym"], "qt", spec.bucket_us, forward=True)
    since, ahead = F.col("t") - F.col("begin_t"), F.col("next_t") - F.col("t")
    within = lambda lo, hi: (since >= spec.us(lo)) & (since < spec.us(hi))
    phase = F.when(ahead <= spec.us(30), "pre")
    for name, lo, hi in (("begin", 0, 5), ("middle", 5, 12), ("end", 12, 30), ("after", 0, 300)):
        phase = phase.when(within(lo, hi), name)
    return both.withColumn("phase", phase.otherwise("quiet")).drop("qt", "begin_t", "next_t", "state_t")
