"""The 73 features of a trade, and the panel with labels and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators import events as E
from tidemark.operators import grid as G
from tidemark.operators.asof import asof, indexed, mids_at, rolling_blocks, windowed
from tidemark.operators.markout import markouts
from tidemark.sources.feeds import Feeds

VENUES = ("binance", "bybit")
#: Columns of the panel that are no features.
META = ("trade_id", "sym", "t", "seq", "side", "s", "price", "amount", "notional", "w", "day", "split")


def book_state(feeds: Feeds) -> DataFrame:
    """``trade_id`` with the book as of each trade. Before the first quote the first one's spread and amounts are taken, and after
    the last quote they stay; only ``mid`` is NULL in both cases."""
    spec = feeds.spec
    asked = feeds.trades.select("trade_id", "sym", F.col("t").alias("qt"))
    found = asof(asked, feeds.book, ["mid", "spread", "bid_amount", "ask_amount"], ["sym"], "qt", spec.bucket_us)
    first = feeds.book.groupBy("sym").agg(F.min_by(F.struct("spread", "bid_amount", "ask_amount"), F.struct("t", "seq")).alias("f"), F.max("t").alias("last_t"))
    out = found.join(F.broadcast(first), "sym", "left")
    return out.select("trade_id", F.when(F.col("qt") <= F.col("last_t"), F.col("mid")).alias("mid"), *[F.when(F.col("state_t").isNull(), F.col(f"f.{c}")).otherwise(F.col(c)).alias(c) for c in ("spread", "bid_amount", "ask_amount")])


def mid_changes(feeds: Feeds) -> DataFrame:
    """Quotes whose mid differs from the one before."""
    rows = rolling_blocks(indexed(feeds.book, ["sym"], feeds.spec.bucket_us), "idx", E.BLOCK, 1)
    before = F.lag("mid").over(Window.partitionBy("sym", "blk").orderBy("idx"))
    return rows.withColumn("_p", before).where("not ghost and _p is not null and _p != mid").select("sym", "t", "seq")


def book_dynamics(feeds: Feeds) -> DataFrame:
    """``trade_id, book_age_s, book_chg_rate_30s``: time since the mid last changed, and changes a second over 30 s."""
    spec = feeds.spec
    changes = mid_changes(feeds)
    age = E.seconds_since(feeds.trades, "trade_id", changes, spec).withColumnRenamed("since", "book_age_s")
    rate = windowed(feeds.trades, "trade_id", changes, {"chg": F.lit(1).cast("long")}, {"30": spec.us(30)}, ["sym"], spec.bucket_us)
    return age.join(rate, "trade_id").select("trade_id", "book_age_s", (F.col("chg_30") / 30.0).alias("book_chg_rate_30s"))


def calendar(feeds: Feeds) -> DataFrame:
    t, spec = F.col("t"), feeds.spec
    return feeds.trades.select("trade_id", X.hour_of_day(t, spec).alias("hour"), X.is_weekend(t, spec).alias("is_weekend"), X.minutes_to_funding(t, spec).alias("min_to_funding"), X.in_funding_window(t, spec).alias("in_funding_window"))


def venue_features(feeds: Feeds, venue: str) -> DataFrame:
    spec = feeds.spec
    state = E.last_state(feeds, venue)
    rows = E.liquidation_windows(feeds, venue).join(state, "trade_id").join(feeds.trades.select("trade_id", "s"), "trade_id")
    out = []
    for w in spec.liq_s:
        out += [F.col(f"net_{w}").alias(f"{venue}_liqpress_{w}s"), F.col(f"abs_{w}").alias(f"{venue}_liqabs_{w}s"), F.col(f"cnt_{w}").cast("double").alias(f"{venue}_liqcnt_{w}s"), (F.col("s") * F.col(f"net_{w}")).alias(f"{venue}_liqalign_{w}s")]
    short, long = spec.liq_s[-2], spec.liq_s[-1]
    out += [F.col("since").alias(f"dt_last_{venue}_liq_s"), X.acceleration(F.col(f"cnt_{short}").cast("double"), F.col(f"cnt_{long}").cast("double"), float(short), float(long)).alias(f"{venue}_liqaccel"), F.col("runlen").cast("double").alias(f"{venue}_liq_runlen"), F.col("z").alias(f"{venue}_liqz")]
    if venue == "bybit":
        out += [F.col("liq_price").alias("_price"), F.col("since").alias("_since")]
    return rows.select("trade_id", *out)


def features(feeds: Feeds, strict: bool = False) -> DataFrame:
    """``trade_id`` and the 73 features. ``strict`` reads the grid one second earlier, so that no quote after the trade enters."""
    spec = feeds.spec
    s, mid = F.col("s"), F.col("mid")
    rows = feeds.trades.select("trade_id", "s", "price").join(book_state(feeds), "trade_id")
    obi = X.imbalance(F.col("bid_amount"), F.col("ask_amount"))
    rows = rows.withColumns({"obi": obi, "obi_signed": obi * s, "micro_signed_bps": s * X.microprice_bps(F.col("spread"), mid, obi), "px_vs_mid_bps": X.distance_bps(s, F.col("price"), mid)})
    past = mids_at(feeds.trades, "trade_id", feeds.book, spec, {f"_m{w}": -spec.us(w) for w in spec.momentum_s})
    rows = rows.join(past, "trade_id").withColumns({f"ret_{w}s_signed": X.return_bps(s, mid, F.col(f"_m{w}")) for w in spec.momentum_s})
    grid = G.rolling(G.mid_grid(feeds), spec.vol_s)
    names = {f"rv_{w}": f"rv_{w}s" for w in spec.vol_s} | {f"ampl_{w}": f"ampl_{w}s" for w in spec.vol_s} | {"rskew_30": "rskew_30", "rskew_300": "rskew_300", "varratio_300": "varratio_300"}
    rows = rows.join(G.at_second(feeds.trades, "trade_id", grid, list(names), spec, strict).withColumnsRenamed(names), "trade_id")
    rows = rows.withColumns({"vol_ts_ratio": X.ratio(F.col("rv_5s"), F.col("rv_300s")), "vol_ts_ratio_mid": X.ratio(F.col("rv_30s"), F.col("rv_300s"))})
    rows = rows.join(book_dynamics(feeds), "trade_id")
    for venue in VENUES:
        rows = rows.join(venue_features(feeds, venue), "trade_id")
    cross = {}
    for w in spec.liq_s[1:]:
        gap = F.col(f"bybit_liqpress_{w}s") - F.col(f"binance_liqpress_{w}s")
        cross |= {f"xexch_liqpress_{w}s": gap, f"xexch_liqalign_{w}s": s * gap}
    basis = E.basis_bps(F.col("_price"), mid, F.col("_since"), spec.basis_stale_s)
    rows = rows.withColumns(cross | {"liq_lead_s": F.col("dt_last_binance_liq_s") - F.col("dt_last_bybit_liq_s"), "basis_bps": basis, "basis_signed_bps": s * basis})
    rows = rows.join(G.flow_features(feeds), "trade_id").join(calendar(feeds), "trade_id")
    return rows.drop("s", "price", "mid", "spread", "bid_amount", "ask_amount", "_price", "_since", *[f"_m{w}" for w in spec.momentum_s])


def feature_columns(panel: DataFrame) -> list[str]:
    """All columns that are neither about the trade itself nor labels or scores."""
    return [c for c in panel.columns if c not in META and not c.startswith(("pnl_", "score"))]


def panel(feeds: Feeds, strict: bool = False) -> DataFrame:
    """Trades with labels, features, day and split."""
    labelled = markouts(feeds).withColumns({"day": X.day(F.col("t")), "split": X.split_label(F.col("t"), feeds.spec)})
    return labelled.join(features(feeds, strict), "trade_id")
