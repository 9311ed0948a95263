"""The per-second grid: flow sums, forward-filled mids, rolling volatility, amplitude, skew and variance ratio."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators.asof import asof, rolling_blocks, windowed
from tidemark.sources.feeds import Feeds

BLOCK = 7200
HALO = 320


def flow_grid(feeds: Feeds) -> DataFrame:
    """``sym, sec`` with signed volume, volume and number of trades of each second that has any."""
    sec = X.second(F.col("t"), feeds.spec)
    return (feeds.trades if feeds.tape is None else feeds.tape).groupBy("sym", sec.alias("sec")).agg(F.sum(F.col("s") * F.col("amount")).alias("signed_vol"), F.sum("amount").alias("tot_vol"), F.count("*").cast("int").alias("cnt"))


def spine(ends: DataFrame, first: str, last: str) -> DataFrame:
    """Every second between two bounds of each symbol, made block by block so that no row expands without bound."""
    blocks = ends.withColumn("_k", F.explode(F.sequence(X.floor_div(F.col(first), BLOCK), X.floor_div(F.col(last), BLOCK))))
    return blocks.select("sym", F.explode(F.sequence(F.greatest(F.col(first), F.col("_k") * BLOCK), F.least(F.col(last), F.col("_k") * BLOCK + (BLOCK - 1)))).alias("sec"))


def dense_flow(grid: DataFrame) -> DataFrame:
    """The flow grid with a row for every second from the first to the last, zeros where nothing traded."""
    ends = grid.groupBy("sym").agg(F.min("sec").alias("s0"), F.max("sec").alias("s1"))
    return spine(ends, "s0", "s1").join(grid, ["sym", "sec"], "left").fillna(0, ["signed_vol", "tot_vol", "cnt"])


def mid_grid(feeds: Feeds) -> DataFrame:
    """``sym, sec, mid``: the last mid of each second, carried forward over seconds without quotes."""
    spec = feeds.spec
    rows = feeds.book.withColumn("sec", X.second(F.col("t"), spec))
    each = rows.groupBy("sym", "sec").agg(F.max_by("mid", F.struct("t", "seq")).alias("mid"))
    ends = each.groupBy("sym").agg(F.min("sec").alias("s0"), F.max("sec").alias("s1"))
    states = each.select("sym", F.col("sec").alias("t"), F.lit(0).alias("seq"), "mid")
    return asof(spine(ends, "s0", "s1"), states, ["mid"], ["sym"], "sec", BLOCK).drop("state_t")


def rolling(grid: DataFrame, vol_s: tuple[int, ...] = (5, 30, 300), skew_s: tuple[int, ...] = (30, 300), ratio_s: int = 300, lag: int = 10) -> DataFrame:
    """The mid grid with ``rv_<w>, ampl_<w>, rskew_<w>, varratio_<w>``; each is NULL until its window is full.

    Volatility is the sample deviation of 1-second log returns in basis points, amplitude the range of the mid against
    the mid, skew the adjusted sample skewness, and the ratio the variance of ``lag``-second returns over ``lag`` times
    that of 1-second returns.
    """
    rows = rolling_blocks(grid, "sec", BLOCK, HALO)
    order = Window.partitionBy("sym", "blk").orderBy("sec")
    rows = rows.withColumn("r", F.log(F.col("mid") / F.lag("mid").over(order))).withColumn("r10", F.log(F.col("mid") / F.lag("mid", lag).over(order)))
    # Moments are differences of running sums within a block, so their cost does not grow with the window.
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    powers = {f"{c}_{k}": F.coalesce(F.sum(F.pow(F.col(c), F.lit(float(k)))).over(so_far), F.lit(0.0)) for c, top in (("r", 3), ("r10", 2)) for k in range(1, top + 1)}
    rows = rows.withColumns(powers | {f"{c}_0": F.count(c).over(so_far) for c in ("r", "r10")})

    def within(c: str, k: int, w: int):
        return F.col(f"{c}_{k}") - F.coalesce(F.lag(f"{c}_{k}", w).over(order), F.lit(0))

    def central2(c: str, w: int):
        """Sum of squared deviations; what is below the rounding of the running sums is 0."""
        ss = within(c, 2, w) - within(c, 1, w) * within(c, 1, w) / w
        return F.when(ss > F.col(f"{c}_2") * 1e-12, ss).otherwise(0.0)

    full = lambda c, w, x: F.when(within(c, 0, w) == w, x)
    last = lambda w: order.rowsBetween(-(w - 1), 0)
    out = {}
    for w in vol_s:
        out[f"rv_{w}"] = full("r", w, F.sqrt(central2("r", w) / (w - 1)) * 1e4)
        out[f"ampl_{w}"] = F.when(F.count("mid").over(last(w)) == w, (F.max("mid").over(last(w)) - F.min("mid").over(last(w))) / F.col("mid") * 1e4)
    for w in skew_s:
        mean, m2 = within("r", 1, w) / w, central2("r", w) / w
        m3 = within("r", 3, w) / w - 3 * mean * within("r", 2, w) / w + 2 * mean * mean * mean
        out[f"rskew_{w}"] = full("r", w, F.when(m2 > 1e-20, m3 / F.pow(m2, F.lit(1.5)) * ((w * (w - 1)) ** 0.5 / (w - 2))))
    out[f"varratio_{ratio_s}"] = full("r10", ratio_s, full("r", ratio_s, X.ratio(central2("r10", ratio_s), lag * central2("r", ratio_s))))
    return rows.withColumns(out).where("not ghost").select("sym", "sec", "mid", *out)


def at_second(queries: DataFrame, key: str, grid: DataFrame, columns: list[str], spec, strict: bool = False) -> DataFrame:
    """``key`` and the grid's values at each query's second (``strict``: the one before), held at the grid's last second; NULL before it."""
    ends = grid.groupBy("sym").agg(F.max("sec").alias("s1"))
    sec = X.second(F.col("t"), spec) - (1 if strict else 0)
    asked = queries.select(key, "sym", "t").join(F.broadcast(ends), "sym", "left").select(key, "sym", F.least(sec, F.col("s1")).alias("sec"))
    return asked.join(grid.select("sym", "sec", *columns), ["sym", "sec"], "left").select(key, *columns)


def flow_windows(feeds: Feeds, windows: tuple[int, ...] | None = None) -> DataFrame:
    """``trade_id`` with net, total and count of trades over the ``w`` whole seconds before its own, NULL where the grid has not all of them."""
    spec = feeds.spec
    windows = windows or spec.flow_s
    grid = flow_grid(feeds)
    ends = grid.groupBy("sym").agg(F.min("sec").alias("s0"), F.max("sec").alias("s1"))
    seconds = grid.withColumns({"t": F.col("sec"), "seq": F.lit(0)})
    trades = feeds.trades.select("trade_id", "sym", X.second(F.col("t"), spec).alias("sec"))
    values = {"net": F.col("signed_vol"), "tot": F.col("tot_vol"), "n": F.col("cnt").cast("long")}
    sums = windowed(trades.withColumn("t", F.col("sec") - 1), "trade_id", seconds, values, {str(w): w for w in windows}, ["sym"], BLOCK)
    rows = trades.join(F.broadcast(ends), "sym").join(sums, "trade_id")
    out = []
    for w in windows:
        valid = (F.col("sec") - F.col("s0") - w >= 0) & (F.col("sec") <= F.col("s1") + 1)
        out += [F.when(valid, F.col(f"{v}_{w}")).alias(f"{v}_{w}") for v in values]
    return rows.select("trade_id", "sym", *out)


def flow_features(feeds: Feeds) -> DataFrame:
    """The ten flow features of each trade."""
    rows = flow_windows(feeds).join(feeds.trades.select("trade_id", "s"), "trade_id")
    out = []
    for w in feeds.spec.flow_s:
        net, tot, n = F.col(f"net_{w}"), F.col(f"tot_{w}"), F.col(f"n_{w}")
        known = net.isNotNull()
        tfi = F.when(known, F.when(tot > 0, net / tot).otherwise(0.0))
        out += [tfi.alias(f"tfi_{w}s"), (tfi * F.col("s")).alias(f"tfi_aligned_{w}s"), (n / float(w)).alias(f"trade_intensity_{w}s"), F.when(known, F.when(tot > 0, F.abs(net) / tot).otherwise(0.0)).alias(f"flow_imbalance_mag_{w}s"), (F.col("s") * net).alias(f"signed_vol_mom_{w}s")]
    return rows.select("trade_id", *out)
