"""As-of lookups, running totals and windowed sums, spread over time buckets.

There are few symbols and very many rows, so a window over a symbol alone would be one task. Rows are dealt by
(symbol, time bucket) instead; what a bucket needs from before it (the last state, or the totals so far) comes from a table with one
row for each bucket, made by partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.functions.exprs import floor_div
from tidemark.spec import DAY_US

_BEFORE = (Window.unboundedPreceding, -1)
_UP_TO = (Window.unboundedPreceding, 0)
#: Doubles as exact addends, and their totals: a sum and a difference of two totals keep all twelve digits.
ADDEND, TOTAL = "decimal(26,12)", "decimal(36,12)"


def asof(queries: DataFrame, states: DataFrame, payload: list[str], by: list[str], q_time: str = "qt", bucket_us: int = DAY_US, forward: bool = False) -> DataFrame:
    """Each query row with the payload of the last state at or before it (``forward``: the first at or after it).

    Of states at one time the last in ``seq`` counts (forward: the first). Adds ``state_t`` and the payload, NULL where there is none.
    """
    sign = -1 if forward else 1
    t, q = F.col("t") * sign, F.col(q_time) * sign
    s = states.select(*by, floor_div(t, bucket_us).alias("_b"), t.alias("_t"), F.lit(0).alias("_k"), (F.col("seq") * sign).alias("_seq"), F.struct(F.col("t").alias("state_t"), *payload).alias("_s"))
    rows = queries.select(*by, floor_div(q, bucket_us).alias("_b"), q.alias("_t"), F.lit(1).alias("_k"), F.lit(0).cast("long").alias("_seq"), F.struct(*queries.columns).alias("_q"))
    last = s.groupBy(*by, "_b").agg(F.max_by("_s", F.struct("_t", "_seq")).alias("_s"))
    asked = rows.select(*by, "_b").distinct()
    carry = last.join(asked, [*by, "_b"], "full").withColumn("_s", F.last("_s", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_b").rowsBetween(*_BEFORE)))
    carry = carry.where("_s is not null").select(*by, "_b", F.lit(-(1 << 62)).alias("_t"), F.lit(0).alias("_k"), F.lit(0).cast("long").alias("_seq"), "_s")
    all_ = s.unionByName(carry).unionByName(rows, allowMissingColumns=True)
    found = F.last("_s", ignorenulls=True).over(Window.partitionBy(*by, "_b").orderBy("_t", "_k", "_seq").rowsBetween(*_UP_TO))
    out = all_.withColumn("_s", found).where("_q is not null")
    return out.select("_q.*", "_s.state_t", *[F.col(f"_s.{c}").alias(c) for c in payload])


def bounds(feed: DataFrame, by: list[str], prefix: str = "") -> DataFrame:
    """First and last time of a feed: one row for each key."""
    return feed.groupBy(*by).agg(F.min("t").alias(f"{prefix}first_t"), F.max("t").alias(f"{prefix}last_t"))


def asof_mid(queries: DataFrame, book: DataFrame, spec, q_time: str = "qt") -> DataFrame:
    """Queries with ``mid``: NULL before the first quote and after the last one, where the mid is not known to hold."""
    found = asof(queries, book, ["mid"], ["sym"], q_time, spec.bucket_us)
    ends = bounds(book, ["sym"]).select("sym", "last_t")
    return found.join(F.broadcast(ends), "sym", "left").withColumn("mid", F.when(F.col(q_time) <= F.col("last_t"), F.col("mid"))).drop("last_t", "state_t")


def at_offsets(queries: DataFrame, offsets_us: dict[str, int]) -> DataFrame:
    """A row for each query and offset: ``off`` (its name) and ``qt``."""
    pairs = F.array(*[F.struct(F.lit(k).alias("off"), F.lit(v).cast("long").alias("d")) for k, v in offsets_us.items()])
    return queries.withColumn("_o", F.explode(pairs)).select(*queries.columns, F.col("_o.off").alias("off"), (F.col("t") + F.col("_o.d")).alias("qt"))


def mids_at(events: DataFrame, key: str, book: DataFrame, spec, offsets_us: dict[str, int], time: Column | None = None) -> DataFrame:
    """``key`` and the mid at each offset from its time, one column for each offset, in a single as-of pass."""
    asked = at_offsets(events.select(key, "sym", (time if time is not None else F.col("t")).alias("t")), offsets_us)
    found = asof_mid(asked, book, spec)
    return found.groupBy(key).agg(*[F.max(F.when(F.col("off") == k, F.col("mid"))).alias(k) for k in offsets_us])


def indexed(feed: DataFrame, by: list[str], bucket_us: int = DAY_US) -> DataFrame:
    """``feed`` with ``idx``, its place from 0 in (t, seq) order within ``by``."""
    b = floor_div(F.col("t"), bucket_us)
    rows = feed.withColumn("_b", b)
    counts = rows.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    ahead = counts.withColumn("_ahead", F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(*_BEFORE)), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("t", "seq")) - 1
    return rows.withColumn("_i", own).join(ahead, [*by, "_b"]).withColumn("idx", F.col("_ahead") + F.col("_i")).drop("_b", "_i", "_ahead")


def running(feed: DataFrame, values: dict[str, Column], by: list[str], bucket_us: int = DAY_US) -> DataFrame:
    """``by, t, seq`` and the running totals of ``values``, this row included. Finite doubles are added as decimals, without rounding."""
    rows = feed.select(*by, "t", "seq", floor_div(F.col("t"), bucket_us).alias("_b"), *[v.alias(k) for k, v in values.items()])
    doubles = [k for k, kind in rows.dtypes if k in values and kind == "double"]
    rows = rows.withColumns({k: F.when(X.finite(F.col(k)), F.col(k)).cast(ADDEND) for k in doubles})
    as_total = lambda k, c: F.col(c).cast(TOTAL) if k in doubles else F.col(c)
    totals = rows.groupBy(*by, "_b").agg(*[F.sum(k).alias(k) for k in values])
    w = Window.partitionBy(*by).orderBy("_b").rowsBetween(*_BEFORE)
    ahead = totals.select(*by, "_b", *[F.coalesce(F.sum(k).over(w), F.lit(0)).alias(f"_{k}") for k in values])
    own = Window.partitionBy(*by, "_b").orderBy("t", "seq").rowsBetween(*_UP_TO)
    within = rows.select(*by, "t", "seq", "_b", *[F.sum(k).over(own).alias(k) for k in values])
    return within.join(ahead, [*by, "_b"]).select(*by, "t", "seq", *[(as_total(k, k) + as_total(k, f"_{k}")).alias(k) for k in values])


def windowed(events: DataFrame, key: str, feed: DataFrame, values: dict[str, Column], windows_us: dict[str, int], by: list[str], bucket_us: int = DAY_US) -> DataFrame:
    """``key`` and, for each window, the sums of ``values`` of the feed over (t - window, t], named ``value_window``.

    Running totals are looked up as of t and as of t - window, so the cost does not grow with the window. They are exact, so that a
    sum depends on the rows in its window alone: not on what came before it, nor on their order.
    """
    totals = running(feed, values, by, bucket_us)
    doubles = [k for k, kind in totals.dtypes if kind.startswith("decimal")]
    asked = at_offsets(events.select(key, *by, "t"), {"now": 0} | {k: -v for k, v in windows_us.items()})
    found = asof(asked, totals, list(values), by, "qt", bucket_us)
    at = lambda off, v: F.coalesce(F.max(F.when(F.col("off") == off, F.col(v))), F.lit(0))
    total = lambda k, v: (at("now", v) - at(k, v)).cast("double") if v in doubles else at("now", v) - at(k, v)
    return found.groupBy(key).agg(*[total(k, v).alias(f"{v}_{k}") for k in windows_us for v in values])


def rolling_blocks(feed: DataFrame, index: str, block: int, halo: int) -> DataFrame:
    """``feed`` dealt into blocks of a dense index; the last ``halo`` rows of a block are also in the next one, marked ``ghost``.

    A window over (by, ``blk``) of up to ``halo`` preceding rows then sees all it needs; ghost rows are dropped afterwards.
    """
    own = floor_div(F.col(index), block)
    into = F.array_compact(F.array(F.struct(own.alias("blk"), F.lit(False).alias("ghost")), F.when(F.pmod(F.col(index), F.lit(block)) >= block - halo, F.struct((own + 1).alias("blk"), F.lit(True).alias("ghost")))))
    return feed.withColumn("_p", F.explode(into)).select(*feed.columns, "_p.blk", "_p.ghost")
