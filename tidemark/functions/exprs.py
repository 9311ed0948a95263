"""Scalar expressions: pure functions from columns to columns. Missing is NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.spec import DAY_US, Spec


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where that is not finite."""
    return F.when(b != 0, a / b)


def floor_div(c: Column, n: int) -> Column:
    """Integer division rounding down, for negative numbers too."""
    n = F.lit(n).cast("long")
    return ((c - F.pmod(c, n)) / n).cast("long")


def trade_sign(side: Column) -> Column:
    return F.when(side == "buy", 1).otherwise(-1)


def mid(bid: Column, ask: Column) -> Column:
    return (bid + ask) / 2


def markout_bps(price: Column, s: Column, later_mid: Column, rebate: float) -> Column:
    """Maker's profit on a trade against a later mid, in basis points, with the rebate."""
    return -s * (later_mid - price) / price * 1e4 + rebate


def imbalance(bid: Column, ask: Column) -> Column:
    return F.when(bid + ask > 0, (bid - ask) / (bid + ask)).otherwise(0.0)


def microprice_bps(spread: Column, mid_: Column, obi: Column) -> Column:
    return (spread / 2) / mid_ * obi * 1e4


def distance_bps(s: Column, price: Column, mid_: Column) -> Column:
    return s * (price - mid_) / mid_ * 1e4


def return_bps(s: Column, now: Column, then: Column) -> Column:
    return s * (now - then) / then * 1e4


def acceleration(short: Column, long: Column, short_s: float = 30.0, long_s: float = 300.0) -> Column:
    """Rate in the short window over rate in the long one; NULL if nothing happened in the long one."""
    return F.when(long > 0, (short / short_s) / (long / long_s))


def second(t: Column, spec: Spec) -> Column:
    return floor_div(t, spec.us_per_s)


def hour_of_day(t: Column, spec: Spec) -> Column:
    return F.pmod(floor_div(t, spec.us(3600)), F.lit(24)).cast("double")


def is_weekend(t: Column, spec: Spec) -> Column:
    return (F.pmod(floor_div(t, spec.us(86_400)) + 3, F.lit(7)) >= 5).cast("double")


def minutes_to_funding(t: Column, spec: Spec) -> Column:
    period = 8 * 3600
    return F.pmod(period - F.pmod(second(t, spec), F.lit(period)), F.lit(period)).cast("double") / 60


def in_funding_window(t: Column, spec: Spec, margin: float = 5.0) -> Column:
    m = minutes_to_funding(t, spec)
    return ((m <= margin) | (m >= 480 - margin)).cast("double")


def day(t: Column) -> Column:
    return floor_div(t, DAY_US)


def minute(t: Column) -> Column:
    return floor_div(t, 60_000_000)


def month(t: Column) -> Column:
    """``YYYY-MM`` in UTC, whatever the session's zone."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), day(t).cast("int")), "yyyy-MM")


def split_label(t: Column, spec: Spec) -> Column:
    """The split of a time: windows are right-exclusive and lose the embargo at their trailing edge; else ``other``."""
    out = F.lit("other")
    for label, first, end in reversed(spec.split_windows()):
        out = F.when((t >= first) & (t < end - spec.embargo_us), label).otherwise(out)
    return out


def recency_weight(w: Column, age_days: Column, tau_days: float) -> Column:
    """Weight falling by a factor of e each ``tau_days``."""
    return w * F.exp(-age_days / tau_days)


def log_bin(c: Column, per_decade: int = 10) -> Column:
    return F.floor(F.log10(c) * per_decade).cast("long")


def keep_below(score: Column, cut) -> Column:
    """1 (filtered) where the score is known and below the cut, else 0."""
    return F.coalesce(score < cut, F.lit(False)).cast("int")


def place(cuts: Column, x: Column, size: int, up_to: bool = False) -> Column:
    """How many of the sorted ``cuts`` (``size`` at most) lie below ``x``, or with ``up_to`` at or below it, by bisection."""

    def step(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        cut = F.get(cuts, mid)
        right = (s["lo"] < s["hi"]) & ((cut <= x) if up_to else (cut < x))
        return F.struct(F.when(right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(right, s["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi"))
    return F.aggregate(F.array_repeat(F.lit(0), size.bit_length()), start, step, lambda s: s["lo"])


def pearson(x: Column, y: Column) -> Column:
    """Correlation of the pairs without a NULL; NULL where one side does not vary, which ``corr`` takes for an error."""
    both = x.isNotNull() & y.isNotNull()
    one = lambda c: F.when(both, c)
    return ratio(F.covar_pop(one(x), one(y)), F.stddev_pop(one(x)) * F.stddev_pop(one(y)))


def rounded(c: Column, digits: int = 4) -> Column:
    """Rounded for output, without a negative zero."""
    return F.round(c, digits) + 0.0
