"""Exact quantiles of groups of any size.

``percentile`` holds every distinct value of a group in one task. Here a bounded sketch cuts each group's values into pieces, values
are counted by piece, and ranks are found within pieces; a value that many rows share is one row from the first shuffle on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import exprs as X

PIECES = 256


def exact_quantiles(rows: DataFrame, by: list[str], x: str, points: list[float], name: str = "values", pieces: int = PIECES) -> DataFrame:
    """``by`` and an array of the linearly interpolated quantiles of the finite values at ``points``; no row for a group without values.

    A negative zero counts as zero, so equal quantiles are equal in every bit.
    """
    known = rows.where(X.finite(F.col(x))).select(*by, (F.col(x).cast("double") + 0.0).alias("_x"))
    cuts = F.percentile_approx("_x", [k / pieces for k in range(1, pieces)], 20 * pieces)
    sketch = F.broadcast(known.groupBy(*by).agg(cuts.alias("_cuts"), F.count("*").alias("_n")))  # pieces numbers for each group
    counted = known.join(sketch, by).groupBy(*by, X.place(F.col("_cuts"), F.col("_x"), pieces).alias("_p"), "_x").agg(F.count("*").alias("_c"), F.first("_n").alias("_n"))
    so_far = F.sum("_c").over(Window.partitionBy(*by, "_p").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumn("_last", so_far - 1)
    ahead = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = counted.groupBy(*by, "_p").agg(F.sum("_c").alias("_size"), F.first("_n").alias("_n")).withColumn("_ahead", F.coalesce(F.sum("_size").over(ahead), F.lit(0)))
    at = [(F.col("_n") - 1) * F.lit(p) for p in points]  # not n p - p, which misses whole ranks by a bit
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(h).alias("hi"), f(a).cast("long").alias("rank"), (a - F.floor(a)).alias("part")) for i, a in enumerate(at) for h, f in ((0, F.floor), (1, F.ceil))])
    asked = sizes.withColumn("_w", F.explode(wanted)).where((F.col("_w.rank") >= F.col("_ahead")) & (F.col("_w.rank") < F.col("_ahead") + F.col("_size")))
    asked = asked.select(*by, "_p", "_w.i", "_w.hi", "_w.part", (F.col("_w.rank") - F.col("_ahead")).alias("_rank"))
    found = placed.join(F.broadcast(asked), [*by, "_p"]).where((F.col("_rank") <= F.col("_last")) & (F.col("_rank") > F.col("_last") - F.col("_c")))
    side = lambda h: F.max(F.when(F.col("hi") == h, F.col("_x")))
    each = found.groupBy(*by, "i").agg(side(0).alias("_lo"), side(1).alias("_hi"), F.max("part").alias("part"))
    value = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("part") + 0.0
    return each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", value.alias("v")))), lambda s: s["v"]).alias(name))


def quantile(rows: DataFrame, by: list[str], x: str, point: float, name: str) -> DataFrame:
    return exact_quantiles(rows, by, x, [point], name).withColumn(name, F.get(name, F.lit(0)))
