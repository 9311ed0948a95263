"""Structured Streaming forms of the event operators.

Availability delays are part of the event time, before the watermark; rows later than the watermark are dropped by Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.sources.feeds import micros
from tidemark.spec import Spec


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet*")


def _time(t: Column) -> Column:
    return F.timestamp_micros(t)


def flow_grid(events: DataFrame, spec: Spec, lateness: str = "10 minutes") -> DataFrame:
    """Per symbol and second: signed volume, volume and number of trades, as a tumbling window."""
    k = F.get_json_object("props", "$.k").cast("long")
    buy = F.col("event_type") == "purchase"
    rows = events.where(F.col("event_type").isin("purchase", "click")).select(F.when(F.col("user_id") % 2 == 0, "btc").otherwise("eth").alias("sym"), _time(micros(F.col("ts"))).alias("at"), F.when(buy, 1).otherwise(-1).alias("s"), ((1 + k) * 20).cast("double").alias("amount"))
    window = F.window("at", f"{spec.us_per_s} microseconds")
    out = rows.withWatermark("at", lateness).groupBy("sym", window.alias("win")).agg(F.sum(F.col("s") * F.col("amount")).alias("signed_vol"), F.sum("amount").alias("tot_vol"), F.count("*").cast("int").alias("cnt"))
    return out.select("sym", X.floor_div(F.unix_micros("win.start"), spec.us_per_s).alias("sec"), "signed_vol", "tot_vol", "cnt")


def sessions(events: DataFrame, spec: Spec, lateness: str = "1 hour") -> DataFrame:
    """Liquidation cascades of both venues as session windows: a gap of exactly the limit still belongs to the session."""
    delay = F.when(F.col("event_type") == "signup", spec.us(spec.bybit_delay_s)).otherwise(0)
    rows = events.where(F.col("event_type").isin("error", "signup")).select(F.when(F.col("user_id") % 2 == 0, "btc").otherwise("eth").alias("sym"), (micros(F.col("ts")) + delay).alias("t"), (F.col("event_id") % 2).alias("odd"))
    out = rows.withColumn("at", _time(F.col("t"))).withWatermark("at", lateness).groupBy("sym", F.session_window("at", f"{spec.us(spec.cascade_gap_s)} microseconds").alias("win"))
    return out.agg(F.min("t").alias("begin_t"), F.max("t").alias("end_t"), F.count("*").alias("n"), F.count_if(F.col("odd") == 1).alias("n_sell")).drop("win")


def liquidations_before(trades: DataFrame, liquidations: DataFrame, spec: Spec, seconds: int, lateness: str = "10 minutes") -> DataFrame:
    """Interval join of two streams with columns ``sym`` and ``at``: liquidations in (at - seconds, at] of each trade."""
    a = trades.withWatermark("at", lateness).alias("a")
    b = liquidations.withWatermark("at", lateness).alias("b")
    span = F.expr(f"b.at <= a.at and b.at > a.at - interval {spec.us(seconds) // 1_000_000} seconds")
    return a.join(b, (F.col("a.sym") == F.col("b.sym")) & span, "leftOuter")


def asof_mid(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Trades with the last mid of their symbol at or before them, as a state per symbol: columns ``sym, t, seq, mid, is_quote``.

    Rows of a symbol wait until the watermark has passed them and are then read in the order (t, quotes first, seq). What a
    symbol keeps is its last mid and the rows within the lateness.
    """
    import pandas as pd

    def step(key, frames, state):
        held, mid = (pd.DataFrame(list(state.get[0]), columns=["t", "is_quote", "seq", "mid"]), state.get[1]) if state.exists else (None, None)
        rows = pd.concat([x for x in ([held] if held is not None else []) + [f[["t", "is_quote", "seq", "mid"]] for f in frames]])
        mark = state.getCurrentWatermarkMs() * 1000
        due = rows["t"] <= mark
        ready = rows[due].sort_values(["t", "is_quote", "seq"], ascending=[True, False, True])
        found = ready["mid"].where(ready["is_quote"]).ffill()
        if mid is not None:
            found = found.fillna(mid)
        if len(found) and found.notna().any():
            mid = float(found.iloc[-1])
        left = rows[~due]
        state.update(([tuple(r) for r in left.astype(object).itertuples(index=False)], mid))
        if len(left):
            state.setTimeoutTimestamp(max(int(left["t"].min() // 1000) + 1, state.getCurrentWatermarkMs() + 1))
        out = ready.assign(sym=key[0], mid=found)[~ready["is_quote"].astype(bool)]
        yield out[["sym", "t", "seq", "mid"]].astype({"t": "int64", "seq": "int64", "mid": "float64"})

    rows = events.select("sym", "t", "seq", "mid", "is_quote", _time(F.col("t")).alias("at")).withWatermark("at", lateness)
    held = "held array<struct<t: long, is_quote: boolean, seq: long, mid: double>>, mid double"
    return rows.groupBy("sym").applyInPandasWithState(step, "sym string, t long, seq long, mid double", held, "append", "EventTimeTimeout")


def to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over what is there, in append mode, into Parquet files; state beyond the watermark is dropped, and a restart goes on."""
    query = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over what is there and returns the complete result."""
    query = stream.writeStream.outputMode("complete").format("memory").queryName(f"tidemark_{name}").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return stream.sparkSession.table(f"tidemark_{name}")
