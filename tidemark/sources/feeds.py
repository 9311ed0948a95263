"""Feeds: where they lie, their schemas, and the normal forms that the operators take.

Normal forms, all with ``sym`` and ``t`` (microseconds) and ``seq`` (order among equal times, unique in a feed):

* trades: ``trade_id, side, s, price, amount, notional, w``; ``trade_id`` is unique over all symbols, as operators join on it
* book: ``mid, spread, bid_amount, ask_amount``
* liquidations: ``venue, side, sgn, price, notional, signed`` with ``t`` the time they became known and ``raw_t`` their own
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import exprs as X
from tidemark.spec import Spec

_TIME = [T.StructField("timestamp", T.LongType()), T.StructField("ticker", T.StringType())]
_DEAL = [T.StructField("side", T.StringType()), T.StructField("price", T.DoubleType()), T.StructField("amount", T.DoubleType())]
TRADES = T.StructType(_TIME + _DEAL)
LIQUIDATIONS = T.StructType(_TIME + _DEAL)
BBO = T.StructType(_TIME + [T.StructField(c, T.DoubleType()) for c in ("bid_price", "bid_amount", "ask_price", "ask_amount")])
SCHEMAS = {"trades": TRADES, "bbo": BBO, "liq_binance": LIQUIDATIONS, "liq_bybit": LIQUIDATIONS}


# Folder and file name of each source; ``{}`` is the symbol in lower case.
LAYOUT = {
    "trades": "binance_trades/perp_{}usdt.parquet",
    "bbo": "binance_booktickers/perp_{}usdt.parquet",
    "liq_binance": "binance_liquidations/perp_{}usdt.parquet",
    "liq_bybit": "bybit_liquidations/{}usdt.parquet",
}
#: Bits of a row's place in its file, below the number of the file.
ROW_BITS = 40


@dataclass(frozen=True)
class Catalog:
    """Resolves (source, symbol) under a data directory; a path may be a file or a folder of files."""

    data_dir: str

    def path(self, source: str, symbol: str) -> str:
        if source not in SCHEMAS:
            raise ValueError(f"unknown source {source!r}; one of {', '.join(SCHEMAS)}")
        return f"{self.data_dir.rstrip('/')}/{LAYOUT[source].format(symbol.lower())}"

    def scan(self, spark: SparkSession, source: str, symbol: str, first_file: int = 0) -> DataFrame:
        """A lazy scan with the declared schema, ``sym`` and ``seq``: the number of the file, in order of its name, and the row's place in it."""
        raw = spark.read.schema(SCHEMAS[source]).parquet(self.path(source, symbol))
        files = sorted(raw.inputFiles())
        if len(files) == 1:
            return raw.withColumns({"seq": F.lit(first_file << ROW_BITS).cast("long") + F.col("_metadata.row_index"), "sym": F.lit(symbol)})
        # One row per file, joined by a plan that its size decides. Local paths are written with one slash or three.
        names = spark.createDataFrame([(re.sub("^file:/+", "/", f), first_file + i) for i, f in enumerate(files)], "_file string, _number long")
        rows = raw.withColumns({"_file": F.regexp_replace("_metadata.file_path", "^file:/+", "/"), "_row": F.col("_metadata.row_index")}).join(names, "_file")
        return rows.withColumns({"seq": F.shiftleft("_number", ROW_BITS) + F.col("_row"), "sym": F.lit(symbol)}).drop("_file", "_row", "_number")

    def files(self, spark: SparkSession, source: str, symbol: str) -> int:
        return len(spark.read.schema(SCHEMAS[source]).parquet(self.path(source, symbol)).inputFiles())


def inventory(spark: SparkSession, catalog: Catalog, symbols: list[str]) -> DataFrame:
    """``feed, sym, n, first_t, last_t, days, mb``: rows and times as the files' footers have them, and the files' size."""
    out = None
    for source in SCHEMAS:
        for s in symbols:
            path = catalog.path(source, s)
            raw = spark.read.schema(SCHEMAS[source]).parquet(path)
            size = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).agg((F.sum("length") / 1e6).alias("mb"))
            one = raw.agg(F.count("*").alias("n"), F.min("timestamp").alias("first_t"), F.max("timestamp").alias("last_t")).crossJoin(F.broadcast(size))
            one = one.select(F.lit(source).alias("feed"), F.lit(s).alias("sym"), "n", "first_t", "last_t", ((F.col("last_t") - F.col("first_t")) / 86_400_000_000.0).alias("days"), "mb")
            out = one if out is None else out.unionByName(one)
    return out


def validate_sorted(feed: DataFrame, bucket: int = 1 << 20, by: tuple[str, ...] = ("sym",), time: str = "t") -> DataFrame:
    """``by, backward``: backward steps of ``t`` in the order of ``seq``; 0 for a sorted feed.

    Places are dealt into buckets; a bucket's first row is compared with the last one of the bucket before.
    """
    rows = feed.select(*by, F.col(time).alias("t"), "seq", F.shiftright("seq", bucket.bit_length() - 1).alias("_b"))
    back = F.col("t") < F.lag("t").over(Window.partitionBy(*by, "_b").orderBy("seq"))
    inner = rows.withColumn("_back", back).groupBy(*by, "_b").agg(F.count_if("_back").alias("n"), F.min_by("t", "seq").alias("first"), F.max_by("t", "seq").alias("last"))
    edge = F.col("first") < F.lag("last").over(Window.partitionBy(*by).orderBy("_b"))  # one row per bucket
    return inner.withColumn("_edge", edge).groupBy(*by).agg((F.sum("n") + F.count_if("_edge")).alias("backward"))


def trades(raw: DataFrame, spec: Spec, trade_id: Column | None = None) -> DataFrame:
    """Trades in normal form from ``timestamp, side, price, amount, sym, seq``."""
    s = X.trade_sign(F.col("side"))
    notional = F.col("price") * F.col("amount")
    return raw.select((F.col("seq") if trade_id is None else trade_id).alias("trade_id"), "sym", F.col("timestamp").alias("t"), "seq", "side", s.alias("s"), "price", "amount", notional.alias("notional"), F.least(notional, F.lit(spec.notional_cap)).alias("w"))


def book(raw: DataFrame) -> DataFrame:
    return raw.select("sym", F.col("timestamp").alias("t"), "seq", X.mid(F.col("bid_price"), F.col("ask_price")).alias("mid"), (F.col("ask_price") - F.col("bid_price")).alias("spread"), "bid_amount", "ask_amount", "bid_price", "ask_price")


def liquidations(raw: DataFrame, venue: str, spec: Spec, shift: bool = True) -> DataFrame:
    """Liquidations in normal form; those of the delayed venue become known ``bybit_delay_s`` later."""
    delay = spec.us(spec.bybit_delay_s) if shift and venue == "bybit" else 0
    s = X.trade_sign(F.col("side"))
    notional = F.col("price") * F.col("amount")
    return raw.select("sym", F.lit(venue).alias("venue"), (F.col("timestamp") + F.lit(delay).cast("long")).alias("t"), F.col("timestamp").alias("raw_t"), "seq", "side", s.alias("sgn"), "price", "amount", notional.alias("notional"), (s * notional).alias("signed"))


def sample_trades(feed: DataFrame, target_rows: int) -> tuple[DataFrame, int]:
    """Every k-th trade of each symbol in (t, seq) order, ``k = max(1, n // target_rows)`` of the whole feed; returns k too."""
    from tidemark.operators.asof import indexed

    step = max(1, feed.count() // target_rows)
    return indexed(feed, ["sym"]).where(F.col("idx") % step == 0).drop("idx"), step


@dataclass(frozen=True)
class Feeds:
    """The four feeds of a run. Where ``trades`` are a sample, ``tape`` has all of them, for the flow of each second."""

    trades: DataFrame
    book: DataFrame
    binance: DataFrame
    bybit: DataFrame
    spec: Spec
    tape: DataFrame | None = None

    def liquidations(self, venue: str) -> DataFrame:
        return self.binance if venue == "binance" else self.bybit

    def both(self) -> DataFrame:
        return self.binance.unionByName(self.bybit)


def from_catalog(spark: SparkSession, catalog: Catalog, symbols: list[str], spec: Spec) -> Feeds:
    """The feeds of several symbols. Files are numbered over all of them, so ``seq`` and ``trade_id`` are unique."""

    def all_of(source: str) -> DataFrame:
        out, n = None, 0
        for s in symbols:
            one = catalog.scan(spark, source, s, n)
            n += catalog.files(spark, source, s)
            out = one if out is None else out.unionByName(one)
        return out

    return Feeds(trades(all_of("trades"), spec), book(all_of("bbo")), liquidations(all_of("liq_binance"), "binance", spec), liquidations(all_of("liq_bybit"), "bybit", spec), spec)


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp without time zone, whatever the session's zone."""
    seconds = F.unix_date(ts.cast("date")).cast("long") * 86_400 + F.hour(ts).cast("long") * 3_600 + F.minute(ts).cast("long") * 60
    return seconds * 1_000_000 + (F.expr("1000000") * F.extract(F.lit("SECOND"), ts)).cast("long")


def from_events(spark: SparkSession, sf_dir: str, spec: Spec) -> Feeds:
    """Feeds out of the ``events`` table: purchases and clicks trade, views quote, errors and sign-ups liquidate."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    price = F.lit(100.0) + F.col("value") / F.lit(100.0)
    base = e.select("event_id", micros(F.col("ts")).alias("timestamp"), F.when(F.col("user_id") % 2 == 0, "btc").otherwise("eth").alias("sym"), "event_type", price.alias("price"), k.alias("k"), F.col("event_id").alias("seq"))
    deal = base.where(F.col("event_type").isin("purchase", "click")).withColumns({"side": F.when(F.col("event_type") == "purchase", "buy").otherwise("sell"), "amount": ((1 + F.col("k")) * 20).cast("double")})
    quote = base.where("event_type = 'view'").withColumns({"bid_price": F.col("price") - 0.01, "ask_price": F.col("price") + 0.01, "bid_amount": (1 + F.col("k")).cast("double"), "ask_amount": (1 + F.col("event_id") % 50).cast("double")})
    forced = base.withColumns({"side": F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell"), "amount": (1 + F.col("k")).cast("double")})
    return Feeds(
        trades(deal, spec, F.col("event_id")),
        book(quote),
        liquidations(forced.where("event_type = 'error'"), "binance", spec),
        liquidations(forced.where("event_type = 'signup'"), "bybit", spec),
        spec,
    )
