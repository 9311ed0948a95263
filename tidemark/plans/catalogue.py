"""Registered queries over the ``events`` feeds, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators import analysis as A
from tidemark.operators import eda
from tidemark.operators import events as E
from tidemark.operators import features as P
from tidemark.operators import grid as G
from tidemark.operators import markout as M
from tidemark.operators import ml as ML
from tidemark.operators import study
from tidemark.operators.asof import asof_mid, mids_at
from tidemark.operators.lineage import written
from tidemark.plans import oracle as O
from tidemark.sources.feeds import Feeds, from_events, sample_trades
from tidemark.spec import FIXTURE
from tidemark.streaming import streams as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of the feeds under its name, with its SQL."""

    def add(f: Callable[[Feeds], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(from_events(spark, sf_dir, FIXTURE))
        if sql is not None:
            ORACLE_SQL[key] = sql
        return f

    return add


def r(*names: str, digits: int = 4) -> list:
    return [X.rounded(F.col(n), digits).alias(n) for n in names]


def rule_rows(feeds: Feeds) -> DataFrame:
    """Trades with markouts, split, and the deterministic score: aligned liquidations of the delayed venue over the long window."""
    net = E.liquidation_windows(feeds, "bybit", (300,)).select("trade_id", F.col("net_300").alias("net"))
    rows = M.markouts(feeds).join(net, "trade_id").withColumn("score", F.col("s") * F.col("net"))
    return written(rows.withColumn("split", X.split_label(F.col("t"), feeds.spec)))  # rules read their rows several times


def _markout(tau: int):
    @query(O.markout(tau), f"q_markout_{tau}")
    def q(f: Feeds) -> DataFrame:
        return M.markouts(f, (tau,)).select("trade_id", "sym", *r(f"pnl_{tau}"))


for _tau in FIXTURE.taus:
    _markout(_tau)


@query(O.BASELINES)
def q_baselines(f: Feeds) -> DataFrame:
    return M.baselines(M.markouts(f), f.spec, ("train", "val", "test"))


@query(O.SCORE_KEEPALL)
def q_score_keepall(f: Feeds) -> DataFrame:
    rows = M.by_horizon(M.markouts(f), f.spec.taus).withColumn("f", F.lit(0))
    out = M.evaluate_filter(rows, ["sym", "tau"], f.spec)
    return out.select("sym", "tau", *r("pnl_all", "pnl_kept", "score", "frac_w", "frac_n"), *r("turnover_per_day", digits=2), "constraint_ok", "n", "n_days")


@query(O.SCORE_RULE)
def q_score_rule(f: Feeds) -> DataFrame:
    rows = M.by_horizon(rule_rows(f), f.spec.taus).withColumn("f", X.keep_below(F.col("score"), F.lit(0.0)))
    out = M.evaluate_filter(rows.drop("score"), ["sym", "split", "tau"], f.spec)
    return out.select("sym", "split", "tau", *r("pnl_all", "pnl_kept", "pnl_filtered", "score", "frac_w", "frac_n"), *r("turnover_per_day", digits=2), "constraint_ok", "n", "n_days")


@query(O.SPLIT_COUNTS)
def q_split_counts(f: Feeds) -> DataFrame:
    return f.trades.groupBy("sym", X.split_label(F.col("t"), f.spec).alias("split")).agg(F.count("*").alias("n"), X.rounded(F.sum("w")).alias("w"))


@query(O.ASOF_MID)
def q_asof_mid(f: Feeds) -> DataFrame:
    return asof_mid(f.trades.select("trade_id", "sym", F.col("t").alias("qt")), f.book, f.spec).select("trade_id", *r("mid", digits=6))


@query(O.BOOK_STATE)
def q_book_state(f: Feeds) -> DataFrame:
    rows = P.book_state(f).withColumn("obi", X.imbalance(F.col("bid_amount"), F.col("ask_amount")))
    return rows.select("trade_id", *r("mid", "spread", "bid_amount", "ask_amount", "obi", digits=6))


@query(O.MOMENTUM)
def q_momentum(f: Feeds) -> DataFrame:
    mids = mids_at(f.trades, "trade_id", f.book, f.spec, {"m0": 0, "m1": -f.spec.us(1), "m5": -f.spec.us(5), "m30": -f.spec.us(30)})
    rows = f.trades.select("trade_id", "s").join(mids, "trade_id")
    return rows.select("trade_id", *[X.rounded(X.return_bps(F.col("s"), F.col("m0"), F.col(f"m{w}"))).alias(f"ret_{w}") for w in (1, 5, 30)])


@query(O.LIQ_WINDOW)
def q_liq_window(f: Feeds) -> DataFrame:
    a, b = (E.liquidation_windows(f, v, (30, 300)) for v in ("binance", "bybit"))
    names = [f"{k}_{w}" for w in (30, 300) for k in ("net", "abs", "cnt")]
    both = a.select("trade_id", *[F.col(n).alias(f"a_{n}") for n in names]).join(b.select("trade_id", *[F.col(n).alias(f"b_{n}") for n in names]), "trade_id")
    return both.select("trade_id", *[X.rounded(F.col(f"{p}_{n}").cast("double")).alias(f"{p}_{n}") for p in "ab" for n in names])


@query(O.LIQ_RECENCY)
def q_liq_recency(f: Feeds) -> DataFrame:
    a, b = (E.seconds_since(f.trades, "trade_id", f.liquidations(v), f.spec).withColumnRenamed("since", v) for v in ("binance", "bybit"))
    return a.join(b, "trade_id").select("trade_id", *r("binance", "bybit"), X.rounded(F.col("binance") - F.col("bybit")).alias("lead"))


@query(O.LIQ_RUNLEN)
def q_liq_runlen(f: Feeds) -> DataFrame:
    return E.run_length(f.both(), ["sym", "venue"]).select("venue", "sym", F.col("seq").alias("event_id"), "runlen")


@query(O.LIQ_ZSCORE)
def q_liq_zscore(f: Feeds) -> DataFrame:
    return E.zscore(f.both(), "notional", ["sym", "venue"]).select("venue", "sym", F.col("seq").alias("event_id"), *r("z"))


@query(O.BASIS)
def q_basis(f: Feeds) -> DataFrame:
    rows = E.last_state(f, "bybit").join(P.book_state(f).select("trade_id", "mid"), "trade_id")
    return rows.select("trade_id", X.rounded(E.basis_bps(F.col("liq_price"), F.col("mid"), F.col("since"), f.spec.basis_stale_s)).alias("basis_bps"))


@query(O.SEASONALITY)
def q_seasonality(f: Feeds) -> DataFrame:
    return P.calendar(f)


@query(O.FLOW_GRID)
def q_flow_grid(f: Feeds) -> DataFrame:
    return G.dense_flow(G.flow_grid(f)).select("sym", "sec", *r("signed_vol", "tot_vol"), "cnt")


@query(O.FLOW_FEATURES)
def q_flow_features(f: Feeds) -> DataFrame:
    return G.flow_features(f).select("trade_id", *r(*[f"{n}_{w}s" for w in (30, 300) for n in ("tfi", "tfi_aligned", "trade_intensity", "flow_imbalance_mag", "signed_vol_mom")]))


@query(O.MID_GRID)
def q_mid_grid(f: Feeds) -> DataFrame:
    return G.mid_grid(f).groupBy("sym", X.floor_div(F.col("sec"), 1440).alias("day")).agg(F.count("*").alias("n"), X.rounded(F.sum("mid")).alias("total"), X.rounded(F.min("mid")).alias("lo"), X.rounded(F.max("mid")).alias("hi"))


def _rolling(sql: str, name: str, columns: list[str]) -> None:
    @query(sql, name)
    def q(f: Feeds) -> DataFrame:
        rows = G.rolling(G.mid_grid(f))
        return rows.groupBy("sym", X.floor_div(F.col("sec"), 1440).alias("day")).agg(*[a for c in columns for a in (F.count(c).alias(f"n_{c}"), X.rounded(F.sum(c), 3).alias(c))])


_rolling(O.rolling(["rv_5", "rv_30", "rv_300"]), "q_rolling_vol", ["rv_5", "rv_30", "rv_300"])
_rolling(O.rolling(["ampl_5", "ampl_30", "ampl_300"]), "q_amplitude", ["ampl_5", "ampl_30", "ampl_300"])
_rolling(O.rolling(["rskew_300"]), "q_skew", ["rskew_300"])
_rolling(O.rolling(["varratio_300"]), "q_varratio", ["varratio_300"])


@query(O.BOOK_DYNAMICS)
def q_book_dynamics(f: Feeds) -> DataFrame:
    return P.book_dynamics(f).select("trade_id", *r("book_age_s", "book_chg_rate_30s"))


@query(O.XEXCH)
def q_xexch(f: Feeds) -> DataFrame:
    a, b = (E.liquidation_windows(f, v, (30, 300)).select("trade_id", F.col("net_30").alias(f"{v}_30"), F.col("net_300").alias(f"{v}_300")) for v in ("binance", "bybit"))
    rows = a.join(b, "trade_id").join(f.trades.select("trade_id", "s"), "trade_id")
    gap = {w: F.col(f"bybit_{w}") - F.col(f"binance_{w}") for w in (30, 300)}
    return rows.select("trade_id", *[X.rounded(gap[w]).alias(f"press_{w}") for w in gap], *[X.rounded(F.col("s") * gap[w]).alias(f"align_{w}") for w in gap])


@query()
def q_feature_panel(f: Feeds) -> DataFrame:
    return P.panel(f)


@query(O.conditional(5), "q_conditional_markout")
def q_conditional_markout(f: Feeds) -> DataFrame:
    return A.conditional_markout(rule_rows(f), ["sym"], "score", "pnl_30").select("sym", F.col("bucket").cast("long").alias("bucket"), *r("lo", "hi", "wpnl"), "n")


@query(O.CALIBRATION)
def q_calibration(f: Feeds) -> DataFrame:
    return A.calibration(rule_rows(f), ["sym"], "score", "pnl_120").select("sym", F.col("bucket").cast("long").alias("bucket"), *r("mean_score", "wpnl"), "n")


@query(O.REGIME)
def q_regime_by_month(f: Feeds) -> DataFrame:
    rows = rule_rows(f).withColumn("vol", F.col("notional"))
    return A.regime_by_month(rows, "score", "vol", (30,)).select("sym", "month", "n", *r("median_vol", "pnl_all_30", "edge_30"))


@query(O.KEEP_BEST)
def q_keep_best(f: Feeds) -> DataFrame:
    rows = rule_rows(f)
    rule = A.fit_keep_best(rows.where("split = 'train'"), ["sym"], "score", "pnl_30", 0.5)
    scored = A.apply_keep_best(rows.where("split = 'val'").withColumn("x", F.col("score")), rule, ["sym"], "x").withColumn("pnl", F.col("pnl_30"))
    out = M.evaluate_filter(scored.drop("score"), ["sym"], f.spec).join(rule, "sym")
    return out.select("sym", "direction", *r("cut", "pnl_all", "pnl_kept", "score"), "n")


@query(O.THRESHOLD_CURVE)
def q_threshold_curve(f: Feeds) -> DataFrame:
    rows = rule_rows(f).withColumns({"pnl": F.col("pnl_30"), "x": F.col("score")}).drop("score")
    return A.threshold_curve(rows, ["sym"], "x", f.spec).select("sym", *r("thr", "pnl_kept", "score", "frac_w"), "n")


@query(O.THRESHOLD_CV)
def q_threshold_cv(f: Feeds) -> DataFrame:
    rows = rule_rows(f).withColumn("pnl", F.col("pnl_30"))
    return A.threshold_cv(rows, ["sym"], "score", f.spec).select("sym", *r("thr", "cv"))


@query(O.MINUTE_TRADES)
def q_minute_bars_trades(f: Feeds) -> DataFrame:
    return eda.minute_bars_trades(f).select("sym", "minute", "n", "buy_n", *r("amount", "notional", "buy_notional", "px_first", "px_last", "px_min", "px_max"))


@query(O.MINUTE_BBO)
def q_minute_bars_bbo(f: Feeds) -> DataFrame:
    return eda.minute_bars_book(f).select("sym", "minute", "n", "crossed", "locked", *r("mid_first", "mid_last", "mid_min", "mid_max", "spread", "rel_spread", "bid_amount", "ask_amount", digits=6))


@query(O.LOG_HIST)
def q_log_hist(f: Feeds) -> DataFrame:
    return eda.log_histogram(f.trades, "notional", ["sym"]).select("sym", "bin", "n", *r("bin_lo", "bin_hi"))


@query(O.SPREAD_HIST)
def q_spread_hist(f: Feeds) -> DataFrame:
    return eda.spread_histogram(f)


@query(O.STATS)
def q_stats(f: Feeds) -> DataFrame:
    x = "notional"
    return f.trades.groupBy("sym").agg(F.count("*").alias("n"), *[X.rounded(v).alias(k) for k, v in {"mean": F.avg(x), "std": F.stddev_samp(x), "lo": F.min(x), "hi": F.max(x), "capped": F.sum((F.col(x) > f.spec.notional_cap).cast("double"))}.items()], F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query(O.QUANTILES)
def q_quantiles(f: Feeds) -> DataFrame:
    out = eda.sampled_quantiles(f.trades, "notional", ["sym"], 3, (0.01, 0.5, 0.99))
    return out.select("sym", *r("q010", "q500", "q990"))


@query(O.SAMPLE_TRADES)
def q_sample_trades(f: Feeds) -> DataFrame:
    rows, step = sample_trades(f.trades, 1000)
    return rows.select("trade_id", "sym", "t", F.lit(step).cast("long").alias("step"))


@query(O.MISSING_MINUTES)
def q_missing_minutes(f: Feeds) -> DataFrame:
    return eda.missing_minutes(f).groupBy("sym", X.floor_div(F.col("minute"), 1440).alias("day")).agg(F.count("*").alias("missing"), F.min("minute").alias("first_missing"))


@query(O.ANOMALIES)
def q_anomaly_audit(f: Feeds) -> DataFrame:
    return eda.anomalies(f.both(), ["sym", "venue"], ["side", "price", "amount"])


@query(O.HOURLY)
def q_hourly(f: Feeds) -> DataFrame:
    return eda.hourly_from_bars(eda.minute_bars_trades(f)).select("sym", "hour", *r("mean_n", "mean_notional"))


@query(O.DAILY)
def q_daily(f: Feeds) -> DataFrame:
    return eda.daily_from_bars(eda.minute_bars_trades(f)).select("sym", "day", "n", *r("notional", "buy_frac"))


@query(O.BURST)
def q_burstiness(f: Feeds) -> DataFrame:
    return eda.burstiness(eda.minute_bars_trades(f)).select("sym", "min_n", *r("median_n", "p99_n"), "max_n")


@query(O.DAILY_LIQ)
def q_daily_liq(f: Feeds) -> DataFrame:
    return f.both().groupBy("sym", "venue", X.day(F.col("raw_t")).alias("day")).agg(F.count("*").alias("n"), X.rounded(F.sum("notional")).alias("notional"), X.rounded(F.avg((F.col("side") == "buy").cast("double"))).alias("buy_frac"))


@query(O.VENUE_CORR)
def q_venue_minute_corr(f: Feeds) -> DataFrame:
    return eda.venue_corr(f).select("sym", *r("corr"), "minutes")


@query(O.LIQ_MARKOUT)
def q_liq_markout(f: Feeds) -> DataFrame:
    return eda.liquidation_summary(f).select("venue", "sym", "side", F.col("h").cast("long").alias("h"), "n", *r("mean_ret"))


# Offsets in seconds of the event studies.
PROFILE_OFFSETS = (-60, -30, -20, -10, -5, -2, -1, -0.5, -0.2, -0.1, 0, 0.1, 0.2, 0.5, 1, 2, 5, 10, 20, 30, 60, 120, 180, 240, 300)
IMPACT_OFFSETS = (-1, -0.5, -0.1, 0, 0.1, 0.5, 1, 2, 5, 10, 30)


@query(O.liq_profile(PROFILE_OFFSETS))
def q_liq_profile(f: Feeds) -> DataFrame:
    return eda.liquidation_profile(f, PROFILE_OFFSETS).where("n > 0").select("venue", "sym", "side", *r("offset"), "n", *r("mean", "median"))


@query(O.trade_impact(IMPACT_OFFSETS))
def q_trade_impact(f: Feeds) -> DataFrame:
    return eda.trade_impact(f, f.trades, IMPACT_OFFSETS).select("sym", "side", *r("offset"), "n", *r("mean"))


@query(O.impact_normalised(IMPACT_OFFSETS))
def q_impact_normalised(f: Feeds) -> DataFrame:
    """The impact over its mean before the trade."""
    return study.pre_normalised(eda.trade_impact(f, f.trades, IMPACT_OFFSETS), ["sym", "side"], "offset", "mean").select("sym", "side", *r("offset", "mean"))


@query(O.IMPACT_BY_SIZE)
def q_impact_by_size(f: Feeds) -> DataFrame:
    return eda.impact_by_size(f, (2000.0, 5000.0, 8000.0), (30, 120)).select(F.col("size").cast("long").alias("size"), F.col("offset").cast("long").alias("offset"), "n", *r("mean"))


@query(O.CASCADES)
def q_cascades(f: Feeds) -> DataFrame:
    return E.cascades(f).select("sym", "begin_t", "end_t", "n", F.col("sgn").cast("long").alias("sgn"), "n_sell")


@query(O.CASCADE_META)
def q_cascade_meta(f: Feeds) -> DataFrame:
    return eda.cascade_meta(f).select("sym", "n", *r("sell_share", "median_span", "median_climax"))


@query(O.around([(str(o), o + 2.5, o, o + 5) for o in range(-60, 300, 5)], True))
def q_cascade_profile(f: Feeds) -> DataFrame:
    return eda.cascade_profile(f).select("sym", F.col("offset").cast("string").alias("point"), *r("move", "spread_bps", "obi_signed", "trade_rate", "flow_signed", "binance", "bybit"), *r("depth_usd", digits=2))


@query(O.around([(p, c, lo, hi) for p, (lo, hi, c) in eda.PHASES.items()], False))
def q_cascade_phases(f: Feeds) -> DataFrame:
    return eda.cascade_phases(f).select("sym", F.col("phase").alias("point"), *r("move", "spread_bps", "obi_signed", "trade_rate", "flow_signed", "binance", "bybit"), *r("depth_usd", digits=2))


@query(O.PHASE_TAGS)
def q_phase_tags(f: Feeds) -> DataFrame:
    """Trades by phase, and the means of their markout and of four features."""
    grid = G.at_second(f.trades, "trade_id", G.rolling(G.mid_grid(f)), ["rv_300", "ampl_300"], f.spec)
    rows = eda.phase_tags(f, M.markouts(f, (120,))).join(grid, "trade_id")
    for v in ("binance", "bybit"):
        rows = rows.join(E.liquidation_windows(f, v, (300,)).select("trade_id", F.col("abs_300").alias(f"{v}_abs_300")), "trade_id")
    return rows.groupBy("sym", "phase").agg(F.count("*").alias("n"), *[X.rounded(F.avg(c), d).alias(c) for c, d in (("pnl_120", 4), ("rv_300", 4), ("ampl_300", 4), ("binance_abs_300", 2), ("bybit_abs_300", 2))])


@query(O.WCORR)
def q_wcorr(f: Feeds) -> DataFrame:
    return A.weighted_corr(rule_rows(f), ["sym", "split"], "score", "pnl_30").select("sym", "split", *r("corr", digits=6), F.col("direction").cast("long").alias("direction"))


@query(O.MISSINGNESS)
def q_missingness(f: Feeds) -> DataFrame:
    return A.missingness(M.markouts(f), ["sym"], ["pnl_30", "pnl_120", "pnl_300"]).select("sym", "feature", *r("missing", digits=6))


QUERIES["q_stream_flow_grid"] = lambda spark, sf_dir: S.drain(S.flow_grid(S.event_stream(spark, sf_dir), FIXTURE), "flow_grid").select("sym", "sec", *r("signed_vol", "tot_vol"), "cnt")
QUERIES["q_stream_sessions"] = lambda spark, sf_dir: S.drain(S.sessions(S.event_stream(spark, sf_dir), FIXTURE), "sessions").select("sym", "begin_t", "end_t", "n", "n_sell")
ORACLE_SQL |= {"q_stream_flow_grid": O.STREAM_FLOW_GRID, "q_stream_sessions": O.STREAM_SESSIONS}


def _model(f: Feeds) -> tuple[DataFrame, ML.Model]:
    """The panel, and a boosted model of the markout at 30 s on all its features, fitted on the training split."""
    rows = written(P.panel(f))  # hundreds of jobs read it, and its plan is large
    return rows, ML.fit(rows.where("split = 'train'"), P.feature_columns(rows), "pnl_30", "mse")


@query()
def q_gbt_score(f: Feeds) -> DataFrame:
    """The boosted model's scores of all trades."""
    rows, model = _model(f)
    return ML.predict(model, rows, "gbt_score").select("trade_id", "sym", "split", "gbt_score")


@query()
def q_importance(f: Feeds) -> DataFrame:
    rows, model = _model(f)
    return ML.permutation_importance(model, rows.where("split = 'val'"), "pnl_30", repeats=3)


@query(O.WF_SUMMARY)
def q_wf_summary(f: Feeds) -> DataFrame:
    """Walk-forward folds of ten days with the fixed rule, summarised."""
    rows = rule_rows(f).withColumns({"pnl": F.col("pnl_30"), "f": X.keep_below(F.col("score"), F.lit(0.0)), "fold": X.floor_div(F.col("t") - f.spec.windows[0][1], 10 * 86_400_000_000)})
    folds = M.evaluate_filter(rows.drop("score"), ["sym", "fold"], f.spec)
    return A.summarize(folds, ["sym"]).select("sym", *r("mean_score", "std_score", "min_score"), "n_folds", "all_ok")


@query(O.TRADES)
def q_trades(f: Feeds) -> DataFrame:
    return f.trades.select("trade_id", "sym", "t", "side", F.col("s").cast("long").alias("s"), *r("price", "notional", "w"))


@query(O.INVENTORY)
def q_inventory(f: Feeds) -> DataFrame:
    """Rows, first and last time and days of each feed and symbol."""
    feeds = {"trades": f.trades.select("sym", "t"), "bbo": f.book.select("sym", "t"), "binance": f.binance.select("sym", F.col("raw_t").alias("t")), "bybit": f.bybit.select("sym", F.col("raw_t").alias("t"))}
    out = None
    for name, rows in feeds.items():
        one = rows.withColumn("feed", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("feed", "sym").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), X.rounded((F.max("t") - F.min("t")) / 86_400_000_000.0).alias("days"))


@query(O.EDGE)
def q_edge(f: Feeds) -> DataFrame:
    """Quintile edge and trend of the score, and whether the months keep its sign."""
    rows = rule_rows(f)
    kept = A.month_survival(rows, ["sym"], "score", "pnl_120", F.col("split") == "train")
    return A.edge(rows, ["sym"], "score", "pnl_120").join(kept, "sym").select("sym", *r("edge", "trend"), "months", "survived")


@query(O.RECENCY)
def q_recency_weight(f: Feeds) -> DataFrame:
    rows = ML.recency(f.trades.select("trade_id", "sym", "t", "w"), 10.0)
    return rows.groupBy("sym", X.day(F.col("t")).alias("day")).agg(X.rounded(F.sum("w"), 2).alias("w"))


@query(O.REPORT)
def q_report(f: Feeds) -> DataFrame:
    """Four ways to filter, side by side: everything, the score's sign, the best half by a training rule, and the fitted cut."""
    rows = rule_rows(f).withColumns({"pnl": F.col("pnl_30"), "x": F.col("score")}).drop("score")
    train = rows.where("split = 'train'")
    rule = A.fit_keep_best(train, ["sym"], "x", "pnl", 0.5)
    cut = F.broadcast(A.threshold_cv(train, ["sym"], "x", f.spec).select("sym", "thr"))
    test = rows.where("split in ('val', 'test')")
    ways = {"keep_all": test.withColumn("f", F.lit(0)), "sign": test.withColumn("f", X.keep_below(F.col("x"), F.lit(0.0))), "best_half": A.apply_keep_best(test, rule, ["sym"], "x"), "fitted": test.join(cut, "sym").withColumn("f", X.keep_below(F.col("x"), F.col("thr"))).drop("thr")}
    out = None
    for name, one in ways.items():
        m = M.evaluate_filter(one, ["sym", "split"], f.spec).withColumn("method", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out.select("method", "sym", "split", *r("pnl_all", "pnl_kept", "score", "frac_w"), "n", "n_days")


@query(O.REPORT_ALL)
def q_report_horizons(f: Feeds) -> DataFrame:
    """The report's four ways to filter at every horizon; the reference feature is the rule's score."""
    rows = rule_rows(f).withColumn("ref", F.col("score"))
    out = study.report(rows, f.spec.taus, lambda tau: "score", "ref", f.spec)
    return out.select("method", "sym", "split", F.col("tau").cast("long").alias("tau"), *r("pnl_all", "pnl_kept", "score", "frac_n"), "constraint_ok", "n", "n_days")


@query(O.MONTHLY)
def q_monthly_stability(f: Feeds) -> DataFrame:
    out = study.monthly_stability(rule_rows(f), f.spec.taus, lambda tau: "score", f.spec)
    return out.select("sym", "month", F.col("tau").cast("long").alias("tau"), *r("pnl_all", "pnl_kept", "score", "frac_n"), "n", "n_days")


#: Two folds of the fixture's month: training up to a day, less the embargo, and the ten days from it.
FOLD_DAYS = (10, 20)


@query(O.walk_forward(FOLD_DAYS))
def q_walk_forward(f: Feeds) -> DataFrame:
    """Walk-forward folds in which the cut of the rule's score is fitted on the training rows."""
    rows, day = rule_rows(f), 86_400_000_000
    first = f.spec.windows[0][1]
    folds = [(first, first + d * day - f.spec.embargo_us, first + d * day, first + (d + 10) * day) for d in FOLD_DAYS]

    def fit_fn(train: DataFrame, tau: int, step: int):
        return lambda r: r, A.threshold_cv(train.withColumn("pnl", F.col(f"pnl_{tau}")), ["sym"], "score", f.spec, scale=step)

    numbered = None
    for i, fold in enumerate(folds):
        one = study.evaluate_specs(rows, {"rule": fit_fn}, (30, 300), [fold], f.spec)
        one = one.withColumn("fold", F.lit(i)) if one is not None else None
        numbered = one if numbered is None else numbered.unionByName(one) if one is not None else numbered
    return numbered.select("spec", "sym", F.col("tau").cast("long").alias("tau"), F.col("fold").cast("long").alias("fold"), *r("pnl_all", "pnl_kept", "score", "frac_n"), "n", "n_days")


@query(O.MUTUAL)
def q_mutual_information(f: Feeds) -> DataFrame:
    return study.mutual_information(rule_rows(f), ["sym"], "score", "pnl_30").select("sym", *r("mi"))


@query()
def q_feature_missingness(f: Feeds) -> DataFrame:
    """The twenty features of the panel with the largest share of missing values in any symbol."""
    rows = P.panel(f)
    return study.top_missing(A.missingness(rows, ["sym"], P.feature_columns(rows)))


@query()
def q_seeded_sample(f: Feeds) -> DataFrame:
    return study.seeded_sample(f.trades, "trade_id", 500, 7).select("trade_id", "sym", "t")
