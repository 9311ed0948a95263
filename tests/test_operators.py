"""Hand-computed cases of the event-feed operators."""

import inspect
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators import analysis as A
from tidemark.operators import eda
from tidemark.operators import events as E
from tidemark.operators import features as P
from tidemark.operators import grid as G
from tidemark.operators import markout as M
from tidemark.operators import ml as ML
from tidemark.operators import quantiles as Q
from tidemark.operators import study as ST
from tidemark.operators import walkforward as W
from tidemark.operators.asof import asof_mid, windowed
from tidemark import __main__ as cli
from tidemark.plans import catalogue
from tidemark.sources.feeds import Catalog, Feeds, from_catalog, validate_sorted
from tidemark.streaming import streams as S
from tidemark.spec import DAY_US, Spec, midnight

US = 1_000_000
SPEC = Spec()


def book(spark, rows):
    return spark.createDataFrame([("x", t, i, float(m), 0.1, 2.0, 1.0, m - 0.05, m + 0.05) for i, (t, m) in enumerate(rows)], "sym string, t long, seq long, mid double, spread double, bid_amount double, ask_amount double, bid_price double, ask_price double")


def trades(spark, rows):
    return spark.createDataFrame([(i, "x", t, i, "buy" if s > 0 else "sell", s, float(p), 1.0, float(p), min(float(p), 1e5)) for i, (t, s, p) in enumerate(rows)], "trade_id long, sym string, t long, seq long, side string, s int, price double, amount double, notional double, w double")


def liqs(spark, rows, venue="binance"):
    return spark.createDataFrame([("x", venue, t, t, i, "buy" if v > 0 else "sell", 1 if v > 0 else -1, float(p), 1.0, float(abs(v)), float(v)) for i, (t, v, p) in enumerate(rows)], "sym string, venue string, t long, raw_t long, seq long, side string, sgn int, price double, amount double, notional double, signed double")


def feeds(spark, t, b, a=(), y=()):
    return Feeds(trades(spark, t), book(spark, b), liqs(spark, list(a)), liqs(spark, list(y), "bybit"), SPEC)


def test_asof_mid_is_unknown_outside_the_quotes(spark):
    q = spark.createDataFrame([("x", t) for t in (5, 10, 25, 30, 35)], "sym string, qt long")
    got = {r["qt"]: r["mid"] for r in asof_mid(q, book(spark, [(10, 100), (20, 101), (30, 102)]), SPEC).collect()}
    assert got == {5: None, 10: 100, 25: 101, 30: 102, 35: None}


def test_markout_formula(spark):
    row = spark.range(1).select(X.markout_bps(F.lit(100.0), F.lit(1), F.lit(99.0), 0.5).alias("a"), X.markout_bps(F.lit(100.0), F.lit(-1), F.lit(99.0), 0.5).alias("b")).first()
    assert (row["a"], row["b"]) == pytest.approx((100.5, -99.5))


def test_markout_horizon(spark):
    f = feeds(spark, [(0, 1, 100)], [(0, 100), (30 * US, 101), (60 * US, 102)])
    row = M.markouts(f, (30, 300)).first()
    assert row["pnl_30"] == pytest.approx(-99.5) and row["pnl_300"] is None


def test_asof_across_buckets_takes_the_carried_state(spark):
    q = spark.createDataFrame([("x", 9 * DAY_US + 5), ("x", 3)], "sym string, qt long")
    b = book(spark, [(1, 100), (2, 101), (10 * DAY_US, 103)])
    assert sorted(r["mid"] for r in asof_mid(q, b, SPEC).collect()) == [101, 101]


def scored(spark, rows):
    return spark.createDataFrame([("x", t, w, p, f) for t, w, p, f in rows], "sym string, t long, w double, pnl double, f int")


def test_weighted_mean_skips_missing(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, 5.0), (3.0, 1.0)], "p double, w double")
    assert df.agg(M.weighted_mean(F.col("p"), F.col("w")).alias("m")).first()["m"] == 2.0


def test_evaluate_filter(spark):
    r = M.evaluate_filter(scored(spark, [(0, 1.0, 1.0, 0), (0, 1.0, -1.0, 1), (0, 1.0, 2.0, 0), (0, 1.0, -2.0, 1)]), ["sym"], SPEC).first()
    assert (r["pnl_all"], r["pnl_kept"], r["pnl_filtered"], r["score"], r["frac_w"], r["frac_n"], r["turnover_per_day"], r["constraint_ok"]) == (0, 1.5, -1.5, 1.5, 0.5, 0.5, 2, False)


@pytest.mark.parametrize(("days", "ok"), [(1, True), (10, False)])
def test_turnover_constraint(spark, days, ok):
    rows = scored(spark, [(i % days * DAY_US, 1e5, 1.0, 0) for i in range(10)])
    assert M.evaluate_filter(rows, ["sym"], SPEC).first()["constraint_ok"] is ok


def test_split_boundaries(spark):
    e = SPEC.embargo_us
    (_, a, b), (_, b2, c), (_, c2, d) = SPEC.windows
    times = [a - 1, a, b - e - 1, b - e, b - 1, b2, c - e - 1, c - e, c2, d - e - 1, d - e, d]
    got = [r["l"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, t long").select("i", X.split_label(F.col("t"), SPEC).alias("l")).orderBy("i").collect()]
    assert got == ["other", "train", "train", "other", "other", "val", "val", "other", "test", "test", "other", "other"]


def test_without_a_test_split_its_window_is_validation():
    assert [w[0] for w in Spec(use_test=False).split_windows()] == ["train", "val"]


def test_scalar_features(spark):
    row = spark.range(1).select(X.imbalance(F.lit(3.0), F.lit(1.0)).alias("obi"), X.microprice_bps(F.lit(2.0), F.lit(100.0), F.lit(0.5)).alias("micro"), X.acceleration(F.lit(1.0), F.lit(10.0)).alias("a"), X.acceleration(F.lit(2.0), F.lit(4.0)).alias("b"), X.acceleration(F.lit(0.0), F.lit(0.0)).alias("c")).first()
    assert (row["obi"], row["micro"], row["a"], row["b"], row["c"]) == (0.5, 50, 1, 5, None)


def test_windowed_liquidations_are_open_on_the_left(spark):
    q = spark.createDataFrame([(1, "x", 30)], "id long, sym string, t long")
    feed = liqs(spark, [(10, 100, 1), (20, -50, 1), (30, 200, 1)])
    values = {"net": F.col("signed"), "abs": F.col("notional"), "cnt": F.lit(1).cast("long")}
    r = windowed(q, "id", feed, values, {"25": 25, "15": 15}, ["sym"]).first()
    assert (r["net_25"], r["abs_25"], r["cnt_25"], r["net_15"], r["abs_15"], r["cnt_15"]) == (250, 350, 3, 150, 250, 2)
    assert windowed(q, "id", feed, values, {"20": 20}, ["sym"]).first()["cnt_20"] == 2


def test_run_length(spark):
    rows = liqs(spark, [(i, v, 1) for i, v in enumerate([1, 1, -1, 1, 1, 1])])
    assert [r["runlen"] for r in E.run_length(rows, ["sym"]).orderBy("t").collect()] == [1, 2, -1, 1, 2, 3]


def test_flow_window_excludes_the_current_second(spark):
    rows = [(100, 2, 2), (101, -1, 3), (102, 3, 3), (103, 0, 4), (104, 5, 5)]
    t = [(sec * US, 1 if net >= 0 else -1, 1) for sec, net, _ in rows] + [(103 * US + US // 2, 1, 1)]
    r = {x["trade_id"]: x for x in G.flow_windows(feeds(spark, t, [(0, 1)]), (2,)).collect()}
    assert r[5]["n_2"] == 2 and r[5]["tot_2"] == 2 and r[5]["net_2"] == 0
    assert r[0]["net_2"] is None


def test_calendar(spark):
    ts = [midnight("2026-01-01"), midnight("2026-01-01") + 2 * 3600 * US, midnight("2025-12-01"), midnight("2025-12-01") + 13 * 3600 * US, midnight("2025-12-06")]
    f = feeds(spark, [(t, 1, 1) for t in ts], [(0, 1)])
    r = P.calendar(f).orderBy("trade_id").collect()
    assert [(x["min_to_funding"], x["in_funding_window"]) for x in r[:2]] == [(0, 1), (360, 0)]
    assert [x["hour"] for x in r[2:4]] == [0, 13] and [x["is_weekend"] for x in r[2:]] == [0, 0, 1]


def test_recency_and_basis(spark):
    f = feeds(spark, [(1 * US, 1, 100), (601 * US, 1, 100)], [(0, 100), (700 * US, 100)], (), [(0, 1, 99)])
    r = E.last_state(f, "bybit").orderBy("trade_id").collect()
    assert [x["since"] for x in r] == [1.0, 601.0]
    got = spark.createDataFrame([(99.0, 100.0, 1.0), (99.0, 100.0, 601.0)], "p double, m double, s double").select(E.basis_bps(F.col("p"), F.col("m"), F.col("s"), 300).alias("b")).collect()
    assert [x["b"] for x in got] == [-100, 0]


def test_zscore_needs_enough_events(spark):
    rows = liqs(spark, [(i, float(i + 1), 1) for i in range(25)])
    z = [r["z"] for r in E.zscore(rows, "notional", ["sym"]).orderBy("t").collect()]
    assert z[:19] == [None] * 19
    x = list(range(1, 21))
    mean = sum(x) / 20
    assert z[19] == pytest.approx((20 - mean) / math.sqrt(sum((v - mean) ** 2 for v in x) / 19))


def test_cascades_split_on_a_longer_gap_only(spark):
    times = [0, 10, 20, 30, 40, 51, 52, 53, 54]
    f = feeds(spark, [(0, 1, 1)], [(0, 1)], [(t * US, -1, 1) for t in times])
    assert [(r["begin_t"], r["n"], r["sgn"]) for r in E.cascades(f).collect()] == [(0, 5, -1)]


def test_folds_and_months():
    folds = W.walk_forward_folds(midnight("2025-11-01"), midnight("2026-04-29"), SPEC, 3)
    assert [f[2] for f in folds] == [midnight("2026-02-01"), midnight("2026-03-01"), midnight("2026-04-01")]
    assert all(f[1] == f[2] - 300 * US for f in folds) and folds[-1][3] == midnight("2026-04-29")


def test_threshold_cv_finds_an_informative_cut(spark):
    n = 4000
    rows = spark.range(n).select(F.lit("x").alias("sym"), (F.col("id") * 50 * DAY_US / n).cast("long").alias("t"), F.col("id").alias("seq"), F.lit(2e4).alias("w"), (F.pmod(F.xxhash64("id"), F.lit(2001)) / 1000.0 - 1).alias("score")).withColumn("pnl", F.col("score"))
    r = A.threshold_cv(rows, ["sym"], "score", Spec(turnover_min_per_day=1e4), n_splits=4).first()
    assert r["thr"] > 0 and r["cv"] > 0


def test_threshold_cv_without_a_feasible_cut(spark):
    rows = scored(spark, [(i * US * 1000, 1.0, float(i), 0) for i in range(20)]).withColumn("score", F.col("pnl")).withColumn("seq", F.lit(0))
    r = A.threshold_cv(rows, ["sym"], "score", SPEC, n_splits=2).first()
    assert r["thr"] == 0 and r["cv"] == float("-inf")


def test_knee_and_clusters(spark):
    sweep = spark.createDataFrame([(5, 0.5), (8, 1.0), (12, 1.0), (40, 0.9)], "n_selected int, internal_score double")
    assert A.pick_n(sweep).first()["n_selected"] == 8
    imp = spark.createDataFrame([("a", 1, 0.9), ("b", 1, 0.5), ("c", 2, 0.7), ("d", 3, 0.1)], "feature string, cluster int, importance double")
    assert [r["feature"] for r in A.select_features(imp, 2).collect()] == ["a", "c"]


def test_unknown_source_is_an_error():
    assert Catalog("/d").path("trades", "BTC") == "/d/binance_trades/perp_btcusdt.parquet"
    assert Catalog("/d/").path("liq_bybit", "eth") == "/d/bybit_liquidations/ethusdt.parquet"
    with pytest.raises(ValueError):
        Catalog("/d").path("orders", "btc")


def write_feeds(spark, root, symbols=("btc", "eth"), files=2):
    """A data directory: each symbol's feeds lie in a folder of several files, with the same rows in each but other prices."""
    catalog = Catalog(str(root))
    for n, sym in enumerate(symbols):
        level = 100.0 * 10**n
        for k in range(files):
            t0 = k * 1000 * US
            deal = lambda rows: spark.createDataFrame([(t0 + t * US, sym, side, level * p, 1.0) for t, side, p in rows], "timestamp long, ticker string, side string, price double, amount double").coalesce(1)  # noqa: E731, B023
            frames = {
                "trades": deal([(1, "buy", 1.0), (2, "sell", 1.0)]),
                "liq_binance": deal([(0, "buy", 1.0)]),
                "liq_bybit": deal([(0, "sell", 1.0)]),
                "bbo": spark.createDataFrame([(t0 + t * US, sym, level - 0.5, 1.0, level + 0.5, 1.0) for t in (0, 100, 400)], "timestamp long, ticker string, bid_price double, bid_amount double, ask_price double, ask_amount double").coalesce(1),
            }
            for source, frame in frames.items():
                frame.write.mode("append").parquet(catalog.path(source, sym))
    return catalog


def test_rows_of_symbols_and_files_are_told_apart(spark, tmp_path):
    f = from_catalog(spark, write_feeds(spark, tmp_path), ["btc", "eth"], SPEC)
    rows = M.markouts(f).collect()
    assert len(rows) == len({r["trade_id"] for r in rows}) == 8
    assert all(r[f"pnl_{tau}"] == pytest.approx(0.5) for r in rows for tau in SPEC.taus)
    windows = E.liquidation_windows(f, "binance", (30,)).join(f.trades, "trade_id").collect()
    assert len(windows) == 8 and all(r["net_30"] == (100 if r["sym"] == "btc" else 1000) for r in windows)
    assert {(r["venue"], r["sym"], r["n"]) for r in eda.liquidation_summary(f).where("side = 'ALL' and h = 30").collect()} == {(v, s, 2) for v in ("binance", "bybit") for s in ("btc", "eth")}


def test_order_audit_counts_backward_steps(spark):
    times = [1, 2, 2, 1, 5, 3, 9]
    rows = trades(spark, [(t, 1, 1) for t in times])
    for bucket in (1 << 20, 4, 2, 1):
        assert validate_sorted(rows, bucket).first()["backward"] == 2
    assert validate_sorted(rows.orderBy("t").withColumn("seq", F.col("t") * 10 + F.col("seq")), 4).first()["backward"] == 0


def test_exact_quantiles_are_those_of_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    values = {"a": rng.normal(size=3000), "b": np.concatenate([np.zeros(900), -np.zeros(300), rng.integers(-3, 4, 300).astype(float)]), "c": np.array([5.0])}
    rows = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None), ("a", float("nan")), ("d", None)], "g string, v double").repartition(7)
    points = [0.0, 0.1, 0.25, 0.5, 0.77, 0.99, 1.0]
    got = {r["g"]: r["values"] for r in Q.exact_quantiles(rows, ["g"], "v", points, pieces=16).collect()}
    assert set(got) == set(values)
    for k, vs in values.items():
        assert got[k] == pytest.approx([float(np.quantile(vs, p)) for p in points], abs=1e-12)
    assert all(math.copysign(1, v) == 1 for v in got["b"] if v == 0)


def test_equal_windows_have_equal_sums_wherever_they_lie(spark):
    values = [0.1, 0.7, 1000.3, 77.777777, -0.3]
    far = 20 * SPEC.bucket_us
    events = [(k * far + i * US, v, 100) for k in range(12) for i, v in enumerate([1e7 / 3 + k, *values])]
    f = feeds(spark, [(k * far + 5 * US, 1, 100) for k in range(12)], [(0, 100)], [(t, v, p) for t, v, p in events])
    got = E.liquidation_windows(f, "binance", (5,)).collect()
    assert {r["net_5"] for r in got} == {math.fsum(values)} and {r["cnt_5"] for r in got} == {5}


def test_quantiles_at_whole_ranks_are_values(spark):
    for n in range(2, 3000):  # a rank that n p - p misses
        missed = [k for k in range(50) if (n - 1) * k % 50 == 0 and n * (k / 50) - k / 50 < (n - 1) * (k / 50) == (n - 1) * k // 50]
        if missed:
            break
    rows = spark.range(n).select(F.lit("a").alias("g"), (F.col("id") / 7).alias("v"))
    got = Q.exact_quantiles(rows, ["g"], "v", [k / 50 for k in missed], pieces=16).first()["values"]
    assert missed and got == [(n - 1) * k // 50 / 7 for k in missed]


def test_place_counts_cuts_below(spark):
    cuts = [-2.0, 0.0, 0.0, 1.5, 7.0]
    rows = spark.createDataFrame([(float(x),) for x in (-9, -2, -1, 0, 1, 1.5, 6, 7, 99)], "x double").withColumn("cuts", F.array(*map(F.lit, cuts)))
    for r in rows.select("x", X.place(F.col("cuts"), F.col("x"), 5).alias("a"), X.place(F.col("cuts"), F.col("x"), 5, up_to=True).alias("b")).collect():
        assert (r["a"], r["b"]) == (sum(c < r["x"] for c in cuts), sum(c <= r["x"] for c in cuts))


def signed_zeros(spark):
    """Scores of both zeros: as numbers they are one."""
    scores = [-5.0, -0.0, 0.0, -0.0, 0.0, 3.0, -0.0, 8.0] * 10
    return spark.createDataFrame([("x", i * DAY_US // 8, i, "2024", 2e5, float(i % 5 - 2), s, "train") for i, s in enumerate(scores)], "sym string, t long, seq long, month string, w double, pnl double, score double, split string").withColumns({"pnl_30": F.col("pnl"), "vol": F.col("w")})


def test_signed_zeros_are_one_value(spark):
    rows = signed_zeros(spark)
    plain = rows.withColumn("score", F.col("score") + 0.0)
    same = lambda f: sorted(map(repr, f(rows).collect())) == sorted(map(repr, f(plain).collect()))
    breaks = A.quantile_breaks(rows, ["sym"], "score", 5).first()["breaks"]
    assert breaks == sorted(set(breaks))
    curve = A.threshold_curve(rows, ["sym"], "score", SPEC).collect()
    assert all(r["n"] == 80 for r in curve) and len({r["thr"] for r in curve}) == len(curve)
    for f in (
        lambda d: A.conditional_markout(d, ["sym"], "score", "pnl_30").drop("lo", "hi"),
        lambda d: A.calibration(d, ["sym"], "score", "pnl_30"),
        lambda d: A.edge(d, ["sym"], "score", "pnl_30"),
        lambda d: A.threshold_curve(d, ["sym"], "score", SPEC),
        lambda d: A.threshold_cv(d, ["sym"], "score", SPEC, embargo_us=0),
        lambda d: A.fit_keep_best(d, ["sym"], "score", "pnl_30", 0.5),
        lambda d: A.regime_by_month(d, "score", "vol", (30,)),
    ):
        assert same(f)


def test_curve_is_the_filter_at_each_cut(spark):
    rows = signed_zeros(spark)
    for r in A.threshold_curve(rows, ["sym"], "score", SPEC, n=7).collect():
        f = rows.select("sym", "t", "w", "pnl", X.keep_below(F.col("score"), F.lit(r["thr"])).alias("f"))
        want = M.evaluate_filter(f, ["sym"], SPEC).first()
        for c in ("n", "n_days", "pnl_all", "pnl_kept", "pnl_filtered", "score", "turnover_per_day", "constraint_ok", "frac_w", "frac_n"):
            assert (r[c] is None) == (want[c] is None) and (r[c] is None or r[c] == pytest.approx(want[c])), c


def test_signal_contract(spark):
    f = feeds(spark, [(i, 1, 1) for i in range(6)], [(0, 1)])
    assert W.signal(f).agg(F.sum("f_30")).first()[0] == 0
    alternate = lambda g, tau: g.trades.select("trade_id", (F.col("trade_id") % 2).alias("f"))
    assert W.signal(f, filter_fn=alternate).agg(F.sum("f_120")).first()[0] == 3
    with pytest.raises(ValueError):
        W.signal(f, filter_fn=lambda g, tau: alternate(g, tau).limit(5))


def test_panel_has_73_features(spark):
    mids = [100, 100.1, 100, 100.2, 100.1, 100]
    f = feeds(spark, [(3_500_000, 1, 100.2), (4_500_000, -1, 100.1)], [(i * US, m) for i, m in enumerate(mids)], [(US, 500, 100), (2 * US, -300, 100)], [(US, 500, 100), (2 * US, -300, 100)])
    panel = P.panel(f)
    assert len(P.feature_columns(panel)) == 73
    r = panel.orderBy("trade_id").collect()
    assert [x["obi"] for x in r] == pytest.approx([1 / 3, 1 / 3]) and [x["obi_signed"] for x in r] == pytest.approx([1 / 3, -1 / 3])
    assert [x["xexch_liqpress_30s"] for x in r] == [0, 0]
    assert all(x["tfi_300s"] is None for x in r)


def test_boosting_stops_as_the_reference_does():
    assert ML.stop_round([1.0 - 0.01 * i for i in range(50)]) is None
    assert ML.stop_round([3.0, 2.0, 1.0] + [1.5] * 30) == 13  # the best round, then ten without a gain
    assert ML.stop_round([3.0, 2.0, 1.0] + [1.5] * 9 + [0.9] + [1.0] * 30) == 23


def test_boosting_fits_until_the_held_out_error_stops(spark):
    rows = spark.range(4000).select((F.col("id") / 4000).alias("a"), F.pmod(F.xxhash64("id"), F.lit(7)).cast("double").alias("b"), F.lit(1.0).alias("w")).withColumn("y", F.when(F.col("a") > 0.5, 4.0).otherwise(-4.0))
    model = ML.fit(rows, ["a", "b"], "y", iterations=30, depth=1)
    assert model.stages[0].getNumTrees <= 30
    assert inspect.signature(ML.fit).parameters["iterations"].default == 400
    x = ML.permutation_importance(model, rows.withColumn("trade_id", F.monotonically_increasing_id()), "y").collect()
    assert [r["feature"] for r in x] == ["a", "b"] and x[0]["importance"] > 1 and abs(x[1]["importance"]) < 0.01


def test_boosted_model_is_cut_and_not_fitted_again(spark, monkeypatch):
    from pyspark.ml.regression import GBTRegressor

    rows = small_panel(spark, 600)
    data = ML.assemble(rows, ["a", "b"]).select("_x", F.col("pnl_30").alias("_y"), F.lit(1.0).alias("_w"), (F.col("trade_id") % 10 == 0).alias("_held"))
    asked = []
    trainer = lambda n: asked.append(n) or GBTRegressor(featuresCol="_x", weightCol="_w", labelCol="_y", predictionCol="_p", maxIter=n, stepSize=0.05, maxDepth=2, seed=7)
    monkeypatch.setattr(ML, "stop_round", lambda errors: 4)
    cut = ML._fit_stopping(data, trainer, 9, "squared")
    assert asked == [9] and cut.getNumTrees == 4
    short = trainer(4).fit(data.where("not _held"))
    sums = [m.transform(data).agg(F.sum("_p"), F.max("_p")).first() for m in (cut, short)]
    assert sums[0] == pytest.approx(sums[1], abs=1e-9)


def test_importance_scores_all_features_in_one_pass(spark, monkeypatch):
    rows = small_panel(spark, 600).withColumn("w", F.col("w") + F.col("trade_id"))
    model = ML.fit(rows, ["a", "b"], "pnl_30", iterations=5, depth=2, min_leaf=5)
    error = lambda d: ML.predict(model, d, "_s").agg(F.sum(F.col("w") * (F.col("pnl_30") - F.col("_s")) * (F.col("pnl_30") - F.col("_s")))).first()[0]
    dealt = [ML.shuffled(rows, ["a", "b"], "trade_id", 100 * k) for k in range(2)]
    assert all(sorted(r[0] for r in d.select("_other.a").collect()) == sorted(r[0] for r in rows.select("a").collect()) for d in dealt)
    mean = rows.agg(M.weighted_mean(F.col("pnl_30"), F.col("w"))).first()[0]
    total = rows.agg(F.sum(F.col("w") * (F.col("pnl_30") - mean) * (F.col("pnl_30") - mean))).first()[0]
    want = {c: (sum(error(d.withColumn(c, F.col(f"_other.{c}"))) for d in dealt) / 2 - error(rows)) / total for c in ("a", "b")}
    calls, predict = [], ML.predict
    monkeypatch.setattr(ML, "predict", lambda *a: calls.append(1) or predict(*a))
    got = {r["feature"]: r["importance"] for r in ML.permutation_importance(model, rows, "pnl_30", repeats=2).collect()}
    assert len(calls) == 1 and got == pytest.approx(want, abs=1e-9) and got["a"] > 0.1


@pytest.mark.parametrize("kind", ["mse", "classifier", "quantile"])
def test_importance_predicts_each_row_once(spark, monkeypatch, kind):
    """The growth of the error is that of predictions of changed rows, for all kinds of models and trees of more than 63 leaves; no row is predicted more than once."""
    mixed = lambda i: F.pmod(F.xxhash64("trade_id", F.lit(i)), F.lit(1000)) / 1000.0
    rows = small_panel(spark, 600).select("trade_id", F.lit(1.0).alias("w"), mixed(1).alias("a"), F.when(mixed(2) > 0.1, mixed(2)).alias("b"), F.lit(3.0).alias("c"))
    rows = rows.withColumn("pnl_30", F.sin(F.col("a") * 9) + F.coalesce("b", F.lit(2.0)) * F.col("a") - 0.6).localCheckpoint()
    model = ML.fit(rows, ["a", "b", "c"], "pnl_30", kind, iterations=3, depth=8 if kind == "mse" else 3, min_leaf=1)
    if kind == "mse":
        assert max(t.numNodes for t in model.stages[0].trees) > 126
    error = lambda d: ML.predict(model, d, "_s").agg(F.sum((F.col("pnl_30") - F.col("_s")) ** 2)).first()[0]
    total = rows.agg(F.var_pop("pnl_30") * F.count("*")).first()[0]
    dealt = ML.shuffled(rows, ["a", "b", "c"], "trade_id", 0)
    want = {c: (error(dealt.withColumn(c, F.col(f"_other.{c}"))) - error(rows)) / total for c in ("a", "b", "c")}
    seen, predict = [], ML.predict
    monkeypatch.setattr(ML, "predict", lambda m, d, name: seen.append(d.count()) or predict(m, d, name))
    got = {r["feature"]: r["importance"] for r in ML.permutation_importance(model, rows, "pnl_30", repeats=1).collect()}
    assert got == pytest.approx(want, abs=1e-9) and got["a"] > 0.01 and got["c"] == 0
    assert seen == [rows.count()]


def test_model_queries_take_all_features_rounds_and_repeats(spark, monkeypatch):
    seen = {}
    panel = spark.createDataFrame([(1, "x", "train", 0.5, 1.0, 2.0)], "trade_id long, sym string, split string, pnl_30 double, obi double, rskew_30 double")
    monkeypatch.setattr(P, "panel", lambda f: panel)
    monkeypatch.setattr(ML, "fit", lambda rows, features, label, kind, **options: seen.update(features=features, options=options))
    monkeypatch.setattr(ML, "permutation_importance", lambda model, rows, label, repeats=3: seen.update(repeats=repeats))
    monkeypatch.setattr(catalogue, "from_events", lambda *a: None)
    catalogue.QUERIES["q_importance"](spark, "")
    assert seen == {"features": ["obi", "rskew_30"], "options": {}, "repeats": 3}


def small_panel(spark, n=1200):
    """Two symbols over half a year, with markouts that one feature explains."""
    h = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(2001)) / 1000.0 - 1
    first, end = SPEC.windows[0][1], SPEC.windows[-1][2]
    rows = spark.range(n).select(F.col("id").alias("trade_id"), F.when(F.col("id") % 2 == 0, "btc").otherwise("eth").alias("sym"), (F.lit(first) + F.col("id") * ((end - first) // n)).alias("t"), F.col("id").alias("seq"), F.lit(1e5).alias("w"), F.lit(100.0).alias("price"), h(1).alias("a"), h(2).alias("b"))
    rows = rows.withColumns({f"pnl_{tau}": F.col("a") * 3 + 0.1 for tau in SPEC.taus} | {"split": X.split_label(F.col("t"), SPEC), "day": X.day(F.col("t"))})
    return rows


def test_walk_forward_runs_models_by_symbol(spark):
    panel, spec = small_panel(spark), Spec(turnover_min_per_day=1.0)
    folds = W.walk_forward_folds(spec.windows[0][1], spec.windows[-1][2], spec, 2)
    sets = ST.spec_sets(["a", "b"], spec, iterations=3, min_leaf=5, depth=2)
    assert set(sets) == {"baseline", "regime", "objective", "features", "shipped"} and len(sets["regime"]) == 4
    got = ST.evaluate_specs(panel, {"baseline_mse": sets["baseline"]["baseline_mse"], "quantile_50": sets["objective"]["quantile_50"]}, (30,), folds, spec).collect()
    assert {(r["sym"], r["spec"], r["fold"]) for r in got} == {(s, n, m) for s in ("btc", "eth") for n in ("baseline_mse", "quantile_50") for m in ("2026-03", "2026-04")}
    assert all(r["score"] > 0.3 for r in got)
    assert A.summarize(ST.evaluate_specs(panel, {"x": sets["baseline"]["baseline_mse"]}, (30,), folds, spec), ["sym"]).count() == 2


def test_models_by_cell_are_stored_and_read(spark, tmp_path):
    panel = small_panel(spark).where("sym = 'eth'")
    for tau, kind in ((120, "quantile"), (30, "mae")):
        model = ST.fit_cell(panel, ["a", "b"], "eth", tau, iterations=3, min_leaf=5, depth=2)
        assert model.kind == kind
        model.threshold = 0.25
        ML.save(model, spark, f"{tmp_path}/{tau}")
        back, cut = ML.load(spark, f"{tmp_path}/{tau}")
        one, two = (ML.predict(m, panel, "p").agg(F.sum("p"), F.min("p")).first() for m in (model, back))
        assert cut == 0.25 and tuple(one) == pytest.approx(tuple(two))
    assert ML.load(spark, f"{tmp_path}/none") == (None, None)
    with pytest.raises(ValueError):
        ST.fit_cell(panel, ["a"], "eth", 30, models={("eth", 30): {"kind": "oracle"}})


def test_feature_selection(spark):
    panel, spec = small_panel(spark), Spec(turnover_min_per_day=1.0)
    options = {"iterations": 3, "min_leaf": 5, "depth": 2}
    fit_block, held, importance, cluster = ST.importance_of(panel, ["a", "b"], 30, "btc", spec, repeats=1, **options)
    last, first = fit_block.agg(F.max("t")).first()[0], held.agg(F.min("t")).first()[0]
    assert first - last >= spec.embargo_us and 0.15 < held.count() / (held.count() + fit_block.count()) < 0.25
    assert importance["a"] > importance["b"] and len(set(cluster.values())) == 2
    assert ST.select(importance, cluster, 1) == ["a"] and ST.select(importance, {"a": 0, "b": 0}, 2) == ["a"]
    sweep = ST.sweep_n(fit_block, held, importance, cluster, "btc", 30, spec, (1, 2, 40), **options)
    assert [r["n_selected"] for r in sweep.orderBy("n_selected").collect()] == [1, 2] and A.pick_n(sweep).first()["n_selected"] == 1
    ranks = spark.createDataFrame([("btc", 30, "a", 0, 0.5)], "sym string, tau int, feature string, rank int, importance double")
    got = {(r["sym"], r["feature"]): r for r in ST.explain_cell(panel, ["a", "b"], 30, ranks, ["a"]).collect()}
    assert got["btc", "a"]["sign"] == 1 and got["btc", "a"]["survived"] == got["btc", "a"]["months"] and got["btc", "a"]["rank"] == 0
    assert got["eth", "b"]["rank"] == -1 and not got["eth", "b"]["curated"]


def test_mutual_information_and_samples(spark):
    panel = small_panel(spark)
    mi = {c: {r["sym"]: r["mi"] for r in ST.mutual_information(panel, ["sym"], c, "pnl_30").collect()} for c in ("a", "b")}
    assert mi["a"]["btc"] == pytest.approx(math.log(10), abs=0.01) and mi["b"]["btc"] < 0.2
    some = [r["trade_id"] for r in ST.seeded_sample(panel, "trade_id", 9, 3).collect()]
    assert len(set(some)) == 9 and some == [r["trade_id"] for r in ST.seeded_sample(panel.repartition(5), "trade_id", 9, 3).collect()]
    profile = spark.createDataFrame([("x", -2.0, 2.0), ("x", -1.0, 4.0), ("x", 0.0, 6.0)], "k string, o double, y double")
    assert [r["y"] for r in ST.pre_normalised(profile, ["k"], "o", "y").orderBy("o").collect()] == pytest.approx([2 / 3, 4 / 3, 2])


def test_time_units_and_symbols(spark):
    assert [W.time_unit(1_762_000_000 * 10**k) for k in (0, 3, 6, 9)] == ["seconds", "milliseconds", "microseconds", "nanoseconds"] and W.time_unit(5) is None
    frame = lambda ticker, price: spark.createDataFrame([(ticker, price)], "ticker string, price double")
    assert W.infer_symbol(frame("ETHUSDT", 1e5)) == "eth" and W.infer_symbol(frame(None, 9e4)) == "btc" and W.infer_symbol(frame(None, 3e3)) == "eth"
    assert W.infer_symbol(frame(None, 1.0).limit(0)) is None and W.infer_symbol(frame(None, 9e4), frame("eth", 1.0)) == "eth"


def test_signal_on_raw_frames(spark):
    deal = spark.createDataFrame([(1_762_000_000_000 + 1000 * i, "buy", 3000.0 + i, 1.0) for i in range(6)], "timestamp long, side string, price double, amount double")
    bbo = spark.createDataFrame([(1_762_000_000_000 + 500 * i, 2999.5, 1.0, 3000.5, 2.0) for i in range(12)], "timestamp long, bid_price double, bid_amount double, ask_price double, ask_amount double")
    got = W.signal_frames(deal, bbo, deal.limit(2), deal.limit(1), SPEC).collect()
    assert len(got) == 6 and all(r["f_30"] == r["f_300"] == 0 for r in got)
    got = W.signal_frames(deal, bbo, deal, deal, SPEC, symbol="eth", filter_fn=lambda f, tau: f.trades.select("trade_id", (F.col("price") > 3002).cast("int").alias("f"))).collect()
    assert sum(r["f_120"] for r in got) == 3


def test_stream_carries_the_last_mid(spark, tmp_path):
    rows = [("x", 10 * US, 1, 100.0, True), ("x", 11 * US, 2, None, False), ("x", 12 * US, 3, 101.0, True), ("x", 12 * US, 4, None, False), ("y", 11 * US, 5, None, False), ("x", 9 * US, 6, None, False)]
    late = [(s, 4000 * US, 9, 1.0, True) for s in "xy"]
    schema = "sym string, t long, seq long, mid double, is_quote boolean"
    for k, part in enumerate((rows, late, [(s, 8000 * US, 10, 1.0, True) for s in "xy"])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        S.to_files(S.asof_mid(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/state")
    got = {r["seq"]: r["mid"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {2: 100.0, 4: 101.0, 5: None, 6: None}


def test_command_lines(spark, tmp_path):
    write_feeds(spark, tmp_path / "data")
    run = lambda *a: cli.main([*a, "--data-dir", f"{tmp_path}/data", "--out", f"{tmp_path}/out", "--rows", "100"], spark)
    for command in ("baselines", "flowgrid", "panel", "evaluate", "eda"):
        run(command)
    read = lambda name: spark.read.parquet(f"{tmp_path}/out/{name}")
    assert read("panel").count() == 8 and read("evaluation").count() == 6 and read("eda_inventory").agg(F.sum("n")).first()[0] == 2 * 2 * (2 + 1 + 1 + 3)
    with pytest.raises(SystemExit):
        run("nonsense")
