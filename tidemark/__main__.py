"""Command lines: ``python -m tidemark <command> --data-dir D --out O``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import eda, ml, study
from tidemark.operators import features as P
from tidemark.operators import grid as G
from tidemark.operators import markout as M
from tidemark.operators import walkforward as W
from tidemark.operators.analysis import missingness, regime_by_month, summarize, threshold_cv
from tidemark.operators.lineage import written
from tidemark.sources.feeds import Catalog, Feeds, from_catalog, inventory, sample_trades
from tidemark.spec import Spec


class Run:
    """What every command takes: the session, the feeds, and the folder of results."""

    def __init__(self, spark: SparkSession, args: argparse.Namespace):
        self.spark, self.args, self.out, self.spec = spark, args, args.out.rstrip("/"), Spec()
        self.catalog = Catalog(args.data_dir)

    def feeds(self) -> Feeds:
        return from_catalog(self.spark, self.catalog, self.args.symbols, self.spec)

    def write(self, df: DataFrame, name: str) -> None:
        W.write_artifact(df, f"{self.out}/{name}") if "sym" in df.columns else df.write.mode("overwrite").parquet(f"{self.out}/{name}")

    def panel(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.out}/panel")

    def iterations(self) -> dict:
        return {"iterations": self.args.iterations, "min_leaf": self.args.min_leaf}


def baselines(run: Run) -> None:
    run.write(M.baselines(M.markouts(run.feeds()), run.spec, ("train", "val", "test")), "baselines")


def flowgrid(run: Run) -> None:
    run.write(G.flow_grid(run.feeds()), "flow_grid")


def panel(run: Run) -> None:
    """Markouts and features of every k-th trade; ``step`` is that k."""
    feeds = run.feeds()
    some, step = sample_trades(feeds.trades, run.args.rows)
    run.write(P.panel(Feeds(some, feeds.book, feeds.binance, feeds.bybit, feeds.spec, feeds.trades)).withColumn("step", F.lit(step)), "panel")


def _scored(run: Run) -> DataFrame:
    rows, features = run.panel(), P.feature_columns(run.panel().drop("step"))
    for tau in run.spec.taus:
        out = None
        for s in run.args.symbols:
            model, _ = ml.load(run.spark, W.model_path(f"{run.out}/models", s, tau))
            one = rows.where(F.col("sym") == s)
            one = ml.predict(model, one, f"score_{tau}") if model is not None else one.withColumn(f"score_{tau}", F.lit(0.0))
            out = one if out is None else out.unionByName(one)
        rows = out
    return rows.select(*[c for c in rows.columns if c not in features], *features)


def train(run: Run) -> None:
    """A model and a threshold for each symbol and horizon."""
    rows = written(run.panel())
    features, step = P.feature_columns(rows.drop("step")), rows.agg(F.max("step")).first()[0] or 1
    learn = rows.where("split = 'train'")
    for s in run.args.symbols:
        for tau in run.spec.taus:
            model = study.fit_cell(learn, features, s, tau, **run.iterations())
            scored = ml.predict(model, learn.where(F.col("sym") == s), "score").withColumn("pnl", F.col(f"pnl_{tau}"))
            cut = threshold_cv(scored, ["sym"], "score", run.spec, scale=step, min_keep=run.args.min_keep_frac).first()
            model.threshold = None if cut is None else float(cut["thr"])
            ml.save(model, run.spark, W.model_path(f"{run.out}/models", s, tau))


def walkforward(run: Run) -> None:
    rows = written(run.panel())
    step = rows.agg(F.max("step")).first()[0] or 1
    windows = run.spec.windows
    folds = W.walk_forward_folds(windows[0][1], windows[-1][2], run.spec, run.args.n_oos)
    specs = study.spec_sets(P.feature_columns(rows.drop("step")), run.spec, **run.iterations())[run.args.specs]
    found = study.evaluate_specs(rows, specs, run.args.taus, folds, run.spec, step)
    if found is None:
        raise SystemExit("no fold has rows on both sides")
    found = written(found)
    run.write(found, f"walkforward_{run.args.specs}")
    print(W.markdown_table(summarize(found, ["sym", "spec", "tau"])))


def feature_select(run: Run) -> None:
    rows = written(run.panel())
    features, step = P.feature_columns(rows.drop("step")), rows.agg(F.max("step")).first()[0] or 1
    ranks, sweeps = [], None
    for s in run.args.symbols:
        for tau in run.args.taus:
            fit_block, held, importance, cluster = study.importance_of(rows, features, tau, s, run.spec, **run.iterations())
            ranks += [(s, tau, f, i, importance[f]) for i, f in enumerate(sorted(importance, key=lambda f: (-importance[f], f)))]
            one = study.sweep_n(fit_block, held, importance, cluster, s, tau, run.spec, step=step, **run.iterations()).withColumns({"sym": F.lit(s), "tau": F.lit(tau)})
            sweeps = one if sweeps is None else sweeps.unionByName(one)
    run.write(sweeps, "feature_sweep")
    run.write(run.spark.createDataFrame(ranks, "sym string, tau int, feature string, rank int, importance double"), "feature_ranks")


def feature_explain(run: Run) -> None:
    rows, ranks = written(run.panel()), run.spark.read.parquet(f"{run.out}/feature_ranks")
    out = None
    for tau in run.args.taus:
        one = study.explain_cell(rows, P.feature_columns(rows.drop("step")), tau, ranks)
        out = one if out is None else out.unionByName(one)
    run.write(out, "feature_explanations")


def regime(run: Run) -> None:
    run.write(regime_by_month(run.panel(), "ret_5s_signed", "rv_300s", run.spec.taus), "regime")


def report(run: Run) -> None:
    rows = written(_scored(run))
    step = rows.agg(F.max("step")).first()[0] or 1
    found = written(study.report(rows, run.spec.taus, lambda tau: f"score_{tau}", "ret_5s_signed", run.spec, step=step))
    run.write(found, "report")
    run.write(study.monthly_stability(rows, run.spec.taus, lambda tau: f"score_{tau}", run.spec, step), "monthly_stability")
    run.write(missingness(rows, ["sym"], P.feature_columns(rows.drop("step"))), "missingness")
    print(W.markdown_table(W.pivot_methods(found, ["sym", "split", "tau"], ["keep_all", "expected_value", "score_max", "reference"])))


def evaluate(run: Run) -> None:
    """``signal`` with the stored models on every trade of a data directory, and its score by symbol and horizon."""
    out = None
    for s in run.args.symbols:
        feeds = from_catalog(run.spark, run.catalog, [s], run.spec)
        models = {tau: ml.load(run.spark, W.model_path(f"{run.out}/models", s, tau))[0] for tau in run.spec.taus}
        filters = W.signal(feeds, {tau: m for tau, m in models.items() if m is not None})
        rows = M.markouts(feeds).join(filters, "trade_id")
        for tau in run.spec.taus:
            one = M.evaluate_filter(rows.select("sym", "t", "w", F.col(f"pnl_{tau}").alias("pnl"), F.col(f"f_{tau}").alias("f")), ["sym"], run.spec).withColumn("tau", F.lit(tau))
            out = one if out is None else out.unionByName(one)
    out = written(out)
    run.write(out, "evaluation")
    print(W.markdown_table(out))


def explore(run: Run) -> None:
    """The tables behind the exploration: bars, histograms, event studies, cascades, inventory."""
    f = run.feeds()
    bars = eda.minute_bars_trades(f)
    tables = {"minute_trades": bars, "minute_bbo": eda.minute_bars_book(f), "hist_notional": eda.log_histogram(f.trades, "notional", ["sym"]), "hist_spread": eda.spread_histogram(f), "daily": eda.daily_from_bars(bars), "hourly": eda.hourly_from_bars(bars), "burstiness": eda.burstiness(bars), "venue_corr": eda.venue_corr(f), "liquidations": eda.liquidation_summary(f), "cascade_profile": eda.cascade_profile(f), "cascade_phases": eda.cascade_phases(f), "cascade_meta": eda.cascade_meta(f), "inventory": inventory(run.spark, run.catalog, run.args.symbols)}
    for name, table in tables.items():
        run.write(table, f"eda_{name}")


COMMANDS = {"baselines": baselines, "flowgrid": flowgrid, "panel": panel, "train": train, "walkforward": walkforward, "feature-select": feature_select, "feature-explain": feature_explain, "regime": regime, "report": report, "evaluate": evaluate, "eda": explore}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    parser.add_argument("command", choices=sorted(COMMANDS))
    parser.add_argument("--data-dir", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--symbols", nargs="+", default=["btc", "eth"])
    parser.add_argument("--taus", nargs="+", type=int, default=list(Spec().taus))
    parser.add_argument("--rows", type=int, default=3_000_000, help="trades of the panel, about")
    parser.add_argument("--specs", default="baseline", choices=["baseline", "regime", "objective", "features", "shipped"])
    parser.add_argument("--n-oos", type=int, default=3)
    parser.add_argument("--min-keep-frac", type=float, default=0.05)
    parser.add_argument("--iterations", type=int, default=400)
    parser.add_argument("--min-leaf", type=int, default=200)
    args = parser.parse_args(argv)
    COMMANDS[args.command](Run(spark or SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate(), args))


if __name__ == "__main__":
    main()
