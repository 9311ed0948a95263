"""Models of the markout: boosted trees by several losses, storage, importance, feature clusters."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators.leaves import ROWS, leaves_of, moves
from tidemark.operators.markout import weighted_mean
from tidemark.spec import DAY_US

#: Stands for a missing value: trees split it off, as they accept no NULL. Far below any feature.
MISSING = -1e12
#: Early stopping: one row of so many is held out, and rounds end when so many in a row gained less than the least gain.
HELD_OUT, PATIENCE, LEAST_GAIN = 10, 10, 1e-7
#: Tasks that score the variants of permutation importance.
SCORE_TASKS = 64


@dataclass
class Model:
    kind: str
    features: list[str]
    stages: list = field(default_factory=list)
    threshold: float | None = None


def _filled(features: list[str]) -> dict[str, Column]:
    return {c: F.when(X.finite(F.col(c).cast("double")), F.col(c).cast("double")).otherwise(MISSING) for c in features}


def assemble(rows: DataFrame, features: list[str]) -> DataFrame:
    filled = rows.withColumns({f"_x_{c}": v for c, v in _filled(features).items()})
    out = VectorAssembler(inputCols=[f"_x_{c}" for c in features], outputCol="_x").transform(filled)
    return out.drop(*[f"_x_{c}" for c in features])


def recency(rows: DataFrame, tau_days: float) -> DataFrame:
    """``rows`` with ``w`` falling by a factor of e for each ``tau_days`` before the newest row."""
    newest = F.broadcast(rows.agg(F.max("t").alias("_newest")))
    return rows.crossJoin(newest).withColumn("w", X.recency_weight(F.col("w"), (F.col("_newest") - F.col("t")) / DAY_US, tau_days)).drop("_newest")


def stop_round(errors: list[float], patience: int = PATIENCE) -> int | None:
    """The first round after which the last ``patience`` errors are all no better than the one before them."""
    for n in range(patience + 1, len(errors) + 1):
        if min(errors[n - patience : n]) >= errors[n - patience - 1] - LEAST_GAIN:
            return n
    return None


def fit(rows: DataFrame, features: list[str], label: str, kind: str = "mse", iterations: int = 400, depth: int = 5, min_leaf: int = 200, alpha: float = 0.5, tau_days: float = 30.0, step: float = 0.05) -> Model:
    """Fits on rows with a finite label, weighted by ``w``: ``mse``, ``mae``, ``recency``, ``quantile`` or ``classifier``.

    All but ``quantile`` hold out a tenth, drawn by a hash of the row, and stop early by its error.
    """
    known = rows.where(X.finite(F.col(label)))
    if kind == "recency":
        known = recency(known, tau_days)
    draw = F.pmod(F.xxhash64(*features, label), F.lit(HELD_OUT)) == 0
    data = assemble(known, features).select("_x", F.col("w").alias("_w"), F.col(label).cast("double").alias("_y"), draw.alias("_held"))
    common = {"featuresCol": "_x", "weightCol": "_w", "maxDepth": depth, "minInstancesPerNode": min_leaf, "seed": 7}
    if kind in ("mse", "mae", "recency"):
        loss = "absolute" if kind == "mae" else "squared"
        return Model(kind, features, [_fit_stopping(data, lambda n: GBTRegressor(labelCol="_y", lossType=loss, maxIter=n, stepSize=step, predictionCol="_p", **common), iterations, loss)])
    if kind == "classifier":
        data = data.withColumn("_y", (F.col("_y") > 0).cast("double"))
        return Model(kind, features, [_fit_stopping(data, lambda n: GBTClassifier(labelCol="_y", maxIter=n, stepSize=step, predictionCol="_p", **common), iterations)])
    if kind == "quantile":
        return _fit_quantile(data.drop("_held"), features, alpha, iterations, step, common)
    raise ValueError(f"unknown kind of model: {kind!r}")


def _fit_stopping(data: DataFrame, trainer, iterations: int, *loss: str):
    """``validationIndicatorCol`` ends at the first round without gain; here ``stop_round`` decides, and the model is cut there.

    A round does not depend on how many follow, so there are two fits at most: a short one, and if it did not stop one of all rounds.
    """
    data = data.persist()
    learn, held = data.where(~F.col("_held")), data.where("_held")
    try:
        if held.isEmpty() or learn.isEmpty():
            return trainer(iterations).fit(data)
        for rounds in sorted({min(4 * PATIENCE, iterations), iterations}):
            model = trainer(rounds).fit(learn)
            stop = stop_round(model.evaluateEachIteration(held, *loss))
            if stop is not None:
                return _first_trees(model, stop)
        return model
    finally:
        data.unpersist()


def _first_trees(model, n: int):
    """The boosted model after its first ``n`` rounds."""
    java, jvm = model._java_obj, SparkSession.active().sparkContext._jvm
    kind = getattr(jvm, java.getClass().getName())
    return model._copyValues(type(model)(kind(java.uid(), java.trees()[:n], java.treeWeights()[:n])))


def _fit_quantile(data: DataFrame, features: list[str], alpha: float, rounds: int, step: float, common: dict) -> Model:
    """Boosting of the pinball loss: trees follow its gradient, and each leaf takes the quantile of its residuals."""
    start = data.agg(F.percentile("_y", F.lit(alpha)).alias("q")).first()["q"] or 0.0
    model = Model("quantile", features, [float(start)])
    now = data.withColumn("_p", F.lit(float(start))).persist()
    for _ in range(rounds):
        target = now.withColumn("_g", F.when(F.col("_y") > F.col("_p"), alpha).otherwise(alpha - 1.0))
        tree = DecisionTreeRegressor(labelCol="_g", predictionCol="_t", leafCol="_leaf", **common).fit(target)
        leaves = tree.transform(now)
        values = {int(r["_leaf"]): float(r["v"]) for r in leaves.groupBy("_leaf").agg(F.percentile(F.col("_y") - F.col("_p"), F.lit(alpha)).alias("v")).collect()}
        model.stages.append((tree, {k: step * v for k, v in values.items()}))
        after = _add(leaves, values, step).select("_x", "_w", "_y", "_p").persist()
        after.count()
        now.unpersist()
        now = after
    now.unpersist()
    return model


def _add(leaves: DataFrame, values: dict[int, float], step: float = 1.0) -> DataFrame:
    table = F.create_map(*[F.lit(x) for k, v in values.items() for x in (float(k), step * v)])
    return leaves.withColumn("_p", F.col("_p") + F.coalesce(table[F.col("_leaf")], F.lit(0.0))).drop("_leaf", "_t")


def predict(model: Model, rows: DataFrame, name: str = "score") -> DataFrame:
    """``rows`` with the model's prediction; the probability of a positive markout for a classifier."""
    data = assemble(rows, model.features)
    if model.kind == "quantile":
        out = data.withColumn("_p", F.lit(model.stages[0]))
        for tree, values in model.stages[1:]:
            out = _add(tree.transform(out), values)
        return out.withColumnRenamed("_p", name).drop("_x")
    out = model.stages[0].transform(data)
    value = vector_to_array("probability")[1] if model.kind == "classifier" else F.col("_p")
    return out.withColumn(name, value).drop("_x", "_p", "probability", "rawPrediction")


def save(model: Model, spark: SparkSession, path: str) -> None:
    """Stores the trees and one row of metadata. Quantile models keep their leaf values there."""
    import json

    trees = [model.stages[0]] if model.kind != "quantile" else [t for t, _ in model.stages[1:]]
    PipelineModel(trees).write().overwrite().save(f"{path}/trees")
    leaves = json.dumps([model.stages[0], [[list(map(list, v.items()))] for _, v in model.stages[1:]]]) if model.kind == "quantile" else ""
    spark.createDataFrame([(model.kind, model.features, model.threshold, leaves)], "kind string, features array<string>, threshold double, leaves string").write.mode("overwrite").parquet(f"{path}/meta")


def load(spark: SparkSession, path: str) -> tuple[Model | None, float | None]:
    """The model and its threshold, (None, None) where nothing is stored."""
    import json

    from pyspark.errors import AnalysisException

    try:
        meta = spark.read.parquet(f"{path}/meta").first()
    except AnalysisException:
        return None, None
    trees = PipelineModel.load(f"{path}/trees").stages
    stages: list = list(trees)
    if meta["kind"] == "quantile":
        start, values = json.loads(meta["leaves"])
        stages = [start, *[(t, {int(k): v for k, v in pairs[0]}) for t, pairs in zip(trees, values, strict=True)]]
    return Model(meta["kind"], list(meta["features"]), stages, meta["threshold"]), meta["threshold"]


def weighted_r2(rows: DataFrame, label: str, score: str) -> float:
    y, p, w = F.col(label), F.col(score), F.col("w")
    known = rows.where(X.finite(y))
    mean = F.broadcast(known.agg(weighted_mean(y, w).alias("_m")))
    r = known.crossJoin(mean).agg((1 - F.sum(w * (y - p) * (y - p)) / F.sum(w * (y - F.col("_m")) * (y - F.col("_m")))).alias("r2")).first()
    return float(r["r2"]) if r["r2"] is not None else 0.0


def shuffled(rows: DataFrame, columns: list[str], key: str, seed: int, buckets: int = 64) -> DataFrame:
    """``rows`` with ``_other``, the columns of another row, each row's once: within hashed buckets the next one's, in hash order."""
    h = F.xxhash64(key, F.lit(seed))
    order = Window.partitionBy("_b").orderBy("_h", key)
    dealt = rows.withColumns({"_h": h, "_b": F.pmod(F.xxhash64(key, F.lit(seed + 1)), F.lit(buckets)), "_own": F.struct(*columns)})
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return dealt.withColumn("_other", F.coalesce(F.lead("_own").over(order), F.first("_own").over(whole))).drop("_h", "_b", "_own")


def _trees(model: Model) -> list[tuple]:
    """The trees of a model with their weights, or with the values of their leaves."""
    return list(zip(model.stages[0].trees, model.stages[0].treeWeights, strict=True)) if model.kind != "quantile" else model.stages[1:]


def permutation_importance(model: Model, rows: DataFrame, label: str, key: str = "trade_id", repeats: int = 3) -> DataFrame:
    """``feature, importance``: mean loss of weighted R2 when a feature is permuted.

    One permutation of the rows serves all features of a repeat. Rows are predicted once; what a permuted feature adds to the
    prediction is found from the trees' leaves, so that a row is neither copied nor walked through all trees for each feature.
    """
    y, w = F.col(label), F.col("w")
    known = rows.where(X.finite(y)).select(key, label, "w", *model.features)
    known = predict(model, known, "_s").select(key, y.cast("double").alias("_y"), F.coalesce(w.cast("double"), F.lit(0.0)).alias("_w"), "_s", F.array(*_filled(model.features).values()).alias("_own_x")).persist()
    mean = known.agg(weighted_mean(F.col("_y"), F.col("_w")).alias("m")).first()["m"] or 0.0
    total = known.agg(F.sum(F.col("_w") * (F.col("_y") - mean) * (F.col("_y") - mean)).alias("t")).first()["t"]
    out = dict.fromkeys(model.features, 0.0)
    if total:
        leaves, linked, n = leaves_of(_trees(model)), model.kind == "classifier", len(model.features)
        chance = lambda m: 1 / (1 + np.exp(-2 * m))

        def losses(batches):
            """The growth of the weighted squared error of a task's rows, by feature."""
            sums = np.zeros(n)
            for batch in batches:
                table = lambda name: batch.column(name).flatten().to_numpy().reshape(-1, n)
                own, other = table("_own_x"), table("_other_x")
                left, weight = batch.column("_y").to_numpy() - batch.column("_s").to_numpy(), batch.column("_w").to_numpy()
                for i in range(0, len(own), ROWS):
                    part = slice(i, i + ROWS)
                    base, moved = moves(leaves, own[part], other[part])
                    for f, d in moved.items():
                        d = chance(base + d) - chance(base) if linked else d
                        sums[f] += np.sum(weight[part] * d * (d - 2 * left[part]))
            yield pa.RecordBatch.from_pydict({"f": np.arange(n), "e": sums})

        # Dealt again, as the windows' few tasks would score all rows.
        pairs = reduce(DataFrame.unionByName, [shuffled(known, ["_own_x"], key, 100 * k) for k in range(repeats)]).repartition(SCORE_TASKS)
        grown = pairs.select("_y", "_s", "_w", "_own_x", F.col("_other._own_x").alias("_other_x")).mapInArrow(losses, "f long, e double")
        grown = {r["f"]: r["e"] for r in grown.groupBy("f").agg(F.sum("e").alias("e")).collect()}
        out = {c: grown[i] / repeats / total for i, c in enumerate(model.features)}
    known.unpersist()
    return rows.sparkSession.createDataFrame(list(out.items()), "feature string, importance double")


def impute_median(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values become the column's median, 0 where a column has no value at all."""
    known = rows.agg(*[F.count_if(X.finite(F.col(c))).alias(c) for c in columns]).first()
    some = [c for c in columns if known[c]]
    filled = rows.withColumns({c: F.when(X.finite(F.col(c)), F.col(c)) for c in some} | {c: F.lit(0.0) for c in columns if c not in some})
    return Imputer(inputCols=some, outputCols=some, strategy="median").fit(filled).transform(filled) if some else filled


def correlation(rows: DataFrame, columns: list[str]) -> np.ndarray:
    """Pearson matrix of the imputed columns; its size is that of the feature list, not of the data."""
    data = VectorAssembler(inputCols=columns, outputCol="_x").transform(impute_median(rows, columns))
    return np.nan_to_num(Correlation.corr(data, "_x").first()[0].toArray())


def clusters(corr: np.ndarray, columns: list[str], cut: float = 0.25) -> dict[str, int]:
    """Average linkage on 1 - |r|, cut at a distance."""
    far = 1 - np.abs(corr)
    groups = [[i] for i in range(len(columns))]
    while len(groups) > 1:
        d, a, b = min((float(np.mean(far[np.ix_(x, y)])), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j)
        if d > cut:
            break
        groups[a] += groups.pop(b)
    return {columns[i]: n for n, g in enumerate(groups) for i in g}


def principal_components(rows: DataFrame, columns: list[str], k: int) -> tuple[DataFrame, list[float]]:
    data = VectorAssembler(inputCols=columns, outputCol="_v").transform(impute_median(rows, columns))
    scaled = StandardScaler(withMean=True, inputCol="_v", outputCol="_s").fit(data).transform(data)
    model = PCA(k=k, inputCol="_s", outputCol="pca").fit(scaled)
    return model.transform(scaled).drop("_v", "_s"), [float(x) for x in model.explainedVariance]
