"""Random-forest demand models on Spark ML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hailgrid.operators import metrics, splits
from hailgrid.session import materialize

# The features, and which of them each model type one-hot encodes.
FEATURES = ("grid_x", "grid_y", "weekday", "hour", "fahrenheit", "precip_in")
CATEGORICAL = {
    "1": (),
    "2": ("weekday", "hour"),
    "3": ("weekday", "hour", "grid_x", "grid_y"),
}
# Rows that one task of a fit reads.
ROWS_PER_PARTITION = 200_000
# Added to a seed for the folds, so that they are drawn apart from the splits.
FOLD_SEED = 1_000
ROW_KEY = ("pickup_datetime", "grid_x", "grid_y", "precip_in")


def features_and_label(joined: DataFrame, label: str = "count") -> DataFrame:
    """The six features and the label, for any number of periods at once."""
    return joined.select(*FEATURES, label)


def build_pipeline(model_type: str, label: str = "count_scaled", weight: str | None = None, seed: int = 1, **params) -> Pipeline:
    """Encoder (types 2 and 3), assembler and forest."""
    if model_type not in CATEGORICAL:
        raise ValueError("model type must be '1', '2' or '3'")
    encoded = CATEGORICAL[model_type]
    stages = []
    if encoded:
        # 'keep' gives a category a fold has not seen its own slot instead of an error
        stages.append(
            OneHotEncoder(inputCols=list(encoded), outputCols=[f"{c}_vec" for c in encoded], handleInvalid="keep")
        )
    inputs = [f"{c}_vec" if c in encoded else c for c in FEATURES]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    forest = RandomForestRegressor(featuresCol="features", labelCol=label, seed=seed, **params)
    if weight:
        forest = forest.setWeightCol(weight)
    stages.append(forest)
    return Pipeline(stages=stages)


def evaluator(label: str = "count_scaled", metric: str = "rmse", weight: str | None = None) -> RegressionEvaluator:
    out = RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName=metric)
    return out.setWeightCol(weight) if weight else out


def model_table(joined: DataFrame, keys: Sequence[str] = ROW_KEY) -> DataFrame:
    """The joined rows written once, evenly spread and in a fixed order.

    Fitting reads its input many times and must not go back to the rides. The number of partitions follows the
    rows, with as many as there are shuffle partitions at least, and a fixed order makes a seeded fit repeatable.
    """
    rows = materialize(joined)
    least = int(joined.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-rows.count() // ROWS_PER_PARTITION))
    return materialize(rows.repartition(parts, *keys).sortWithinPartitions(*keys))


@dataclass
class ForestSearch:
    """The scores of a search, one row per parameter set (num_trees, max_depth, min_instances, mean error over the folds),
    the rows of each fold, and the model fitted to all training rows with the best set."""

    bestModel: PipelineModel
    scores: list[tuple[int, int, int, float]]
    fold_rows: list[int]

    def transform(self, df: DataFrame) -> DataFrame:
        return self.bestModel.transform(df)


@dataclass
class ForestResult:
    """``predictions`` and ``rmse`` are those of the test rows, and ``dev`` and ``dev_rmse`` those of the development rows."""

    model: ForestSearch
    train: DataFrame
    predictions: DataFrame
    rmse: float
    dev: DataFrame
    dev_rmse: float

    @property
    def best(self) -> PipelineModel:
        return self.model.bestModel


def fold_of(keys: Sequence[str], num_folds: int, seed: int = 1) -> Column:
    """The fold 0 .. num_folds - 1 of a row, from a hash of its key: the same wherever and however often the row is read."""
    if num_folds < 2:
        raise ValueError("at least two folds are needed")
    return F.floor(splits.uniform(keys, seed + FOLD_SEED) * num_folds).cast("int")


def _least_weight(rows: DataFrame, weight: str | None, min_instances: int) -> dict[str, object]:
    """Forest parameters that keep ``min_instances`` records in each child, a row of weight n being n of them.

    The bound is a share of all weight; half a record less makes it exact for whole weights whatever the rounding.
    """
    if not weight:
        return {"minInstancesPerNode": min_instances}
    total = rows.agg(F.sum(weight)).first()[0] or 0
    share = (min_instances - 0.5) / total if total else 0.0
    # a share of a half or more, which no split can meet on both sides, is not admitted as a parameter
    return {"minInstancesPerNode": 1, "minWeightFractionPerNode": min(max(share, 0.0), 0.4999999)}


def prefix_rmse(model: PipelineModel, rows: DataFrame, sizes: Sequence[int], label: str, weight: str | None = None) -> list[float]:
    """The error of the forests made of the first ``size`` trees of a fitted one, all in one pass over ``rows``."""
    *before, forest = model.stages
    scored = PipelineModel(before).transform(rows)
    names = [f"_tree{i}" for i in range(max(sizes))]
    for name, tree in zip(names, forest.trees, strict=False):
        scored = tree.setPredictionCol(name).transform(scored)
    errors = []
    for size in sizes:
        mean = reduce(Column.__add__, [F.col(n) for n in names[:size]]) / F.lit(float(size))
        errors.append(metrics.rmse(F.col(label), mean, weight).alias(f"_e{size}"))
    return list(scored.agg(*errors).first())


def search_forest(
    train: DataFrame,
    model_type: str,
    grid: Mapping[str, Sequence[int]],
    num_folds: int = 5,
    label: str = "count_scaled",
    weight: str | None = None,
    keys: Sequence[str] = ROW_KEY,
    seed: int = 1,
    parallelism: int = 4,
) -> ForestSearch:
    """k-fold search over numTrees, maxDepth and minInstancesPerNode.

    Folds come from the rows' keys. One forest of the most trees is fitted per fold, depth and least node, and scored at each
    wanted number of its trees, which are drawn alike and independently. Ties go to the first set of the grid. A row of weight n
    counts n times, towards minInstancesPerNode too. A fold without rows scores nothing; training rows that all lie in one fold
    can't be searched. ``train`` is read many times: pass a ``model_table``.
    """
    sizes = list(grid["numTrees"])
    shapes = [(depth, least) for depth in grid["maxDepth"] for least in grid["minInstancesPerNode"]]
    folded = train.withColumn("_fold", fold_of(keys, num_folds, seed))
    counted = {r["_fold"]: r["count"] for r in folded.groupBy("_fold").count().collect()}
    folds = [f for f in range(num_folds) if counted.get(f)]
    if len(folds) < 2:
        raise ValueError("the training rows fill less than two folds")

    def fit(rows: DataFrame, trees: int, depth: int, least: int) -> PipelineModel:
        params = {"numTrees": trees, "maxDepth": depth, **_least_weight(rows, weight, least)}
        return build_pipeline(model_type, label, weight, seed, **params).fit(rows)

    def score(task: tuple[int, tuple[int, int]]) -> list[float]:
        fold, shape = task
        rest, held = folded.filter(F.col("_fold") != fold), folded.filter(F.col("_fold") == fold)
        return prefix_rmse(fit(rest, max(sizes), *shape), held, sizes, label, weight)

    tasks = [(fold, shape) for shape in shapes for fold in folds]
    with ThreadPool(min(parallelism, len(tasks))) as pool:
        errors = dict(zip(tasks, pool.map(inheritable_thread_target(train.sparkSession)(score), tasks)))
    scores = []
    for i, size in enumerate(sizes):
        for shape in shapes:
            scores.append((size, *shape, sum(errors[fold, shape][i] for fold in folds) / len(folds)))
    size, depth, least, _ = min(scores, key=lambda s: s[-1])
    return ForestSearch(fit(train, size, depth, least), scores, [counted.get(f, 0) for f in range(num_folds)])


def cross_validate(
    train: DataFrame,
    dev: DataFrame,
    test: DataFrame,
    model_type: str,
    grid: Mapping[str, Sequence[int]],
    num_folds: int = 5,
    label: str = "count_scaled",
    weight: str | None = None,
    seed: int = 1,
    parallelism: int = 4,
    keys: Sequence[str] = ROW_KEY,
) -> ForestResult:
    """k-fold search over the grid on ``train``, scored on ``dev`` and ``test``."""
    score = evaluator(label, weight=weight)
    model = search_forest(train, model_type, grid, num_folds, label, weight, keys, seed, parallelism)
    tested, developed = model.transform(test), model.transform(dev)
    return ForestResult(model, train, tested, score.evaluate(tested), developed, score.evaluate(developed))


def rf_pipeline(
    joined: DataFrame,
    model_type: str,
    grid: Mapping[str, Sequence[int]],
    num_folds: int = 5,
    label: str = "count_scaled",
    weight: str | None = None,
    keys: Sequence[str] = ROW_KEY,
    seed: int = 1,
) -> ForestResult:
    """Thirds for train, dev and test; search on train, score on the others."""
    parts = model_table(splits.weighted_split(joined, {"train": 1, "dev": 1, "test": 1}, keys, seed), keys)
    train, dev, test = (parts.filter(F.col("split") == name).drop("split") for name in ("train", "dev", "test"))
    return cross_validate(train, dev, test, model_type, grid, num_folds, label, weight, seed, keys=keys)


def rf_period_split(
    early: DataFrame,
    late: DataFrame,
    model_type: str,
    grid: Mapping[str, Sequence[int]],
    num_folds: int = 5,
    label: str = "count_scaled",
    weight: str | None = None,
    keys: Sequence[str] = ROW_KEY,
    seed: int = 1,
) -> ForestResult:
    """Train on the early period; the late one is halved into dev and test."""
    parts = model_table(splits.weighted_split(late, {"dev": 1, "test": 1}, keys, seed), keys)
    dev, test = (parts.filter(F.col("split") == name).drop("split") for name in ("dev", "test"))
    return cross_validate(model_table(early, keys), dev, test, model_type, grid, num_folds, label, weight, seed, keys=keys)


def fit_once(
    train: DataFrame,
    test: DataFrame,
    model_type: str,
    label: str = "count_scaled",
    weight: str | None = None,
    num_trees: int = 3,
    max_depth: int = 5,
    seed: int = 1,
) -> tuple[PipelineModel, DataFrame]:
    """A single fit without a search. ``train`` is read several times: pass a
    ``model_table``, or rows that are cheap to read again."""
    pipeline = build_pipeline(model_type, label, weight, seed, numTrees=num_trees, maxDepth=max_depth)
    model = pipeline.fit(train)
    return model, model.transform(test)


def get_model_stats(model: ForestSearch, spark) -> DataFrame:
    """One row per parameter set: its values and mean cross-validation score."""
    return spark.createDataFrame(model.scores, "num_trees int, max_depth int, min_instances int, cv_rmse double")


def split_r2(model: PipelineModel, rows: DataFrame, label: str, weight: str | None = None, split: str = "split") -> DataFrame:
    """R2 of a model on each split of ``rows``, with the rows and records it stands for; null where the label doesn't vary."""
    records = F.sum(weight) if weight else F.count(label)
    scored = model.transform(rows).groupBy(split).agg(
        F.count("prediction").alias("n_rows"), records.cast("long").alias("n_records"), metrics.r2(label, "prediction", weight).alias("r2")
    )
    return scored


def stage_params(model: PipelineModel) -> dict[str, dict[str, object]]:
    """Fitted stages with their parameter values."""
    return {s.uid: {p.name: v for p, v in s.extractParamMap().items()} for s in model.stages}


def score_saved(model: PipelineModel, joined: DataFrame, label: str = "count_scaled") -> DataFrame:
    """Predictions of a saved model on another period, with the residual."""
    scored = model.transform(joined)
    return scored.withColumn("residual", F.col("prediction") - F.col(label))
