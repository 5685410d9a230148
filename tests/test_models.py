from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from hailgrid.functions import quantiles
from hailgrid.functions.quantiles import exact_quantiles
from hailgrid.operators import baseline, explore, forest, metrics, residuals, similarity, splits
from hailgrid.plans import workflows

T0 = datetime(2014, 1, 6)


@pytest.fixture(scope="module")
def counted(spark):
    """Cell (4, 32): 2 and 4 on two Mondays at 0:00; cell (5, 32): 1 on the first."""
    week = timedelta(days=7)
    data = [(T0, 4, 32, 2, 0.5), (T0 + week, 4, 32, 4, 1.0), (T0, 5, 32, 1, 0.25)]
    return spark.createDataFrame(
        data, "pickup_datetime timestamp_ntz, grid_x int, grid_y int, count bigint, count_scaled double")


def test_means_and_unseen_keys(counted, rows):
    model = baseline.fit_baseline(counted)
    assert rows(model, "grid_x", "weekday", "hour", "mean_count", "mean_count_scaled") == [
        (4, 0, 0, 3.0, 0.75), (5, 0, 0, 1.0, 0.25)]
    later = counted.withColumn("pickup_datetime", F.col("pickup_datetime") + F.expr("interval 1 hour"))
    assert rows(baseline.predict_baseline(later, model), "pred", "pred_scaled") == [(0.0, 0.0)] * 3


def test_window_form_equals_the_join(counted, rows):
    names = ["pickup_datetime", "grid_x", "pred", "pred_scaled"]
    by_join = baseline.predict_means(counted, baseline.fit_means(counted))
    assert rows(by_join, *names) == rows(baseline.fit_predict_means(counted), *names)


def test_adjusted_model_weights_equal_rows(spark, counted, rows):
    rain = [(T0, 30.0, 0.5), (T0, 30.0, 0.5), (T0, 30.0, 0.0), (T0 + timedelta(days=7), 30.0, 0.5)]
    plain = spark.createDataFrame(rain, "datetime timestamp_ntz, fahrenheit double, precip_in double")
    folded = plain.groupBy(*plain.columns).agg(F.count("*").alias("n_records"))
    models = [baseline.fit_adjusted(counted, w) for w in (plain, folded)]
    assert rows(models[0]) == rows(models[1])
    heavy = models[0].filter("heavy_rain and grid_x = 4").first()
    assert heavy.mean_count == pytest.approx((2 + 2 + 4) / 3)
    scored = baseline.predict_adjusted(counted, plain, models[0])
    assert scored.count() == 7 and scored.filter("pred = 0").count() == 0


def test_stats_and_scaling_invariant(counted):
    pred = metrics.with_residual(baseline.fit_predict_means(counted))
    s = metrics.prediction_stats(pred).first()
    assert s.rmse == pytest.approx(np.sqrt(2 / 3)) and s.residual_mean == pytest.approx(0)
    assert s.r2 == pytest.approx(1 - 2 / np.sum((np.array([2, 4, 1]) - 7 / 3) ** 2))
    assert (s.count_p25, s.count_p50, s.count_p75) == (1.5, 2.0, 3.0)
    assert (s.residual_p25, s.residual_p50, s.residual_p75) == (-0.5, 0.0, 0.5)
    c = metrics.scaling_check(pred).first()
    assert c.max_abs_difference == pytest.approx(0) and c.rmse_rescaled == pytest.approx(c.rmse)
    e = metrics.error_summary(pred).first()
    assert (e.n_rows, e.max_count) == (3, 4) and e.sse == pytest.approx(2.0)
    assert e.std_error == pytest.approx(1.0) and e.mean_abs_error == pytest.approx(2 / 3)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.sampled_from([0.0, 1.0, -3.5, 7.25, 7.25, 100.0]) | st.floats(-1e6, 1e6), min_size=1, max_size=60),
    st.sampled_from([(0.25, 0.5, 0.75), (0.0, 0.333, 1.0), (0.99,)]),
)
def test_exact_quantiles_small(spark, values, probs):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = exact_quantiles(df, "v", probs).first()
    assert list(got) == pytest.approx(list(np.quantile(values, probs)), abs=1e-9)


@pytest.mark.parametrize("n", [99, 2_500, 40_003])
def test_exact_quantiles_with_a_hot_value_and_groups(spark, n):
    rng = np.random.default_rng(n)
    values = np.where(rng.random(n) < 0.4, 5.0, np.round(rng.normal(5, 3, n), 5))
    group = (np.arange(n) % 7 == 0).astype(int)
    df = spark.createDataFrame([(int(g), float(v)) for g, v in zip(group, values)], "g int, v double")
    probs = (0.01, 0.25, 0.5, 0.75, 0.95)
    for row in exact_quantiles(df, "v", probs, ["g"]).collect():
        want = np.quantile(values[group == row.g], probs)
        assert list(row)[1:] == pytest.approx(list(want), abs=1e-12)
    assert list(exact_quantiles(df, "v", probs).first()) == pytest.approx(list(np.quantile(values, probs)), abs=1e-12)


@pytest.mark.parametrize("shift", [-0.3, 0.02])
def test_exact_quantiles_with_a_sketch_that_is_off(spark, monkeypatch, shift):
    """Brackets that lie beside their ranks are widened until they hold them, for some groups or all."""
    honest = quantiles._sketch

    def off(data, probs, keys, half):
        moved = [min(1.0, max(0.0, p + shift)) for p in probs] if half < 1 else probs
        return honest(data, moved, keys, half)

    monkeypatch.setattr(quantiles, "_sketch", off)
    rng = np.random.default_rng(5)
    values, group = rng.normal(0, 1, 3_000), rng.integers(0, 40, 3_000)
    group[group == 3] = 4
    values[group == 7] = 2.5
    df = spark.createDataFrame([(int(g) if g else None, float(v)) for g, v in zip(group, values)], "g int, v double")
    probs = (0.0, 0.1, 0.5, 0.95)
    got = exact_quantiles(df, "v", probs, ["g"]).collect()
    assert len(got) == 39
    for row in got:
        assert list(row)[1:] == pytest.approx(list(np.quantile(values[group == (row.g or 0)], probs)), abs=1e-12)
    assert list(exact_quantiles(df, "v", probs).first()) == pytest.approx(list(np.quantile(values, probs)), abs=1e-12)
    assert list(exact_quantiles(df.filter("v > 100"), "v", probs).first()) == [None] * 4


def test_describe_uses_the_sample_deviation(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 4.0), (2, 9.0)], "g int, v double")
    a = {r.g: r for r in metrics.describe(df, "v", by=["g"]).collect()}
    b = {r.g: r for r in metrics.describe(df, "v", by=["g"], repeating=True).collect()}
    for r in (a[1], b[1]):
        assert (r.n, r.min, r.max, r.p50) == (3, 1.0, 4.0, 2.0) and r.std == pytest.approx(np.std([1, 2, 4], ddof=1))
    assert a[2].std is None and b[2].std is None


def test_bins_are_right_closed_and_keep_empty_ones(spark, rows):
    df = spark.createDataFrame([(0.0, 1), (2.5, 3), (2.6, 5), (10.0, 7), (None, 9)], "v double, count int")
    got = rows(explore.mean_by_bin(df, "v", 4), "bin", "bin_low", "bin_high", "mean")
    assert got == [(0, 0.0, 2.5, 2.0), (1, 2.5, 5.0, 5.0), (2, 5.0, 7.5, None), (3, 7.5, 10.0, 7.0)]
    same = spark.createDataFrame([(3.0, 1), (3.0, 5)], "v double, count int")
    assert [r.mean for r in explore.mean_by_bin(same, "v", 2).orderBy("bin").collect()].count(3.0) == 1


def test_weighted_bin_means_equal_repeated_rows(spark, rows):
    df = spark.createDataFrame([(0.0, 1, 3), (1.0, 5, 1), (9.0, 2, 2)], "v double, count int, w int")
    repeated = df.withColumn("_r", F.explode(F.expr("sequence(1, w)")))
    assert rows(explore.mean_by_bin(df, "v", 3, weight="w")) == rows(explore.mean_by_bin(repeated, "v", 3))


def test_histogram_matches_numpy(spark, rows):
    values = [0.0, 0.5, 1.0, 1.0, 2.2, 5.0, 9.99, 10.0]
    got = rows(explore.histogram(spark.createDataFrame([(v,) for v in values], "v double"), "v"), "n_rows", "bin")
    assert [n for n, _ in sorted(got, key=lambda r: r[1])] == list(np.histogram(values, 10)[0])


def test_tables(spark, rows):
    cells = spark.createDataFrame([(x, 25, x * 10) for x in range(1, 11)] + [(30, 55, 1)], "grid_x int, grid_y int, count bigint")
    assert [r.grid_x for r in explore.top_quantile_cells(cells, 0.9).collect()] == [10, 9]
    assert rows(cells.filter(explore.in_rectangle()), "grid_x") == [(x,) for x in range(3, 9)]
    assert rows(cells.filter(explore.in_rectangle(explore.HIGH_DEMAND_VIEW)), "grid_x") == [(x,) for x in range(2, 10)]
    heat = {r.grid_y: r for r in explore.heatmap(cells).collect()}
    assert heat[55].x30 == 1 and heat[55].x0 == 0 and heat[25].x10 == 100
    assert [r["count"] for r in explore.busiest(cells, 2).collect()] == [100, 90]
    assert tuple(explore.null_counts(spark.createDataFrame([(None,), (1,)], "a int"), ["a"]).first()) == (2, 1)


def test_residual_thresholds(spark, rows):
    df = spark.createDataFrame(
        [(10, 4.0), (10, 6.0), (5, 17.0), (25, 40.0), (3, 3.5)], "count int, pred double"
    ).transform(metrics.with_residual)
    assert rows(df.filter(residuals.is_under()), "pred") == [(4.0,)]
    assert rows(df.filter(residuals.is_under(1 / 3)), "pred") == [(4.0,), (6.0,)]
    assert rows(df.filter(residuals.is_over()), "pred") == [(17.0,)]
    assert rows(df.filter(residuals.is_well()), "pred") == [(3.5,)]


def test_sides_with_weights_equal_repeated_rows(spark, rows):
    df = spark.createDataFrame(
        [(1.0, 0.5, 10.0, 2), (2.0, 0.1, 90.0, 1), (-4.0, 0.0, 50.0, 3)],
        "residual double, precip_in double, fahrenheit double, w bigint",
    ).transform(residuals.flag_weather)
    flags = ["heavy_rain", "moderate_rain", "cold", "hot"]
    weighted = residuals.compare_sides(df, flags, weight="w")
    repeated = residuals.compare_sides(df.withColumn("_r", F.explode(F.expr("sequence(1, int(w))"))), flags)
    for a, b in zip(rows(weighted), rows(repeated)):
        assert a[:3] == b[:3] and list(a[3:]) == [pytest.approx(v) if v is not None else None for v in b[3:]]


def test_studies_return_tables_per_month(spark):
    times = [T0 + timedelta(days=7 * w) for w in range(3)]
    data = [(t, -74.0, 40.7) for t in times[:1] for _ in range(40)] + [(t, -74.0, 40.7) for t in times[1:]]
    rides = spark.createDataFrame(data, "pickup_datetime timestamp_ntz, pickup_longitude double, pickup_latitude double")
    under = workflows.analyze_underestimated(rides)
    assert [r["count"] for r in under["rows"].collect()] == [40]
    assert under["weekday_hour"].first().weekday_0 == 1 and under["cells"].first().n_rows == 1
    over = workflows.analyze_overestimated(rides)
    assert over["rows"].count() == 2 and over["dates"].count() == 2 and over["hours"].first()["count"] == 2


def test_distances_and_clusters(spark, rows):
    data = [("a", 0, 0, 5), ("a", 1, 0, 1), ("b", 0, 0, 7), ("b", 30, 55, 100), ("c", 2, 3, 50), ("d", 2, 3, 40)]
    sparse = spark.createDataFrame(data, "period string, grid_x int, grid_y int, count bigint")
    dense = similarity.dense_cells(sparse)
    assert dense.count() == 4 * 1650
    dist = {(r.period_a, r.period_b): r.distance for r in similarity.period_distances(dense).collect()}
    assert len(dist) == 16 and dist["a", "b"] == 3 and dist["a", "c"] == 56 and dist["c", "d"] == 10
    assert all(dist[x, y] == dist[y, x] for x, y in dist) and all(dist[p, p] == 0 for p in "abcd")
    assert dict(rows(similarity.total_distances(similarity.period_distances(dense))))["a"] == 3 + 56 + 46
    diff = similarity.counts_diff(dense, F.lit("a"), F.lit("b"))
    assert diff.count() == 1650 and diff.agg(F.sum("diff")).first()[0] == 3
    vectors = similarity.period_vectors(dense)
    a = vectors.filter("period = 'a'").first().features.toArray()
    assert len(a) == 1650 and a[0] == 5 and a[55] == 1 and a.sum() == 6
    got = {r.period: r for r in similarity.dist_to_center(vectors, similarity.fit_clusters(vectors)).collect()}
    assert got["a"].prediction == got["b"].prediction != got["c"].prediction == got["d"].prediction
    assert got["c"].dist_to_center == pytest.approx(5.0) and got["a"].dist_to_center == pytest.approx(np.sqrt(1.25))


@pytest.mark.parametrize("k", [1, 3])
def test_clusters_do_not_depend_on_partitions_and_are_an_optimum(spark, k):
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(m, 0.5, (20, 4)) for m in (0.0, 4.0, 9.0)])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(points)], "period int, v array<double>")
    df = df.select("period", array_to_vector("v").alias("features"))
    runs = [similarity.fit_clusters(df.repartition(parts), k) for parts in (1, 7)]
    assert np.allclose(runs[0].centers, runs[1].centers) and len(runs[0].centers) == k
    got = {r.period: r for r in similarity.dist_to_center(df, runs[0]).collect()}
    groups = [list(range(60))] if k == 1 else [list(range(20 * g, 20 * g + 20)) for g in range(3)]
    cost = 0.0
    for group in groups:
        assert len({got[i].prediction for i in group}) == 1
        cost += ((points[group] - points[group].mean(axis=0)) ** 2).sum()
    assert runs[0].cost == pytest.approx(cost) == pytest.approx(sum(r.dist_to_center**2 for r in got.values()))


def test_clusters_with_few_distinct_rows(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "period int, v array<double>")
    same = same.select("period", array_to_vector("v").alias("features"))
    found = similarity.fit_clusters(same, 3)
    assert found.centers == [[1.0, 2.0]] and found.cost == 0
    with pytest.raises(ValueError):
        similarity.fit_clusters(same.limit(0))


@pytest.mark.parametrize("parts", [1, 7])
def test_exact_split_sizes_do_not_depend_on_partitions(spark, parts):
    df = spark.range(5_000).repartition(parts).withColumn("g", F.col("id") % 3)
    sizes = {"test": 500, "dev": 123}
    got = splits.split_exact(df, sizes, ["id"], seed=4)
    assert {r.split: r["count"] for r in got.groupBy("split").count().collect()} == {
        "test": 500, "dev": 123, "train": 4_377}
    assert got.filter("split = 'test'").agg(F.sum("id")).first()[0] == splits.split_exact(
        spark.range(5_000), sizes, ["id"], seed=4).filter("split = 'test'").agg(F.sum("id")).first()[0]


@pytest.mark.parametrize("slices", [1, 3])
def test_exact_split_with_few_slices(spark, monkeypatch, slices):
    df = spark.range(500).select("id", (F.col("id") % 2).alias("g"))
    want = {r.id: r.split for r in splits.split_exact(df, {"a": 40, "b": 7}, ["id"], by=["g"], seed=4).collect()}
    whole = {r.id: r.split for r in splits.split_exact(df, {"a": 40, "b": 600}, ["id"], seed=4).collect()}
    monkeypatch.setattr(splits, "SLICES", slices)
    assert want == {r.id: r.split for r in splits.split_exact(df, {"a": 40, "b": 7}, ["id"], by=["g"], seed=4).collect()}
    assert whole == {r.id: r.split for r in splits.split_exact(df, {"a": 40, "b": 600}, ["id"], seed=4).collect()}


def test_sample_per_group_and_small_groups(spark):
    df = spark.range(1_000).withColumn("g", F.when(F.col("id") < 990, 0).otherwise(1))
    got = splits.sample_n(df, 50, ["id"], ["g"], seed=1)
    assert {r.g: r["count"] for r in got.groupBy("g").count().collect()} == {0: 50, 1: 10}
    assert splits.sample_n(df, 5_000, ["id"]).count() == 1_000
    assert splits.sample_n(df, 0, ["id"]).count() == 0


def test_random_splits(spark):
    df = spark.range(4_000)
    parts = {r.split: r["count"] for r in splits.weighted_split(df, {"train": 8, "dev": 1, "test": 1}, ["id"]).groupBy("split").count().collect()}
    assert sum(parts.values()) == 4_000 and 3_050 < parts["train"] < 3_350
    halves = splits.mask_split(df, ["id"], 0.25).groupBy("split").count().collect()
    assert {r.split for r in halves} == {"train", "test"}
    for ratio in (0, 1):
        with pytest.raises(ValueError):
            splits.mask_split(df, ["id"], ratio)


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(0)
    data = []
    for i in range(600):
        x, y, d, h = (int(v) for v in (rng.integers(0, 6), rng.integers(0, 6), rng.integers(0, 7), rng.integers(0, 24)))
        n = 1 + x + h // 4
        data.append((T0 + timedelta(hours=i), x, y, n, n / 12, d, h, 30.0 + h, 0.1 * (i % 5)))
    return spark.createDataFrame(
        data,
        "pickup_datetime timestamp_ntz, grid_x int, grid_y int, count bigint, count_scaled double, weekday int, "
        "hour int, fahrenheit double, precip_in double",
    )


@pytest.mark.parametrize("model_type,size", [("1", 6), ("2", 4 + 7 + 24), ("3", 2 + 7 + 24 + 6 + 6)])
def test_forest_search(features, model_type, size):
    grid = {"numTrees": [3], "maxDepth": [3, 5], "minInstancesPerNode": [1]}
    result = forest.rf_pipeline(features, model_type, grid, num_folds=2)
    assert result.best.stages[-1].numFeatures == size
    assert 0 < result.rmse < 0.3 and result.predictions.count() > 100
    stats = forest.get_model_stats(result.model, features.sparkSession).collect()
    assert [(r.num_trees, r.max_depth, r.min_instances) for r in stats] == [(3, 3, 1), (3, 5, 1)]
    assert min(r.cv_rmse for r in stats) < features.agg(F.stddev("count_scaled")).first()[0]


def test_forest_rejects_unknown_types(features):
    with pytest.raises(ValueError):
        forest.build_pipeline("4")


def test_forest_scores_an_unseen_category(features):
    train = features.filter("weekday < 5")
    _, scored = forest.fit_once(train, features, "2")
    assert scored.count() == features.count()
    assert forest.features_and_label(features).columns == [*forest.FEATURES, "count"]


def test_forest_period_split_is_repeatable(features):
    grid = {"numTrees": [3], "maxDepth": [3], "minInstancesPerNode": [1]}
    early, late = features.filter(F.col("pickup_datetime") < F.lit(T0 + timedelta(hours=300))), features
    runs = [forest.rf_period_split(early, late, "1", grid, num_folds=2) for _ in range(2)]
    assert runs[0].predictions.count() == runs[1].predictions.count()
    assert runs[0].rmse == pytest.approx(runs[1].rmse)


def test_weighted_errors_equal_repeated_rows(features):
    """One model, scored on folded rows with weights and on the rows repeated."""
    folded = features.withColumn("w", (F.col("hour") % 3 + 1).cast("long"))
    model, scored = forest.fit_once(folded, folded, "1", label="count", weight="w")
    repeated = model.transform(folded.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "w"))))
    one = scored.agg(metrics.rmse("count", "prediction", "w"), metrics.r2("count", "prediction", "w")).first()
    other = repeated.agg(metrics.rmse("count", "prediction"), metrics.r2("count", "prediction")).first()
    assert tuple(one) == pytest.approx(tuple(other), abs=1e-9)
    a = metrics.error_summary(scored, "count", "prediction", "w").first()
    b = metrics.error_summary(repeated, "count", "prediction").first()
    assert tuple(a) == pytest.approx(tuple(b), abs=1e-7)


def test_a_search_scores_the_development_rows(features):
    result = forest.rf_pipeline(features, "1", {"numTrees": [2], "maxDepth": [3], "minInstancesPerNode": [1]}, num_folds=2)
    assert result.dev.count() > 0 and result.dev_rmse == pytest.approx(forest.evaluator().evaluate(result.dev))


def test_a_search_does_not_depend_on_partitions(features):
    grid = {"numTrees": [1, 4], "maxDepth": [2, 4], "minInstancesPerNode": [1, 3]}
    runs = [forest.rf_pipeline(features.repartition(parts), "1", grid, num_folds=3).model for parts in (1, 7)]
    assert runs[0].fold_rows == runs[1].fold_rows and len(runs[0].fold_rows) == 3 and min(runs[0].fold_rows) > 30
    assert [s[:3] for s in runs[0].scores] == [(t, d, m) for t in (1, 4) for d in (2, 4) for m in (1, 3)]
    assert [s[3] for s in runs[0].scores] == pytest.approx([s[3] for s in runs[1].scores], abs=1e-12)
    best = min(runs[0].scores, key=lambda s: s[3])
    assert runs[0].bestModel.stages[-1].getNumTrees == best[0]


def test_folds_follow_the_key(features):
    fold = forest.fold_of(forest.ROW_KEY, 4)
    one, other = ({r[0]: r[1] for r in df.select("pickup_datetime", fold).collect()} for df in (features, features.repartition(5)))
    assert one == other and set(one.values()) == {0, 1, 2, 3}
    with pytest.raises(ValueError):
        forest.fold_of(forest.ROW_KEY, 1)
    with pytest.raises(ValueError):
        forest.search_forest(features.limit(1), "1", {"numTrees": [1], "maxDepth": [2], "minInstancesPerNode": [1]})


def test_errors_of_the_first_trees(features):
    model = forest.build_pipeline("2", "count", numTrees=5, maxDepth=4).fit(features)
    got = forest.prefix_rmse(model, features, [1, 3, 5], "count")
    ready = forest.PipelineModel(model.stages[:-1]).transform(features).select("features", "count").collect()
    actual = np.array([r["count"] for r in ready])
    trees = np.array([[t.predict(r.features) for r in ready] for t in model.stages[-1].trees])
    want = [np.sqrt(np.mean((trees[:k].mean(axis=0) - actual) ** 2)) for k in (1, 3, 5)]
    assert got == pytest.approx(want) and got[2] == pytest.approx(forest.evaluator("count").evaluate(model.transform(features)))


@pytest.mark.parametrize("least", [1, 7, 40])
def test_a_tree_on_folded_rows_splits_as_on_repeated_ones(features, least):
    folded = features.withColumn("w", (F.col("hour") % 4 + 1).cast("long")).coalesce(1)
    repeated = folded.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "w"))).drop("_")
    plain = {"numTrees": 1, "maxDepth": 5, "bootstrap": False}
    one = forest.build_pipeline("1", "count", "w", **plain, **forest._least_weight(folded, "w", least)).fit(folded)
    other = forest.build_pipeline("1", "count", **plain, minInstancesPerNode=least).fit(repeated)
    a, b = (m.transform(folded).select("prediction").toPandas().prediction for m in (one, other))
    assert one.stages[-1].totalNumNodes == other.stages[-1].totalNumNodes > 3
    assert list(a) == pytest.approx(list(b), abs=1e-9)


def test_r2_of_each_split(features):
    halves = splits.mask_split(features, forest.ROW_KEY, 0.5, seed=1).withColumn("w", F.lit(1) + F.col("hour") % 2)
    model, _ = forest.fit_once(halves.filter("split = 'train'"), halves, "1", label="count", weight="w")
    scored = model.transform(halves).toPandas()
    for r in forest.split_r2(model, halves, "count", "w").collect():
        part = scored[scored.split == r.split]
        mean = np.average(part["count"], weights=part.w)
        want = 1 - (part.w * (part["count"] - part.prediction) ** 2).sum() / (part.w * (part["count"] - mean) ** 2).sum()
        assert r.r2 == pytest.approx(want) and r.n_rows == len(part) and r.n_records == part.w.sum()
    assert forest.split_r2(model, halves.withColumn("count", F.lit(3)), "count").first().r2 is None


def test_weighted_r2_of_large_counts(spark):
    """Squared sums of whole counts and weights pass 64 bits; R2 is still that of numpy."""
    y, p, w = [3_000_000_000, 1_000_000_000, 2_000_000_000], [2.5e9, 1.5e9, 2.0e9], [2, 1, 3]
    df = spark.createDataFrame(list(zip(y, p, w)), "count long, prediction double, n_records long")
    got = df.agg(metrics.r2("count", "prediction", "n_records")).first()[0]
    ya, wa = np.array(y, dtype=float), np.array(w, dtype=float)
    mean = np.sum(ya * wa) / np.sum(wa)
    assert got == pytest.approx(1 - np.sum((ya - np.array(p)) ** 2 * wa) / np.sum((ya - mean) ** 2 * wa))
