"""The registered queries: every operator over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hailgrid.functions import clock, numeric
from hailgrid.functions.grid import NYC
from hailgrid.functions.numeric import r6
from hailgrid.functions.quantiles import attach
from hailgrid.operators import baseline, counts, explore, forest, joins, metrics, residuals, similarity, splits
from hailgrid.operators import weather, zipcodes
from hailgrid.plans import workflows
from hailgrid.session import materialize, shared_folder
from hailgrid.sources import sinks
from hailgrid.sources.tables import Tables

REGISTRY: dict[str, Callable[[Tables], DataFrame]] = {}

# The given events cover 30 days, so a period is a week and the model is trained
# on the first two weeks and scored on the rest.
PERIOD = clock.week_floor
# The residual studies fit per half-month: two periods in the given events.
STUDY_PERIOD = clock.half_month_floor
SPLIT_AT = "2024-01-15"
ZIP_RADIUS_KM = 1.0
OVER_RESIDUAL = 2
# Of two weeks a cell-hour has few; at a half none would be left.
UNDER_SHARE = 0.25
HOT_ABOVE = 50.0
FOREST_GRID = {"numTrees": [5], "maxDepth": [10], "minInstancesPerNode": [1, 5]}


def query(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    REGISTRY[fn.__name__] = fn
    return fn


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, folder: fn(Tables(spark, folder))

    return {name: bind(fn) for name, fn in REGISTRY.items()}


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def _time_split(rides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Early and late rides, as ranges on the raw time so that the scan prunes."""
    at = F.lit(SPLIT_AT).cast("timestamp_ntz")
    return rides.filter(F.col("pickup_datetime") < at), rides.filter(F.col("pickup_datetime") >= at)


# ---- box, grid and clock -------------------------------------------------


@query
def bbox_rides(t: Tables) -> DataFrame:
    return _rounded(counts.clean_rides(t.rides()), "pickup_longitude", "pickup_latitude")


@query
def grid_cells(t: Tables) -> DataFrame:
    lat, lon = "pickup_latitude", "pickup_longitude"
    coord = NYC.coord(lat, lon)
    return counts.clean_rides(t.rides()).select(
        "ride_id",
        coord["x"].alias("grid_x"),
        coord["y"].alias("grid_y"),
        NYC.x(lon, clamp=True).alias("grid_x_clamped"),
        NYC.y(lat, clamp=True).alias("grid_y_clamped"),
    )


@query
def cell_ids(t: Tables) -> DataFrame:
    """All rides, also those outside the box: the id is plain arithmetic."""
    return t.rides().groupBy(NYC.cell_id("pickup_latitude", "pickup_longitude").alias("cell_id")).agg(
        F.count("*").alias("n_rides")
    )


@query
def cell_centers(t: Tables) -> DataFrame:
    cells = counts.counts_by_grid_cell(t.rides()).select(NYC.id_of("grid_x", "grid_y").alias("cell_id"), "count")
    return cells.groupBy("cell_id").agg(F.sum("count").alias("n_rides")).withColumns(
        {"center_lon": r6(NYC.center_lon("cell_id")), "center_lat": r6(NYC.center_lat("cell_id"))}
    )


@query
def hour_parts(t: Tables) -> DataFrame:
    when = "pickup_datetime"
    return counts.clean_rides(t.rides()).select(
        "ride_id",
        clock.hour_floor(when).alias("pickup_hour"),
        clock.weekday(when).alias("weekday"),
        F.hour(when).alias("hour"),
        F.minute(when).alias("minute"),
        F.dayofmonth(when).alias("day"),
    )


@query
def hour_keys(t: Tables) -> DataFrame:
    when = F.col("valid")
    return t.raw_metar().select(
        "event_id",
        clock.hour_key(when).alias("hour_key"),
        clock.month_day(when).alias("month_day"),
        clock.hour_key_from_text(when.cast("string")).alias("text_hour_key"),
    )


@query
def parsed_values(t: Tables) -> DataFrame:
    """Text to number and text to time, with the three numeric tests side by side."""
    text_time = F.substring(F.col("valid").cast("string"), 1, 16)
    # Every third text is cut short or has another form, and is no time in the format.
    kept = F.col("event_id") % 3
    lenient = F.when(kept == 0, text_time).when(kept == 1, F.substring(text_time, 1, 10)).otherwise(F.translate(text_time, " ", "T"))
    return t.raw_metar().select(
        "event_id",
        clock.parse_time(text_time, clock.WEATHER_TIME).alias("datetime"),
        numeric.parse_numeric("tmpf").alias("fahrenheit"),
        numeric.parse_numeric("p01i").alias("precip_in"),
        numeric.is_numeric_text("tmpf", "search").alias("found_anywhere"),
        numeric.is_numeric_text("tmpf", "prefix").alias("found_at_start"),
        clock.parse_time(lenient, clock.WEATHER_TIME, strict=False).alias("lenient_datetime"),
    )


@query
def period_labels(t: Tables) -> DataFrame:
    labelled = counts.clean_rides(t.rides()).groupBy(clock.period_label("pickup_datetime").alias("period"))
    return labelled.agg(F.count("*").alias("n_rides")).withColumn("period_start", clock.period_date("period"))


# ---- weather -------------------------------------------------------------


@query
def clean_precip(t: Tables) -> DataFrame:
    return weather.clean_precip(t.metar())


@query
def clean_temperature(t: Tables) -> DataFrame:
    return _rounded(weather.clean_temperature(t.metar()), "fahrenheit")


@query
def hourly_weather(t: Tables) -> DataFrame:
    return _rounded(weather.clean_metar(t.metar()), "fahrenheit")


@query
def hourly_weather_dedup(t: Tables) -> DataFrame:
    return _rounded(weather.clean_metar(t.metar(), dedupe=True), "fahrenheit")


@query
def weather_outer(t: Tables) -> DataFrame:
    return _rounded(weather.clean_metar(t.metar(), how="full"), "fahrenheit")


@query
def weather_records(t: Tables) -> DataFrame:
    return _rounded(weather.weather_records(t.metar()), "fahrenheit")


@query
def weather_nulls(t: Tables) -> DataFrame:
    outer = weather.clean_metar(t.metar(), how="full")
    return explore.null_counts(outer, ["fahrenheit", "precip_in"])


@query
def weather_completeness(t: Tables) -> DataFrame:
    return weather.completeness(t.metar())


@query
def weather_gaps(t: Tables) -> DataFrame:
    """Missing stretches of the routine hourly precipitation."""
    return weather.missing_stretches(weather.clean_precip(t.metar()))


@query
def rides_nearest_weather(t: Tables) -> DataFrame:
    """Rides with the readings nearest in time, at most ten minutes away."""
    readings = weather.filter_numerical(weather.filter_numerical(t.metar(), "fahrenheit"), "precip_in")
    return joins.join_nearest_reading(t.rides(), readings, minutes=10).select("ride_id", "pickup_datetime", "datetime", "fahrenheit", "precip_in")


@query
def weather_day_filters(t: Tables) -> DataFrame:
    return weather.on_days(t.raw_metar().withColumnRenamed("valid", "datetime"), [2, 5, 6, 31])


@query
def precip_histogram(t: Tables) -> DataFrame:
    amounts = weather.clean_precip(t.metar()).filter(F.col("precip_in") < 1)
    return _rounded(explore.histogram(amounts, "precip_in"), "bin_low", "bin_high")


@query
def weather_buckets(t: Tables) -> DataFrame:
    return weather.weather_records(t.metar()).groupBy(
        numeric.bucket_fahrenheit("fahrenheit").alias("temperature"),
        numeric.bucket_precip("precip_in").alias("precipitation"),
    ).agg(F.sum("n_records").alias("n_records"))


# ---- counts --------------------------------------------------------------


@query
def cell_hour_counts(t: Tables) -> DataFrame:
    return counts.cell_hour_counts(t.rides())


@query
def cell_counts(t: Tables) -> DataFrame:
    return counts.counts_by_grid_cell(t.rides())


@query
def scaled_counts_global(t: Tables) -> DataFrame:
    return _rounded(counts.count_rides(t.rides()), "count_scaled")


@query
def scaled_counts_by_period(t: Tables) -> DataFrame:
    return _rounded(counts.count_rides(t.rides(), period=PERIOD), "count_scaled")


@query
def union_periods(t: Tables) -> DataFrame:
    """Two spans counted and scaled on their own, then stacked."""
    early, late = _time_split(t.rides())
    parts = [
        counts.count_rides(span).withColumn("span", F.lit(name)) for name, span in (("early", early), ("late", late))
    ]
    return _rounded(parts[0].unionByName(parts[1]), "count_scaled")


@query
def busiest_groups(t: Tables) -> DataFrame:
    """Top-k report: the 20 busiest cell-hours."""
    rows = counts.cell_hour_counts(t.rides())
    return explore.busiest(rows, 20, ties=["pickup_datetime", "grid_x", "grid_y"])


@query
def preview_rows(t: Tables) -> DataFrame:
    """A preview: the first ten cell-hours."""
    return counts.cell_hour_counts(t.rides()).orderBy("pickup_datetime", "grid_x", "grid_y").limit(10)


@query
def count_describe(t: Tables) -> DataFrame:
    stats = metrics.describe(counts.cell_hour_counts(t.rides()), "count", repeating=True)
    return _rounded(stats, "mean", "std")


@query
def count_quantiles(t: Tables) -> DataFrame:
    cells = counts.counts_by_grid_cell(t.rides())
    stats = metrics.describe(cells, "count", probs=(0.5, 0.75, 0.90, 0.95, 0.99), repeating=True)
    return _rounded(stats, "mean", "std", "p50", "p75", "p90", "p95", "p99")


@query
def top_quantile_cells(t: Tables) -> DataFrame:
    return explore.top_quantile_cells(counts.counts_by_grid_cell(t.rides()))


@query
def mean_hourly_max(t: Tables) -> DataFrame:
    return _rounded(explore.mean_hourly_max(counts.cell_hour_counts(t.rides()), "2024-01-02"), "mean_hourly_max")


@query
def demand_heatmap(t: Tables) -> DataFrame:
    return workflows.demand_heatmap(t.rides())


@query
def high_demand_heatmap(t: Tables) -> DataFrame:
    cells = counts.counts_by_grid_cell(t.rides()).filter(explore.in_rectangle(explore.HIGH_DEMAND_VIEW))
    x0, x1, _, _ = explore.HIGH_DEMAND_VIEW
    return explore.matrix(cells, "grid_y", "grid_x", range(x0, x1 + 1), "count", "x")


@query
def dense_grid(t: Tables) -> DataFrame:
    return workflows.dense_periods(t.rides(), PERIOD)


# ---- weather join and demand by feature ----------------------------------


@query
def rides_weather(t: Tables) -> DataFrame:
    """Cell-hours with their hour's weather; equal records of an hour are one, with their number."""
    joined = joins.join_rides_metar(counts.count_rides(t.rides()), weather.weather_records(t.metar()))
    return _rounded(joined, "count_scaled", "fahrenheit")


@query
def rides_weather_left(t: Tables) -> DataFrame:
    hourly = weather.clean_metar(t.metar(), dedupe=True)
    joined = joins.join_rides_metar(counts.cell_hour_counts(t.rides()), hourly, how="left")
    return _rounded(joined, "fahrenheit")


@query
def rides_without_weather(t: Tables) -> DataFrame:
    lost = joins.rides_without_weather(counts.clean_rides(t.rides()), weather.weather_records(t.metar()))
    return lost.select("ride_id", "pickup_datetime")


@query
def weather_join_audit(t: Tables) -> DataFrame:
    return joins.audit_dropped(counts.cell_hour_counts(t.rides()), weather.weather_records(t.metar()))


def _demand_by_clock(t: Tables, keys: list[str]) -> DataFrame:
    return workflows.demand_by_clock(counts.cell_hour_counts(t.rides()), weather.weather_records(t.metar()), keys)


@query
def demand_by_weekday(t: Tables) -> DataFrame:
    return _demand_by_clock(t, ["weekday"])


@query
def demand_by_hour(t: Tables) -> DataFrame:
    return _demand_by_clock(t, ["hour"])


@query
def demand_weekday_hour(t: Tables) -> DataFrame:
    return explore.matrix(_demand_by_clock(t, ["weekday", "hour"]), "weekday", "hour", range(24), "demand", "h")


def _demand_by_bin(t: Tables, feature: str, n: int) -> DataFrame:
    records = weather.fold_records(weather.weather_records(t.metar()), feature)
    joined = joins.join_rides_metar(counts.cell_hour_counts(t.rides()), records)
    return _rounded(explore.mean_by_bin(joined, feature, n, weight="n_records"), "bin_low", "bin_high", "mean")


@query
def demand_by_temp_bin(t: Tables) -> DataFrame:
    return _demand_by_bin(t, "fahrenheit", 4)


@query
def demand_by_precip_bin(t: Tables) -> DataFrame:
    return _demand_by_bin(t, "precip_in", 3)


# ---- baseline models and their errors ------------------------------------


def _scored(t: Tables) -> DataFrame:
    early, late = _time_split(t.rides())
    return workflows.train_and_predict(early, late)


@query
def baseline_model(t: Tables) -> DataFrame:
    model = baseline.fit_baseline(counts.count_rides(t.rides()))
    return _rounded(model, "mean_count", "mean_count_scaled")


@query
def baseline_predict(t: Tables) -> DataFrame:
    return _rounded(_scored(t), "count_scaled", "pred", "pred_scaled", "residual")


@query
def adjusted_model(t: Tables) -> DataFrame:
    model = baseline.fit_adjusted(counts.count_rides(t.rides()), weather.weather_records(t.metar()))
    return _rounded(model, "mean_count", "mean_count_scaled")


def _scored_adjusted(t: Tables, hourly: DataFrame) -> DataFrame:
    early, late = _time_split(t.rides())
    return workflows.train_and_predict_adjusted(early, late, weather.weather_records(t.metar()), hourly)


@query
def adjusted_predict(t: Tables) -> DataFrame:
    scored = _scored_adjusted(t, weather.weather_records(t.metar()))
    return _rounded(scored, "count_scaled", "fahrenheit", "pred", "pred_scaled", "residual")


@query
def adjusted_fit_transform(t: Tables) -> DataFrame:
    """The rain-adjusted model on the rows that it is fitted to."""
    scored = workflows.fit_transform_adjusted(t.rides(), weather.weather_records(t.metar()))
    return _rounded(scored, "count_scaled", "fahrenheit", "pred", "pred_scaled", "residual")


@query
def prediction_stats(t: Tables) -> DataFrame:
    stats = metrics.prediction_stats(_scored(t))
    return _rounded(stats, *[c for c, kind in stats.dtypes if kind == "double"])


@query
def adjusted_stats(t: Tables) -> DataFrame:
    stats = metrics.prediction_stats(_scored_adjusted(t, weather.clean_metar(t.metar(), dedupe=True)))
    return _rounded(stats, *[c for c, kind in stats.dtypes if kind == "double"])


@query
def scaling_check(t: Tables) -> DataFrame:
    return _rounded(
        metrics.scaling_check(workflows.fit_transform(t.rides())), "max_abs_difference", "rmse_rescaled", "rmse"
    )


@query
def error_summary(t: Tables) -> DataFrame:
    return _rounded(metrics.error_summary(_scored(t)), "sse", "mean_error", "mean_abs_error", "std_error")


def _fit_all(t: Tables) -> DataFrame:
    return _rounded(workflows.fit_transform(t.rides()), "count_scaled", "pred", "pred_scaled", "residual")


@query
def underestimated(t: Tables) -> DataFrame:
    return _fit_all(t).filter(residuals.is_under())


@query
def overestimated(t: Tables) -> DataFrame:
    return _fit_all(t).filter(residuals.is_over(OVER_RESIDUAL))


@query
def well_estimated(t: Tables) -> DataFrame:
    return _fit_all(t).filter(residuals.is_well())


@query
def large_residual(t: Tables) -> DataFrame:
    return _fit_all(t).filter(residuals.is_large(OVER_RESIDUAL))


@query
def value_cutoffs(t: Tables) -> DataFrame:
    """Quiet rows predicted too low, and rows over a count."""
    rows = _fit_all(t)
    quiet_low = (F.col("count") < 5) & (F.col("residual") < 0)
    return rows.filter(quiet_low | (F.col("count") > 20)).withColumn("quiet_low", quiet_low)


@query
def residual_weekday_hour(t: Tables) -> DataFrame:
    return residuals.weekday_hour_sizes(_fit_all(t).filter(residuals.is_over(OVER_RESIDUAL)))


def _over_study(t: Tables) -> dict[str, DataFrame]:
    return workflows.analyze_overestimated(t.rides(), OVER_RESIDUAL, period=STUDY_PERIOD)


def _under_study(t: Tables) -> dict[str, DataFrame]:
    return workflows.analyze_underestimated(t.rides(), UNDER_SHARE, STUDY_PERIOD)


@query
def over_study_by_period(t: Tables) -> DataFrame:
    """Overestimated rows of a model fitted per half-month, by half-month, weekday and hour."""
    return _over_study(t)["weekday_hour"]


@query
def under_study_cells(t: Tables) -> DataFrame:
    return _under_study(t)["cells"]


@query
def over_study_cells(t: Tables) -> DataFrame:
    return _over_study(t)["cells"]


@query
def under_study_by_period(t: Tables) -> DataFrame:
    return _under_study(t)["weekday_hour"]


@query
def over_study_rows(t: Tables) -> DataFrame:
    return _rounded(_over_study(t)["rows"], "count_scaled", "pred", "pred_scaled", "residual")


@query
def under_study_rows(t: Tables) -> DataFrame:
    return _rounded(_under_study(t)["rows"], "count_scaled", "pred", "pred_scaled", "residual")


def _panels(study: dict[str, DataFrame]) -> DataFrame:
    """Histogram panels of a study, one below the other: rows per date, hour and weekday of each period."""
    axes = (("dates", "date"), ("hours", "hour"), ("weekdays", "weekday"))
    parts = [
        study[table].select("period", F.lit(axis).alias("axis"), F.col(axis).cast("string").alias("at"), F.col("count").alias("n_rows"))
        for table, axis in axes
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def over_histograms(t: Tables) -> DataFrame:
    return _panels(_over_study(t))


@query
def under_histograms(t: Tables) -> DataFrame:
    return _panels(_under_study(t))


@query
def residual_histogram(t: Tables) -> DataFrame:
    """Hours of the overestimated rows in equal-width bins."""
    rows = workflows.fit_transform(t.rides()).filter(residuals.is_over(OVER_RESIDUAL))
    return _rounded(explore.histogram(rows, "hour"), "bin_low", "bin_high")


@query
def residual_by_feature(t: Tables) -> DataFrame:
    rows = joins.join_rides_metar(workflows.fit_transform(t.rides()), weather.clean_metar(t.metar(), dedupe=True))
    stats = residuals.by_feature(rows, ["count", "weekday", "hour"], {"fahrenheit": 10, "precip_in": 10})
    return _rounded(stats, "mean_residual", "mean_abs")


@query
def residual_by_rain(t: Tables) -> DataFrame:
    sides = workflows.residuals_by_weather(t.rides(), t.metar(), ["heavy_rain", "moderate_rain"])
    return _rounded(sides, "mean", "std", "min", "max")


@query
def residual_by_temperature(t: Tables) -> DataFrame:
    sides = workflows.residuals_by_weather(t.rides(), t.metar(), ["cold", "hot"], hot_above=HOT_ABOVE)
    return _rounded(sides, "mean", "std", "min", "max")


@query
def residual_by_area(t: Tables) -> DataFrame:
    rows = workflows.residuals_by_area(t.rides(), STUDY_PERIOD)
    stats = metrics.describe(rows, "residual", by=["period", "high_demand"])
    return _rounded(stats, "mean", "std", "min", "max", "p25", "p50", "p75")


# ---- similarity of periods -----------------------------------------------


@query
def period_distance(t: Tables) -> DataFrame:
    return workflows.dist_matrix(t.rides(), PERIOD)


@query
def period_total_distance(t: Tables) -> DataFrame:
    return similarity.total_distances(workflows.dist_matrix(t.rides(), PERIOD))


@query
def counts_diff(t: Tables) -> DataFrame:
    first, other = (F.lit(day).cast("timestamp_ntz") for day in ("2024-01-01", "2024-01-22"))
    return similarity.counts_diff(workflows.dense_periods(t.rides(), PERIOD), first, other)


@query
def kmeans_periods(t: Tables) -> DataFrame:
    """Cluster of each week; the cluster holding the first week is called 0."""
    return _clusters(t).select("period", "cluster")


@query
def dist_to_center(t: Tables) -> DataFrame:
    return _rounded(_clusters(t).select("period", "dist_to_center"), "dist_to_center")


def _clusters(t: Tables) -> DataFrame:
    scored = workflows.cluster_periods(t.rides(), PERIOD)
    first = scored.agg(F.min_by("prediction", "period")).scalar()
    return scored.withColumn("cluster", (F.col("prediction") != first).cast("int"))


# ---- ZIP labels ----------------------------------------------------------


@query
def zip_rides(t: Tables) -> DataFrame:
    labelled = workflows.label_rides(t.rides(), t.centroids(), ZIP_RADIUS_KM)
    return labelled.select("ride_id", "pickup_datetime", "zip")


@query
def zip_missing(t: Tables) -> DataFrame:
    rides = zipcodes.label_zip(t.rides(), t.centroids(), ZIP_RADIUS_KM)
    return rides.agg(
        F.count("*").alias("n_rides"),
        F.count_if(F.col("zip") == zipcodes.MISSING).alias("n_missing"),
        F.count_if((F.col("zip") == zipcodes.MISSING) & (F.col("pickup_latitude") != 0)).alias("n_unexplained"),
    )


@query
def zip_demand(t: Tables) -> DataFrame:
    return workflows.zip_demand(t.rides(), t.metar(), t.centroids(), ZIP_RADIUS_KM)


@query
def zip_busiest(t: Tables) -> DataFrame:
    """Top-k report: the 20 busiest rows of the ZIP demand table."""
    keys = ["hour", "weekday", "zip", "temperature", "precipitation"]
    return explore.busiest(workflows.zip_demand(t.rides(), t.metar(), t.centroids(), ZIP_RADIUS_KM), 20, ties=keys)


# ---- samples and splits --------------------------------------------------


@query
def sample_n(t: Tables) -> DataFrame:
    """The sampling operator: exactly 500 rides of every week."""
    rides = t.rides().withColumn("period", PERIOD("pickup_datetime"))
    return splits.sample_n(rides, 500, ["ride_id"], ["period"], seed=7).select("ride_id", "period")


@query
def mask_split(t: Tables) -> DataFrame:
    cells = counts.cell_hour_counts(t.rides())
    return splits.mask_split(cells, ["pickup_datetime", "grid_x", "grid_y"], 0.5, seed=1)


@query
def weighted_split(t: Tables) -> DataFrame:
    cells = counts.cell_hour_counts(t.rides())
    return splits.weighted_split(cells, {"train": 8, "dev": 1, "test": 1}, ["pickup_datetime", "grid_x", "grid_y"], 3)


@query
def fixed_split(t: Tables) -> DataFrame:
    cells = materialize(counts.cell_hour_counts(t.rides()))
    return splits.split_exact(cells, {"test": 200, "dev": 100}, ["pickup_datetime", "grid_x", "grid_y"], seed=2)


# ---- forests -------------------------------------------------------------


def _features(t: Tables) -> DataFrame:
    return workflows.joined_features(t.rides(), t.metar())


def _facts(result: forest.ForestResult, label: str, weight: str) -> DataFrame:
    """One row that holds of any sound fit: rows per split, rows predicted, predictions within
    the range of the training label, and a smaller error on the training rows than the mean's."""
    ends = result.train.agg(F.struct(F.count("*").alias("n"), F.min(label).alias("low"), F.max(label).alias("high")).alias("x")).scalar()
    both = result.dev.withColumn("split", F.lit("dev")).unionByName(result.predictions.withColumn("split", F.lit("test")))
    both = both.withColumn("_train", ends)
    tested = F.col("split") == "test"
    inside = F.col("prediction").between(F.col("_train.low") - 1e-9, F.col("_train.high") + 1e-9)
    fitted = result.model.transform(result.train).agg(metrics.r2(label, "prediction", weight).alias("r2")).scalar()
    return both.agg(
        F.first("_train.n").alias("n_train"),
        F.count_if(~tested).alias("n_dev"),
        F.count_if(tested).alias("n_test"),
        F.count("prediction").alias("n_predicted"),
        F.every(inside).alias("within_range"),
    ).withColumns({"beats_mean": fitted > 0, "errors_known": F.lit(result.rmse >= 0 and result.dev_rmse >= 0)})


def _forest_facts(t: Tables, model_type: str) -> DataFrame:
    """The parameter sets that were searched, each with the facts of the fit."""
    result = forest.rf_pipeline(_features(t), model_type, FOREST_GRID, num_folds=2, weight="n_records")
    searched = forest.get_model_stats(result.model, t.spark).select(
        "num_trees", "max_depth", "min_instances", (F.col("cv_rmse") > 0).alias("scored")
    )
    folds = {f"n_fold{i}": F.lit(n).cast("long") for i, n in enumerate(result.model.fold_rows)}
    searched = searched.withColumns({"model_type": F.lit(model_type), **folds})
    return attach(searched, _facts(result, "count_scaled", "n_records"), ())


@query
def rf_type1(t: Tables) -> DataFrame:
    return _forest_facts(t, "1")


@query
def rf_type2(t: Tables) -> DataFrame:
    return _forest_facts(t, "2")


@query
def rf_type3(t: Tables) -> DataFrame:
    return _forest_facts(t, "3")


@query
def rf_single_fit(t: Tables) -> DataFrame:
    """One fit without a search, on the plain count: rows per split, and whether there is an error and it is below the mean's on the training rows."""
    halves = forest.model_table(splits.mask_split(_features(t), forest.ROW_KEY, 0.5, seed=1))
    train, test = (halves.filter(F.col("split") == s) for s in ("train", "test"))
    model, _ = forest.fit_once(train, test, "3", label="count", weight="n_records")
    return model.transform(halves).groupBy("split").agg(
        F.count("prediction").alias("n_predicted"),
        F.sum("n_records").alias("n_records"),
        (metrics.rmse("count", "prediction", "n_records") > 0).alias("has_error"),
        ((F.col("split") == "test") | (metrics.r2("count", "prediction", "n_records") > 0)).alias("beats_mean"),
    )


@query
def rf_split_r2(t: Tables) -> DataFrame:
    """R2 of one fit on each half. Trees are not known to SQL, so this has no oracle; a test recomputes it from the predictions."""
    halves = forest.model_table(splits.mask_split(_features(t), forest.ROW_KEY, 0.5, seed=1))
    model, _ = forest.fit_once(halves.filter("split = 'train'"), halves, "3", label="count", weight="n_records")
    return forest.split_r2(model, halves, "count", "n_records")


@query
def rf_period_split(t: Tables) -> DataFrame:
    early, late = _time_split(t.rides())
    sides = [workflows.joined_features(side, t.metar()) for side in (early, late)]
    result = forest.rf_period_split(*sides, "1", FOREST_GRID, num_folds=2, weight="n_records")
    summary = metrics.error_summary(result.predictions, "count_scaled", "prediction", "n_records")
    facts = _facts(result, "count_scaled", "n_records").drop("beats_mean")
    return attach(facts, summary.select(F.col("n_rows").alias("n_records"), r6("max_count").alias("max_count")), ())


@query
def rf_reload_score(t: Tables) -> DataFrame:
    """Fit on the early weeks, save, load, score the late weeks, and compare with the model that was fitted."""
    early, late = _time_split(t.rides())
    train = forest.model_table(workflows.joined_features(early, t.metar()))
    model, _ = forest.fit_once(train, train, "1", weight="n_records")
    folder = f"{shared_folder(t.spark)}/forest-{uuid.uuid4().hex}"
    sinks.save_model(model, folder)
    rows = forest.model_table(workflows.joined_features(late, t.metar()))
    loaded = forest.score_saved(sinks.load_model(folder), rows)
    own = model.transform(rows.select(*forest.ROW_KEY, "fahrenheit", "weekday", "hour")).select(*forest.ROW_KEY, F.col("prediction").alias("fitted"))
    same = loaded.join(own, list(forest.ROW_KEY))
    return same.select(
        "pickup_datetime", "grid_x", "grid_y", r6("fahrenheit").alias("fahrenheit"), "precip_in", "weekday", "hour", r6("count_scaled").alias("count_scaled"),
        (F.col("prediction") == F.col("fitted")).alias("same_prediction"),
        (F.abs(F.col("prediction") - F.col("count_scaled") - F.col("residual")) < 1e-12).alias("residual_fits"),
    )
