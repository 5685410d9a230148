"""How alike periods are: dense cell vectors, pairwise distances, two-means clusters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hailgrid.functions.grid import NYC, GridSpec
from hailgrid.session import materialize


def dense_cells(counts: DataFrame, by: Sequence[str] = ("period",), grid: GridSpec = NYC) -> DataFrame:
    """Every full cell of every period, 0 where there were no rides. Points on
    the east and south edges (x = nx, y = ny) lie outside the matrix."""
    index = F.sequence(F.lit(0), F.lit(grid.n_cells - 1))
    # summing the counts, not just listing the groups, reads the same shuffle as the join below
    groups = counts.groupBy(*by).agg(F.sum("count").alias("_rides")).filter("_rides > 0")
    cells = groups.withColumn("_cell", F.explode(index))
    frame = cells.select(
        *by,
        (F.col("_cell") % grid.nx).alias("grid_x"),
        F.floor(F.col("_cell") / F.lit(grid.nx)).cast("int").alias("grid_y"),
    )
    joined = frame.join(counts, [*by, "grid_x", "grid_y"], "left")
    return joined.withColumn("count", F.coalesce("count", F.lit(0).cast("bigint")))


def counts_diff(dense: DataFrame, first, second, period: str = "period") -> DataFrame:
    """Absolute difference of two periods, cell by cell."""
    one = F.sum(F.when(F.col(period) == first, F.col("count")))
    other = F.sum(F.when(F.col(period) == second, F.col("count")))
    pair = dense.filter((F.col(period) == first) | (F.col(period) == second))
    both = pair.groupBy("grid_x", "grid_y").agg(F.coalesce(one, F.lit(0)).alias("a"), F.coalesce(other, F.lit(0)).alias("b"))
    return both.select("grid_x", "grid_y", F.abs(F.col("a") - F.col("b")).alias("diff"))


def period_distances(dense: DataFrame, period: str = "period") -> DataFrame:
    """Distance between every two periods: summed absolute cell differences.

    The input is one row per (period, cell), so the join on the cell grows with
    the calendar and the grid, never with the rides. Each unordered pair is
    computed once and mirrored.
    """
    a = dense.select(F.col(period).alias("period_a"), "grid_x", "grid_y", F.col("count").alias("a"))
    b = dense.select(F.col(period).alias("period_b"), "grid_x", "grid_y", F.col("count").alias("b"))
    halves = (
        a.join(b, ["grid_x", "grid_y"])
        .filter(F.col("period_a") <= F.col("period_b"))
        .groupBy("period_a", "period_b")
        .agg(F.sum(F.abs(F.col("a") - F.col("b"))).alias("distance"))
    )
    there = F.struct(F.col("period_a").alias("x"), F.col("period_b").alias("y"))
    back = F.struct(F.col("period_b").alias("x"), F.col("period_a").alias("y"))
    ways = F.when(F.col("period_a") == F.col("period_b"), F.array(there)).otherwise(F.array(there, back))
    return halves.select(F.explode(ways).alias("p"), "distance").select(
        F.col("p.x").alias("period_a"), F.col("p.y").alias("period_b"), "distance"
    )


def total_distances(distances: DataFrame) -> DataFrame:
    return distances.groupBy(F.col("period_a").alias("period")).agg(F.sum("distance").alias("total_distance"))


def period_vectors(dense: DataFrame, period: str = "period") -> DataFrame:
    """One vector per period, x-major. A vector has as many entries as the grid has cells."""
    ordered = F.array_sort(F.collect_list(F.struct("grid_x", "grid_y", "count")))
    vectors = dense.groupBy(period).agg(ordered.alias("cells"))
    values = F.transform("cells", lambda c: c["count"].cast("double"))
    return vectors.select(period, array_to_vector(values).alias("features"))


@dataclass
class Clusters:
    """The centres of the cheapest start, their cost, and how many rounds were made."""

    centers: list[list[float]]
    cost: float
    rounds: int


def _squared(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v)


def _nearest(values: Column, centers: Column) -> Column:
    """Struct (cost, cluster) of the nearest of an array of (cluster, center); ties go to the smaller cluster."""
    return F.array_min(F.transform(centers, lambda c: F.struct(_squared(values, c["center"]).alias("cost"), c["cluster"].alias("cluster"))))


def _state(centers: DataFrame) -> DataFrame:
    """All centres written as one row: starts x clusters vectors, which the next round reads as a scalar."""
    return materialize(centers.agg(F.collect_list(F.struct("start", "cluster", "cost", "center")).alias("every")))


def _beside(rows: DataFrame, state: DataFrame, starts: int) -> DataFrame:
    """Every row once for each start, with the start's nearest centre."""
    tried = rows.withColumn("_every", state.select("every").scalar())
    tried = tried.select("_key", "_values", "_every", F.explode(F.sequence(F.lit(0), F.lit(starts - 1))).alias("start"))
    near = _nearest(F.col("_values"), F.filter("_every", lambda c: c["start"] == F.col("start")))
    return tried.select("_key", "_values", "start", near.alias("near"))


def _spread_start(rows: DataFrame, k: int, seed: int, starts: int) -> DataFrame:
    """The state of first centres: each further one of a start is drawn with a chance that follows its squared distance from those before.

    The draw is the largest log(u) / weight, u from a hash of the row, the start and the seed, so it does not depend on partitions.
    Where a start has fewer distinct rows than clusters, it has fewer centres.
    """
    def drawn(cluster: int) -> Column:
        u = (F.xxhash64(F.lit(seed), F.lit(cluster), "start", "_key") % F.lit(1 << 52)).cast("double") / F.lit(float(1 << 53)) + F.lit(0.5)
        return F.log(F.greatest(u, F.lit(1e-300)))

    def centers(picked: DataFrame, weight: Column, cluster: int) -> DataFrame:
        best = picked.groupBy("start").agg(F.max_by("_values", drawn(cluster) / weight).alias("center"))
        return best.select("start", F.lit(cluster).alias("cluster"), F.lit(0.0).alias("cost"), "center")

    first = rows.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(starts - 1))))
    state = _state(centers(first, F.lit(1.0), 0))
    for cluster in range(1, k):
        far = _beside(rows, state, starts).filter("near.cost > 0")
        state = _state(state.select(F.inline("every")).unionByName(centers(far, F.col("near.cost"), cluster)))
    return state


def fit_clusters(vectors: DataFrame, k: int = 2, seed: int = 1, starts: int = 10, max_rounds: int = 100) -> Clusters:
    """The cheapest of ``starts`` seeded runs; more starts are less likely to end in a poor optimum.

    All starts advance together: a round is one aggregate over the rows, with sums combined in the tasks, whose state (starts x
    clusters vectors) is written for the next. The rounds end when no start's cost falls any more.
    """
    if k < 1 or starts < 1:
        raise ValueError("at least one cluster and one start are needed")
    values = vectors.select(vector_to_array("features").alias("_values"))
    rows = materialize(values.withColumn("_key", F.xxhash64("_values")))
    state = _spread_start(rows, k, seed, starts)
    before: dict[int, float] = {}
    for done in range(1, max_rounds + 1):
        groups = _beside(rows, state, starts).groupBy("start", F.col("near.cluster").alias("cluster"))
        mean = Summarizer.mean(array_to_vector("_values"))
        moved = groups.agg(F.sum("near.cost").alias("cost"), mean.alias("mean"))
        following = _state(moved.select("start", "cluster", "cost", vector_to_array("mean").alias("center")))
        costs: dict[int, float] = {}
        for c in following.select(F.transform("every", lambda c: F.struct(c["start"], c["cost"]))).first()[0]:
            costs[c[0]] = costs.get(c[0], 0.0) + c[1]
        if not costs:
            raise ValueError("no vectors to cluster")
        # The costs belong to the centres before the move. Sums in another order may differ in the last digits.
        if before and all(costs[s] >= before[s] * (1 - 1e-12) for s in costs):
            break
        before, state = costs, following
    best = min(costs, key=lambda s: (costs[s], s))
    found = state.select(F.inline("every")).filter(F.col("start") == best).orderBy("cluster").collect()
    return Clusters([list(r.center) for r in found], costs[best], done)


def dist_to_center(vectors: DataFrame, clusters: Clusters) -> DataFrame:
    """Each period's cluster and its Euclidean distance to that cluster's centre."""
    table = vectors.sparkSession.createDataFrame(list(enumerate(clusters.centers)), "cluster int, center array<double>")
    every = table.agg(F.array_sort(F.collect_list(F.struct("cluster", "center")))).scalar()
    near = _nearest(F.col("_values"), F.col("_centers"))
    scored = vectors.withColumns({"_values": vector_to_array("features"), "_centers": every}).withColumn("_near", near)
    return scored.withColumns({"prediction": F.col("_near.cluster"), "dist_to_center": F.sqrt("_near.cost")}).drop(
        "_values", "_centers", "_near", "features"
    )
