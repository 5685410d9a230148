"""Nearest-centroid ZIP labels within a radius, by a pruned index of cells.

Space is cut into square buckets one radius wide, so that any centroid within the radius of a point lies in the
point's bucket or one of its eight neighbours. A bucket lists only the centroids that can be the nearest one to
some point of it: one is dropped if that nearest to the bucket's middle is nearer all over the bucket.
Where more than a few are left the bucket is cut into sixteen cells, which are pruned in turn, until all lists are short;
so cells are small where places crowd. A ride meets its cell's list and picks its label with an array expression.
Distances are compared in whole millimetres and ties go to the smaller ZIP, so labels do not
depend on the order of arithmetic. Buckets wrap around at 180 degrees.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from hailgrid.session import materialize

# Mean Earth radius, and the label of a ride without a ZIP.
EARTH_KM = 6371.0
MISSING = "missing"
_MM_PER_KM = 1e6

# Entries of the index up to which it is handed to every task (about 20 MB); a larger one is joined by cell. US ZIP codes
# number about 41,000 and take about nine entries each.
MAX_BROADCAST = 500_000

# A cell whose list is longer is cut, SPLIT times by each side, until its height is no more than a millimetre or so. Each cut
# allows MORE entries: where many places are about as near, small cells would save little.
LEAF = 4
MORE = 2
SPLIT = 4
_LEAST_KM = 2e-6


def haversine_mm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.floor(2 * EARTH_KM * _MM_PER_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a))) + 0.5)


def _distinct_places(centroids: DataFrame) -> DataFrame:
    """One ZIP per location: at equal distance the smaller ZIP wins anyway."""
    return centroids.groupBy("lat", "lon").agg(F.min("zip").alias("zip"))


def _bucket_sizes(max_abs_lat: float, radius_km: float) -> tuple[float, int]:
    """Bucket height in degrees, and the number of buckets around a circle of latitude; a bucket is at least one
    radius wide everywhere a match can lie. Near a pole one bucket spans the circle."""
    height = math.degrees(radius_km / EARTH_KM) * 1.001
    reach = max_abs_lat + height
    if reach >= 89.0:
        return height, 1
    # the arc that spans the radius there: slightly wider than the radius over the cosine
    half = math.sin(radius_km / EARTH_KM / 2) / math.cos(math.radians(reach))
    width = math.degrees(2 * math.asin(min(1.0, half))) * 1.001
    return height, max(1, math.floor(360.0 / width))


class _Cells:
    """The cells of one level of the index: (_i, _j) counts them from the equator and from 180 degrees west."""

    def __init__(self, height: float, around: int, rows: int = 1, columns: int = 1):
        self.height, self.around, self.rows, self.columns = height, around, rows, columns
        self.tall, self.wide = height / rows, 360.0 / around / columns

    def cut(self) -> _Cells:
        """Sixteen cells for each: by both sides, or by longitude alone while they are much wider than tall (buckets near a pole)."""
        by = (1, SPLIT * SPLIT) if self.wide > SPLIT * self.tall else (SPLIT, SPLIT)
        return _Cells(self.height, self.around, self.rows * by[0], self.columns * by[1])

    def of(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        # Exact for powers of two, so that a point's cells of all levels lie within each other.
        i, j = lat / self.height * self.rows, (lon + 180.0) / 360.0 * self.around * self.columns
        return F.floor(i), F.pmod(F.floor(j), F.lit(self.around * self.columns))


def _pruned(entries: DataFrame, cells: _Cells, radius_km: float) -> DataFrame:
    """Entries (_i, _j, zip, lat, lon, x, y, z) without the places that are nowhere in their cell the nearest, or nowhere within the radius.

    A place's rival is the one nearest to the cell's middle. Where it is nearer is one side of a plane through the centre of the
    globe, so a rival that is nearer at all four corners is nearer everywhere, but for the curve of the cell's sides.
    """
    tall, wide = math.radians(cells.tall), math.radians(cells.wide)
    placed = entries.selectExpr(
        "*",
        *[f"radians(greatest(-90D, least(90D, (_i + {k}D) * {cells.tall!r}D))) AS _lat{n}" for n, k in enumerate((0, 0.5, 1))],
        *[f"radians((_j + {k}D) * {cells.wide!r}D - 180D) AS _lon{n}" for n, k in enumerate((0, 0.5, 1))],
    ).selectExpr(*entries.columns, *[f"{f}(_{a}{n}) AS _{f}_{a}{n}" for f in ("sin", "cos") for a in ("lat", "lon") for n in range(3)])

    def dot(i: int, j: int, x: str, y: str, z: str) -> str:
        return f"_cos_lat{i} * (_cos_lon{j} * {x} + _sin_lon{j} * {y}) + _sin_lat{i} * {z}"

    placed = placed.withColumn("_mid", F.expr("sqrt(pow(_cos_lat1 * _cos_lon1 - x, 2) + pow(_cos_lat1 * _sin_lon1 - y, 2) + pow(_sin_lat1 - z, 2))"))
    rivals = placed.groupBy("_i", "_j").agg(F.min(F.struct("_mid", "x", "y", "z")).alias("_q"))
    both = placed.join(rivals, ["_i", "_j"]).selectExpr("*", "_q.x - x AS _gx", "_q.y - y AS _gy", "_q.z - z AS _gz")
    corners = ", ".join(dot(i, j, "_gx", "_gy", "_gz") for i in (0, 2) for j in (0, 2))
    # Half of what the squares of the two distances differ by, at least: a plane's height over the cell departs from that between its
    # corners by the curve, and the distances that decide are in whole millimetres.
    curve = f"{(tall * tall + wide * wide) / 8!r}D * sqrt(_gx * _gx + _gy * _gy + _gz * _gz)"
    half = math.hypot(tall, wide) / 2
    rounding = f"{2 * _LEAST_KM / EARTH_KM!r}D * (_mid + {half!r}D) + 1e-15D"
    kept = both.filter(f"least({corners}) <= {curve} + {rounding} AND _mid <= {half + (radius_km + _LEAST_KM) / EARTH_KM!r}D")
    return kept.select(*entries.columns)


def build_index(places: DataFrame, height: float, around: int, radius_km: float, leaf: int = LEAF) -> tuple[DataFrame, list[_Cells], int]:
    """The lists of the cells that are cut no further, (_level, _i, _j, _near), the cells of each level and the number of entries.

    Places are (zip, lat, lon), one for a location. A list has at most ``leaf`` entries and ``MORE`` for each level, but where more
    places can be nearest within the last millimetre. Entries are rows until their list is short, so a crowd of places is pruned by many tasks.
    """
    cells = _Cells(height, around)
    i, j = cells.of(F.col("lat"), F.col("lon"))
    sides = sorted({d % around for d in (-1, 0, 1)})
    entries = places.select(i.alias("_pi"), j.alias("_pj"), "zip", "lat", "lon").selectExpr(
        "*", "cos(radians(lat)) * cos(radians(lon)) AS x", "cos(radians(lat)) * sin(radians(lon)) AS y", "sin(radians(lat)) AS z"
    )
    for name, steps in (("_di", (-1, 0, 1)), ("_dj", sides)):
        entries = entries.withColumn(name, F.explode(F.array(*[F.lit(d) for d in steps])))
    at = [(F.col("_pi") + F.col("_di")).alias("_i"), F.pmod(F.col("_pj") + F.col("_dj"), F.lit(around)).alias("_j")]
    entries = entries.select(*at, "zip", "lat", "lon", "x", "y", "z")
    levels, lists = [cells], []
    while True:
        held = materialize(_pruned(entries, cells, radius_km))
        finest = math.radians(cells.tall) * EARTH_KM <= _LEAST_KM
        crowded = held.groupBy("_i", "_j").agg(F.count("*").alias("_n")).filter(F.col("_n") > leaf + MORE * len(lists)).select("_i", "_j")
        last = finest or crowded.isEmpty()
        short = held if last else held.join(crowded, ["_i", "_j"], "left_anti")
        lists.append(short.select(F.lit(len(lists)).alias("_level"), "_i", "_j", F.struct("zip", "lat", "lon").alias("place")))
        if last:
            every = functools.reduce(DataFrame.unionByName, lists)
            size = Observation()
            index = materialize(every.observe(size, F.count("*").alias("n")).groupBy("_level", "_i", "_j").agg(F.collect_list("place").alias("_near")))
            return index, levels, size.get["n"]
        entries = held.join(crowded, ["_i", "_j"])
        finer = cells.cut()
        for name, by in (("_i", finer.rows // cells.rows), ("_j", finer.columns // cells.columns)):
            entries = entries.withColumn(name, F.explode(F.sequence(F.col(name) * by, F.col(name) * by + by - 1)))
        cells = finer
        levels.append(cells)


def label_zip(
    rides: DataFrame,
    centroids: DataFrame,
    radius_km: float,
    lat: str = "pickup_latitude",
    lon: str = "pickup_longitude",
    max_broadcast: int = MAX_BROADCAST,
) -> DataFrame:
    """Rides with ``zip``: the nearest centroid within the radius, else 'missing'.

    The index is written when this is called, and counted. Broadcast, it lets the rides
    be scanned once and not shuffled; beyond that Spark joins by cell and splits hot ones.
    """
    size = centroids.agg(F.count("*").alias("n"), F.max(F.abs("lat")).alias("reach")).first()
    if size["n"] == 0:
        return rides.withColumn("zip", F.lit(MISSING))
    height, around = _bucket_sizes(size["reach"], radius_km)
    index, levels, entries = build_index(_distinct_places(centroids), height, around, radius_km)
    valid = F.col(lat).between(-90, 90) & F.col(lon).isNotNull()
    joined = rides
    for k, level in enumerate(levels):
        i, j = level.of(F.col(lat), F.col(lon))
        cells = index.filter(F.col("_level") == k).select(F.col("_i").alias(f"_i{k}"), F.col("_j").alias(f"_j{k}"), F.col("_near").alias(f"_near{k}"))
        cells = F.broadcast(cells) if entries <= max_broadcast else cells
        joined = joined.withColumns({"_pi": F.when(valid, i), "_pj": F.when(valid, j)})
        joined = joined.join(cells, (F.col("_pi") == F.col(f"_i{k}")) & (F.col("_pj") == F.col(f"_j{k}")), "left").drop("_pi", "_pj", f"_i{k}", f"_j{k}")
    # A point lies in one cell that was cut no further.
    lists = [f"_near{k}" for k in range(len(levels))]
    apart = F.transform(
        F.coalesce(*lists),
        lambda c: F.struct(haversine_mm(F.col(lat), F.col(lon), c["lat"], c["lon"]).alias("mm"), c["zip"].alias("zip")),
    )
    nearest = F.array_min(F.filter(apart, lambda c: c["mm"] <= round(radius_km * _MM_PER_KM)))
    return joined.withColumn("zip", F.coalesce(nearest["zip"], F.lit(MISSING))).drop(*lists)


def labelled_only(rides: DataFrame) -> DataFrame:
    return rides.filter(F.col("zip") != MISSING)


def unexplained_missing(rides: DataFrame, lat: str = "pickup_latitude") -> DataFrame:
    """Unlabelled rides that do carry a position."""
    return rides.filter((F.col("zip") == MISSING) & (F.col(lat) != 0))
