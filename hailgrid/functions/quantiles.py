"""Exact quantiles that no single task has to hold.

The built-in ``percentile`` keeps every distinct value of a group in one
buffer. That is right for counts, which repeat, but not for residuals, which
rarely do. Here a sketch brackets each wanted rank, and only the values in the
bracket (a fixed small share of the rows) are ranked, after being counted per
distinct value. What lies below a bracket is counted exactly, so a sketch that
is off is noticed; the groups it misses get a wider one until every rank is held.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hailgrid.session import materialize, small_side

SKETCH_ACCURACY = 20_000
# Half the share of the rows that a bracket is to hold, and how much wider it is where it missed its rank.
BRACKET = 10.0 / SKETCH_ACCURACY
WIDER = 16
# A bracket is ranked in so many parts of equal width, each in a task of its own.
PARTS = 256


def exact_quantiles(df: DataFrame, value: Column | str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """One row per group with ``q0, q1, ...``: linearly interpolated quantiles.

    The values are written once when this is called, and narrowed to their brackets. The brackets of few groups are handed to every task.
    """
    keys = list(by)
    col = F.col(value) if isinstance(value, str) else value
    data = materialize(df.select(*keys, col.cast("double").alias("_v")).filter(F.col("_v").isNotNull()))
    sides = _brackets(data, probs, keys)
    if keys:
        sides = small_side(sides)
    bracketed = attach(data, sides.select(*keys, "_lo", "_hi"), keys)

    def part(i: int) -> Column:
        low, high = F.col("_lo")[i], F.col("_hi")[i]
        return F.when(high > low, F.floor((F.col("_v") - low) / (high - low) * (PARTS - 1)).cast("int")).otherwise(0)

    slots = F.filter(
        F.array(
            *[
                F.when(F.col("_v").between(F.col("_lo")[i], F.col("_hi")[i]), F.struct(F.lit(i).alias("no"), part(i).alias("part")))
                for i in range(len(probs))
            ]
        ),
        lambda s: s.isNotNull(),
    )
    inside = (
        bracketed.select(*keys, "_v", F.explode(slots).alias("_at"))
        .groupBy(*keys, F.col("_at.no").alias("_slot"), F.col("_at.part").alias("_part"), "_v")
        .count()
    )
    # Cumulative counts: within a part of the bracket, after what the parts before it hold.
    within = Window.partitionBy(*keys, "_slot", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys, "_slot").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = inside.groupBy(*keys, "_slot", "_part").agg(F.sum("count").alias("_in_part"))
    parts = parts.withColumn("_before", F.coalesce(F.sum("_in_part").over(earlier), F.lit(0))).drop("_in_part")
    inside = inside.withColumn("_cum", F.sum("count").over(within))
    inside = attach(inside, parts, [*keys, "_slot", "_part"]).withColumn("_cum", F.col("_cum") + F.col("_before")).drop("_part", "_before")

    ranked = attach(inside.drop("count"), sides.drop("_lo", "_hi"), keys)
    spans = []
    for i, p in enumerate(probs):
        position = F.lit(p) * (F.col("_n") - 1)
        here = F.col("_slot") == i
        below = F.col(f"_below{i}")
        # smallest bracket value whose cumulative count passes the wanted rank
        for name, rank in (("a", F.floor(position)), ("b", F.ceil(position))):
            spans.append(F.min(F.when(here & (below + F.col("_cum") > rank), F.col("_v"))).alias(f"_{name}{i}"))
        spans.append(F.coalesce(F.max(F.when(here, F.col("_cum"))), F.lit(0)).alias(f"_in{i}"))
    picked = ranked.groupBy(*keys).agg(
        F.first("_n").alias("_n"),
        *[F.first(f"_{side}{i}").alias(f"_{side}{i}") for i in range(len(probs)) for side in ("below", "prev", "next")],
        *spans,
    )
    out = []
    for i, p in enumerate(probs):
        position = F.lit(p) * (F.col("_n") - 1)
        low, high = F.floor(position), F.ceil(position)
        below, prev, nxt = F.col(f"_below{i}"), F.col(f"_prev{i}"), F.col(f"_next{i}")
        # The neighbours serve a rank that is one beside the bracket.
        a = F.when(low < below, prev).otherwise(F.coalesce(F.col(f"_a{i}"), nxt))
        b = F.when(high < below, prev).otherwise(F.coalesce(F.col(f"_b{i}"), nxt))
        out.append((a + (b - a) * (position - low)).alias(f"q{i}"))
    return picked.select(*keys, *out)


def _sketch(data: DataFrame, probs: Sequence[float], keys: Sequence[str], half: float) -> DataFrame:
    """Per group its rows and, for each wanted rank, a value probably below and one probably above it."""
    if half >= 1:
        ends = [F.array_repeat(end("_v"), len(probs)) for end in (F.min, F.max)]
    else:
        ends = [
            F.percentile_approx("_v", [min(1.0, max(0.0, p + step)) for p in probs], SKETCH_ACCURACY) for step in (-half, half)
        ]
    return data.groupBy(*keys).agg(F.count("*").alias("_n"), ends[0].alias("_lo"), ends[1].alias("_hi"))


def _brackets(data: DataFrame, probs: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """One row per group: its rows, each rank's bracket, the rows below it and the value next to it on either side.

    Every bracket holds its rank or has it as a neighbour, by exact counts. Each round takes the groups whose bracket doesn't and
    widens it, up to the whole group, so there are at most four rounds and nearly always one.
    """
    slots = range(len(probs))
    half, found, missing = BRACKET, [], data
    while True:
        sketch = _sketch(missing, probs, keys, half)
        sketch = small_side(sketch) if keys else sketch
        low, high = (lambda i: F.col("_lo")[i]), (lambda i: F.col("_hi")[i])
        counted = materialize(
            attach(missing, sketch, keys).groupBy(*keys).agg(
                *[F.first(c).alias(c) for c in ("_n", "_lo", "_hi")],
                *[F.count_if(F.col("_v") < low(i)).alias(f"_below{i}") for i in slots],
                *[F.count_if(F.col("_v") > high(i)).alias(f"_above{i}") for i in slots],
                *[F.max(F.when(F.col("_v") < low(i), F.col("_v"))).alias(f"_prev{i}") for i in slots],
                *[F.min(F.when(F.col("_v") > high(i), F.col("_v"))).alias(f"_next{i}") for i in slots],
            )
        )
        lost = F.lit(False)
        for i, p in enumerate(probs):
            position = F.lit(p) * (F.col("_n") - 1)
            last = F.col("_n") - F.col(f"_above{i}")
            lost = lost | (F.floor(position) < F.col(f"_below{i}") - 1) | (F.ceil(position) > last)
        lost = F.coalesce(lost, F.lit(False))
        found.append(counted.filter(~lost).drop(*[f"_above{i}" for i in slots]))
        again = counted.filter(lost).select(*keys)
        if half >= 1 or again.isEmpty():
            break
        half *= WIDER
        if keys:
            missing = attach(data, small_side(again), keys)
    return reduce(DataFrame.unionByName, found)


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Put the per-group row of ``right`` beside every row of ``left``.

    Without keys ``right`` is a single row and comes in as a scalar subquery, so
    nothing is shuffled for it. Null keys match.
    """
    if not keys:
        row = right.select(F.struct(*right.columns).alias("_row")).scalar()
        return left.withColumn("_row", row).select(*left.columns, "_row.*")
    renamed = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return left.join(renamed, same, how).drop(*[f"_k_{k}" for k in keys])
