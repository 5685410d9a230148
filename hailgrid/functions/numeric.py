"""Number parsing, weather buckets and equal-width bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hailgrid.functions.grid import _as_col

# How numeric text is recognised. ``whole`` is the default and
# keeps negative readings; ``search`` and ``prefix`` accept a number anywhere
# in, or at the start of, the text.
NUMERIC_TEXT = {
    "whole": r"^-?\d+(\.\d+)?$",
    "search": r"\d+(\.\d+)?",
    "prefix": r"^\d+(\.\d+)?",
}

# Lower edges of the temperature (F) and precipitation (inch) buckets.
FAHRENHEIT_EDGES = (40.0, 55.0, 70.0, 85.0)
PRECIP_EDGES = (0.10, 0.30)


def is_numeric_text(c: Column | str, match: str = "whole") -> Column:
    return _as_col(c).cast("string").rlike(NUMERIC_TEXT[match])


def parse_numeric(c: Column | str, match: str = "whole") -> Column:
    """Text to double; anything that is not a number becomes null."""
    return F.when(is_numeric_text(c, match), _as_col(c).try_cast("double"))


def _left_closed(c: Column, edges: tuple[float, ...]) -> Column:
    return sum(((c >= F.lit(edge)).cast("int") for edge in edges), F.lit(0))


def bucket_fahrenheit(c: Column | str) -> Column:
    """0..4, left-closed; null stays null."""
    return _left_closed(_as_col(c), FAHRENHEIT_EDGES)


def bucket_precip(c: Column | str) -> Column:
    """0..2, left-closed; a negative amount is an error."""
    amount = _as_col(c)
    problem = F.concat(F.lit("negative precipitation: "), amount.cast("string"))
    return F.when(amount < 0, F.raise_error(problem).cast("int")).otherwise(_left_closed(amount, PRECIP_EDGES))


def right_closed_bin(c: Column | str, lo: Column, hi: Column, n: int) -> Column:
    """Index of the right-closed equal-width bin over [lo, hi]; lo falls in bin 0."""
    step = (hi - lo) / F.lit(float(n))
    return sum(((_as_col(c) > lo + F.lit(float(i)) * step).cast("int") for i in range(1, n)), F.lit(0))


def left_closed_bin(c: Column | str, lo: Column, hi: Column, n: int) -> Column:
    """Index of the left-closed equal-width bin over [lo, hi]; hi falls in the last bin."""
    step = (hi - lo) / F.lit(float(n))
    return sum(((_as_col(c) >= lo + F.lit(float(i)) * step).cast("int") for i in range(1, n)), F.lit(0))


def r6(c: Column | str) -> Column:
    """Six decimals, with negative zero folded into zero."""
    return F.round(_as_col(c), 6) + F.lit(0.0)
