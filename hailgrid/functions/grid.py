"""The city grid: bounding box, cell index, cell id and cell centre."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@dataclass(frozen=True)
class GridSpec:
    """A lat/lon box cut into ``nx`` x ``ny`` cells; y counts down from the north.

    A point exactly on the east or south edge is inside the box and falls in
    column ``nx`` or row ``ny``, one past the last full cell. ``clamp=True``
    folds those into the last cell.
    """

    # The service area and its cell counts (cells of about 1 km).
    north: float = 41.0
    south: float = 40.5
    east: float = -73.7
    west: float = -74.05
    nx: int = 30
    ny: int = 55

    @property
    def dx(self) -> float:
        return (self.east - self.west) / self.nx

    @property
    def dy(self) -> float:
        return (self.north - self.south) / self.ny

    def contains(self, lat: Column | str, lon: Column | str) -> Column:
        """Inclusive box test, as plain comparisons that a Parquet scan can use. A
        null coordinate gives null, which a filter treats as outside."""
        return _as_col(lat).between(self.south, self.north) & _as_col(lon).between(self.west, self.east)

    def in_box(self, lat: Column | str, lon: Column | str) -> Column:
        """The box test as a flag that is never null."""
        return F.coalesce(self.contains(lat, lon), F.lit(False))

    def x(self, lon: Column | str, clamp: bool = False) -> Column:
        cell = ((_as_col(lon) - F.lit(self.west)) / F.lit(self.dx)).cast("int")
        return F.greatest(F.lit(0), F.least(F.lit(self.nx - 1), cell)) if clamp else cell

    def y(self, lat: Column | str, clamp: bool = False) -> Column:
        cell = ((F.lit(self.north) - _as_col(lat)) / F.lit(self.dy)).cast("int")
        return F.greatest(F.lit(0), F.least(F.lit(self.ny - 1), cell)) if clamp else cell

    def id_of(self, x: Column | str, y: Column | str) -> Column:
        return F.lit(self.nx) * _as_col(y) + _as_col(x)

    def cell_id(self, lat: Column | str, lon: Column | str) -> Column:
        return self.id_of(self.x(lon), self.y(lat))

    def coord(self, lat: Column | str, lon: Column | str) -> Column:
        return F.struct(self.x(lon).alias("x"), self.y(lat).alias("y"))

    def center_lon(self, cell_id: Column | str) -> Column:
        return F.lit(self.west) + (_as_col(cell_id) % self.nx + F.lit(0.5)) * F.lit(self.dx)

    def center_lat(self, cell_id: Column | str) -> Column:
        row = F.floor(_as_col(cell_id) / F.lit(self.nx))
        return F.lit(self.north) - (row + F.lit(0.5)) * F.lit(self.dy)

    @property
    def n_cells(self) -> int:
        return self.nx * self.ny


NYC = GridSpec()
