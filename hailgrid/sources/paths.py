"""File names and column layouts of the yearly ride files and station weather."""

from __future__ import annotations

import re

# File name patterns, sample sizes and the column names each
# year's ride file uses for (pickup time, longitude, latitude).
RIDE_FILE = "yellow_tripdata_{year}-{month:02d}{suffix}.csv"
WEATHER_FILE = "lga_{year}-{month:02d}.csv"
SAMPLE_SIZES = ("tiny", "small", "mid")
FIRST_YEAR, LAST_YEAR = 2009, 2017
LAYOUTS = {
    "2009": ("Trip_Pickup_DateTime", "Start_Lon", "Start_Lat"),
    "2010-2013": ("pickup_datetime", "pickup_longitude", "pickup_latitude"),
    "2014": (" pickup_datetime", " pickup_longitude", " pickup_latitude"),
    "2015-2016": ("tpep_pickup_datetime", "pickup_longitude", "pickup_latitude"),
}
WEATHER_COLUMNS = {"valid": "datetime", "tmpf": "fahrenheit", " p01i": "precip_in"}

# Fixed value: the year and month in a file name.
PERIOD_IN_NAME = r"(\d{4})-(\d{2})"


def ride_path(base: str, year: int, month: int, size: str = "full") -> str:
    """One month's rides; ``size`` names a sample file instead of the whole month."""
    if size != "full" and size not in SAMPLE_SIZES:
        raise ValueError(f"size={size} is not a supported value")
    suffix = "" if size == "full" else f"_{size}"
    return f"{base.rstrip('/')}/{RIDE_FILE.format(year=year, month=month, suffix=suffix)}"


def weather_path(base: str, year: int, month: int) -> str:
    return f"{base.rstrip('/')}/{WEATHER_FILE.format(year=year, month=month)}"


def period_of(path: str) -> tuple[int, int]:
    """(year, month) taken from the file name."""
    found = re.search(PERIOD_IN_NAME, path.rsplit("/", 1)[-1])
    if not found:
        raise ValueError(f"no yyyy-MM in file name: {path}")
    return check_period(int(found.group(1)), int(found.group(2)))


def check_period(year: int, month: int) -> tuple[int, int]:
    if not FIRST_YEAR <= year <= LAST_YEAR:
        raise ValueError(f"year {year} is outside {FIRST_YEAR}..{LAST_YEAR}")
    if not 1 <= month <= 12:
        raise ValueError(f"month {month} is outside 1..12")
    return year, month


def layout_of(year: int, month: int) -> str:
    check_period(year, month)
    if (year, month) >= (2016, 7):
        raise ValueError("ride files from 2016-07 on carry zone ids, not coordinates")
    for label in LAYOUTS:
        first, _, last = label.partition("-")
        if int(first) <= year <= int(last or first):
            return label
    raise ValueError(f"no layout for {year}")
