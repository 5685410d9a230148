"""Oracle SQL for the registered queries, written for a second engine."""

from __future__ import annotations

# Named steps shared by the queries. Each lists the steps it needs first.
_STEPS: dict[str, tuple[tuple[str, ...], str]] = {
    "rides": (
        (),
        """
        SELECT e.event_id * 1048576 + g.n AS ride_id, e.ts AS pickup_datetime,
               -74.08e0 + (e.user_id % 11) * 0.04e0 AS pickup_longitude,
               40.45e0 + (floor(e.user_id / 11) % 7) * 0.1e0 AS pickup_latitude
        FROM events e
        CROSS JOIN LATERAL (SELECT unnest(generate_series(1, greatest(1, CAST(1 + floor(e.value / 20) AS BIGINT)))) AS n) g""",
    ),
    "cells": (
        ("rides",),
        """
        SELECT *,
               CAST(trunc((pickup_longitude + 74.05e0) / ((74.05e0 - 73.7e0) / 30)) AS INTEGER) AS grid_x,
               CAST(trunc((41.0e0 - pickup_latitude) / ((41.0e0 - 40.5e0) / 55)) AS INTEGER) AS grid_y,
               date_trunc('hour', pickup_datetime) AS pickup_hour
        FROM rides
        WHERE pickup_latitude BETWEEN 40.5e0 AND 41.0e0 AND pickup_longitude BETWEEN -74.05e0 AND -73.7e0""",
    ),
    "counts": (
        ("cells",),
        """
        SELECT pickup_hour AS pickup_datetime, grid_x, grid_y, count(*) AS "count"
        FROM cells GROUP BY pickup_hour, grid_x, grid_y""",
    ),
    "scaled": (
        ("counts",),
        """
        SELECT *, CAST(isodow(pickup_datetime) - 1 AS INTEGER) AS weekday,
               CAST(hour(pickup_datetime) AS INTEGER) AS hour,
               "count" / (SELECT max("count") FROM counts) AS count_scaled
        FROM counts""",
    ),
    "cell_totals": (
        ("cells",),
        'SELECT grid_x, grid_y, count(*) AS "count" FROM cells GROUP BY grid_x, grid_y',
    ),
    "raw_metar": (
        (),
        """
        SELECT event_id,
               CASE WHEN event_id % 14 = 0 THEN date_trunc('hour', ts) + INTERVAL 51 MINUTE ELSE ts END AS valid,
               CASE WHEN event_id % 50 = 0 THEN 'M' ELSE CAST(user_id % 100 - 10 AS VARCHAR) END AS tmpf,
               CASE WHEN event_id % 40 = 0 THEN 'T'
                    ELSE concat('0.', lpad(CAST(event_id % 60 AS VARCHAR), 2, '0')) END AS p01i
        FROM events""",
    ),
    "precip": (
        ("raw_metar",),
        r"""
        SELECT date_trunc('hour', valid) AS datetime, TRY_CAST(p01i AS DOUBLE) AS precip_in
        FROM raw_metar
        WHERE minute(valid) = 51 AND regexp_full_match(p01i, '-?\d+(\.\d+)?')""",
    ),
    "nearest": (
        ("raw_metar",),
        r"""
        SELECT datetime, precip_in FROM (
          SELECT date_trunc('hour', valid) AS datetime, TRY_CAST(p01i AS DOUBLE) AS precip_in,
                 row_number() OVER (PARTITION BY date_trunc('hour', valid)
                                    ORDER BY abs(minute(valid) - 51), valid, TRY_CAST(p01i AS DOUBLE)) AS rn
          FROM raw_metar WHERE regexp_full_match(p01i, '-?\d+(\.\d+)?')
        ) WHERE rn = 1""",
    ),
    "temps": (
        ("raw_metar",),
        r"""
        SELECT date_trunc('hour', valid) AS datetime, avg(TRY_CAST(tmpf AS DOUBLE)) AS fahrenheit
        FROM raw_metar WHERE regexp_full_match(tmpf, '-?\d+(\.\d+)?') GROUP BY 1""",
    ),
    "weather": (
        ("precip", "temps"),
        "SELECT t.datetime, t.fahrenheit, p.precip_in FROM temps t JOIN precip p ON t.datetime = p.datetime",
    ),
    "weather_one": (
        ("nearest", "temps"),
        "SELECT t.datetime, t.fahrenheit, p.precip_in FROM temps t JOIN nearest p ON t.datetime = p.datetime",
    ),
    "joined": (
        ("scaled", "weather"),
        """
        SELECT s.*, w.fahrenheit, w.precip_in
        FROM scaled s JOIN weather w ON s.pickup_datetime = w.datetime""",
    ),
    # Equal weather rows of an hour are one row with their number.
    "folded": (
        ("weather",),
        "SELECT datetime, fahrenheit, precip_in, count(*) AS n_records FROM weather GROUP BY ALL",
    ),
    "features": (
        ("scaled", "folded"),
        """
        SELECT s.*, w.fahrenheit, w.precip_in, w.n_records
        FROM scaled s JOIN folded w ON s.pickup_datetime = w.datetime""",
    ),
    "early_features": (
        ("early", "folded"),
        "SELECT s.*, w.fahrenheit, w.precip_in, w.n_records FROM early s JOIN folded w ON s.pickup_datetime = w.datetime",
    ),
    "late_features": (
        ("late", "folded"),
        "SELECT s.*, w.fahrenheit, w.precip_in, w.n_records FROM late s JOIN folded w ON s.pickup_datetime = w.datetime",
    ),
    "own_by_half": (
        ("scaled",),
        """
        SELECT *, round(exact, 6) + 0.0 AS residual FROM (
          SELECT *, avg("count") OVER key AS pred, avg(count_scaled) OVER key AS pred_scaled, avg("count") OVER key - "count" AS exact
          FROM (
            SELECT * EXCLUDE (count_scaled), "count" / max("count") OVER (PARTITION BY period) AS count_scaled FROM (
              SELECT *, CAST(date_trunc('month', pickup_datetime) AS TIMESTAMP)
                + CASE WHEN day(pickup_datetime) < 16 THEN INTERVAL 0 DAY ELSE INTERVAL 15 DAY END AS period FROM scaled))
          WINDOW key AS (PARTITION BY period, grid_x, grid_y, weekday, hour))""",
    ),
    "model": (
        ("scaled",),
        """
        SELECT grid_x, grid_y, weekday, hour, avg("count") AS mean_count, avg(count_scaled) AS mean_count_scaled
        FROM scaled GROUP BY grid_x, grid_y, weekday, hour""",
    ),
    "own": (
        ("scaled", "model"),
        """
        SELECT s.*, round(m.mean_count, 6) + 0.0 AS pred, round(m.mean_count_scaled, 6) + 0.0 AS pred_scaled,
               round(m.mean_count - s."count", 6) + 0.0 AS residual
        FROM scaled s JOIN model m USING (grid_x, grid_y, weekday, hour)""",
    ),
    "own_weather": (
        ("scaled", "model", "weather"),
        """
        SELECT s.*, m.mean_count - s."count" AS residual, w.fahrenheit, w.precip_in
        FROM scaled s JOIN model m USING (grid_x, grid_y, weekday, hour)
        JOIN weather w ON s.pickup_datetime = w.datetime""",
    ),
    "own_weather_one": (
        ("scaled", "model", "weather_one"),
        """
        SELECT s.*, m.mean_count - s."count" AS residual, w.fahrenheit, w.precip_in
        FROM scaled s JOIN model m USING (grid_x, grid_y, weekday, hour)
        JOIN weather_one w ON s.pickup_datetime = w.datetime""",
    ),
    "early": (
        ("counts",),
        """
        SELECT *, CAST(isodow(pickup_datetime) - 1 AS INTEGER) AS weekday,
               CAST(hour(pickup_datetime) AS INTEGER) AS hour,
               "count" / max("count") OVER () AS count_scaled
        FROM counts WHERE pickup_datetime < TIMESTAMP '2024-01-15'""",
    ),
    "late": (
        ("counts",),
        """
        SELECT *, CAST(isodow(pickup_datetime) - 1 AS INTEGER) AS weekday,
               CAST(hour(pickup_datetime) AS INTEGER) AS hour,
               "count" / max("count") OVER () AS count_scaled
        FROM counts WHERE pickup_datetime >= TIMESTAMP '2024-01-15'""",
    ),
    "scored": (
        ("early", "late"),
        """
        SELECT l.*, coalesce(m.mean_count, 0.0) AS pred, coalesce(m.mean_scaled, 0.0) AS pred_scaled,
               coalesce(m.mean_count, 0.0) - l."count" AS residual
        FROM late l LEFT JOIN (
          SELECT grid_x, grid_y, weekday, hour, avg("count") AS mean_count, avg(count_scaled) AS mean_scaled
          FROM early GROUP BY grid_x, grid_y, weekday, hour
        ) m USING (grid_x, grid_y, weekday, hour)""",
    ),
    "rain_model": (
        ("early", "weather"),
        """
        SELECT grid_x, grid_y, weekday, hour, precip_in >= 0.3e0 AS heavy_rain,
               avg("count") AS mean_count, avg(count_scaled) AS mean_scaled
        FROM early JOIN weather ON pickup_datetime = datetime
        GROUP BY grid_x, grid_y, weekday, hour, precip_in >= 0.3e0""",
    ),
    "periods": (
        ("cells",),
        """
        SELECT date_trunc('week', pickup_datetime) AS period, grid_x, grid_y, count(*) AS "count"
        FROM cells GROUP BY 1, 2, 3""",
    ),
    "dense": (
        ("periods",),
        """
        SELECT CAST(p.period AS TIMESTAMP) AS period, CAST(x.v AS INTEGER) AS grid_x, CAST(y.v AS INTEGER) AS grid_y,
               coalesce(c."count", 0) AS "count"
        FROM (SELECT DISTINCT period FROM periods) p
        CROSS JOIN (SELECT unnest(generate_series(0, 29)) AS v) x
        CROSS JOIN (SELECT unnest(generate_series(0, 54)) AS v) y
        LEFT JOIN periods c ON c.period = p.period AND c.grid_x = x.v AND c.grid_y = y.v""",
    ),
    "distances": (
        ("dense",),
        """
        SELECT a.period AS period_a, b.period AS period_b, CAST(sum(abs(a."count" - b."count")) AS BIGINT) AS distance
        FROM dense a JOIN dense b ON a.grid_x = b.grid_x AND a.grid_y = b.grid_y
        GROUP BY 1, 2""",
    ),
    # Two-means of a few weeks by trying every bipartition: each subset that
    # holds the first week, its squared error, and the cheapest one.
    "week_no": (
        ("dense",),
        "SELECT period, row_number() OVER (ORDER BY period) - 1 AS i FROM (SELECT DISTINCT period FROM dense)",
    ),
    "sides": (
        ("week_no",),
        """
        SELECT b.mask, w.period, CAST((b.mask >> w.i) & 1 AS INTEGER) AS side
        FROM week_no w
        CROSS JOIN (SELECT unnest(generate_series(2, CAST(pow(2, (SELECT count(*) FROM week_no)) AS BIGINT) - 2, 2))
                    AS mask) b""",
    ),
    "centers": (
        ("sides", "dense"),
        """
        SELECT s.mask, s.side, d.grid_x, d.grid_y, avg(d."count") AS center
        FROM sides s JOIN dense d USING (period) GROUP BY 1, 2, 3, 4""",
    ),
    "member_cost": (
        ("centers",),
        """
        SELECT s.mask, s.side, s.period, sum((d."count" - c.center) * (d."count" - c.center)) AS cost
        FROM sides s JOIN dense d USING (period)
        JOIN centers c ON c.mask = s.mask AND c.side = s.side AND c.grid_x = d.grid_x AND c.grid_y = d.grid_y
        GROUP BY 1, 2, 3""",
    ),
    "best_mask": (
        ("member_cost",),
        "SELECT mask FROM member_cost GROUP BY mask ORDER BY sum(cost), mask LIMIT 1",
    ),
    "zip_places": (
        (),
        """
        SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS zip,
               40.5e0 + (c_custkey * 53 % 500) / 1000e0 AS lat,
               -74.05e0 + (c_custkey * 37 % 350) / 1000e0 AS lon
        FROM customer""",
    ),
    "zip_labels": (
        ("rides", "zip_places"),
        """
        SELECT pickup_latitude, pickup_longitude, zip FROM (
          SELECT s.*, z.zip,
                 row_number() OVER (PARTITION BY pickup_latitude, pickup_longitude ORDER BY z.km, z.zip) AS rn
          FROM (SELECT DISTINCT pickup_latitude, pickup_longitude FROM rides) s
          CROSS JOIN LATERAL (
            SELECT zip, round(12742.0e0 * asin(sqrt(least(1.0e0,
                pow(sin(radians(lat - pickup_latitude) / 2), 2)
                + cos(radians(pickup_latitude)) * cos(radians(lat))
                  * pow(sin(radians(lon - pickup_longitude) / 2), 2)))), 6) AS km
            FROM zip_places) z
          WHERE z.km <= 1.0
        ) WHERE rn = 1""",
    ),
    "zip_rides": (
        ("zip_labels",),
        """
        SELECT r.*, coalesce(l.zip, 'missing') AS zip
        FROM rides r LEFT JOIN zip_labels l USING (pickup_latitude, pickup_longitude)""",
    ),
    "zip_demand": (
        ("zip_rides", "weather"),
        """
        SELECT CAST(hour(r.pickup_datetime) AS INTEGER) AS hour,
               CAST(isodow(r.pickup_datetime) - 1 AS INTEGER) AS weekday, zip,
               CAST(CASE WHEN fahrenheit < 40 THEN 0 WHEN fahrenheit < 55 THEN 1 WHEN fahrenheit < 70 THEN 2
                         WHEN fahrenheit < 85 THEN 3 ELSE 4 END AS INTEGER) AS temperature,
               CAST(CASE WHEN precip_in < 0.1e0 THEN 0 WHEN precip_in < 0.3e0 THEN 1 ELSE 2 END AS INTEGER)
                 AS precipitation,
               count(*) AS "count"
        FROM zip_rides r JOIN weather w ON date_trunc('hour', r.pickup_datetime) = w.datetime
        WHERE zip <> 'missing' GROUP BY 1, 2, 3, 4, 5""",
    ),
}


def _with(query: str, *needs: str) -> str:
    ordered: list[str] = []

    def add(name: str) -> None:
        for before in _STEPS[name][0]:
            add(before)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        add(name)
    steps = ",\n".join(f"{name} AS ({_STEPS[name][1].strip()})" for name in ordered)
    return (f"WITH {steps}\n" if steps else "") + query.strip()


def _uniform(key: str, seed: int) -> str:
    return f"(CAST('0x' || substr(md5('{seed}|' || {key}), 1, 13) AS BIGINT) / 4503599627370496e0)"


def _cell_key() -> str:
    return "strftime(pickup_datetime, '%Y-%m-%d %H:%M:%S') || '|' || grid_x || '|' || grid_y"


def _edges(n: int, i: str) -> str:
    return f"round(lo + {i} * ((hi - lo) / {n}e0), 6) + 0.0"


def _bin(value: str, n: int, op: str) -> str:
    return " + ".join(f"CAST({value} {op} lo + {i}e0 * ((hi - lo) / {n}e0) AS INTEGER)" for i in range(1, n))


def _bin_means(value: str, n: int) -> str:
    return _with(
        f"""
        , ends AS (SELECT min({value}) AS lo, max({value}) AS hi FROM joined),
        means AS (SELECT {_bin(value, n, '>')} AS bin, avg("count") AS mean FROM joined, ends GROUP BY 1)
        SELECT CAST(b.bin AS INTEGER) AS bin, {_edges(n, 'b.bin')} AS bin_low, {_edges(n, '(b.bin + 1)')} AS bin_high,
               round(mean, 6) + 0.0 AS mean
        FROM ends CROSS JOIN (SELECT unnest(generate_series(0, {n - 1})) AS bin) b LEFT JOIN means USING (bin)
        """,
        "joined",
    )


def _histogram(source: str, value: str, n: int, where: str, *needs: str) -> str:
    return _with(
        f"""
        , vals AS (SELECT CAST({value} AS DOUBLE) AS v FROM {source} {where}),
        ends AS (SELECT min(v) AS lo, max(v) AS hi FROM vals),
        sizes AS (SELECT {_bin('v', n, '>=')} AS bin, count(*) AS n_rows FROM vals, ends GROUP BY 1)
        SELECT CAST(b.bin AS INTEGER) AS bin, {_edges(n, 'b.bin')} AS bin_low, {_edges(n, '(b.bin + 1)')} AS bin_high,
               coalesce(n_rows, 0) AS n_rows
        FROM ends CROSS JOIN (SELECT unnest(generate_series(0, {n - 1})) AS bin) b LEFT JOIN sizes USING (bin)
        """,
        *needs,
    )


def _stats(name: str, prefix: str) -> str:
    integer = name == '"count"'
    value = (lambda e: e) if integer else (lambda e: f"round({e}, 6) + 0.0")
    return f"""
        count({name}) AS {prefix}n, round(avg({name}), 6) + 0.0 AS {prefix}mean,
        round(stddev_samp({name}), 6) + 0.0 AS {prefix}std,
        {value(f'min({name})')} AS {prefix}min, {value(f'max({name})')} AS {prefix}max"""


def _quantiles(name: str, prefix: str, probs: tuple[int, ...] = (25, 50, 75)) -> str:
    return ",\n".join(
        f"round(quantile_cont(CAST({name} AS DOUBLE), {p / 100}), 6) + 0.0 AS {prefix}p{p}" for p in probs
    )


def _prediction_stats(source: str, *needs: str) -> str:
    return _with(
        f"""
        SELECT {_stats('"count"', 'count_')}, {_quantiles('"count"', 'count_')},
               round(sqrt(avg((count_scaled - pred_scaled) * (count_scaled - pred_scaled))), 6) + 0.0 AS rmse_scaled,
               round(sqrt(avg(residual * residual)), 6) + 0.0 AS rmse,
               round(1 - sum(residual * residual) / (var_pop("count") * count(*)), 6) + 0.0 AS r2,
               {_stats('residual', 'residual_')}, {_quantiles('residual', 'residual_')}
        FROM {source}""",
        *needs,
    )


def _pivot(rows: str, column: str, values: range, prefix: str, measure: str, source: str, as_count: bool = True) -> str:
    cols = ", ".join(
        f"CAST(coalesce(sum(CASE WHEN {column} = {v} THEN {measure} END), 0) AS BIGINT) AS {prefix}{v}" for v in values
    )
    return f"SELECT {rows}, {cols} FROM {source} GROUP BY {rows}"


def _sides(flags: dict[str, str]) -> str:
    parts = [
        f"SELECT '{name}' AS flag, {test} AS side, {_stats('residual', '')} FROM own_weather GROUP BY 2"
        for name, test in flags.items()
    ]
    return _with(" UNION ALL ".join(parts), "own_weather")


_OWN = """pickup_datetime, grid_x, grid_y, "count", round(count_scaled, 6) + 0.0 AS count_scaled,
          weekday, hour, pred, pred_scaled, residual"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}

    q["bbox_rides"] = _with(
        """SELECT ride_id, pickup_datetime, round(pickup_longitude, 6) + 0.0 AS pickup_longitude,
                  round(pickup_latitude, 6) + 0.0 AS pickup_latitude FROM cells""", "cells")
    q["grid_cells"] = _with(
        """SELECT ride_id, grid_x, grid_y, least(grid_x, 29) AS grid_x_clamped, least(grid_y, 54) AS grid_y_clamped
           FROM cells""", "cells")
    q["cell_ids"] = _with(
        """SELECT CAST(30 * trunc((41.0e0 - pickup_latitude) / ((41.0e0 - 40.5e0) / 55))
                  + trunc((pickup_longitude + 74.05e0) / ((74.05e0 - 73.7e0) / 30)) AS INTEGER) AS cell_id,
                  count(*) AS n_rides FROM rides GROUP BY 1""", "rides")
    q["cell_centers"] = _with(
        """SELECT cell_id, n_rides,
                  round(-74.05e0 + (cell_id % 30 + 0.5e0) * ((74.05e0 - 73.7e0) / 30), 6) AS center_lon,
                  round(41.0e0 - (floor(cell_id / 30) + 0.5e0) * ((41.0e0 - 40.5e0) / 55), 6) AS center_lat
           FROM (SELECT 30 * grid_y + grid_x AS cell_id, count(*) AS n_rides FROM cells GROUP BY 1)""", "cells")
    q["hour_parts"] = _with(
        """SELECT ride_id, pickup_hour, CAST(isodow(pickup_datetime) - 1 AS INTEGER) AS weekday,
                  CAST(hour(pickup_datetime) AS INTEGER) AS hour, CAST(minute(pickup_datetime) AS INTEGER) AS minute,
                  CAST(day(pickup_datetime) AS INTEGER) AS day FROM cells""", "cells")
    q["hour_keys"] = _with(
        """SELECT event_id, strftime(valid, '%Y-%m-%d-%H') AS hour_key, strftime(valid, '%m/%d') AS month_day,
                  strftime(valid, '%Y-%m-%d-%H') AS text_hour_key FROM raw_metar""", "raw_metar")
    q["parsed_values"] = _with(
        r"""SELECT event_id, date_trunc('minute', valid) AS datetime, TRY_CAST(tmpf AS DOUBLE) AS fahrenheit,
                   TRY_CAST(p01i AS DOUBLE) AS precip_in, regexp_matches(tmpf, '[0-9]') AS found_anywhere,
                   regexp_matches(tmpf, '^[0-9]') AS found_at_start,
                   CASE WHEN event_id % 3 = 0 THEN date_trunc('minute', valid) END AS lenient_datetime FROM raw_metar""", "raw_metar")
    q["period_labels"] = _with(
        """SELECT strftime(pickup_datetime, '%Y-%m') AS period, count(*) AS n_rides,
                  CAST(date_trunc('month', min(pickup_datetime)) AS DATE) AS period_start
           FROM cells GROUP BY 1""", "cells")

    q["clean_precip"] = _with("SELECT * FROM precip", "precip")
    q["clean_temperature"] = _with("SELECT datetime, round(fahrenheit, 6) AS fahrenheit FROM temps", "temps")
    q["hourly_weather"] = _with(
        "SELECT datetime, round(fahrenheit, 6) AS fahrenheit, precip_in FROM weather", "weather")
    q["hourly_weather_dedup"] = _with(
        "SELECT datetime, round(fahrenheit, 6) AS fahrenheit, precip_in FROM weather_one", "weather_one")
    q["weather_outer"] = _with(
        """SELECT coalesce(t.datetime, p.datetime) AS datetime, round(fahrenheit, 6) AS fahrenheit, precip_in
           FROM temps t FULL JOIN precip p ON t.datetime = p.datetime""", "temps", "precip")
    q["weather_records"] = _with(
        """SELECT datetime, round(fahrenheit, 6) AS fahrenheit, precip_in, count(*) AS n_records
           FROM weather GROUP BY ALL""", "weather")
    q["weather_nulls"] = _with(
        """SELECT count(*) AS n_rows, count(*) - count(fahrenheit) AS null_fahrenheit,
                  count(*) - count(precip_in) AS null_precip_in
           FROM temps t FULL JOIN precip p ON t.datetime = p.datetime""", "temps", "precip")
    q["weather_completeness"] = _with(
        """SELECT strftime(valid, '%m/%d') AS month_day, count(*) AS n_records,
                  count(*) FILTER (WHERE minute(valid) = 51) AS n_routine FROM raw_metar GROUP BY 1""", "raw_metar")
    q["weather_gaps"] = _with(
        """SELECT hour + INTERVAL 1 HOUR AS first_hour, next - INTERVAL 1 HOUR AS last_hour, date_diff('hour', hour, next) - 1 AS n_hours
           FROM (SELECT hour, lead(hour) OVER (ORDER BY hour) AS next FROM (SELECT DISTINCT datetime AS hour FROM precip))
           WHERE next > hour + INTERVAL 1 HOUR""", "precip")
    q["rides_nearest_weather"] = _with(
        r"""SELECT ride_id, pickup_datetime, datetime, fahrenheit, precip_in FROM rides LEFT JOIN (
              SELECT t, datetime, fahrenheit, precip_in FROM (SELECT DISTINCT pickup_datetime AS t FROM rides) JOIN (
                SELECT valid AS datetime, TRY_CAST(tmpf AS DOUBLE) AS fahrenheit, TRY_CAST(p01i AS DOUBLE) AS precip_in FROM raw_metar
                WHERE regexp_full_match(tmpf, '-?\d+(\.\d+)?') AND regexp_full_match(p01i, '-?\d+(\.\d+)?'))
              ON datetime BETWEEN t - INTERVAL 10 MINUTE AND t + INTERVAL 10 MINUTE
              QUALIFY row_number() OVER (PARTITION BY t ORDER BY abs(epoch_us(datetime) - epoch_us(t)), datetime, fahrenheit, precip_in) = 1)
            ON t = pickup_datetime""", "rides", "raw_metar")
    q["weather_day_filters"] = _with(
        "SELECT event_id, valid AS datetime, tmpf, p01i FROM raw_metar WHERE day(valid) IN (2, 5, 6, 31)", "raw_metar")
    q["precip_histogram"] = _histogram("precip", "precip_in", 10, "WHERE precip_in < 1", "precip")
    q["weather_buckets"] = _with(
        """SELECT CAST(CASE WHEN fahrenheit < 40 THEN 0 WHEN fahrenheit < 55 THEN 1 WHEN fahrenheit < 70 THEN 2
                            WHEN fahrenheit < 85 THEN 3 ELSE 4 END AS INTEGER) AS temperature,
                  CAST(CASE WHEN precip_in < 0.1e0 THEN 0 WHEN precip_in < 0.3e0 THEN 1 ELSE 2 END AS INTEGER)
                    AS precipitation, count(*) AS n_records FROM weather GROUP BY 1, 2""", "weather")

    q["cell_hour_counts"] = _with("SELECT * FROM counts", "counts")
    q["cell_counts"] = _with("SELECT * FROM cell_totals", "cell_totals")
    q["scaled_counts_global"] = _with(
        """SELECT pickup_datetime, grid_x, grid_y, "count",
                  round("count" / (SELECT max("count") FROM counts), 6) AS count_scaled FROM counts""", "counts")
    q["scaled_counts_by_period"] = _with(
        """SELECT *, round("count" / max("count") OVER (PARTITION BY period), 6) AS count_scaled FROM (
             SELECT *, CAST(date_trunc('week', pickup_datetime) AS TIMESTAMP) AS period FROM counts)""", "counts")
    q["union_periods"] = _with(
        """SELECT pickup_datetime, grid_x, grid_y, "count", round(count_scaled, 6) AS count_scaled, 'early' AS span
           FROM early UNION ALL
           SELECT pickup_datetime, grid_x, grid_y, "count", round(count_scaled, 6), 'late' FROM late""",
        "early", "late")
    q["busiest_groups"] = _with(
        'SELECT * FROM counts ORDER BY "count" DESC, pickup_datetime, grid_x, grid_y LIMIT 20', "counts")
    q["preview_rows"] = _with("SELECT * FROM counts ORDER BY pickup_datetime, grid_x, grid_y LIMIT 10", "counts")
    q["count_describe"] = _with(
        f"""SELECT {_stats('"count"', '')}, {_quantiles('"count"', '')} FROM counts""", "counts")
    q["count_quantiles"] = _with(
        f"""SELECT {_stats('"count"', '')}, {_quantiles('"count"', '', (50, 75, 90, 95, 99))} FROM cell_totals""",
        "cell_totals")
    q["top_quantile_cells"] = _with(
        """SELECT * FROM cell_totals
           WHERE "count" >= (SELECT quantile_cont(CAST("count" AS DOUBLE), 0.95) FROM cell_totals)""", "cell_totals")
    q["mean_hourly_max"] = _with(
        """SELECT round(avg(peak), 6) AS mean_hourly_max FROM (
             SELECT max("count") AS peak FROM counts WHERE pickup_datetime >= TIMESTAMP '2024-01-02'
             GROUP BY pickup_datetime)""", "counts")
    q["demand_heatmap"] = _with(_pivot("grid_y", "grid_x", range(31), "x", '"count"', "cell_totals"), "cell_totals")
    q["high_demand_heatmap"] = _with(
        _pivot("grid_y", "grid_x", range(2, 10), "x", '"count"',
               "(SELECT * FROM cell_totals WHERE grid_x > 1 AND grid_x < 10 AND grid_y > 19 AND grid_y < 33)"),
        "cell_totals")
    q["dense_grid"] = _with("SELECT * FROM dense", "dense")

    q["rides_weather"] = _with(
        """SELECT pickup_datetime, grid_x, grid_y, "count", round(count_scaled, 6) AS count_scaled,
                  round(fahrenheit, 6) AS fahrenheit, precip_in, n_records, weekday, hour FROM features""", "features")
    q["rides_weather_left"] = _with(
        """SELECT pickup_datetime, grid_x, grid_y, "count", round(fahrenheit, 6) AS fahrenheit, precip_in,
                  CAST(isodow(pickup_datetime) - 1 AS INTEGER) AS weekday, CAST(hour(pickup_datetime) AS INTEGER) AS hour
           FROM counts LEFT JOIN weather_one ON pickup_datetime = datetime""", "counts", "weather_one")
    q["rides_without_weather"] = _with(
        """SELECT ride_id, pickup_datetime FROM cells
           WHERE pickup_hour NOT IN (SELECT datetime FROM weather)""", "cells", "weather")
    q["weather_join_audit"] = _with(
        """SELECT CAST(sum("count") AS BIGINT) AS rides, CAST(coalesce(sum("count") FILTER (WHERE k), 0) AS BIGINT) AS rides_kept,
                  CAST(sum("count") - coalesce(sum("count") FILTER (WHERE k), 0) AS BIGINT) AS rides_dropped,
                  count(*) AS cell_hours, count(*) FILTER (WHERE k) AS cell_hours_kept,
                  count(*) FILTER (WHERE NOT k) AS cell_hours_dropped
           FROM (SELECT *, pickup_datetime IN (SELECT datetime FROM weather) AS k FROM counts)""", "counts", "weather")

    for key in ("weekday", "hour"):
        q[f"demand_by_{key}"] = _with(
            f'SELECT {key}, CAST(sum("count") AS BIGINT) AS demand FROM joined GROUP BY {key}', "joined")
    q["demand_weekday_hour"] = _with(_pivot("weekday", "hour", range(24), "h", '"count"', "joined"), "joined")
    q["demand_by_temp_bin"] = _bin_means("fahrenheit", 4)
    q["demand_by_precip_bin"] = _bin_means("precip_in", 3)

    q["baseline_model"] = _with(
        """SELECT grid_x, grid_y, weekday, hour, round(mean_count, 6) AS mean_count,
                  round(mean_count_scaled, 6) AS mean_count_scaled FROM model""", "model")
    q["baseline_predict"] = _with(
        """SELECT pickup_datetime, grid_x, grid_y, "count", round(count_scaled, 6) AS count_scaled, weekday, hour,
                  round(pred, 6) AS pred, round(pred_scaled, 6) AS pred_scaled, round(residual, 6) + 0.0 AS residual
           FROM scored""", "scored")
    q["adjusted_model"] = _with(
        """SELECT grid_x, grid_y, weekday, hour, precip_in >= 0.3e0 AS heavy_rain,
                  round(avg("count"), 6) AS mean_count, round(avg(count_scaled), 6) AS mean_count_scaled
           FROM joined GROUP BY ALL""", "joined")
    adjusted = """
        SELECT l.*, w.fahrenheit, w.precip_in, {n} w.precip_in >= 0.3e0 AS heavy_rain,
               coalesce(m.mean_count, 0.0) AS pred, coalesce(m.mean_scaled, 0.0) AS pred_scaled,
               coalesce(m.mean_count, 0.0) - l."count" AS residual
        FROM late l JOIN {weather} w ON l.pickup_datetime = w.datetime
        LEFT JOIN rain_model m ON m.grid_x = l.grid_x AND m.grid_y = l.grid_y AND m.weekday = l.weekday
             AND m.hour = l.hour AND m.heavy_rain = (w.precip_in >= 0.3e0)"""
    q["adjusted_predict"] = _with(
        f"""SELECT pickup_datetime, grid_x, grid_y, "count", round(count_scaled, 6) AS count_scaled, weekday, hour,
                   round(fahrenheit, 6) AS fahrenheit, precip_in, n_records, heavy_rain, round(pred, 6) AS pred,
                   round(pred_scaled, 6) AS pred_scaled, round(residual, 6) + 0.0 AS residual
            FROM ({adjusted.format(weather='folded', n='w.n_records,')})""", "late", "rain_model", "folded")
    q["adjusted_fit_transform"] = _with(
        """, rain AS (SELECT *, precip_in >= 0.3e0 AS heavy_rain FROM features),
           means AS (
             SELECT grid_x, grid_y, weekday, hour, heavy_rain, sum("count" * n_records) / sum(n_records) AS mean_count,
                    sum(count_scaled * n_records) / sum(n_records) AS mean_scaled FROM rain GROUP BY ALL)
           SELECT pickup_datetime, grid_x, grid_y, "count", round(count_scaled, 6) AS count_scaled, weekday, hour,
                  round(fahrenheit, 6) AS fahrenheit, precip_in, n_records, heavy_rain, round(mean_count, 6) AS pred,
                  round(mean_scaled, 6) AS pred_scaled, round(mean_count - "count", 6) + 0.0 AS residual
           FROM rain JOIN means USING (grid_x, grid_y, weekday, hour, heavy_rain)""", "features")
    q["prediction_stats"] = _prediction_stats("scored", "scored")
    q["adjusted_stats"] = _prediction_stats(
        f"({adjusted.format(weather='weather_one', n='')})", "late", "rain_model", "weather_one")
    q["scaling_check"] = _with(
        """SELECT round(max(abs((SELECT max("count") FROM counts) * m.mean_count_scaled - m.mean_count)), 6) + 0.0
                    AS max_abs_difference,
                  round(sqrt(avg(pow(count_scaled - m.mean_count_scaled, 2))) * (SELECT max("count") FROM counts), 6) + 0.0
                    AS rmse_rescaled,
                  round(sqrt(avg(pow(s."count" - m.mean_count, 2))), 6) + 0.0 AS rmse
           FROM scaled s JOIN model m USING (grid_x, grid_y, weekday, hour)""", "scaled", "model")
    q["error_summary"] = _with(
        """SELECT count(*) AS n_rows, max("count") AS max_count, round(sum(residual * residual), 6) + 0.0 AS sse,
                  round(avg(-residual), 6) + 0.0 AS mean_error, round(avg(abs(residual)), 6) + 0.0 AS mean_abs_error,
                  round(stddev_samp(-residual), 6) + 0.0 AS std_error FROM scored""", "scored")

    q["underestimated"] = _with(f'SELECT {_OWN} FROM own WHERE residual < -0.5 * "count"', "own")
    q["overestimated"] = _with(f'SELECT {_OWN} FROM own WHERE "count" < 20 AND residual > 2', "own")
    q["well_estimated"] = _with(f"SELECT {_OWN} FROM own WHERE abs(residual) <= 1", "own")
    q["large_residual"] = _with(f"SELECT {_OWN} FROM own WHERE residual > 2", "own")
    q["value_cutoffs"] = _with(
        f"""SELECT {_OWN}, "count" < 5 AND residual < 0 AS quiet_low FROM own
            WHERE ("count" < 5 AND residual < 0) OR "count" > 20""", "own")
    over = '(SELECT * FROM own WHERE "count" < 20 AND residual > 2)'
    q["residual_weekday_hour"] = _with(_pivot("hour", "weekday", range(7), "weekday_", "1", over), "own")
    over = '(SELECT * FROM own_by_half WHERE "count" < 20 AND residual > 2)'
    under = '(SELECT * FROM own_by_half WHERE residual < -0.25 * "count")'
    rows = """SELECT pickup_datetime, period, grid_x, grid_y, "count", round(count_scaled, 6) + 0.0 AS count_scaled, weekday, hour,
                     round(pred, 6) + 0.0 AS pred, round(pred_scaled, 6) + 0.0 AS pred_scaled, residual FROM """
    for name, source in (("over", over), ("under", under)):
        q[f"{name}_study_by_period"] = _with(
            _pivot("period, hour", "weekday", range(7), "weekday_", "1", source), "own_by_half")
        q[f"{name}_study_cells"] = _with(
            f"SELECT period, grid_x, grid_y, count(*) AS n_rows FROM {source} GROUP BY 1, 2, 3", "own_by_half")
        q[f"{name}_study_rows"] = _with(rows + source, "own_by_half")
        panels = [
            f"SELECT period, '{axis}' AS axis, CAST({at} AS VARCHAR) AS at, count(*) AS n_rows FROM {source} GROUP BY 1, 3"
            for axis, at in (("date", "CAST(pickup_datetime AS DATE)"), ("hour", "hour"), ("weekday", "weekday"))
        ]
        q[f"{name}_histograms"] = _with(" UNION ALL ".join(panels), "own_by_half")
    q["residual_histogram"] = _histogram("own", "hour", 10, 'WHERE "count" < 20 AND residual > 2', "own")

    feature = """SELECT '{name}' AS feature, CAST({at} AS DOUBLE) AS at, count(*) AS n,
                        round(avg(residual), 6) + 0.0 AS mean_residual, round(avg(abs(residual)), 6) + 0.0 AS mean_abs
                 FROM own_weather_one {more} GROUP BY 2"""
    parts = [feature.format(name=n, at=c, more="") for n, c in
             (("count", '"count"'), ("weekday", "weekday"), ("hour", "hour"))]
    for name in ("fahrenheit", "precip_in"):
        ends = f", (SELECT min({name}) AS lo, max({name}) AS hi FROM own_weather_one) ends"
        parts.append(feature.format(name=name, at=_bin(name, 10, ">"), more=ends))
    q["residual_by_feature"] = _with(" UNION ALL ".join(parts), "own_weather_one")
    q["residual_by_rain"] = _sides(
        {"heavy_rain": "precip_in >= 0.3e0", "moderate_rain": "precip_in >= 0.1e0 AND precip_in < 0.3e0"})
    q["residual_by_temperature"] = _sides({"cold": "fahrenheit < 20", "hot": "fahrenheit > 50"})
    q["residual_by_area"] = _with(
        f""", areas AS (
              SELECT *, avg("count") OVER (PARTITION BY period, high_demand, grid_x, grid_y, weekday, hour) - "count" AS area_residual
              FROM (SELECT *, grid_x BETWEEN 3 AND 8 AND grid_y BETWEEN 21 AND 32 AS high_demand FROM own_by_half))
            SELECT period, high_demand, {_stats('area_residual', '')}, {_quantiles('area_residual', '')}
            FROM areas GROUP BY 1, 2""", "own_by_half")

    q["period_distance"] = _with("SELECT * FROM distances", "distances")
    q["period_total_distance"] = _with(
        "SELECT period_a AS period, CAST(sum(distance) AS BIGINT) AS total_distance FROM distances GROUP BY 1", "distances")
    q["counts_diff"] = _with(
        """SELECT a.grid_x, a.grid_y, abs(a."count" - b."count") AS diff
           FROM dense a JOIN dense b ON a.grid_x = b.grid_x AND a.grid_y = b.grid_y
           WHERE a.period = TIMESTAMP '2024-01-01' AND b.period = TIMESTAMP '2024-01-22'""", "dense")
    q["kmeans_periods"] = _with(
        "SELECT period, side AS cluster FROM sides WHERE mask = (SELECT mask FROM best_mask)", "best_mask")
    q["dist_to_center"] = _with(
        """SELECT period, round(sqrt(cost), 6) AS dist_to_center FROM member_cost
           WHERE mask = (SELECT mask FROM best_mask)""", "best_mask")

    q["zip_rides"] = _with("SELECT ride_id, pickup_datetime, zip FROM zip_rides WHERE zip <> 'missing'", "zip_rides")
    q["zip_missing"] = _with(
        """SELECT count(*) AS n_rides, count(*) FILTER (WHERE zip = 'missing') AS n_missing,
                  count(*) FILTER (WHERE zip = 'missing' AND pickup_latitude <> 0) AS n_unexplained
           FROM zip_rides""", "zip_rides")
    q["zip_demand"] = _with("SELECT * FROM zip_demand", "zip_demand")
    q["zip_busiest"] = _with(
        """SELECT * FROM zip_demand
           ORDER BY "count" DESC, hour, weekday, zip, temperature, precipitation LIMIT 20""", "zip_demand")

    q["sample_n"] = _with(
        f"""SELECT ride_id, CAST(period AS TIMESTAMP) AS period FROM (
              SELECT ride_id, date_trunc('week', pickup_datetime) AS period,
                     row_number() OVER (PARTITION BY date_trunc('week', pickup_datetime)
                                        ORDER BY {_uniform('ride_id', 7)}, ride_id) AS rn FROM rides)
            WHERE rn <= 500""", "rides")
    q["mask_split"] = _with(
        f"""SELECT *, CASE WHEN {_uniform(_cell_key(), 1)} < 0.5 THEN 'train' ELSE 'test' END AS split
            FROM counts""", "counts")
    u = _uniform(_cell_key(), 3)
    q["weighted_split"] = _with(
        f"""SELECT *, CASE WHEN {u} < 0.8e0 THEN 'train' WHEN {u} < 0.8e0 + 0.1e0 THEN 'dev' ELSE 'test' END AS split
            FROM counts""", "counts")
    q["fixed_split"] = _with(
        f"""SELECT * EXCLUDE (rn), CASE WHEN rn <= 200 THEN 'test' WHEN rn <= 300 THEN 'dev' ELSE 'train' END AS split
            FROM (SELECT *, row_number() OVER (ORDER BY {_uniform(_cell_key(), 2)}, pickup_datetime, grid_x, grid_y) AS rn
                  FROM counts)""", "counts")
    # What any sound fit must show: the splits are known, the trees are not.
    key = f"{_cell_key()} || '|' || precip_in"
    u = _uniform(key, 1)
    third = 1 / 3
    for kind in ("1", "2", "3"):
        q[f"rf_type{kind}"] = _with(
            f""", parts AS (
                  SELECT CASE WHEN {u} < {third!r}e0 THEN 'train' WHEN {u} < {third + third!r}e0 THEN 'dev' ELSE 'test' END AS split,
                         CAST(floor({_uniform(key, 1001)} * 2) AS INTEGER) AS fold FROM features)
                SELECT 5::INTEGER AS num_trees, 10::INTEGER AS max_depth, CAST(m.v AS INTEGER) AS min_instances, true AS scored,
                       '{kind}' AS model_type, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'dev') AS n_dev,
                       count(*) FILTER (split = 'train' AND fold = 0) AS n_fold0, count(*) FILTER (split = 'train' AND fold = 1) AS n_fold1,
                       count(*) FILTER (split = 'test') AS n_test, count(*) FILTER (split <> 'train') AS n_predicted,
                       true AS within_range, true AS beats_mean, true AS errors_known
                FROM parts, (SELECT unnest([1, 5]) AS v) m GROUP BY m.v""", "features")
    q["rf_single_fit"] = _with(
        f"""SELECT CASE WHEN {u} < 0.5 THEN 'train' ELSE 'test' END AS split, count(*) AS n_predicted,
                   CAST(sum(n_records) AS BIGINT) AS n_records, true AS has_error, true AS beats_mean
            FROM features GROUP BY 1""", "features")
    q["rf_period_split"] = _with(
        f""", parts AS (SELECT *, CASE WHEN {u} < 0.5 THEN 'dev' ELSE 'test' END AS split FROM late_features)
            SELECT (SELECT count(*) FROM early_features) AS n_train, count(*) FILTER (split = 'dev') AS n_dev,
                   count(*) FILTER (split = 'test') AS n_test, count(*) AS n_predicted, true AS within_range, true AS errors_known,
                   CAST(sum(n_records) FILTER (split = 'test') AS BIGINT) AS n_records,
                   round(max(count_scaled) FILTER (split = 'test'), 6) + 0.0 AS max_count FROM parts""", "early_features", "late_features")
    q["rf_reload_score"] = _with(
        """SELECT pickup_datetime, grid_x, grid_y, round(fahrenheit, 6) + 0.0 AS fahrenheit, precip_in, weekday, hour,
                  round(count_scaled, 6) + 0.0 AS count_scaled, true AS same_prediction, true AS residual_fits
           FROM late_features""", "late_features")
    return q
