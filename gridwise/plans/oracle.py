"""The registered queries in plain SQL for DuckDB, written from the definitions and not from the Spark plans."""

from __future__ import annotations

import math

LAGS = (1, 2, 3, 6, 12, 24)
LAGGED = ("GHI", "DNI", "DHI", "T_amb")
BASE = ("DNI", "DHI", "T_amb", "RH", "WS", "WS_gust", "WD", "WD_std", "BP")
W = "PARTITION BY site_id ORDER BY ts"
STAMP = "'%Y-%m-%d %H:%M'"


def r6(expr: str) -> str:
    return f"(round(CAST({expr} AS DOUBLE) + 1e-9, 6) + 0e0)"


def named(columns: dict[str, str]) -> str:
    return ", ".join(f'{expr} AS "{name}"' for name, expr in columns.items())


def rounded(columns: dict[str, str]) -> str:
    return named({name: r6(expr) for name, expr in columns.items()})


READINGS = """readings AS (
  SELECT user_id AS site_id, ts, value * 5e0 AS "GHI", value * 3.5e0 AS "DNI",
    CASE WHEN event_type = 'error' THEN 0e0 ELSE value * 1.25e0 END AS "DHI",
    CAST(15 + event_id % 20 AS DOUBLE) AS "T_amb", CAST(30 + event_id % 60 AS DOUBLE) AS "RH",
    CAST(1 + event_id % 7 AS DOUBLE) AS "WS", CAST(1 + event_id % 7 AS DOUBLE) * 1.5e0 AS "WS_gust",
    CAST(event_id % 360 AS DOUBLE) AS "WD", CAST(10 + event_id % 10 AS DOUBLE) AS "WD_std",
    CAST(1000 + event_id % 25 AS DOUBLE) AS "BP"
  FROM events)"""
HOUSES = "raw AS (SELECT user_id AS site_id, ts, value / 25e0 AS kw FROM events)"
FEEDERS = "raw AS (SELECT user_id % 10 AS site_id, ts, value / 25e0 AS kw FROM events)"
BOTH = """raw AS (SELECT user_id AS site_id, ts, value / 25e0 AS kw FROM events
  UNION ALL SELECT -1 - user_id % 10, ts, value / 25e0 FROM events)"""
PANELS = """panels AS (
  SELECT c_custkey AS site_id, CAST(c_nationkey + 5 AS DOUBLE) AS area,
    CASE WHEN c_mktsegment <> 'MACHINERY' THEN (15e0 + c_custkey % 10) / 100e0 END AS eff
  FROM customer WHERE c_mktsegment <> 'FURNITURE')"""


def elevation(hour: str) -> str:
    return f"greatest(90e0 - abs({hour} - 12) * 7.5e0, 0e0)"


def calendar() -> dict[str, str]:
    return {
        "hour": "CAST(hour(ts) AS INTEGER)",
        "month": "CAST(month(ts) AS INTEGER)",
        "dayofyear": "CAST(dayofyear(ts) AS INTEGER)",
        "dayofweek": "CAST(isodow(ts) - 1 AS INTEGER)",
    }


def waves() -> dict[str, str]:
    parts = {"hour": ("hour(ts)", 24), "month": ("month(ts)", 12), "dayofyear": ("dayofyear(ts)", 365),
             "dayofweek": ("(isodow(ts) - 1)", 7)}
    return {
        f"{name}_{fn}": f"{fn}({part} * {2 * math.pi!r}e0 / {period}e0)"
        for name, (part, period) in parts.items()
        for fn in ("sin", "cos")
    }


def ratios() -> dict[str, str]:
    up = elevation("hour(ts)")
    return {
        "clear_sky_index": f'CASE WHEN {up} > 0 THEN "GHI" / ({up} * 10e0 + 1e0) ELSE 0e0 END',
        "DNI_DHI_ratio": 'CASE WHEN "DHI" > 0 THEN "DNI" / "DHI" ELSE 0e0 END',
        "temp_humidity": '"T_amb" * "RH"',
        "wind_pressure": '"WS" * "BP"',
    }


def lags() -> dict[str, str]:
    out = {f"{c}_lag_{k}": f'lag("{c}", {k}) OVER ({W})' for k in LAGS for c in LAGGED}
    return {**out, **{f"GHI_diff_{k}": f'"GHI" - lag("GHI", {k}) OVER ({W})' for k in (1, 3, 6)}}


def rolling() -> dict[str, str]:
    out = {}
    for k in (3, 6, 12, 24):
        over = f"OVER ({W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
        out[f"GHI_rolling_mean_{k}"] = f'avg("GHI") {over}'
        out[f"GHI_rolling_std_{k}"] = f'coalesce(stddev_samp("GHI") {over}, 0e0)'
        out[f"GHI_rolling_min_{k}"] = f'min("GHI") {over}'
        out[f"GHI_rolling_max_{k}"] = f'max("GHI") {over}'
    return out


def ewm() -> dict[str, str]:
    past = f'list("GHI") OVER ({W} ROWS BETWEEN 256 PRECEDING AND CURRENT ROW)'
    return {
        f"GHI_ema_{span}": f"list_reduce({past}, lambda y, x: x * {2 / (span + 1)!r}e0 + y * {1 - 2 / (span + 1)!r}e0)"
        for span in (3, 6, 12)
    }


def modes() -> dict[str, str]:
    def mode(i: int) -> str:
        half = 2 ** i // 2
        return f'avg("GHI") OVER ({W} ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)'

    out = {f"VMD_mode_{i}": mode(i) for i in range(1, 8)}
    return {**out, "VMD_high_freq": f"{mode(1)} + {mode(2)}", "VMD_low_freq": f"{mode(6)} + {mode(7)}"}


def feature_exprs() -> dict[str, str]:
    """The 77 features in training order."""
    lagged = lags()
    return {
        **{c: f'"{c}"' for c in BASE},
        **waves(),
        "solar_elevation": elevation("hour(ts)"),
        **ratios(),
        **lagged,
        **rolling(),
        **ewm(),
        **modes(),
    }


def features_cte() -> str:
    return f"""{READINGS}, features AS (
  SELECT site_id, ts, "GHI", {named(feature_exprs() | {})}, row_number() OVER ({W}) AS n FROM readings)"""


# Spans, gaps and the two rules, on `raw`.
RULE = f"""gaps AS (
  SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER ({W}))) / 1e6 AS gap FROM raw),
rule AS (
  SELECT site_id, n, hours, a AS rule_a, CASE WHEN NOT a THEN med END AS med, NOT a AND coalesce(med < 2700, FALSE) AS rule_b
  FROM (SELECT site_id, n, hours, n > 24 AND hours > 0 AND n > 1.5e0 * hours AS a, med
    FROM (SELECT site_id, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 36e8 AS hours, median(gap) AS med
      FROM gaps GROUP BY site_id)))"""

# Hourly means on a full spine, filled, from a relation (site_id, ts, kw).
def hourly(source: str, name: str) -> str:
    return f"""{name}_mean AS (
  SELECT site_id, date_trunc('hour', ts) AS h, avg(kw) AS kw FROM {source} GROUP BY ALL),
{name}_spine AS (
  SELECT site_id, unnest(generate_series(min(h), max(h), INTERVAL 1 HOUR)) AS h FROM {name}_mean GROUP BY site_id),
{name} AS (
  SELECT site_id, h AS ts, last_value(kw IGNORE NULLS) OVER (
    PARTITION BY site_id ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS kw
  FROM {name}_spine LEFT JOIN {name}_mean USING (site_id, h))"""


# Needs `raw`; gives `series` after the rule.
SERIES = f"""{RULE},
dense AS (SELECT raw.* FROM raw JOIN rule USING (site_id) WHERE rule_a OR rule_b),
{hourly("dense", "resampled")},
series AS (
  SELECT site_id, ts, kw FROM resampled
  UNION ALL SELECT raw.site_id, ts, kw FROM raw JOIN rule USING (site_id) WHERE NOT (rule_a OR rule_b))"""


def history(all_rows: str, last: int | None = None) -> str:
    """`all_rows` (an `everything` relation) cut to accepted sites, and to their last rows if asked, then resampled."""
    cut = f" AND back <= {last}" if last else ""
    return f"""{all_rows.replace("raw AS", "everything AS", 1)},
raw AS (
  SELECT site_id, ts, kw FROM (
    SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY ts DESC) AS back, count(*) OVER (PARTITION BY site_id) AS n
    FROM everything) WHERE n >= 24{cut}),
{SERIES}"""


PROFILE = """last_seen AS (SELECT site_id, max(ts) AS last_ts FROM series GROUP BY site_id),
means AS (SELECT site_id, hour(ts) AS hour, avg(kw) AS kw FROM series GROUP BY ALL),
profile AS (
  SELECT site_id, last_ts, h.hour, greatest(coalesce(kw, 0.1e0), 0.01e0) AS kw
  FROM last_seen CROSS JOIN (SELECT unnest(range(24)) AS hour) h LEFT JOIN means USING (site_id, hour))"""
FORECAST = f"""{PROFILE},
con AS (
  SELECT site_id, CAST(step AS INTEGER) AS step, last_ts + to_hours(CAST(step AS INTEGER)) AS ts,
    round(kw + 1e-9, 4) AS kwh
  FROM profile JOIN (SELECT unnest(range(1, 25)) AS step) s
    ON profile.hour = (hour(last_ts) + step) % 24)"""
CON = f"{history(HOUSES)}, {FORECAST}"

PREDICTED = f"""last_reading AS (
  SELECT site_id, max(ts) AS ts, arg_max("GHI", ts) AS ghi FROM readings GROUP BY site_id),
predicted AS (
  SELECT site_id, step, ts + to_hours(step) AS ts,
    CASE WHEN {elevation("hour(ts)")} > 0 THEN ghi / ({elevation("hour(ts)")} * 10e0 + 1e0) ELSE 0e0 END
      * ({elevation("hour(ts + to_hours(step))")} * 10e0 + 1e0) * exp(step * -0.05e0) AS ghi
  FROM last_reading CROSS JOIN (SELECT CAST(unnest(range(1, 4)) AS INTEGER) AS step) s)"""
CATEGORY = """CASE WHEN ghi < 100 THEN 'Low ☁️' WHEN ghi < 400 THEN 'Moderate 🌤️' WHEN ghi < 700 THEN 'High 🌥️'
  ELSE 'Excellent ☀️' END"""


def solar_cte(owners_only: bool) -> str:
    join = "JOIN" if owners_only else "LEFT JOIN"
    return f"""{READINGS}, {PANELS}, {PREDICTED},
sol AS (
  SELECT predicted.site_id, step, ts, round(ghi + 1e-9, 2) AS ghi_wm2,
    round(ghi * coalesce(area, 10e0) * coalesce(eff, 0.2e0) / 1000e0 + 1e-9, 4) AS energy_kwh, {CATEGORY} AS category
  FROM predicted {join} panels USING (site_id))"""


SOL = solar_cte(owners_only=True)

CONDITIONS = """conditions AS (
  SELECT user_id AS site_id, ts, hour(ts) AS hour, isodow(ts) - 1 AS dow, month(ts) AS month, value % 40e0 AS temperature,
    CASE WHEN event_type <> 'error' THEN value % 19e0 + 1e0 END AS hist_avg, (event_id % 11) / 10e0 AS demand
  FROM events),
tin AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY ts DESC) AS back FROM conditions)
  WHERE back = 1 AND hist_avg IS NOT NULL)"""
SCORES = f"""{CONDITIONS},
scores AS (
  SELECT *, sin(step * (demand + 1e0) + hour) * 2e0 AS raw
  FROM tin CROSS JOIN (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS step) s)"""
TAR = f"""{SCORES},
tar AS (
  SELECT site_id, step, CAST((hour + step) % 24 AS INTEGER) AS hour, day, least(25e0, greatest(1e0,
      hist_avg * (0.8e0 - 0.1e0 * demand) + hist_avg * (0.4e0 + 0.2e0 * demand) / (1e0 + exp(-raw)))) AS tariff,
    month
  FROM (SELECT *, dow AS day FROM scores))"""
STATS = f"""{TAR},
stats AS (
  SELECT site_id, min(tariff) AS lo, max(tariff) AS hi, avg(tariff) AS mean,
    arg_min(step, tariff + step * 1e-13) AS lo_step, arg_max(step, tariff - step * 1e-13) AS hi_step,
    max(CASE WHEN step = 1 THEN tariff END) AS next
  FROM tar GROUP BY site_id),
hours AS (
  SELECT stats.*, CAST((tin.hour + lo_step) % 24 AS INTEGER) AS lo_hour, CAST((tin.hour + hi_step) % 24 AS INTEGER) AS hi_hour
  FROM stats JOIN tin USING (site_id))"""


def ampm(hour: str) -> str:
    return f"""(CAST(CASE WHEN {hour} % 12 = 0 THEN 12 ELSE {hour} % 12 END AS VARCHAR) || ':00 ' ||
    CASE WHEN {hour} < 12 THEN 'AM' ELSE 'PM' END)"""


def clock(hour: str) -> str:
    return f"(lpad(CAST({hour} AS VARCHAR), 2, '0') || ':00')"


ALL = f"{SOL}, {CON}, {STATS}"
COST = f"""{CON}, {TAR},
cost AS (SELECT con.site_id, con.step, con.ts, kwh * tariff AS cost FROM con JOIN tar USING (site_id, step)),
low AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY cost, step) AS rn FROM cost) WHERE rn = 1)"""
DECISION = """ids AS (SELECT site_id FROM sol UNION SELECT site_id FROM con UNION SELECT site_id FROM tar),
decided AS (
  SELECT ids.site_id, s.energy_kwh AS solar_1h, strftime(s.ts, '%Y-%m-%d %H:%M') AS solar_label, c.kwh AS energy_1h,
    strftime(c.ts, '%Y-%m-%d %H:%M') AS energy_label, hours.*  EXCLUDE (site_id), s.energy_kwh - c.kwh AS net,
    CAST(s.site_id IS NOT NULL AS INTEGER) AS has_solar, CAST(c.site_id IS NOT NULL AS INTEGER) AS has_energy,
    CAST(hours.site_id IS NOT NULL AS INTEGER) AS has_tariff
  FROM ids LEFT JOIN (SELECT * FROM sol WHERE step = 1) s USING (site_id)
    LEFT JOIN (SELECT * FROM con WHERE step = 1) c USING (site_id) LEFT JOIN hours USING (site_id))"""


def _solar(columns: dict[str, str], keep: str = "site_id, ts") -> str:
    return f"WITH {READINGS} SELECT {keep}, {rounded(columns)} FROM readings"


SQL: dict[str, str] = {}

SQL["solar_calendar"] = (
    f"WITH {READINGS} SELECT site_id, ts, {named(calendar())}, "
    f"{rounded({**waves(), 'solar_elevation': elevation('hour(ts)')})} FROM readings"
)
SQL["solar_ratios"] = _solar(ratios())
SQL["solar_lags"] = _solar(lags())
SQL["solar_rolling"] = _solar(rolling())
SQL["solar_ewm"] = _solar(ewm())
_READINGS_WITH_GAPS = READINGS.replace('value * 5e0 AS "GHI"', "CASE WHEN event_type <> 'signup' THEN value * 5e0 END AS \"GHI\"")


def _ewm_gaps(span: int) -> str:
    """Fold over the readings so far; each is weighted by the rows since the one before."""
    a = 2 / (span + 1)
    kept = f"pow({1 - a!r}e0, no - before)"
    step = f"struct_pack(c := CASE WHEN before IS NULL THEN 0e0 ELSE {kept} / ({kept} + {a!r}e0) END, x := \"GHI\")"
    past = f"list({step}) OVER ({W} ROWS BETWEEN 2000 PRECEDING AND CURRENT ROW)"
    return f"list_reduce({past}, lambda y, z: struct_pack(c := 0e0, x := z.c * y.x + (1e0 - z.c) * z.x)).x"


SQL["solar_ewm_gaps"] = f"""WITH {_READINGS_WITH_GAPS},
numbered AS (SELECT site_id, ts, "GHI", row_number() OVER ({W}) AS no FROM readings),
seen AS (SELECT *, lag(no) OVER ({W}) AS before FROM numbered WHERE "GHI" IS NOT NULL),
averages AS (SELECT site_id, ts, {named({f"e{s}": _ewm_gaps(s) for s in (3, 12, 48)})} FROM seen)
SELECT site_id, ts, {rounded({f"GHI_ema_{s}": f"last_value(e{s} IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)" for s in (3, 12, 48)})}
FROM numbered LEFT JOIN averages USING (site_id, ts)"""
_OUTAGES = _READINGS_WITH_GAPS.replace("user_id AS site_id", "user_id % 10 AS site_id", 1)
_LONG_GAPS = f"""WITH {_OUTAGES},
cut AS (SELECT site_id, ts, "DNI", CASE WHEN day(ts) NOT BETWEEN 8 AND 19 THEN "GHI" END AS "GHI" FROM readings),
numbered AS (SELECT *, row_number() OVER ({W}) AS no FROM cut)"""
SQL["long_site_averages"] = f"""{_LONG_GAPS},
seen AS (SELECT *, lag(no) OVER ({W}) AS before FROM numbered WHERE "GHI" IS NOT NULL),
averages AS (SELECT site_id, no, {named({f"e{s}": _ewm_gaps(s) for s in (3, 12, 48)})} FROM seen)
SELECT site_id, ts, {r6('"DNI"')} AS "DNI", {rounded({f"GHI_ema_{s}": f"last_value(e{s} IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)" for s in (3, 12, 48)})}
FROM numbered LEFT JOIN averages USING (site_id, no)"""
SQL["long_site_filled"] = f"""{_LONG_GAPS}
SELECT site_id, ts, {r6('"DNI"')} AS "DNI", {r6(f"""coalesce(last_value("GHI" IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value("GHI" IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))""")} AS "GHI"
FROM numbered"""
SQL["solar_modes"] = _solar(modes())
SQL["solar_features"] = f"""WITH {features_cte()}
SELECT site_id, ts, {rounded({c: f'"{c}"' for c in ("GHI", *feature_exprs())})} FROM features WHERE n > 24"""
SQL["long_site_features"] = SQL["solar_features"].replace("user_id AS site_id", "user_id % 10 AS site_id", 1)
SQL["solar_lookback"] = f"""WITH {features_cte()},
recent AS (
  SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY ts) - 1 AS i FROM (
    SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY ts DESC) AS back, count(*) OVER (PARTITION BY site_id) AS rows,
      max(ts) OVER (PARTITION BY site_id) AS last_ts
    FROM features WHERE n > 24) WHERE back <= 12 AND rows >= 12),
flat AS (
  SELECT site_id, last_ts, i, unnest(range(77)) AS j, unnest([{", ".join(f'"{c}"' for c in feature_exprs())}]) AS x FROM recent)
SELECT site_id, last_ts, CAST(i * 77 + j AS INTEGER) AS pos, {r6("x")} AS x FROM flat"""
SQL["solar_min_rows"] = f"""WITH {READINGS}
SELECT site_id, n, CASE WHEN n >= least THEN 'ok' ELSE 'too few rows' END AS reason, CAST(least AS INTEGER) AS least
FROM (SELECT site_id, count(*) AS n FROM readings GROUP BY site_id) CROSS JOIN (SELECT unnest([36, 72]) AS least) m"""

RANGES = [
    ("GHI", 0, 1500), ("DNI", 0, 1200), ("DHI", 0, 600), ("T_amb", -20, 60), ("RH", 0, 100), ("WS", 0, 50),
    ("WS_gust", 0, 80), ("WD", 0, 360), ("WD_std", 0, 180), ("BP", 800, 1100), ("area_m2", 0.1, 10000),
    ("efficiency", 0.05, 0.35),
]
_FAILED = ", ".join(f"CASE WHEN \"{c}\" >= {lo}e0 AND \"{c}\" <= {hi}e0 THEN NULL ELSE '{c}' END" for c, lo, hi in RANGES)
SQL["sensor_range_checks"] = f"""WITH {READINGS}, {PANELS},
joined AS (
  SELECT readings.*, coalesce(area, 10e0) AS area_m2, coalesce(eff, 0.2e0) AS efficiency
  FROM readings LEFT JOIN panels USING (site_id))
SELECT site_id, ts, concat_ws(',', {_FAILED}) AS failed, {r6('least(greatest("GHI", 0e0), 1500e0)')} AS ghi_clipped,
  {r6("area_m2")} AS area_m2, {r6("efficiency")} AS efficiency FROM joined"""
SQL["ingest_csv"] = f"""SELECT user_id AS site_id, date_trunc('second', ts) AS ts, {r6("value")} AS kw
FROM events WHERE event_type <> 'error'"""
SQL["ingest_json"] = f"""WITH {READINGS}
SELECT site_id, date_trunc('minute', ts) AS ts, {rounded({c: f'"{c}"' for c in ("GHI", *BASE)})}
FROM readings WHERE "DHI" <> 0"""
SQL["ingest_requests"] = f"""WITH {READINGS},
numbered AS (
  SELECT *, row_number() OVER ({W}) AS no, count(*) OVER (PARTITION BY site_id) AS n FROM readings),
newest AS (SELECT *, least(no + 9, n) // 5 * 5 AS request, n // 5 * 5 AS panel FROM numbered)
SELECT site_id, ts, {rounded({"GHI": '"GHI" * (1e0 + request / 100e0)', "DHI": '"DHI"', "BP": '"BP"',
  "area_m2": "CAST(panel AS DOUBLE)",
  "efficiency": "CASE WHEN panel % 15 / 10e0 > 0 AND panel % 15 / 10e0 <= 1 THEN panel % 15 / 10e0 ELSE 0.2e0 END"})}
FROM newest WHERE request >= no"""
_SENSORS = rounded({c: f'"{c}"' for c in ("GHI", *BASE)})
SQL["solar_files"] = f"""WITH {READINGS}
SELECT site_id, ts, {_SENSORS}, 'csv' AS file, CAST(NULL AS DOUBLE) AS area_m2 FROM readings
UNION ALL SELECT site_id, ts, {_SENSORS}, 'json', CASE WHEN site_id % 30 > 0 THEN CAST(site_id % 30 AS DOUBLE) END FROM readings"""
SQL["consumption_files"] = f"""WITH {HOUSES}
SELECT site_id, ts, {r6("kw")} AS kw, file FROM raw CROSS JOIN (SELECT unnest(['csv', 'json']) AS file) f WHERE site_id % 7 <> 0"""
SQL["tariff_files"] = f"""WITH {CONDITIONS}
SELECT site_id, CAST(hour AS INTEGER) AS hour, CAST(dow AS INTEGER) AS dow, CAST(month AS INTEGER) AS month, {rounded({c: c for c in ("temperature", "hist_avg", "demand")})}
FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY ts DESC) AS back FROM conditions) WHERE back = 1"""
SQL["written_forecasts"] = f"""WITH {ALL}
SELECT site_id, 'solar' AS forecast, step, {r6("energy_kwh")} AS y FROM sol
UNION ALL SELECT site_id, 'consumption', step, {r6("kwh")} FROM con
UNION ALL SELECT site_id, 'tariff', step, {r6("tariff")} FROM tar"""
SQL["forecast_rejections"] = f"""WITH {CONDITIONS.split("tin AS")[0].rstrip().rstrip(",")},
parts AS (
  SELECT user_id * 10 + CASE WHEN day(ts) % 4 = 0 THEN 0 ELSE 1 END AS site_id, event_type <> 'signup' AS complete FROM events),
counts AS (SELECT site_id, count(*) AS n, CAST(sum(CASE WHEN complete THEN 1 ELSE 0 END) AS BIGINT) AS whole FROM parts GROUP BY site_id)
SELECT site_id, 'solar' AS forecast, whole AS n, 'too few rows' AS reason FROM counts WHERE whole < 36
UNION ALL SELECT site_id, 'consumption', n, 'too few rows' FROM counts WHERE n < 24
UNION ALL SELECT site_id, 'tariff', CAST(1 AS BIGINT), 'no average price' FROM (
  SELECT site_id, arg_max(coalesce(hist_avg, -1), ts) AS last_price FROM conditions GROUP BY site_id) WHERE last_price = -1"""
SQL["hourly_resample"] = f"WITH {HOUSES}, {hourly('raw', 'full_hours')} SELECT site_id, ts, {r6('kw')} AS kw FROM full_hours"
SQL["hourly_series"] = f"WITH {FEEDERS}, {SERIES} SELECT site_id, ts, {r6('kw')} AS kw FROM series"
SQL["resample_rule"] = f"""WITH {BOTH}, {RULE}
SELECT site_id, n, {r6("hours")} AS span_hours, rule_a, {r6("med")} AS median_gap_s, rule_b, rule_a OR rule_b AS resample FROM rule"""
SQL["gap_counts"] = f"""WITH {BOTH},
gaps AS (SELECT site_id, ts, epoch(ts - lag(ts) OVER ({W})) AS gap FROM raw)
SELECT site_id, count(*) AS n, count(*) FILTER (gap < 2700) AS short_gaps, count(*) FILTER (gap >= 2700) AS long_gaps,
  {r6("min(gap) FILTER (gap >= 2700)")} AS shortest_long_s, {r6("epoch(max(ts) - min(ts)) / 3600e0")} AS span_hours
FROM gaps GROUP BY site_id"""
SQL["gap_medians"] = f"""WITH {BOTH}, {RULE}
SELECT site_id, {r6("median(gap)")} AS median_gap_s FROM gaps WHERE gap IS NOT NULL GROUP BY site_id"""
SQL["hourly_profile"] = f"""WITH {HOUSES}, series AS (SELECT * FROM raw), {PROFILE}
SELECT p.site_id, CAST(p.hour AS INTEGER) AS hour, {r6("p.kw")} AS kw, {r6("q.kw")} AS usual_now
FROM profile p JOIN profile q ON p.site_id = q.site_id AND q.hour = hour(q.last_ts)"""


def _consumption_features() -> dict[str, str]:
    start = f"CASE WHEN lead(kw) OVER ({W}) IS NULL THEN 0e0 ELSE kw END"
    out = {"hour": "hour(ts)", "day": "day(ts)", "month": "month(ts)", "weekday": "isodow(ts) - 1"}
    for k in (1, 2, 3, 6, 12, 24, 48):
        out[f"lag_{k}"] = f"coalesce(lag(kw, {k}) OVER ({W}), first_value(kw) OVER ({W}))"
    for k in (6, 24):
        out[f"rolling_mean_{k}"] = f"coalesce(avg(kw) OVER ({W} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING), {start})"
    out["rolling_std_24"] = f"coalesce(stddev_samp(kw) OVER ({W} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), 0e0)"
    return out


SQL["consumption_features"] = (
    f"WITH {history(HOUSES)} SELECT site_id, ts, {rounded({'kw': 'kw', **_consumption_features()})} FROM series"
)
SQL["profile_forecast"] = f"""WITH {CON}
SELECT site_id, step, strftime(ts, {STAMP}) AS label, {r6("kwh")} AS kwh,
  {r6("round(sum(kwh) OVER (PARTITION BY site_id) + 1e-9, 4)")} AS total_kwh FROM con"""
SQL["feeder_forecast"] = f"""WITH {history(FEEDERS)}, {FORECAST}
SELECT site_id, step, strftime(ts, {STAMP}) AS label, {r6("kwh")} AS kwh FROM con"""
SQL["service_window_forecast"] = f"""WITH {history(FEEDERS, 2000)}, {FORECAST}
SELECT site_id, step, strftime(ts, {STAMP}) AS label, {r6("kwh")} AS kwh FROM con"""
SQL["consumption_totals"] = f"WITH {CON} SELECT site_id, {r6('round(sum(kwh) + 1e-9, 4)')} AS total_kwh FROM con GROUP BY site_id"
BASE_ERRORS = f"""{history(HOUSES)},
based AS (
  SELECT site_id, ts, kw, (coalesce(lag(kw, 1) OVER ({W}), first_value(kw) OVER ({W}))
      + coalesce(lag(kw, 24) OVER ({W}), first_value(kw) OVER ({W}))) / 2e0 AS base,
    row_number() OVER (PARTITION BY site_id ORDER BY ts DESC) AS back, count(*) OVER (PARTITION BY site_id) AS n,
    max(ts) OVER (PARTITION BY site_id) AS last_ts
  FROM series)"""
SQL["residual_errors"] = f"""WITH {BASE_ERRORS}
SELECT b.site_id, b.last_ts, CAST(pos AS INTEGER) AS pos, {r6("(kw - base - 0.1e0) / 2e0")} AS error
FROM based b JOIN (SELECT unnest(range(24)) AS pos) p ON b.back = least(24 - pos, b.n)"""
SQL["recursion_24h"] = f"""WITH RECURSIVE {BASE_ERRORS}, {PROFILE},
day_before AS (SELECT site_id, CAST(25 - back AS INTEGER) AS step, kw FROM based WHERE back <= 24),
steps AS (
  SELECT site_id, last_ts, 0 AS step, kw AS v, (kw - base - 0.1e0) / 2e0 AS e FROM based WHERE back = 1
  UNION ALL
  SELECT s.site_id, s.last_ts, s.step + 1,
    CASE WHEN greatest((s.v + d.kw) / 2e0 + greatest(s.e / 2e0 * 2e0 + 0.1e0, -(s.v + d.kw) / 2e0), 0.01e0) <= 0.01e0 THEN p.kw
      ELSE (s.v + d.kw) / 2e0 + greatest(s.e / 2e0 * 2e0 + 0.1e0, -(s.v + d.kw) / 2e0) END, s.e / 2e0
  FROM steps s JOIN day_before d ON d.site_id = s.site_id AND d.step = s.step + 1
  JOIN profile p ON p.site_id = s.site_id AND p.hour = (hour(s.last_ts) + s.step + 1) % 24)
SELECT site_id, CAST(step AS INTEGER) AS step, last_ts + to_hours(CAST(step AS INTEGER)) AS ts, {r6("round(v + 1e-9, 4)")} AS kwh
FROM steps WHERE step > 0"""
_PRICED = CONDITIONS.split("tin AS")[0].rstrip().rstrip(",")
_SHARE = """least(greatest((price - hist_avg * (0.8e0 - demand * 0.1e0)) / (hist_avg * (0.4e0 + demand * 0.2e0)), 0.01e0), 0.99e0)"""
SQL["tariff_training"] = f"""WITH {_PRICED},
priced AS (
  SELECT *, {", ".join(f"coalesce(lag(hist_avg, {k}) OVER ({W}), hist_avg) / 10e0 AS lag_{k}" for k in (1, 12))},
    row_number() OVER ({W}) AS no FROM conditions WHERE hist_avg IS NOT NULL),
pairs AS (
  SELECT p.*, CAST(q.no - p.no AS INTEGER) AS step, q.hist_avg AS price
  FROM priced p JOIN priced q ON p.site_id = q.site_id AND q.no > p.no AND q.no <= p.no + 12)
SELECT site_id, ts, step, {rounded({
    "label": f"ln({_SHARE} / (1e0 - {_SHARE}))",
    "ahead_sin": f"sin(((hour + step) % 24) * {2 * math.pi!r}e0 / 24e0)", "ahead_cos": f"cos(((hour + step) % 24) * {2 * math.pi!r}e0 / 24e0)",
    "tariff_lag_1": "lag_1", "tariff_lag_12": "lag_12", "temperature_norm": "(temperature - 20e0) / 30e0", "hist_avg_norm": "hist_avg / 10e0"})}
FROM pairs"""
SQL["last_n_readings"] = f"""WITH {CON},
feeders AS (
  SELECT user_id % 10 AS site_id, ts, value / 25e0 AS kw,
    row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts DESC) AS back FROM events)
SELECT site_id, ts, {r6("kw")} AS kw, back = 1 AS is_last FROM feeders WHERE back <= 10
UNION ALL SELECT -1 - site_id, ts, {r6("kwh")}, FALSE FROM con WHERE step <= 3"""
SQL["sorted_readings"] = f"""WITH {HOUSES}
SELECT site_id, ts, {r6("kw")} AS kw, {r6(f"(epoch_us(ts) - epoch_us(lag(ts) OVER ({W}))) / 1e6")} AS gap_s
FROM raw ORDER BY site_id, ts"""
SQL["history_arrays"] = f"""WITH {HOUSES},
extended AS (
  SELECT * FROM raw
  UNION ALL SELECT site_id, max(ts) + INTERVAL 1 HOUR, arg_max(kw, ts) * 2 FROM raw GROUP BY site_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY ts DESC) AS back FROM extended),
last48 AS (SELECT site_id, list(kw ORDER BY ts) AS h FROM ranked WHERE back <= 48 GROUP BY site_id),
hist AS (
  SELECT site_id, CASE WHEN len(h) < 48 THEN list_append(h, h[1]) ELSE list_append(h[2:], h[1]) END AS h FROM last48)
SELECT site_id, CAST(len(h) AS INTEGER) AS n,
  {", ".join(f'{r6(f"CASE WHEN len(h) >= {k} THEN h[-{k}] ELSE h[1] END")} AS back_{k}' for k in (1, 2, 24, 48, 100))},
  {r6("list_avg(h[-6:])")} AS mean_6, {r6("list_stddev_pop(h[-24:])")} AS std_24,
  {r6("h[-1]")} AS padded_last, {r6("h[1]")} AS left_padded_first FROM hist"""
SQL["solar_energy"] = f"""WITH {solar_cte(owners_only=False)}
SELECT site_id, step, strftime(ts, {STAMP}) AS label, {r6("ghi_wm2")} AS ghi_wm2, {r6("energy_kwh")} AS energy_kwh, category,
  {r6("round(sum(energy_kwh) OVER s + 1e-9, 4)")} AS total_kwh, {r6("avg(ghi_wm2) OVER s")} AS avg_ghi,
  {r6("max(ghi_wm2) OVER s")} AS max_ghi, {r6("avg(energy_kwh) OVER s")} AS avg_kwh
FROM sol WINDOW s AS (PARTITION BY site_id)"""

_FRAME_WAVES = {
    f"{name}_{fn}": f"{fn}({expr} * {2 * math.pi!r}e0 / {period}e0)"
    for name, expr, period in (("hour", "h", 24), ("day", "dow", 7), ("month", "month", 12))
    for fn in ("sin", "cos")
}
_FRAME_LAGS = {f"tariff_lag_{k}": f"coalesce(recent[23 - frame + {k} + 1], hist_avg) / 10e0" for k in (1, 2, 3, 6, 12)}
SQL["tariff_frames"] = f"""WITH {CONDITIONS},
past AS (
  SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY ts DESC) AS k FROM conditions WHERE hist_avg IS NOT NULL),
lists AS (SELECT site_id, list(hist_avg ORDER BY k) AS recent FROM past WHERE k <= 36 GROUP BY site_id),
frames AS (
  SELECT tin.*, recent, frame, (hour - (23 - frame) + 24) % 24 AS h
  FROM tin LEFT JOIN lists USING (site_id) CROSS JOIN (SELECT unnest(range(24)) AS frame) f)
SELECT site_id, CAST(frame AS INTEGER) AS frame, CAST(h AS INTEGER) AS frame_hour,
  {rounded({**_FRAME_WAVES, "temperature_norm": "(temperature - 20e0) / 30e0", "demand_index": "demand",
            "hist_avg_norm": "hist_avg / 10e0", **_FRAME_LAGS})} FROM frames"""
SQL["tariff_band"] = f"""WITH {TAR}
SELECT site_id, step, {ampm("hour")} AS time, {clock("hour")} AS clock,
  (['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'])[day + 1] AS day,
  (['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'])[month] AS month,
  {r6("tariff")} AS tariff FROM tar"""
SQL["tariff_summary"] = f"""WITH {STATS}
SELECT site_id, {r6("lo")} AS min_tariff, {r6("hi")} AS max_tariff, {r6("mean")} AS avg_tariff, {r6("hi - lo")} AS spread,
  CAST(hi_step - 1 AS INTEGER) AS peak_index, CAST(lo_step - 1 AS INTEGER) AS off_peak_index, hi_hour AS peak_hour,
  lo_hour AS cheap_hour, {r6("next")} AS next_tariff, CAST(hi_step AS INTEGER) AS peak_step,
  CAST(lo_step AS INTEGER) AS cheap_step FROM hours"""
SQL["tariff_badges"] = f"""WITH {STATS}
SELECT tar.site_id, step, hour, {r6("tariff")} AS tariff,
  CASE WHEN tariff >= mean + 0.4e0 * (hi - mean) THEN 'Peak' WHEN tariff <= mean - 0.4e0 * (mean - lo) THEN 'Off-peak'
    ELSE 'Mid' END AS badge,
  CAST(trunc((tariff - lo) / greatest(hi - lo, 0.01e0) * 100e0) AS INTEGER) AS bar_pct, {ampm("hour")} AS hour_label
FROM tar JOIN stats USING (site_id)"""
TOP = f"""{STATS},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY tariff, step) AS cheap,
    row_number() OVER (PARTITION BY site_id ORDER BY tariff DESC, step) AS dear FROM tar),
top AS (
  SELECT site_id, 'cheapest' AS kind, CAST(cheap AS INTEGER) AS rank, step, hour, tariff FROM ranked WHERE cheap <= 3
  UNION ALL SELECT site_id, 'dearest', CAST(dear AS INTEGER), step, hour, tariff FROM ranked WHERE dear <= 3)"""
SQL["tariff_top_hours"] = f"WITH {TOP} SELECT site_id, kind, rank, step, hour, {r6('tariff')} AS tariff FROM top"
_TEXT = f"string_agg({clock('hour')} || printf(' (₹%.2f)', tariff), ', ' ORDER BY rank)"
SQL["appliance_hours"] = f"""WITH {TOP}
SELECT site_id, {_TEXT} FILTER (kind = 'cheapest') AS best_hours, {_TEXT} FILTER (kind = 'dearest') AS worst_hours,
  {r6("max(hi - lo)")} AS saving_per_kwh FROM top JOIN stats USING (site_id) GROUP BY site_id"""
SQL["next_hour_decision"] = f"""WITH {ALL}, {DECISION}
SELECT site_id, {rounded({"solar_1h": "solar_1h", "energy_1h": "energy_1h"})}, solar_label, energy_label, has_solar, has_energy,
  has_tariff, has_solar + has_energy + has_tariff AS inputs_ready,
  CASE WHEN net > 0 THEN 'surplus' WHEN net <= 0 THEN 'deficit' END AS state,
  {rounded({"surplus_kwh": "CASE WHEN net > 0 THEN net END", "deficit_kwh": "CASE WHEN net <= 0 THEN -net END"})},
  CASE WHEN net > 0 THEN {ampm("hi_hour")} END AS sell_hour,
  {rounded({"max_tariff": "hi", "sell_revenue": "CASE WHEN net > 0 THEN net * hi END",
            "import_cost": "CASE WHEN net <= 0 THEN -net * next END", "next_tariff": "next", "min_tariff": "lo"})},
  CASE WHEN net <= 0 THEN {ampm("lo_hour")} END AS cheap_hour_label FROM decided"""
SQL["next_hour_join"] = f"""WITH {SOL}, {CON}
SELECT sol.site_id, sol.step, {r6("energy_kwh")} AS solar_kwh, {r6("kwh")} AS kwh
FROM sol JOIN con ON sol.site_id = con.site_id AND sol.step = con.step WHERE sol.step = 1"""
SQL["energy_balance_3h"] = f"""WITH {ALL},
gen AS (SELECT site_id, round(sum(energy_kwh) + 1e-9, 4) AS g FROM sol GROUP BY site_id),
used AS (SELECT site_id, sum(kwh) AS u FROM con WHERE step <= 3 GROUP BY site_id),
totals AS (
  SELECT site_id, coalesce(g, 0e0) AS g, coalesce(u, 0e0) AS u FROM gen FULL JOIN used USING (site_id)),
hourly AS (
  SELECT site_id, step, strftime(coalesce(c.ts, s.ts), {STAMP}) AS label, coalesce(energy_kwh, 0e0) AS e, coalesce(kwh, 0e0) AS k
  FROM sol s FULL JOIN (SELECT * FROM con WHERE step <= 3) c USING (site_id, step)
  WHERE site_id IN (SELECT site_id FROM sol) AND site_id IN (SELECT site_id FROM con))
SELECT totals.site_id, {rounded({"generated_kwh": "g", "used_kwh": "u", "net_kwh": "g - u"})},
  CASE WHEN g - u >= 0 THEN 'Surplus' ELSE 'Deficit' END AS state, step, label,
  {rounded({"solar_kwh": "e", "use_kwh": "k"})}, split_part(label, ' ', 2) AS time
FROM totals LEFT JOIN hourly USING (site_id)"""
SQL["timeline"] = f"""WITH {ALL},
points AS (
  SELECT site_id, strftime(ts, {STAMP}) AS label, 1 AS src, step, energy_kwh AS v FROM sol
  UNION ALL SELECT site_id, strftime(ts, {STAMP}), 2, step, kwh FROM con),
axis AS (
  SELECT site_id, label, min(src * 100 + step) AS place, max(CASE WHEN src = 1 THEN v END) AS e, max(CASE WHEN src = 2 THEN v END) AS k
  FROM points GROUP BY site_id, label),
placed AS (
  SELECT tar.site_id, tariff, coalesce((
      SELECT arg_min(label, place) FROM axis WHERE axis.site_id = tar.site_id AND label LIKE '% ' || {clock("hour")}
    ), 'H' || {clock("hour")}) AS label FROM tar),
merged AS (SELECT site_id, label, e, k, tariff FROM axis FULL JOIN placed USING (site_id, label)),
ready AS (
  SELECT site_id FROM merged GROUP BY site_id
  HAVING CAST(count(e) > 0 AS INTEGER) + CAST(count(k) > 0 AS INTEGER) + CAST(count(tariff) > 0 AS INTEGER) >= 2)
SELECT site_id, label, {rounded({"solar_kwh": "coalesce(e, 0e0)", "use_kwh": "coalesce(k, 0e0)", "tariff": "coalesce(tariff, 0e0)"})}
FROM merged WHERE site_id IN (SELECT site_id FROM ready) ORDER BY site_id, label"""
SQL["lowest_cost"] = f"WITH {COST} SELECT site_id, step, strftime(ts, {STAMP}) AS label, {r6('cost')} AS cost FROM low"
SQL["best_windows"] = f"""WITH {SOL}, {STATS},
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY energy_kwh DESC, step) AS rn FROM sol) WHERE rn = 1)
SELECT site_id, step, strftime(ts, {STAMP}) AS label, {r6("energy_kwh")} AS energy_kwh, {clock("lo_hour")} AS cheapest_hour,
  {r6("lo")} AS min_tariff, {clock("hi_hour")} AS dearest_hour, {r6("hi")} AS max_tariff
FROM best FULL JOIN hours USING (site_id)"""
SQL["chart_tables"] = f"""WITH {ALL}, {DECISION}
SELECT site_id, 'ghi_wm2' AS chart, strftime(ts, '%H:%M') AS label, {r6("ghi_wm2")} AS y FROM sol
UNION ALL SELECT site_id, 'energy_kwh', strftime(ts, '%H:%M'), {r6("energy_kwh")} FROM sol
UNION ALL SELECT site_id, 'consumption', strftime(ts, {STAMP}), {r6("kwh")} FROM con
UNION ALL SELECT site_id, 'tariff', {ampm("hour")}, {r6("round(tariff + 1e-9, 4)")} FROM tar
UNION ALL SELECT site_id, 'next_hour', 'solar_kwh', {r6("solar_1h")} FROM decided WHERE has_solar = 1 AND has_energy = 1
UNION ALL SELECT site_id, 'next_hour', 'use_kwh', {r6("energy_1h")} FROM decided WHERE has_solar = 1 AND has_energy = 1"""
SQL["recommendations"] = f"""WITH {ALL}, {DECISION},
cost AS (SELECT con.site_id, con.step, con.ts, kwh * tariff AS cost FROM con JOIN tar USING (site_id, step)),
low AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY cost, step) AS rn FROM cost) WHERE rn = 1),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY energy_kwh DESC, step) AS rn FROM sol) WHERE rn = 1)
SELECT site_id, 1 AS priority, '💹 Sell Extra Solar Energy — Primary Decision' AS title,
  printf('Next hour (%s): solar generates %.4f kWh but you only need %.4f kWh. Surplus: %.4f kWh. Tariff model says price peaks at %s (₹%.2f/kWh). Export at that hour → estimated revenue ₹%.2f.',
    solar_label, solar_1h, energy_1h, net, {ampm("hi_hour")}, hi, net * hi) AS body, 'recommendation' AS box
FROM decided WHERE net > 0 AND has_tariff = 1
UNION ALL SELECT site_id, 1, '🔋 Export Opportunity',
  printf('Next hour solar surplus: %.4f kWh. Run the Tariff tab to find the best sell hour.', net), 'recommendation'
FROM decided WHERE net > 0 AND has_tariff = 0
UNION ALL SELECT site_id, 1, '⚠️ Grid Import Required',
  printf('Next hour deficit: %.4f kWh. Solar cannot cover demand — defer non-critical loads.', abs(net)), 'warning'
FROM decided WHERE net <= 0
UNION ALL SELECT site_id, 2, '☀️ Peak Solar Window (3h)',
  printf('Best solar output at %s — %.4f kWh. Run high-power appliances then.', strftime(ts, {STAMP}), energy_kwh), 'recommendation'
FROM best
UNION ALL SELECT site_id, 3, '🟢 Cheapest Tariff — Buy / Import Window',
  printf('Lowest tariff at %s (₹%.2f/kWh). Ideal for EV charging, water heaters, washing machines.', {clock("lo_hour")}, lo), 'recommendation'
FROM hours
UNION ALL SELECT site_id, 4, '🔴 Peak Tariff — Best Sell / Avoid Buying',
  printf('Highest tariff at %s (₹%.2f/kWh). Sell excess solar here for maximum revenue; defer grid-powered loads.', {clock("hi_hour")}, hi), 'warning'
FROM hours
UNION ALL SELECT site_id, 5, '💰 Lowest Cost Hour',
  printf('Minimum electricity cost at %s — ₹%.2f for that hour. Ideal for heavy loads.', strftime(ts, {STAMP}), cost), 'recommendation'
FROM low"""


def _quartiles(columns: list[str], source: str) -> str:
    return "SELECT " + ", ".join(f'quantile_cont("{c}", [0.25, 0.5, 0.75]) AS "q_{c}"' for c in columns) + f" FROM {source}"


def _in_units(column: str, of: str | None = None) -> str:
    q = f'"q_{of or column}"'
    return f"""(("{column}" - {q}[2]) / CASE WHEN {q}[3] = {q}[1] THEN 1e0 ELSE {q}[3] - {q}[1] END)"""


_ALL_FEATURES = list(feature_exprs())
_FEATURE_ROWS = f"""{features_cte()},
f AS (
  SELECT *, row_number() OVER ({W}) AS i, count(*) OVER (PARTITION BY site_id) AS rows,
    lead("GHI", 1) OVER ({W}) AS y1, lead("GHI", 2) OVER ({W}) AS y2, lead("GHI", 3) OVER ({W}) AS y3
  FROM features WHERE n > 24),
quart AS ({_quartiles([*_ALL_FEATURES, "GHI"], "f")})"""
SQL["scaled_features"] = f"""WITH {_FEATURE_ROWS}
SELECT site_id, ts, {rounded({c: _in_units(c) for c in _ALL_FEATURES})} FROM f, quart"""


def _bin(x: str) -> str:
    return f"least(greatest(floor({x} * 2e0) + 4, 0), 7)"


SQL["feature_ranks"] = f"""WITH {_FEATURE_ROWS},
s AS (SELECT site_id, i, [{", ".join(_in_units(c) for c in _ALL_FEATURES)}] AS x,
    CASE WHEN i >= 12 AND y3 IS NOT NULL THEN {_in_units("y1", "GHI")} END AS y FROM f, quart),
e AS (SELECT site_id, i, unnest(range(77)) AS j, unnest(x) AS v FROM s),
pairs AS (
  SELECT l.lag, e.j, e.v, s.y FROM s JOIN (SELECT unnest(range(12)) AS lag) l ON s.y IS NOT NULL
  JOIN e ON e.site_id = s.site_id AND e.i = s.i - l.lag),
related AS (SELECT lag, j, CASE WHEN var_pop(v) > 0 THEN corr(v, y) ELSE 0e0 END AS r, count(*) AS n FROM pairs GROUP BY ALL),
counts AS (SELECT lag, j, {_bin("v")} AS a, {_bin("y")} AS b, count(*) AS c FROM pairs GROUP BY ALL),
shares AS (
  SELECT lag, j, c, sum(c) OVER (PARTITION BY lag, j) AS n, sum(c) OVER (PARTITION BY lag, j, a) AS na, sum(c) OVER (PARTITION BY lag, j, b) AS nb
  FROM counts),
mutual AS (SELECT lag, j, sum(c / CAST(n AS DOUBLE) * ln(CAST(c AS DOUBLE) * n / (CAST(na AS DOUBLE) * nb))) AS mi FROM shares GROUP BY ALL)
SELECT CAST(lag AS INTEGER) AS lag, CAST(j AS INTEGER) AS "column", {r6("r * r / (1e0 - r * r) * (n - 2)")} AS f, {r6("mi")} AS mi
FROM related JOIN mutual USING (lag, j)"""


def _lines(columns: dict[str, tuple[str, int]], lines: list[str]) -> str:
    """Scaled elements by name (feature, rows back), and lines on some of them that the earlier half of the windows gives."""
    values = ", ".join(
        f'lag({_in_units(c)}, {back}) OVER ({W}) AS "{name}"' if back else f'{_in_units(c)} AS "{name}"' for name, (c, back) in columns.items()
    )
    metas = ", ".join(f'(SELECT a FROM line_{x}) + (SELECT b FROM line_{x}) * "{x}" AS meta_{x}' for x in lines)
    fits = ", ".join(
        f'line_{x} AS (SELECT regr_intercept(l1, "{x}") AS a, regr_slope(l1, "{x}") AS b FROM wins, mid WHERE epoch_us(ts) <= m)' for x in lines
    )
    return f"""{_FEATURE_ROWS},
units AS (
  SELECT site_id, ts, i, rows, {values}, {", ".join(f'{_in_units(f"y{h}", "GHI")} AS l{h}' for h in (1, 2, 3))}, "q_GHI" AS qy FROM f, quart),
wins AS (SELECT * FROM units WHERE i >= 12 AND l3 IS NOT NULL),
mid AS (SELECT quantile_cont(CAST(epoch_us(ts) AS DOUBLE), 0.5) AS m FROM wins),
{fits},
stacked AS (SELECT *, {metas} FROM units)"""


SQL["stacked_vector"] = f"""WITH {_lines({"g": ("GHI_rolling_mean_3", 0), "d": ("DNI", 2), "t": ("T_amb", 1), "k": ("GHI_lag_1", 0)}, ["g", "d"])},
ends AS (SELECT site_id, ts AS last_ts, unnest(range(4)) AS pos, unnest([t, k, meta_g, meta_d]) AS x FROM stacked WHERE i = rows AND rows >= 12)
SELECT site_id, last_ts, CAST(pos AS INTEGER) AS pos, {r6("x")} AS x FROM ends"""
_LINE_GHI = f"""{_lines({"g": ("GHI_rolling_mean_3", 0)}, ["g"])},
late AS (SELECT stacked.* FROM stacked, mid WHERE i >= 12 AND l3 IS NOT NULL AND epoch_us(ts) > m),
hours_fit AS ({" UNION ALL ".join(f"SELECT {h} AS step, regr_intercept(l{h}, meta_g) AS a, regr_slope(l{h}, meta_g) AS b FROM late" for h in (1, 2, 3))}),
lined AS (
  SELECT site_id, CAST(step AS INTEGER) AS step, ts + to_hours(CAST(step AS INTEGER)) AS ts,
    greatest((a + b * meta_g) * (qy[3] - qy[1]) + qy[2], 0e0) AS ghi
  FROM stacked, hours_fit WHERE i = rows AND rows >= 12)"""
SQL["linear_solar_3h"] = f"WITH {_LINE_GHI} SELECT site_id, step, ts, {r6('ghi')} AS ghi FROM lined"
_LINE_CON = f"""{history(HOUSES)}, {PROFILE},
lagged AS (
  SELECT site_id, ts, kw, coalesce(lag(kw, 1) OVER ({W}), first_value(kw) OVER ({W})) AS x1,
    coalesce(lag(kw, 24) OVER ({W}), first_value(kw) OVER ({W})) AS x2,
    row_number() OVER ({W}) AS no, row_number() OVER (PARTITION BY site_id ORDER BY ts DESC) AS back FROM series),
moments AS (
  SELECT var_pop(x1) AS v1, var_pop(x2) AS v2, covar_pop(x1, x2) AS v12, covar_pop(x1, kw) AS c1, covar_pop(x2, kw) AS c2,
    avg(x1) AS m1, avg(x2) AS m2, avg(kw) AS my FROM lagged),
plane AS (
  SELECT (c1 * v2 - c2 * v12) / (v1 * v2 - v12 * v12) AS b1, (c2 * v1 - c1 * v12) / (v1 * v2 - v12 * v12) AS b2, m1, m2, my FROM moments),
based AS (SELECT lagged.*, my + b1 * (x1 - m1) + b2 * (x2 - m2) AS base FROM lagged, plane),
spread AS (SELECT quantile_cont(kw - base, [0.25, 0.5, 0.75]) AS q FROM based),
errors AS (SELECT based.*, (kw - base - q[2]) / (q[3] - q[1]) AS e FROM based, spread),
after AS (SELECT *, lag(e) OVER ({W}) AS before FROM errors),
fix AS (SELECT regr_intercept(e, before) AS a, regr_slope(e, before) AS b FROM after WHERE no > 24),
day_before AS (SELECT site_id, 25 - back AS step, kw FROM based WHERE back <= 24),
steps AS (
  SELECT errors.site_id, last_ts, 0 AS step, errors.kw AS v, e FROM errors JOIN last_seen USING (site_id) WHERE back = 1
  UNION ALL
  SELECT n.site_id, n.last_ts, n.step, CASE WHEN greatest(raw, 0.01e0) <= 0.01e0 THEN p.kw ELSE raw END, e
  FROM (SELECT site_id, last_ts, step, base + greatest(e * (q[3] - q[1]) + q[2], -base) AS raw, e
    FROM (SELECT s.site_id, s.last_ts, s.step + 1 AS step, my + b1 * (s.v - m1) + b2 * (d.kw - m2) AS base, fix.a + fix.b * s.e AS e
      FROM steps s JOIN day_before d ON d.site_id = s.site_id AND d.step = s.step + 1, plane, fix), spread) n
  JOIN profile p ON p.site_id = n.site_id AND p.hour = (hour(n.last_ts) + n.step) % 24),
con AS (
  SELECT site_id, CAST(step AS INTEGER) AS step, last_ts + to_hours(CAST(step AS INTEGER)) AS ts, round(v + 1e-9, 4) AS kwh
  FROM steps WHERE step > 0)"""
SQL["linear_consumption_24h"] = f"WITH RECURSIVE {_LINE_CON} SELECT site_id, step, ts, {r6('kwh')} AS kwh FROM con"
_LINE_STATS = STATS.replace("sin(step * (demand + 1e0) + hour) * 2e0", "(SELECT a FROM score) + (SELECT b FROM score) * (hist_avg / 10e0)").replace(
    "scores AS (", f"""priced AS (SELECT *, row_number() OVER ({W}) AS no FROM conditions WHERE hist_avg IS NOT NULL),
followed AS (
  SELECT p.hist_avg, p.demand, q.hist_avg AS price FROM priced p JOIN priced q ON p.site_id = q.site_id AND q.no > p.no AND q.no <= p.no + 12),
score AS (SELECT regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM (SELECT ln({_SHARE} / (1e0 - {_SHARE})) AS y, hist_avg / 10e0 AS x FROM followed)),
scores AS (""", 1)
SQL["linear_tariff_12h"] = f"WITH {_LINE_STATS} SELECT site_id, step, hour, {r6('tariff')} AS tariff FROM tar"
SQL["fitted_decisions"] = f"""WITH RECURSIVE {_LINE_GHI}, {PANELS},
sol AS (
  SELECT lined.site_id, step, ts, round(ghi + 1e-9, 2) AS ghi_wm2,
    round(ghi * coalesce(area, 10e0) * coalesce(eff, 0.2e0) / 1000e0 + 1e-9, 4) AS energy_kwh FROM lined LEFT JOIN panels USING (site_id)),
{_LINE_CON}, {_LINE_STATS}, {DECISION}
SELECT site_id, {rounded({c: c for c in ("solar_1h", "energy_1h")})}, solar_label, CAST(has_solar + has_energy + has_tariff AS INTEGER) AS inputs_ready,
  CASE WHEN net > 0 THEN 'surplus' WHEN net <= 0 THEN 'deficit' END AS state,
  {rounded({"surplus_kwh": "CASE WHEN net > 0 THEN net END", "deficit_kwh": "CASE WHEN net <= 0 THEN -net END"})},
  CASE WHEN net > 0 THEN {ampm("hi_hour")} END AS sell_hour, {rounded({"max_tariff": "hi", "sell_revenue": "CASE WHEN net > 0 THEN net * hi END",
    "import_cost": "CASE WHEN net <= 0 THEN -net * next END"})}, CASE WHEN net <= 0 THEN {ampm("lo_hour")} END AS cheap_hour_label
FROM decided"""
_FULL = "CASE WHEN microsecond({0}) % 1000000 = 0 THEN strftime({0}, '%Y-%m-%d %H:%M:%S') ELSE strftime({0}, '%Y-%m-%d %H:%M:%S.%f') END"
SQL["solar_responses"] = f"""WITH {SOL}
SELECT site_id, '(12,3)' AS "window", {r6("round(sum(energy_kwh) OVER (PARTITION BY site_id) + 1e-9, 4)")} AS total_energy_kwh,
  {_FULL.format("(ts - to_hours(step))")} AS last_timestamp, coalesce(area, 10e0) AS panel_area_m2, {r6("coalesce(eff, 0.2e0)")} AS panel_efficiency,
  step, strftime(ts, {STAMP}) AS hour_label, {r6("ghi_wm2")} AS ghi_wm2, {r6("energy_kwh")} AS energy_kwh, category AS irradiance_category
FROM sol LEFT JOIN panels USING (site_id)"""
SQL["consumption_responses"] = f"""WITH {CON}
SELECT site_id, {r6("round(sum(kwh) OVER (PARTITION BY site_id) + 1e-9, 4)")} AS total_consumption_kwh,
  {_FULL.format("(ts - to_hours(step))")} AS last_timestamp, step, strftime(ts, {STAMP}) AS hour_label, {r6("kwh")} AS consumption_kwh FROM con"""
SQL["holdout_consumption"] = f"""WITH {HOUSES}, {hourly("raw", "full_hours")},
ends AS (SELECT *, max(ts) OVER (PARTITION BY site_id) - INTERVAL 24 HOUR AS cut FROM full_hours),
series AS (SELECT site_id, ts, kw FROM ends WHERE ts <= cut), {FORECAST},
before AS (SELECT site_id, arg_max(kw, ts) AS last FROM series GROUP BY site_id)
SELECT e.site_id, count(*) AS hours, {rounded({"error": "avg(abs(e.kw - con.kwh))", "error_last": "avg(abs(e.kw - before.last))",
  "error_yesterday": "avg(abs(e.kw - d.kw))"})}
FROM ends e JOIN con USING (site_id, ts) JOIN series d ON d.site_id = e.site_id AND d.ts = e.ts - INTERVAL 1 DAY
JOIN before ON before.site_id = e.site_id WHERE e.ts > e.cut GROUP BY e.site_id"""
SQL["tariff_defaults"] = f"""WITH {_PRICED},
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY ts DESC) AS back FROM conditions) WHERE back = 1)
SELECT c_custkey AS site_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS dow, CAST(month(ts) AS INTEGER) AS month,
  {rounded({"temperature": "round_even(least(55e0, greatest(-10e0, coalesce(CASE WHEN site_id % 3 > 0 THEN temperature * 3e0 - 30e0 END, 28e0))), 0)",
    "hist_avg": "coalesce(hist_avg, 6.5e0)", "demand": "0.5e0"})}
FROM customer LEFT JOIN last ON site_id = c_custkey"""
SQL["ml_solar_3h"] = f"""WITH {READINGS}
SELECT site_id, step, max(ts) + to_hours(step) AS ts, TRUE AS sound
FROM readings CROSS JOIN (SELECT CAST(unnest(range(1, 4)) AS INTEGER) AS step) s GROUP BY site_id, step HAVING count(*) >= 36"""
SQL["ml_consumption_24h"] = f"""WITH {history(HOUSES)}
SELECT site_id, step, max(ts) + to_hours(step) AS ts, TRUE AS sound
FROM series CROSS JOIN (SELECT CAST(unnest(range(1, 25)) AS INTEGER) AS step) s GROUP BY site_id, step"""
SQL["ml_tariff_12h"] = f"WITH {TAR} SELECT site_id, step, hour, TRUE AS sound FROM tar"
