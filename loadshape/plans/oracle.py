"""DuckDB twins of the check queries (the correctness oracle).

Written independently of the Spark code: plain per-site windows
(``PARTITION BY Site ORDER BY Timestamp_Local, row_id``), the exponentially
weighted means as a recursive CTE that repeats the recursion row by row.
Tables ``events`` etc. are views registered by the checker.
"""

from __future__ import annotations

from .. import config as C
from ..operators import features as FE
from .present import sql_present

S, TS, RID = '"Site"', '"Timestamp_Local"', "row_id"
TT, RR, PP = f'"{C.TEMP}"', f'"{C.RAD}"', f'"{C.POWER}"'
FL, CP = f'"{C.FLAG}"', f'"{C.CAP}"'

METER = f"""
m AS (
  SELECT 'Site' || chr(CAST(65 + user_id % 13 AS INT)) AS {S},
         event_id AS {RID},
         ts + to_days(CAST(user_id % 12 * 30 AS INT)) AS {TS},
         CASE WHEN event_id % 53 = 0 THEN NULL ELSE 5 + (event_id * 37 % 3000) / 100.0::DOUBLE END AS {TT},
         CASE WHEN event_id % 71 = 0 THEN NULL
              WHEN hour(ts) BETWEEN 6 AND 18 THEN CAST(event_id * 91 % 1000 AS DOUBLE) ELSE 0.0 END AS {RR},
         CASE WHEN event_id % 97 = 0 THEN NULL ELSE value * (1 + (user_id % 13) % 3) END AS {PP},
         CAST(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS INTEGER) AS {FL}
  FROM events
),
ml AS (
  SELECT *, CASE WHEN {FL} = 0 THEN 0.0 ELSE {FL} * {PP} * 0.25 END AS {CP} FROM m
)"""

ARCHETYPES = f"""
arch AS (
  SELECT {S}, avg({PP}) AS mean_power,
         CASE WHEN avg({PP}) > {C.ARCHETYPE_POWER_THRESHOLD} THEN 'large' ELSE 'small' END AS site_archetype
  FROM ml GROUP BY {S}
)"""

W = f"PARTITION BY {S} ORDER BY {TS}, {RID}"
SMALL, LARGE = "site_archetype = 'small'", "site_archetype = 'large'"


def fr(n: int) -> str:
    return f"(PARTITION BY {S} ORDER BY {TS}, {RID} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def flag(cond: str) -> str:
    return f"CAST(COALESCE({cond}, false) AS INTEGER)"


def state_sql(ts: str = TS) -> str:
    h, dow = f"hour({ts})", f"(isodow({ts}) - 1)"
    return (f"CASE WHEN {h} >= 8 AND {h} < 18 AND {dow} < 5 THEN 'Workday_Hours' "
            f"WHEN {dow} < 5 THEN 'Workday_OffHours' "
            f"WHEN {h} BETWEEN 8 AND 18 THEN 'Weekend_Day' ELSE 'Weekend_Night' END")


def _cyc(v: str, period: int, fn: str = "sin") -> str:
    return f"{fn}(2 * pi() * {v} / {float(period)})"


def row_local_sql() -> dict[str, str]:
    h, dow, mon, doy = "h", "dow", "mon", "dayofyear(" + TS + ")"
    wk = f"(CASE WHEN {dow} >= 5 THEN 1 ELSE 0 END)"
    work = flag(f"{h} >= 8 AND {h} < 18 AND {dow} < 5")
    hd = f"(CASE WHEN {TT} IS NULL THEN NULL ELSE greatest(0.0, {C.COMFORT_TEMP} - {TT}) END)"
    season = f"CAST(floor(({mon} % 12 + 3) / 3) AS INTEGER)"
    d = {
        "hour": h, "dayofweek": dow, "quarter": f"quarter({TS})", "month": mon,
        "dayofyear": doy, "is_weekend": wk,
        "heating_degree": hd,
        "cooling_degree": f"(CASE WHEN {TT} IS NULL THEN NULL ELSE greatest(0.0, {TT} - {C.COMFORT_TEMP}) END)",
        "temp_rad_interaction": f"{TT} * {RR}",
        "temp_squared": f"{TT} * {TT}",
        "is_business_hours": flag(f"{h} >= 7 AND {h} <= 18 AND {wk} = 0"),
        "is_peak_hours": flag(f"{h} >= 13 AND {h} <= 20"),
        "is_winter": flag(f"{mon} IN (6, 7, 8)"),
        "is_summer": flag(f"{mon} IN (12, 1, 2)"),
        "is_heating_likely": flag(f"{mon} IN (6, 7, 8) AND ({wk} = 1 OR {hd} > 0)"),
        "day_of_year_sin": _cyc(doy, 365), "day_of_year_cos": _cyc(doy, 365, "cos"),
        "is_lunch_hour": flag(f"{h} >= 12 AND {h} < 13 AND {wk} = 0"),
        "is_overnight": flag(f"{h} >= 22 OR {h} < 5"),
        "temp_deviation_from_comfort": f"abs({TT} - {C.COMFORT_TEMP})",
        "temp_x_hour_sin": f"{TT} * {_cyc(h, 24)}",
        "temp_x_hour_cos": f"{TT} * {_cyc(h, 24, 'cos')}",
        "day_of_month": f"day({TS})",
        "week_of_year": f"week({TS})",
        "time_of_day_minute": f"({h} * 60 + minute({TS}))",
        "time_of_day_fraction": f"({h} * 60 + minute({TS})) / 1440.0::DOUBLE",
        "hour_sin": _cyc(h, 24), "hour_cos": _cyc(h, 24, "cos"),
        "day_of_week_sin": _cyc(dow, 7), "day_of_week_cos": _cyc(dow, 7, "cos"),
        "month_sin": _cyc(mon, 12), "month_cos": _cyc(mon, 12, "cos"),
        "is_weekday": flag(f"{dow} < 5"),
        "is_work_hours": work,
        "is_morning_ramp_up": flag(f"{h} >= 6 AND {h} < 9 AND {wk} = 0"),
        "is_evening_ramp_down": flag(f"{h} >= 17 AND {h} < 20 AND {wk} = 0"),
        "hour_of_week": f"({dow} * 24 + {h})",
        "is_first_work_hour": flag(f"{h} = 8 AND {wk} = 0"),
        "is_last_work_hour": flag(f"{h} = 17 AND {wk} = 0"),
        "season": season,
        "temp_cubed": f"{TT} * {TT} * {TT}",
        "radiation_is_zero": flag(f"{RR} = 0"),
        "radiation_sqrt": f"(CASE WHEN {RR} >= 0 THEN sqrt({RR}) END)",
        "is_mild_temp_workday": flag(f"{TT} > 19 AND {TT} < 23 AND {work} = 1"),
        "is_extreme_heat_workday": flag(f"{TT} > 30 AND {work} = 1"),
        "is_extreme_cold_workday": flag(f"{TT} < 10 AND {work} = 1"),
        "temp_x_is_work_hours": f"{TT} * {work}",
        "temp_x_is_weekend": f"{TT} * {wk}",
        "rad_x_is_work_hours": f"{RR} * {work}",
        "rad_x_is_weekend": f"{RR} * {wk}",
        "rad_x_hour_sin": f"{RR} * {_cyc(h, 24)}",
        "rad_x_hour_cos": f"{RR} * {_cyc(h, 24, 'cos')}",
        "effective_temp_load": f"{TT} + 0.01 * {RR}",
        "temp_x_season": f"{TT} * {season}",
        "temp_x_month_sin": f"{TT} * {_cyc(mon, 12)}",
        "temp_x_month_cos": f"{TT} * {_cyc(mon, 12, 'cos')}",
        "temp_bins_cold": flag(f"{TT} <= 10"),
        "temp_bins_mild": flag(f"{TT} > 10 AND {TT} <= 18"),
        "temp_bins_warm": flag(f"{TT} > 18 AND {TT} <= 25"),
        "temp_bins_hot": flag(f"{TT} > 25"),
        "archetype_small": flag(SMALL),
        "archetype_large": flag(LARGE),
        "archetype_small_temp_interaction": f"{flag(SMALL)} * {TT}",
        "archetype_small_power_interaction": f"{flag(SMALL)} * {PP}",
        "archetype_large_temp_interaction": f"{flag(LARGE)} * {TT}",
        "archetype_large_power_interaction": f"{flag(LARGE)} * {PP}",
    }
    for s in C.OCCUPANCY_STATES:
        d[f"state_{s}"] = flag(f"st = '{s}'")
    return d


def _moment(kind: str, n: int) -> str:
    """From the frame's deviations from their mean, so that no power sums cancel."""
    f = fr(n)
    k = f"count({PP}) OVER {f}"
    const = "0.0" if kind == "skewness" else "-3.0"
    power = lambda p: f"list_sum(list_transform(d, lambda e: {' * '.join(['e'] * p)}))"
    c = "len(d)::DOUBLE"
    if kind == "skewness":
        value = f"{c} * sqrt({c} - 1) / ({c} - 2) * {power(3)} / pow({power(2)}, 1.5)"
    else:
        value = f"({c} - 1) / (({c} - 2) * ({c} - 3)) * (({c} + 1) * ({c} * {power(4)} / pow({power(2)}, 2) - 3) + 6)"
    away = "list_transform(list_filter(v, lambda x: x IS NOT NULL), lambda x: x - list_avg(v))"
    return (f"(CASE WHEN {k} < 4 THEN NULL "
            f"WHEN min({PP}) OVER {f} = max({PP}) OVER {f} THEN {const} "
            f"WHEN var_pop({PP}) OVER {f} <= 1e-14 THEN NULL "
            f"ELSE list_transform([list({PP}) OVER {f}], lambda v: list_transform([{away}], lambda d: {value})[1])[1] END)")


def window_sql() -> dict[str, str]:
    d: dict[str, str] = {}
    for k in C.LAGS:
        d[f"power_lag_{k}"] = f"lag({PP}, {k}) OVER ({W})"
        d[f"temp_lag_{k}"] = f"lag({TT}, {k}) OVER ({W})"
    for n in C.POWER_ROLL_FULL:
        f = fr(n)
        d[f"power_roll_mean_{n}"] = f"(CASE WHEN count({PP}) OVER {f} >= {n} THEN avg({PP}) OVER {f} END)"
        d[f"power_roll_std_{n}"] = f"(CASE WHEN count({PP}) OVER {f} >= {n} THEN stddev_samp({PP}) OVER {f} END)"
    d["power_cumsum_4"] = f"(CASE WHEN count({PP}) OVER {fr(4)} >= 4 THEN sum({PP}) OVER {fr(4)} END)"
    for dd in C.POWER_DIFFS:
        d[f"power_diff_{dd}"] = f"{PP} - lag({PP}, {dd}) OVER ({W})"
    for dd in C.TEMP_RAD_DIFFS:
        d[f"temp_diff_{dd}"] = f"{TT} - lag({TT}, {dd}) OVER ({W})"
        d[f"rad_diff_{dd}"] = f"{RR} - lag({RR}, {dd}) OVER ({W})"
    f4 = fr(C.SLOPE_WINDOW)
    d["power_slope_4"] = f"(CASE WHEN count({PP}) OVER {f4} >= 2 THEN regr_slope({PP}, idx) OVER {f4} END)"
    for n in C.TEMP_ROLL_PARTIAL:
        d[f"temp_roll_mean_{n}"] = f"avg({TT}) OVER {fr(n)}"
        d[f"temp_roll_std_{n}"] = f"stddev_samp({TT}) OVER {fr(n)}"
    for n in C.TEMP_ROLL_MINMAX:
        d[f"temp_roll_min_{n}"] = f"min({TT}) OVER {fr(n)}"
        d[f"temp_roll_max_{n}"] = f"max({TT}) OVER {fr(n)}"
        d[f"temp_roll_range_{n}"] = f"max({TT}) OVER {fr(n)} - min({TT}) OVER {fr(n)}"
    for n in C.POWER_ROLL_MINMAX:
        d[f"power_roll_min_{n}"] = f"min({PP}) OVER {fr(n)}"
        d[f"power_roll_max_{n}"] = f"max({PP}) OVER {fr(n)}"
        d[f"power_roll_median_{n}"] = f"median({PP}) OVER {fr(n)}"
    for n in C.MOMENT_WINDOWS:
        d[f"power_roll_skew_{n}"] = _moment("skewness", n)
        d[f"power_roll_kurt_{n}"] = _moment("kurtosis", n)
    for n in C.ROLL_SUM_WINDOWS:
        d[f"power_roll_sum_{n}"] = f"sum({PP}) OVER {fr(n)}"
        d[f"temp_roll_sum_{n}"] = f"sum({TT}) OVER {fr(n)}"
        d[f"rad_roll_sum_{n}"] = f"sum({RR}) OVER {fr(n)}"
    n = C.PERCENTILE_WINDOW
    d[f"power_percentile_{n}"] = (
        f"(CASE WHEN count({PP}) OVER {fr(n)} >= 4 THEN "
        f"len(list_filter(list({PP}) OVER {fr(n)}, lambda v: v >= {PP})) / CAST(count(*) OVER {fr(n)} AS DOUBLE) END)")
    d["_pf"] = f"last_value({PP} IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    d["_st_lag"] = f"lag(st) OVER ({W})"
    d["is_work_hours_lag"] = f"lag(is_work_hours) OVER ({W})"
    return d


def stage3_sql() -> dict[str, str]:
    d: dict[str, str] = {}
    for dd in C.POWER_DIFFS:
        d[f"power_pct_change_{dd}"] = (
            f"(CASE WHEN lag(_pf, {dd}) OVER ({W}) = 0 THEN NULL ELSE _pf / lag(_pf, {dd}) OVER ({W}) - 1 END)")
    d["state_changed"] = "(CASE WHEN _st_lag IS NULL OR st <> _st_lag THEN 1 ELSE 0 END)"
    d["_last_change"] = (f"max(CASE WHEN _st_lag IS NULL OR st <> _st_lag THEN idx END) "
                         f"OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    return d


def stage4_sql() -> dict[str, str]:
    d = {
        "power_vs_roll_mean_96": f"{PP} - power_roll_mean_96",
        "temp_x_power_lag_96": f"{TT} * power_lag_96",
        "is_transition_to_work": flag("is_work_hours = 1 AND is_work_hours_lag = 0"),
        "is_transition_from_work": flag("is_work_hours = 0 AND is_work_hours_lag = 1"),
        "time_since_last_transition": "idx - _last_change",
        "hour_x_power_roll_mean_24": "hour * power_roll_mean_24",
        "power_lag_96_x_dayofweek": "power_lag_96 * dayofweek",
        "rad_x_power_lag_96": f"{RR} * power_lag_96",
        "temp_x_power_roll_mean_12": f"{TT} * power_roll_mean_12",
        "power_vs_daily_avg": f"{PP} / (power_roll_mean_96 + {C.EPS})",
        "power_vs_daily_max": f"{PP} / (power_roll_max_96 + {C.EPS})",
    }
    for n in C.ZSCORE_WINDOWS:
        d[f"power_zscore_{n}"] = f"({PP} - power_roll_mean_{n}) / (power_roll_std_{n} + {C.EPS})"
    return d


def ewm_sql(source: str = "b") -> str:
    """Recursive CTE: the weighted-mean recursion, one row per step."""
    specs = [(f"power_ewm_span_{s}", PP, s) for s in C.EWM_SPANS] + \
            [(f"temp_ewm_span_{s}", TT, s) for s in C.EWM_SPANS]
    init = ", ".join(f"{src} AS y{i}, 1.0::DOUBLE AS w{i}" for i, (_, src, _) in enumerate(specs))
    steps = []
    for i, (_, src, span) in enumerate(specs):
        a = 1.0 / (1.0 + (span - 1) / 2.0)
        keep = 1.0 - a
        y, w = f"r.y{i}", f"r.w{i}"
        dec = f"({w} * {keep!r}::DOUBLE)"
        steps.append(
            f"CASE WHEN {y} IS NULL THEN x.{src} "
            f"WHEN x.{src} IS NULL THEN {y} "
            f"WHEN {y} = x.{src} THEN {y} "
            f"ELSE ({dec} * {y} + {a!r}::DOUBLE * x.{src}) / ({dec} + {a!r}::DOUBLE) END AS y{i}")
        steps.append(
            f"CASE WHEN {y} IS NULL THEN {w} "
            f"WHEN x.{src} IS NULL THEN {dec} ELSE 1.0::DOUBLE END AS w{i}")
    outs = ", ".join(f"y{i} AS {name}" for i, (name, _, _) in enumerate(specs))
    return f"""
ewm_rec({S}, idx, {', '.join(f'y{i}, w{i}' for i in range(len(specs)))}) AS (
  SELECT {S}, idx, {init} FROM {source} WHERE idx = 0
  UNION ALL
  SELECT x.{S}, x.idx, {', '.join(steps)}
  FROM ewm_rec r JOIN {source} x ON x.{S} = r.{S} AND x.idx = r.idx + 1
),
ewm AS (SELECT {S}, idx, {outs} FROM ewm_rec)"""


def features_core(names: list[str], where: str | None = None) -> str:
    """CTE chain ending in ``f4`` (every meter row with all stage columns)
    and, when EWM columns are asked for, ``f5`` = f4 joined with them."""
    local, win, s3, s4 = row_local_sql(), window_sql(), stage3_sql(), stage4_sql()
    need_ewm = any("ewm" in n for n in names)
    base_filter = f"WHERE {where}" if where else ""
    local_cols = ",\n    ".join(f'{e} AS "{n}"' for n, e in local.items())
    win_cols = ",\n    ".join(f'{e} AS "{n}"' for n, e in win.items())
    s3_cols = ",\n    ".join(f'{e} AS "{n}"' for n, e in s3.items())
    s4_cols = ",\n    ".join(f'{e} AS "{n}"' for n, e in s4.items())
    ewm_part = ewm_sql("b") + "," if need_ewm else ""
    ewm_join = f"LEFT JOIN ewm USING ({S}, idx)" if need_ewm else ""
    return f"""WITH RECURSIVE {METER},
{ARCHETYPES},
b0 AS (
  SELECT ml.*, arch.site_archetype FROM ml LEFT JOIN arch USING ({S}) {base_filter}
),
b AS (
  SELECT *, row_number() OVER ({W}) - 1 AS idx, {state_sql()} AS st,
         hour({TS}) AS h, isodow({TS}) - 1 AS dow, month({TS}) AS mon
  FROM b0
),
{ewm_part}
f1 AS (
  SELECT *,
    {local_cols}
  FROM b
),
f2 AS (
  SELECT *,
    {win_cols}
  FROM f1
),
f3 AS (
  SELECT *,
    {s3_cols}
  FROM f2
),
f4 AS (
  SELECT f3.*,
    {s4_cols}
  FROM f3
),
f5 AS (SELECT * FROM f4 {ewm_join})"""


def features_sql(names: list[str], keys: list[str] | None = None,
                 decimals: dict[str, int] | None = None, where: str | None = None) -> str:
    """SQL computing the given features for every meter row, output columns
    ``keys`` + names (presented)."""
    keys = keys or ["Site", "row_id"]
    decimals = decimals or {}
    kinds = FE.feature_kinds()
    key_sql = ", ".join(f'"{k}"' for k in keys)
    out = ", ".join([key_sql] + [sql_present(n, kinds.get(n, "double"), decimals.get(n, 6)) for n in names])
    return f"""{features_core(names, where)}
SELECT {out}
FROM f5"""


def features_sql_raw(names: list[str], where: str | None = None) -> str:
    """CTE chain ending in ``feats``: raw readings + the named features."""
    cols = ", ".join(f'"{n}"' for n in list(C.RAW_NUMERIC) + list(names))
    return f"""{features_core(names, where)},
feats AS (SELECT {cols} FROM f5)"""
