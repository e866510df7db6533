"""DuckDB twins of the selection, split, blend and metric checks."""

from __future__ import annotations

from .. import config as C
from ..operators import features as FE
from ..operators.selection import correlation_candidates
from . import oracle as O
from .present import sql_round

S, TS, RID, TT, RR, PP, FL, CP = O.S, O.TS, O.RID, O.TT, O.RR, O.PP, O.FL, O.CP


def temporal_split_sql() -> str:
    return f"""WITH {O.METER},
cut AS (SELECT max({TS}) - INTERVAL {C.VALIDATION_DAYS} DAY AS c FROM ml)
SELECT {S}, CAST(sum(CASE WHEN {TS} < cut.c THEN 1 ELSE 0 END) AS BIGINT) AS n_fit,
       CAST(sum(CASE WHEN {TS} >= cut.c THEN 1 ELSE 0 END) AS BIGINT) AS n_validation
FROM ml, cut GROUP BY {S}"""


def class_weights_sql() -> str:
    return f"""WITH {O.METER},
c AS (SELECT CAST({FL} + 1 AS DOUBLE) AS label, count(*) AS n FROM ml GROUP BY 1)
SELECT {sql_round('label')} AS label, CAST(n AS BIGINT) AS n,
       {sql_round('(SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n)')} AS class_weight
FROM c"""


def archetype_subsets_sql() -> str:
    return f"""WITH {O.METER}, {O.ARCHETYPES}
SELECT site_archetype, CAST(count(DISTINCT {S}) AS BIGINT) AS n_sites, CAST(count(*) AS BIGINT) AS n_rows
FROM ml JOIN arch USING ({S}) GROUP BY site_archetype"""


def _corr_sql(source: str, level: str) -> str:
    cands = correlation_candidates()
    pairs = [f'corr(CAST("{cands[i]}" AS DOUBLE), CAST("{cands[j]}" AS DOUBLE)) AS "{i}|{j}"'
             for i in range(len(cands)) for j in range(i + 1, len(cands))]
    return f"""
agg AS (SELECT {level} AS level, {', '.join(pairs)} FROM {source} GROUP BY 1),
long AS (SELECT * FROM agg UNPIVOT INCLUDE NULLS (r FOR pair IN (COLUMNS(* EXCLUDE (level))))),
parsed AS (SELECT level, CAST(split_part(pair, '|', 1) AS INTEGER) AS i,
                  CAST(split_part(pair, '|', 2) AS INTEGER) AS j,
                  CASE WHEN r IS NULL OR isnan(r) THEN NULL ELSE least(abs(r), 1.0) END AS r FROM long)"""


def _named_pairs() -> str:
    names = ", ".join(f"'{c}'" for c in correlation_candidates())
    return f"[{names}][i + 1] AS feature_i, [{names}][j + 1] AS feature_j, {sql_round('r')} AS abs_corr"


def corr_pairs_sql() -> str:
    base = O.features_sql_raw(FE.BASELINE)
    return f"{base},{_corr_sql('feats', chr(39) + 'all' + chr(39))}\nSELECT {_named_pairs()} FROM parsed"


def corr_levels_sql() -> str:
    return f"""{O.features_core(FE.BASELINE)},
leveled AS (SELECT *, unnest(['all', site_archetype]) AS at_level FROM f5),{_corr_sql('leveled', 'at_level')}
SELECT level, {_named_pairs()} FROM parsed"""


def corr_drops_sql() -> str:
    body = corr_pairs_sql()
    return f"""WITH pairs AS ({body})
SELECT DISTINCT feature_j AS feature FROM pairs WHERE abs_corr > {C.CORR_THRESHOLD}"""


def edited_features_sql(out: list[str], extra: list[str]) -> str:
    cands = correlation_candidates()
    cand_rows = ", ".join(f"({k}, '{c}')" for k, c in enumerate(cands))
    remove = ", ".join(f"'{c}'" for c in out + C.ALWAYS_DROP)
    add_rows = ", ".join(f"({1000 + k}, '{c}')" for k, c in enumerate(dict.fromkeys(extra)))
    body = corr_pairs_sql()
    return f"""WITH pairs AS ({body}),
dropped AS (SELECT DISTINCT feature_j AS feature FROM pairs WHERE abs_corr > {C.CORR_THRESHOLD}),
cand(pos, feature) AS (VALUES {cand_rows}),
kept AS (SELECT pos, feature FROM cand
         WHERE feature NOT IN (SELECT feature FROM dropped) AND feature NOT IN ({remove})),
added(pos, feature) AS (VALUES {add_rows}),
lst AS (SELECT * FROM kept UNION ALL SELECT * FROM added WHERE feature NOT IN (SELECT feature FROM kept))
SELECT CAST(row_number() OVER (ORDER BY pos) - 1 AS BIGINT) AS position, feature FROM lst"""


def regressor_inputs_sql(names: list[str]) -> str:
    counts = ", ".join(f'count("{n}") AS "{n}"' for n in names)
    order = ", ".join(f"'{n}'" for n in names)
    made = [n for n in names if n not in C.RAW_NUMERIC]
    return f"""{O.features_sql_raw(made)},
agg AS (SELECT {counts} FROM feats)
SELECT CAST(list_position([{order}], feature) - 1 AS BIGINT) AS position, feature, CAST(n AS BIGINT) AS n_present
FROM (UNPIVOT agg ON COLUMNS(*) INTO NAME feature VALUE n)"""


def imputation_values_sql(names: list[str]) -> str:
    made = [n for n in names if n not in C.RAW_NUMERIC]
    rows = " UNION ALL ".join(
        f"""SELECT '{n}' AS feature, {sql_round(f'quantile_disc(CAST("{n}" AS DOUBLE), 0.5)')} AS median FROM feats"""
        for n in names)
    return f"{O.features_sql_raw(made)}\n{rows}"


def event_rows_sql() -> str:
    return f"""WITH {O.METER}
SELECT {S}, {RID}, CAST({FL} AS BIGINT) AS {FL}, {sql_round(CP)} AS {CP} FROM ml WHERE {FL} <> 0"""


def aligned_test_sql(holdout_days: int = 61) -> str:
    return f"""WITH {O.METER}, cut AS (SELECT max({TS}) - INTERVAL {holdout_days} DAY AS c FROM ml)
SELECT {S}, {RID}, {TS}, {sql_round(TT)} AS {TT}, {sql_round(RR)} AS {RR}, {sql_round(PP)} AS {PP},
       CAST(0 AS BIGINT) AS {FL}, CAST(0 AS BIGINT) AS {CP}
FROM ml, cut WHERE {TS} >= cut.c"""


def submission_order_sql() -> str:
    return f"""{profile_core_sql()}
SELECT {S}, {TS}, {RID}, CAST(row_number() OVER (ORDER BY {S}, {TS}, {RID}) - 1 AS BIGINT) AS position FROM sub"""


def _profile_level(src: str, extra: str, name: str) -> str:
    """Two-family profile level over test rows ``src`` trained on ``tr{extra}``."""
    keys_a = f"{extra}slot_a" if not extra else f"site_archetype, slot_a"
    keys_b = f"{extra}slot_b" if not extra else f"site_archetype, slot_b"
    train = "tr" if not extra else "tra"
    using_a = "slot_a" if not extra else "site_archetype, slot_a"
    using_b = "slot_b" if not extra else "site_archetype, slot_b"
    prob = (f"[(sum(CASE WHEN {FL} = -1 THEN 1 ELSE 0 END) + 1) / (count(*) + 3), "
            f"(sum(CASE WHEN {FL} = 0 THEN 1 ELSE 0 END) + 1) / (count(*) + 3), "
            f"(sum(CASE WHEN {FL} = 1 THEN 1 ELSE 0 END) + 1) / (count(*) + 3)]")
    cap = f"coalesce(avg(CASE WHEN {FL} <> 0 THEN {CP} END), 0.0)"
    uni = "[1.0::DOUBLE / 3.0::DOUBLE, 1.0::DOUBLE / 3.0::DOUBLE, 1.0::DOUBLE / 3.0::DOUBLE]"
    return f"""
{name}_pa AS (SELECT {keys_a}, {prob} AS p, {cap} AS c FROM {train} GROUP BY {keys_a}),
{name}_pb AS (SELECT {keys_b}, {prob} AS p, {cap} AS c FROM {train} GROUP BY {keys_b}),
{name}_1 AS (
  SELECT s.{S}, s.{RID}, s.{TS},
         coalesce(a.p, {uni}) AS pa, coalesce(a.c, 0.0) AS ca,
         coalesce(b.p, {uni}) AS pb, coalesce(b.c, 0.0) AS cb
  FROM {src} s LEFT JOIN {name}_pa a USING ({using_a}) LEFT JOIN {name}_pb b USING ({using_b})
),
{name}_2 AS (
  SELECT {S}, {RID}, {TS},
         [0.7 * pa[1] + 0.3 * pb[1], 0.7 * pa[2] + 0.3 * pb[2], 0.7 * pa[3] + 0.3 * pb[3]] AS p,
         0.7 * ca + 0.3 * cb AS craw
  FROM {name}_1
),
{name} AS (
  SELECT {S}, {RID}, {TS}, p,
         CASE WHEN list_position(p, list_max(p)) - 1 <> 1 THEN craw ELSE 0.0 END AS cap
  FROM {name}_2
)"""


def profile_core_sql(holdout_days: int = 61, trained_on: str | None = None) -> str:
    """``trained_on``: archetype whose sites alone have training rows."""
    only = f" AND {S} IN (SELECT {S} FROM arch WHERE site_archetype = '{trained_on}')" if trained_on else ""
    slot = f"(isodow({TS}) - 1) * 24 + hour({TS}) AS slot_a, hour({TS}) AS slot_b"
    return f"""WITH {O.METER},
cut AS (SELECT max({TS}) - INTERVAL {holdout_days} DAY AS c FROM ml),
te AS (SELECT ml.* EXCLUDE ({FL}, {CP}), {slot} FROM ml, cut WHERE {TS} >= cut.c),
truth AS (SELECT {S}, {RID}, {FL}, {CP} FROM ml, cut WHERE {TS} >= cut.c),
arch AS (SELECT {S}, CASE WHEN avg({PP}) > {C.ARCHETYPE_POWER_THRESHOLD} THEN 'large' ELSE 'small' END AS site_archetype
         FROM te GROUP BY {S}),
tr AS (SELECT ml.*, {slot} FROM ml, cut WHERE {TS} < cut.c{only}),
tra AS (SELECT tr.*, arch.site_archetype FROM tr JOIN arch USING ({S})),
tea AS (SELECT te.*, arch.site_archetype FROM te JOIN arch USING ({S})
        WHERE arch.site_archetype IN (SELECT site_archetype FROM tra)),
{_profile_level('te', '', 'g')},
{_profile_level('tea', 'x', 'x')},
mrg AS (
  SELECT g.{S}, g.{RID}, g.{TS}, g.p AS pg, g.cap AS cg,
         coalesce(x.p, g.p) AS pa, coalesce(x.cap, g.cap) AS ca
  FROM g LEFT JOIN x USING ({S}, {RID})
),
fin AS (
  SELECT {S}, {RID}, {TS},
         [0.9 * pg[1] + 0.1 * pa[1], 0.9 * pg[2] + 0.1 * pa[2], 0.9 * pg[3] + 0.1 * pa[3]] AS p,
         0.9 * cg + 0.1 * ca AS cap
  FROM mrg
),
sub AS (
  SELECT {S}, {RID}, {TS}, CAST(list_position(p, list_max(p)) - 2 AS INTEGER) AS {FL},
         CASE WHEN list_position(p, list_max(p)) - 2 = 0 THEN 0.0 ELSE cap END AS {CP}
  FROM fin
)"""


def profile_submission_sql(trained_on: str | None = None) -> str:
    return f"""{profile_core_sql(trained_on=trained_on)}
SELECT {S}, {TS}, CAST({FL} AS BIGINT) AS {FL}, {sql_round(CP)} AS {CP} FROM sub"""


def confusion_sql() -> str:
    return f"""{profile_core_sql()}
SELECT CAST(t.{FL} AS BIGINT) AS true_flag, CAST(s.{FL} AS BIGINT) AS pred_flag, CAST(count(*) AS BIGINT) AS n
FROM sub s JOIN truth t USING ({S}, {RID}) GROUP BY 1, 2"""


def classification_scores_sql() -> str:
    return f"""{profile_core_sql()},
conf AS (SELECT t.{FL} AS tf, s.{FL} AS pf, count(*) AS n FROM sub s JOIN truth t USING ({S}, {RID}) GROUP BY 1, 2),
cls AS (SELECT tf AS c FROM conf UNION SELECT pf FROM conf),
pc AS (
  SELECT c,
         coalesce((SELECT sum(n) FROM conf WHERE tf = c AND pf = c), 0) AS tp,
         coalesce((SELECT sum(n) FROM conf WHERE tf = c), 0) AS nt,
         coalesce((SELECT sum(n) FROM conf WHERE pf = c), 0) AS np
  FROM cls
),
sc AS (
  SELECT c, CASE WHEN nt > 0 THEN tp / nt ELSE 0.0 END AS rec,
            CASE WHEN np > 0 THEN tp / np ELSE 0.0 END AS pre FROM pc
),
f AS (SELECT c, rec, pre, CASE WHEN rec + pre > 0 THEN 2 * rec * pre / (rec + pre) ELSE 0.0 END AS f1 FROM sc)
SELECT {sql_round('CASE WHEN min(rec) > 0 THEN exp(avg(ln(rec))) ELSE 0.0 END')} AS g_mean,
       {sql_round('avg(f1)')} AS macro_f1, CAST(count(*) AS BIGINT) AS n_classes
FROM f"""


def regression_errors_sql() -> str:
    return f"""{profile_core_sql()},
e AS (SELECT s.{CP} - t.{CP} AS e, t.{CP} AS a FROM sub s JOIN truth t USING ({S}, {RID})
      WHERE s.{CP} IS NOT NULL AND t.{CP} IS NOT NULL),
em AS (SELECT avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(abs(a)) AS maa, count(*) AS n FROM e)
SELECT {sql_round('mae')} AS mae, {sql_round('rmse')} AS rmse, {sql_round('maa')} AS mean_abs_actual,
       CAST(n AS BIGINT) AS n,
       {sql_round('CASE WHEN maa = 0 THEN NULL ELSE mae / maa END')} AS nmae,
       {sql_round('CASE WHEN maa = 0 THEN NULL ELSE rmse / maa END')} AS nrmse
FROM em"""


def tree_walk_sql(scores: list[str]) -> str:
    """Every test row is scored; none differs."""
    none = ", ".join(f"CAST(0 AS BIGINT) AS mismatches{c}" for c in scores)
    return f"{profile_core_sql()}\nSELECT {S}, count(*) AS n_rows, {none} FROM tea GROUP BY {S}"


def _folds(source: str, n_splits: int) -> str:
    """Fold 0 takes what is left when the others have equal sizes."""
    return f"""SELECT *, greatest(0, {n_splits} - (n - p) // (n // {n_splits + 1}))::BIGINT AS fold
FROM (SELECT *, row_number() OVER (ORDER BY {TS}, {S}, {RID}) AS p, count(*) OVER () AS n FROM {source})"""


def time_folds_sql(n_splits: int = 3) -> str:
    return f"WITH {O.METER}, folded AS ({_folds('ml', n_splits)}) SELECT {S}, {RID}, fold FROM folded"


def fold_medians_sql(names: list[str], n_splits: int = 3) -> str:
    made = [n for n in names if n not in C.RAW_NUMERIC]
    rows = " UNION ALL ".join(
        f"""SELECT {k} AS fold, '{n}' AS feature, {sql_round(f'quantile_disc(CAST("{n}" AS DOUBLE), 0.5)')} AS median
FROM folded WHERE fold < {k}""" for n in names for k in range(1, n_splits + 1))
    return f"{O.features_core(made)}, folded AS ({_folds('f5', n_splits)})\n{rows}"


def calibration_points_sql() -> str:
    """Isotonic fit by its min-max formula: the greatest, over starts up to a
    point, of the least mean, over ends from it on."""
    return f"""{profile_core_sql()},
pts AS (SELECT {sql_round('g_2.craw')} AS x, count(*) AS n, sum(t.{CP}) AS total
        FROM g_2 JOIN truth t USING ({S}, {RID}) WHERE t.{FL} <> 0 AND t.{CP} IS NOT NULL GROUP BY 1),
cum AS (SELECT x, n, row_number() OVER w AS k, sum(n) OVER w AS cn, sum(total) OVER w AS ct, total FROM pts WINDOW w AS (ORDER BY x)),
spans AS (SELECT a.k AS a, b.k AS b, (b.ct - a.ct + a.total) / (b.cn - a.cn + a.n) AS mean FROM cum a JOIN cum b ON a.k <= b.k),
least AS (SELECT a, b AS k, min(mean) OVER (PARTITION BY a ORDER BY b DESC) AS m FROM spans),
fit AS (SELECT k, max(m) AS fitted FROM least GROUP BY k)
SELECT {sql_round('x')} AS x, CAST(n AS BIGINT) AS n, {sql_round('fitted')} AS fitted FROM cum JOIN fit USING (k)"""
