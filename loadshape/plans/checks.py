"""Check queries: one per operator family of the survey, each reading the
shared test tables through the meter view, with a DuckDB twin in
``oracle.py`` where SQL can express it.

Feature checks run the production path (halo-blocked windows) over the
whole meter table, every row, and present the family's columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..operators.archetypes import ARCH, attach_archetype, site_archetypes
from ..operators.blocking import blocked_features
from ..operators import features as FE
from ..operators import metrics as M
from ..operators import selection as SEL
from ..operators import split as SP
from ..session import cut_lineage, ensure_checkpoint_dir, written
from ..sources.meter import SUBMISSION_ORDER, load_meter_csv, meter_view, read_meter_csv, time_holdout, with_position
from . import oracle as O
from . import oracle_plans as OP
from .present import present, sql_round
from .profile import profile_submission

# Feature families (survey section 2.3/2.4 rows).
FAMILIES: dict[str, list[str]] = {
    "calendar_features": [
        "hour", "dayofweek", "quarter", "month", "dayofyear", "is_weekend", "day_of_month",
        "week_of_year", "time_of_day_minute", "time_of_day_fraction", "hour_sin", "hour_cos",
        "day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos", "day_of_year_sin",
        "day_of_year_cos", "is_weekday", "is_work_hours", "is_business_hours", "is_peak_hours",
        "is_morning_ramp_up", "is_evening_ramp_down", "is_first_work_hour", "is_last_work_hour",
        "is_lunch_hour", "is_overnight", "is_winter", "is_summer", "season", "hour_of_week",
        "state_Weekend_Day", "state_Weekend_Night", "state_Workday_Hours", "state_Workday_OffHours"],
    "weather_features": [
        "heating_degree", "cooling_degree", "temp_rad_interaction", "temp_squared", "temp_cubed",
        "is_heating_likely", "temp_deviation_from_comfort", "temp_bins_cold", "temp_bins_mild",
        "temp_bins_warm", "temp_bins_hot", "radiation_is_zero", "radiation_sqrt",
        "is_mild_temp_workday", "is_extreme_heat_workday", "is_extreme_cold_workday",
        "temp_x_hour_sin", "temp_x_hour_cos", "temp_x_is_work_hours", "temp_x_is_weekend",
        "rad_x_is_work_hours", "rad_x_is_weekend", "rad_x_hour_sin", "rad_x_hour_cos",
        "effective_temp_load", "temp_x_season", "temp_x_month_sin", "temp_x_month_cos"],
    "archetype_features": [
        "archetype_small", "archetype_large", "archetype_small_temp_interaction",
        "archetype_small_power_interaction", "archetype_large_temp_interaction",
        "archetype_large_power_interaction"],
    "lag_features": [f"{v}_lag_{k}" for k in C.LAGS for v in ("power", "temp")],
    "diff_features": [f"power_diff_{d}" for d in C.POWER_DIFFS]
                     + [f"temp_diff_{d}" for d in C.TEMP_RAD_DIFFS]
                     + [f"rad_diff_{d}" for d in C.TEMP_RAD_DIFFS],
    "power_rolling_full": [f"power_roll_{s}_{n}" for n in C.POWER_ROLL_FULL for s in ("mean", "std")]
                          + ["power_cumsum_4", "power_vs_roll_mean_96", "power_vs_daily_avg",
                             "power_vs_daily_max", "power_zscore_24", "power_zscore_96"],
    "temp_rolling_partial": [f"temp_roll_{s}_{n}" for n in C.TEMP_ROLL_PARTIAL for s in ("mean", "std")]
                            + [f"temp_roll_{s}_{n}" for n in C.TEMP_ROLL_MINMAX
                               for s in ("min", "max", "range")],
    "power_rolling_order": [f"power_roll_{s}_{n}" for n in C.POWER_ROLL_MINMAX
                            for s in ("min", "max", "median")],
    "rolling_sums": [f"{v}_roll_sum_{n}" for n in C.ROLL_SUM_WINDOWS for v in ("power", "temp", "rad")],
    "rolling_moments": [f"power_roll_{s}_{n}" for n in C.MOMENT_WINDOWS for s in ("skew", "kurt")],
    "rolling_slope": ["power_slope_4"],
    "rolling_percentile": ["power_percentile_96"],
    "pct_change": [f"power_pct_change_{d}" for d in C.POWER_DIFFS],
    "ewm_features": [f"{v}_ewm_span_{s}" for s in C.EWM_SPANS for v in ("power", "temp")],
    "state_transitions": ["state_changed", "is_work_hours_lag", "is_transition_to_work",
                          "is_transition_from_work", "time_since_last_transition"],
    "window_interactions": ["temp_x_power_lag_96", "hour_x_power_roll_mean_24",
                            "power_lag_96_x_dayofweek", "rad_x_power_lag_96",
                            "temp_x_power_roll_mean_12"],
}

LOOSE: dict[str, int] = {}
# Means of 2-decimal readings over 2^k*3 rows end exactly on a 7th-decimal
# tie; one more decimal keeps them off the rounding boundary.
LOOSE.update({n: 7 for n in FAMILIES["power_rolling_full"] + FAMILIES["temp_rolling_partial"]
              if "mean" in n})

# Survey rows covered by each check (for the README coverage table).
COVERS = {
    "meter_view": "P1 (source)",
    "meter_load": "S1, S3, S4",
    "meter_rejects": "S1, S4",
    "meter_unlabelled": "S2, S4",
    "site_archetypes": "A1, A2",
    "calendar_features": "F1-F15, F20, F21",
    "weather_features": "F16-F19, F24-F27",
    "archetype_features": "J1, F22, F23",
    "lag_features": "W1",
    "diff_features": "W2",
    "power_rolling_full": "W4, W9 (cumsum), F29-F31",
    "temp_rolling_partial": "W5, W6",
    "power_rolling_order": "W7, W8",
    "blocked_windows": "W1, W2, W3, W7, W9, W13, W15-W17 across block borders",
    "rolling_sums": "W9",
    "rolling_moments": "W10, W11",
    "rolling_slope": "W12",
    "rolling_percentile": "W13",
    "pct_change": "W3",
    "ewm_features": "W14",
    "state_transitions": "W15-W17",
    "window_interactions": "F28",
    "temporal_split": "P5, A3",
    "class_weights": "A6, P9",
    "archetype_subsets": "P4, J1",
    "correlation_pairs": "A4",
    "correlation_levels": "A4, M11",
    "correlated_drops": "A5",
    "classifier_features": "M1, A5",
    "regressor_features": "M1, A5",
    "regressor_inputs": "A7",
    "imputation_values": "M12",
    "event_rows": "P6",
    "aligned_test": "P3",
    "submission_order": "S5 (order)",
    "one_archetype_submission": "P10",
    "tree_walk_scores": "M2-M5, M7, M11",
    "time_folds": "M9",
    "fold_medians": "M8, M12",
    "calibration_points": "M13",
    "profile_submission": "V1-V4, P7, P9, P10, J2-J4",
    "confusion_matrix": "E1",
    "classification_scores": "E2, E3",
    "regression_errors": "E4",
    "model_submission": "M1-M7, M10-M12, J2-J4, V1-V4 (rows only)",
}
HOLDOUT_DAYS = 61


def featured_meter(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> DataFrame:
    """The meter table with its sites' archetypes, as far as the features
    ``names`` (default all) depend on them: without that no site means are
    computed and the input is read once."""
    meter = meter_view(spark, sf_dir)
    if names is not None and not any(n.startswith("archetype_") for n in names):
        return meter.withColumn(ARCH, F.lit(None).cast("string"))
    return attach_archetype(meter, site_archetypes(meter))


#: Look-backs of up to 150 rows, and the carries across blocks.
BLOCKED = ["power_lag_144", "temp_diff_96", "power_roll_min_96", "power_roll_max_144", "rad_roll_sum_48",
           "power_percentile_96", "power_pct_change_96", "state_changed", "is_transition_to_work",
           "time_since_last_transition"]


def q_blocked_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows over small blocks with a short halo: many blocks per site."""
    feats = blocked_features(featured_meter(spark, sf_dir, BLOCKED), keep=BLOCKED, block_rows=200, halo=150)
    return present(feats.select(C.SITE, C.ROW_ID, *[F.col(f"`{n}`") for n in BLOCKED]), LOOSE)


def family_query(names: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        feats = blocked_features(featured_meter(spark, sf_dir, names), keep=names)
        return present(feats.select(C.SITE, C.ROW_ID, *[F.col(f"`{n}`") for n in names]), LOOSE)
    return run


def q_meter_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(meter_view(spark, sf_dir))


#: Lines of the CSV copy that are spoilt: a number, a time, missing fields.
SPOILT = (101, 103, 107)


def csv_copy(spark: SparkSession, sf_dir: str) -> str:
    """The meter table as CSV files in order of row id, some lines spoilt."""
    meter = meter_view(spark, sf_dir)
    rid, names = F.col(C.ROW_ID), [C.SITE, C.TIME, C.TEMP, C.RAD, C.POWER, C.FLAG, C.CAP]
    text = {c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in names}
    text[C.POWER] = F.when(rid % SPOILT[0] == 0, F.lit("n/a")).otherwise(text[C.POWER])
    text[C.TIME] = F.when(rid % SPOILT[1] == 0, F.lit("2024-13-45 00:00:00")).otherwise(text[C.TIME])
    line = F.when(rid % SPOILT[2] == 0, F.concat_ws(",", *[text[c] for c in names[:3]])).otherwise(
        F.concat_ws(",", *text.values()))
    ordered = meter.select(C.ROW_ID, line.alias("value")).repartitionByRange(5, C.ROW_ID).sortWithinPartitions(C.ROW_ID)

    def with_header(frames):
        import pandas as pd
        yield pd.DataFrame({"value": [",".join(names)]})
        for frame in frames:
            yield frame[["value"]]

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/meter-csv-{uuid.uuid4().hex}"
    ordered.mapInPandas(with_header, "value string").write.text(path)
    return path


def q_meter_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1, S3, S4: good rows of a load, after a path that doesn't exist."""
    path = csv_copy(spark, sf_dir)
    return present(load_meter_csv(spark, [f"{path}-missing", path]).rows)


def q_meter_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1, S4: the rejected lines' numbers beside the counts of the load."""
    load = load_meter_csv(spark, csv_copy(spark, sf_dir))
    return present(load.rejects.select(C.ROW_ID, F.lit(load.n_rows).alias("n_rows"), F.lit(load.n_rejected).alias("n_rejected")))


def q_meter_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2: the unlabelled layout, read from a copy of the test file."""
    _, test, _ = _holdout(spark, sf_dir)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/meter-csv-{uuid.uuid4().hex}"
    test.orderBy(C.ROW_ID).select(C.SITE, C.TIME, C.TEMP, C.RAD, C.POWER).write.option("header", True) \
        .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)
    return present(read_meter_csv(spark, path, labelled=False, most_rejected=0.0))


def q_site_archetypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(site_archetypes(meter_view(spark, sf_dir)))


def q_temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = SP.temporal_split(meter_view(spark, sf_dir))
    return present(marked.groupBy(C.SITE).agg(
        F.sum(F.col(SP.FIT)).alias("n_fit"), F.sum(1 - F.col(SP.FIT)).alias("n_validation")))


def q_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(SP.balanced_class_weights(SP.with_label(meter_view(spark, sf_dir))))


def q_archetype_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    meter = meter_view(spark, sf_dir)
    arch = cut_lineage(site_archetypes(meter))
    parts = [SP.restrict_to_archetype(meter, arch, a)
             .agg(F.countDistinct(C.SITE).alias("n_sites"), F.count(F.lit(1)).alias("n_rows"))
             .select(F.lit(a).alias("site_archetype"), "n_sites", "n_rows")
             for a in C.ARCHETYPES]
    out = parts[0].unionByName(parts[1])
    return present(out.where(F.col("n_rows") > 0))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = blocked_features(featured_meter(spark, sf_dir), keep=FE.BASELINE)
    return SEL.pairwise_abs_corr(feats, SEL.correlation_candidates())


def q_correlation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(_pairs(spark, sf_dir).select("feature_i", "feature_j", "abs_corr"))


def q_correlation_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 for all rows and per archetype, from one pass."""
    feats = blocked_features(featured_meter(spark, sf_dir), keep=FE.BASELINE)
    found = SEL.correlation_levels(feats, SEL.correlation_candidates(), "site_archetype", tuple(C.ARCHETYPES))
    return present(found.select("level", "feature_i", "feature_j", "abs_corr"))


def q_correlated_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SEL.correlated_drops(_pairs(spark, sf_dir)).select("feature")


def edited_features_query(out: list[str], extra: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        dropped = [r["feature"] for r in q_correlated_drops(spark, sf_dir).collect()]
        names = SEL.edited_list(SEL.surviving(SEL.correlation_candidates(), dropped), out, extra)
        return spark.createDataFrame(list(enumerate(names)), "position long, feature string")
    return run


def q_regressor_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7: the united regressor features in order, with their readings."""
    names = SEL.regressor_features_used()
    made = [n for n in names if n not in C.RAW_NUMERIC]
    feats = blocked_features(featured_meter(spark, sf_dir), keep=made)
    counts = feats.agg(*[F.count(F.col(f"`{n}`")).alias(f"n{k}") for k, n in enumerate(names)])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(k).cast("long").alias("position"), F.lit(n).alias("feature"), F.col(f"n{k}").alias("n_present"))
        for k, n in enumerate(names)])))


#: Readings, a lag and differences, so that missing values of both kinds occur.
IMPUTED = [*C.RAW_NUMERIC, "power_lag_144", "power_diff_672", "rad_diff_24", "hour"]


def q_imputation_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M12, with a sketch fine enough to be exact on the check tables."""
    from .models import medians
    feats = blocked_features(featured_meter(spark, sf_dir, IMPUTED), keep=[n for n in IMPUTED if n not in C.RAW_NUMERIC])
    return present(medians(feats, IMPUTED, accuracy=1_000_000))


def q_event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(SP.events_only(meter_view(spark, sf_dir)).select(C.SITE, C.ROW_ID, C.FLAG, C.CAP))


def q_aligned_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test, _ = _holdout(spark, sf_dir)
    return present(SP.align_columns(test, train.columns))


def q_submission_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test, _ = _holdout(spark, sf_dir)
    return with_position(profile_submission(train, test), SUBMISSION_ORDER).select(*SUBMISSION_ORDER, "position")


def q_one_archetype_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10, M11: no large site has training rows, so those fall back."""
    train, test, _ = _holdout(spark, sf_dir)
    train = SP.restrict_to_archetype(train, cut_lineage(site_archetypes(test)), "small")
    return present(profile_submission(train, test).select(*C.SUBMISSION_COLUMNS))


def _holdout(spark: SparkSession, sf_dir: str):
    meter = meter_view(spark, sf_dir)
    train, test = time_holdout(meter, HOLDOUT_DAYS)
    truth = meter.join(test.select(C.SITE, C.ROW_ID), [C.SITE, C.ROW_ID], "left_semi") \
                 .select(C.SITE, C.ROW_ID, F.col(C.FLAG).alias("true_flag"), F.col(C.CAP).alias("true_cap"))
    return train, test, truth


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test, truth = _holdout(spark, sf_dir)
    sub = profile_submission(train, test)
    return sub.join(truth, [C.SITE, C.ROW_ID])


def q_profile_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test, _ = _holdout(spark, sf_dir)
    return present(profile_submission(train, test).select(*C.SUBMISSION_COLUMNS))


def q_confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(M.confusion(_scored(spark, sf_dir), "true_flag", C.FLAG))


def q_classification_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(M.classification_scores(M.confusion(_scored(spark, sf_dir), "true_flag", C.FLAG)))


def q_regression_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(M.regression_errors(_scored(spark, sf_dir), "true_cap", C.CAP))


def q_model_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2-M11 end to end (rows-only check: tree ensembles have no SQL
    twin). Small tree counts: label quality is not under test."""
    from .models import small_params
    from .pipeline import run
    train, test, _ = _holdout(spark, sf_dir)
    sub, _ = run(spark, train, test, params=small_params(clf_iter=3, clf_depth=4, rf_trees=5, rf_depth=6,
                                                         reg_iter=3, reg_depth=4, reg_b_depth=4))
    return present(sub.select(*C.SUBMISSION_COLUMNS))


#: Inputs of the small tree models below: readings, calendar and window features, with missing values.
TREE_INPUTS = ["hour", "dayofweek", "is_work_hours", "power_lag_1", "power_diff_4", "temp_roll_mean_4", "rad_roll_sum_12"]


def q_tree_walk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2-M5, M7, M11: both archetypes' fitted ensembles as node tables score
    the test rows in one pass; rows per site whose scores differ from MLlib's."""
    from . import models as MD
    from ..operators.trees import forest_table
    train, test, _ = _holdout(spark, sf_dir)
    arch = cut_lineage(site_archetypes(test))
    made = written(blocked_features(attach_archetype(train, arch), keep=TREE_INPUTS), "tree-train")
    wide = written(blocked_features(attach_archetype(test, arch), keep=TREE_INPUTS), "tree-test")
    cols = [*C.RAW_NUMERIC, *TREE_INPUTS]
    params = MD.small_params(clf_iter=3, clf_depth=3, rf_trees=4, rf_depth=4, reg_iter=3, reg_depth=3, reg_b_depth=4, patience=2)
    tables, rows = {}, None
    for a in C.ARCHETYPES:
        train_a, test_a = (SP.restrict_to_archetype(f, arch, a) for f in (made, wide))
        if train_a.isEmpty() or test_a.isEmpty():
            continue
        level = MD.fit_level(train_a, cols, cols, params)
        tables |= MD.level_tables(level, a)
        scored = MD.family_scores(level, MD.design_both(test_a, level)).select(
            C.SITE, "_f_clf", "_f_reg", F.lit(a).alias("of_level"), *[F.col(c).alias(f"mllib{c}") for c in SCORES])
        rows = scored if rows is None else rows.unionByName(scored)
    walked = MD.walked_scores(forest_table(tables), rows, F.col("of_level"))

    def differ(c: str) -> Column:
        one, two = F.col(c), F.col(f"mllib{c}")
        far = lambda x, y: F.coalesce(F.abs(x - y) > 1e-9, F.lit(True))
        return F.exists(F.zip_with(one, two, far), lambda b: b) if c in ("_pa", "_pb") else far(one, two)

    return walked.groupBy(C.SITE).agg(F.count(F.lit(1)).alias("n_rows"), *[
        F.count(F.when(differ(c), 1)).alias(f"mismatches{c}") for c in SCORES])


SCORES = ["_pa", "_pb", "_cap_a", "_cap_b"]


def q_time_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tuning import FOLD, time_folds
    return time_folds(meter_view(spark, sf_dir), 3).select(C.SITE, C.ROW_ID, F.col(FOLD).cast("long").alias("fold"))


def q_fold_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8, M12: medians of the training side of every time fold from merged
    sketches, large enough to be exact on the check tables."""
    from .tuning import fold_medians, time_folds
    feats = blocked_features(featured_meter(spark, sf_dir, IMPUTED), keep=[n for n in IMPUTED if n not in C.RAW_NUMERIC])
    return present(fold_medians(time_folds(feats, 3), IMPUTED, 3, sketch=32_768))


def q_calibration_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M13: isotonic fit of the profile's raw capacity against the actual one
    on test events, pooled in short ranges."""
    from ..operators.isotonic import fitted_points
    from .profile import raw_capacity
    train, test, truth = _holdout(spark, sf_dir)
    raw = present(raw_capacity(train, test))
    events = truth.where((F.col("true_flag") != 0) & F.col("true_cap").isNotNull())
    points = raw.join(events, [C.SITE, C.ROW_ID]).select(F.col("raw_capacity").alias("x"), F.col("true_cap").alias("y"))
    return present(fitted_points(points, range_rows=20))


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        "meter_view": q_meter_view,
        "meter_load": q_meter_load,
        "meter_rejects": q_meter_rejects,
        "meter_unlabelled": q_meter_unlabelled,
        "site_archetypes": q_site_archetypes,
    }
    for name, cols in FAMILIES.items():
        q[name] = family_query(cols)
    q["blocked_windows"] = q_blocked_windows
    q.update({
        "temporal_split": q_temporal_split,
        "class_weights": q_class_weights,
        "archetype_subsets": q_archetype_subsets,
        "correlation_pairs": q_correlation_pairs,
        "correlation_levels": q_correlation_levels,
        "correlated_drops": q_correlated_drops,
        "classifier_features": edited_features_query(C.CLASSIFIER_OUT, C.CLASSIFIER_IN),
        "regressor_features": edited_features_query(C.REGRESSOR_OUT, C.REGRESSOR_IN),
        "regressor_inputs": q_regressor_inputs,
        "imputation_values": q_imputation_values,
        "event_rows": q_event_rows,
        "aligned_test": q_aligned_test,
        "submission_order": q_submission_order,
        "one_archetype_submission": q_one_archetype_submission,
        "profile_submission": q_profile_submission,
        "confusion_matrix": q_confusion_matrix,
        "classification_scores": q_classification_scores,
        "regression_errors": q_regression_errors,
        "tree_walk_scores": q_tree_walk_scores,
        "time_folds": q_time_folds,
        "fold_medians": q_fold_medians,
        "calibration_points": q_calibration_points,
        "model_submission": q_model_submission,
    })
    return q


def sql_queries() -> dict[str, str]:
    meter_cols = ", ".join([O.S, O.RID, O.TS] + [
        f"{sql_round(c)} AS {c}" for c in (O.TT, O.RR, O.PP)] + [
        f"CAST({O.FL} AS BIGINT) AS {O.FL}", f"{sql_round(O.CP)} AS {O.CP}"])
    numbered = f"numbered AS (SELECT *, row_number() OVER (ORDER BY {O.RID}) - 1 AS place FROM ml)"
    spoilt = " OR ".join(f"{O.RID} % {k} = 0" for k in SPOILT)
    loaded = meter_cols.replace(f", {O.RID},", f", place AS {O.RID},", 1)
    unlabelled = ", ".join([O.S, f"row_number() OVER (ORDER BY {O.RID}) - 1 AS {O.RID}", O.TS, *[
        f"{sql_round(c)} AS {c}" for c in (O.TT, O.RR, O.PP)]])
    q = {
        "meter_view": f"WITH {O.METER} SELECT {meter_cols} FROM ml",
        "meter_load": f"WITH {O.METER}, {numbered} SELECT {loaded} FROM numbered WHERE NOT ({spoilt})",
        "meter_rejects": f"""WITH {O.METER}, {numbered}
SELECT place AS {O.RID}, (SELECT count(*) FROM ml WHERE NOT ({spoilt})) AS n_rows,
       (SELECT count(*) FROM ml WHERE {spoilt}) AS n_rejected FROM numbered WHERE {spoilt}""",
        "meter_unlabelled": f"""WITH {O.METER}, cut AS (SELECT max({O.TS}) - INTERVAL {HOLDOUT_DAYS} DAY AS c FROM ml)
SELECT {unlabelled} FROM ml, cut WHERE {O.TS} >= cut.c""",
        "site_archetypes": (f"WITH {O.METER}, {O.ARCHETYPES} "
                            f"SELECT {O.S}, {sql_round('mean_power')} AS mean_power, site_archetype FROM arch"),
    }
    for name, cols in FAMILIES.items():
        q[name] = O.features_sql(cols, decimals=LOOSE)
    q["blocked_windows"] = O.features_sql(BLOCKED, decimals=LOOSE)
    q.update({
        "temporal_split": OP.temporal_split_sql(),
        "class_weights": OP.class_weights_sql(),
        "archetype_subsets": OP.archetype_subsets_sql(),
        "correlation_pairs": OP.corr_pairs_sql(),
        "correlation_levels": OP.corr_levels_sql(),
        "correlated_drops": OP.corr_drops_sql(),
        "classifier_features": OP.edited_features_sql(C.CLASSIFIER_OUT, C.CLASSIFIER_IN),
        "regressor_features": OP.edited_features_sql(C.REGRESSOR_OUT, C.REGRESSOR_IN),
        "regressor_inputs": OP.regressor_inputs_sql(SEL.regressor_features_used()),
        "imputation_values": OP.imputation_values_sql(IMPUTED),
        "event_rows": OP.event_rows_sql(),
        "aligned_test": OP.aligned_test_sql(),
        "submission_order": OP.submission_order_sql(),
        "one_archetype_submission": OP.profile_submission_sql(trained_on="small"),
        "profile_submission": OP.profile_submission_sql(),
        "confusion_matrix": OP.confusion_sql(),
        "classification_scores": OP.classification_scores_sql(),
        "regression_errors": OP.regression_errors_sql(),
        "tree_walk_scores": OP.tree_walk_sql(SCORES),
        "time_folds": OP.time_folds_sql(),
        "fold_medians": OP.fold_medians_sql(IMPUTED),
        "calibration_points": OP.calibration_points_sql(),
    })
    return q


