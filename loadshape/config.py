"""Column names and fixed values of the demand-response data model.

Everything listed under "fixed values" must stay equal to the values the
original pipeline uses, otherwise feature names, feature lists and model
inputs stop matching. They are written out plainly, in their natural order.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# input/output column names of the meter files.
# ---------------------------------------------------------------------------
SITE = "Site"
TIME = "Timestamp_Local"
TEMP = "Dry_Bulb_Temperature_C"
RAD = "Global_Horizontal_Radiation_W/m2"
POWER = "Building_Power_kW"
FLAG = "Demand_Response_Flag"
CAP = "Demand_Response_Capacity_kW"

# Unique tie-breaker that makes the per-site row order explicit (the original
# relies on file row order; Spark needs a deterministic order key).
ROW_ID = "row_id"

RAW_NUMERIC = [TEMP, RAD, POWER]
SUBMISSION_COLUMNS = [SITE, TIME, FLAG, CAP]

# ---------------------------------------------------------------------------
# Feature-engineering parameters.
# ---------------------------------------------------------------------------
LAGS = [1, 2, 4, 8, 16, 24, 48, 56, 96, 144]
POWER_ROLL_FULL = [4, 12, 24, 48, 56, 96, 144]
TEMP_ROLL_PARTIAL = [4, 8, 12, 24, 48, 96, 288, 672]
TEMP_ROLL_MINMAX = [24, 96]
POWER_ROLL_MINMAX = [4, 12, 24, 48, 96, 144]
MOMENT_WINDOWS = [24, 96]
TEMP_RAD_DIFFS = [1, 4, 24, 96]
POWER_DIFFS = [1, 4, 24, 96, 672]
ROLL_SUM_WINDOWS = [12, 24, 48]
EWM_SPANS = [8, 24]
ZSCORE_WINDOWS = [24, 96]
PERCENTILE_WINDOW = 96
SLOPE_WINDOW = 4
COMFORT_TEMP = 18.0
ARCHETYPE_POWER_THRESHOLD = 60.0
ARCHETYPES = ["small", "large"]
TEMP_BIN_LABELS = ["cold", "mild", "warm", "hot"]
TEMP_BIN_EDGES = [10.0, 18.0, 25.0]  # right-closed: (-inf,10], (10,18], (18,25], (25,inf)
OCCUPANCY_STATES = ["Workday_Hours", "Workday_OffHours", "Weekend_Day", "Weekend_Night"]
EPS = 1e-6

# Longest row look-back of any window feature (power_diff_672, temp_roll_*_672).
MAX_LOOKBACK = 672

# ---------------------------------------------------------------------------
# Correlation pruning and feature lists.
# ---------------------------------------------------------------------------
CORR_THRESHOLD = 0.98
ALWAYS_DROP = ["power_roll_std_56", "power_roll_mean_144"]

CLASSIFIER_OUT = [
    "month", "power_roll_mean_96", "power_roll_std_56", "power_roll_mean_144",
    "power_lag_96", "temp_lag_48", "power_roll_std_4", "temp_lag_144",
    "archetype_large", "archetype_small",
]
CLASSIFIER_IN = [
    "hour_cos", "day_of_week_cos", "is_last_work_hour", "is_mild_temp_workday",
    "temp_roll_min_24", "rad_diff_1", "rad_diff_4", "is_transition_to_work",
    "is_transition_from_work", "state_Workday_OffHours", "rad_roll_sum_48",
    "power_zscore_96",
]
REGRESSOR_OUT = [
    "archetype_small_power_interaction", "Dry_Bulb_Temperature_C",
    "power_roll_std_56", "power_roll_mean_144",
]
REGRESSOR_IN = [
    "temp_ewm_span_24", "temp_x_power_lag_96", "temp_x_hour_sin",
    "archetype_large_power_interaction", "power_ewm_span_8", "temp_bins_warm",
    "temp_roll_std_8", "temp_roll_min_24", "temp_diff_24", "power_pct_change_4",
    "temp_x_is_weekend", "rad_x_hour_sin", "power_vs_daily_max",
    "temp_roll_std_4", "rad_diff_4",
]

# Hand-picked regressor features, three groups that are united (duplicates
# collapse; we keep first-appearance order).
REGRESSOR_SELECTED = [
    "month", "temp_roll_max_96", "power_pct_change_4", "temp_diff_24",
    "power_lag_24", "temp_lag_96", "archetype_small_temp_interaction",
    "power_roll_mean_24", "power_lag_8", "temp_roll_min_24", "dayofweek",
    "is_heating_likely", "temp_x_hour_sin", "is_morning_ramp_up", "power_diff_1",
    "is_peak_hours", "state_changed", "cooling_degree", "power_diff_96",
    "temp_ewm_span_24", "temp_roll_std_8", "power_ewm_span_8", "temp_x_is_weekend",
    "power_vs_roll_mean_96", "temp_roll_std_4", "temp_lag_144", "is_business_hours",
    "power_pct_change_96", "temp_rad_interaction", "archetype_large",
    "power_vs_daily_max", "is_weekend", "is_summer", "is_mild_temp_workday",
    "archetype_small_power_interaction", "Global_Horizontal_Radiation_W/m2",
    "Building_Power_kW", "power_roll_std_4", "power_roll_mean_96", "is_winter",
    "archetype_large_power_interaction", "quarter", "power_lag_48",
]
REGRESSOR_OFFICIAL = [
    "power_roll_mean_4", "power_cumsum_4", "is_lunch_hour", "temp_bins_cold",
    "time_of_day_minute", "time_of_day_fraction", "hour_sin", "is_evening_ramp_down",
    "is_last_work_hour", "power_roll_max_4", "power_roll_max_12", "power_roll_max_24",
    "power_roll_max_48", "power_diff_24", "power_zscore_24", "power_zscore_96",
    "power_percentile_96",
]
REGRESSOR_EXTRA = [
    "hour_cos", "power_roll_median_24", "power_roll_min_48", "power_roll_median_48",
    "power_roll_min_96", "power_roll_max_96", "power_roll_min_144",
    "power_roll_median_144", "power_roll_skew_24", "power_roll_kurt_24",
    "power_roll_kurt_96", "power_pct_change_1", "power_diff_4", "power_pct_change_24",
    "power_diff_672", "power_pct_change_672", "is_work_hours_lag",
    "time_since_last_transition", "state_Weekend_Day", "state_Workday_Hours",
    "temp_x_is_work_hours", "rad_x_is_work_hours", "rad_x_is_weekend",
    "rad_x_hour_cos", "effective_temp_load", "hour_x_power_roll_mean_24",
    "power_lag_96_x_dayofweek", "rad_x_power_lag_96", "temp_x_power_roll_mean_12",
    "rad_roll_sum_12", "temp_roll_sum_24", "rad_roll_sum_24", "power_roll_sum_48",
    "rad_roll_sum_48", "power_vs_daily_avg", "power_zscore_24", "power_zscore_96",
    "power_percentile_96",
]

# ---------------------------------------------------------------------------
# Labels, split and ensemble weights.
# ---------------------------------------------------------------------------
VALIDATION_DAYS = 31
PATIENCE = 250                        # rounds without a lower validation loss
LGB_WEIGHT, XGB_WEIGHT = 0.7, 0.3     # family A / family B blend
GLOBAL_WEIGHT, ARCHETYPE_WEIGHT = 0.9, 0.1
NUM_CLASSES = 3

# ---------------------------------------------------------------------------
# Boosting settings of the final models (the same globally and
# per archetype), those used when none are given, and the two search grids.
# ---------------------------------------------------------------------------
CLF_SETTINGS = {"n_estimators": 2500, "learning_rate": 0.026, "num_leaves": 29, "colsample_bytree": 0.8,
                "min_child_samples": 20, "reg_alpha": 0.46, "reg_lambda": 0.5}
REG_SETTINGS = {"n_estimators": 10000, "learning_rate": 0.0175, "num_leaves": 49, "colsample_bytree": 0.8,
                "min_child_samples": 20, "reg_alpha": 0.3, "reg_lambda": 0.2}
CLF_FALLBACK = {"n_estimators": 1500, "learning_rate": 0.02, "num_leaves": 41, "colsample_bytree": 0.8,
                "min_child_samples": 20, "reg_alpha": 0.5, "reg_lambda": 1.0}
REG_FALLBACK = {"n_estimators": 1500, "learning_rate": 0.05, "num_leaves": 60, "colsample_bytree": 0.8,
                "min_child_samples": 20, "reg_alpha": 0.5, "reg_lambda": 0.5}
CLF_GRID = {"n_estimators": [1500], "learning_rate": [0.01, 0.02, 0.03], "num_leaves": [31, 41, 51, 61],
            "colsample_bytree": [0.8], "min_child_samples": [20], "reg_alpha": [0.1, 0.5], "reg_lambda": [0.1, 0.5]}
REG_GRID = {"n_estimators": [1500], "learning_rate": [0.01, 0.03, 0.05], "num_leaves": [40, 50, 60, 80],
            "colsample_bytree": [0.8], "min_child_samples": [20], "reg_alpha": [0.1, 0.5], "reg_lambda": [0.1, 0.5]}
