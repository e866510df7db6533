"""Profile predictor: class frequencies and mean event capacity per calendar
slot, learned from the training file. It is fully SQL-expressible, so the
whole blend path (two families, two levels, gating, fallback join,
post-processing, sorted sink) and the metrics are checked against DuckDB
on real rows. The MLlib models in ``plans.models`` feed the same blend.

Family A keys on hour-of-week, family B on hour-of-day; the archetype level
adds the site archetype to the key. The training file is read once, into
totals per (archetype, hour-of-week); all four key tables are sums of those.
They have a fixed size bound (168 or 24 slots, times 2 archetypes), so they
are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import calendar as cal
from ..operators.archetypes import ARCH, attach_archetype, site_archetypes
from ..operators.ensemble import CAPACITY, PROBS, merge_levels, two_family_level
from ..session import written

SLOT_A, SLOT_B = "slot_a", "slot_b"
FLAGS = (-1, 0, 1)


def slots(df: DataFrame) -> DataFrame:
    return df.withColumn(SLOT_A, cal.dayofweek() * 24 + cal.hour()).withColumn(SLOT_B, cal.hour())


def slot_totals(train: DataFrame) -> DataFrame:
    """Rows per flag, event readings and their capacity per (archetype, slot);
    at most 3 x 169 rows, whatever the input."""
    f = F.col(C.FLAG)
    event_cap = F.when(f != 0, F.col(C.CAP))
    return train.groupBy(ARCH, SLOT_A, SLOT_B).agg(
        F.count(F.lit(1)).alias("n"), *[F.count(F.when(f == v, 1)).alias(f"n{k}") for k, v in enumerate(FLAGS)],
        F.count(event_cap).alias("n_cap"), F.sum(event_cap).alias("cap"))


def key_table(totals: DataFrame, keys: list[str]) -> DataFrame:
    """Laplace-smoothed class shares and mean event capacity per key."""
    t = totals.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "n0", "n1", "n2", "n_cap", "cap")])
    probs = F.array(*[((F.col(f"n{k}") + 1) / (F.col("n") + 3)).cast("double") for k in range(len(FLAGS))])
    return t.select(*keys, probs.alias("p"), F.coalesce(F.try_divide("cap", "n_cap"), F.lit(0.0)).alias("c"))


def apply_profile(test: DataFrame, model: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    uniform = F.array(*[F.lit(1.0 / 3.0)] * 3)
    m = model.select(*keys, F.col("p").alias("p_" + suffix), F.col("c").alias("c_" + suffix))
    out = test.join(F.broadcast(m), keys, "left")
    return (out.withColumn("p_" + suffix, F.coalesce(F.col("p_" + suffix), uniform))
               .withColumn("c_" + suffix, F.coalesce(F.col("c_" + suffix), F.lit(0.0))))


def predict_level(totals: DataFrame, test: DataFrame, extra: list[str]) -> DataFrame:
    scored = test
    for suffix, slot in (("a", SLOT_A), ("b", SLOT_B)):
        keys = [*extra, slot]
        scored = apply_profile(scored, key_table(totals, keys), keys, suffix)
    level = two_family_level(scored, "p_a", "p_b", "c_a", "c_b")
    return level.select(C.SITE, C.ROW_ID, C.TIME, PROBS, CAPACITY)


def raw_capacity(train: DataFrame, test: DataFrame) -> DataFrame:
    """Blended capacity of the global profile for every test row, before
    gating: what a calibration maps."""
    totals = written(slot_totals(slots(train.withColumn(ARCH, F.lit(None).cast("string")))), "slot-totals")
    scored = slots(test)
    for suffix, slot in (("a", SLOT_A), ("b", SLOT_B)):
        scored = apply_profile(scored, key_table(totals, [slot]), [slot], suffix)
    raw = F.lit(C.LGB_WEIGHT) * F.col("c_a") + F.lit(C.XGB_WEIGHT) * F.col("c_b")
    return scored.select(C.SITE, C.ROW_ID, raw.alias("raw_capacity"))


def profile_submission(train: DataFrame, test: DataFrame) -> DataFrame:
    """Global + per-archetype profiles, merged like the model ensemble.
    Archetypes come from the test file (as the original does)."""
    arch = written(site_archetypes(test), "archetypes")
    totals = written(slot_totals(slots(attach_archetype(train, arch))), "slot-totals")
    te = slots(test)
    global_pred = predict_level(totals, te, [])
    # P10: an archetype without training rows gets no archetype model; its
    # rows fall back to the global prediction.
    trained = totals.where(F.col(ARCH).isNotNull()).select(ARCH).distinct()
    te_arch = attach_archetype(te, arch).join(F.broadcast(trained), ARCH, "left_semi")
    return merge_levels(global_pred, predict_level(totals, te_arch, [ARCH]))
