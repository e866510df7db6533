"""Site archetypes (A1, A2) and the site -> archetype lookup (J1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from .sizing import small_side

ARCH = "site_archetype"


def site_archetypes(meter: DataFrame, threshold: float = C.ARCHETYPE_POWER_THRESHOLD) -> DataFrame:
    """One row per site: mean power and 'large' above the threshold, else
    'small' (a site whose readings are all missing counts as small).
    Partial aggregation on the map side; one row per site is shuffled."""
    return (meter.groupBy(C.SITE)
            .agg(F.avg(C.POWER).alias("mean_power"))
            .select(C.SITE, "mean_power",
                    F.when(F.col("mean_power") > threshold, "large").otherwise("small").alias(ARCH)))


def attach_archetype(meter: DataFrame, archetypes: DataFrame) -> DataFrame:
    """Left lookup; a site missing from the map gets NULL (both one-hot
    columns 0 later). The map has one row per site: broadcast when its
    counted size allows it, shuffle join otherwise."""
    lookup = archetypes.select(C.SITE, ARCH)
    return meter.join(small_side(lookup), C.SITE, "left")
