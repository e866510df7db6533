from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from loadshape.session import local_session
    s = local_session("*", shuffle_partitions=8, app="loadshape-tests")
    yield s


@pytest.fixture(scope="session")
def meter_small(spark):
    from loadshape.operators.archetypes import attach_archetype, site_archetypes
    from loadshape.sources.meter import meter_view
    m = meter_view(spark, SF01)
    return attach_archetype(m, site_archetypes(m))
