"""No join of voxels, runs or links is a broadcast, however few bytes their Parquet files have."""

import re

import pytest

from voluma.operators import evaluation, grid
from voluma.plans import fixtures
from voluma.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture
def plans(monkeypatch):
    """The plans of all tables that a query stores."""
    found = []
    def saved(df, name, own=grid.saved):
        found.append(f"{name}\n" + df._jdf.queryExecution().executedPlan().toString())
        return own(df, name)
    for module in (grid, evaluation):
        monkeypatch.setattr(module, "saved", saved)
    return found


def broadcast_keys(plans):
    """The left keys of the broadcast joins."""
    joins = [m for p in plans for m in re.findall(r"BroadcastHashJoin \[(.*?)\]", p)]
    return {re.sub(r"#\d+L?", "", k) for m in joins for k in m.split(", ")}


@pytest.mark.parametrize("name", ["depth_rows", "depth_trend_rows", "neighbor_correction_round2", "neighbor_correction_round1", "correction_counts", "corrected_metrics", "depth_slab_corrected", "case_macro_cube", "evaluate_masks", "evaluate_masks_valid", "topology_betti26", "components18", "components26", "topology_betti"])
def test_joins_of_voxels_are_dealt(spark, plans, name):
    """Nor are voxels the side that is broadcast of their join with a row per volume."""
    out = QUERIES[name](spark, SF)
    voxels = [p for p in plans if not p.startswith("topology\n")]  # which joins rows per volume alone
    assert not any(re.search(r"BroadcastHashJoin .*BuildLeft", p) for p in voxels)
    keys = broadcast_keys([*plans, out._jdf.queryExecution().executedPlan().toString()])
    assert not keys & {"z", "y", "x", "run", "_u", "_v", "root"}, keys


def test_values_of_large_volumes_are_in_no_buffer(spark, monkeypatch):
    """The scores are the same from percentiles by range, whose plan has no aggregation that holds a volume's values."""
    by_buffer = QUERIES["gaussian_smooth"](spark, SF).collect()
    monkeypatch.setattr(fixtures, "AT_ONCE", 0)
    out = QUERIES["gaussian_smooth"](spark, SF)
    assert "percentile" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(out.collect()) == sorted(by_buffer) and by_buffer
