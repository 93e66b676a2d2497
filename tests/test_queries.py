"""Registered queries against their SQL (all of them: tests/check_oracle.py or PANELSPARK_ALL=1)."""
import os

import pytest

import __spark_entry__ as entry
from panelspark.queries import ORACLES, QUERIES
from tests.check_oracle import compare, connect

SCALE = "/root/testdata/sf0.01"

# A cross-section of the operator families; PANELSPARK_ALL=1 runs every query.
CHOSEN = (
    "W5_cs_rank_pct", "W7_roll_beta", "W19_debounce", "W20_regime_exposure", "W21_book_walk_impact", "P15_norm_cdf_ppf", "J4_asof_inclusive",
    "J12_position_diff", "T1_liquidity_schedule", "T2_top_bottom_k", "A9_psr", "A12_rank_ic", "A15_cross_sectional_median", "A25_newey_west_stacked",
    "F7_target_weights", "F10_portfolio_returns", "V2_cpcv_splits", "V6_cscv_logits", "V8_bootstrap_ci", "M2_ridge_coefficients", "D1_verify_panel",
    "S2_read_daily_bars", "ST3_tick_bars",
)


@pytest.fixture(scope="module")
def con():
    return connect(SCALE)


def test_registry_is_complete():
    names, oracles = set(entry.queries()), set(entry.oracle_sql())
    assert oracles <= names and len(names) > 170
    assert set(QUERIES) - set(ORACLES) <= {"R2_recipe_sweep"} and set(QUERIES) <= names


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["instrument", "date", "exposure"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(entry.queries()) if os.environ.get("PANELSPARK_ALL") else CHOSEN)
def test_query(spark, con, name):
    ok, text, _ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SCALE)
    assert ok, text
