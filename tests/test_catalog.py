"""A spread of registered queries against their SQL, and the driver contract."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import check_oracles  # noqa: E402

entry = check_oracles.entry
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in check_oracles.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [
    "s1_csv_directory", "p3_deduplicate", "e4_preprocess", "t8_contrastive_pairs", "j3_negative_grid", "m2_ks_greater",
    "m6_assessment", "x2_ranked_subsets", "x3_dispersion", "a4_candidate_scores", "w1_continuous_assessment",
])
def test_query_agrees_with_sql(spark, con, name):
    text, _, ok = check_oracles.check(spark, con, SMALL, name)
    assert ok, text


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
