"""Registered queries against their SQL on the smallest tables (check.py does all of them on any folder)."""

import os

import pytest

import __spark_entry__ as entry
import check

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")

SAMPLE = [
    "R8_gated_hybrid", "R16_profile_blend", "R18_diversity", "M4_profile_pair_percentiles", "N7_neighbors_facts_only",
    "H5_successors", "C4_single_linkage", "C7_valid_clusters", "B4_assembled_profiles", "G1_claim_verification", "T2_terms",
    "S11_registration_counts", "V17_codes_in_batch", "E3_alpha_sweep",
]


@pytest.fixture(scope="module")
def con():
    return check.connect(FOLDER)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    ok, note = check.compare(spark, con, name, FOLDER, entry.oracle_sql()[name])
    assert ok, note


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "frame", "position", "emp_id", "dept_id", "score"] and df.count() > 0
