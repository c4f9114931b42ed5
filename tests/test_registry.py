"""Every registered query equals its SQL on the smallest tables."""

import os

import pytest

import oracle
from reelgrid.registry import CATALOGUE

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")

# One per chunked code path; rows of a media beyond the limit are split over tasks.
CHUNKED = [
    "lod_levels", "scenes", "repeat_seeds", "asof_nearest", "keyframe_neighbours", "range_summary",
    "frame_metrics", "frame_range_plan", "keyframe_plan", "first_rows_in_ranges", "single_frame", "seek_percentiles", "presentation_order",
    "rows_in_ranges", "lod_deep", "context_window", "analyse_ranges", "analyse_overlapping_ranges",
]


# Queries whose state SQL cannot fold; all others have SQL.
WITHOUT_SQL = {"stream_visits"}


def test_all_queries_have_sql():
    assert {name for name, q in CATALOGUE.items() if q.sql is None} == WITHOUT_SQL


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(CATALOGUE))
def test_query_equals_sql(spark, con, name):
    message, ok = oracle.compare(spark, con, FOLDER, name, CATALOGUE[name])
    assert ok, message


@pytest.mark.parametrize("name", CHUNKED)
def test_chunked_query_equals_sql(spark, con, name):
    spark.conf.set("reelgrid.chunk.rows", "25")
    try:
        message, ok = oracle.compare(spark, con, FOLDER, name, CATALOGUE[name])
    finally:
        spark.conf.unset("reelgrid.chunk.rows")
    assert ok, message
