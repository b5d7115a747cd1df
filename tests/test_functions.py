"""Registered queries of functions and small operators against their SQL, on the smallest tables."""

import duckdb
import pytest

from trackloom.plans import audit_sql, function_queries, function_sql, image_queries, image_sql, oracle, queries

SF = "/root/testdata/sf0.001"
TABLES = ("events", "embeddings")
NAMES = (
    "ellipse_shape", "permutation_text", "time_spec", "trim_window", "track_palette", "frame_clock", "first_frames", "flag_counts", "region_plan",
    "detections_file", "trajectory_file", "verdicts_file", "sidecar_file", "sampled_frames", "background_table", "clone_patch", "brush_stamp",
    "detect_frames", "blob_perimeter", "pose_patches", "running_patch", "verdict_problems", "blob_contours", "blob_solidity", "chain_split",
    "fingerprint_extract", "shape_points", "mask_share", "candidates_file", "tuning_params", "roi_sidecar", "recording_meta", "track_summary",
    "perm_costs", "audit_reviewed", "audit_fingerprints", "polarity_route", "zoom_box", "improvement",
)
QUERIES = queries.QUERIES | function_queries.QUERIES | image_queries.QUERIES
SQL = oracle.SQL | function_sql.SQL | image_sql.SQL | audit_sql.SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF), duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), columns)


def test_every_function_query_has_sql():
    assert set(function_queries.QUERIES) <= set(function_sql.SQL)
    # Basins and fits aren't for SQL; test_separate has plain loops beside them. So do the tracker's tests.
    assert set(QUERIES) - set(SQL) == {"watershed_split", "arc_rescue", "tracker_batch", "tracker_stream"}
