"""Registered queries against DuckDB on the smallest tables.

A sample of each family runs by default; ALBUMETRICS_ALL_QUERIES=1 runs all.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, canonical

PATH = "/root/testdata/sf0.001"
SAMPLE = """a04_overview a08_representatives a09_median_date a16_pause_accounting e11_rotate_region e18_grid_decode
f13_preselect g01_edges_with_time g07_match_faces j04_person_counts j10_scan_reconcile j13_best_overlap l03_unknown_page
m09_assign_by_name m12_merge_persons m15_purge_outside m21_import_regions s04_upsert s05_read_regions s07_write_regions
s13_drain_pending s15_log_range t01_ingest t06_remaining_time t07_gate_stream w02_coverage_cut_ties w04_person_distances_large_gallery
w05_month_list x03_minimise""".split()

NAMES = sorted(entry.oracle_sql()) if os.environ.get("ALBUMETRICS_ALL_QUERIES") else SAMPLE


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{PATH}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, PATH)
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(cursor.fetchall(), names)


def test_flagship(spark):
    assert entry.entry(spark).count() == 500


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _against_sql(spark, tables, path, name):
    """Spark's and DuckDB's rows of a query over ``tables``, which lie below ``path``."""
    con = duckdb.connect()
    for table in tables:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet/*.parquet'")
    df = entry.queries()[name](spark, str(path))
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    return canonical([tuple(r) for r in df.collect()], df.columns), canonical(cursor.fetchall(), names)


@pytest.mark.parametrize("name", ["s04_upsert", "s04_insert_ignore"])
def test_moved_ids_meet_present_ones(spark, tmp_path, name):
    events = spark.read.parquet(f"{PATH}/events.parquet").limit(60)
    far = events.selectExpr("event_id + 5000000 AS event_id", *[c for c in events.columns if c != "event_id"])
    events.unionByName(far).write.parquet(f"{tmp_path}/events.parquet")
    mine, theirs = _against_sql(spark, ["events"], tmp_path, name)
    assert mine == theirs and len({row[-1] for row in mine}) == len(mine)


@pytest.mark.parametrize("name", ["t03_match_arrivals", "t04_live_counts"])
def test_streams_of_tables_in_several_files(spark, tmp_path, name):
    for table in ("events", "embeddings"):
        spark.read.parquet(f"{PATH}/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    mine, theirs = _against_sql(spark, ["events", "embeddings"], tmp_path, name)
    assert mine and mine == theirs


def test_clusters_that_are_not_the_labels(spark, tmp_path):
    """Every other vector points elsewhere, so labels fall apart and meet: the SQL has to follow the edges."""
    spark.read.parquet(f"{PATH}/events.parquet").write.parquet(f"{tmp_path}/events.parquet")
    moved = "transform(embedding, (x, i) -> CAST(x + IF(vec_id % 2 = 0 AND i = 40 + label % 2, 3, 0) AS FLOAT)) AS embedding"
    spark.read.parquet(f"{PATH}/embeddings.parquet").filter("vec_id < 250").selectExpr("vec_id", moved, "label").write.parquet(f"{tmp_path}/embeddings.parquet")
    mine, theirs = _against_sql(spark, ["events", "embeddings"], tmp_path, "g03_propagation")
    assert mine == theirs
    labels = {str(r.vec_id): r.label for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").select("vec_id", "label").collect()}
    assert len({(cluster, labels[face]) for cluster, face in mine}) > len(set(labels.values()))
