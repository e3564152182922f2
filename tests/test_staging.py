from datetime import datetime

from pyspark.sql import functions as F

from loomgraph.operators import staging as S
from loomgraph.operators.graph import build_edges


def test_last_and_first_win(spark, rows):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("a", 2, "y"), (None, 1, "z"), ("b", None, "w"), ("b", 0, "v")], "id string, seq int, v string")
    assert rows(S.upsert_last(df, ["id"], ["seq"])) == sorted([("a", 3, None), (None, 1, "z"), ("b", 0, "v")], key=str)
    assert rows(S.insert_first(df, ["id"], ["seq"])) == sorted([("a", 1, "x"), (None, 1, "z"), ("b", None, "w")], key=str)


def test_edge_key_with_and_without_type(spark):
    r = spark.createDataFrame([(1, "a", "b", "HAS_PROP", 1, 1), (2, "a", "b", "RETURNS", 1, 1), (3, "a", "b", "returns", 1, 1)], "id long, source_id string, target_id string, reference_type string, line_number int, column_number int")
    assert build_edges(r).count() == 2 and build_edges(r, legacy_key=True).count() == 1


def test_merge_props(spark, rows):
    old = spark.createDataFrame([("a", "1", "o"), ("b", "2", None)], "id string, x string, y string")
    new = spark.createDataFrame([("a", None, "n", "z"), ("c", "3", None, None)], "id string, x string, y string, w string")
    assert rows(S.merge_props(old, new)) == sorted([("a", "1", "n", "z"), ("b", "2", None, None), ("c", "3", None, None)], key=str)


def test_incremental(spark, rows):
    files = spark.createDataFrame([("p", "1"), ("q", "2"), ("r", None), ("n", "3")], "file_path string, content string")
    h = files.select("file_path", F.md5("content").alias("hash")).where("file_path in ('p')")
    hashes = h.withColumn("last_parsed", F.lit(datetime(2025, 1, 1)).cast("timestamp_ntz")).unionByName(spark.createDataFrame([("q", "stale", None)], "file_path string, hash string, last_parsed timestamp_ntz"))
    stale = S.needs_parsing(files, hashes)
    assert rows(stale, "file_path") == [("n",), ("q",)]
    stored = spark.createDataFrame([("q", "old"), ("q", "old2"), ("p", "keep")], "file_path string, v string")
    fresh = spark.createDataFrame([("q", "new")], "file_path string, v string")
    assert rows(S.replace_files(stored, fresh)) == [("p", "keep"), ("q", "new")]


def test_edge_checks(spark, rows):
    nodes = spark.createDataFrame([("a", "file"), ("b", "class")], "id string, type string")
    edges = spark.createDataFrame([(1, "a", "b", "CONTAINS"), (2, "a", "x", "CONTAINS"), (3, "x", "b", "CALLS")], "eid long, src string, dst string, type string")
    assert rows(S.valid_edges(edges, nodes), "eid") == [(1,)]
    assert rows(S.skipped_edges(edges, nodes)) == [("CALLS", 1, 1), ("CONTAINS", 2, 1)]
    assert rows(S.rewrite_type(edges, nodes, "CONTAINS", "DEFINES", ["file"], ["class"]), "eid", "type") == [(1, "DEFINES"), (2, "CONTAINS"), (3, "CALLS")]
    assert S.duplicate_keys(edges, ["type"]).count() == 1
