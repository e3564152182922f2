"""Staging algebra: keyed upserts, first-wins inserts, merges, incremental refresh, endpoint checks.

All of them are one aggregation or one join on the key. ``max_by``-style aggregates replace windows, so
that rows of a key are combined on the map side and a hot key costs its task one row per map task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _keep(df: DataFrame, keys: list[str], order: list[str], last: bool) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    lead = [F.col(c) for c in order if c not in keys]
    value = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(lead)], F.struct(*rest).alias("_row")) if rest else F.struct(F.lit(1).alias("_row"))
    picked = df.groupBy(*keys).agg((F.max if last else F.min)(value).alias("_v"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_v._row.{c}").alias(c) for c in df.columns])


def upsert_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Insert-or-replace: the whole row of greatest ``order`` wins for each key (ties: greatest row).
    Null keys form a key of their own; null order values come before all others."""
    return _keep(df, keys, order, True)


def insert_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Insert-or-ignore: the row of least ``order`` wins for each key (ties: least row)."""
    return _keep(df, keys, order, False)


def edge_keys(with_type: bool = True) -> list[str]:
    """Uniqueness of references; the type belongs to it unless the legacy rule is asked for."""
    base = ["source_id", "target_id", "line_number", "column_number"]
    return [*base, "reference_type"] if with_type else base


def merge_props(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Merge by key: a non-null new value replaces the old one, absent values keep it."""
    cols = [c for c in old.columns if c != key] + [c for c in new.columns if c != key and c not in old.columns]
    o, n = old.alias("o"), new.alias("n")
    j = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")

    def pick(c: str) -> Column:
        side = [F.col(f"{a}.{c}") for a, d in (("n", new), ("o", old)) if c in d.columns]
        return F.coalesce(*side).alias(c)

    return j.select(F.coalesce(F.col(f"n.{key}"), F.col(f"o.{key}")).alias(key), *[pick(c) for c in cols])


def merge_edges(edges: DataFrame, order: str = "eid") -> DataFrame:
    """One edge per (src, dst, type), properties of the last one."""
    return upsert_last(edges, ["src", "dst", "type"], [order])


def replace_files(stored: DataFrame, fresh: DataFrame, path: str = "file_path") -> DataFrame:
    """Rows of files that were read again replace all stored rows of these files."""
    return stored.join(fresh.select(path).distinct(), path, "left_anti").unionByName(fresh.select(*stored.columns))


def needs_parsing(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """Files whose md5 differs from the stored hash, or that have none; null content is never parsed.
    Of several stored rows of a path the latest ``last_parsed`` counts."""
    stored = upsert_last(hashes.select("file_path", "hash", "last_parsed"), ["file_path"], ["last_parsed"]).select("file_path", "hash")
    now = files.where(F.col("content").isNotNull()).select("file_path", F.md5("content").alias("new_hash"))
    return now.join(stored, "file_path", "left").where(~F.col("hash").eqNullSafe(F.col("new_hash"))).select("file_path", "new_hash", F.col("hash").alias("stored_hash"))


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends exist."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def skipped_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Count of edges left out for a missing end, by type."""
    ids = nodes.select("id")
    j = edges.join(ids.select(F.col("id").alias("src"), F.lit(True).alias("has_src")), "src", "left").join(ids.select(F.col("id").alias("dst"), F.lit(True).alias("has_dst")), "dst", "left")
    return j.groupBy("type").agg(F.count("*").alias("edges"), F.count(F.when(F.col("has_src").isNull() | F.col("has_dst").isNull(), 1)).alias("skipped"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Uniqueness constraint as a report: keys with more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def set_where(df: DataFrame, column: str, value: Column, condition: Column) -> DataFrame:
    """``SET column = value`` on matching rows."""
    old = F.col(column) if column in df.columns else F.lit(None)
    return df.withColumn(column, F.when(condition, value).otherwise(old))


def rewrite_type(edges: DataFrame, nodes: DataFrame, old: str, new: str, src_types: list[str], dst_types: list[str]) -> DataFrame:
    """Edge type ``old`` becomes ``new`` between nodes of the given types; other edges stay."""
    kind = nodes.select("id", F.col("type").alias("_t"))
    marked = (
        edges.join(kind.select(F.col("id").alias("src"), F.col("_t").alias("_s")), "src", "left")
        .join(kind.select(F.col("id").alias("dst"), F.col("_t").alias("_d")), "dst", "left")
    )
    hit = (F.col("type") == old) & F.col("_s").isin(src_types) & F.col("_d").isin(dst_types)
    return marked.withColumn("type", F.when(hit, new).otherwise(F.col("type"))).select(*edges.columns)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
