"""The property graph: nodes and edges as DataFrames, and how they are made from the staging tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.labels import label
from loomgraph.operators.staging import insert_first
from loomgraph.schema import edge_type

NODE_COLUMNS = ["id", "name", "type", "label", "file_path", "line_number", "namespace", "parent_id", "visibility", "return_type", "metadata"]
EDGE_COLUMNS = ["eid", "src", "dst", "type", "line_number", "column_number"]
# Types that own members.
CLASS_TYPES = ["class", "interface", "trait", "TSClass", "TSInterface"]


@dataclass
class PropertyGraph:
    """``nodes`` (id unique, ``label``), ``edges`` (``eid`` unique, src, dst, type)."""

    nodes: DataFrame
    edges: DataFrame

    def node(self, *labels: str) -> DataFrame:
        return self.nodes.where(F.col("label").isin(list(labels))) if labels else self.nodes

    def edge(self, *types: str) -> DataFrame:
        return self.edges.where(F.col("type").isin(list(types))) if types else self.edges

    def views(self, spark: SparkSession) -> None:
        """Temporary views ``nodes`` and ``edges`` for SQL users."""
        self.nodes.createOrReplaceTempView("nodes")
        self.edges.createOrReplaceTempView("edges")

    def write(self, path: str) -> None:
        """Edges by type and nodes by label, so that typed patterns prune partitions."""
        self.nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
        self.edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")

    @staticmethod
    def read(spark: SparkSession, path: str) -> PropertyGraph:
        return PropertyGraph(spark.read.parquet(f"{path}/nodes").select(*NODE_COLUMNS), spark.read.parquet(f"{path}/edges").select(*EDGE_COLUMNS))


def build_nodes(symbols: DataFrame) -> DataFrame:
    """Current row of each id. One aggregate a column, so that a query reads and shuffles only what it
    uses; this relies on the staging contract that rows of an id with equal ``updated_at`` are identical
    (``upsert_last`` decides ties by the whole row, at the price of always moving it)."""
    cols = [c for c in NODE_COLUMNS if c not in ("id", "label")]
    now = symbols.where(F.col("id").isNotNull()).groupBy("id").agg(*[F.max_by(c, "updated_at").alias(c) for c in cols])
    return now.withColumn("label", label()).select(*NODE_COLUMNS)


def build_edges(references: DataFrame, legacy_key: bool = False) -> DataFrame:
    """First reference per (source, target, type, line, column); ``legacy_key`` leaves the type out."""
    r = references.select(F.col("id").alias("eid"), F.col("source_id").alias("src"), F.col("target_id").alias("dst"), edge_type().alias("type"), "line_number", "column_number")
    keys = ["src", "dst", "line_number", "column_number"] + ([] if legacy_key else ["type"])
    return insert_first(r, keys, ["eid"]).select(*EDGE_COLUMNS)


def structure_edges(nodes: DataFrame) -> DataFrame:
    """parent -> child: DEFINES from files to class-like symbols and functions and from class-like symbols
    to members, CONTAINS otherwise. ``eid`` is negative, so that it never meets a reference's."""
    kid = nodes.where(F.col("parent_id").isNotNull()).select(F.col("id").alias("dst"), F.col("parent_id").alias("src"), F.col("type").alias("_k"), "line_number")
    up = nodes.select(F.col("id").alias("src"), F.col("type").alias("_p"))
    defines = ((F.col("_p") == "file") & F.col("_k").isin([*CLASS_TYPES, "function"])) | F.col("_p").isin(CLASS_TYPES)
    return kid.join(up, "src").select(
        (-1 - F.abs(F.xxhash64("dst") % F.lit(2**61))).alias("eid"), "src", "dst", F.when(defines, "DEFINES").otherwise("CONTAINS").alias("type"), "line_number", F.lit(0).alias("column_number")
    )


def code_graph(symbols: DataFrame, references: DataFrame) -> PropertyGraph:
    """Graph of the references between stored symbols."""
    return PropertyGraph(build_nodes(symbols), build_edges(references))


def structure_graph(symbols: DataFrame) -> PropertyGraph:
    """Graph of directories, files, classes and members."""
    nodes = build_nodes(symbols)
    return PropertyGraph(nodes, structure_edges(nodes))
