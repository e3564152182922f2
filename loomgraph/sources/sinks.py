"""Graph exports: statement scripts, bulk-load CSV, and the reader of relationship scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.labels import labels


def _quoted(c: str) -> Column:
    v = F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.concat(F.lit("'"), v, F.lit("'"))


def script_nodes(nodes: DataFrame, rule: str = "typed") -> DataFrame:
    """One CREATE statement a node in a column ``line``; absent properties are left out."""
    props = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), _quoted(c))) for c in ("id", "name", "type", "file_path", "namespace", "visibility")]
    props.append(F.when(F.col("line_number").isNotNull(), F.concat(F.lit("line_number: "), F.col("line_number").cast("string"))))
    return nodes.select(F.concat(F.lit("CREATE (:"), F.array_join(labels(rule), ":"), F.lit(" {"), F.concat_ws(", ", *props), F.lit("});")).alias("line"))


def script_edges(edges: DataFrame) -> DataFrame:
    """One MATCH ... CREATE statement an edge."""
    return edges.select(
        F.concat(F.lit("MATCH (s {id: "), _quoted("src"), F.lit("}), (t {id: "), _quoted("dst"), F.lit("}) CREATE (s)-[:"), F.col("type"), F.lit("]->(t);")).alias("line")
    )


def write_script(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as text files in parallel; nodes are to be run first."""
    script_nodes(nodes).write.mode("overwrite").text(f"{path}/nodes")
    script_edges(edges).write.mode("overwrite").text(f"{path}/edges")


def relationships(lines: DataFrame) -> DataFrame:
    """(src, dst, type) of the MATCH lines in a column ``value``; other lines are ignored."""
    line = r"^\s*MATCH\s+\(\w+[^{]*\{id:\s*'((?:[^'\\]|\\.)*)'\}\)\s*,\s*\(\w+[^{]*\{id:\s*'((?:[^'\\]|\\.)*)'\}\)\s*(?:CREATE|MERGE)\s+\(\w+\)-\[\w*:(\w+)[^\]]*\]->"
    plain = lambda i: F.regexp_replace(F.regexp_extract("value", line, i), r"\\(.)", "$1")
    return lines.where(F.col("value").rlike(line)).select(plain(1).alias("src"), plain(2).alias("dst"), F.regexp_extract("value", line, 3).alias("type"))


def read_relationships(spark: SparkSession, path: str) -> DataFrame:
    """``relationships`` of the text files under a path."""
    return relationships(spark.read.text(path))


# Column headers of the bulk-load format (``id:ID``, ``:LABEL``, ``:START_ID``, ``:END_ID``, ``:TYPE``, ``:int``).
def csv_nodes(nodes: DataFrame) -> DataFrame:
    """Bulk-load rows of the exported label groups; ``label`` is the group."""
    return nodes.withColumn("_l", labels("csv")).where("_l is not null").select(
        F.col("id").alias("id:ID"), "name", "type", F.coalesce("file_path", F.lit("")).alias("file_path"), F.coalesce("line_number", F.lit(0)).alias("line_number:int"),
        F.coalesce("namespace", F.lit("")).alias("namespace"), F.coalesce("visibility", F.lit("")).alias("visibility"), F.array_join("_l", ";").alias(":LABEL"), F.col("_l")[1].alias("label"),
    )


def csv_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias(":START_ID"), F.col("dst").alias(":END_ID"), F.coalesce("line_number", F.lit(0)).alias("line:int"), F.coalesce("column_number", F.lit(0)).alias("column:int"), F.col("type").alias(":TYPE"), F.col("type").alias("type"))


def write_csv(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One folder of CSV per label and per type."""
    csv_nodes(nodes).write.mode("overwrite").partitionBy("label").option("header", True).csv(f"{path}/nodes")
    csv_edges(edges).write.mode("overwrite").partitionBy("type").option("header", True).csv(f"{path}/edges")
