"""File sources: trees read as binary files, discovery predicates, directory and file rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import paths


def read_tree(spark: SparkSession, root: str, glob: str = "*", language: str | None = None) -> DataFrame:
    """(file_path, content) of the files under a root; listing and reading are distributed by Spark."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    df = files.select(F.regexp_replace("path", "^file:/*", "/").alias("file_path"), F.decode("content", "UTF-8").alias("content"))
    return df.where(paths.discovered(F.col("file_path"), language)) if language else df


def structure(files: DataFrame, prune: bool = True, extensions: list[str] | None = None) -> DataFrame:
    """Directory and file rows (id, name, type, file_path, parent_id) of a list of paths, each once."""
    p = files.where(F.col("file_path").isNotNull()).select(paths.norm("file_path").alias("p")).distinct()
    p = p.where(~paths.pruned(F.col("p"))) if prune else p
    dirs = p.select(F.explode(paths.prefixes(F.col("p"))).alias("p")).distinct()
    up = paths.parent(F.col("p"))
    row = lambda kind, pre: (
        F.concat(F.lit(pre), F.md5("p")).alias("id"), paths.basename(F.col("p")).alias("name"), F.lit(kind).alias("type"), F.col("p").alias("file_path"), F.concat(F.lit("dir_"), F.md5(up)).alias("parent_id"),
    )
    return dirs.select(*row("directory", "dir_")).unionByName(p.where(paths.extension(F.col("p")).isin(extensions or paths.INDEXABLE)).select(*row("file", "file_")))


def read_config(path: str) -> dict:
    """YAML or JSON configuration; a relative ``root`` is taken from the file's own directory."""
    import json
    from pathlib import Path

    text = Path(path).read_text()
    if path.endswith(".json"):
        conf = json.loads(text)
    else:
        import yaml

        conf = yaml.safe_load(text)
    conf = conf or {}
    project = conf.setdefault("project", {})
    root = Path(project.get("root", "."))
    project["root"] = str(root if root.is_absolute() else (Path(path).parent / root).resolve())
    project.setdefault("languages", [])
    conf.setdefault("plugins", [])
    return conf
