"""JSON metadata: class names and hooks in configuration documents."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import ship

# Keys that list hook classes, and the mark of lists that extend others.
HOOK_KEYS = ["beforeLoginHookClassNameList", "onLoginHookClassNameList", "onFailHookClassNameList", "onSuccessHookClassNameList", "onSuccessByTokenHookClassNameList", "onSecondStepRequiredHookClassNameList"]
APPEND = "__APPEND__"
CLASS_NAME = r"^[A-Z][A-Za-z0-9_\\]+$"
METADATA_PATHS = r"(/[Rr]esources/metadata/.*\.json|/Custom/Resources/.*\.json)$"


def read_metadata(spark: SparkSession, root: str) -> DataFrame:
    """(config_file, json) of the metadata documents under a root; each file once."""
    d = spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").option("pathGlobFilter", "*.json").text(root)
    return d.select(F.input_file_name().alias("config_file"), F.col("value").alias("json")).where(F.col("config_file").rlike(METADATA_PATHS))


def hooks(documents: DataFrame) -> DataFrame:
    """(config_file, config_key, class_name) of the known hook lists."""
    parts = [documents.select("config_file", F.lit(k).alias("config_key"), F.explode(F.from_json(F.get_json_object("json", f"$.{k}"), "array<string>")).alias("class_name")) for k in HOOK_KEYS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where((F.col("class_name") != APPEND) & F.col("class_name").rlike(CLASS_NAME) & F.col("class_name").contains("\\"))


def _leaves(value, trail: str, out: list[tuple[str, str]], strings_only: bool) -> None:
    stack = [(value, trail)]
    while stack:
        v, t = stack.pop()
        if isinstance(v, dict):
            stack += [(x, f"{t}::{k}" if t else k) for k, x in v.items()]
        elif isinstance(v, list):
            stack += [(x, f"{t}::{i}" if t else str(i)) for i, x in enumerate(v)]
        elif isinstance(v, str):
            out.append((t, v))
        elif not strings_only and v is not None:
            out.append((t, json.dumps(v)))


def leaves(documents: DataFrame, key: str = "config_file", strings_only: bool = True) -> DataFrame:
    """(key, path, value) of every string leaf at any depth (or of every scalar, as JSON text); documents
    that are no JSON are skipped.

    Depth is unbounded, which the built-in JSON functions cannot follow: an Arrow batch at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, text in zip(b[key], b["json"]):
                found: list[tuple[str, str]] = []
                try:
                    _leaves(json.loads(text), "", found, strings_only)
                except (TypeError, ValueError, RecursionError):
                    continue
                out += [(k, t, v) for t, v in found]
            yield pd.DataFrame(out, columns=[key, "path", "value"])

    ship(documents.sparkSession)
    kind = dict(documents.dtypes)[key]
    return documents.select(key, "json").mapInPandas(run, f"{key} {kind}, path string, value string")


def class_references(documents: DataFrame, key: str = "config_file") -> DataFrame:
    """Leaves that name a class."""
    v = F.col("value")
    return leaves(documents, key).where(v.rlike(CLASS_NAME) & v.contains("\\")).select(key, F.col("path").alias("config_key"), v.alias("class_name"))
