"""Schemas of the staging tables and of the graph, and the shared name normalisations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _I, _B, _TS = T.StringType(), T.IntegerType(), T.BooleanType(), T.TimestampNTZType()

SYMBOLS = T.StructType(
    [T.StructField(n, _S) for n in ("id", "name", "type", "file_path")]
    + [T.StructField("line_number", _I), T.StructField("column_number", _I)]
    + [T.StructField(n, _S) for n in ("namespace", "parent_id", "visibility")]
    + [T.StructField(n, _B) for n in ("is_static", "is_abstract", "is_final")]
    + [T.StructField(n, _S) for n in ("return_type", "parameters", "extends", "implements", "uses", "metadata", "hash")]
    + [T.StructField("created_at", _TS), T.StructField("updated_at", _TS)]
)
REFERENCES = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("source_id", _S), T.StructField("target_id", _S), T.StructField("reference_type", _S), T.StructField("line_number", _I), T.StructField("column_number", _I), T.StructField("context", _S), T.StructField("created_at", _TS)]
)
#: What extractors return for a file.
EXTRACTED = T.StructType(
    [T.StructField(n, _S) for n in ("file_path", "kind", "id", "name", "type")]
    + [T.StructField("line_number", _I), T.StructField("column_number", _I)]
    + [T.StructField(n, _S) for n in ("parent", "target", "detail")]
)


def edge_type(c: str | Column = "reference_type") -> Column:
    """Relationship type as loaded: upper case, ``-`` as ``_``."""
    return F.upper(F.replace(F.col(c) if isinstance(c, str) else c, F.lit("-"), F.lit("_")))


def symbol_id(file_path: str, name: str, line: str, column: str) -> Column:
    """Default id of a symbol stored without one: md5 of ``file:name:line:column``."""
    return F.md5(F.concat_ws(":", file_path, name, F.col(line).cast("string"), F.col(column).cast("string")))


def content_hash(name: str, type_: str, namespace: str) -> Column:
    """Change hash of a symbol: md5 of ``name:type:namespace``, a missing namespace being empty."""
    return F.md5(F.concat_ws(":", name, type_, F.coalesce(F.col(namespace), F.lit(""))))
