"""Incremental ingestion as a stream of file contents.

Each micro-batch keeps the files whose content hash is new, extracts their rows and appends them with
the batch number; a reader resolves "the latest batch of each file". Appending makes a batch that is
run again after a failure harmless: its rows carry the same number and replace nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.staging import needs_parsing, upsert_last
from loomgraph.sources.extract import extract

HASHES = "file_path string, hash string, last_parsed timestamp_ntz, batch long"


def _hashes(spark: SparkSession, table: str) -> DataFrame:
    try:
        return spark.read.schema(HASHES).parquet(f"{table}/hashes")
    except Exception:  # noqa: BLE001 - nothing has been written yet
        return spark.createDataFrame([], HASHES)


def ingest_batch(batch: DataFrame, batch_id: int, table: str) -> None:
    """Fold one batch of (file_path, content, fetched_at) into the table folder."""
    spark = batch.sparkSession
    now = upsert_last(batch.select("file_path", "content", "fetched_at").where("file_path is not null"), ["file_path"], ["fetched_at"])
    known = _hashes(spark, table).where(F.col("batch") < batch_id)
    fresh = needs_parsing(now, known.select("file_path", "hash", "last_parsed"))
    files = now.join(fresh.select("file_path", "new_hash"), "file_path")
    rows = extract(files).withColumn("batch", F.lit(batch_id).cast("long"))
    rows.write.mode("overwrite").parquet(f"{table}/rows/batch={batch_id}")
    hashes = files.select("file_path", F.col("new_hash").alias("hash"), F.col("fetched_at").cast("timestamp_ntz").alias("last_parsed"))
    hashes.write.mode("overwrite").parquet(f"{table}/hashes/batch={batch_id}")


def start(spark: SparkSession, source: str, schema: str, table: str, checkpoint: str, available_now: bool = True):
    """Stream a folder of parquet files with contents into the table folder."""
    stream = spark.readStream.schema(schema).parquet(source)
    writer = stream.writeStream.foreachBatch(lambda df, i: ingest_batch(df, i, table)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_rows(spark: SparkSession, table: str) -> DataFrame:
    """Extracted rows of the last batch in which each file was read."""
    rows = spark.read.parquet(f"{table}/rows")
    last = _hashes(spark, table).groupBy("file_path").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["file_path", "batch"], "left_semi")
