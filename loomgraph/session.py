"""Session access, table loading and lineage cuts.

Lineage is cut with tables written to the shared folder that the cluster names in
``spark.checkpoint.dir``; a private folder is used only where that setting is absent and the session is
local (tests, laptops): on a cluster a missing setting is an error. Tables that no result reads are
deleted when the operator returns, the others by ``clean`` or when the program ends.
A written table survives the loss of executors, keeps its column statistics (so Catalyst can size
joins) and is computed once.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_SHIPPED: set[str] = set()
_BASES: dict[str, list[str]] = {}


def get_spark(cpus: str | int = "*", app: str = "loomgraph", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once an application; called by all that runs Python there.
    Spark serves the archive from the driver, so the package need not be installed on the cluster."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="loomgraph-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "loomgraph.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(archive)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder for cut tables: the session's ``spark.checkpoint.dir``, else a private one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
    if app not in _LOCAL:
        private = tempfile.mkdtemp(prefix="loomgraph-cut-")
        atexit.register(shutil.rmtree, private, ignore_errors=True)
        _LOCAL[app] = "file://" + private
    return _LOCAL[app]


def clean(spark: SparkSession) -> None:
    """Delete the cut tables of this application; results that were not consumed can no longer be read."""
    app = spark.sparkContext.applicationId
    for base in _BASES.pop(app, []):
        p = spark._jvm.org.apache.hadoop.fs.Path(base)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _clean_all() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        clean(spark)


atexit.register(_clean_all)


class Cuts:
    """Tables written by one run of an operator; superseded ones can be dropped while it goes on."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        _BASES.setdefault(spark.sparkContext.applicationId, []).append(self.base)

    def write(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        """Write ``df`` and return it as a scan, so that later plans start from files."""
        self.count += 1
        path = os.path.join(self.base, f"t{self.count}")
        # Uncompressed, so that the file size Catalyst plans with is near the size in memory: a strongly
        # compressed table of numbers would pass for small and be broadcast.
        writer = df.write.option("compression", "none")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._cut_path = path  # type: ignore[attr-defined]
        return out

    def write_counted(self, df: DataFrame, what: Column | None = None) -> tuple[DataFrame, int]:
        """``write``, and the rows written (or the value of the aggregate ``what``), counted by the write itself."""
        seen = Observation()
        out = self.write(df.observe(seen, (F.count(F.lit(1)) if what is None else what).alias("n")))
        # a plan that Spark finds to be empty has nothing to observe
        return out, (seen.get.get("n") or 0)

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing will read any more."""
        path = getattr(df, "_cut_path", None)
        if path:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


    def finish(self, df: DataFrame) -> DataFrame:
        """Return the result after deleting the tables that its plan does not read."""
        name = self.base.rsplit("/", 1)[-1]
        read = {f.split(f"{name}/", 1)[1].split("/", 1)[0] for f in df.inputFiles() if f"{name}/" in f}
        jvm = self.spark._jvm
        for n in range(1, self.count + 1):
            if f"t{n}" not in read:
                p = jvm.org.apache.hadoop.fs.Path(os.path.join(self.base, f"t{n}"))
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        return df


#: Most rows of a side that may be broadcast after it was counted; about 100 bytes a row at most here.
BROADCAST_ROWS = 100_000


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint only for a side whose counted rows are within the bound; else a shuffle join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
