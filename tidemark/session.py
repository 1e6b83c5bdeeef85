"""Session helpers: the shared folder jobs stage into, and cutting a plan there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL_ROOTS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local-mode session (tests) may fall back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="tidemark-")
    return _LOCAL_ROOTS[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, never handed out twice."""
    return f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder no later plan reads."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def cut(df: DataFrame, label: str = "cut", at: str | None = None) -> DataFrame:
    """Materialise ``df`` as a table in the shared folder and return a scan of it.

    Rows are computed once, survive the loss of executors, and the new scan carries true sizes for the
    optimizer. Used where a plan would otherwise grow with every round of an iteration, or where a
    value such as a partition number has to stay fixed. ``at`` names the folder for a caller that removes
    it again.
    """
    spark = df.sparkSession
    path = at or scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_counted(df: DataFrame, label: str = "cut") -> tuple[DataFrame, int]:
    """Like ``cut``, with the number of rows observed while writing.

    A re-run stage may count a row twice, so the number is an upper bound; zero is always zero.
    """
    watch = Observation()
    written = cut(df.observe(watch, F.count(F.lit(1)).alias("n")), label)
    return written, watch.get["n"]


def drop_scratch(spark: SparkSession) -> None:
    """Delete everything this application staged below the shared folder."""
    remove_path(spark, f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}")
