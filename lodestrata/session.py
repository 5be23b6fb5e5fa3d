"""Sessions, tables, and tables that are prepared from others."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "lodestrata", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings as keywords with dots written as underscores twice (a__b)."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


class Tables:
    """The tables of a folder of Parquet files as attributes."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share; a local one only where the session runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "/tmp/checkpoints/lodestrata"


_PREPARED: dict[tuple, str] = {}


def _version(df: DataFrame) -> tuple:
    """The files that df reads, with their lengths and times."""
    spark, out = df.sparkSession, []
    for file in sorted(df.inputFiles()):
        where = spark._jvm.org.apache.hadoop.fs.Path(file)
        status = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where)
        out.append((file, status.getLen(), status.getModificationTime()))
    return tuple(out)


def prepared_path(name: str, source: DataFrame, write: Callable[[DataFrame, str], None]) -> str:
    """Where ``write`` put what it makes of source, once per application and version of source's files: an index, as at ingest."""
    spark = source.sparkSession
    key = (spark.sparkContext.applicationId, name, _version(source))
    if key not in _PREPARED:
        path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        write(source, path)
        _PREPARED[key] = path
    return _PREPARED[key]
