"""Sessions, shared folders and materialised tables."""

from __future__ import annotations

import gc
import uuid
from urllib.parse import urlparse
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "corpusmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects: UTC, adaptive execution, Arrow."""
    builder = SparkSession.builder.appName(app)
    builder = builder.master(master) if master else builder
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _is_local(path: str) -> bool:
    return urlparse(path).scheme in ("", "file")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else one in the warehouse.

    A warehouse on a local file system is only shared where all run on one machine; elsewhere it is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        if _is_local(found) and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; {found} is on each machine's own disk")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def list_paths(spark: SparkSession, path: str) -> list[str]:
    """What lies right below a path of any Hadoop file system, in order (a file: itself); empty if nothing is there."""
    hadoop_path, files = _file_system(spark, path)
    return sorted(f.getPath().toString() for f in files.listStatus(hadoop_path)) if files.exists(hadoop_path) else []


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder that goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/corpusmill-{uuid.uuid4().hex}"
    hadoop_path, files = _file_system(spark, path)
    files.deleteOnExit(hadoop_path)
    return path


_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def materialize(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder (in a subfolder for each value of ``by``) and read it back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession)
    writer = df.write if by is None else df.write.partitionBy(by)
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame, part: str = "") -> None:
    """Delete what ``materialize`` wrote for tables (or a subfolder of them) that nothing reads any more."""
    for t in tables:
        hadoop_path, files = _file_system(t.sparkSession, f"{_PATHS[t]}/{part}".rstrip("/"))
        files.delete(hadoop_path, True)


def free_shuffles(df: DataFrame) -> None:
    """Let Spark delete the shuffle files of finished steps now: it does so once the driver's JVM has collected their plans."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def broadcast_within(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark ``df`` for broadcast only if it was counted to hold at most ``max_rows`` rows; else joins shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
