"""Readers and writers, dispatched by suffix; append-only checkpoints; versioned overwrites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.sources.session import materialize

#: One line of a checkpoint of generated texts.
CHECKPOINT = T.StructType([T.StructField(n, T.IntegerType() if n in ("sent_idx", "percentage") else T.StringType()) for n in ("id", "type", "model", "sent_idx", "percentage", "text", "rewritten")])
#: Keys of an older line that aren't a model's name.
OLD_KEYS = ["id", "_id", "sent_idx", "text"]


def read_any(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet, CSV, TSV or JSON lines by suffix (S1, S4, S5, T22). Parquet filters and column choices are pushed down by the planner."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind in ("csv", "tsv"):
        return reader.options(header=True, sep="\t" if kind == "tsv" else ",", multiLine=True, escape='"').csv(path)
    if kind in ("json", "jsonl"):
        return reader.json(path)
    if kind == "parquet":
        return reader.parquet(path)
    raise ValueError(f"no reader for {path}")


def write_any(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write by suffix (K1-K4). ``mode`` "overwrite" first writes beside, so that a table may replace one it was read from (K2)."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if mode == "overwrite":
        df = materialize(df)
    writer = df.write.mode(mode)
    if kind in ("csv", "tsv"):
        writer.options(header=True, sep="\t" if kind == "tsv" else ",", escape='"').csv(path)
    elif kind in ("json", "jsonl"):
        writer.option("ignoreNullFields", False).json(path)
    elif kind == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"no writer for {path}")


def write_versioned(df: DataFrame, path: str, version: str) -> str:
    """Keep earlier outputs (K9): write to ``path``/v=``version`` and return that path."""
    target = f"{path.rstrip('/')}/v={version}"
    df.write.parquet(target)
    return target


def load_state(spark: SparkSession, path: str, schema: T.StructType, fresh: bool = False) -> DataFrame:
    """The saved table, or an empty one of that schema."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)
    return read_any(spark, path, schema) if there and not fresh else spark.createDataFrame([], schema)


def parse_checkpoint(lines: DataFrame, value: str = "value") -> DataFrame:
    """Checkpoint lines in long form (S6, G10): the columns of CHECKPOINT, ``status`` (ok, blank, corrupt) and the columns of ``lines`` but ``value``.

    Newer lines have a model and a rewrite; older ones have each model's rewrite under the model's name, one
    row for each such key. Truncated or non-object lines are corrupt and have null fields; null lines are blank.
    """
    rest = [c for c in lines.columns if c != value]
    blank = F.trim(F.coalesce(F.col(value), F.lit(""))) == ""
    parsed = lines.withColumn("__m", F.from_json(F.col(value), "map<string,string>", {"mode": "PERMISSIVE"})).withColumn("__v", F.try_parse_json(F.col(value)))
    bad = F.col("__m").isNull() | F.col("__v").isNull()
    modern = F.map_contains_key("__m", F.lit("rewritten"))
    old = F.filter(F.map_entries("__m"), lambda e: ~e["key"].isin(OLD_KEYS))
    get = lambda k: F.try_element_at("__m", F.lit(k))
    pairs = F.when(blank | bad, F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value")))).when(modern, F.array(F.struct(get("model").alias("key"), get("rewritten").alias("value")))).otherwise(old)
    out = parsed.withColumn("__e", F.explode_outer(pairs))
    usable = ~(blank | bad)
    return out.select(
        *rest,
        F.when(blank, "blank").when(bad, "corrupt").otherwise("ok").alias("status"),
        F.when(usable, F.coalesce(get("id"), get("_id"))).alias("id"),
        F.when(usable, F.coalesce(get("type"), F.lit("sentence"))).alias("type"),
        F.col("__e.key").alias("model"),
        F.when(usable, get("sent_idx").try_cast("int")).alias("sent_idx"),
        F.when(usable, get("percentage").try_cast("int")).alias("percentage"),
        F.when(usable, get("text")).alias("text"),
        F.col("__e.value").alias("rewritten"),
    )
