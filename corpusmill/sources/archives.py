"""Zip containers and document folders as tables: (path, name, stem, ext[, content])."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import shard_of


def stem(name: Column) -> Column:
    """Last path part without its extension."""
    return F.regexp_extract(name, r"([^/]+?)(\.[^./]*)?$", 1)


def extension(name: Column) -> Column:
    """Extension of the last path part, lower-case, without the dot; empty if none."""
    return F.lower(F.regexp_extract(name, r"[^/]\.([^./]+)$", 1))


#: Schemes whose archives are read in place, member by member; Spark reads others whole, so those must fit a task.
IN_PLACE = ("", "file", "s3", "gs")
#: A batch of members closes at this many bytes or members.
BATCH_BYTES, BATCH_MEMBERS = 32 << 20, 1000


def open_place(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a path or URI, and the path in it."""
    parts = urlparse(uri)
    return (fs.LocalFileSystem(), uri.removeprefix("file:").replace("///", "/", 1)) if parts.scheme in ("", "file") else fs.FileSystem.from_uri(uri)


def list_zips(spark: SparkSession, path: str, content: bool = False, extensions: tuple[str, ...] = ()) -> DataFrame:
    """Members of the zip files under ``path`` (S7-S9, K6), read on the executors one archive at a time. Broken archives have no members.

    A task holds a batch of members at once, not an archive.
    """
    fields = [pa.field("path", pa.string()), pa.field("name", pa.string()), pa.field("size", pa.int64()), pa.field("content", pa.binary())]
    whole = urlparse(path).scheme not in IN_PLACE

    def members(where: str, source: BinaryIO) -> Iterator[tuple]:
        try:
            archive = zipfile.ZipFile(source)
        except (zipfile.BadZipFile, pa.ArrowInvalid):  # Arrow refuses to seek before the start of a short file
            return
        for info in archive.infolist():
            ext = info.filename.rsplit(".", 1)[-1].lower() if "." in info.filename else ""
            if not info.is_dir() and (not extensions or ext in extensions):
                yield where, info.filename, info.file_size, archive.read(info) if content else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=pa.schema(fields))
        for b in batches:
            for i, where in enumerate(b.column(0).to_pylist()):
                held, size = [], 0
                files, inside = (None, "") if whole else open_place(where)
                with io.BytesIO(b.column(1)[i].as_py()) if whole else files.open_input_file(inside) as source:
                    for row in members(where, source):
                        held.append(row)
                        size += len(row[3] or b"")
                        if size >= BATCH_BYTES or len(held) >= BATCH_MEMBERS:
                            yield packed(held)
                            held, size = [], 0
                if held:
                    yield packed(held)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path)
    out = files.select("path", *(["content"] if whole else [])).mapInArrow(run, "path string, name string, size long, content binary")
    out = out.withColumn("stem", stem(F.col("name"))).withColumn("ext", extension(F.col("name")))
    return out if content else out.drop("content")


def index_zips(members: DataFrame) -> DataFrame:
    """One row per file name: the last archive (by path) that has it."""
    return members.groupBy("name").agg(F.max("path").alias("path"))


def read_text(members: DataFrame) -> DataFrame:
    """Members with their content as UTF-8 text."""
    return members.withColumn("text", F.decode("content", "UTF-8"))


def list_folders(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """Files below ``path``: (path, folder, name, ext[, content]) (S10, D5). Without ``content`` no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", *(["content"] if content else []))
    return files.withColumn("folder", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1)).withColumn("ext", extension(F.col("name")))


def rename_meta(members: DataFrame) -> DataFrame:
    """``_meta`` leaves the last part of names; a renamed member takes the place of one that has its new name (the last by its old name, of several)."""
    to = F.regexp_replace("name", r"_meta(?=[^/]*$)", "")
    moved = members.where(F.col("name") != to).groupBy(to.alias("__to")).agg(F.max("name").alias("__from"))
    rows = members.withColumn("__to", to).join(moved, "__to", "left").where(F.col("__from").isNull() | (F.col("name") == F.col("__from")))
    return rows.withColumn("name", F.col("__to")).select(*members.columns)


def pack_zips(members: DataFrame, folder: str, shard: str = "shard") -> DataFrame:
    """Write (``shard``, name, content) rows as one zip per shard into a shared folder (K5, K7, K8); returns (shard, files, bytes).

    Names are flattened to their last part; of equal names in a shard the first in order is kept; null contents and
    names have no member, a null shard is called "none". ``folder`` is a path or a URI of any file system that Arrow
    knows. Rows reach a task sorted and are written as they come, so it holds a batch, not a shard. Each archive is
    built beside its place and moved there, so a retried task leaves a whole one.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = open_place(folder)
        open_: tuple | None = None

        def close() -> pa.RecordBatch:
            key, beside, out, z, seen, size = open_
            z.close()
            out.close()
            files.move(beside, f"{place.rstrip('/')}/{key}.zip")
            return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([seen[0]], pa.int64()), pa.array([size[0]], pa.int64())], names=["shard", "files", "bytes"])

        for b in batches:
            for i, (key, name) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if open_ is None or open_[0] != key:
                    if open_ is not None:
                        yield close()
                    files.create_dir(place, recursive=True)
                    beside = f"{place.rstrip('/')}/{key}.zip.{uuid.uuid4().hex}"
                    out = files.open_output_stream(beside)
                    open_, last = (key, beside, out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED), [0], [0]), None
                if name != last:
                    body = b.column(2)[i].as_py()
                    open_[3].writestr(zipfile.ZipInfo(name), body, zipfile.ZIP_DEFLATED)
                    open_[4][0] += 1
                    open_[5][0] += len(body)
                    last = name
        if open_ is not None:
            yield close()

    rows = members.select(F.coalesce(F.col(shard).cast("string"), F.lit("none")).alias("shard"), F.regexp_extract("name", r"([^/]*)$", 1).alias("name"), F.col("content").cast("binary").alias("content"))
    rows = rows.where("name IS NOT NULL AND content IS NOT NULL").repartition("shard").sortWithinPartitions("shard", "name", "content")
    return rows.mapInArrow(build, "shard string, files long, bytes long")


def split_store(archives: DataFrame, folders: DataFrame | None, target: str, workers: int, run: str = "0", chunks: int = 1) -> DataFrame:
    """Members of archives, and files of folders, as one zip for each worker: ``target``/part_<worker>.<run>.<chunk>.zip.

    A member's id is its stem, a file's that of its folder; the id's shard (F16) says whose it is. What an earlier run
    put into ``target`` is left out. ``chunks`` cuts a worker's share, so that it is written by as many tasks.
    ``archives``: (name, stem, content), ``folders``: (folder, name, content).
    """
    rows = archives.select("name", F.col("stem").alias("__id"), "content")
    if folders is not None:
        rows = rows.unionByName(folders.select("name", F.col("folder").alias("__id"), "content"))
    rows = rows.withColumn("__worker", shard_of(F.col("__id"), workers))
    spark = archives.sparkSession
    files, place = open_place(target)
    if files.get_file_info(place).type != fs.FileType.NotFound:
        there = list_zips(spark, target).select(F.regexp_extract("path", r"part_(\d+)\.[^/]*$", 1).cast("int").alias("__worker"), F.col("name").alias("__flat")).distinct()
        rows = rows.withColumn("__flat", F.regexp_extract("name", r"([^/]*)$", 1)).join(there, ["__worker", "__flat"], "left_anti")
    named = rows.withColumn("shard", F.concat(F.lit("part_"), F.col("__worker"), F.lit(f".{run}."), F.pmod(F.xxhash64("__id"), F.lit(chunks))))
    return pack_zips(named, target)


def merge_stores(members: DataFrame, target: str, chunks: int = 1) -> DataFrame:
    """Members of all workers' zips as ``chunks`` archives ``target``/all_<chunk>.zip; of equal names the one of the last archive (by path) is kept."""
    last = members.groupBy("name").agg(F.max("path").alias("path"))
    kept = members.join(last, ["name", "path"], "left_semi")
    return pack_zips(kept.withColumn("shard", F.concat(F.lit("all_"), F.pmod(F.xxhash64("name"), F.lit(chunks)))), target)
