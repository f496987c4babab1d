"""Pages and files from elsewhere, by a function that is passed in (offline: a lookup in a table or dict)."""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import file_kind, link_key
from corpusmill.operators.integrate import downloadable, incomplete, insert_new
from corpusmill.sources.archives import list_zips, open_place, pack_zips
from corpusmill.sources.session import discard, list_paths, materialize

#: url -> (media type, body), or None where there is nothing
Fetcher = Callable[[str], tuple[str, bytes] | None]


def fetch(urls: DataFrame, url: str, fetcher: Fetcher, delay: tuple[float, float] = (0.0, 0.0), per_task: int = 200) -> DataFrame:
    """All columns of ``urls`` plus mime, body and status (ok, none, error) (S11, S12). A failure is a row's status.

    Calls run on the executors, one at a time per task, with a uniform delay between them.
    """
    names = urls.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = []
            for u in frame[url]:
                time.sleep(random.uniform(*delay))
                try:
                    found = fetcher(u) if u is not None else None
                    got.append((*found, "ok") if found else (None, None, "none"))
                except Exception:
                    got.append((None, None, "error"))
            yield frame.assign(mime=[g[0] for g in got], body=[g[1] for g in got], status=[g[2] for g in got])[[*names, "mime", "body", "status"]]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema)
    parts = max(1, -(-urls.count() // per_task))
    return urls.repartition(parts, F.col(url)).mapInPandas(run, f"{fields}, mime string, body binary, status string")


def crawl(list_page: Callable[[int], list[str] | None], patience: int = 3, most: int = 100_000) -> list[str]:
    """Distinct links of numbered listing pages, until more than ``patience`` in a row are empty or fail."""
    found: dict[str, None] = {}
    empty, number = 0, 1
    while empty <= patience and number <= most:
        links = list_page(number) or []
        fresh = [u for u in links if u not in found]
        empty = 0 if fresh else empty + 1
        found.update(dict.fromkeys(fresh))
        number += 1
    return list(found)


def missing_downloads(metadata: DataFrame, stems: DataFrame, key: str = "id") -> DataFrame:
    """Rows with a link, not known to be downloaded, whose id no store has."""
    return downloadable(metadata).join(stems.select(F.col("stem").alias(key)).distinct(), key, "left_anti")


def _fetch_into(place: str, rows: DataFrame, url: str, fetcher: Fetcher, delay: tuple[float, float], kind: Column, per_zip: int) -> DataFrame:
    """Fetch the files of ``rows`` (``stem`` names them, ``kind`` is their extension), zip those of a known kind under ``place``; returns ``rows`` with ``kind``, null where nothing was kept."""
    kept = (F.col("status") == "ok") & F.col("body").isNotNull()
    got = materialize(fetch(rows, url, fetcher, delay).withColumn("kind", F.when(kept, kind)))
    parts, run = max(1, -(-got.count() // per_zip)), uuid.uuid4().hex
    packed = got.where("kind IS NOT NULL").select(F.concat(F.lit(f"{run}-"), F.pmod(F.xxhash64("stem"), F.lit(parts))).alias("shard"), F.concat_ws(".", "stem", "kind").alias("name"), F.col("body").alias("content"))
    pack_zips(packed, place).write.format("noop").mode("overwrite").save()
    return got


def download_missing(metadata: DataFrame, place: str, fetcher: Fetcher, key: str = "id", delay: tuple[float, float] = (0.0, 0.0), per_zip: int = 5_000) -> DataFrame:
    """Fetch the files of rows that aren't downloaded into zips under ``place``; returns ``metadata`` with ``downloaded`` brought up to date.

    True where a zip has the key, false where there is no link or nothing was got; extensions by media type, else by
    link (F11). A null key is never fetched, a repeated one once (from the least of its links).
    """
    spark = metadata.sparkSession
    stems = lambda: list_zips(spark, place).select(F.col("stem").alias("__stem")).distinct()
    todo = downloadable(metadata).where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("stem")).agg(F.min("download_link").alias("link"))
    if list_paths(spark, place):
        todo = todo.join(stems(), F.col("stem") == F.col("__stem"), "left_anti")
    todo = materialize(todo)
    if todo.limit(1).count():
        discard(_fetch_into(place, todo, "link", fetcher, delay, file_kind(F.col("mime"), F.col("link")), per_zip))
    discard(todo)
    there = stems().withColumn("__there", F.lit(True)) if list_paths(spark, place) else spark.createDataFrame([], "__stem string, __there boolean")
    out = metadata.join(there, F.col(key).cast("string") == F.col("__stem"), "left")
    return out.withColumn("downloaded", F.coalesce(F.col("__there"), F.col("downloaded").eqNullSafe(True))).select(*metadata.columns)


def cached(url: str, path: str, chunks: Callable[[str], Iterable[bytes]]) -> str:
    """A dump's path, fetched chunk by chunk unless a finished copy is there; a copy that broke off is never taken for one."""
    files, place = open_place(path)
    if files.get_file_info(place).type == fs.FileType.NotFound:
        beside = f"{place}.{uuid.uuid4().hex}"
        files.create_dir(place.rsplit("/", 1)[0], recursive=True)
        with files.open_output_stream(beside) as out:
            for chunk in chunks(url):
                out.write(chunk)
        files.move(beside, place)
    return path


# -- a source that is scraped in steps ------------------------------------------------------------

#: Columns of a source's state, those that make metadata complete, and the media types whose files are kept.
STATE = T.StructType([T.StructField(n, {"year": T.IntegerType(), "downloaded": T.BooleanType()}.get(n, T.StringType())) for n in ("title", "first_name", "last_name", "college", "year", "promoter", "themes", "keywords", "text_homepage", "page_link", "download_link", "downloaded", "source")])
ESSENTIAL = ["title", "last_name", "college", "year", "promoter"]
KEPT = {"application/pdf": "pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "application/msword": "doc"}

#: page link -> metadata by column of STATE, or None where there is none
Facts = Callable[[str], dict | None]


class Scrape:
    """A source's state in a shared folder, advanced by steps that can be stopped and run again.

    The state is a log: each step (new links, a wave of metadata, a wave of downloads) is a table of its own, and a
    row of the state has, by link, the last value of each column that isn't null. So a step that was stopped is run
    again, and a finished one never is. Waves bound what a stop can lose; their rows are dealt by hash of the link.
    """

    def __init__(self, spark: SparkSession, folder: str, source: str, wave: int = 100_000, delay: tuple[float, float] = (0.0, 0.0)) -> None:
        self.spark, self.folder, self.source, self.wave, self.delay = spark, folder.rstrip("/"), source, wave, delay

    def state(self) -> DataFrame:
        done = [p for p in list_paths(self.spark, f"{self.folder}/log") if list_paths(self.spark, f"{p}/_SUCCESS")]
        if not done:
            return self.spark.createDataFrame([], STATE)
        log = self.spark.read.schema(T.StructType([*STATE, T.StructField("step", T.LongType())])).parquet(*done)
        return log.groupBy("page_link").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("step"))).alias(c) for c in STATE.names if c != "page_link"]).select(*STATE.names)

    def _save(self, rows: DataFrame) -> int:
        """Append one step; returns its number."""
        steps = [int(p.rsplit("-", 1)[1]) for p in list_paths(self.spark, f"{self.folder}/log")]
        n = max(steps, default=0) + 1
        given = [F.col(c).cast(STATE[c].dataType) if c in rows.columns else F.lit(None).cast(STATE[c].dataType).alias(c) for c in STATE.names]
        rows.select(*given, F.lit(n).cast("long").alias("step")).write.mode("overwrite").parquet(f"{self.folder}/log/step-{n:09d}")
        return n

    def _waves(self, todo: DataFrame) -> Iterator[DataFrame]:
        held = materialize(todo)
        n = -(-held.count() // self.wave)
        for i in range(n):
            yield held.where(F.pmod(F.xxhash64("page_link"), F.lit(n)) == i)
        discard(held)

    def gather(self, links: DataFrame) -> int:
        """Add the ``page_link`` values that the state lacks; returns how many those are."""
        state = self.state().select("page_link")
        fresh = materialize(insert_new(state.limit(0), links.select("page_link").join(state, "page_link", "left_anti").where("page_link IS NOT NULL"), "page_link"))
        n = fresh.count()
        if n:
            self._save(fresh.withColumn("source", F.lit(self.source)))
        discard(fresh)
        return n

    def describe(self, facts: Facts) -> None:
        """Metadata of rows that lack an essential value; a page that fails or has none is asked again next time. A year that isn't a number is null."""
        delay, names = self.delay, [c for c in STATE.names if c not in ("page_link", "downloaded", "source")]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = []
                for link in frame["page_link"]:
                    time.sleep(random.uniform(*delay))
                    try:
                        found = facts(link)
                    except Exception:
                        found = None
                    if found:
                        rows.append([link, *[None if found.get(c) is None else str(found[c]) for c in names]])
                yield pd.DataFrame(rows, columns=["page_link", *names], dtype=object)

        for rows in self._waves(incomplete(self.state(), ESSENTIAL).where("page_link IS NOT NULL").select("page_link")):
            got = rows.mapInPandas(run, ", ".join(f"{c} string" for c in ("page_link", *names)))
            self._save(got.withColumn("year", F.col("year").try_cast("double").cast("int")))

    def download(self, fetcher: Fetcher, per_zip: int = 5_000) -> None:
        """Files of rows with a link that aren't marked as downloaded, in zips under ``folder``/files, named by 12 digits of the page link's MD5.

        What a zip has already is only marked. Other media types, and failures, are marked as not downloaded.
        """
        place = f"{self.folder}/files"
        key = link_key(F.col("page_link"))
        todo = downloadable(self.state()).select("page_link", "download_link", key.alias("stem"))
        if list_paths(self.spark, place):
            there = list_zips(self.spark, place).select("stem").distinct()
            self._save(todo.join(there, "stem", "left_semi").withColumn("downloaded", F.lit(True)).select("page_link", "downloaded"))
            todo = todo.join(there, "stem", "left_anti")
        for rows in self._waves(todo):
            mime = F.lower(F.coalesce("mime", F.lit("")))
            kind = F.coalesce(*[F.when(F.contains(mime, F.lit(m)), F.lit(e)) for m, e in KEPT.items()])
            got = _fetch_into(place, rows, "download_link", fetcher, self.delay, kind, per_zip)
            self._save(got.select("page_link", F.col("kind").isNotNull().alias("downloaded")))
            discard(got)

    def run(self, links: DataFrame | None = None, facts: Facts | None = None, fetcher: Fetcher | None = None) -> DataFrame:
        """The steps whose source is given, in order; returns the state."""
        if links is not None:
            self.gather(links)
        if facts is not None:
            self.describe(facts)
        if fetcher is not None:
            self.download(fetcher)
        return self.state()
