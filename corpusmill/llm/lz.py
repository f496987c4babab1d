"""Operator 5: document fingerprints from Lempel-Ziv phrases."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import table

BINS, SHIFT, EMPTY = 128, 57, -1


@dataclass
class Parse:
    """A text's dictionary phrases in order (LZ78: each is the shortest not seen before), and how many, with where the next began, when the parse came to ``mark``."""

    text: str
    mark: int
    phrases: list[str] = field(default_factory=list)
    at_mark: tuple[int, int] = (0, 0)


def parse_phrases(text: str, mark: int | None = None) -> Parse:
    out = Parse(text, len(text) if mark is None else mark)
    seen: set[str] = set()
    start, count = _walk(text, 0, 0, out.mark, seen, out.phrases)
    out.at_mark = (count, start)
    _walk(text, start, out.mark, len(text), seen, out.phrases)
    return out


def _walk(text: str, start: int, at: int, end: int, seen: set[str], phrases: list[str]) -> tuple[int, int]:
    for e in range(at + 1, end + 1):
        p = text[start:e]
        if p not in seen:
            seen.add(p)
            phrases.append(p)
            start = e
    return start, len(phrases)


def continue_phrases(parsed: Parse, edited: str) -> list[str]:
    """Phrases of ``edited`` that the parse of a text with the same first ``mark`` characters doesn't have yet, after its first ``at_mark`` ones."""
    count, start = parsed.at_mark
    fresh: list[str] = []
    _walk(edited, start, parsed.mark, len(edited), set(parsed.phrases[:count]), fresh)
    return fresh


def hash_phrases(phrases: list[str]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(p.encode("utf-8", "surrogatepass")) for p in phrases], np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minimum hash of each of BINS bins (one-permutation hashing), 16 bits of it; EMPTY where a bin has none."""
    h = np.sort(hashes)
    edges = np.searchsorted(h, np.arange(BINS, dtype=np.uint64) << np.uint64(SHIFT))
    full = np.diff(np.r_[edges, len(h)]) > 0
    out = np.full(BINS, EMPTY, np.int32)
    out[full] = (h[edges[full]] & np.uint64(0xFFFF)).astype(np.int32)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard likeness of two phrase sets: equal bins of those not empty in both; 1 for two empty sets."""
    used = (a != EMPTY) | (b != EMPTY)
    return float(((a == b) & used).sum() / used.sum()) if used.any() else 1.0


def as_text(sig: np.ndarray) -> str:
    return "".join(["...." if v == EMPTY else f"{v:04x}" for v in sig.tolist()])


def fingerprint_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", buckets_per_partition: int = 4) -> DataFrame:
    """(``key``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row.

    Rows go in descending order of ``key`` (null last, equal keys by a hash of the text); each is compared
    with an edited text, its last third replaced by the start of the next row's text (after the last row:
    the first), and with the next row. Keys are cut into ranges by approximate quantiles over all rows, and
    a key (or null) that fills several ranges by the hash of the text; each range gets one more row, the first
    of the next range, so that every task streams through its rows with two texts in hand. The edited text's
    parse goes on from the original's, which has the same start. Null text is empty: its fingerprint has only
    empty bins. A single row is its own next. Very long texts cost memory in proportion to one text. Repeated
    rows each have a result, and are each other's next. An empty table gives no rows; other columns are ignored,
    and none can clash.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions")) * buckets_per_partition
    rows = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    # n numbers at most come to the driver.
    cuts, nulls, count = docs.agg(F.percentile_approx(key, [i / n for i in range(1, n)], max(10_000, 10 * n)), F.count_if(F.col(key).isNull()), F.count("*")).first()
    place = F.struct(F.col("__key").isNull().alias("none"), F.bitwise_not(F.coalesce(F.col("__key"), F.lit(0)).cast("long")).alias("down"), F.xxhash64("__text").alias("tie"))
    bucket = _bucket(F.col("__key"), F.xxhash64("__text"), cuts or [], -(-n * nulls // max(count, 1)))
    placed = rows.withColumn("__bucket", bucket).withColumn("__place", place)
    firsts = sorted(tuple(r) for r in placed.groupBy("__bucket").agg(F.min("__place")).collect())
    schema = docs.select(key).schema
    for f in spark.createDataFrame([], "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").schema:
        schema = schema.add(f)
    # Bounded by the number of buckets: the first row of each, and the bucket that needs it besides.
    guests = spark.createDataFrame([(b, p, firsts[i - 1][0]) for i, (b, p) in enumerate(firsts)], "__b long, __first struct<none:boolean,down:bigint,tie:bigint>, __before long")
    spread = placed.join(F.broadcast(guests), (F.col("__bucket") == F.col("__b")) & (F.col("__place") == F.col("__first")), "left")
    home = F.struct(F.col("__bucket").alias("bucket"), F.lit(False).alias("guest"))
    spread = spread.select("__key", "__text", "__place", F.explode(F.when(F.col("__b").isNull(), F.array(home)).otherwise(F.array(home, F.struct(F.col("__before").alias("bucket"), F.lit(True).alias("guest"))))).alias("__at"))
    dealt = spread.select("__key", "__text", F.col("__at.bucket").alias("__bucket"), F.col("__at.guest").alias("__guest"), "__place").repartition("__bucket").sortWithinPartitions("__bucket", "__guest", "__place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (key, parse, hashes, bucket) of the row that waits for its next one
        out: list[tuple] = []
        for b in batches:
            columns = [b.column(c) for c in range(4)]
            for i in range(b.num_rows):
                bucket_, guest = columns[2][i].as_py(), columns[3][i].as_py()
                if guest and (held is None or held[3] != bucket_):
                    continue  # of equal first rows the first one serves
                words = columns[1][i].as_py()
                parsed = parse_phrases(words, len(words) - len(words) // 3)
                hashes = hash_phrases(parsed.phrases)
                sig = signature(hashes)
                if held is not None and held[3] == bucket_:
                    out.append(_row(*held[:3], words, sig))
                held = None if guest else (columns[0][i].as_py(), parsed, (hashes, sig), bucket_)
                if len(out) >= 512:
                    yield _batch(out, schema.names, b.schema.field(0).type)
                    out = []
        if out:
            yield _batch(out, schema.names, b.schema.field(0).type)

    return dealt.select("__key", "__text", "__bucket", "__guest").mapInArrow(run, schema)


def _bucket(key: Column, tie: Column, cuts: list[int], null_parts: int) -> Column:
    """Number of a row's range, in the order of rows: by how many ``cuts`` are above the key, and for a key that several cuts name (or null, for ``null_parts``), by its share of the hashes.

    Cuts are looked up in two steps, among every step-th and then within a step, from constant arrays.
    """
    down = sorted(set(cuts), reverse=True)
    parts = {c: cuts.count(c) for c in down} if len(down) < len(cuts) else {}
    step = max(1, math.isqrt(len(down)))
    numbers = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>") if xs else F.array().cast("array<bigint>")
    above = lambda xs: F.size(F.filter(xs, lambda c: c > key))
    coarse = above(numbers(down[step - 1 :: step]))
    rows = F.split(F.lit(";".join(",".join(map(str, down[i : i + step])) for i in range(0, len(down), step))), ";")
    fine = above(F.split(F.coalesce(F.get(rows, coarse), F.lit("")), ",").try_cast("array<bigint>"))
    before = coarse * step + fine if down else F.lit(0)
    several = {c: m for c, m in parts.items() if m > 1}
    share = lambda m: 1 + F.shiftright((F.shiftright(tie, 32) + (1 << 31)) * m, 32)
    own = F.lit(0).cast("long")
    if several:
        m = F.get(numbers(list(several.values())), F.array_position(numbers(list(several)), key).cast("int") - 1)
        own = F.coalesce(share(m), F.lit(0))
    number = F.shiftleft(before.cast("long"), 32) + own
    return F.when(key.isNull(), F.lit((len(down) + 1) << 32) + share(F.lit(max(1, null_parts)))).otherwise(number)


def _row(key, parsed: Parse, hashed: tuple[np.ndarray, np.ndarray], following: str, next_sig: np.ndarray) -> tuple:
    hashes, sig = hashed
    third = len(parsed.text) - parsed.mark
    edited = parsed.text[: parsed.mark] + following[:third]
    edited_sig = signature(np.concatenate([hashes[: parsed.at_mark[0]], hash_phrases(continue_phrases(parsed, edited))]))
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return key, len(parsed.text), digest, as_text(sig), as_text(edited_sig), likeness(sig, edited_sig), likeness(sig, next_sig)


def _batch(rows: list[tuple], names: list[str], key_type: pa.DataType) -> pa.RecordBatch:
    types = (key_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def op5_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all ``documents`` and of their edited texts."""
    return fingerprint_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
