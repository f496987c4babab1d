"""Operator 8: quality classifier with hierarchical empirical Bayes over sites."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.llm.common import broadcast_within, materialize, table

_LOWER, _UPPER, _DIGITS = re.compile("[^\\W\\d_]+"), re.compile("[A-Z]{2,}"), re.compile("[0-9]+")
_PLAIN = re.compile("[.,;:]+$")


def features(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's words (lower case, closing stops cut off) and their beginnings, of the shapes of those that aren't plain words, and of how often a word follows itself."""
    digest, out, words = xxhash.xxh64_intdigest, set(), text.split()
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    out.update(digest(b"\x02%d" % share) for share in (5, 20, 50) if 100 * again > share * len(words))
    for w in set(words):
        plain = _PLAIN.sub("", w)
        low = plain.lower()
        out.add(digest(low.encode("utf-8", "surrogatepass")))
        for n in (5, 7):
            if len(low) > n:
                out.add(digest(b"\x03" + low[:n].encode("utf-8", "surrogatepass")))
        if not plain.isalpha() or (len(plain) > 1 and plain.isupper()):
            shape = _LOWER.sub("a", _UPPER.sub("\x01", w)).replace("\x01", "A")
            out.add(digest(b"\x00" + _DIGITS.sub("9", shape).encode("utf-8", "surrogatepass")))
    return np.array(sorted(out), np.uint64)


@dataclass
class Classifier:
    """Logistic regression over the presence of selected features; ``prior`` is the share of bad documents it was fitted on."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def evidence(self, text: str) -> float:
        """Log-likelihood ratio of bad to good: the fitted log-odds less those of the prior."""
        f = features(text)
        at = np.minimum(np.searchsorted(self.keys, f), max(len(self.keys) - 1, 0))
        hit = at[self.keys[at] == f] if len(self.keys) and len(f) else np.zeros(0, int)
        return float(self.bias + self.weights[hit].sum() - np.log(self.prior / (1 - self.prior)))


def fit(rows: list[tuple[bytes, int]], max_features: int = 1000, least_docs: int = 5, lift: float = 2.0, steps: int = 500) -> Classifier:
    """Logistic regression, with a ridge and weights of 0 or more, over marks of bad documents.

    A mark is in ``least_docs`` documents or more, ``lift`` times as often bad as all are (or nine times in
    ten), and passes the G test at 0.01 over all features tested (Bonferroni); at most ``max_features`` of
    the strongest are kept. Common words, which only tell the length of a text, are no marks.
    """
    y = np.array([r[1] for r in rows], np.float64)
    n, bad = len(y), float(y.sum())
    prior = (bad + 0.5) / (n + 1)
    start = Classifier(np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior))), prior)
    if not n:
        return start
    lists = [np.frombuffer(r[0], np.uint64) for r in rows]
    flat, owner = np.concatenate(lists), np.repeat(np.arange(n), [len(x) for x in lists])
    keys, place, df = np.unique(flat, return_inverse=True, return_counts=True)
    with_bad = np.bincount(place, weights=y[owner], minlength=len(keys))
    usable = (df >= least_docs) & (with_bad / df >= min(lift * bad / n, 0.9))

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0)

    g = 2 * (part(with_bad, df * bad / n) + part(df - with_bad, df * (n - bad) / n) + part(bad - with_bad, (n - df) * bad / n) + part(n - bad - df + with_bad, (n - df) * (n - bad) / n))
    # Upper tail of chi-square with one degree of freedom is under exp(-g / 2).
    usable &= np.exp(-g / 2) * max(1, usable.sum()) <= 0.01
    chosen = np.flatnonzero(usable)
    chosen = np.sort(chosen[np.argsort(-g[chosen], kind="stable")[:max_features]])
    if not len(chosen):
        return start
    slot = np.full(len(keys), -1)
    slot[chosen] = np.arange(len(chosen))
    x = np.zeros((n, len(chosen)), np.float32)
    inside = slot[place] >= 0
    x[owner[inside], slot[place][inside]] = 1
    w, b = np.zeros(len(chosen)), start.bias
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):
        d = 1 / (1 + np.exp(-(x @ w.astype(np.float32) + b))) - y
        gw, gb = x.T @ d.astype(np.float32) / n + 1e-5 * w, d.mean()
        mw, vw, mb, vb = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        c = 0.1 / (1 - 0.9**step)
        w, b = np.maximum(w - c * mw / (np.sqrt(vw / (1 - 0.99**step)) + 1e-8), 0), b - c * mb / (np.sqrt(vb / (1 - 0.99**step)) + 1e-8)
    return Classifier(keys[chosen], w, float(b), prior)


def learn(docs: DataFrame, labels: DataFrame, key: str, text: str, max_labelled: int = 8000, max_bytes: int = 256 << 20) -> Classifier:
    """Fit on at most ``max_labelled`` labelled documents, chosen by a hash of the key, and at most ``max_bytes`` of their features, in that order; bad: any label of quality 0 or toxic 1.

    Labels without a key, quality and toxic mark, or without both of these, are ignored. A key counts once,
    however often its rows are repeated (of different texts, that of the least hash).
    """
    known = labels.where(F.col(key).isNotNull() & F.coalesce("quality", "toxic").isNotNull())
    bad = known.groupBy(key).agg(F.max((F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int")).alias("bad"))
    chosen = bad.orderBy(F.xxhash64(key), key).limit(max_labelled)
    whole = F.coalesce(F.col(text), F.lit(""))
    once = docs.join(F.broadcast(chosen), key).groupBy(key).agg(F.min_by(whole, F.struct(F.xxhash64(whole), F.length(whole))).alias("t"), F.min("bad").alias("bad"))
    rows = once.select("t", "bad", F.xxhash64(key).alias("place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([features(t).tobytes() for t in b.column(0).to_pylist()], pa.binary()), *b.columns[1:]], names=["x", "y", "place"])

    found = rows.mapInArrow(run, "x binary, y int, place long")
    # One window over max_labelled rows at most.
    within = found.withColumn("size", F.sum(F.length("x")).over(W.orderBy("place", "x"))).where(F.col("size") <= max_bytes)
    return fit([(bytes(r["x"]), r["y"]) for r in within.orderBy("place", "x").select("x", "y").collect()])


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(spread: float | None, noise: float | None, n: int | None, within: float | None, most: float = 1e6) -> float:
    """Beta prior strength by moments, from sums over groups: n (rate - mean)^2, mean (1 - mean), n, n mean (1 - mean). As many documents as a group must have for its own rate to weigh as much as its parent's."""
    between = ((spread or 0.0) - (noise or 0.0)) / (n or 1)
    return min((within or 0.0) / (n or 1) / between, most) if between > 0 else most


def _sums(groups: DataFrame, mean: Column) -> tuple:
    rows = groups.withColumn("v", mean * (1 - mean)).withColumn("e", F.col("n") * F.pow(F.col("bad") / F.col("n") - mean, 2))
    return tuple(rows.agg(F.sum("e"), F.sum("v"), F.sum("n"), F.sum(F.col("v") * F.col("n"))).first())


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", cutoff: float = 0.5, max_labelled: int = 8000, max_broadcast_sites: int = 10_000) -> DataFrame:
    """(``key``, ``host``, ``path``, evidence, site_rate, score, kept) per row; score is the posterior of a good document.

    The document classifier gives a likelihood ratio for the whole text. Its soft counts are summed by host
    and by path within host; a host's rate is shrunk toward the global rate, a path's toward its host's, with
    prior strengths estimated by moments, so that sparse sites stay near the global prior. The rate without
    the document's own share is its prior odds. Sums go by host and path with partial aggregation, so a hot
    host costs no more than others. Null text is empty; very long texts are read whole, each in its row; a null
    host or path is a value of its own; labels with a null key are ignored, and with no labels at all the
    evidence is 0 and everything is kept. Repeated rows are judged each but learnt from once; an empty table
    gives no rows; other columns are ignored.
    """
    net = learn(docs.select(key, text), labels.select(key, "quality", "toxic"), key, text, max_labelled)
    rows = docs.select(F.col(key).alias("__key"), F.col(host).alias("__host"), F.col(path).alias("__path"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = type(rows.schema)([*rows.schema.fields[:3], *docs.sparkSession.createDataFrame([], "evidence double").schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([net.evidence(t) for t in b.column(3).to_pylist()], pa.float64())], names=schema.names)

    judged = materialize(rows.mapInArrow(run, schema)).withColumn("bad", 1 / (1 + F.exp(-(F.col("evidence") + float(np.log(net.prior / (1 - net.prior)))))))
    paths = materialize(judged.groupBy("__host", "__path").agg(F.sum("bad").alias("bad"), F.count("*").alias("n")))
    hosts = materialize(paths.groupBy("__host").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")))
    total = hosts.agg(F.sum("bad"), F.sum("n")).first()
    rate = min(max((total[0] or 0.0) / (total[1] or 1), 1e-6), 1 - 1e-6)
    m_host = _strength(*_sums(hosts, F.lit(rate)))
    hosts = hosts.withColumn("host_rate", (F.col("bad") + m_host * rate) / (F.col("n") + m_host))
    by_path = paths.alias("p").join(broadcast_within(hosts.select(F.col("__host").alias("__h"), "host_rate"), max_broadcast_sites), F.col("__host").eqNullSafe(F.col("__h"))).drop("__h")
    m_path = _strength(*_sums(by_path, F.col("host_rate")))
    sites = by_path.select(F.col("__host").alias("__h"), F.col("__path").alias("__p"), F.col("bad").alias("site_bad"), F.col("n").alias("site_n"), "host_rate")
    joined = judged.join(broadcast_within(sites, max_broadcast_sites), F.col("__host").eqNullSafe(F.col("__h")) & F.col("__path").eqNullSafe(F.col("__p")))
    own = F.greatest(F.col("site_bad") - F.col("bad"), F.lit(0.0)) + m_path * F.col("host_rate")
    prior = F.least(F.greatest(own / (F.col("site_n") - 1 + m_path), F.lit(1e-6)), F.lit(1 - 1e-6))
    out = joined.withColumn("site_rate", prior).withColumn("score", 1 / (1 + F.exp(F.col("evidence") + logit(F.col("site_rate")))))
    return out.select(F.col("__key").alias(key), F.col("__host").alias(host), F.col("__path").alias(path), "evidence", "site_rate", "score", (F.col("score") >= cutoff).alias("kept"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of all ``documents``; hosts are sources, paths languages within them."""
    out = classify(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "evidence", "site_rate", "score", "kept")
