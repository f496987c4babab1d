"""The detector of machine-written texts: labelled sets, a split by group, character n-grams, a linear model, its figures."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import strip
from corpusmill.operators import margins as M
from corpusmill.operators.cleaning import sums_before
from corpusmill.operators.rewrites import FAILED
from corpusmill.sources.session import discard, materialize


def long_labels(df: DataFrame, key: str, human: str, models: list[str]) -> DataFrame:
    """M1: (abstract_id, text, label): the human text 0, each model's column 1; blank and failed ones are left out."""
    cells = [F.struct(F.col(human).alias("text"), F.lit(0).alias("label")), *[F.struct(F.col(m).alias("text"), F.lit(1).alias("label")) for m in models]]
    rows = df.select(F.col(key).alias("abstract_id"), F.explode(F.array(*cells)).alias("c")).select("abstract_id", "c.text", "c.label")
    return rows.where((strip(F.coalesce(F.col("text"), F.lit(""))) != "") & (F.col("text") != FAILED))


def group_split(df: DataFrame, group: str, share: float = 0.2) -> DataFrame:
    """M2: ``is_test`` by group: the share of distinct groups, rounded up, of least MD5. No group is on both sides.

    The rank among group hashes is found by counting: only the cut between test and train comes to the driver.
    """
    hashed = df.select(F.col(group).alias("__g")).distinct().withColumn("__h", F.md5(F.col("__g").cast("string").cast("binary")))
    n = hashed.count()
    want = -(-int(round(n * share * 1e6)) // 1_000_000)
    cut = kth_smallest(hashed, "__h", want)
    h = F.md5(F.col(group).cast("string").cast("binary"))
    return df.withColumn("is_test", h <= F.lit(cut) if cut is not None else F.lit(False))


def kth_smallest(df: DataFrame, hex_column: str, k: int, leaf: int = 100_000) -> str | None:
    """The k-th smallest of distinct hex strings: counts by the next digits narrow the range until few are left."""
    if k < 1:
        return None
    prefix = ""
    while True:
        inside = df.where(F.startswith(hex_column, F.lit(prefix)))
        if inside.limit(leaf + 1).count() <= leaf:
            rows = inside.orderBy(hex_column).select(hex_column).limit(k).collect()
            return rows[-1][0] if rows else None
        for digits, n in sorted(inside.groupBy(F.substring(hex_column, len(prefix) + 1, 3)).count().collect()):
            if k <= n:
                prefix += digits
                break
            k -= n


def flat_text(text: Column) -> Column:
    """The lower-cased text with single spaces, empty for null."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s\s+", " ")


def char_ngrams(text: Column, low: int = 3, high: int = 5) -> Column:
    """M3: character n-grams of the lower-cased text with single spaces, in time linear in the text: each match takes one code point and looks ahead."""
    return F.concat(*[F.regexp_extract_all(flat_text(text), F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)) for n in range(low, high + 1)])


def tfidf_table(df: DataFrame, key: str, text: str, low: int = 3, high: int = 5) -> DataFrame:
    """M3 as rows (key, term, weight): (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), each document's weights of length 1."""
    counts = df.select(key, F.explode(char_ngrams(F.col(text), low, high)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    docs = df.select(key).distinct().count()
    seen = counts.groupBy("term").agg(F.count("*").alias("df"))
    raw = counts.join(seen, "term").withColumn("w", (1 + F.log("tf")) * (F.log((1.0 + docs) / (1 + F.col("df"))) + 1))
    norms = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


class Detector:
    """M3, M4, M7: n-gram weights and a linear SVM, of the definition of ``CountVectorizer``, ``IDF``, ``Normalizer`` and ``LinearSVC``.

    As in the reference, every n-gram of the training texts is a feature, unless ``vocabulary`` or ``least_docs`` say otherwise.
    Equal frequencies are ordered by the n-gram's integer. Each step of the solver reads all packed documents, which
    executors cache; later trials of a step read scores. Each core sends a gradient. The driver holds some 30 numbers for each feature (about 800,000 features of 100,000 documents). Without
    rows all scores are 0.
    """

    def __init__(self, vocabulary: int | None = None, least_docs: float = 1, iterations: int = 50) -> None:
        self.size, self.least_docs, self.iterations, self.penalty = vocabulary, least_docs, iterations, 1e-3

    def fit(self, df: DataFrame) -> Detector:
        sc = df.sparkSession.sparkContext
        train = materialize(df.select(flat_text(F.col("text")).alias("text"), "label"))
        self.counter = self._lexicon(train)
        lexicon = sc.broadcast(self.counter)
        packed = train.rdd.mapPartitions(lambda rows: M.pack(rows, lexicon.value)).persist(StorageLevel.MEMORY_AND_DISK)
        packed.count()
        chunks = packed.coalesce(max(1, min(packed.getNumPartitions(), sc.defaultParallelism)))
        self.coefficients, self.intercept = self._solve(sc, chunks, lexicon)
        packed.unpersist()
        discard(train)
        return self

    def _lexicon(self, train: DataFrame) -> M.Lexicon:
        def found(f) -> np.ndarray:
            rows = train.select("text").mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"k": x.astype(np.int64)}) for x in [M.distinct(f(t) for b in batches for t in b.column(0).to_pylist())]), "k long").distinct()
            return np.sort(rows.toArrow().column("k").to_numpy()).astype(np.uint64)

        coder = M.Coder(found(M.code_points))
        if coder.wide:
            coder.threes = found(lambda t: coder.of_three(coder.digits(t)))
        capped = self.size is not None

        def count(batches):
            for k, docs, n in M.frequencies((t for b in batches for t in b.column(0).to_pylist()), coder, capped):
                yield pa.RecordBatch.from_pydict({"k": k.astype(np.int64), "df": docs, "n": n})

        seen = train.select("text").mapInArrow(count, "k long, df long, n long").groupBy("k").agg(F.sum("df").alias("df"), F.sum("n").alias("n")).toArrow()
        keys, df, n = (seen.column(c).to_numpy() for c in ("k", "df", "n"))
        docs = train.count()
        kept = np.flatnonzero(df >= (self.least_docs if self.least_docs >= 1 else self.least_docs * docs))
        kept = kept[np.lexsort((keys[kept], -n[kept]))][: self.size]
        order = np.argsort(keys[kept])
        return M.Lexicon(coder, keys[kept][order].astype(np.uint64), order.astype(np.int32), np.log((docs + 1.0) / (df[kept] + 1.0)), docs)

    def _solve(self, sc, chunks, lexicon) -> tuple[np.ndarray, float]:
        size, docs = len(self.counter), self.counter.docs
        if not docs:
            return np.zeros(size), 0.0
        one, two = (sum(x) for x in zip(*chunks.mapPartitions(lambda c: M.moments(c, lexicon.value)).collect(), strict=True))
        mean = one / docs
        std = np.sqrt(np.maximum(0, two - docs * mean * mean) / max(1, docs - 1))
        inverse = np.divide(1, std, out=np.zeros(size), where=std > 0)
        centre, idf = mean * inverse, self.counter.idf

        weights = lambda x: np.append(x[:-1] * inverse * idf, 0.0)
        offset = lambda x: float(x[-1] - x[:-1] @ centre)

        def objective(x: np.ndarray) -> tuple[float, np.ndarray]:
            sent = sc.broadcast((weights(x), offset(x)))
            loss, pull, slope = 0.0, 0.0, np.zeros(size + 1)
            for a, b, at, v in chunks.mapPartitions(lambda c: M.losses(c, *sent.value)).collect():
                loss, pull = loss + a, pull + b
                slope[slice(None) if at is None else at] += v
            sent.destroy()
            grad = np.append((slope[:-1] * idf * inverse - pull * centre) / docs + self.penalty * x[:-1], pull / docs)
            return loss / docs + self.penalty / 2 * (x[:-1] @ x[:-1]), grad

        held = []

        def leave() -> None:
            while held:
                rows, sent = held.pop()
                rows.unpersist()
                sent.destroy()

        def along(x: np.ndarray, dir_: np.ndarray):
            bound, bend, rows = 0.0, None, None

            def told(alpha: float, new: np.ndarray) -> tuple[float, float]:
                nonlocal bound, bend, rows
                if alpha > bound:
                    leave()
                    bound = 4 * alpha
                    bend = np.flatnonzero((x * dir_ < 0) & (abs(x) <= bound * abs(dir_)))
                    bend = bend[bend < size]
                    sent = sc.broadcast((weights(x), weights(dir_), bend))
                    rows = chunks.mapPartitions(lambda c: M.line(c, *sent.value)).persist(StorageLevel.MEMORY_AND_DISK)
                    held.append((rows, sent))
                bent, o, turn = ((new - x - alpha * dir_)[bend] * inverse[bend] * idf[bend], offset(new), offset(dir_))
                parts = rows.mapPartitions(lambda c: M.trial(c, alpha, bent, o, turn)).collect()
                loss, slope = (sum(p[i] for p in parts) for i in (0, 1))
                return loss / docs + self.penalty / 2 * (new[:-1] @ new[:-1]), slope / docs + self.penalty * (new[:-1] @ dir_[:-1])

            leave()
            return told

        x = M.owlqn(objective, np.zeros(size + 1), self.iterations, along=along)
        leave()
        return x[:-1] * inverse, float(x[-1] - x[:-1] @ centre)

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with score (the decision value) and prediction."""
        sent = df.sparkSession.sparkContext.broadcast((self.counter, self.coefficients * self.counter.idf, self.intercept))

        @F.pandas_udf("double")
        def decide(texts: pd.Series) -> pd.Series:
            return pd.Series([M.decision(t, *sent.value) for t in texts], dtype=float)

        return df.withColumn("score", decide(flat_text(F.col("text")))).withColumn("prediction", (F.col("score") > 0).cast("int"))

    def strongest(self, spark, n: int = 10, sides: tuple[str, str] = ("human", "machine")) -> DataFrame:
        """The terms of largest weight either way, ``sides`` naming labels 0 and 1, equal weights by the term; weights are on the driver."""
        rows, w = [], self.coefficients
        k = min(n, len(w))
        for side, sign in zip(sides, (1, -1), strict=True):
            ends = np.flatnonzero(sign * w <= np.partition(sign * w, k - 1)[k - 1]) if k else []
            ordered = sorted(((float(w[i]), self.counter.term(i)) for i in ends), reverse=sign < 0)
            rows += [(t, x, side) for x, t in ordered[:k]]
        return spark.createDataFrame(rows, "term string, weight double, side string")


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """M5: (label, prediction, n) of all four cells, those without rows 0."""
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("prediction"), F.col(f"n{a}{b}").alias("n")) for a in (0, 1) for b in (0, 1)]))
    sums = [F.count_if((F.col(label) == a) & (F.col(prediction) == b)).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)]
    return df.agg(*sums).select(cells.alias("c")).select("c.*")


def report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """M5: (label, precision, recall, f1, support) from the confusion counts, in one aggregate."""
    cells = df.groupBy(F.col(label).alias("l"), F.col(prediction).alias("p")).agg(F.count("*").alias("n"))
    rows = cells.select("n", "l", "p").withColumn("labels", F.array(F.lit(0), F.lit(1))).select("n", "l", "p", F.explode("labels").alias("label"))
    tp = F.sum(F.when((F.col("l") == F.col("label")) & (F.col("p") == F.col("label")), F.col("n")).otherwise(0))
    said, there = F.sum(F.when(F.col("p") == F.col("label"), F.col("n")).otherwise(0)), F.sum(F.when(F.col("l") == F.col("label"), F.col("n")).otherwise(0))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    out = rows.groupBy("label").agg(tp.alias("tp"), said.alias("said"), there.alias("support"))
    return out.select("label", share(F.col("tp"), F.col("said")).alias("precision"), share(F.col("tp"), F.col("support")).alias("recall"), share(2 * F.col("tp"), F.col("said") + F.col("support")).alias("f1"), "support")


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """M6: the area under the ROC curve by rank sums over distinct scores; ties count half."""
    per = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label)).cast("double").alias("pos"), F.sum(1 - F.col(label)).cast("double").alias("neg"))
    wins = sums_before(per, ["s"], "neg", "below").withColumn("w", F.col("pos") * (F.col("below") + F.col("neg") / 2))
    return wins.agg((F.sum("w") / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def mix_labels(human: DataFrame, machine: DataFrame, key: str) -> DataFrame:
    """M8: both sets with their label, in the order of a hash of key and label."""
    parts = [human.withColumn("label", F.lit(0)), machine.withColumn("label", F.lit(1))]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return both.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col("label").cast("string")).cast("binary")))
