"""Operator 4: quality rules with risk-controlled thresholds. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import WORD, broadcast_within, materialize, table, words

#: rule -> (metric rejects when "above" or "below" the cutoff, cutoffs from loosest to strictest)
CUTOFFS = {
    "symbol_ratio": ("above", [2.0, 1.0, 0.5, 0.3, 0.2, 0.1, 0.05]),
    "upper_ratio": ("above", [0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15]),
    "repeat_ratio": ("above", [0.18, 0.16, 0.14, 0.12, 0.1]),
    "dup_line_ratio": ("above", [0.8, 0.6, 0.5, 0.4, 0.3]),
    "word_length": ("below", [2.0, 2.5, 3.0, 3.5]),
}
#: Most false rejections of a stratum's verdict, all rules together, and the chance of missing that anywhere.
MAX_RISK, ERROR = 0.02, 0.05


def repeated_words(df: DataFrame, words_col: str, out: str, width: int = 5) -> DataFrame:
    """Add ``out``: words in ``width``-word windows that occur twice or more in the text, first ones included.

    Windows are compared by a 64-bit hash of the words' 64-bit hashes; all work stays within the row.
    """
    n = F.size(words_col)
    df = df.withColumn("__h", F.when(n > width, F.transform(words_col, lambda w: F.xxhash64(w))))
    window = lambda i: F.xxhash64(*[F.get(F.col("__h"), i + j) for j in range(width)])
    df = df.withColumn("__w", F.when(n > width, F.transform(F.sequence(F.lit(0), n - width), window)))
    df = df.withColumn("__p", F.when(F.size(F.array_distinct("__w")) < F.size("__w"), F.sort_array(F.transform("__w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = lambda i: F.get(F.col("__p"), i)["h"]
    same = lambda p, i: F.coalesce(p["h"] == at(i + 1), F.lit(False)) | F.when(i > 0, p["h"] == at(i - 1)).otherwise(False)
    df = df.withColumn("__r", F.sort_array(F.filter(F.transform("__p", lambda p, i: F.when(same(p, i), p["i"])), lambda x: x.isNotNull())))
    spans = F.transform("__r", lambda x, i: F.least(F.lit(width), F.coalesce(F.get(F.col("__r"), i + 1) - x, F.lit(width))))
    return df.withColumn(out, F.coalesce(F.aggregate(spans, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long")).drop("__h", "__w", "__p", "__r")


def measure(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` columns plus the counts and metrics of each whole text."""
    df = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__t")).withColumn("__words", words(F.col("__t")))
    df = df.withColumn("__lines", F.filter(F.split("__t", "\n"), lambda x: F.rlike(x, F.lit(WORD))))
    count = lambda pattern: F.regexp_count("__t", F.lit(pattern)).cast("long")
    df = repeated_words(
        df.select(
            *keep,
            "__words",
            F.size("__words").cast("long").alias("n_words"),
            F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
            count("[#*$%&|<>]").alias("n_symbols"),
            F.size("__lines").cast("long").alias("n_lines"),
            (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
            count("[A-Z]").alias("n_upper"),
        ),
        "__words",
        "n_repeat_words",
    ).drop("__words")
    ratio = lambda a, b: F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1))
    df = df.withColumns(
        {
            "symbol_ratio": ratio("n_symbols", "n_words"),
            "upper_ratio": ratio("n_upper", "word_chars"),
            "repeat_ratio": ratio("n_repeat_words", "n_words"),
            "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
            "word_length": ratio("word_chars", "n_words"),
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        }
    )
    # A generator of one row: a filter on the metrics isn't moved below it, where it would repeat all the
    # expressions above for each use.
    metrics = [c for c in df.columns if c not in keep]
    return df.select(*keep, F.explode(F.array(F.struct(*metrics))).alias("__m")).select(*keep, "__m.*")


def log_gamma(x: Column) -> Column:
    """Stirling's series after a shift by 8; relative error about 1e-13 for x >= 1."""
    y = x + 8.0
    shift = reduce(lambda a, b: a * b, [x + float(i) for i in range(8)])
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - F.log(shift)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p) where k < n p, else 1: the exact p-value of "the risk is over p".

    Summed from term k downward; terms beyond 40 standard deviations are under the double's precision.
    """
    k, n = k.cast("double"), n.cast("double")
    first = F.exp(log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    steps = F.least(k, F.floor(40 * F.sqrt(n)) + 100).cast("int")
    start = F.struct(first.alias("term"), first.alias("sum"))

    def step(acc: Column, j: Column) -> Column:
        term = acc["term"] * (k - j + 1) * F.lit(1 - p) / ((n - k + j) * F.lit(p))
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    total = F.aggregate(F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")), start, step, lambda a: a["sum"])
    return F.when(k < n * p, total).otherwise(F.lit(1.0))


def fires(rule: str, cutoff: Column | float) -> Column:
    return F.col(rule) >= cutoff if CUTOFFS[rule][0] == "above" else F.col(rule) <= cutoff


def _best_cutoff(tests: Column) -> Column:
    usable = F.transform(tests, lambda x, i: F.when(F.forall(F.slice(tests, F.lit(1), i + 1), lambda y: y["sure"]) & (x["gain"] > 0), F.struct(x["gain"], -x["i"], x["cut"])))
    return F.array_max(F.filter(usable, lambda x: x.isNotNull()))["cut"]


def select_cutoffs(measured: DataFrame, labels: DataFrame, key: str, stratum: str, max_risk: float = MAX_RISK, error: float = ERROR) -> DataFrame:
    """One row per stratum: ``stratum`` and the chosen cutoff of each rule (null: none is certified).

    Holdout: documents that pass the base rules and have a label; one with any label 0 counts as bad. A document
    goes if any rule fires, so each rule may use up ``max_risk`` / rules. For each stratum and rule, cutoffs are
    tested from loosest to strictest in fixed sequence, each by the exact binomial test of "it rejects more than
    that share of the good documents" at level ``error`` / (strata * rules); the sequence stops at the first
    that is not rejected. So with probability 1 - ``error`` the rules in use, together, reject under ``max_risk``
    of each stratum's good documents. Of the certified cutoffs the one with the largest share of bad less share
    of good documents is used, the loosest of equals, if that is above 0.
    """
    share = max_risk / len(CUTOFFS)
    good = labels.where(F.col("quality").isin(0, 1)).groupBy(key).agg(F.min("quality").alias("quality"))
    held = measured.where(~F.col("base_failed")).select(key, stratum, *CUTOFFS).join(good, key)
    is_good = F.col("quality") == 1
    sums = [F.sum(is_good.cast("long")).alias("n_good"), F.sum((~is_good).cast("long")).alias("n_bad")]
    for rule, (_, cuts) in CUTOFFS.items():
        for i, cut in enumerate(cuts):
            sums += [F.sum((is_good & fires(rule, cut)).cast("long")).alias(f"g_{rule}_{i}"), F.sum((~is_good & fires(rule, cut)).cast("long")).alias(f"b_{rule}_{i}")]
    counts = materialize(held.groupBy(stratum).agg(*sums))
    level = error / (max(1, counts.count()) * len(CUTOFFS))
    cells = [F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("i"), F.lit(cut).alias("cut"), F.col(f"g_{rule}_{i}").alias("g"), F.col(f"b_{rule}_{i}").alias("b")) for rule, (_, cuts) in CUTOFFS.items() for i, cut in enumerate(cuts)]
    tested = counts.select(stratum, "n_good", "n_bad", F.explode(F.array(*cells)).alias("c")).select(
        stratum,
        "c.rule",
        F.struct(
            F.col("c.i").alias("i"),
            (binomial_tail(F.col("c.g"), F.col("n_good"), share) <= level).alias("sure"),
            (F.col("c.b") / F.greatest("n_bad", F.lit(1)) - F.col("c.g") / F.greatest("n_good", F.lit(1))).alias("gain"),
            F.col("c.cut").alias("cut"),
        ).alias("test"),
    )
    best = tested.groupBy(stratum, "rule").agg(F.sort_array(F.collect_list("test")).alias("tests")).select(stratum, "rule", _best_cutoff(F.col("tests")).alias("cut"))
    return best.groupBy(F.col(stratum).alias("__stratum")).agg(*[F.max(F.when(F.col("rule") == rule, F.col("cut"))).alias(f"cut_{rule}") for rule in CUTOFFS])


def judge_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", max_risk: float = MAX_RISK, error: float = ERROR, max_broadcast_strata: int = 10_000, carry: list[str] | None = None) -> DataFrame:
    """``key``, ``stratum``, the counts and metrics, base_failed, rejected_by (array of rules) and kept; with ``carry``, a struct ``carried`` of those columns.

    Null text has no words and fails the base rules. Labels with a null key or a quality other than 0 and 1
    are ignored. A null stratum is one of its own. Without labels only the base rules reject. Repeated rows
    are judged each. Very long texts are handled within their row; other columns are ignored. Columns to
    carry are written with the metrics, so that texts are measured once; as fields of a struct they clash with
    no result.
    """
    keep = [key, stratum]
    if carry is not None:
        docs, keep = docs.select(key, stratum, F.col(text).alias("__whole"), F.struct(*carry).alias("carried")), [*keep, "carried"]
    measured = materialize(measure(docs, text if carry is None else "__whole", keep))
    cutoffs = materialize(select_cutoffs(measured, labels, key, stratum, max_risk, error))
    joined = measured.join(broadcast_within(cutoffs, max_broadcast_strata), F.col(stratum).eqNullSafe(F.col("__stratum")), "left").drop("__stratum")
    by = F.filter(F.array(*[F.when(fires(rule, F.col(f"cut_{rule}")), F.lit(rule)) for rule in CUTOFFS]), lambda x: x.isNotNull())
    out = joined.withColumn("rejected_by", by).drop(*[f"cut_{rule}" for rule in CUTOFFS])
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, holdouts from ``labels``, strata by language."""
    out = judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _quality_sql() -> str:
    share = MAX_RISK / len(CUTOFFS)
    rules = [(rule, i, cut, sign) for rule, (sign, cuts) in CUTOFFS.items() for i, cut in enumerate(cuts)]
    values = ", ".join(f"('{rule}', {i}, CAST({cut} AS DOUBLE), {'TRUE' if sign == 'above' else 'FALSE'})" for rule, i, cut, sign in rules)
    unpivot = " UNION ALL ".join(f"SELECT doc_id, lang, base_failed, '{rule}' AS rule, {rule} AS m FROM measured" for rule in CUTOFFS)
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) > 5)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY doc_id),
c AS (SELECT w.doc_id AS doc_id, lang, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(ls) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  len(regexp_extract_all(t, '[A-Z]')) AS n_upper, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
measured AS (SELECT *, n_symbols::DOUBLE / greatest(n_words, 1) AS symbol_ratio, n_upper::DOUBLE / greatest(word_chars, 1) AS upper_ratio, n_repeat_words::DOUBLE / greatest(n_words, 1) AS repeat_ratio,
  n_dup_lines::DOUBLE / greatest(n_lines, 1) AS dup_line_ratio, word_chars::DOUBLE / greatest(n_words, 1) AS word_length, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
long AS ({unpivot}),
lab AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
cuts(rule, i, cut, above) AS (VALUES {values}),
cnt AS (SELECT lang, cuts.rule AS rule, i, cut, above, count(*) FILTER (quality = 1) AS ng, count(*) FILTER (quality = 0) AS nb,
  count(*) FILTER (quality = 1 AND (CASE WHEN above THEN m >= cut ELSE m <= cut END)) AS g, count(*) FILTER (quality = 0 AND (CASE WHEN above THEN m >= cut ELSE m <= cut END)) AS b
  FROM long JOIN lab USING (doc_id) JOIN cuts ON long.rule = cuts.rule WHERE NOT base_failed GROUP BY ALL),
tested AS (SELECT *, CASE WHEN g < ng * {share} THEN list_sum(list_transform(range(0, g + 1), lambda j: exp(lgamma(ng + 1) - lgamma(j + 1) - lgamma(ng - j + 1) + j * ln({share}) + (ng - j) * ln(1 - {share})))) ELSE 1 END
  <= {ERROR} / ((SELECT count(*) FROM (SELECT DISTINCT lang FROM cnt)) * {len(CUTOFFS)}) AS sure, b / greatest(nb, 1) - g / greatest(ng, 1) AS gain FROM cnt),
ok AS (SELECT *, bool_and(sure) OVER (PARTITION BY lang, rule ORDER BY i) AS certified FROM tested),
best AS (SELECT lang, rule, max_by(cut, [gain, -i]) AS cut, any_value(above) AS above FROM ok WHERE certified AND gain > 0 GROUP BY lang, rule),
rej AS (SELECT DISTINCT doc_id FROM long JOIN best ON long.rule = best.rule AND long.lang IS NOT DISTINCT FROM best.lang WHERE CASE WHEN above THEN m >= cut ELSE m <= cut END)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rej) AS kept FROM measured
"""


OP4_SQL = _quality_sql()
