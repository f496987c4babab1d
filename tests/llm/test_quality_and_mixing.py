"""Operators 4, 7, 8 on small input."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import classifier, mixing, quality

DOCS = "doc_id long, text string, lang string, source string, kept string"


def naive_repeats(text: str) -> int:
    words = text.split()
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit |= set(range(i, i + 5))
    return len(hit)


def test_counts(spark):
    r = random.Random(1)
    texts = ["", None, "a b c d e", "a b c d e a b c d e", "x " * 40, " ".join(r.choice("abc") for _ in range(300)), "one\n\none\ntwo \ntwo\n \n", "*#|a <b>"]
    df = spark.createDataFrame([(i, t, "en", "s", "k") for i, t in enumerate(texts)], DOCS)
    got = {x["doc_id"]: x for x in quality.measure(df, "text", ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        assert got[i]["n_repeat_words"] == naive_repeats(t or ""), t
        assert got[i]["n_words"] == len((t or "").split())
        assert got[i]["word_chars"] == sum(map(len, (t or "").split()))
    assert got[6]["n_dup_lines"] == 1 and got[7]["n_symbols"] == 5


def test_binomial_tail_is_exact(spark):
    cases = [(0, 100), (3, 400), (15, 1000), (1, 1), (19, 1200)]
    df = spark.createDataFrame(cases, "k long, n long")
    for (k, n), row in zip(cases, df.select(quality.binomial_tail(F.col("k"), F.col("n"), 0.02).alias("p")).collect(), strict=True):
        want = float(sum(math.comb(n, j) * Fraction(2, 100) ** j * Fraction(98, 100) ** (n - j) for j in range(k + 1))) if k < n * 0.02 else 1.0
        assert row["p"] == pytest.approx(want, rel=1e-9)


def prose(r: random.Random, n: int = 60) -> str:
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(n))


def test_cutoffs_reject_junk_and_hold_their_risk(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(1500):
        junk = i % 5 == 0
        text = " ".join(w + "***" for w in prose(r).split()) if junk else prose(r)
        rows.append((i, text, "en", "s", "k"))
        labels.append((i, int(not junk), 0))
    rows += [(5000, " ".join(w + "###" for w in prose(r).split()), "en", "s", "k"), (5001, prose(r), "en", "s", "k"), (5002, None, None, None, None), (5003, prose(r), None, "s", "k"), (5001, prose(r), "en", "s", "k")]
    df, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (None, 1, 0), (5003, None, None)], "doc_id long, quality int, toxic int")
    out = quality.judge_quality(df, lab).collect()
    verdict = {(x["doc_id"], x["kept"]) for x in out}
    assert len(out) == len(rows)
    assert {(5000, False), (5001, True), (5002, False), (5003, True)} <= verdict
    assert sum(not x["kept"] for x in out if x["doc_id"] < 1500 and x["doc_id"] % 5) == 0
    carried = quality.judge_quality(df, lab, carry=["doc_id", "text", "lang"]).where("kept").select("carried.*")
    assert sorted(x["doc_id"] for x in carried.collect()) == sorted(x["doc_id"] for x in out if x["kept"])
    few = quality.judge_quality(df, lab.limit(20))
    assert few.where("doc_id = 5000").first()["kept"]  # too few labels certify nothing
    assert quality.judge_quality(spark.createDataFrame([], DOCS), lab).count() == 0


def test_all_rules_together_hold_the_risk(spark):
    """Forty strata where each rule would wrongly reject its own 1.5 % of good documents (7.5 % together), and forty where one rejects 0.02 %."""
    n, names = 6000, list(quality.CUTOFFS)
    harmless = {r: 0.0 if sign == "above" else 9.0 for r, (sign, _) in quality.CUTOFFS.items()}
    fires = {r: cuts[0] for r, (_, cuts) in quality.CUTOFFS.items()}
    rows = spark.range(80 * n).selectExpr("id as doc_id", f"concat('s', id div {n}) as lang", "cast(xxhash64(id) >> 11 as double) / (1L << 52) * 0.5 + 0.5 as u", f"id div {n} < 40 as risky", f"id % {n} < 100 as junk")
    for k, r in enumerate(names):
        risky = (F.col("u") >= 0.015 * k) & (F.col("u") < 0.015 * (k + 1)) if k else F.col("u") < 0.015
        mild = (F.col("u") < 0.0002) & F.lit(k == 0)
        rows = rows.withColumn(r, F.when(F.when(F.col("risky"), risky).otherwise(mild) | F.col("junk"), fires[r]).otherwise(harmless[r]))
    rows = rows.withColumn("base_failed", F.lit(False))
    labels = rows.select("doc_id", (~F.col("junk")).cast("int").alias("quality"))
    chosen = {x["__stratum"]: x for x in quality.select_cutoffs(rows, labels, "doc_id", "lang").collect()}
    assert len(chosen) == 80
    for i in range(80):
        used = [r for r in names if chosen[f"s{i}"][f"cut_{r}"] is not None]
        assert not used if i < 40 else names[0] in used, i


def naive_targets(sizes: dict, weights=(3, 1, 2)) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    goal, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        rest = goal - sum(capped.values())
        over = [s for s in free if rest * w[s] / sum(w[x] for x in free) > 2 * sizes[s]]
        if not over:
            return capped | {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        capped |= {s: 2 * sizes[s] for s in over}


def test_mix(spark):
    r = random.Random(3)
    rows = []
    for s, n in (("a", 900), ("b", 40), ("c", 3), (None, 200), ("é", 60)):
        rows += [(len(rows) + i, "w " * r.randint(1, 400), "en", s, "k") for i in range(n)]
    rows += [(None, "x y z", "en", "a", "k"), (7, None, "en", "a", "k"), (8, "  ", "en", "b", "k"), (9, "same row", "en", "a", "k"), (9, "same row", "en", "a", "k")]
    df = spark.createDataFrame(rows, DOCS)
    first, again = (sorted(map(tuple, mixing.mix_sources(x, chunk=16).collect()), key=repr) for x in (df, df.repartition(7)))
    assert first == again and len(first) == len(rows)
    sizes: dict = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, taken = naive_targets(sizes), {}
    for _, s, size, source_size, target, copies, got in first:
        assert source_size == sizes[s] and target == pytest.approx(want[s]) and got == copies * size <= 2 * size
        taken[s] = taken.get(s, 0) + got
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 400 and (sizes[s] < 2000 or abs(taken[s] / want[s] - 1) < 0.02)
    assert mixing.mix_sources(spark.createDataFrame([], DOCS)).count() == 0


def test_a_classifier_learns_a_repeated_row_once(spark):
    r = random.Random(6)
    rows = [(i, prose(r) + (" scoundrel" if i % 5 == 0 else ""), "en", f"s{i % 3}", "k") for i in range(500)]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(500)] + [(700 + i, None, None) for i in range(50)], "doc_id long, quality int, toxic int")
    one, two = (classifier.learn(x, labels, "doc_id", "text", 400) for x in (df, df.unionByName(df).repartition(5)))
    assert len(one.keys) and (one.keys == two.keys).all() and one.prior == two.prior and one.weights == pytest.approx(two.weights, abs=1e-6)
    assert one.prior == pytest.approx(0.2, abs=0.06)
    few = classifier.learn(df, labels, "doc_id", "text", 400, max_bytes=0)
    assert not len(few.keys)


def test_rates_of_sites_by_brute_force(spark):
    """The shrunk rates and scores, computed again from each document's evidence."""
    r = random.Random(7)
    rows = []
    for i in range(600):
        source, lang = r.choice(["a", "a", "b", "c", None]), r.choice(["en", "de", None])
        bad = r.random() < {"a": 0.05, "b": 0.6, "c": 0.2, None: 0.3}[source]
        rows.append((i, prose(r) + (" scoundrel" if bad else ""), lang, source, "k"))
    rows += [(900, "lone text " * 30, "xx", "alone", "k"), rows[0], rows[0]]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1, int("scoundrel" in t)) for i, t, *_ in rows[:400]], "doc_id long, quality int, toxic int")
    net = classifier.learn(df, labels, "doc_id", "text")
    out = classifier.classify(df, labels).collect()
    assert len(out) == len(rows)
    base = math.log(net.prior / (1 - net.prior))
    docs = [((x["source"],), (x["source"], x["lang"]), 1 / (1 + math.exp(-(x["evidence"] + base))), x) for x in out]

    def totals(level):
        sums: dict = {}
        for d in docs:
            bad, n = sums.get(d[level], (0.0, 0))
            sums[d[level]] = (bad + d[2], n + 1)
        return sums

    def strength(groups, mean):
        n = sum(k for _, k in groups.values())
        spread = sum(k * (b / k - mean(g)) ** 2 for g, (b, k) in groups.items()) - sum(mean(g) * (1 - mean(g)) for g in groups)
        within = sum(k * mean(g) * (1 - mean(g)) for g, (_, k) in groups.items()) / n
        return min(within / (spread / n), 1e6) if spread > 0 else 1e6

    hosts, paths = totals(0), totals(1)
    rate = sum(b for b, _ in hosts.values()) / len(docs)
    m = strength(hosts, lambda _: rate)
    host_rate = {h: (b + m * rate) / (n + m) for (h,), (b, n) in hosts.items()}
    m2 = strength(paths, lambda g: host_rate[g[0]])
    for _, g, bad, x in docs:
        b, n = paths[g]
        prior = min(max((max(b - bad, 0) + m2 * host_rate[g[0]]) / (n - 1 + m2), 1e-6), 1 - 1e-6)
        assert x["site_rate"] == pytest.approx(prior, rel=1e-6)
        assert x["score"] == pytest.approx(1 / (1 + math.exp(x["evidence"]) * prior / (1 - prior)), rel=1e-6)


def test_a_very_long_text_is_judged_and_classified(spark):
    r = random.Random(9)
    long = prose(r, 200_000)
    df = spark.createDataFrame([(1, long, "en", "s", "k"), (2, prose(r), "en", "s", "k")], DOCS)
    labels = spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in quality.judge_quality(df, labels).collect()}
    assert got[1]["n_words"] == 200_000 and got[1]["n_repeat_words"] == 0 and got[1]["kept"]
    assert all(x["kept"] for x in classifier.classify(df, labels).collect())
    clash = df.withColumnsRenamed({"kept": "symbol_ratio"}).withColumn("n_words", F.lit("mine"))
    carried = quality.judge_quality(clash, labels, carry=["doc_id", "symbol_ratio", "n_words"]).collect()
    assert {x["carried"]["n_words"] for x in carried} == {"mine"} and {x["n_words"] for x in carried} == {60, 200_000}


def test_classifier_finds_marks_and_shrinks_sites(spark):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        words = prose(r, 80).split()
        if toxic:
            words[r.randrange(80)] = "Scoundrel,"
        rows.append((i, " ".join(words), "en", f"s{i % 4}", "k"))
        if i < 700:
            labels.append((i, 1, int(toxic)))
    rows += [(2000, None, None, None, None), (None, prose(r), "en", "s1", "k"), (2001, prose(r), "xx", "alone", "k")]
    df = spark.createDataFrame(rows, DOCS)
    lab = spark.createDataFrame([*labels, (None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    out = classifier.classify(df, lab).collect()
    assert len(out) == len(rows)
    held = {x["doc_id"]: x["kept"] for x in out if x["doc_id"] is not None and 700 <= x["doc_id"] < 900}
    assert all(kept == (i % 6 != 0) for i, kept in held.items())
    rates = {x["doc_id"]: x["site_rate"] for x in out}
    assert rates[2001] == pytest.approx(1 / 6, abs=0.1)  # a site with nothing else has about the global rate
    assert all(x["kept"] for x in classifier.classify(df, lab.limit(0)).collect())
    assert classifier.classify(spark.createDataFrame([], DOCS), lab).count() == 0
