"""Operator 6 against a Gibbs sampler that seats customer by customer, exact counts and its own rules."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusmill.llm import pitman_yor

DOCS = "doc_id long, text string, spans string, learn boolean"


def test_base_columns_and_held_out_likelihood(spark):
    r = random.Random(2)
    vocab = ["w%d" % i for i in range(200)]

    def walk(n):  # a word tends to call for its successor
        at, out = 0, []
        for _ in range(n):
            at = (at * 7 + 3) % 200 if r.random() < 0.6 else min(int(r.paretovariate(0.8)), 199)
            out.append(vocab[at])
        return " ".join(out)

    texts = [walk(r.randint(1, 120)) for _ in range(300)] + ["", None, "A Ü b", "unseen tokens only"]
    rows = [(i, t, "s", i % 7 != 2 and i < 303) for i, t in enumerate(texts)] + [(None, "w1", "s", None)]
    df = spark.createDataFrame(rows, DOCS)
    got = pitman_yor.score_texts(df, "learn", side=3).collect()
    assert len(got) == len(rows)
    tokens = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), b""]
    c = Counter(w for _, t, _, learn in rows if learn for w in tokens(t))
    n, v, base, score = sum(c.values()), len(c), 0.0, 0.0
    by = {x["doc_id"]: x for x in got}
    for k, t, _, learn in rows:
        x, w = by[k], tokens(t)
        assert (x["n_tokens"], x["n_known"], x["train_tokens"]) == (len(w), sum(c[y] > 0 for y in w), n)
        want = sum(math.log10((c[y] + 1) / (n + v + 1)) for y in w)
        assert x["base_score"] == pytest.approx(want) and x["score"] < 0
        if not learn and k is not None and k < 300:
            base, score = base + want, score + x["score"]
    assert score > base  # held-out texts are likelier than under add-one
    assert pitman_yor.score_texts(df.limit(0), "learn").count() == 0
    nothing = pitman_yor.score_texts(df.limit(5).withColumn("learn", df.learn & False), "learn").collect()
    assert all(x["train_tokens"] == 0 and math.isfinite(x["score"]) for x in nothing)


def brute_probabilities(pairs: list, discounts: tuple[float, float], vocabulary: int, sweeps: int, burn: int, seed: int) -> dict:
    """Averaged predictive probabilities of (context, word) cells, by a sampler that takes out and seats again one customer after the other, with the sizes of all tables."""
    r, (d, d0) = random.Random(seed), discounts
    leaf, top, out, tables, customers = {}, {}, Counter(), Counter(), Counter(u for u, _ in pairs)

    def root(w):
        n, c, t = sum(top.get(w, ())), sum(map(sum, top.values())), sum(map(len, top.values()))
        return (n - d0 * len(top.get(w, ())) + (1 + d0 * t) / (vocabulary + 1)) / (1 + c)

    def sit(at, new, discount):
        x = r.random() * (sum(at) - discount * len(at) + new)
        for i, size in enumerate(at):
            x -= size - discount
            if x < 0:
                at[i] += 1
                return False
        at.append(1)
        return True

    def leave(at):
        i = r.choices(range(len(at)), at)[0]
        at[i] -= 1
        return not at[i] and at.pop(i) == 0

    def add(u, w):
        if sit(leaf.setdefault((u, w), []), (1 + d * tables[u]) * root(w), d):
            tables[u] += 1
            sit(top.setdefault(w, []), (1 + d0 * sum(map(len, top.values()))) / (vocabulary + 1), d0)

    for pair in pairs:
        add(*pair)
    for sweep in range(sweeps):
        for u, w in r.sample(pairs, len(pairs)):
            if leave(leaf[u, w]):
                tables[u] -= 1
                leave(top[w])
            add(u, w)
        if sweep >= burn:
            for u, w in set(pairs):
                t = leaf[u, w]
                out[u, w] += (sum(t) - d * len(t) + (1 + d * tables[u]) * root(w)) / (1 + customers[u]) / (sweeps - burn)
    return out


def test_agrees_with_a_brute_force_sampler_however_it_is_dealt(spark):
    r, words = random.Random(5), "abcdefghij"
    texts = []
    for _ in range(40):
        at, t = r.choice(words), []
        for _ in range(r.randint(1, 12)):
            t.append(at)
            at = words[(words.index(at) * 3 + 1) % 10] if r.random() < 0.5 else words[min(int(r.paretovariate(0.9)) - 1, 9)]
        texts.append(" ".join(t))
    df = spark.createDataFrame([(i, t, "s", True) for i, t in enumerate(texts * 2)], DOCS)  # each row twice
    one, many = (
        {x["doc_id"]: x["score"] for x in pitman_yor.score_texts(df.repartition(n), "learn", side=side, burn=2, samples=10).collect()} for n, side in ((1, 1), (7, 3))
    )
    assert one == many and all(one[i] == one[i + 40] for i in range(40))
    pairs = [p for t in texts * 2 for w in [["^", *t.split(), "$"]] for p in zip(w, w[1:], strict=False)]
    share = lambda c: float(np.clip(c[1] / max(c[1] + 2 * c[2], 1), 0.1, 0.95))
    cells = Counter(pairs)
    discounts = share(Counter(cells.values())), share(Counter(Counter(w for _, w in cells).values()))
    want = brute_probabilities(pairs, discounts, len({w for _, w in pairs}), 400, 50, 6)
    off = [(one[i] - sum(math.log10(want[p]) for p in zip(["^", *t.split()], [*t.split(), "$"], strict=True))) / (len(t.split()) + 1) for i, t in enumerate(texts)]
    assert abs(np.mean(off)) < 0.005 and np.abs(off).max() < 0.04


def test_every_context_sums_to_one(spark):
    """Over the vocabulary, the end and one unknown word, with the totals that the scores use."""
    r, words = random.Random(8), "abcdefghijklm"
    known = [(i, " ".join(r.choices(words, range(1, 14), k=r.randint(0, 30))), "s", True) for i in range(50)]
    asked = [(100 + i, f"{u} {w}", "s", False) for i, (u, w) in enumerate((u, w) for u in words for w in [*words, "zzz"])]
    df = spark.createDataFrame(known + asked, DOCS).coalesce(1)
    rows = df.selectExpr("doc_id", "cast(text as binary)", "learn")
    answered = pitman_yor.fit_and_respond(rows.mapInArrow(pitman_yor._count_blocks(2), pitman_yor.ROW), 2)[0].collect()
    logs = defaultdict(dict)
    for x in answered:
        if x["kind"] == "response":
            logs[x["block"]][x["bucket"]] = pitman_yor.unpack(bytes(x["payload"]))[0]
    ids = {int(pitman_yor.word_id(w.encode())): w for w in [*words, "zzz"]} | {0: "$"}
    p = {}
    for x in [x for x in answered if x["kind"] == "own"]:
        rank, common, shards, lengths, _ = pitman_yor.unpack(bytes(x["payload"]))
        numbers = np.unique(pitman_yor.cell_numbers(common.astype(np.int32)[rank], lengths.astype(np.int64), len(shards)))
        word, context, bucket, _ = pitman_yor.by_bucket(numbers, shards.astype(np.int64), 2)
        assert len(shards) == len(ids)  # every word is in the block; their numbers go by id
        names = [ids[i] for i in sorted(ids)] + ["^"]
        all_logs = np.concatenate([logs[x["block"]][b] for b in sorted(logs[x["block"]])])
        assert (np.diff(bucket) >= 0).all()
        p |= {(names[u], names[w]): 10**v for w, u, v in zip(word.tolist(), context.tolist(), all_logs.tolist(), strict=True)}
    sums = Counter()
    for (u, _), v in p.items():
        sums[u] += v
    full = [u for u in words if sum((u, w) in p for w in ids.values()) == len(ids)]
    assert len(full) == len(words) and all(sums[u] == pytest.approx(1, abs=1e-4) for u in full)


@pytest.mark.parametrize("discount", [0.3, 0.8])
def test_seatings(discount):
    """Counts of tables against all seatings one by one; draws against their weights; the limit law of many customers against exact counts."""
    weights = Counter({(): 1.0})
    for _ in range(6):  # table sizes -> weight of all ways there
        now = Counter()
        for sizes, w in weights.items():
            for i, n in enumerate(sizes):
                now[tuple(sorted((*sizes[:i], n + 1, *sizes[i + 1 :])))] += w * (n - discount)
            now[tuple(sorted((*sizes, 1)))] += w
        weights = now
    by = Counter()
    for sizes, w in weights.items():
        by[len(sizes)] += w
    t = np.arange(2, 7)
    small = pitman_yor.Seatings(discount)
    assert np.exp(small.rise(np.full(5, 6), t)) == pytest.approx([by[k] / by[k - 1] for k in t.tolist()])
    n, parent, others = 40_000, 0.2, 7.0
    drawn = pitman_yor.seat(np.full(n, 6), np.full(n, parent), others, discount, pitman_yor.mixed(np.arange(n, dtype=np.uint64) + np.uint64(9)))
    want = np.array([by[k] * math.prod(parent * (pitman_yor.THETA + discount * (others + i)) for i in range(1, k)) for k in range(1, 7)])
    assert np.bincount(drawn, minlength=7)[1:] / n == pytest.approx(want / want.sum(), abs=0.012)
    exact, c = pitman_yor.Seatings(discount, 4096), 4000
    for rate in (0.3, 5.0, 40.0, 0.1 * c, 0.7 * c):
        mean = []
        for s in (small, exact):
            w = np.r_[0, np.cumsum(s.rise(np.full(c - 1, c), np.arange(2, c + 1)) + math.log(rate))]
            w = np.exp(w - w.max())
            mean.append((w * np.arange(1, c + 1)).sum() / w.sum())
        assert mean[0] == pytest.approx(mean[1], rel=0.01)
    many = pitman_yor.seat(np.full(2000, c), np.full(2000, 0.05), 900.0, discount, pitman_yor.mixed(np.arange(2000, dtype=np.uint64)))
    w = np.r_[0, np.cumsum(exact.rise(np.full(c - 1, c), np.arange(2, c + 1)) + np.log(0.05 * (1 + discount * (900 + np.arange(1, c)))))]
    w = np.exp(w - w.max())
    assert many.mean() == pytest.approx((w * np.arange(1, c + 1)).sum() / w.sum(), rel=0.02)


def test_each_previous_word_has_a_restaurant_of_its_own(spark):
    """Words of one ending, each with its own successor: that one is always likely, also where it and its likes meet in different buckets."""
    rows = [(i * 10 + k, f"w{i}xx s{i}", "s", k < 5) for i in range(300) for k in range(6)]
    got = pitman_yor.score_texts(spark.createDataFrame(rows, DOCS), "learn", side=3).collect()
    held = [x["score"] for x in got if x["doc_id"] % 10 == 5]
    assert len(held) == 300 and min(held) > math.log10(1 / 300) + 3 * math.log10(0.75)


def test_equal_blocks_and_a_block_per_text(spark):
    """Repeated rows of which each is a block."""
    text = "a b a b c " * 20
    rows = spark.createDataFrame([(1, text, "s", True)] * 3, DOCS).coalesce(1).selectExpr("doc_id", "cast(text as binary)", "learn")
    own = rows.mapInArrow(pitman_yor._count_blocks(2, 50), pitman_yor.ROW).where("kind = 'own'").collect()
    assert len({x["block"] for x in own}) == 3
    got = pitman_yor.score_texts(spark.createDataFrame([(1, text, "s", True)] * 3, DOCS).coalesce(1), "learn", block=50).collect()
    assert len(got) == 3 and len({x["score"] for x in got}) == 1


def test_a_very_long_text(spark):
    r = random.Random(3)
    long = " ".join(f"w{int(r.paretovariate(0.7))}" for _ in range(300_000))
    rows = [(1, long, "s", True), (2, "w1 w2", "s", False), (1, long, "s", False)]
    got = {(x["doc_id"], x["n_tokens"]): x for x in pitman_yor.score_texts(spark.createDataFrame(rows, DOCS), "learn").collect()}
    assert set(got) == {(1, 300_001), (2, 3)} and math.isfinite(got[1, 300_001]["score"])


def test_packed_arrays_come_back():
    arrays = [np.arange(5, dtype=np.uint64) << np.uint64(40), np.zeros(0, np.uint32), np.array([1.5, -2], np.float32), np.frombuffer(b";:;", np.uint8)]
    for a, b in zip(arrays, pitman_yor.unpack(pitman_yor.pack(*arrays)), strict=True):
        assert a.dtype == b.dtype and (a == b).all()
    numbers = np.array([5, 2, 9, 0, 4_000_000_000])
    assert (np.cumsum(pitman_yor.steps(numbers), dtype=np.uint32) == numbers).all()
