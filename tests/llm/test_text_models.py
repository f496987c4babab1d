"""Operators 5, 9, 10 against brute force, the library, and on odd input."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.llm import bpe, lz, secrets

DOCS = "doc_id long, text string, spans string"


# -- 5 --------------------------------------------------------------------------------------------


def test_lz_fingerprints(spark):
    r = random.Random(1)
    texts = ["", None, "a", "ab" * 3000, "".join(r.choice("abcdé ") for _ in range(3000)), "x" * 50_000, "".join(r.choice("xyz") for _ in range(500))]
    rows = [(i * 3 % 7, t, "s") for i, t in enumerate(texts)] + [(None, "null key", "s"), (3, "second of three", "s")]
    got = lz.fingerprint_texts(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    by = {x["doc_id"]: x for x in got if x["doc_id"] != 3}
    ordered = sorted((x for x in rows if x[0] not in (3, None)), key=lambda x: -x[0])
    text = {k: t or "" for k, t, _ in ordered}
    for k, nxt in ((2, 1), (1, 0), (6, 5)):
        own, n = text[k], len(text[k]) // 3
        edited = own[: len(own) - n] + text[nxt][:n]
        sig = lambda t: lz.signature(lz.hash_phrases(lz.parse_phrases(t).phrases))
        assert by[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert by[k]["fingerprint"] == lz.as_text(sig(own)) and by[k]["edited_fingerprint"] == lz.as_text(sig(edited))
        assert by[k]["near_edited"] == lz.likeness(sig(own), sig(edited)) and by[k]["near_next"] == lz.likeness(sig(own), sig(text[nxt]))
    alone = lz.fingerprint_texts(spark.createDataFrame([(1, "abcdef", "s")], DOCS)).first()
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()
    assert lz.fingerprint_texts(spark.createDataFrame([], DOCS)).count() == 0


def plain_signature(text: str) -> str:
    """The fingerprint from its definition: LZ78 phrases by a growing dictionary, 128 bins by the top 7 bits, 16 low bits of each bin's least hash."""
    phrases, now = set(), ""
    for c in text:
        now += c
        if now not in phrases:
            phrases.add(now)
            now = ""
    bins: dict[int, int] = {}
    for p in phrases:
        h = xxhash.xxh64_intdigest(p.encode())
        bins[h >> 57] = min(h, bins.get(h >> 57, h))
    return "".join(f"{bins[i] & 0xFFFF:04x}" if i in bins else "...." for i in range(128))


def test_lz_fingerprints_by_brute_force_however_keys_lie(spark):
    """Unique keys, keys that hold a third of the rows, and null ones only, over several tasks."""
    r = random.Random(4)
    for keys in (list(range(400)), [r.choice([7, 7, i]) for i in range(400)], [None] * 400):
        rows = [(k, "".join(r.choice("abc é") for _ in range(r.randint(0, 200))), "s") for k in keys]
        df = spark.createDataFrame(rows, DOCS)
        got = lz.fingerprint_texts(df.repartition(5)).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, lz.fingerprint_texts(df, buckets_per_partition=1).collect()))
        tie = {t: h for t, h in df.select("text", F.xxhash64("text").alias("h")).collect()}
        order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), tie[x[1]]))
        want = []
        for (k, t, _), (_, following, _) in zip(order, [*order[1:], order[0]], strict=True):
            third = len(t) // 3
            edited = t[: len(t) - third] + following[:third]
            mine, other, nxt = plain_signature(t), plain_signature(edited), plain_signature(following)
            like = lambda a, b: (lambda used: sum(x == y for x, y in used) / len(used) if used else 1.0)([(a[i : i + 4], b[i : i + 4]) for i in range(0, 512, 4) if (a[i : i + 4], b[i : i + 4]) != ("....", "....")])
            want.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), mine, other, like(mine, other), like(mine, nxt)))
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    spread = df.select(lz._bucket(F.col("doc_id"), F.xxhash64("text"), [], 8).alias("b")).distinct().count()
    assert spread == 8  # null keys alone fill eight ranges


@given(st.text(alphabet="ab ", max_size=80), st.text(alphabet="ab ", max_size=40))
@settings(max_examples=200, deadline=None)
def test_lz_goes_on_from_a_shared_start(a, b):
    parsed = lz.parse_phrases(a, len(a) - len(a) // 3)
    edited = a[: parsed.mark] + b
    assert parsed.phrases[: parsed.at_mark[0]] + lz.continue_phrases(parsed, edited) == lz.parse_phrases(edited).phrases
    assert parsed.phrases == lz.parse_phrases(a).phrases and len(set(parsed.phrases)) == len(parsed.phrases)


# -- 9 --------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


ODD = ["", " ", "aaaa" * 500, "I'LL don'T 'S", "<|endoftext|>x<|startoftext|>", "<|EndOfText|>", "ΟΔΟΣ Σ", "İstanbul ǅ", "é ﬁ ½ ² ١٢", "한글 漢字 ありがとう", "a\x00b\x1cc\x85d\u200be", "👍🏽😀", "!!!???" * 40, "a\n\n\tb"]


def test_bpe_equals_the_library(library):
    ours = bpe.WordBpe(bpe.vocabulary(), cache=5)
    for (ids, decoded), text, enc in zip(ours.encode(ODD), ODD, library.encode_batch(ODD, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == enc.ids, text
        assert decoded == library.decode(enc.ids, skip_special_tokens=False)


@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", categories=["L", "N", "P", "S", "Z"], max_codepoint=0x2FFF), max_size=30), max_size=5))
@settings(max_examples=150, deadline=None)
def test_bpe_equals_the_library_on_any_text(library, texts):
    ours = bpe.load(bpe.vocabulary())
    for (ids, _), enc in zip(ours.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == enc.ids


@pytest.mark.parametrize("least", [3, 1000])
def test_bpe_of_long_words_equals_the_library(library, monkeypatch, least):
    monkeypatch.setattr(bpe, "LONG", least)
    r = random.Random(5)
    words = ["".join(r.choice(a) for _ in range(r.randint(1, 90))) for a in ("ab", "aab", "abcdefghijklmnopqrstuvwxyz", "éa") for _ in range(100)]
    words += ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000)), "a" * 100_001]
    ours = bpe.WordBpe(bpe.vocabulary())
    for (ids, _), enc in zip(ours.encode(words), library.encode_batch(words, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == enc.ids


def test_bpe_rows(spark, library):
    rows = [(i, t, "s") for i, t in enumerate(ODD)] + [(None, None, "s"), (1, "twice", "s"), (1, "twice", "s")]
    out = bpe.encode_texts(spark.createDataFrame(rows, DOCS), bpe.vocabulary()).collect()
    assert len(out) == len(rows)
    for x in out:
        assert len(x["ids"]) == x["n_tokens"] and hashlib.sha256(np.array(x["ids"], "<u4").tobytes()).hexdigest() == x["ids_sha256"]
    assert next(x for x in out if x["doc_id"] is None)["n_tokens"] == 0
    assert bpe.encode_texts(spark.createDataFrame([], DOCS), bpe.vocabulary()).count() == 0


# -- 10 -------------------------------------------------------------------------------------------


def naive_base(text: str) -> set:
    assign = re.compile("(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    out = {("assign", *m.span()) for m in assign.finditer(text) if len(m[2]) >= 12}
    out |= {("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18}
    return out | {("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16}


@given(st.lists(st.sampled_from(["token", "PassWord", "api_key", "apikey", "=", ": ", "'", '"', "AKIA", "ABCDEF012345678901", "deadbeef01234567", "abcdefghijkl", "é", " ", "ſecret=", "x"]), max_size=12))
@settings(max_examples=300, deadline=None)
def test_base_spans(parts):
    text = "".join(parts)
    assert {(k, s, e) for s, e, _, k in secrets.base_spans(text)} == naive_base(text)


def test_secret_network_and_rows(spark):
    made = secrets.made_findings(300, 77)
    hidden = 'see key: "Zx9Qw3Lk7Pn2Vb8Rt5Yh1Mc4Df6Gj0S" ok'
    rows = [(i, f"calm words here {i} and there, no. 4644348398{i:06d}x", "s") for i in range(50)]
    rows += [(100, 'token = "24be64439e3e49cf46b2d7c90f3602a3"', "s"), (101, hidden, "s"), (102, None, "s"), (None, "", "s"), (103, "z" * 300_000, "s"), (101, hidden, "s")]
    df = spark.createDataFrame(rows, DOCS)
    net = secrets.learn(df)
    p = net.probability(np.stack([secrets.encode(t, s) for t, s, _ in made]))
    y = np.array([g for *_, g in made])
    assert (p[y == 1] >= net.threshold).mean() > 0.9 and (p[y == 0] >= net.threshold).mean() < 0.05
    out = secrets.scan_secrets(df, net).collect()
    assert len(out) == len(rows)
    by = {x["doc_id"]: x for x in out}
    assert [s["kind"] for s in by[100]["spans"]] == ["assign", "hex"] and by[100]["redacted"] == 'token = "[SECRET]"'
    assert [s["kind"] for s in by[101]["spans"]] == ["model"] and "Zx9" not in by[101]["redacted"]
    assert by[102]["redacted"] is None and by[103]["redacted"] == "z" * 300_000 and by[3]["redacted"].startswith("calm words")
    assert secrets.scan_secrets(spark.createDataFrame([], DOCS), net).count() == 0
    assert df.select(F.col("spans")).columns == ["spans"]


def test_long_texts_of_findings_equal_all_comparisons():
    """Five megabytes of hashes and a long token of many spans take seconds; what spans leave open is found as by comparing all."""
    r = random.Random(6)
    net = secrets.Network.fresh(1)
    hashes = "\n".join("".join(r.choices("0123456789abcdef", k=64)) for _ in range(77_000))
    assert len(secrets.scan_texts([hashes], net)[0]) == 77_000
    assert sum(s[3] == "hex" for s in secrets.scan_texts(["0123456789abcdefg" * 20_000], net)[0]) == 20_000
    for _ in range(300):
        spans = [(s, s + r.randint(1, 30), s, "hex") for s in (r.randint(0, 200) for _ in range(r.randint(0, 12)))]
        run = (a := r.randint(0, 200), a + r.randint(1, 40))
        assert list(secrets.Covered(spans).within(run)) == sorted((s, e) for s, e, *_ in spans if s < run[1] and run[0] < e)


def test_the_embedding_is_learnt():
    made = secrets.made_findings(16, 5)
    x, y = np.stack([secrets.encode(t, secrets.one_window(t, s)) for t, s, _ in made]), np.array([g for *_, g in made], np.float64)
    net = secrets.Network.fresh(2)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    loss = lambda: float(np.mean(np.logaddexp(0, z := net.forward(x)[0]) - y * z))
    slope = net.gradients(x, y)["embed"]
    assert (slope[:, : secrets.CHANNELS] == 0).all()
    code = int(x[0, secrets.LEFT])
    for channel in (secrets.CHANNELS, secrets.CHANNELS + 3):
        at = []
        for e in (1e-5, -2e-5):
            net.weights["embed"][code, channel] += e
            at.append(loss())
        net.weights["embed"][code, channel] += 1e-5
        assert (at[0] - at[1]) / 2e-5 == pytest.approx(slope[code, channel], rel=1e-3, abs=1e-7)


def test_recall_on_held_out_findings_that_no_rule_knows(spark):
    """The threshold is constrained on findings outside the rules; measured here on fresh ones."""
    made = [(t, s, g) for t, s, g in secrets.made_findings(3000, 91) if not any(secrets.Covered(secrets.base_spans(t)).within(s))]
    df = spark.createDataFrame([(i, f"calm words {i}", "s") for i in range(20)], DOCS)
    net = secrets.learn(df)
    p = net.probability(np.stack([secrets.encode(t, secrets.one_window(t, s)) for t, s, _ in made]))
    y = np.array([g for *_, g in made]) == 1
    assert y.sum() > 500 and (p[y] >= net.threshold).mean() > 0.95 and (p[~y] >= net.threshold).mean() < 0.03


def test_a_key_at_the_end_of_a_long_run_is_found(spark):
    key = "ghp_AbC9xK2mQ7vR4tY8wZ1nP5sL3dF6hJ0uE"
    runs = ["config.production.database.credentials.key=" + key, "srv/data/projects/archive/reports/quarterly/2021/" + key, "/".join(["part", "of", "a", "long", "way", "7"] * 30) + "/" + key + "/and/on/to/the/end/of/it"]
    calm = "/".join(["part", "of", "a", "long", "way", "7"] * 30)
    df = spark.createDataFrame([(i, f"see {x} there", "s") for i, x in enumerate([*runs, calm])], DOCS)
    out = {x["doc_id"]: x["redacted"] for x in secrets.scan_secrets(df, secrets.learn(df)).collect()}
    assert all(key[4:] not in out[i] and "[SECRET]" in out[i] for i in range(len(runs)))
    assert out[len(runs)] == f"see {calm} there"
    assert secrets.windows((5, 40)) == [(5, 40)] and secrets.windows((0, 95)) == [(0, 40), (20, 60), (40, 80), (55, 95)]


def test_keys_of_letters_and_what_rules_leave_of_a_run_are_found(spark):
    texts = ["bearer QwZkRtXvBnMpLsDfGhJcYbTrWq end", "see sk_live_0123456789abcdefXyZ9Qw3Lk7Pn2Vb8Rt5 end", "see 0123456789abcdefXyZ9Qw3 end"]
    calm = ["the internationalization of telecommunications goes on", "=" * 70, "well-known-and-often-used words", "getElementByIdentifier of it", "/static/0123456789abcdef.html there"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts + calm)], DOCS)
    out = {x["doc_id"]: (x["redacted"], [s["kind"] for s in x["spans"]]) for x in secrets.scan_secrets(df, secrets.learn(df)).collect()}
    assert "QwZk" not in out[0][0] and "XyZ9" not in out[1][0] and "XyZ9" not in out[2][0]
    assert out[0][1] == ["model"] and out[1][1] == ["hex", "model"] and out[2][1] == ["hex", "model"]
    assert [out[3 + i][0] for i in range(4)] == calm[:4] and out[7] == ("/static/[SECRET].html there", ["hex"])
