"""The pipeline's stages against brute force on a small fixture."""

from __future__ import annotations

import random

import corpus_pipeline as P
from corpusmill.llm import bpe, secrets, simhash


def test_stages(spark, tmp_path):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, prose(60), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100, rows[0][1], "en", "s0", 0), (101, rows[1][1] + " more", "en", "s1", 0), (102, "too short", "en", "s0", 0), (103, None, None, None, None), (104, prose(40) + ' token = "24be64439e3e49cf46b2d7c90f3602a3"', "en", "s2", 0), (None, prose(50), "en", None, 0), (5, rows[5][1], "en", "s2", 0)]
    rows = [(i, t, lang, s, len(t) if t else None) for i, t, lang, s, _ in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, sf = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)
    kept = []
    for name, stage in P.STAGES[:-1]:
        docs = P.materialize(stage(spark, docs, sf))
        assert docs.columns == P.COLUMNS, name
        kept.append(docs.collect())
    ids = lambda x: sorted(d["doc_id"] for d in x if d["doc_id"] is not None)
    assert ids(kept[0]) == sorted(i for i, t, *_ in rows if t and len(t.split()) >= 10 and i is not None)
    fps = {n: simhash.fingerprint(d["text"].encode()) for n, d in enumerate(kept[0])}
    groups = simhash.brute_components(fps)
    assert len(kept[1]) == len(set(groups.values())) and 100 not in ids(kept[1]) and ids(kept[1]).count(5) == 1
    assert len(kept[2]) == len(kept[1])
    secret = next(d for d in kept[2] if d["doc_id"] == 104)
    assert "[SECRET]" in secret["text"] and secret["n_chars"] == len(secret["text"]) and not secrets.base_spans(secret["text"])
    size = sum(len(d["text"].split()) for d in kept[2])
    assert abs(sum(len(d["text"].split()) for d in kept[3]) / (1.5 * size) - 1) < 0.05
    last = P.STAGES[-1][1](spark, docs, sf).collect()
    assert len(last) == len(kept[3])
    net = bpe.load(bpe.vocabulary())
    want = sorted(len(i) // 4 for i, _ in net.encode([d["text"] for d in kept[3]]))
    assert sorted(x["n_tokens"] for x in last) == want


def test_odd_tables_pass_all_stages(spark, tmp_path):
    """An empty table, a table of nulls, very long texts, repeated rows and more columns named like results."""
    r = random.Random(6)
    prose = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n))
    long = prose(100_000)
    rows = [(None, None, None, None, None)] * 3 + [(1, "", "en", "a", 0), (2, long, "en", "a", len(long)), (2, long, "en", "a", len(long)), (3, prose(40), None, None, 200)]
    for n, rows_ in enumerate(([], rows[:3], rows)):
        sf = str(tmp_path / str(n))
        df = spark.createDataFrame([(*x, "mine", "mine", 1.0) for x in rows_], "doc_id long, text string, lang string, source string, n_chars long, kept string, spans string, size double")
        df.write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        out = P.run(spark, sf).collect()
        assert {x["doc_id"] for x in out} <= {2, 3} and (n == 2) == any(x["n_tokens"] > 100_000 for x in out)
