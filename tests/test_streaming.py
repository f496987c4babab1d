from __future__ import annotations

from corpusmill.streaming.checkpoints import merge_log


def test_log_merges_as_it_grows(spark, tmp_path):
    log, target, state = (str(tmp_path / x) for x in ("log", "table", "state"))
    (tmp_path / "log").mkdir()
    line = '{"id": "%s", "type": "sentence", "model": "m", "sent_idx": 0, "text": "t", "rewritten": "%s"}\n'
    (tmp_path / "log" / "1.jsonl").write_text(line % ("a", "one") + "{broken\n\n")
    merge_log(spark, log, target, state).awaitTermination(120)
    (tmp_path / "log" / "2.jsonl").write_text(line % ("a", "two") + line % ("b", "three"))
    merge_log(spark, log, target, state).awaitTermination(120)
    got = sorted((r["id"], r["rewritten"]) for r in spark.read.parquet(target).collect())
    assert got == [("a", "one"), ("b", "three")]


def test_seed_and_nulls(spark, tmp_path):
    log, target, state = (str(tmp_path / x) for x in ("log", "table", "state"))
    (tmp_path / "log").mkdir()
    line = '{"id": "%s", "type": "full_abstract", "model": "m", "text": "t", "rewritten": %s}\n'
    seed = spark.createDataFrame([("s", "full_abstract", "m", None, None, "t")], "id string, type string, model string, sent_idx int, percentage int, text string")
    (tmp_path / "log" / "1.jsonl").write_text(line % ("s", '"no"') + line % ("a", "null"))
    merge_log(spark, log, target, state, seed).awaitTermination(120)
    (tmp_path / "log" / "2.jsonl").write_text(line % ("a", '"late"'))
    merge_log(spark, log, target, state, seed).awaitTermination(120)
    assert [(r["id"], r["rewritten"]) for r in spark.read.parquet(target).collect()] == [("a", None)]
