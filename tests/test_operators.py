"""Table operators on tiny frames: edge values, ties, and properties that must hold."""

from __future__ import annotations

import json
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import cleaning as C
from corpusmill.operators import detect as D
from corpusmill.operators import integrate as I
from corpusmill.operators import rewrites as R
from corpusmill.operators import texts as X
from corpusmill.sources import archives, io


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_column_names(spark):
    df = spark.createDataFrame([(1, 2)], [" A b ", "C-d!"])
    assert C.clean_column_names(df).columns == ["a_b", "cd"]
    with pytest.raises(ValueError):
        C.clean_column_names(spark.createDataFrame([(1, 2)], ["a b", "A_B"]))


def test_enforcement(spark):
    cells = ["yes", "OFF", "1", "0", "2", "n/a", None, " ", "['a', None]", "[['x']]", "[broken", "{'k': 'n/a', 'm': 1}", "[]", "-99", "3.5", "2020-01-02"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    got = {k: [r["c"] for r in C.enforce_schema(df, {"c": k}).orderBy("i").collect()] for k in ("bool", "number", "string", "list", "dict")}
    assert got["bool"][:8] == [True, False, True, False, None, None, None, None]
    assert got["number"][2:6] == [1.0, 0.0, 2.0, None] and got["number"][13:15] == [-99.0, 3.5]
    assert got["string"][8] == "a" and got["string"][10] == "[broken" and got["string"][12] is None and got["string"][13] is None
    assert got["list"][0] == ["yes"] and got["list"][8] == ["a", None] and got["list"][12] is None and got["list"][5] is None
    assert got["dict"][11] == {"m": "1"} and got["dict"][0] is None
    assert C.enforce_schema(df, {"absent": "bool"}).columns == ["i", "c"]
    safe = C.enforce_schema(df, {"c": "number"}, {"c": ("-99",)}).orderBy("i").collect()
    assert safe[13]["c"] == -99.0
    assert C.enforce_report(df, {"c": "bool"}).first().asDict() == {"column": "c", "total": 11, "placeholders": 3, "mismatch": 8}


def test_policies_for_mixed_columns(spark):
    df = spark.createDataFrame([("1",), ("2",), ("x",)], "c string")
    assert C.resolve_mixed(df, ["c"]) == {"c": "number"}
    assert C.resolve_mixed(df, ["c"], {"c": "skip"}) == {} and C.resolve_mixed(df, ["c"], {"c": "string"}) == {"c": "string"}


def test_duplicates(spark):
    df = spark.createDataFrame([(3, "a", None), (1, "a", None), (2, "b", 1.0), (None, "b", 1.0)], "i int, k string, v double")
    assert rows(C.drop_exact(df, "i")) == [(1, "a", None), (2, "b", 1.0)]
    assert C.drop_exact(C.drop_exact(df, "i"), "i").count() == 2
    assert C.duplicate_count(df, ["k", "v"]).first()[0] == 2
    assert C.drop_exact(df.limit(0), "i").count() == 0


def test_constant_and_sparse_columns(spark):
    df = spark.createDataFrame([(1, "x", None, None), (2, "x", "y", None)], "a int, b string, c string, d string")
    assert C.constant_columns(df) == ["b", "d"]
    assert C.drop_missing_columns(df, 0.5).columns == ["a", "b", "c"] and "d" in C.drop_missing_columns(df, 0.5, ("d",)).columns


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(5)
    got = {r["k"]: r["n"] for r in C.number_rows(df, ["k"], "n", 4181).collect()}
    assert got == {k: k + 4181 for k in range(1000)}


def test_merges(spark):
    master = spark.createDataFrame([("a", "x", 1), ("b", None, 2), ("a", "later", 3)], "k string, v string, o int")
    active = spark.createDataFrame([("a", "z", 1), ("b", "z", 2), ("c", "first", 3), ("c", "second", 4)], "k string, v string, o int")
    filled = R.fill_missing(master, active, ["k"], "v", "o")
    assert rows(filled) == [("a", "x"), ("b", None), ("c", "first")]
    again = R.fill_missing(filled.withColumn("o", F.lit(0)), active, ["k"], "v", "o")
    assert rows(again) == rows(filled)
    last = R.last_wins([master, active], ["k"], "v", "o")
    assert rows(last) == [("a", "z"), ("b", "z"), ("c", "second")]
    assert rows(R.last_wins([active, master], ["k"], "v", "o")) == [("a", "later"), ("b", None), ("c", "second")]
    assert rows(R.last_wins([active, master], ["k"], "v", "o", skip_null=True)) == [("a", "later"), ("b", "z"), ("c", "second")]
    assert rows(R.last_wins([master, master], ["k"], "v", "o")) == rows(R.last_wins([master], ["k"], "v", "o"))


def test_tasks_end(spark):
    df = spark.createDataFrame([("1", "One two. Three four.", ["One two.", "Three four."]), ("2", " ", ["x"]), ("3", "t", [])], "id string, text string, sents array<string>")
    tasks = R.all_tasks(df, "id", "text", "sents", ["m"])
    assert tasks.count() == 2 + 3 + 1
    done = R.generate(tasks, R.swap_case, {})
    assert {r["status"] for r in done.collect()} == {"ok"}
    assert R.pending_tasks(tasks, done).count() == 0
    empty = done.withColumn("rewritten", F.lit(""))
    assert {r["type"] for r in R.pending_tasks(tasks, empty).collect()} == {"percentage", "full_abstract"}

    def broken(prompt, text, model, seed):
        raise RuntimeError("down")

    assert {r["status"] for r in R.generate(tasks, broken, {}).collect()} == {"error"}
    same = R.generate(tasks.where("type = 'full_abstract'").withColumn("text", F.lit("w " * 60)), lambda p, t, m, s: t, {})
    assert same.first()["rewritten"] == R.FAILED


def test_checkpoint_lines(spark):
    lines = ['{"id": 1, "type": "sentence", "model": "m", "sent_idx": 0, "text": "a", "rewritten": null}', '{"_id": "2", "sent_idx": 3, "text": "b", "x": "X", "y": "Y"}', "", None, '{"id": 1', "[1]"]
    got = rows(io.parse_checkpoint(spark.createDataFrame([(x,) for x in lines], "value string")))
    assert [r[0] for r in got].count("corrupt") == 2 and [r[0] for r in got].count("blank") == 2
    assert ("ok", "1", "sentence", "m", 0, None, "a", None) in got and ("ok", "2", "sentence", "y", 3, None, "b", "Y") in got and ("ok", "2", "sentence", "x", 3, None, "b", "X") in got


def test_stores(spark, tmp_path):
    for n, names in {"a.zip": ["x/1.md", "2.json"], "b.zip": ["2.json", "3.pdf"]}.items():
        with zipfile.ZipFile(tmp_path / n, "w") as z:
            for m in names:
                z.writestr(m, f"{n} {m} é")
    (tmp_path / "broken.zip").write_bytes(b"no zip")
    members = archives.list_zips(spark, str(tmp_path), content=True)
    assert sorted(r["stem"] for r in members.collect()) == ["1", "2", "2", "3"]
    assert {r["name"]: r["path"][-5:] for r in archives.index_zips(members).collect()}["2.json"] == "b.zip"
    assert archives.read_text(members).where("name = '3.pdf'").first()["text"] == "b.zip 3.pdf é"
    packed = archives.pack_zips(members.withColumn("shard", F.lit(1)), str(tmp_path / "out")).first()
    assert packed["files"] == 3 and sorted(zipfile.ZipFile(tmp_path / "out" / "1.zip").namelist()) == ["1.md", "2.json", "3.pdf"]


def test_packing_streams(spark, tmp_path):
    """Shards larger than a batch, equal names, nulls, and a split and merge that may be run again."""
    data = spark.range(3000).select(F.when(F.col("id") % 7 > 0, F.col("id") % 2).alias("shard"), F.concat(F.lit("d/"), (F.col("id") % 2500).cast("string"), F.lit(".md")).alias("name"), F.when(F.col("id") != 9, F.concat(F.lit("c"), F.col("id")).cast("binary")).alias("content"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    said = {r["shard"]: r["files"] for r in archives.pack_zips(data, str(tmp_path / "a b")).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want: dict = {}
    for r in data.where("content IS NOT NULL").collect():
        name, key = r["name"][2:], "none" if r["shard"] is None else str(r["shard"])
        want[key, name] = min(want.get((key, name), bytes(r["content"])), bytes(r["content"]))
    members = archives.list_zips(spark, str(tmp_path / "a b"), content=True)
    assert {(r["path"].rsplit("/", 1)[-1][:-4], r["name"]): bytes(r["content"]) for r in members.collect()} == want
    assert said == {k: sum(key == k for key, _ in want) for k in said} and len(said) == 3

    for folder in ("7", "x"):
        (tmp_path / "f" / folder).mkdir(parents=True)
        (tmp_path / "f" / folder / f"{folder}.json").write_text(folder)
    files = archives.list_folders(spark, str(tmp_path / "f"), content=True)
    counts = [sum(r["files"] for r in archives.split_store(members, files, str(tmp_path / "parts"), 3, run, 2).collect()) for run in "01"]
    names = {n for _, n in want}
    assert counts == [len(names) + 2, 0] and (tmp_path / "parts" / "part_1.0.0.zip").exists()
    archives.merge_stores(archives.list_zips(spark, str(tmp_path / "parts"), content=True), str(tmp_path / "all")).collect()
    assert set(zipfile.ZipFile(tmp_path / "all" / "all_0.zip").namelist()) == names | {"7.json", "x.json"}
    named = spark.createDataFrame([("f/1_meta.json", "new"), ("f/1.json", "old"), ("g/1.json", "stays"), ("a_meta/2.md", "too"), ("3_meta.md", "moves")], "name string, content string")
    assert rows(archives.rename_meta(named)) == rows(spark.createDataFrame([("f/1.json", "new"), ("g/1.json", "stays"), ("a_meta/2.md", "too"), ("3.md", "moves")], "name string, content string"))


def test_types_and_reports(spark):
    df = spark.createDataFrame([(1, 1.0, 2.5, None, "7", 1e300), (2, None, 3.0, None, "x", 1.0)], "k int, a double, b double, c double, s string, h double")
    assert [f.dataType.simpleString() for f in C.narrow_types(df).schema] == ["int", "bigint", "double", "double", "string", "double"]
    assert rows(C.narrow_types(df)) == rows(df.withColumn("a", F.col("a").cast("long"))) and C.narrow_types(df.limit(0)).schema == df.schema
    mixed = spark.createDataFrame([(x, x) for x in ("1", "2", "3", "b", "a", "a", "4.5", "true", "n/a", "")], "m string, n string")
    got = {r["column"]: (r["majority"], r["outliers"]) for r in C.type_outliers(mixed, ["m", "n"], 3).collect()}
    assert got == {c: ("str", ["1", "2", "3"]) for c in "mn"} and C.type_outliers(mixed.limit(0), ["m"]).count() == 0
    tasks = spark.createDataFrame([("1", 0, "a"), ("1", 1, "a"), ("2", 0, 'q"}'), ("3", 0, None)], "id string, sent_idx int, text string")
    lines = R.older_lines(spark.createDataFrame([("1", 0, "a", "m", None), ("2", 0, 'q"}', "n", "{x}"), ("3", 0, None, "m", "y"), ("9", 0, "a", "m", "y")], "id string, sent_idx int, text string, model string, rewritten string"))
    assert json.loads(lines.collect()[1]["value"]) == {"id": "2", "sent_idx": 0, "text": 'q"}', "n": "{x}"}
    log = io.parse_checkpoint(lines)
    assert rows(R.older_pending(tasks, log, ["m", "n"]).select("id", "sent_idx", "model")) == rows(spark.createDataFrame([("1", 0, "n"), ("1", 1, "n"), ("2", 0, "m"), ("3", 0, "m"), ("3", 0, "n")], "id string, sent_idx int, model string"))
    more = lines.unionByName(spark.createDataFrame([("",), ("{bad",), ('{"id": "1", "type": "full_abstract", "model": "m", "text": "t", "rewritten": "r"}',), ('{"id": "2", "type": "sentence", "model": "m", "text": "gone", "rewritten": "r"}',)], "value string"))
    report = R.align_report(R.align(io.parse_checkpoint(more), tasks)).first().asDict()
    # Without a result: record 1. With one: 2 matches, 3 has no text to match, 9 isn't a row; then a full text and a sentence that is gone.
    assert report == {"loaded": 6, "matched": 1, "other": 1, "unmatched": 3, "id_missing": 1, "corrupt": 1, "blank": 1}
    assert R.align_report(R.align(io.parse_checkpoint(more.limit(0)), tasks)).first().asDict() == dict.fromkeys(report, 0)


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", \n b', None), (2, "é\t", "x")], "i int, s string, t string")
    for kind in ("parquet", "jsonl"):
        path = f"{tmp_path}/t.{kind}"
        io.write_any(df, path)
        assert rows(io.read_any(spark, path, df.schema)) == rows(df)
        io.write_any(io.read_any(spark, path, df.schema).limit(1), path, "overwrite")
        assert io.read_any(spark, path, df.schema).count() == 1
    io.write_any(df, f"{tmp_path}/t.tsv")
    assert rows(io.read_any(spark, f"{tmp_path}/t.tsv", df.schema).select("i", "t")) == rows(df.select("i", "t"))
    assert io.load_state(spark, f"{tmp_path}/none.parquet", df.schema).count() == 0
    with pytest.raises(ValueError):
        io.read_any(spark, "x.xls")


def test_fuzzy_rows(spark):
    data = [(1, "big data in town", "A B", None), (2, "data in big town", "B A", "x"), (3, "other thing whole", "C", None), (4, "big data in town", "Z Y", None), (5, None, "A B", None), (6, "other thing whole", "C", None)]
    df = spark.createDataFrame(data, "id int, title string, author string, extra string")
    assert rows(X.resolve_fuzzy(df, "title", "author", "id")) == [(1, 2), (6, 3)]


def test_fuzzy_parts(spark, monkeypatch):
    """Any number of parts gives what comparing all titles gives."""
    rng = random.Random(5)
    words = ["red", "blue", "great", "pine", "old", "steel", "oak"]
    titles = sorted({" ".join(rng.choices(words, k=rng.randint(0, 5))) for _ in range(70)})

    def score(a, b):
        x, y = (" ".join(sorted(v.split())) for v in (a, b))
        return 200.0 * X.subsequence_length(x, y) / (len(x) + len(y)) if x or y else 100.0

    want = set()
    for a in titles:
        best = sorted((-score(a, b), b) for b in titles if score(a, b) >= 60)[:5]
        want |= {(a, b, -s) for s, b in best if b != a}
    df = spark.createDataFrame([(t,) for t in [*titles, *titles, None]], "t string")
    for side in (7, 1000):
        monkeypatch.setattr(X, "SIDE", side)
        assert {tuple(r) for r in X.fuzzy_pairs(df, "t").collect()} == want
    assert X.fuzzy_pairs(df.limit(0), "t").count() == 0


def test_generate_pending(spark):
    tasks = spark.createDataFrame([(str(i), m, k, i % 3 if k == "sentence" else None, None, f"text {i}") for i in range(6) for m in "ab" for k in ("sentence", "full_abstract")], "id string, model string, type string, sent_idx int, percentage int, text string")
    done = spark.createDataFrame([("0", "a", "sentence", 0, None, "x"), ("1", "a", "full_abstract", None, None, "")], "id string, model string, type string, sent_idx int, percentage int, rewritten string")
    got = R.generate_pending(tasks, done, R.swap_case, {}, ("sentence",), 2).collect()
    assert sorted((r["id"], r["model"], r["rewritten"]) for r in got) == [("0", "b", "TEXT 0"), ("1", "a", "TEXT 1"), ("1", "b", "TEXT 1"), ("2", "a", "TEXT 2")]
    assert R.generate_pending(tasks, done, R.swap_case, {}).count() == 23


def test_outline(spark):
    md = "lead\n\n- dropped? no\n\n# C1\ntext one\n## S\n### D\n### E\npara\nmore\n\n1. x\n2. y\n\n# C2\n\n# C3\nlast"
    got = rows(X.outline(spark.createDataFrame([(1, md), (2, "- early"), (3, None)], "id int, md string"), "id", "md"))
    flat = [(r[1], r[2], list(r[3]), r[4], r[6]) for r in got if r[0] == 1]
    assert (1, "Introduction", [], "text", "lead") in flat and (1, "Introduction", [], "list_container", "dropped? no") in flat
    assert (2, "C1", [], "text", "text one") in flat and (2, "C1", ["S", "D", "E"], "text", "para more") in flat
    assert (2, "C1", ["S", "D", "E"], "list_container", "x | y") in flat and (4, "C3", [], "text", "last") in flat
    assert not [r for r in got if r[0] in (2, 3)]


def test_inline_marks(spark):
    cases = {"**B** *i* ***x y.*** _u_ __v__": "B i x y. u v", "[l](/u) ![p](s) `c_d`": "l p c_d", "a_b_c 2*3*4 * x * #*$ *": "a_b_c 2*3*4 * x * #*$ *", "\\*no\\* \\# \\a": "*no* # \\a", "": ""}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want string")
    assert [tuple(r) for r in df.select(X.inline_text(F.col("t")).alias("got"), "want").where("got <> want").collect()] == []
    md = "# **A** b\n\n> quote\n\n---\n\n```py\n# no\n\nno\n```\n- *x*\n- y\n\n* * *\n\nlast\n\n~~~\nopen"
    got = spark.createDataFrame([(md,)], "t string").select(F.explode(X.block_array(F.col("t"))).alias("b")).select("b.*").collect()
    assert [(r["kind"], r["value"]) for r in got] == [("heading", "A b"), ("list", "x | y"), ("text", "last")]


def test_outline_trees(spark):
    """Trees against nested objects built node by node; sections thousands deep."""
    marks = ["# A", "## B", '### C "q"', "###### D", "- x\n- y", "text\nmore", "1. n"]
    rng = random.Random(3)
    texts = ["\n\n".join(rng.choices(marks, k=rng.randint(0, 12))) for _ in range(60)] + [None, "", "# A\n\n" + "### in\n\n" * 5000 + "end"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, md string")
    kept = {r["id"]: r for r in X.outline_trees(df, "id", "md").collect()}
    parts = {r["id"]: r["b"] for r in df.select("id", X.block_array(F.col("md")).alias("b")).collect()}
    assert len(kept) == len(texts) and kept[62]["tree"].endswith('"value": "end"}' + "]}" * 5002) and kept[62]["title"] == "A"
    for i in range(62):
        chapters, chapter, section = [], None, None

        def begin(title, chapters=chapters):
            chapters.append({"type": "chapter", "title": title, "content": []})
            return chapters[-1]

        for kind, level, value in parts[i]:
            if kind == "heading" and level == 1:
                chapter, section = begin(value), None
            elif kind == "heading":
                if level == 2:
                    chapter = chapter or begin("Untitled Chapter")
                home = chapter if level == 2 else section or chapter
                if home:
                    section = {"type": "section", "title": value, "level": level, "content": []}
                    home["content"].append(section)
            elif kind == "text" or chapter:
                chapter = chapter or begin("Introduction")
                (section or chapter)["content"].append({"type": "text" if kind == "text" else "list_container", "value": value})
        title = chapters[0]["title"] if chapters else "Extracted Document"
        assert json.loads(kept[i]["tree"]) == {"title": title, "chapters": chapters} and kept[i]["title"] == title
    one = spark.createDataFrame([(1, "# A\n\nx"), (1, "y"), (None, "z")], "id int, md string")
    assert rows(X.outline(one, "id", "md").select("id", "chapter", "block_no", "value")) == rows(spark.createDataFrame([(1, "A", 1, "x"), (1, "Introduction", 1, "y"), (None, "Introduction", 1, "z")], "id int, chapter string, block_no int, value string"))


def test_pages(spark):
    html = '<html lang="nl"><h1 class=x> Hi </h1><div class="a b">one <br> <p>two</p></div><div class="a">three</div>'
    got = spark.createDataFrame([(html,), (None,)], "h string").select(X.class_texts(F.col("h"), ("a", "z")).alias("m")).collect()
    assert got[0]["m"] == {"a": "one two three"} and got[1]["m"] == {}


def test_split_and_figures(spark):
    df = spark.createDataFrame([(g, i) for g in range(50) for i in range(3)], "g int, i int")
    out = D.group_split(df, "g")
    sides = out.groupBy("g").agg(F.count_distinct("is_test").alias("n")).where("n > 1").count()
    assert sides == 0 and out.where("is_test").select("g").distinct().count() == 10
    hexes = spark.range(500).select(F.md5(F.col("id").cast("string").cast("binary")).alias("h"))
    ordered = sorted(r["h"] for r in hexes.collect())
    assert all(D.kth_smallest(hexes, "h", k, leaf=20) == ordered[k - 1] for k in (1, 37, 499, 500)) and D.kth_smallest(hexes, "h", 0) is None
    scored = spark.createDataFrame([(1, 1, 0.9), (0, 1, 0.5), (1, 0, 0.5), (0, 0, 0.1)], "label int, prediction int, score double")
    assert D.auc(scored, "score", "label").first()["auc"] == pytest.approx(0.875)
    assert rows(D.report(scored).select("label", "precision", "recall", "support")) == [(0, 0.5, 0.5, 2), (1, 0.5, 0.5, 2)]


def test_set_compares(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(2,), (3,), (None,)], "k int")
    assert rows(I.membership(a, b, "k", "f")) == [(1, False), (2, True), (2, True)]
    assert I.integrity(a, b.dropna(), "k").first().asDict() == {"matches": 1, "missing": 1, "extra": 1}
    assert rows(I.insert_new(a.distinct(), b.dropna(), "k")) == [(1,), (2,), (3,)]
    assert rows(I.update_non_null(a.distinct().withColumn("v", F.lit("o")), spark.createDataFrame([(1, None), (2, "n")], "k int, v string"), "k")) == [(1, "o"), (2, "n")]


def test_detector_queries_take_every_labelled_document_and_ngram(spark, tmp_path, monkeypatch):
    from corpusmill.operators import detect
    from corpusmill.plans import rewriting

    r = random.Random(4)
    texts = {i: ("good fine text " if i % 2 else "bad poor words ") + "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(120)) for i in range(40)}
    rows = [*texts.items(), (40, " "), (41, None), (42, "not labelled")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(42)] + [(42, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    fitted = []
    fit = detect.Detector.fit
    monkeypatch.setattr(detect.Detector, "fit", lambda self, df: fitted.append(self) or fit(self, df))
    assert rewriting.rated(spark, str(tmp_path)).count() == 40
    top = rewriting.top_coefs(spark, str(tmp_path)).collect()
    assert [r["side"] for r in top] == ["quality 0"] * 10 + ["quality 1"] * 10
    want = {t[i : i + n] for t in texts.values() for n in (3, 4, 5) for i in range(len(t) - n + 1)}
    assert len(want) > 5000 and set(fitted[0].counter.vocabulary) == want


def test_pruning_goes_down(spark):
    df = spark.createDataFrame([(["a", "n/a", None], {"k": ["-"], "m": ["x", " "]}, (("?", ["nan", "z"]), None))], "a array<string>, m map<string,array<string>>, s struct<i:struct<t:string,u:array<string>>,e:string>")
    got = df.select(*[C.prune(F.col(f.name), f.dataType).alias(f.name) for f in df.schema]).first()
    assert got["a"] == ["a", None, None] and got["m"] == {"m": ["x", None]} and got["s"]["i"]["u"] == [None, "z"] and got["s"]["i"]["t"] is None
    empty = df.limit(1).select(F.expr("array('n/a', null)").alias("a"), F.expr("map('k', array('-'))").alias("m"), F.expr("named_struct('i', '--')").alias("s"))
    assert tuple(empty.select(*[C.prune(F.col(f.name), f.dataType).alias(f.name) for f in empty.schema]).first()) == (None, None, None)
    text = spark.createDataFrame([("{'a': ['n/a', {'b': None}], 'c': [1, 'n/a'], 'd': 999}",), ("[['x', '-'], ['--']]",)], "t string")
    found = [r[0] for r in text.select(C.pruned_literal("t")).collect()]
    assert found == ['{"c": [1, null]}', '[["x", null], null]']


def test_quantiles_by_counting(spark):
    r = random.Random(3)
    for values in ([r.gauss(0, 1) for _ in range(3000)], [5.0] * 2000 + [r.random() * 1e9 for _ in range(200)], [1.0], [2.0, 4.0]):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        want = df.agg(F.percentile("x", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))).first()[0]
        assert C.quantiles(df, [0.05, 0.5, 0.95], leaf=50, bins=10) == pytest.approx(want)
    assert C.quantiles(spark.createDataFrame([], "x double"), [0.5]) is None
    capped = C.cap_outliers(spark.createDataFrame([(None,), (1.0,), (100.0,)], "x double"), ["x"]).collect()
    assert sorted(x[0] for x in capped if x[0] is not None) == pytest.approx([5.95, 95.05])


def test_boolean_words_need_few_values(spark):
    words = ["yes", "no", "Y", "n", "true", "false", "on", "off", "t", "f", "1", "0"]
    few, many = spark.createDataFrame([(w,) for w in words[:8]], "c string"), spark.createDataFrame([(w,) for w in words], "c string")
    assert C.infer_schema(few).first()["type"] == "bool" and C.infer_schema(many).first()["type"] == "string"
    blanks = spark.createDataFrame([(w,) for w in words[:6] + ["-" * i for i in range(1, 8)]], "c string")
    assert C.infer_schema(blanks).first()["type"] == "string"


def test_long_chains_of_titles_end(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(500)], "a long, b long")
    assert {r["root"] for r in X.connected(chain).collect()} == {0}


def test_scratch_folders(spark, tmp_path, monkeypatch):
    from corpusmill.sources import session

    df = session.materialize(spark.range(10).withColumn("k", F.col("id") % 2), by="k")
    path = session._PATHS[df].removeprefix("file:")
    folders = lambda: sorted(x.name for x in __import__("pathlib").Path(path).glob("k=*"))
    assert df.count() == 10 and folders() == ["k=0", "k=1"]
    session.discard(df, part="k=0")
    assert folders() == ["k=1"] and df.where("k = 1").count() == 5
    session.discard(df)
    assert not __import__("os").path.exists(path)

    class Remote:
        """A session on a cluster that names no shared folder."""

        master, getCheckpointDir = "spark://far:7077", staticmethod(lambda: None)
        conf = type("C", (), {"get": staticmethod(lambda key, default="file:/own/disk": None if key == "spark.checkpoint.dir" else default)})
        sparkContext = property(lambda self: self)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Remote())


def test_confusion(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (1, 0), (1, 1)], "label int, prediction int")
    assert rows(D.confusion(df)) == [(0, 0, 1), (0, 1, 0), (1, 0, 1), (1, 1, 2)]
    assert rows(D.confusion(df.limit(0))) == [(0, 0, 0), (0, 1, 0), (1, 0, 0), (1, 1, 0)]


def spark_svm(df, iterations):
    """Terms' weights and intercept by Spark's own CountVectorizer, IDF, Normalizer and LinearSVC."""
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.feature import IDF, CountVectorizer, Normalizer
    from pyspark.ml.linalg import Vectors, VectorUDT

    log = F.udf(lambda v: Vectors.sparse(v.size, v.indices, [1 + math.log(x) for x in v.values]), VectorUDT())
    grams = df.withColumn("grams", D.char_ngrams(F.col("text")))
    counter = CountVectorizer(inputCol="grams", outputCol="tf", vocabSize=2**31 - 1, minDF=1).fit(grams)
    logs = counter.transform(grams).withColumn("log_tf", log("tf"))
    norm = Normalizer(inputCol="raw", outputCol="features", p=2.0).transform(IDF(inputCol="log_tf", outputCol="raw").fit(logs).transform(logs))
    model = LinearSVC(featuresCol="features", labelCol="label", regParam=1e-3, maxIter=iterations).fit(norm)
    return dict(zip(counter.vocabulary, model.coefficients.toArray().tolist(), strict=True)), model.intercept


@pytest.mark.parametrize("iterations", [3, 25])
def test_detector_fits_as_spark_does(spark, iterations):
    """Also with short, blank, repeated and very repetitive texts, and where trials of a step go on (25 iterations)."""
    r = random.Random(8)
    texts = [" ".join(r.choice(["good", "fine", "bad", "poor", "red", "blue", "x\U0001f600y"]) for _ in range(r.randint(1, 40))) for _ in range(60)] + ["ab", "ab", "so  so", "é" * 900, "no" * 400]
    df = spark.createDataFrame([(t, int("good" in t) ^ (i % 9 == 0)) for i, t in enumerate(texts)], "text string, label int").repartition(5)
    want, intercept = spark_svm(df, iterations)
    net = D.Detector(iterations=iterations).fit(df)
    got = dict(zip(net.counter.vocabulary, net.coefficients.tolist(), strict=True))
    assert got.keys() == want.keys() and net.intercept == pytest.approx(intercept, abs=1e-6)
    assert max(abs(got[t] - want[t]) for t in want) < 1e-6


def test_packed_documents():
    """Three bytes an n-gram, whatever the gaps and counts; n-grams of more than 4,095 characters too."""
    from collections import Counter

    import numpy as np

    from corpusmill.operators import margins as M

    r = random.Random(2)
    texts = ["".join(chr(r.randint(0x4E00, 0x9000)) for _ in range(9000)), "ab" * 700, "", "xy", "abcab" + chr(0x4E00)]
    for some in (texts, texts[1:]):
        coder = M.Coder(M.distinct(M.code_points(t) for t in some))
        if coder.wide:
            coder.threes = M.distinct(coder.of_three(coder.digits(t)) for t in some)
        assert coder.wide == (some is texts)
        for t in some:
            want = Counter(t[i : i + n] for n in (3, 4, 5) for i in range(len(t) - n + 1))
            assert Counter(coder.term(k) for k in coder.keys(t)) == want
    keys = np.arange(1, 200_001, dtype=np.uint64)

    class Wide:
        keys = staticmethod(lambda text: np.repeat(np.array([1, 70_000, 199_999], np.uint64), [1, 254, 5000]))

    lexicon = M.Lexicon(Wide(), keys, np.arange(200_000, dtype=np.int32), np.ones(200_000), 1)
    (chunk,) = M.pack([("a", 1), ("b", 0)], lexicon)
    ids, logs = M.unpack(chunk)
    at = np.flatnonzero(logs)
    assert ids[at].tolist() == [0, 69_999, 199_998] * 2 and logs[at] == pytest.approx([1, 1 + math.log(254), 1 + math.log(5000)] * 2)
    with pytest.raises(ValueError, match="labels"):
        list(M.pack([("a", 2)], lexicon))


def test_detector_without_rows(spark):
    none = spark.createDataFrame([], "text string, label int")
    net = D.Detector().fit(none)
    assert net.score(none).count() == 0 and net.strongest(spark).count() == 0
    assert D.Detector(iterations=2).fit(spark.createDataFrame([("ab", 1), (None, 0)], "text string, label int")).strongest(spark).count() == 0
