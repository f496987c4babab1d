"""Scalar functions, one table of cases each."""

from __future__ import annotations

import random
import zlib

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import rewrites as R
from corpusmill.operators import texts as X


def check(spark, f, cases):
    df = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(cases)], "i int, x string")
    got = {r["i"]: r["y"] for r in df.select("i", f(F.col("x")).alias("y")).collect()}
    for i, (k, want) in enumerate(cases):
        assert got[i] == want, repr(k)


def test_placeholders(spark):
    bad = [None, "", "   ", "NaN", "n/a", "NA", "NULL", "none", "<none>", "Not Reported", "unknown", "undefined", "missing", "-", "---", "/", "//", "??", "-99", "-9999", "999", "9999", " 999 ", "\t\n"]
    check(spark, T.is_placeholder, [(x, True) for x in bad] + [(x, False) for x in ["0", "n/a x", "9", "nanny", "a-", "-98"]])
    check(spark, lambda c: T.is_placeholder(c, ("999", "-")), [("999", False), ("-", False), ("9999", True)])


def test_names(spark):
    check(spark, T.safe_filename, [("con", "_con"), ("CON.txt", "_CON.txt"), ("conx.txt", "conx.txt"), ('a/b:c*"?<>|\\', "a_b_c_______"), (" .x. ", "x"), ("...", "_empty_filename_"), ("", "_empty_filename_"), ("lpt9.tar.gz", "lpt9.tar.gz"), (None, None)])
    check(spark, T.plain_filename, [("aé b.c", "aé b_c"), ("  ", "untitled"), ("..a", "__a"), ("x/ñ", "x__")])


def test_replies(spark):
    check(spark, T.normalize_text, [(None, ""), ("‘a’  “b” `c`\n\td ", "'a' \"b\" 'c' d")])
    check(spark, T.after_marker, [("a", "a"), ("t<channel|> one <channel|> two", "one")])
    check(spark, lambda c: T.after_marker(c, last=True), [("t<channel|> one <channel|> two", "two")])
    check(spark, lambda c: T.clean_reply(c, F.lit("plain")), [(' "quoted" ', "quoted"), ('"half', '"half'), ("a\0b", "ab"), ('"', "")])
    check(spark, lambda c: T.clean_reply(c, F.lit('"own')), [('"quoted"', '"quoted"')])
    check(spark, T.targets, [("<target>a</target>x<TARGET>b\nc</Target>", ["a", "b\nc"]), ("none", [])])


def test_links_and_kinds(spark):
    check(spark, T.links, [('<a href="x"> <a href=\'y\'><a href="x">', ["x", "y"]), ("", [])])
    check(spark, lambda c: T.file_kind(F.lit("application/octet-stream"), c), [("http://x/a.PDF?b.c", "pdf"), ("http://x/a.exe", "bin")])
    check(spark, lambda c: T.file_kind(c, F.lit("u")), [("Application/pdf; q", "pdf"), ("text/x", None), (None, None)])
    check(spark, T.is_short, [("one two three", True), ("a" * 41 + " b c d e f g", False), ("seven short words are still a few", True)])
    check(spark, lambda c: T.shard_of(c, 3), [("7", 1), ("-1", 2)])
    assert spark.range(1).select(T.task_seed(F.lit("12"), F.lit(25))).first()[0] == zlib.crc32(b"12_25")


def test_similarity(spark):
    r = random.Random(1)

    def table(a, b):
        m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                m[i + 1][j + 1] = m[i][j] + 1 if x == y else max(m[i][j + 1], m[i + 1][j])
        return m[-1][-1]

    pairs = [("kitten", "sitting"), ("", "a"), ("same", "same")] + [tuple("".join(r.choice("abcé ") for _ in range(r.randint(0, 25))) for _ in range(2)) for _ in range(60)]
    for a, b in pairs:
        assert X.subsequence_length(a, b) == table(a, b)
    df = spark.createDataFrame(pairs[:12], "a string, b string")
    assert [x[0] for x in df.select(T.common_subsequence(F.col("a"), F.col("b"))).collect()] == [table(a, b) for a, b in pairs[:12]]
    check(spark, T.sorted_tokens, [("b  a\tc", "a b c"), ("", "")])


def test_sentences(spark):
    text = "One is here. two goes on! Three? A. Four... é five. (Six). 7 ends"
    merged = ["One is here. two goes on!", "Three?", "Four... é five. (Six). 7 ends"]
    # "A." has punctuation second, so it joins the one before.
    merged[1] = "Three? A."
    check(spark, X.merged_sentences, [(text, merged), ("", []), (None, []), ("\n. \n", ["."])])
    check(spark, lambda c: X.merge_fragments(X.split_sentences(c)), [(text, merged), ("", [])])
    check(spark, X.vote_language, [("the cat and the dog", "en"), ("le chat est dans", "fr"), ("", None), (None, None), ("xyz", None)])


def test_shares(spark):
    df = spark.createDataFrame([(1, 25), (2, 25), (6, 25), (10, 25), (3, 50), (5, 50), (7, 75)], "n int, p int")
    got = [r[0] for r in df.select(R.tag_count(F.col("n"), F.col("p"))).collect()]
    assert got == [max(1, round(n * (p / 100.0))) for n, p in [(1, 25), (2, 25), (6, 25), (10, 25), (3, 50), (5, 50), (7, 75)]]
    seeded = spark.createDataFrame([("9", 50, 8)], "k string, p int, n int").select(R.tagged_by_seed("k", "p", "n")).first()[0]
    assert seeded == sorted(random.Random(zlib.crc32(b"9_50")).sample(range(8), 4))


@pytest.mark.parametrize("reply,reason", [("", "empty"), (None, "empty"), ("no tags", "tag_count"), ("<target> </target><target>x</target>", "empty_target"), ("<target>b</target><target> “d” </target>", "unchanged_target"), ("<target>B2</target> x <target>D2</target>", "success")])
def test_validation(spark, reply, reason):
    row = spark.createDataFrame([(["a", "b", "c", '"d"'], [3, 1], reply)], "s array<string>, t array<int>, r string").select(R.validate(F.col("s"), F.col("t"), F.col("r")).alias("v")).first()["v"]
    assert row["reason"] == reason and row["stitched"] == ("a B2 c D2" if reason == "success" else None)
