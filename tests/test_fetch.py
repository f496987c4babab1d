from __future__ import annotations

import shutil

import pytest
from pyspark.sql import functions as F

from corpusmill.functions.text import html_to_markdown
from corpusmill.operators.cleaning import nan_to_null
from corpusmill.sources import fetch as S


def test_fetch_and_crawl(spark):
    def get(url):
        if url == "bad":
            raise OSError(url)
        return ("text/plain", url.encode()) if url != "gone" else None

    df = spark.createDataFrame([("a", 1), ("bad", 2), ("gone", 3), (None, 4)], "u string, n int")
    got = {r["n"]: (r["status"], bytes(r["body"]) if r["body"] else None) for r in S.fetch(df, "u", get).collect()}
    assert got == {1: ("ok", b"a"), 2: ("error", None), 3: ("none", None), 4: ("none", None)}
    pages = {1: ["x", "y"], 2: [], 3: None, 5: ["z", "x"], 12: ["late"]}
    assert S.crawl(pages.get) == ["x", "y", "z"]
    meta = spark.createDataFrame([("1", "l", True), ("2", "l", None), ("3", None, False), ("4", "l", False)], "id string, download_link string, downloaded boolean")
    assert [r["id"] for r in S.missing_downloads(meta, spark.createDataFrame([("4",)], "stem string")).collect()] == ["2"]


def test_markdown_and_nan(spark):
    html = "<h2 class=x>T &amp; U</h2><p>one<br/>two</p><ul><li>a</li><li>b</li></ul><script>no</script>"
    got = spark.createDataFrame([(html,)], "h string").select(html_to_markdown(F.col("h"))).first()[0]
    assert got == "## T & U\n\none\ntwo\n\n- a\n- b"
    html = '<p><b>B</b> <i class=x>i</i> <a class="k" href="/u">link</a> <img src="s.png" alt="pic"> <code>c_d</code></p><hr><blockquote>q</blockquote><body>z</body><pre><code>a\n\n# b</code></pre>'
    got = spark.createDataFrame([(html,)], "h string").select(html_to_markdown(F.col("h"))).first()[0]
    assert got == "**B** *i* [link](/u) ![pic](s.png) `c_d`\n\n---\n\nqz\n\n```\na\n\n# b\n```"
    assert nan_to_null(spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "x double")).where("x IS NULL").count() == 2


def test_cached(tmp_path):
    def broken(url):
        yield b"ab"
        raise OSError(url)

    path, calls = str(tmp_path / "d" / "dump.bin"), []
    with pytest.raises(OSError):
        S.cached("u", path, broken)
    for _ in range(2):
        assert S.cached("u", path, lambda url: calls.append(url) or [b"ab", b"c"]) == path
    assert calls == ["u"] and (tmp_path / "d" / "dump.bin").read_bytes() == b"abc"


def test_scrape(spark, tmp_path):
    """Steps that are run again go on from what is saved: pages that had nothing, files a stop left unmarked, links that are new."""
    folder = str(tmp_path / "s")
    asked = tmp_path / "asked"
    asked.mkdir()

    def facts(link, known):
        if link == "bad":
            raise OSError(link)
        return known.get(link)

    def get(link):
        (asked / link).write_text((asked / link).read_text() + "x" if (asked / link).exists() else "x")
        return {"l1": ("application/pdf", b"1"), "l2": ("text/html", b"2"), "l4": ("application/msword; x", b"4")}.get(link)

    whole = {"title": "t", "last_name": "n", "college": "c", "year": "2001.0", "promoter": "p"}
    known = {"a": {**whole, "download_link": "l1"}, "b": {**whole, "year": "n.d.", "download_link": "l2"}}
    source = S.Scrape(spark, folder, "web", wave=2)
    links = spark.createDataFrame([("a",), ("b",), ("bad",), (None,), ("a",)], "page_link string")
    assert source.state().count() == 0
    first = {r["page_link"]: r for r in source.run(links, lambda u: facts(u, known), get).collect()}
    assert sorted(first) == ["a", "b", "bad"] and first["a"]["year"] == 2001 and first["b"]["year"] is None and first["bad"]["title"] is None
    assert [first[k]["downloaded"] for k in ("a", "b", "bad")] == [True, False, None] and {r["source"] for r in first.values()} == {"web"}
    # A step that broke off has no mark of success and isn't read; its number is not used again.
    broken = tmp_path / "s" / "log" / "step-000000099"
    shutil.copytree(tmp_path / "s" / "log" / "step-000000001", broken)
    (broken / "_SUCCESS").unlink()
    known["b"]["year"], known["c"] = 1999, {**whole, "download_link": "l4"}
    again = S.Scrape(spark, folder, "web", wave=2)
    assert again.gather(spark.createDataFrame([("a",), ("c",)], "page_link string")) == 1
    second = {r["page_link"]: r for r in again.run(None, lambda u: facts(u, known), get).collect()}
    assert second["b"]["year"] == 1999 and second["c"]["downloaded"] and second["a"]["title"] == "t"
    assert {f.name: f.read_text() for f in asked.iterdir()} == {"l1": "x", "l2": "xx", "l4": "x"}
    kinds = sorted(r["name"].split(".")[1] for r in S.list_zips(spark, f"{folder}/files").collect())
    assert kinds == ["doc", "pdf"]
    # A file that is there but not marked is marked, not fetched.
    again._save(spark.createDataFrame([("a", False)], "page_link string, downloaded boolean"))
    assert again.run(fetcher=get).where("page_link = 'a'").first()["downloaded"] and (asked / "l1").read_text() == "x"


def test_download_missing(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def get(link):
        (calls / link.replace("/", "_")).touch()
        return {"a.pdf": ("application/octet-stream", b"a"), "b": ("application/pdf", b"b"), "e": ("text/html", b"")}.get(link)

    schema = "id long, download_link string, downloaded boolean, stem string"
    meta = spark.createDataFrame([(1, "a.pdf", None, "x"), (2, "b", False, None), (3, None, None, None), (4, "gone", None, None), (5, "z", True, None), (None, "n", None, None), (2, "c", None, None)], schema)
    place = str(tmp_path / "files")
    for _ in range(2):
        got = S.download_missing(meta, place, get)
        assert sorted((r["id"] or 0, r["downloaded"]) for r in got.collect()) == [(0, False), (1, True), (2, True), (2, True), (3, False), (4, False), (5, True)]
    assert sorted(f.name for f in calls.iterdir()) == ["a.pdf", "b", "gone"] and got.columns == meta.columns
    assert sorted(r["name"][0] for r in S.list_zips(spark, place).collect()) == ["1", "2"]
    assert S.download_missing(meta.limit(0), str(tmp_path / "none"), get).count() == 0
