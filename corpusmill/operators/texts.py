"""Sentences, languages, near-equal titles, Markdown outlines and page metadata."""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import bound, sorted_tokens, strip

#: Common words by language.
STOP_WORDS = {
    "de": ["der", "die", "und", "das", "nicht", "ein", "ist", "von", "mit", "auf"],
    "en": ["the", "of", "and", "to", "is", "that", "for", "was", "with", "this"],
    "es": ["el", "los", "las", "del", "con", "por", "para", "una", "su", "al"],
    "fr": ["le", "les", "des", "est", "dans", "qui", "une", "pour", "sur", "du"],
    "nl": ["het", "een", "van", "niet", "zijn", "voor", "met", "dat", "deze", "wordt"],
}
PUNCTUATION = r"!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~"


# -- sentences ------------------------------------------------------------------------------------


def split_sentences(text: Column) -> Column:
    """Sentences end at ``.``, ``!`` or ``?`` before white space; trimmed, none empty. The rule is ours."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?]+)\s+", "$1\n"), "\n")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def merge_fragments(sentences: Column) -> Column:
    """A piece that doesn't begin with A-Z, or whose second character is punctuation, joins the one before."""
    follows = lambda s: ~s.rlike("^[A-Z]") | s.rlike(f"(?s)^.[{PUNCTUATION}]")
    joined = lambda acc, s: F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.lit(" "), s)))
    return F.aggregate(sentences, F.array().cast("array<string>"), lambda acc, s: F.when((F.size(acc) > 0) & follows(s), joined(acc, s)).otherwise(F.concat(acc, F.array(s))))


def merged_sentences(text: Column) -> Column:
    """T1 and T2 at once, without an array per step: a break is kept only where the next piece begins with A-Z and no punctuation follows."""
    one = F.array_join(split_sentences(text), "\n")
    # A piece that joins the one before has its break turned into a space.
    return F.when(one == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(one, rf"\n(?![A-Z](?![{PUNCTUATION}]))", " "), "\n"))


# -- languages ------------------------------------------------------------------------------------


def vote_language(text: Column) -> Column:
    """The language with most common words in the text, the first in order of equals; null without any."""
    every = "|".join(sorted({w for words in STOP_WORDS.values() for w in words}))
    # The text is gone through once, for the words of all languages.
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"(?<!\p{{L}})(?:{every})(?!\p{{L}})"), F.lit(0))
    score = lambda hits, words: F.size(F.filter(hits, lambda t: t.isin(*words)))
    scores = lambda hits: F.array(*[F.struct(score(hits, w).alias("n"), F.lit(-i).alias("o"), F.lit(code).alias("lang")) for i, (code, w) in enumerate(STOP_WORDS.items())])
    best = bound(found, lambda hits: F.array_max(scores(hits)))
    return F.when(best["n"] > 0, best["lang"])


class Trigrams:
    """Ranked character trigrams by language; a text goes to the language of least out-of-place distance (published method of n-gram text categorisation)."""

    def __init__(self, ranks: dict[str, dict[str, int]], size: int = 300) -> None:
        self.size, self.ranks = size, ranks

    @staticmethod
    def counts(text: str) -> Counter[str]:
        flat = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        return Counter(flat[i : i + 3] for i in range(len(flat) - 2))

    def profile(self, text: str) -> dict[str, int]:
        ordered = sorted(self.counts(text).items(), key=lambda x: (-x[1], x[0]))[: self.size]
        return {g: i for i, (g, _) in enumerate(ordered)}

    def detect(self, text: str | None) -> str | None:
        own = self.profile(text or "")
        if not own:
            return None
        apart = lambda ranks: sum(abs(i - ranks[g]) if g in ranks else self.size for g, i in own.items())
        return min(self.ranks, key=lambda code: (apart(self.ranks[code]), code))

    def column(self, text: Column) -> Column:
        @F.pandas_udf("string")
        def run(values: pd.Series) -> pd.Series:
            return values.map(self.detect)

        return run(text)


def learn_trigrams(df: DataFrame, text: str, lang: str, size: int = 300) -> Trigrams:
    """Profiles of each language from all its texts: a batch is counted in Python, sums meet by trigram, and ``size`` trigrams a language come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[str, Counter[str]] = {}
            for code, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums.setdefault(code, Counter()).update(Trigrams.counts(t))
            rows = [(code, g, n) for code, c in sums.items() for g, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "gram", "n"])

    counted = df.select(F.col(lang).alias("lang"), F.col(text).alias("t")).dropna().mapInArrow(run, "lang string, gram string, n long")
    best = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("__k", F.row_number().over(best)).where(F.col("__k") <= size)
    ranks: dict[str, dict[str, int]] = {}
    for r in top.orderBy("lang", "__k").collect():
        ranks.setdefault(r["lang"], {})[r["gram"]] = r["__k"] - 1
    return Trigrams(ranks, size)


def select_texts(df: DataFrame, text: str, lang: str, wanted: str, least: int = 100) -> DataFrame:
    """T4: texts of the language, long enough, with the sentences that are in it."""
    rows = df.where((F.col(lang) == wanted) & (F.length(text) >= least) & (F.trim(text) != ""))
    kept = F.filter(merged_sentences(F.col(text)), lambda s: F.coalesce(vote_language(s) == wanted, F.lit(False)))
    return rows.withColumn("sentences", kept).where(F.size("sentences") > 0)


# -- near-equal titles ----------------------------------------------------------------------------


def subsequence_length(a: str, b: str) -> int:
    """Longest common subsequence by one big integer of match bits."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """100 times twice the common subsequence over the lengths, of texts with sorted tokens."""
    return pd.Series([200.0 * subsequence_length(x, y) / (len(x) + len(y)) if x or y else 100.0 for x, y in zip(a, b, strict=True)])


def bag_bound(a: Column, b: Column) -> Column:
    """Characters in both, counted by kind: no common subsequence is longer."""
    return F.aggregate(F.map_entries(a), F.lit(0), lambda acc, e: acc + F.least(e["value"], F.coalesce(F.try_element_at(b, e["key"]), F.lit(0))))


#: Titles of one side that a task of the comparison meets, where they are spread evenly.
SIDE = 4_000


def fuzzy_pairs(titles: DataFrame, title: str, threshold: float = 60.0, limit: int = 5) -> DataFrame:
    """(t1, t2, score) of distinct titles among each other's ``limit`` best by F17 (the title itself counted, ties by text), at ``threshold`` or more.

    Titles meet by length class, equal or neighbouring, so that none meets those whose length alone rules a
    match out; pairs whose bags of characters do so are dropped next. What is left is scored in Arrow batches, each
    pair once. Both sides of a class are cut by hash into parts that follow the number of titles, and each part of
    one meets each of the other, so a task's share doesn't grow with a class; copies grow with the number of parts.
    """
    t = titles.select(F.col(title).alias("t")).where(F.col(title).isNotNull()).distinct()
    cuts = max(2, -(-t.count() // SIDE))
    t = t.withColumn("s", sorted_tokens(F.col("t"))).withColumn("n", F.length("s"))
    # 2 min / (a + b) >= threshold / 100 bounds the ratio of lengths, so classes on a log scale meet only near ones.
    ratio = (200 - threshold) / threshold
    t = t.withColumn("c", F.floor(F.log(F.greatest("n", F.lit(1))) / math.log(ratio)).cast("int"))
    letters = F.split("s", "")
    t = t.withColumn("bag", F.map_from_entries(F.transform(F.array_distinct(letters), lambda c: F.struct(c, F.size(F.filter(letters, lambda x: x == c))))))
    part, all_parts = F.pmod(F.xxhash64("t"), F.lit(cuts)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(cuts - 1)))
    left = t.select("t", "s", "n", "bag", "c", part.alias("p"), all_parts.alias("p2"))
    left = left.withColumn("c", F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)))
    right = t.select(F.col("t").alias("t2"), F.col("s").alias("s2"), F.col("n").alias("n2"), F.col("bag").alias("bag2"), "c", part.alias("p2"), all_parts.alias("p"))
    near = left.join(right, ["c", "p", "p2"]).where((F.col("t") < F.col("t2")) & (200 * F.least("n", "n2") >= threshold * (F.col("n") + F.col("n2"))))
    near = near.where(200 * bag_bound(F.col("bag"), F.col("bag2")) >= threshold * (F.col("n") + F.col("n2")))
    scored = near.withColumn("score", similarity("s", "s2")).where(F.col("score") >= threshold)
    either = F.array(F.struct("t", "t2"), F.struct(F.col("t2").alias("t"), F.col("t").alias("t2")))
    scored = scored.select("score", F.explode(either).alias("e")).select("e.*", "score").unionByName(t.select("t", F.col("t").alias("t2"), F.lit(100.0).alias("score")))
    best = W.partitionBy("t").orderBy(F.desc("score"), "t2")
    return scored.withColumn("__k", F.row_number().over(best)).where((F.col("__k") <= limit) & (F.col("t") != F.col("t2"))).select(F.col("t").alias("t1"), "t2", "score")


def candidate_rows(df: DataFrame, pairs: DataFrame, title: str, key: str) -> DataFrame:
    """Pairs of rows (a < b) with equal or near titles."""
    rows = df.select(F.col(key).alias("k"), F.col(title).alias("t")).where(F.col(title).isNotNull())
    same = rows.alias("x").join(rows.alias("y"), F.col("x.t") == F.col("y.t")).where("x.k < y.k").select(F.col("x.k").alias("a"), F.col("y.k").alias("b"))
    near = pairs.join(rows.select(F.col("k").alias("k1"), F.col("t").alias("t1")), "t1").join(rows.select(F.col("k").alias("k2"), F.col("t").alias("t2")), "t2")
    return same.unionByName(near.select(F.least("k1", "k2").alias("a"), F.greatest("k1", "k2").alias("b"))).distinct()


def resolve_fuzzy(df: DataFrame, title: str, author: str, key: str, title_threshold: float = 60.0, author_threshold: float = 80.0) -> DataFrame:
    """(removed, kept) keys. Confirmed pairs are taken in order (a, b); a pair with a removed row is skipped; of the others the fuller row stays, the smaller key of equals.

    Pairs are independent across connected groups, so each group of confirmed pairs is resolved in its own task.
    """
    from corpusmill.operators.cleaning import completeness

    pairs = candidate_rows(df, fuzzy_pairs(df, title, title_threshold), title, key)
    facts = df.select(F.col(key).alias("k"), F.coalesce(F.col(author).cast("string"), F.lit("")).alias("w"), completeness(df).alias("n"))
    both = pairs.join(facts.select(F.col("k").alias("a"), F.col("w").alias("wa"), F.col("n").alias("na")), "a").join(facts.select(F.col("k").alias("b"), F.col("w").alias("wb"), F.col("n").alias("nb")), "b")
    sure = both.where(similarity(sorted_tokens(F.col("wa")), sorted_tokens(F.col("wb"))) >= author_threshold).select("a", "b", "na", "nb")
    groups = connected(sure.select("a", "b"))

    def run(group: pa.Table) -> pa.Table:
        gone: dict = {}
        for a, b, na, nb in sorted(zip(*(group.column(c).to_pylist() for c in ("a", "b", "na", "nb")), strict=True)):
            if a not in gone and b not in gone:
                gone[b if na >= nb else a] = a if na >= nb else b
        kind = group.schema.field("a").type
        return pa.table([pa.array(list(gone), kind), pa.array(list(gone.values()), kind)], names=["removed", "kept"])

    kind = df.schema[key].dataType.simpleString()
    return sure.join(groups.withColumnRenamed("node", "a"), "a").groupBy("root").applyInArrow(run, f"removed {kind}, kept {kind}")


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of nodes with an edge (a, b): least labels spread and double back over each other until none changes, however many rounds that takes."""
    from corpusmill.sources.session import discard, materialize

    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("root")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("r"))
        up = labels.join(near, labels["node"] == near["a"]).select("node", F.least("root", "r").alias("root"), (F.col("r") < F.col("root")).alias("moved"))
        jump = up.alias("x").join(up.alias("y"), F.col("x.root") == F.col("y.node"), "left").select(F.col("x.node").alias("node"), F.least("x.root", F.coalesce("y.root", "x.root")).alias("root"), (F.col("x.moved") | F.coalesce(F.col("y.root") < F.col("x.root"), F.lit(False))).alias("moved"))
        now = materialize(jump)
        discard(labels)
        labels = now
        if not now.where("moved").limit(1).count():
            return now.select("node", "root")


def repeated_authors(df: DataFrame, author: str, handled: DataFrame, key: str) -> DataFrame:
    """(author, n) of authors with more than one row, rows handled elsewhere left out."""
    return df.join(handled.select(key), key, "left_anti").where(F.col(author).isNotNull()).groupBy(author).agg(F.count("*").alias("n")).where("n > 1")


# -- outlines -------------------------------------------------------------------------------------


def inline_text(c: Column) -> Column:
    """A Markdown text without its marks: images and links by their words, code and emphasis around words by what they hold, escaped characters by themselves."""
    c = F.regexp_replace(c, r"!?\[([^\[\]]*)\]\([^()\s]*\)", "$1")
    c = F.regexp_replace(c, r"`([^`]+)`", "$1")
    for mark, other in ((r"\*", "*"), ("_", "_")):
        c = F.regexp_replace(c, rf"(?U)(?<![\w{other}\\]){mark}{{1,3}}(?=[\w&&[^_]])([^{other}]*[\w.,;:!?)&&[^_]]){mark}{{1,3}}(?![\w{other}])", "$1")
    return F.regexp_replace(c, r"\\([!-/:-@\[-`{-~])", "$1")


def block_array(text: Column) -> Column:
    """The Markdown blocks of a text in order, each (kind heading|list|text, level, value); a null text has none. Fenced code, quotes and rules between parts are none of these and are left out."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?ms)^(```|~~~).*?(^\1[`~]*[ \t]*$|\z)", "\n\n")
    body = F.regexp_replace(body, r"(?m)^(#{1,6}\s.*)$", "\n$1\n")
    parts = F.filter(F.transform(F.split(body, r"\n\s*\n+"), strip), lambda p: (p != "") & ~p.rlike(r"^>|^([-*_])(\s*\1){2,}$"))

    def block(raw: Column) -> Column:
        mark = F.regexp_extract(raw, r"^(#{1,6})\s", 1)
        kind = F.when(mark != "", "heading").when(raw.rlike(r"^([-*+]|\d+[.)])\s"), "list").otherwise("text")
        items = F.array_join(F.transform(F.split(raw, r"\n"), lambda x: strip(F.regexp_replace(x, r"^\s*([-*+]|\d+[.)])\s+", ""))), " | ")
        value = F.when(kind == "heading", strip(F.regexp_replace(raw, r"^#{1,6}\s+", ""))).when(kind == "list", items).otherwise(F.regexp_replace(raw, r"\s*\n\s*", " "))
        return F.struct(kind.alias("kind"), F.length(mark).alias("level"), inline_text(value).alias("value"))

    return F.transform(parts, block)


def blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per Markdown block in order: (key, pos, kind, level, value)."""
    return df.select(key, F.posexplode(block_array(F.col(text))).alias("pos", "b")).select(key, "pos", "b.*")


def outline_steps(rows: list[dict]) -> Iterator[tuple[str, str, int]]:
    """What a text's blocks open and hold, as (chapter|section|inner|text|list_container, value, level).

    Level 1 opens a chapter; level 2 a section of it; a deeper heading goes inside the previous section,
    whatever its level (and is dropped without a chapter). Texts before any chapter go to "Introduction", a
    level-2 heading before any to "Untitled Chapter", lists before any are dropped.
    """
    inside = False
    for row in rows:
        kind, level, value = row["kind"], row["level"], row["value"]
        if kind == "heading" and level > 2 or kind == "list":
            if inside:
                yield ("list_container" if kind == "list" else "inner"), value, level
            continue
        if not inside and (kind == "text" or level == 2):
            yield "chapter", "Introduction" if kind == "text" else "Untitled Chapter", 1
        inside = True
        yield ("text" if kind == "text" else "chapter" if level == 1 else "section"), value, level


def outline(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chapter_no, chapter, section_path, type, block_no, value) of every block under its chapter and sections.

    Each row is a text of its own, taken apart where it lies, without a shuffle; a null or empty text has no rows.
    """
    kinds = [("chapter_no", pa.int32()), ("chapter", pa.string()), ("section_path", pa.list_(pa.string())), ("type", pa.string()), ("block_no", pa.int32()), ("value", pa.string())]

    def placed(rows: list[dict]) -> Iterator[tuple]:
        no, chapter, path, n = 0, None, [], 0
        counts: dict = {}
        for kind, value, _ in outline_steps(rows):
            if kind == "chapter":
                no, chapter, path = no + 1, value, []
            elif kind in ("section", "inner"):
                path = [value] if kind == "section" else [*path, value]
            else:
                n = counts[(no, *path)] = counts.get((no, *path), 0) + 1
                yield no, chapter, path, kind, n, value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, rows in enumerate(b.column(1).to_pylist()):
                found = list(placed(rows))
                if found:
                    columns = [pa.array(list(c), t) for c, (_, t) in zip(zip(*found, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * len(found), b.schema.field(0).type), *columns], names=[key, *[n for n, _ in kinds]])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, block_array(F.col(text)).alias("__b")).mapInArrow(run, f"`{key}` {kind}, chapter_no int, chapter string, section_path array<string>, type string, block_no int, value string")


def tree_json(rows: list[dict]) -> tuple[str, str]:
    """Title (that of the first chapter) and tree of one text's blocks, written as they come, so that sections may lie thousands deep."""
    quoted = lambda x: json.dumps(x, ensure_ascii=False)
    title, out, deep, first = None, [], 0, True
    for kind, value, level in outline_steps(rows):
        keep = {"chapter": 0, "section": 1}.get(kind, deep)
        if keep < deep:
            out.append("]}" * (deep - keep))
            deep, first = keep, False
        out.append("" if first else ", ")
        if kind in ("chapter", "section", "inner"):
            title = value if title is None else title
            level = "" if kind == "chapter" else f'"level": {level}, '
            out.append(f'{{"type": "{"chapter" if kind == "chapter" else "section"}", "title": {quoted(value)}, {level}"content": [')
            deep, first = deep + 1, True
        else:
            out.append(f'{{"type": "{kind}", "value": {quoted(value)}}}')
            first = False
    title = "Extracted Document" if title is None else title
    return title, f'{{"title": {quoted(title)}, "chapters": [{"".join(out)}{"]}" * deep}]}}'


def outline_trees(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, title, tree) with each text's chapters, sections and blocks as nested JSON; a text without any is titled "Extracted Document"."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            trees = [tree_json(rows) for rows in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in trees], pa.string()), pa.array([t for _, t in trees], pa.string())], names=[key, "title", "tree"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, block_array(F.col(text)).alias("__b")).mapInArrow(run, f"`{key}` {kind}, title string, tree string")


# -- pages ----------------------------------------------------------------------------------------


def page_facts(html: Column) -> dict[str, Column]:
    """S14 in expressions: first h1, title, lang and the number of distinct links."""
    tag = lambda name: strip(F.regexp_extract(html, rf"(?is)<{name}[^>]*>(.*?)</{name}>", 1))
    hrefs = F.regexp_extract_all(html, F.lit(r'href="([^"]+)"'), F.lit(1))
    return {"h1": tag("h1"), "title": tag("title"), "lang": F.regexp_extract(html, r'<html[^>]*lang="([^"]*)"', 1), "n_links": F.size(F.array_distinct(hrefs)).cast("long")}


class _Divs(HTMLParser):
    """Texts by class of the elements that carry it."""

    VOID = {"br", "img", "hr", "meta", "link", "input"}

    def __init__(self, wanted: set[str]) -> None:
        super().__init__()
        self.wanted, self.open, self.found = wanted, [], {}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in self.VOID:
            self.open.append((tag, set((dict(attrs).get("class") or "").split()) & self.wanted))

    def handle_endtag(self, tag: str) -> None:
        while self.open and any(t == tag for t, _ in self.open) and self.open.pop()[0] != tag:
            pass

    def handle_data(self, data: str) -> None:
        for _, names in self.open:
            for n in names:
                self.found.setdefault(n, []).append(data)


def class_texts(html: Column, wanted: tuple[str, ...]) -> Column:
    """A map from class to the text inside elements of that class, for pages that expressions can't take apart."""

    @F.pandas_udf("map<string,string>")
    def run(pages: pd.Series) -> pd.Series:
        def one(page: str | None) -> dict[str, str]:
            p = _Divs(set(wanted))
            p.feed(page or "")
            return {k: " ".join(" ".join(v).split()) for k, v in p.found.items()}

        return pages.map(one)

    return run(html)


