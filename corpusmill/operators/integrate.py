"""Source integration: nested projections, language choice, set compares, audits of documents against stores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Language tags taken for Dutch at integration.
DUTCH = ("nl", "dut", "nld")


# -- nested projections ---------------------------------------------------------------------------


def author_names(authors: Column) -> Column:
    """P11: "first last", else the plain name; empty ones go; null is an empty list."""
    full = lambda a: F.nullif(F.trim(F.concat(F.coalesce(a["first_name"], F.lit("")), F.lit(" "), F.coalesce(a["last_name"], F.lit("")))), F.lit(""))
    names = F.transform(authors, lambda a: F.coalesce(full(a), F.trim(a["name"])))
    return F.coalesce(F.filter(names, lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def person_list(first: Column, last: Column) -> Column:
    """P10: a one-element list of the full name."""
    return F.array(F.concat_ws(" ", first, last))


def first_affiliation(affiliations: Column) -> Column:
    return F.get(affiliations, F.lit(0))["name"]


def open_link(files: Column) -> Column:
    """Url of the first file that is open and a full text."""
    return F.get(F.filter(files, lambda f: (f["access"] == "open") & (f["kind"] == "fullText")), F.lit(0))["url"]


def has_language(languages: Column, wanted: tuple[str, ...] = DUTCH) -> Column:
    """Some tag is wanted, in any case."""
    return F.coalesce(F.exists(languages, lambda x: F.lower(x).isin(*wanted)), F.lit(False))


def best_text(items: Column, generic: Column, detect, wanted: tuple[str, ...] = DUTCH, least: int = 100) -> Column:
    """(text, lang): the first item in a wanted language, else the generic text if long enough, with the language that ``detect`` finds in its first 500 characters."""
    own = F.get(F.filter(items, lambda i: F.coalesce(F.lower(i["lang"]).isin(*wanted), F.lit(False))), F.lit(0))["text"]
    other = F.when(F.length(generic) > least, generic)
    return F.when(own.isNotNull(), F.struct(own.alias("text"), F.lit("nl").alias("lang"))).otherwise(F.struct(other.alias("text"), detect(F.substring(other, 1, 500)).alias("lang")))


def keep_mask(wanted: Column, link: Column, text_lang: Column) -> Column:
    """Metadata in the language with an open file, or a text in it."""
    return (wanted & link.isNotNull()) | F.coalesce(text_lang.isin(*DUTCH), F.lit(False))


def explode_texts(df: DataFrame, items: str, lang: str, least: int = 100) -> DataFrame:
    """A row per nested item of the language, long enough and not blank; other columns stay."""
    rows = df.withColumn("__i", F.explode(items))
    return rows.where((F.col("__i.lang") == lang) & (F.length("__i.text") >= least) & (F.trim("__i.text") != "")).withColumn("item_text", F.col("__i.text")).drop("__i")


# -- unions and set compares ----------------------------------------------------------------------


def union_sources(*frames: DataFrame) -> DataFrame:
    """Union by name, missing columns null; types that differ are an error to be cast beforehand."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def membership(df: DataFrame, ids: DataFrame, key: str, flag: str) -> DataFrame:
    """Whether the key is in ``ids``; null keys aren't."""
    marks = ids.select(F.col(key)).where(F.col(key).isNotNull()).distinct().withColumn(flag, F.lit(True))
    return df.join(marks, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def audit(df: DataFrame, stores: dict[str, DataFrame], key: str) -> DataFrame:
    """Every key of the table or of any store once, with a flag per store; all flags come from one shuffle by key."""
    parts = [df.select(key, F.lit("in_metadata").alias("__s"))] + [s.select(key, F.lit(name).alias("__s")) for name, s in stores.items()]
    rows = reduce(DataFrame.unionByName, parts).where(F.col(key).isNotNull())
    return rows.groupBy(key).agg(*[F.max(F.col("__s") == name).alias(name) for name in ("in_metadata", *stores)])


def pending(staged: DataFrame, completed: DataFrame, ignored: list, key: str) -> DataFrame:
    """Staged keys that are neither completed nor on the short ignore list."""
    return staged.where(~F.col(key).isin(*ignored)).join(completed.select(key).distinct(), key, "left_anti")


def prune(store: DataFrame, valid: DataFrame, key: str) -> DataFrame:
    """Members whose key is valid."""
    return store.join(valid.select(key).distinct(), key, "left_semi")


def sync_flag(df: DataFrame, present: DataFrame, key: str, flag: str) -> DataFrame:
    """Set the flag where the key is in the store."""
    seen = membership(df, present, key, "__seen")
    return seen.withColumn(flag, F.when(F.col("__seen"), True).otherwise(F.col(flag))).drop("__seen")


def integrity(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(matches, missing, extra) of two key sets."""
    both = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    per = both.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return per.agg(count((F.col("l") == 1) & (F.col("r") == 1)).alias("matches"), count(F.col("r") == 0).alias("missing"), count(F.col("l") == 0).alias("extra"))


def valid_folders(files: DataFrame) -> DataFrame:
    """Folders with at least one md and one json file."""
    return files.groupBy("folder").agg(F.bool_or(F.col("ext") == "md").alias("md"), F.bool_or(F.col("ext") == "json").alias("json")).where("md AND json").select("folder")


def folder_gaps(stems: DataFrame, files: DataFrame) -> DataFrame:
    """Stems without a valid folder, EMPTY where a folder is there and MISSING where none is."""
    known = files.select(F.col("folder").alias("stem")).distinct().withColumn("__there", F.lit(True))
    lost = stems.select("stem").distinct().join(valid_folders(files).withColumnRenamed("folder", "stem"), "stem", "left_anti")
    return lost.join(known, "stem", "left").select("stem", F.when(F.col("__there"), "EMPTY").otherwise("MISSING").alias("problem"))


def compare_meta(members: DataFrame) -> DataFrame:
    """Files ``x_meta.json`` whose bytes differ from ``x.json``, or that have none; (name, content) in, (name, other) out."""
    metas = members.where(F.col("name").rlike(r"_meta\.json$")).withColumn("other", F.regexp_replace("name", r"_meta(?=\.json$)", ""))
    plain = members.select(F.col("name").alias("other"), F.md5("content").alias("__right"))
    return metas.join(plain, "other", "left").where(F.col("__right").isNull() | (F.md5("content") != F.col("__right"))).select("name", "other")


def insert_new(df: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Append the found keys that the table lacks, other columns null."""
    fresh = found.select(key).distinct().join(df.select(key), key, "left_anti")
    return df.unionByName(fresh, allowMissingColumns=True)


def update_non_null(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Columns of ``changes`` overwrite where they aren't null; one row of changes per key."""
    names = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"__new_{c}") for c in names])
    out = df.join(new, key, "left")
    return out.withColumns({c: F.coalesce(F.col(f"__new_{c}"), F.col(c)) for c in names}).select(*df.columns)


def downloadable(df: DataFrame) -> DataFrame:
    """P20: a link, and not known to be downloaded."""
    return df.where(F.col("download_link").isNotNull() & ~F.col("downloaded").eqNullSafe(True))


def incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a missing essential value."""
    return df.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))
