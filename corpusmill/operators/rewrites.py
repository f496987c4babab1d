"""Rewrite tasks: what is pending against a checkpoint, generation with an injected rewriter, validation, and the ways checkpoints are merged.

Rewrites are kept long (id, kind, model, position, text); they become list columns only on export.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import bound, normalize_text, strip, tag_targets, targets

#: What is stored where no attempt passes; order of kinds.
FAILED = "FAILED_VALIDATION"
KIND_ORDER = {"sentence": 0, "full_abstract": 1, "percentage": 2}


# -- tasks ----------------------------------------------------------------------------------------


def sentence_tasks(df: DataFrame, key: str, sentences: str) -> DataFrame:
    """T5: (key, sent_idx, text), one row per sentence."""
    return df.select(key, F.posexplode(sentences).alias("sent_idx", "text"))


def tag_count(n: Column, share: Column) -> Column:
    """Share of n, rounded half to even, at least 1."""
    return F.greatest(F.lit(1), F.bround(n * (share / F.lit(100.0))).cast("int"))


def tagged_by_hash(key: Column, share: Column, sentences: Column) -> Column:
    """As many positions as ``tag_count``, those of least MD5 of key, share and position; in order."""
    places = F.sequence(F.lit(0), F.size(sentences) - 1)
    keyed = F.transform(places, lambda i: F.struct(F.md5(F.concat_ws("|", key.cast("string"), share.cast("string"), i.cast("string")).cast("binary")).alias("h"), i.alias("i")))
    return F.array_sort(F.transform(F.slice(F.array_sort(keyed), F.lit(1), tag_count(F.size(sentences), share)), lambda x: x["i"]))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def tagged_by_seed(key: pd.Series, share: pd.Series, n: pd.Series) -> pd.Series:
    """U4: the positions that a generator seeded with CRC-32 of ``key_share`` samples, in order."""

    def one(k: str, p: int, size: int) -> list[int]:
        r = random.Random(zlib.crc32(f"{k}_{p}".encode()))
        return sorted(r.sample(range(size), max(1, round(size * (p / 100.0)))))

    return pd.Series([one(*x) for x in zip(key, share, n, strict=True)])


def all_tasks(df: DataFrame, key: str, text: str, sentences: str, models: list[str], shares: tuple[int, ...] = (25, 50, 75)) -> DataFrame:
    """Every (row, model) with its sentences, shares and full text as tasks. Models and shares are short lists, expanded in place; rows without text or sentences have none."""
    rows = df.where((strip(F.coalesce(F.col(text), F.lit(""))) != "") & (F.size(sentences) > 0))
    rows = rows.select(F.col(key).cast("string").alias("id"), F.col(text).alias("__text"), F.col(sentences).alias("__sents"), F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    task = lambda kind, idx, share, body, tagged: F.struct(F.lit(kind).alias("type"), idx.cast("int").alias("sent_idx"), share.cast("int").alias("percentage"), body.alias("text"), tagged.cast("array<int>").alias("tagged"))
    none = F.lit(None)
    singles = F.transform("__sents", lambda s, i: task("sentence", i, none, s, none))
    parts = F.transform(F.array(*[F.lit(p) for p in shares]), lambda p: bound(tagged_by_hash(F.col("id"), p, F.col("__sents")), lambda tagged: task("percentage", none, p, tag_targets(F.col("__sents"), tagged), tagged)))
    full = F.array(task("full_abstract", none, none, F.col("__text"), none))
    return rows.select("id", "model", F.explode(F.concat(singles, parts, full)).alias("t")).select("id", "model", "t.*")


TASK_KEY = ["id", "model", "type", "sent_idx", "percentage"]


def pending_tasks(tasks: DataFrame, done: DataFrame) -> DataFrame:
    """Tasks without a result. A sentence with any result is done; of the other kinds an empty result counts as none."""
    usable = done.where((F.col("type") == "sentence") | (F.coalesce(F.col("rewritten"), F.lit("")) != ""))
    # No position is -1, so that the join keys are plain.
    fill = lambda df: df.withColumn("__i", F.coalesce("sent_idx", F.lit(-1))).withColumn("__p", F.coalesce("percentage", F.lit(-1)))
    keys = ["id", "model", "type", "__i", "__p"]
    return fill(tasks).join(fill(usable).select(*keys).distinct(), keys, "left_anti").drop("__i", "__p")


def order_tasks(tasks: DataFrame, models: list[str]) -> DataFrame:
    """L1: by model as listed, then kind, then id and position."""
    rank = F.coalesce(*[F.when(F.col("model") == m, i) for i, m in enumerate(models)], F.lit(99))
    kind = F.coalesce(*[F.when(F.col("type") == k, i) for k, i in KIND_ORDER.items()], F.lit(99))
    return tasks.orderBy(rank, kind, "id", "sent_idx", "percentage")


def first_per_kind(tasks: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` tasks of each model, kind and share."""
    w = W.partitionBy("model", "type", "percentage").orderBy("id", "sent_idx")
    return tasks.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


# -- validation -----------------------------------------------------------------------------------


def stitch(sentences: Column, tagged: Column, found: Column) -> Column:
    """The sentences with the tagged ones replaced by the texts found, joined by spaces; what else a reply says is discarded."""
    order = F.array_sort(tagged)
    return F.array_join(F.transform(sentences, lambda s, i: F.when(F.array_contains(order, i), strip(F.get(found, (F.array_position(order, i) - 1).cast("int")))).otherwise(s)), " ")


def validate(sentences: Column, tagged: Column, reply: Column) -> Column:
    """(reason, stitched): empty, tag_count, empty_target, unchanged_target or success."""
    given = F.struct(sentences.alias("sentences"), F.array_sort(tagged).alias("tagged"), reply.alias("reply"), targets(reply).alias("found"))
    return bound(given, lambda g: _judged(g["sentences"], g["tagged"], g["reply"], g["found"]))


def _judged(sentences: Column, tagged: Column, reply: Column, found: Column) -> Column:
    order = tagged
    pair = F.transform(order, lambda i: F.struct(F.get(sentences, i).alias("was"), F.get(found, (F.array_position(order, i) - 1).cast("int")).alias("now")))
    bad = F.filter(F.transform(pair, lambda p: F.when(strip(p["now"]) == "", "empty_target").when(normalize_text(p["now"]) == normalize_text(p["was"]), "unchanged_target")), lambda r: r.isNotNull())
    reason = F.when(F.coalesce(reply, F.lit("")) == "", "empty").when(F.size(found) != F.size(tagged), "tag_count").when(F.size(bad) > 0, F.get(bad, F.lit(0))).otherwise("success")
    return F.struct(reason.alias("reason"), F.when(reason == "success", stitch(sentences, tagged, found)).alias("stitched"))


# -- generation -----------------------------------------------------------------------------------

Rewriter = Callable[[str, str, str, int], str]


def generate(tasks: DataFrame, rewrite: Rewriter, prompts: dict[str, str], attempts: int = 3, seed: int = 42) -> DataFrame:
    """Tasks with rewritten, status (ok, failed, error) and attempts.

    Tasks are dealt by model, so that a worker loads each model once, and by id within it. ``rewrite(prompt,
    text, model, seed)`` is called up to ``attempts`` times with rising seeds; a reply is taken if it differs
    from the text, or if it is equal and the text short. Errors become a row's status.
    """
    names = tasks.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for text, kind, model in zip(frame["text"], frame["type"], frame["model"], strict=True):
                short = len((text or "").split()) <= 6 or len((text or "").strip()) <= 40
                state = (FAILED, "failed", attempts)
                for n in range(attempts):
                    try:
                        reply = rewrite(prompts.get(kind, ""), text, model, seed + n)
                    except Exception as e:
                        state = (str(e), "error", n + 1)
                        continue
                    if reply and reply.strip() and (reply.strip() != (text or "").strip() or short):
                        state = (reply, "ok", n + 1)
                        break
                out.append(state)
            yield frame.assign(rewritten=[s[0] for s in out], status=[s[1] for s in out], attempts=[s[2] for s in out])[[*names, "rewritten", "status", "attempts"]]

    dealt = tasks.repartition("model", "id").sortWithinPartitions("model", "id")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tasks.schema)
    return dealt.mapInPandas(run, f"{fields}, rewritten string, status string, attempts int")


def generate_pending(tasks: DataFrame, done: DataFrame, rewrite: Rewriter, prompts: dict[str, str], kinds: tuple[str, ...] = (), debug: int | None = None, attempts: int = 3, seed: int = 42) -> DataFrame:
    """Results of the tasks without one, of some kinds only if ``kinds`` are given, and of each model, kind and share the first ``debug`` only if that is (a trial run)."""
    due = pending_tasks(tasks, done)
    due = due.where(F.col("type").isin(*kinds)) if kinds else due
    return generate(due if debug is None else first_per_kind(due, debug), rewrite, prompts, attempts, seed)


def swap_case(prompt: str, text: str, model: str, seed: int) -> str:
    """A rewriter for tests and offline use."""
    return (text or "").swapcase()


# -- checkpoints ----------------------------------------------------------------------------------


def align(checkpoint: DataFrame, sentences: DataFrame) -> DataFrame:
    """Checkpoint rows with sent_idx of the first sentence of that id with the same trimmed text, and ``found``: matched, text_missing, id_missing."""
    first = sentences.groupBy(F.col("id").cast("string").alias("id"), strip(F.col("text")).alias("__t")).agg(F.min("sent_idx").alias("__i"))
    ids = sentences.select(F.col("id").cast("string").alias("id")).distinct().withColumn("__there", F.lit(True))
    out = checkpoint.withColumn("__t", strip(F.col("text"))).join(first, ["id", "__t"], "left").join(ids, "id", "left")
    return out.withColumn("sent_idx", F.col("__i")).withColumn("found", F.when(F.col("__i").isNotNull(), "matched").when(F.col("__there"), "text_missing").otherwise("id_missing")).drop("__i", "__t", "__there")


def align_report(aligned: DataFrame) -> DataFrame:
    """One row with all counts of ``align`` over the rows of ``parse_checkpoint``: loaded (parsed), matched sentences, other (results that need no sentence), unmatched (no result, or a sentence that isn't there), id_missing, corrupt and blank. An older line counts once for each of its models."""
    ok, sentence, there = F.col("status") == "ok", F.col("type") == "sentence", F.col("found") != "id_missing"
    result = ok & F.col("rewritten").isNotNull()
    lost = ok & (F.col("rewritten").isNull() | there & sentence & (F.col("found") != "matched"))
    counts = {"loaded": ok, "matched": result & sentence & (F.col("found") == "matched"), "other": result & ~sentence & there, "unmatched": lost, "id_missing": result & ~there, "corrupt": F.col("status") == "corrupt", "blank": F.col("status") == "blank"}
    return aligned.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in counts.items()])


def older_pending(tasks: DataFrame, records: DataFrame, models: list[str]) -> DataFrame:
    """(id, sent_idx, text) tasks times ``models`` without a record of that id, text and model; a record's result may be null, one without text doesn't count."""
    done = records.where((F.coalesce(F.col("text"), F.lit("")) != "") & F.col("model").isin(*models)).select(F.col("id").cast("string").alias("__id"), F.col("text").alias("__text"), F.col("model").alias("__model")).distinct()
    due = tasks.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    return due.join(done, (F.col("id").cast("string") == F.col("__id")) & (F.col("text") == F.col("__text")) & (F.col("model") == F.col("__model")), "left_anti")


def older_lines(results: DataFrame) -> DataFrame:
    """Results as checkpoint lines of the older form, {id, sent_idx, text, <model>: rewritten}."""
    head = F.to_json(F.struct("id", "sent_idx", "text"), {"ignoreNullFields": "false"})
    return results.select(F.concat(F.regexp_replace(head, r"\}$", ","), F.regexp_replace(F.to_json(F.create_map("model", "rewritten"), {"ignoreNullFields": "false"}), r"^\{", "")).alias("value"))


def fill_missing(master: DataFrame, active: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """master's rows, and the first active row (by ``order``) of every key that master lacks; a null value in master counts as there."""
    own = master.groupBy(*keys).agg(F.min_by(F.struct(value), order).alias("m"))
    new = active.groupBy(*keys).agg(F.min_by(F.struct(value), order).alias("n"))
    return own.join(new, keys, "full_outer").select(*keys, F.when(F.col("m").isNotNull(), F.col(f"m.{value}")).otherwise(F.col(f"n.{value}")).alias(value))


def last_wins(parts: list[DataFrame], keys: list[str], value: str, order: str, tasks: DataFrame | None = None, skip_null: bool = False) -> DataFrame:
    """J15 (a later null overwrites) and J16 (``skip_null``): the last value of each key, later parts over earlier ones, kept if among the current tasks."""
    rows = parts[0].select(*keys, value, order).withColumn("__s", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        rows = rows.unionByName(p.select(*keys, value, order).withColumn("__s", F.lit(i)))
    if skip_null:
        rows = rows.where(F.col(value).isNotNull())
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(value), F.struct("__s", order)).alias("b")).select(*keys, f"b.{value}")
    return best if tasks is None else best.join(tasks.select(*keys).distinct(), keys, "left_semi")


def scatter(df: DataFrame, key: str, sentences: str, merged: DataFrame, value: str) -> DataFrame:
    """(key, model, values), each a list as long as the sentences with every equal sentence filled. ``merged``: id, text, model, value."""
    places = df.select(F.col(key).cast("string").alias("id"), F.posexplode(sentences).alias("pos", "__t"))
    hits = places.withColumn("__t", strip(F.col("__t"))).join(merged.select("id", "model", strip(F.col("text")).alias("__t"), value), ["id", "__t"])
    slots = hits.groupBy("id", "model").agg(F.map_from_entries(F.collect_list(F.struct("pos", value))).alias("__m"))
    sizes = df.select(F.col(key).cast("string").alias("id"), F.size(sentences).alias("__n"))
    return slots.join(sizes, "id").select("id", "model", F.transform(F.sequence(F.lit(0), F.col("__n") - 1), lambda i: F.try_element_at("__m", i)).alias("values"))


def to_wide(rewrites: DataFrame) -> DataFrame:
    """(id, model, single array, full, p25...) as one row per id and model; the last of repeated results by ``ord``."""
    last = rewrites.groupBy("id", "model", "type", "sent_idx", "percentage").agg(F.max_by("rewritten", "ord").alias("rewritten"))
    single = F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == "sentence", F.struct("sent_idx", "rewritten")))), lambda x: x["rewritten"])
    part = lambda p: F.max(F.when((F.col("type") == "percentage") & (F.col("percentage") == p), F.col("rewritten")))
    return last.groupBy("id", "model").agg(single.alias("single"), F.max(F.when(F.col("type") == "full_abstract", F.col("rewritten"))).alias("full_text"), *[part(p).alias(f"p{p}") for p in (25, 50, 75)])
