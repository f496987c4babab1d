"""Operator 7: mixing sources to target weights by pivotal dependent rounding. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.llm.common import broadcast_within, count_words, materialize, table, unit_hash

#: What the fold carries: the document whose fraction is open, and those settled, one per step.
ITEM = "struct<id:bigint,size:bigint,part:double,tie:bigint>"
DONE = "struct<id:bigint,size:bigint,extra:int,tie:bigint>"


def source_targets(sizes: DataFrame, source: str, weights: list[int], share: float, ceiling: float) -> DataFrame:
    """``sizes``: one row per source with source_size. Adds target: ``share`` of all sizes by weight, never over ``ceiling`` times the source's size, the excess reshared by weight until none is above.

    One row per source passes through the ordering windows, never documents.
    """
    order = W.orderBy(F.col(source).asc_nulls_last())
    n = F.row_number().over(order) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), n % len(weights))
    df = sizes.withColumn("weight", weight).withColumn("most", ceiling * F.col("source_size"))
    everything = W.partitionBy()
    df = df.withColumn("goal", share * F.sum("source_size").over(everything))
    # Sources fill up in the order of most / weight; before the k-th, `filled` is used and `open` weight shares the rest.
    fill = W.orderBy(F.col("most") / F.col("weight"), F.col(source).asc_nulls_last())
    df = df.withColumn("filled", F.sum("most").over(fill.rowsBetween(W.unboundedPreceding, -1)))
    df = df.withColumn("open", F.sum("weight").over(fill.rowsBetween(0, W.unboundedFollowing)))
    df = df.withColumn("level", (F.col("goal") - F.coalesce("filled", F.lit(0.0))) / F.col("open"))
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), "level"))).over(everything)["level"]
    return df.select(source, "source_size", F.least(F.col("most"), F.coalesce(level * F.col("weight"), F.col("most"))).alias("target"))


def settle(items: Column, seed: int) -> Column:
    """Pivotal fold over an array of ITEM: pairs the open document with the next one and moves words between them, at random, until one fraction is 0 or 1. Returns (open, done); size * fraction sums are kept exactly."""

    def meet(acc: Column, x: Column) -> Column:
        a = acc["open"]
        # up: a gains what x gives, in words; down: the other way round.
        up = F.least(a["size"] * (1 - a["part"]), x["size"] * x["part"])
        down = F.least(a["size"] * a["part"], x["size"] * (1 - x["part"]))
        move = F.when(unit_hash(F.lit(seed), a["id"], a["tie"], x["id"], x["tie"]) * (up + down) < down, up).otherwise(-down)
        pa, px = a["part"] + move / a["size"], x["part"] - move / x["size"]
        # The one nearest to an integer is settled; rounding repairs the last bit.
        gap = lambda p: F.least(F.abs(p), F.abs(1 - p))
        a_done = gap(pa) <= gap(px)
        whole = lambda y, p: F.struct(y["id"].alias("id"), y["size"].alias("size"), F.round(p).cast("int").alias("extra"), y["tie"].alias("tie"))
        done = F.when(a_done, whole(a, pa)).otherwise(whole(x, px))
        rest = lambda y, p: F.struct(y["id"].alias("id"), y["size"].alias("size"), F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)).alias("part"), y["tie"].alias("tie"))
        left = F.when(a_done, rest(x, px)).otherwise(rest(a, pa))
        return F.struct(left.alias("open"), F.concat(acc["done"], F.array(done)).alias("done"))

    start = F.struct(F.get(items, F.lit(0)).cast(ITEM).alias("open"), F.array().cast(f"array<{DONE}>").alias("done"))
    return F.aggregate(F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0))), start, meet)


def finish(fold: Column, seed: int) -> Column:
    """Settle a source's last open document by a seeded draw, and repay the words this adds or lacks by turning over settled documents of its chunk that fit, in random order (by a seeded hash, so that no size is favoured).

    What is left over is less than every document of the chunk that could still be turned. Returns an array of DONE.
    """
    a = fold["open"]
    taken = (unit_hash(F.lit(seed), a["id"], a["tie"]) < a["part"]).cast("int")
    last = F.struct(a["id"].alias("id"), a["size"].alias("size"), taken.alias("extra"), a["tie"].alias("tie"))

    def repay(acc: Column, x: Column) -> Column:
        fits = ((acc["debt"] > 0) & (x["extra"] == 1) & (x["size"] <= acc["debt"])) | ((acc["debt"] < 0) & (x["extra"] == 0) & (x["size"] <= -acc["debt"]))
        turned = F.struct(x["id"].alias("id"), x["size"].alias("size"), F.when(fits, 1 - x["extra"]).otherwise(x["extra"]).alias("extra"), x["tie"].alias("tie"))
        debt = F.when(~fits, acc["debt"]).otherwise(acc["debt"] - F.signum(acc["debt"]) * x["size"])
        return F.struct(debt.alias("debt"), F.concat(acc["out"], F.array(turned)).alias("out"))

    start = F.struct(((taken - a["part"]) * a["size"]).alias("debt"), F.array(last).cast(f"array<{DONE}>").alias("out"))
    drawn = F.transform(fold["done"], lambda x: F.struct(unit_hash(F.lit(seed + 1), x["id"], x["tie"]).alias("at"), x.alias("x")))
    shuffled = F.transform(F.array_sort(drawn), lambda d: d["x"])
    return F.aggregate(shuffled, start, repay, lambda acc: acc["out"])


def by_size(a: Column, b: Column) -> Column:
    """Order for array_sort: large documents first, then id and tie, null ids last."""
    sign = lambda x, y: F.when(x < y, -1).when(x > y, 1).otherwise(0)
    ids = F.when(a["id"].isNull() & b["id"].isNull(), 0).when(a["id"].isNull(), 1).when(b["id"].isNull(), -1).otherwise(sign(a["id"], b["id"]))
    return F.when(a["size"] != b["size"], sign(b["size"], a["size"])).when(ids != 0, ids).otherwise(sign(a["tie"], b["tie"]))


def mix_sources(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0, seed: int = 7, chunk: int = 256, max_broadcast_sources: int = 10_000, carry: list[str] | None = None) -> DataFrame:
    """``key``, ``source`` (or the columns ``carry``), size, source_size, target, copies, taken (copies * size) for every row of ``docs``.

    Each document of a source is to be copied target / source_size times: the whole part is fixed, the
    fraction is rounded by the pivotal method, which keeps the source's expected words but for one open
    document. Rows are dealt into chunks of about ``chunk`` by a hash, each folded on its own; the open
    documents of ``chunk`` chunks meet in the next level, until one per source is left, which ``finish``
    settles. A hot source only has more chunks. Null text has size 0 and takes nothing; a null source comes
    last and is a source of its own; null or repeated keys are told apart by a hash of the row, equal rows
    by their number. Very long texts are counted whole, each in its row. Columns of ``docs`` named like a
    result, unless carried, are ignored. An empty table gives no rows. The same input gives the same mix.
    """
    keep = [key, source] if carry is None else carry
    measured = [F.col(key).alias("__id"), F.col(source).alias("__source"), count_words(F.col(text)).alias("__size"), F.xxhash64(F.col(text)).alias("__tie")]
    narrow = docs.select(*measured)
    rows = materialize(narrow)
    targets = source_targets(rows.groupBy("__source").agg(F.sum("__size").alias("source_size")), "__source", list(weights), share, ceiling)
    counts = rows.where(F.col("__size") > 0).groupBy("__source").agg(F.count("*").alias("n"))
    plan = materialize(targets.alias("t").join(counts.alias("c"), F.col("t.__source").eqNullSafe(F.col("c.__source")), "left").select(F.col("t.__source").alias("__s"), "source_size", "target", F.coalesce("n", F.lit(0)).alias("n")))
    most = plan.agg(F.max("n")).first()[0] or 0
    plan = broadcast_within(plan.select("__s", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("n").alias("__chunks")), max_broadcast_sources)

    def place(df: DataFrame) -> DataFrame:
        rate = F.when(F.col("__size") > 0, F.col("__target") / F.col("__source_size")).otherwise(0.0)
        df = df.join(plan, F.col("__source").eqNullSafe(F.col("__s")))
        return df.withColumn("__whole", F.floor(rate).cast("int")).withColumn("__part", rate - F.floor(rate))

    # Equal rows share id and tie: they are one item with their number, counted out again below.
    item = F.struct(F.col("__id").alias("id"), F.col("__size").alias("size"), F.col("__part").alias("part"), F.col("__tie").alias("tie"))
    open_rows = place(rows).where(F.col("__part") > 0).select("__source", item.alias("item"), F.pmod(F.xxhash64("__id", "__tie"), F.greatest(F.ceil(F.col("__chunks") / chunk), F.lit(1))).alias("slot"))
    settled, left, slots = [], open_rows, most
    while True:
        slots = -(-slots // chunk)
        folded = left.groupBy("__source", "slot").agg(F.array_sort(F.collect_list("item"), by_size).alias("items")).select("__source", "slot", settle(F.col("items"), seed).alias("fold"))
        folded = materialize(folded)
        settled.append(folded.select("__source", F.explode("fold.done" if slots > 1 else finish(F.col("fold"), seed)).alias("d")))
        if slots <= 1:
            break
        left = folded.select("__source", F.col("fold.open").alias("item"), F.floor(F.col("slot") / chunk).alias("slot"))
    decided = reduce(DataFrame.unionByName, settled)
    extras = decided.groupBy("__source", F.col("d.id").alias("__id"), F.col("d.tie").alias("__tie")).agg(F.sum("d.extra").alias("extra"))
    # Nulls are equal here: rows meet on stand-ins that can't be null on either side (else a cast would come
    # between and the numbering shuffle again), by which they are numbered too, in one shuffle.
    stand_in = F.struct(F.coalesce(F.col("__id"), F.lit(0)).alias("a"), F.col("__id").isNull().alias("b"), F.coalesce(F.col("__source"), F.lit("")).alias("c"), F.col("__source").isNull().alias("d"), F.coalesce("__tie", F.lit(0)).alias("e"))
    wide = rows.withColumns({key: F.col("__id"), source: F.col("__source")}) if carry is None else docs.select(*carry, *measured)
    numbered = place(wide).withColumn("__row", stand_in)
    joined = numbered.join(extras.select(stand_in.alias("__row"), F.col("extra").alias("__extra")), "__row", "left")
    joined = joined.withColumn("__n", F.row_number().over(W.partitionBy("__row").orderBy("__row")))
    copies = (F.col("__whole") + (F.col("__n") <= F.coalesce("__extra", F.lit(0))).cast("int")).cast("long")
    return joined.select(*keep, F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), copies.alias("copies"), (copies * F.col("__size")).alias("taken"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix of all ``documents``."""
    out = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", "taken")
