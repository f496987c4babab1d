"""Schema inference and enforcement, column cleaning, profiles and exact duplicates.

Every report is a DataFrame; column-wise reports come from one aggregate over all columns, unpivoted.
"""

from __future__ import annotations

import ast
import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import PLACEHOLDER, is_placeholder, strip

_MISSING = re.compile(PLACEHOLDER)
NESTED = (T.ArrayType, T.MapType, T.StructType)
#: Words for true and false.
TRUE, FALSE = ("y", "yes", "t", "true", "1", "on"), ("n", "no", "f", "false", "0", "off")
#: Type names of the schema language.
TYPES = ("string", "bool", "int", "float", "number", "date", "datetime", "list", "dict")


def name_of(c: str) -> str:
    return re.sub(r"[^a-z0-9_]", "", re.sub(r"\s+", "_", c.strip().lower()))


def clean_column_names(df: DataFrame) -> DataFrame:
    """Lower-case names of letters, digits and ``_``; names that would meet are an error."""
    names = [name_of(c) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"names would clash: {sorted(n for n in names if names.count(n) > 1)}")
    return df.toDF(*names)


def nested_columns(df: DataFrame) -> list[str]:
    """Columns that can't be compared as scalars."""
    return [f.name for f in df.schema if isinstance(f.dataType, NESTED)]


def unpivot(df: DataFrame, fields: dict[str, list[Column]], names: list[str], types: list[str]) -> DataFrame:
    """One row per entry of ``fields`` from a one-row frame: column, then its values under ``names``."""
    rows = [F.struct(F.lit(c).alias("column"), *[v.cast(t).alias(n) for v, n, t in zip(vs, names, types, strict=True)]) for c, vs in fields.items()]
    return df.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# -- literals and nested values -------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def literal_to_json(values: pd.Series) -> pd.Series:
    """A Python literal as JSON (sets and tuples as arrays); null where it isn't one."""

    def one(v: str | None) -> str | None:
        try:
            return json.dumps(ast.literal_eval(v), default=lambda x: sorted(x, key=repr), ensure_ascii=False)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None

    return values.map(one)


@F.pandas_udf(T.StringType())
def pruned_literal(values: pd.Series) -> pd.Series:
    """A Python literal as JSON without its missing values, at any depth (a number among them counts by its text); null where it isn't a literal or nothing is left."""

    def prune(v):
        if isinstance(v, (set, frozenset)):
            v = sorted(v, key=repr)
        if isinstance(v, (list, tuple)):
            items = [prune(x) for x in v]
            return items if any(x is not None for x in items) else None
        if isinstance(v, dict):
            return {k: x for k, x in ((k, prune(x)) for k, x in v.items()) if x is not None} or None
        return None if v is None or not str(v).strip() or _MISSING.match(str(v).strip().lower()) else v

    def one(v: str | None) -> str | None:
        try:
            found = prune(ast.literal_eval(v))
            return None if found is None else json.dumps(found, default=str, ensure_ascii=False)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None

    return values.map(one)


def prune(c: Column, kind: T.DataType, protected: tuple[str, ...] = ()) -> Column:
    """G5 at any depth: missing items of an array are null but keep their places, keys of missing values leave a map, missing fields of a struct are null; what then has nothing left is null."""
    if isinstance(kind, T.ArrayType):
        items = F.transform(c, lambda x: prune(x, kind.elementType, protected))
        return F.when(F.exists(items, lambda x: x.isNotNull()), items)
    if isinstance(kind, T.MapType):
        kept = F.map_filter(F.transform_values(c, lambda _, v: prune(v, kind.valueType, protected)), lambda _, v: v.isNotNull())
        return F.when(F.size(kept) > 0, kept)
    if isinstance(kind, T.StructType):
        fields = [prune(c.getField(f.name), f.dataType, protected).alias(f.name) for f in kind]
        return F.when(reduce(lambda a, b: a | b, [f.isNotNull() for f in fields], F.lit(False)), F.struct(*fields)) if fields else c
    return F.when(~is_placeholder(c, protected), c)


TEXTS, PAIRS = T.ArrayType(T.StringType()), T.MapType(T.StringType(), T.StringType())


# -- schema ---------------------------------------------------------------------------------------


def bracketed(df: DataFrame, names: list[str]) -> set[str]:
    """Text columns with a value that may be a literal (from a bracket on), in one aggregate; only these go through Python."""
    text = [c for c in names if isinstance(df.schema[c].dataType, T.StringType)]
    return set(_chosen(df, {c: F.coalesce(F.max(F.col(c).rlike(r"(?U)^\s*[\[{]")), F.lit(False)) for c in text})) if text else set()


def enforce_column(df: DataFrame, name: str, kind: str, protected: tuple[str, ...] = (), literals: bool = True) -> Column:
    """The column under a type name of the schema language; what doesn't fit is null. ``literals``: whether any value begins with a bracket."""
    c, given = F.col(name), df.schema[name].dataType
    if kind == "bool":
        low = F.lower(strip(c.cast("string")))
        if isinstance(given, T.NumericType):
            return F.when(c == 1, True).when(c == 0, False)
        return F.when(is_placeholder(c, protected), None).when(low.isin(*TRUE), True).when(low.isin(*FALSE), False)
    if kind in ("int", "float", "number"):
        base = F.when(~is_placeholder(c, protected), c) if protected else c
        number = base.cast("string").try_cast("double") if not isinstance(given, T.NumericType) else base.cast("double")
        number = F.when(~F.isnan(number), number)
        return F.when(number == F.floor(number), number).cast("long") if kind == "int" else number
    if kind in ("date", "datetime"):
        return c if isinstance(given, (T.TimestampType, T.DateType)) else F.try_to_timestamp(strip(c.cast("string")))
    if kind == "list":
        if isinstance(given, T.ArrayType):
            flat = isinstance(given.elementType, T.AtomicType)
            return prune(c.cast("array<string>"), TEXTS) if flat else prune(c, given)
        as_list = F.from_json(pruned_literal(F.when(F.startswith(strip(c.cast("string")), F.lit("[")), strip(c.cast("string")))), "array<string>") if literals else F.lit(None).cast("array<string>")
        return F.when(is_placeholder(c, protected), None).otherwise(F.coalesce(prune(as_list, TEXTS), F.when(~F.startswith(strip(c.cast("string")), F.lit("[")), F.array(strip(c.cast("string"))))))
    if kind == "dict":
        if isinstance(given, T.StructType):
            return prune(c, given)
        if isinstance(given, T.MapType):
            return prune(c.cast("map<string,string>"), PAIRS) if isinstance(given.valueType, T.AtomicType) else prune(c, given)
        as_map = F.from_json(pruned_literal(F.when(F.startswith(strip(c.cast("string")), F.lit("{")), strip(c.cast("string")))), "map<string,string>") if literals else F.lit(None).cast("map<string,string>")
        return prune(as_map, PAIRS)
    if kind != "string":
        raise ValueError(f"no type {kind}; known: {TYPES}")
    if isinstance(given, T.ArrayType):
        return F.get(F.filter(c.cast("array<string>"), lambda x: ~is_placeholder(x, protected)), F.lit(0))
    if isinstance(given, (T.MapType, T.StructType)):
        return F.lit(None).cast("string")
    text = strip(c.cast("string"))
    if not isinstance(given, T.StringType):
        return F.when(~is_placeholder(c, protected), text)
    if not literals:
        return F.when(~is_placeholder(c, protected), text)
    boxed = F.from_json(literal_to_json(F.when(text.rlike(r"^[\[{]"), text)), "array<string>")
    first = F.get(F.filter(boxed, lambda x: ~is_placeholder(x, protected)), F.lit(0))
    opened = F.when(text.rlike(r"^\["), F.when(boxed.isNotNull(), first).otherwise(text)).otherwise(text)
    return F.when(~is_placeholder(c, protected), F.when(~is_placeholder(opened, protected), opened))


def enforce_schema(df: DataFrame, schema: dict[str, str], protected: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One select that puts each named column under its type; names that aren't there are skipped, others stay."""
    protected, open_ = protected or {}, bracketed(df, [c for c in df.columns if schema.get(c) in ("string", "list", "dict")])
    return df.select(*[enforce_column(df, c, schema[c], protected.get(c, ()), c in open_).alias(c) if c in schema else F.col(c) for c in df.columns])


def enforce_report(df: DataFrame, schema: dict[str, str], protected: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Per column the values lost in all, as placeholders and as mismatches; columns that lose none are left out."""
    protected = protected or {}
    names = [c for c in df.columns if c in schema]
    open_, sums = bracketed(df, names), []
    for c in names:
        before, after = F.col(c).isNotNull(), enforce_column(df, c, schema[c], protected.get(c, ()), c in open_).isNotNull()
        sums += [(F.sum(before.cast("long")) - F.sum(after.cast("long"))).alias(f"t_{c}"), F.sum((before & is_placeholder(F.col(c), protected.get(c, ()))).cast("long")).alias(f"p_{c}")]
    fields = {c: [F.col(f"t_{c}"), F.least(F.col(f"p_{c}"), F.col(f"t_{c}")), F.greatest(F.lit(0), F.col(f"t_{c}") - F.col(f"p_{c}"))] for c in names}
    return unpivot(df.agg(*sums), fields, ["total", "placeholders", "mismatch"], ["long"] * 3).where("total > 0")


def cell_class(c: Column) -> Column:
    """A10: the narrowest type a text reads as."""
    t = strip(c)
    return F.when(t.try_cast("bigint").isNotNull(), "int").when(t.try_cast("double").isNotNull(), "float").when(F.lower(t).isin("true", "false"), "bool").when(t.rlike(r"^[\[{]"), "nested").when(F.try_to_timestamp(t).isNotNull(), "datetime").otherwise("str")


def mixed_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """A10: (column, type, n, share) of the columns whose values are of more than one type."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select("x.*").where(~is_placeholder(F.col("v")))
    counts = cells.groupBy("column", cell_class(F.col("v")).alias("type")).agg(F.count("*").alias("n"))
    per = W.partitionBy("column")
    return counts.withColumn("share", F.col("n") / F.sum("n").over(per)).withColumn("__k", F.count("*").over(per)).where("__k > 1").drop("__k")


def type_outliers(df: DataFrame, columns: list[str], most: int = 5) -> DataFrame:
    """A10: (column, majority, outliers): the ``most`` least distinct values that aren't of a mixed column's commonest type (the greater name, of types equally common)."""
    kinds = mixed_types(df, columns)
    best = kinds.groupBy("column").agg(F.max_by("type", F.struct("n", "type")).alias("majority"))
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select("x.*").where(~is_placeholder(F.col("v")))
    # ``best`` has a row per column of the table at most.
    odd = cells.join(F.broadcast(best), "column").where(cell_class(F.col("v")) != F.col("majority")).select("column", "majority", "v").distinct()
    first = odd.withColumn("__k", F.row_number().over(W.partitionBy("column").orderBy("v"))).where(F.col("__k") <= most)
    return first.groupBy("column", "majority").agg(F.sort_array(F.collect_list("v")).alias("outliers"))


def narrow_types(df: DataFrame) -> DataFrame:
    """Fractional columns that only hold whole numbers become long; not-a-number counts as null. One aggregate over the table; a column without values stays."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.FractionalType)]
    if not names:
        return df
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c))
    # The bounds of a long, as doubles.
    whole = lambda v: (v == F.floor(v)) & (v >= F.lit(-(2.0**63))) & (v < F.lit(2.0**63))
    found = set(_chosen(df, {c: F.coalesce(F.bool_and(whole(number(c))), F.lit(False)) for c in names}))
    return df.select(*[number(f.name).cast("long").alias(f.name) if f.name in found else F.col(f.name) for f in df.schema])


def resolve_mixed(df: DataFrame, columns: list[str], policy: dict[str, str] | None = None) -> dict[str, str]:
    """A schema override for mixed columns by policy (default majority; string, skip or a type name) instead of a prompt."""
    names = {"int": "number", "float": "number", "str": "string", "bool": "bool", "nested": "list", "datetime": "datetime"}
    # A row per mixed column and type comes to the driver.
    best: dict[str, tuple[int, str]] = {}
    for r in mixed_types(df, columns).collect():
        best[r["column"]] = max(best.get(r["column"], (0, "")), (r["n"], r["type"]))
    out = {}
    for c, (_, kind) in best.items():
        rule = (policy or {}).get(c, "majority")
        if rule != "skip":
            out[c] = names[kind] if rule == "majority" else rule
    return out


def infer_schema(df: DataFrame) -> DataFrame:
    """(column, type) by the native type, for strings by what all present values read as, in one aggregate. Words for true and false only make a column boolean if it has at most ten distinct values in lower case, placeholders among them."""
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    sums = [F.lit(0).alias("__none")]
    for c in text:
        v = F.when(~is_placeholder(F.col(c)), strip(F.col(c)))
        low = F.lower(v)
        every = lambda p: F.coalesce(F.min(p.cast("int")), F.lit(0))
        sums += [
            every(F.when(v.isNotNull(), v.try_cast("double").isNotNull())).alias(f"n_{c}"),
            F.when(F.size(F.collect_set(F.when(low.isin(*TRUE, *FALSE), low))) + F.approx_count_distinct(F.when(is_placeholder(F.col(c)), F.lower(F.col(c))), 0.02) <= 10, every(F.when(v.isNotNull(), low.isin(*TRUE, *FALSE)))).otherwise(0).alias(f"b_{c}"),
            every(F.when(v.isNotNull(), F.try_to_timestamp(v).isNotNull())).alias(f"d_{c}"),
            every(F.when(v.isNotNull(), v.rlike(r"(?s)^\[.*\]$"))).alias(f"l_{c}"),
            every(F.when(v.isNotNull(), v.rlike(r"(?s)^\{.*\}$"))).alias(f"m_{c}"),
        ]
    fields = {}
    for f in df.schema:
        c, t = f.name, f.dataType
        if isinstance(t, T.StringType):
            word = F.when(F.col(f"n_{c}") == 1, "number").when(F.col(f"b_{c}") == 1, "bool").when(F.col(f"d_{c}") == 1, "datetime").when(F.col(f"l_{c}") == 1, "list").when(F.col(f"m_{c}") == 1, "dict").otherwise("string")
        else:
            known = [(T.BooleanType, "bool"), (T.IntegralType, "int"), (T.NumericType, "float"), (T.TimestampType, "datetime"), (T.DateType, "date"), (T.ArrayType, "list"), ((T.MapType, T.StructType), "dict")]
            word = F.lit(next((n for k, n in known if isinstance(t, k)), "string"))
        fields[c] = [word]
    return unpivot(df.agg(*sums), fields, ["type"], ["string"])


def auto_pipeline(df: DataFrame, schema: dict[str, str] | None = None, protected: dict[str, tuple[str, ...]] | None = None, drop_sparse: float | None = None, order: str | None = None) -> DataFrame:
    """Rename, infer, override, enforce, drop sparse columns, drop exact duplicates."""
    df = clean_column_names(df)
    inferred = {r["column"]: r["type"] for r in infer_schema(df).collect()}
    df = enforce_schema(df, inferred | (schema or {}), protected)
    if drop_sparse is not None:
        df = drop_missing_columns(df, drop_sparse)
    return drop_exact(df, order)


# -- columns --------------------------------------------------------------------------------------


def combine_columns(a: Column, b: Column, sep: str = " ") -> Column:
    """Both trimmed, joined, the separator's characters cut off at the ends; two nulls give an empty text."""
    joined = F.concat(F.coalesce(F.trim(a.cast("string")), F.lit("")), F.lit(sep), F.coalesce(F.trim(b.cast("string")), F.lit("")))
    return F.trim(joined, F.lit(sep))


def first_element(c: Column) -> Column:
    return F.get(c, F.lit(0))


def join_elements(c: Column, sep: str = "; ") -> Column:
    return F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda x: x.cast("string")), sep))


def drop_short(c: Column, min_chars: int = 10) -> Column:
    return F.when(F.length(c) >= min_chars, c)


def _chosen(df: DataFrame, tests: dict[str, Column]) -> list[str]:
    row = df.agg(*[t.alias(c) for c, t in tests.items()]).first()
    return [c for c in tests if row[c]]


def constant_columns(df: DataFrame) -> list[str]:
    """Columns with at most one value, null counting as one."""
    plain = [c for c in df.columns if c not in nested_columns(df)]
    return _chosen(df, {c: (F.count_distinct(F.col(c)) + F.max(F.col(c).isNull().cast("int"))) <= 1 for c in plain})


def drop_missing_columns(df: DataFrame, threshold: float = 0.95, keep: tuple[str, ...] = ()) -> DataFrame:
    """Drop columns whose missing share is over the threshold."""
    return df.drop(*_chosen(df, {c: F.avg(F.col(c).isNull().cast("int")) > threshold for c in df.columns if c not in keep}))


def cap_outliers(df: DataFrame, columns: list[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Winsorise to exact quantiles (linear between two values); nulls stay."""
    bounds = {c: quantiles(df.select(F.col(c).cast("double").alias("x")).where("x IS NOT NULL"), [low, high]) for c in columns}
    capped = lambda c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c).cast("double"), F.lit(bounds[c][0])), F.lit(bounds[c][1])))
    return df.withColumns({c: capped(c) for c in columns if bounds[c] is not None})


def quantiles(df: DataFrame, shares: list[float], leaf: int = 100_000, bins: int = 1000) -> list[float] | None:
    """Exact quantiles of the column x: counts by range narrow down to ``leaf`` rows or one value about each rank, so that no task gets all values."""
    n = df.count()

    def ranked(k: int) -> float:
        inside, lo, hi, before = df, None, None, 0
        while True:
            lo, hi, size = inside.agg(F.min("x"), F.max("x"), F.count("*")).first()
            if lo == hi:
                return lo
            if size <= leaf:
                return inside.orderBy("x").limit(k - before + 1).agg(F.max("x")).first()[0]
            place = F.least(F.floor((F.col("x") - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
            for r in sorted(inside.groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()):
                if k < before + r["n"]:
                    inside = inside.where(F.col("x").between(r["lo"], r["hi"]))
                    break
                before += r["n"]

    out = []
    for share in shares if n else ():
        at = share * (n - 1)
        low = ranked(int(at))
        out.append(low + (at - int(at)) * (ranked(int(at) + 1) - low) if at > int(at) else low)
    return out or None


def completeness(df: DataFrame) -> Column:
    """P25: values that aren't null."""
    return reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in df.columns])


def sums_before(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """``out``: the sum of ``value`` over all rows before this one in ``order`` (distinct), by range partitions: sums within each, and the totals of those before it."""
    from corpusmill.sources.session import materialize

    placed = materialize(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    # As many rows as the exchange has partitions.
    totals = placed.groupBy("__part").agg(F.sum(value).alias("__t")).select("__part", F.sum("__t").over(before).alias("__before"))
    within = F.sum(value).over(W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return placed.withColumn("__within", within).join(F.broadcast(totals), "__part").withColumn(out, F.coalesce("__before", F.lit(0)) + F.coalesce("__within", F.lit(0))).drop("__part", "__before", "__within")


def number_rows(df: DataFrame, order: list[str], out: str, start: int = 1) -> DataFrame:
    """Consecutive numbers in ``order`` without a single-task sort: rows are range-partitioned and sorted, and each partition starts after the counts of those before it."""
    from corpusmill.sources.session import materialize

    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = materialize(placed).withColumn("__part", F.shiftrightunsigned("__at", 33)).withColumn("__pos", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    # As many rows as the exchange has partitions.
    return placed.join(F.broadcast(before), "__part").withColumn(out, F.col("__before") + F.col("__pos") + start).drop("__part", "__pos", "__at", "__before")


# -- duplicates -----------------------------------------------------------------------------------


def drop_exact(df: DataFrame, order: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """The first row (by ``order``) of each set of rows equal in ``columns`` (default: all scalar ones but ``order``); nulls are equal.

    With no order, or only the order outside the key, this is an aggregate with map-side combining, so hot
    values don't meet in one task's sort.
    """
    keys = columns or [c for c in df.columns if c != order and c not in nested_columns(df)]
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    if order is None:
        return df.dropDuplicates(keys)
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(F.col(order).isNull(), F.col(order))).alias("__r"))
    return best.select(*keys, "__r.*").select(*df.columns)


def duplicate_count(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows beyond the first of each set of equal ones."""
    return df.groupBy(*columns).agg(F.count("*").alias("__n")).agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def column_duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """A5: (column, value, n) of values that occur twice or more."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    return cells.where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n")).where("n >= 2")


def key_duplicates(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Second and later rows of each key."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("__n > 1").drop("__n")


def list_duplicates(items: Column) -> Column:
    """(value, positions) of the items that a list holds more than once, by first position."""
    repeated = F.filter(F.array_distinct(items), lambda v: F.size(F.filter(items, lambda x: x == v)) > 1)
    return F.transform(repeated, lambda v: F.struct(v.alias("value"), F.filter(F.transform(items, lambda x, i: F.when(x == v, i)), lambda p: p.isNotNull()).alias("positions")))


# -- profiles -------------------------------------------------------------------------------------


def missing_report(df: DataFrame) -> DataFrame:
    """(column, missing, share) of columns with missing values."""
    sums = [F.count("*").alias("__n"), *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns]]
    return unpivot(df.agg(*sums), {c: [F.col(c), F.col(c) / F.col("__n")] for c in df.columns}, ["missing", "share"], ["long", "double"]).where("missing > 0")


def profile(df: DataFrame, order: str) -> DataFrame:
    """Per column the type, missing count and share, distinct values (-1 for nested ones), placeholders and the first sample by ``order``."""
    nested = nested_columns(df)
    sums = [F.count("*").alias("__n")]
    for c in df.columns:
        sums += [F.sum(F.col(c).isNull().cast("long")).alias(f"m_{c}"), (F.lit(-1).cast("long") if c in nested else F.count_distinct(F.col(c))).alias(f"u_{c}")]
        sums += [F.min_by(F.substring(F.col(c).cast("string"), 1, 40), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"s_{c}"), F.sum((F.col(c).isNotNull() & is_placeholder(F.col(c).cast("string"))).cast("long")).alias(f"p_{c}")]
    fields = {f.name: [F.lit(f.dataType.simpleString()), F.col(f"m_{f.name}"), F.col(f"m_{f.name}") / F.col("__n"), F.col(f"u_{f.name}"), F.col(f"p_{f.name}"), F.col(f"s_{f.name}")] for f in df.schema}
    return unpivot(df.agg(*sums), fields, ["type", "missing", "share", "distinct_values", "placeholders", "sample"], ["string", "long", "double", "long", "long", "string"])


def _field(items: Column, name: str) -> Column:
    return F.transform(items, lambda x: x[name])


def leaves(df: DataFrame) -> dict[str, Column]:
    """Paths of the scalar leaves of nested columns; arrays give their items."""
    out: dict[str, Column] = {}

    def walk(path: str, c: Column, t: T.DataType) -> None:
        if isinstance(t, T.StructType):
            for f in t:
                walk(f"{path}.{f.name}", _field(c, f.name) if "[]" in path else c[f.name], f.dataType)
        elif isinstance(t, T.ArrayType):
            inner = F.flatten(c) if "[]" in path else c
            walk(f"{path}[]", inner, t.elementType)
        else:
            out[path] = c

    for f in df.schema:
        if isinstance(f.dataType, (T.StructType, T.ArrayType)):
            walk(f.name, F.col(f.name), f.dataType)
    return out


def nested_profile(df: DataFrame) -> DataFrame:
    """(path, values, distinct_values with null as one, category) of every leaf."""
    cells = []
    for path, c in leaves(df).items():
        cells.append(_tag(F.transform(c, lambda x: x.cast("string")) if "[]" in path else F.array(c.cast("string")), path))
    rows = df.select(F.explode(F.concat(*cells)).alias("x")).select("x.*")
    out = rows.groupBy("path").agg(F.count("*").alias("cells"), (F.count_distinct("v") + F.max(F.col("v").isNull().cast("int"))).cast("long").alias("distinct_values"))
    share = F.col("distinct_values") / F.col("cells")
    return out.withColumn("category", F.when(F.col("distinct_values") <= 1, "CONSTANT").when(share > 0.9, "ID-TEXT").when((share < 0.1) | (F.col("distinct_values") < 50), "CATEGORY").otherwise("DENSE"))


def _tag(items: Column, path: str) -> Column:
    return F.transform(F.coalesce(items, F.array(F.lit(None).cast("string"))), lambda v: F.struct(F.lit(path).alias("path"), v.alias("v")))


def value_counts(df: DataFrame, columns: list[str], share: bool = False) -> DataFrame:
    """A1-A3: rows by combination of values, nulls dropped; with their share of all if wanted."""
    kept = df.dropna(subset=columns)
    out = kept.groupBy(*columns).agg(F.count("*").alias("n"))
    return out.withColumn("share", F.col("n") / F.lit(max(1, kept.count()))) if share else out


def samples(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """``n`` rows in the order of a hash of the key, the same on every run."""
    return df.orderBy(F.md5(F.col(key).cast("string").cast("binary")), key).limit(n)


def flatten_fully(c: Column, depth: int) -> Column:
    """An array nested ``depth`` deep as one list."""
    for _ in range(depth - 1):
        c = F.flatten(c)
    return c



def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating columns with NaN as null, the one kind of missing value."""
    return df.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))})
