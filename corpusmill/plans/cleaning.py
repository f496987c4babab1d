"""Queries over schema, cleaning, profiles and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import is_placeholder, is_short
from corpusmill.operators import cleaning as C
from corpusmill.operators import integrate as I
from corpusmill.plans.registry import query
from corpusmill.sources.session import table

#: The placeholder rule in the oracle's SQL.
BAD = r"({c} IS NULL OR trim({c}) = '' OR regexp_matches(lower(trim({c})), '^(nan|n/?a|null|none|<none>|not reported|unknown|undefined|missing|-+|/+|\?+|-99|-9999|999|9999)$'))"
bad = lambda c: BAD.replace("{c}", c)

#: The same dirt on both sides.
DIRTY = "CASE c_custkey % 7 WHEN 0 THEN 'N/A' WHEN 1 THEN '-' WHEN 2 THEN '999' WHEN 3 THEN ' ' ELSE c_mktsegment END"
DIRTY_ROWS = f"""SELECT c_custkey AS id, {DIRTY} AS segment,
 CASE WHEN c_custkey % 5 = 0 THEN 'yes' WHEN c_custkey % 5 = 1 THEN 'OFF' WHEN c_custkey % 5 = 2 THEN '2' WHEN c_custkey % 5 = 3 THEN 'unknown' ELSE 'True' END AS flag,
 CASE WHEN c_custkey % 4 = 0 THEN 'abc' WHEN c_custkey % 4 = 1 THEN '-99' ELSE CAST(c_nationkey AS STRING) END AS amount,
 CASE WHEN c_custkey % 3 = 0 THEN '2020-01-05' WHEN c_custkey % 3 = 1 THEN 'n/a' ELSE 'soon' END AS day"""
SCHEMA = {"segment": "string", "flag": "bool", "amount": "number", "day": "datetime"}


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "customer").createOrReplaceTempView("cm_customer")
    return spark.sql(DIRTY_ROWS + " FROM cm_customer")


def injected_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with nulls in two columns."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.expr("CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END").alias("priority"), F.expr("CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END").alias("price"), "o_orderstatus")


ORDERS_SQL = "(SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS priority, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS price, o_orderstatus FROM orders)"


@query("SELECT lang, count(*) AS n FROM (SELECT min_by(lang, doc_id) AS lang FROM documents WHERE length(text) >= 100 GROUP BY text) GROUP BY lang")
def flagship_dedup_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.length("text") >= 100).select("doc_id", "text", "lang")
    return C.value_counts(C.drop_exact(docs, "doc_id", ["text"]).select("lang"), ["lang"])


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1997")
def scan_year_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Bounds on the column itself reach the Parquet reader, which a function of it would not.
    o = table(spark, sf_dir, "orders").where((F.col("o_orderdate") >= "1996-01-01") & (F.col("o_orderdate") < "1998-01-01"))
    return o.select("o_orderkey", "o_custkey", "o_totalprice")


@query(f"SELECT 'segment' AS \"column\", count(*) FILTER (segment IS NOT NULL AND {bad('segment')}) AS hits, list_sort(list(DISTINCT segment) FILTER (segment IS NOT NULL AND {bad('segment')})) AS samples FROM (SELECT {DIRTY} AS segment FROM customer)")
def placeholder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.col("segment").isNotNull() & is_placeholder(F.col("segment"))
    return dirty(spark, sf_dir).agg(F.lit("segment").alias("column"), F.count_if(hit).alias("hits"), F.sort_array(F.collect_set(F.when(hit, F.col("segment")))).alias("samples"))


@query(f"SELECT id, CASE WHEN NOT {bad('segment')} THEN segment END AS segment FROM (SELECT c_custkey AS id, {DIRTY} AS segment FROM customer)")
def null_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dirty(spark, sf_dir).select("id", F.when(~is_placeholder(F.col("segment")), F.col("segment")).alias("segment"))


ENFORCED = f"""SELECT id, CASE WHEN NOT {bad('segment')} THEN trim(segment) END AS segment,
 CASE WHEN {bad('flag')} THEN NULL WHEN lower(trim(flag)) IN ('y','yes','t','true','1','on') THEN TRUE WHEN lower(trim(flag)) IN ('n','no','f','false','0','off') THEN FALSE END AS flag,
 TRY_CAST(amount AS DOUBLE) AS amount, TRY_CAST(day AS TIMESTAMP) AS day FROM ({DIRTY_ROWS.replace('STRING', 'VARCHAR')} FROM customer)"""


@query(ENFORCED)
def enforce_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.enforce_schema(dirty(spark, sf_dir), SCHEMA)


_REPORT = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(a.{c}) - count(b.{c}) AS total, least(count(*) FILTER (a.{c} IS NOT NULL AND {bad('a.' + c)}), count(a.{c}) - count(b.{c})) AS placeholders, greatest(0, count(a.{c}) - count(b.{c}) - count(*) FILTER (a.{c} IS NOT NULL AND {bad('a.' + c)})) AS mismatch FROM a JOIN b ON a.id = b.id" for c in SCHEMA
)


@query(f"WITH a AS ({DIRTY_ROWS.replace('STRING', 'VARCHAR')} FROM customer), b AS ({ENFORCED}) SELECT * FROM ({_REPORT}) WHERE total > 0")
def enforce_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.enforce_report(dirty(spark, sf_dir), SCHEMA)


MIXED = "CASE event_id % 5 WHEN 0 THEN CAST(CAST(floor(value) AS BIGINT) AS {s}) WHEN 1 THEN 'word' WHEN 2 THEN 'n/a' WHEN 3 THEN '12.5' ELSE 'true' END"


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.expr(MIXED.format(s="STRING")).alias("mixed"), F.expr("CAST(user_id AS STRING)").alias("number"), F.expr("CASE WHEN user_id % 2 = 0 THEN 'yes' ELSE 'no' END").alias("answer"))


@query("SELECT unnest(['event_id', 'mixed', 'number', 'answer']) AS \"column\", unnest(['int', 'string', 'number', 'bool']) AS type FROM (SELECT count(*) FROM events)")
def infer_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.infer_schema(mixed(spark, sf_dir))


@query(f"""WITH t AS (SELECT {MIXED.format(s='VARCHAR')} AS v FROM events), c AS (SELECT CASE WHEN TRY_CAST(v AS BIGINT) IS NOT NULL AND NOT contains(v, '.') AND v <> 'true' THEN 'int' WHEN TRY_CAST(v AS DOUBLE) IS NOT NULL AND v <> 'true' THEN 'float' WHEN v = 'true' THEN 'bool' ELSE 'str' END AS type FROM t WHERE NOT {bad('v')})
SELECT 'mixed' AS "column", type, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM c GROUP BY type""")
def mixed_type_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.mixed_types(mixed(spark, sf_dir), ["mixed", "number"])


@query(f"""WITH t AS (SELECT {MIXED.format(s='VARCHAR')} AS v FROM events), c AS (SELECT v, CASE WHEN TRY_CAST(v AS BIGINT) IS NOT NULL AND NOT contains(v, '.') AND v <> 'true' THEN 'int' WHEN TRY_CAST(v AS DOUBLE) IS NOT NULL AND v <> 'true' THEN 'float' WHEN v = 'true' THEN 'bool' ELSE 'str' END AS type FROM t WHERE NOT {bad('v')}),
m AS (SELECT type FROM c GROUP BY type ORDER BY count(*) DESC, type DESC LIMIT 1), o AS (SELECT DISTINCT v FROM c WHERE type <> (SELECT type FROM m) ORDER BY v LIMIT 5)
SELECT 'mixed' AS "column", (SELECT type FROM m) AS majority, list(v ORDER BY v) AS outliers FROM o""")
def mixed_type_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.type_outliers(mixed(spark, sf_dir), ["mixed", "number"])


@query("SELECT event_id, CAST(floor(value) AS BIGINT) AS whole, value AS part, CAST(NULL AS DOUBLE) AS none, CASE WHEN event_id % 2 = 0 THEN 1::BIGINT END AS gaps FROM events")
def narrow_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.floor("value").cast("double").alias("whole"), F.col("value").alias("part"), F.lit(None).cast("double").alias("none"), F.expr("CASE WHEN event_id % 2 = 0 THEN 1D ELSE double('NaN') END").alias("gaps"))
    return C.narrow_types(e)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return d.join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("constant", F.lit("x")).withColumn("sparse", F.expr("CASE WHEN doc_id % 100 = 0 THEN 1 END"))


LABELLED = "(SELECT d.doc_id AS doc_id, lang, source, n_chars, quality, toxic, 'x' AS constant, CASE WHEN d.doc_id % 100 = 0 THEN 1 END AS sparse FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
_PROFILED = {"doc_id": "bigint", "lang": "string", "source": "string", "n_chars": "bigint", "quality": "int", "toxic": "int", "constant": "string", "sparse": "int"}


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS type, count(*) - count({c}) AS missing, (count(*) - count({c})) / count(*) AS share, count(DISTINCT {c}) AS distinct_values, count(*) FILTER ({c} IS NOT NULL AND {bad(f'CAST({c} AS VARCHAR)')}) AS placeholders, arg_min(substr(CAST({c} AS VARCHAR), 1, 40), doc_id) FILTER ({c} IS NOT NULL) AS sample FROM {LABELLED}" for c, t in _PROFILED.items()))
def profile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.profile(labelled(spark, sf_dir), "doc_id")


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, (count(*) - count({c})) / count(*) AS share FROM {LABELLED}" for c in _PROFILED) + ") WHERE missing > 0")
def missing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.missing_report(labelled(spark, sf_dir))


@query(f"SELECT doc_id, lang, source, n_chars, quality, toxic, sparse FROM {LABELLED}")
def constant_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = labelled(spark, sf_dir)
    return df.drop(*C.constant_columns(df))


@query(f"SELECT doc_id, lang, source, n_chars, quality, toxic, constant FROM {LABELLED}")
def sparse_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.drop_missing_columns(labelled(spark, sf_dir), 0.95)


@query("""WITH cells AS (SELECT 'who.name' AS path, CAST(user_id % 7 AS VARCHAR) AS v FROM events UNION ALL SELECT 'who.team', CASE WHEN event_id % 2 = 0 THEN event_type END FROM events UNION ALL SELECT 'marks[]', CAST(unnest([event_id, event_id + 1]) AS VARCHAR) FROM events),
c AS (SELECT path, count(*) AS cells, count(DISTINCT v) + max(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS distinct_values FROM cells GROUP BY path)
SELECT path, cells, CAST(distinct_values AS BIGINT) AS distinct_values, CASE WHEN distinct_values <= 1 THEN 'CONSTANT' WHEN distinct_values / cells > 0.9 THEN 'ID-TEXT' WHEN distinct_values / cells < 0.1 OR distinct_values < 50 THEN 'CATEGORY' ELSE 'DENSE' END AS category FROM c""")
def nested_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return C.nested_profile(e.select(F.struct((F.col("user_id") % 7).alias("name"), F.expr("CASE WHEN event_id % 2 = 0 THEN event_type END").alias("team")).alias("who"), F.array("event_id", F.col("event_id") + 1).alias("marks")))


@query("SELECT o_orderkey, round(least(greatest(o_totalprice, q[1]), q[2]), 2) AS o_totalprice FROM orders, (SELECT quantile_cont(o_totalprice, [0.05, 0.95]) AS q FROM orders)")
def cap_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cap_outliers(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]).withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("SELECT p_partkey, trim(coalesce(trim(p_brand), '') || ', ' || coalesce(trim(CASE WHEN p_partkey % 2 = 0 THEN p_type END), ''), ', ') AS both FROM part")
def combine_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", C.combine_columns(F.col("p_brand"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN p_type END"), ", ").alias("both"))


@query("SELECT doc_id, string_split(text, chr(10))[1] AS first FROM documents")
def first_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", C.first_element(F.split("text", "\n")).alias("first"))


@query("SELECT doc_id, md5(array_to_string(string_split(text, chr(10)), '; ')) AS joined_md5 FROM documents")
def join_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(C.join_elements(F.split("text", "\n")).cast("binary")).alias("joined_md5"))


@query("SELECT doc_id, CASE WHEN length(string_split(text, chr(10))[1]) >= 100 THEN string_split(text, chr(10))[1] END AS first FROM documents")
def drop_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", C.drop_short(C.first_element(F.split("text", "\n")), 100).alias("first"))


@query("SELECT count(*) - count(DISTINCT text) AS duplicates FROM documents")
def dup_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.duplicate_count(table(spark, sf_dir, "documents"), ["text"])


@query("SELECT min(doc_id) AS doc_id, md5(text) AS text_md5 FROM documents GROUP BY text")
def drop_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.drop_exact(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("SELECT * FROM (SELECT 'p_name' AS \"column\", p_name AS value, count(*) AS n FROM part GROUP BY p_name UNION ALL SELECT 'p_brand', p_brand, count(*) FROM part GROUP BY p_brand) WHERE n >= 2")
def column_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.column_duplicates(table(spark, sf_dir, "part"), ["p_name", "p_brand"])


@query("SELECT p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part) WHERE n > 1")
def key_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.key_duplicates(table(spark, sf_dir, "part").select("p_partkey", "p_name"), ["p_name"], "p_partkey")


@query("""WITH l AS (SELECT l_orderkey, list(CAST(l_quantity % 5 AS INTEGER) ORDER BY l_linenumber, CAST(l_quantity % 5 AS INTEGER)) AS items FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, value, list(pos ORDER BY pos) AS positions FROM (SELECT l_orderkey, unnest(items) AS value, CAST(unnest(range(0, len(items))) AS INTEGER) AS pos FROM l) GROUP BY l_orderkey, value HAVING count(*) > 1""")
def list_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", (F.col("l_quantity") % 5).cast("int").alias("q")))), lambda x: x["q"]).alias("items"))  # noqa: E741
    return l.select("l_orderkey", F.explode(C.list_duplicates(F.col("items"))).alias("d")).select("l_orderkey", "d.value", "d.positions")


@query("SELECT c_custkey AS cust_key, c_name AS full_name_of_customer, [concat_ws(' ', c_name, c_mktsegment)] AS names, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS balance FROM customer")
def clean_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    messy = c.select(F.col("c_custkey").alias(" Cust Key "), F.col("c_name").alias("Full  Name (of)\tCustomer!"), I.person_list(F.col("c_name"), F.col("c_mktsegment")).alias("NAMES"), F.col("c_acctbal").alias("Balance"))
    return C.clean_column_names(messy).withColumn("balance", F.when(F.col("balance") < 0, F.lit(0.0)).otherwise(F.col("balance")))


@query(f"SELECT o_orderkey, o_orderkey % 2 = 0 AS short FROM {ORDERS_SQL} WHERE priority IS NULL OR price IS NULL")
def incomplete_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.incomplete(injected_orders(spark, sf_dir), ["priority", "price"])
    text = F.when(F.col("o_orderkey") % 2 == 0, "a few words").otherwise("one two three four five six seven eight nine ten eleven")
    return rows.select("o_orderkey", is_short(text).alias("short"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 25")
def deterministic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.samples(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", 25)


@query(f"""WITH g AS (SELECT conv_id, list(CASE WHEN turn % 3 = 0 THEN 'n/a' WHEN turn % 3 = 1 THEN role END ORDER BY turn) AS items FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, list_transform(items, lambda x: CASE WHEN NOT {bad('x')} THEN x END) AS items FROM g)
SELECT conv_id, CASE WHEN len(list_filter(items, lambda x: x IS NOT NULL)) > 0 THEN items END AS items FROM p""")
def prune_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.expr("CASE WHEN turn % 3 = 0 THEN 'n/a' WHEN turn % 3 = 1 THEN role END").alias("v")).alias("s"))
    g = c.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("s")), lambda x: x["v"]).alias("items"))
    return g.select("conv_id", C.prune(F.col("items"), C.TEXTS).alias("items"))


@query(f"""WITH c AS (SELECT conv_id, turn, role, CASE WHEN turn % 2 = 0 THEN 'n/a' ELSE text END AS t FROM conversations),
i AS (SELECT conv_id, turn, role, CASE WHEN NOT {bad('role')} THEN role END AS r, CASE WHEN NOT {bad('t')} THEN t END AS t FROM c),
g AS (SELECT conv_id, list(CASE WHEN r IS NOT NULL OR t IS NOT NULL THEN coalesce(r, '-') || '|' || coalesce(md5(t), '-') END ORDER BY turn, role) AS items FROM i GROUP BY conv_id)
SELECT conv_id, items FROM g""")
def prune_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("t", F.expr("CASE WHEN turn % 2 = 0 THEN 'n/a' ELSE text END"))
    inner = lambda x: F.struct(x["role"].alias("r"), F.struct(F.array(x["t"], F.lit("--")).alias("texts"), F.create_map(F.lit("a"), F.lit("unknown")).alias("m")).alias("more"))
    g = c.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "t"))), inner).alias("items"))
    pruned = g.select("conv_id", C.prune(F.col("items"), g.schema["items"].dataType).alias("items"))
    flat = F.transform("items", lambda x: F.when(x.isNotNull(), F.concat_ws("|", F.coalesce(x["r"], F.lit("-")), F.coalesce(F.md5(x["more"]["texts"][0].cast("binary")), F.lit("-")))))
    return pruned.select("conv_id", flat.alias("items"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 4 < 3 THEN [n_name, CAST(n_regionkey AS VARCHAR)] END AS items FROM nation")
def parse_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").withColumn("raw", F.expr("CASE n_nationkey % 4 WHEN 0 THEN concat(\"['\", n_name, \"', \", n_regionkey, \"]\") WHEN 1 THEN concat(\"('\", n_name, \"', '\", n_regionkey, \"', )\") WHEN 2 THEN concat(\"[ '\", n_name, \"','\", n_regionkey, \"' ]\") ELSE '[broken' END"))
    return n.select("n_nationkey", F.from_json(C.literal_to_json("raw"), "array<string>").alias("items"))


@query(f"SELECT DISTINCT segment, flag, amount, day FROM ({ENFORCED})")
def auto_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = dirty(spark, sf_dir).drop("id").toDF("Segment ", "FLAG", "amount", "Day")
    return C.auto_pipeline(df, SCHEMA)


@query(f"SELECT o_orderkey, CAST(2 + (priority IS NOT NULL)::INT + (price IS NOT NULL)::INT AS INTEGER) AS score FROM {ORDERS_SQL}")
def completeness_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = injected_orders(spark, sf_dir)
    return df.select("o_orderkey", C.completeness(df).alias("score"))


@query("SELECT event_type, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM events GROUP BY event_type")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.value_counts(table(spark, sf_dir, "events"), ["event_type"], share=True)


@query(f"SELECT priority IS NULL AS missing, count(*) AS n FROM {ORDERS_SQL} GROUP BY 1")
def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return injected_orders(spark, sf_dir).groupBy(F.col("priority").isNull().alias("missing")).agg(F.count("*").alias("n"))
