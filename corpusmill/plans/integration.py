"""Queries over source integration, audits and stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import link_key, shard_of
from corpusmill.operators import cleaning as C
from corpusmill.operators import integrate as I
from corpusmill.operators import texts as X
from corpusmill.plans.registry import query
from corpusmill.sources.io import read_any, write_any
from corpusmill.sources.session import scratch_path, table


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def stores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three sets of ids that stand for containers of documents."""
    ids = docs(spark, sf_dir).select("doc_id")
    return table(spark, sf_dir, "labels").select("doc_id"), ids.where("doc_id % 3 = 0"), ids.where("doc_id % 5 = 0").select((F.col("doc_id") + 10).alias("doc_id"))


FLAGS = """(SELECT doc_id, bool_or(s = 0) AS in_metadata, bool_or(s = 1) AS in_archive, bool_or(s = 2) AS in_output, bool_or(s = 3) AS in_packed FROM (
 SELECT doc_id, 0 AS s FROM documents UNION ALL SELECT doc_id, 1 FROM labels UNION ALL SELECT doc_id, 2 FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id + 10, 3 FROM documents WHERE doc_id % 5 = 0) GROUP BY doc_id)"""


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive, output, packed = stores(spark, sf_dir)
    return I.audit(docs(spark, sf_dir), {"in_archive": archive, "in_output": output, "in_packed": packed}, "doc_id")


@query(f"SELECT * FROM {FLAGS}")
def audit_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags(spark, sf_dir)


@query(f"SELECT in_metadata, in_archive, in_output, in_packed, count(*) AS n FROM {FLAGS} GROUP BY ALL")
def audit_combos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.value_counts(flags(spark, sf_dir), ["in_metadata", "in_archive", "in_output", "in_packed"])


@query(f"SELECT * FROM {FLAGS} WHERE NOT (in_metadata AND in_archive AND in_output)")
def incomplete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags(spark, sf_dir).where("NOT (in_metadata AND in_archive AND in_output)")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0) AND doc_id NOT IN (1, 2, 4)")
def stage_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.pending(docs(spark, sf_dir).select("doc_id"), stores(spark, sf_dir)[1], [1, 2, 4], "doc_id")


@query("SELECT doc_id + 10 AS doc_id FROM documents WHERE doc_id % 5 = 0 AND doc_id + 10 IN (SELECT doc_id FROM documents)")
def prune_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.prune(stores(spark, sf_dir)[2], docs(spark, sf_dir), "doc_id")


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN TRUE ELSE doc_id % 2 = 0 END AS downloaded FROM documents")
def sync_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = docs(spark, sf_dir).select("doc_id", (F.col("doc_id") % 2 == 0).alias("downloaded"))
    return I.sync_flag(df, stores(spark, sf_dir)[0], "doc_id", "downloaded")


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS labelled FROM documents")
def membership_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.membership(docs(spark, sf_dir).select("doc_id"), stores(spark, sf_dir)[0], "doc_id", "labelled")


@query(f"SELECT count(*) FILTER (in_metadata AND in_packed) AS matches, count(*) FILTER (in_metadata AND NOT in_packed) AS missing, count(*) FILTER (NOT in_metadata AND in_packed) AS extra FROM {FLAGS}")
def integrity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.integrity(docs(spark, sf_dir), stores(spark, sf_dir)[2], "doc_id")


def folder_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).where("doc_id % 7 <> 6")
    return d.select(F.col("doc_id").cast("string").alias("folder"), F.explode(F.expr("CASE doc_id % 3 WHEN 0 THEN array('md', 'json') WHEN 1 THEN array('md') ELSE array('txt') END")).alias("ext"))


@query("SELECT CAST(doc_id AS VARCHAR) AS stem, CASE WHEN doc_id % 7 = 6 THEN 'MISSING' ELSE 'EMPTY' END AS problem FROM documents WHERE NOT (doc_id % 3 = 0 AND doc_id % 7 <> 6)")
def valid_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.folder_gaps(docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("stem")), folder_files(spark, sf_dir))


@query("SELECT doc_id || '_meta.json' AS name, doc_id || '.json' AS other FROM documents WHERE doc_id % 11 = 0 OR doc_id % 13 = 0")
def meta_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    meta = d.select(F.concat("doc_id", F.lit("_meta.json")).alias("name"), F.expr("CASE WHEN doc_id % 11 = 0 THEN concat(text, '.') ELSE text END").cast("binary").alias("content"))
    plain = d.where("doc_id % 13 <> 0").select(F.concat("doc_id", F.lit(".json")).alias("name"), F.col("text").cast("binary").alias("content"))
    return I.compare_meta(meta.unionByName(plain))


@query("SELECT url, page_id FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT DISTINCT url, CAST(NULL AS BIGINT) FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0)")
def new_url_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("url", "page_id")
    return I.insert_new(p.where("page_id % 2 = 0"), p.select("url"), "url")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 3 = 0 THEN 0 ELSE o_totalprice END AS o_totalprice FROM orders")
def update_non_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    changes = o.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("new").alias("o_orderstatus"), F.expr("CASE WHEN o_orderkey % 5 = 0 THEN 0D END").alias("o_totalprice"))
    return I.update_non_null(o, changes, "o_orderkey")


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return I.union_sources(c, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


@query("""SELECT 'difference' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL
SELECT 'intersection', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'union', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)""")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    count = lambda name, df: df.agg(F.lit(name).alias("op"), F.count("*").alias("n"))
    return count("difference", a.subtract(b)).unionByName(count("intersection", a.intersect(b))).unionByName(count("union", a.union(b).distinct()))


@query("""SELECT n_regionkey AS region, list_transform(list(n_nationkey ORDER BY n_nationkey), lambda x: x) AS flat, (SELECT list(x) FROM (SELECT min(i) AS i, x FROM (SELECT unnest(k) AS x, generate_subscripts(k, 1) AS i FROM (SELECT list(n2.n_nationkey % 3 ORDER BY n2.n_nationkey) AS k FROM nation n2 WHERE n2.n_regionkey = n.n_regionkey)) GROUP BY x ORDER BY i)) AS firsts FROM nation n GROUP BY n_regionkey""")
def list_utils(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.sort_array(F.collect_list("n_nationkey")).alias("k"))
    nested = n.withColumn("deep", F.array(F.transform("k", lambda x: F.array(x))))
    return nested.select("region", C.flatten_fully(F.col("deep"), 3).alias("flat"), F.array_distinct(F.transform("k", lambda x: x % 3)).alias("firsts"))


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) + 4180 AS BIGINT) AS id FROM orders")
def seq_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.number_rows(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], "id", 4181)


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with nested authors, affiliations, files and languages."""
    c = table(spark, sf_dir, "customer")
    author = lambda f, l, n: F.struct(F.expr(f).alias("first_name"), F.expr(l).alias("last_name"), F.expr(n).alias("name"))
    return c.select(
        "c_custkey",
        F.when(F.col("c_custkey") % 9 != 0, F.array(author("CASE WHEN c_custkey % 2 = 0 THEN c_name END", "c_mktsegment", "'x'"), author("CAST(NULL AS STRING)", "CAST(NULL AS STRING)", "CASE WHEN c_custkey % 3 = 0 THEN ' plain ' END"))).alias("author"),
        F.expr("CASE WHEN c_custkey % 4 = 0 THEN array() ELSE array(named_struct('name', c_mktsegment), named_struct('name', 'second')) END").alias("affiliation"),
        F.expr("array(named_struct('access', CASE WHEN c_custkey % 2 = 0 THEN 'open' ELSE 'closed' END, 'kind', 'fullText', 'url', concat('u', c_custkey)), named_struct('access', 'open', 'kind', CASE WHEN c_custkey % 3 = 0 THEN 'fullText' ELSE 'other' END, 'url', concat('v', c_custkey)))").alias("file"),
        F.expr("CASE c_custkey % 4 WHEN 0 THEN array('EN', 'NL') WHEN 1 THEN array('en', CAST(NULL AS STRING)) WHEN 2 THEN array('Dut') END").alias("language"),
    )


@query("SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN []::VARCHAR[] ELSE list_filter([trim(coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_name END, '') || ' ' || c_mktsegment), CASE WHEN c_custkey % 3 = 0 THEN 'plain' END], lambda x: x IS NOT NULL) END AS names FROM customer")
def nested_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people(spark, sf_dir).select("c_custkey", I.author_names(F.col("author")).alias("names"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS affiliation FROM customer")
def nested_affiliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people(spark, sf_dir).select("c_custkey", I.first_affiliation(F.col("affiliation")).alias("affiliation"))


OPEN = "CASE WHEN c_custkey % 2 = 0 THEN 'u' || c_custkey WHEN c_custkey % 3 = 0 THEN 'v' || c_custkey END"


@query(f"SELECT c_custkey, {OPEN} AS url FROM customer")
def open_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people(spark, sf_dir).select("c_custkey", I.open_link(F.col("file")).alias("url"))


@query("SELECT c_custkey, c_custkey % 4 IN (0, 2) AS dutch FROM customer")
def lang_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people(spark, sf_dir).select("c_custkey", I.has_language(F.col("language")).alias("dutch"))


VOTE = "(SELECT max_by(lang, [n, -o]) FROM (SELECT l.lang AS lang, l.o AS o, len(list_filter(regexp_split_to_array(lower({t}), '[^\\p{L}]+'), lambda w: list_contains(l.words, w))) AS n FROM (VALUES " + ", ".join(f"('{k}', {i}, {w!r})" for i, (k, w) in enumerate(X.STOP_WORDS.items())) + ") l(lang, o, words)) WHERE n > 0)"


@query("""WITH g AS (SELECT conv_id, min_by(text, turn) FILTER (role = 'user') AS first, min_by(text, turn) FILTER (role = 'assistant') AS reply FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN first WHEN length(reply) > 100 THEN reply END AS text, CASE WHEN conv_id % 3 = 0 THEN 'nl' ELSE """ + VOTE.replace("{t}", "substr(CASE WHEN length(reply) > 100 THEN reply END, 1, 500)") + " END AS lang FROM g WHERE NOT (conv_id % 3 = 0 AND first IS NULL)")
def best_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("first"), F.min_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("reply"))
    c = c.withColumn("items", F.expr("array(named_struct('lang', 'en', 'text', 'no'), named_struct('lang', CASE WHEN conv_id % 3 = 0 THEN 'NL' END, 'text', first))"))
    return c.where("NOT (conv_id % 3 = 0 AND first IS NULL)").select("conv_id", I.best_text(F.col("items"), F.col("reply"), X.vote_language).alias("s")).select("conv_id", "s.*")


@query(f"SELECT c_custkey FROM customer WHERE (c_custkey % 4 IN (0, 2) AND {OPEN} IS NOT NULL) OR c_custkey % 10 = 1")
def keep_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = people(spark, sf_dir)
    lang = F.when(F.col("c_custkey") % 10 == 1, "nl")
    return p.where(I.keep_mask(I.has_language(F.col("language")), I.open_link(F.col("file")), lang)).select("c_custkey")


@query("SELECT conv_id, md5(text) AS text_md5 FROM conversations WHERE role = 'user' AND length(text) >= 100")
def explode_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.col("role").alias("lang"), "text")).alias("items"))
    return I.explode_texts(c, "items", "user").select("conv_id", F.md5(F.col("item_text").cast("binary")).alias("text_md5"))


@query("SELECT p_name AS title, list(p_partkey ORDER BY p_partkey) AS rows FROM part GROUP BY p_name")
def title_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("title")).agg(F.sort_array(F.collect_list("p_partkey")).alias("rows"))


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM labels) AS labels")
def dataset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [docs(spark, sf_dir).select(F.lit("d").alias("t")), table(spark, sf_dir, "labels").select(F.lit("l").alias("t"))]
    return I.union_sources(*parts).agg(F.count_if(F.col("t") == "d").alias("documents"), F.count_if(F.col("t") == "l").alias("labels"))


@query("SELECT page_id, substr(md5(url), 1, 12) AS key FROM pages")
def hash_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", link_key(F.col("url")).alias("key"))


@query("SELECT o_orderkey, CAST(o_orderkey % 3 AS INTEGER) AS shard FROM orders")
def shard_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", shard_of(F.col("o_orderkey"), 3).alias("shard"))


@query("SELECT CAST(doc_id % 3 AS INTEGER) AS shard, count(*) AS n FROM documents GROUP BY 1")
def shard_split_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark)
    docs(spark, sf_dir).select("doc_id", "lang", shard_of(F.col("doc_id"), 3).alias("shard")).repartition("shard").write.partitionBy("shard").parquet(path)
    return spark.read.parquet(path).groupBy("shard").agg(F.count("*").alias("n"))


@query("SELECT 'parquet' AS format, * FROM nation UNION ALL SELECT 'tsv', * FROM nation UNION ALL SELECT 'jsonl', * FROM nation")
def roundtrip_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, base = table(spark, sf_dir, "nation"), scratch_path(spark)
    parts = []
    for kind in ("parquet", "tsv", "jsonl"):
        write_any(n, f"{base}/n.{kind}")
        parts.append(read_any(spark, f"{base}/n.{kind}", n.schema).withColumn("format", F.lit(kind)))
    return I.union_sources(*parts)


def zipped(spark: SparkSession, sf_dir: str) -> str:
    """All documents zipped by shard into the shared folder; returns that folder."""
    from corpusmill.sources.archives import pack_zips

    folder = scratch_path(spark)
    # A shard of some 4,000 documents fits a task; their number follows the table's.
    d = docs(spark, sf_dir)
    d = d.select(shard_of(F.col("doc_id"), max(16, d.count() // 4000)).alias("shard"), F.concat(F.lit("in/"), "doc_id", F.lit(".md")).alias("name"), F.col("text").cast("binary").alias("content"))
    pack_zips(d, folder).collect()
    return folder


@query("SELECT CAST(doc_id AS VARCHAR) AS stem, 'md' AS ext FROM documents")
def zip_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.sources.archives import index_zips, list_zips, stem

    return index_zips(list_zips(spark, zipped(spark, sf_dir))).select(stem(F.col("name")).alias("stem"), F.lit("md").alias("ext"))


@query("SELECT doc_id || '.md' AS name, md5(text) AS text_md5 FROM documents")
def zip_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.sources.archives import list_zips, read_text

    found = read_text(list_zips(spark, zipped(spark, sf_dir), content=True))
    return found.select("name", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("SELECT doc_id || '.md' AS name, CAST(doc_id % 3 AS INTEGER) AS worker, md5(text) AS text_md5 FROM documents")
def archive_split_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents zipped, split by worker, split again (which adds nothing), merged and read back."""
    from corpusmill.sources.archives import list_zips, merge_stores, read_text, split_store

    parts, merged = scratch_path(spark), scratch_path(spark)
    chunks = max(1, docs(spark, sf_dir).count() // 12000)
    members = list_zips(spark, zipped(spark, sf_dir), content=True)
    for run in ("0", "1"):
        split_store(members, None, parts, 3, run, chunks).collect()
    merge_stores(list_zips(spark, parts, content=True), merged, 3 * chunks).collect()
    worker = list_zips(spark, parts).select("name", F.regexp_extract("path", r"part_(\d+)\.[^/]*$", 1).cast("int").alias("worker"))
    return read_text(list_zips(spark, merged, content=True)).join(worker, "name").select("name", "worker", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("""SELECT url AS page_link, CASE WHEN length(url) % 3 > 0 THEN 'T ' || url END AS title, CASE WHEN length(url) % 3 > 0 THEN 1900 + length(url) END AS year, CASE WHEN length(url) % 3 > 0 THEN 'pdf:' || url END AS download_link,
CASE WHEN length(url) % 3 = 1 THEN true WHEN length(url) % 3 = 2 THEN false END AS downloaded, CASE WHEN length(url) % 3 = 1 THEN substr(md5(url), 1, 12) || '.pdf' END AS name, CASE WHEN length(url) % 3 = 1 THEN md5('pdf:' || url) END AS body_md5 FROM (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL)""")
def scrape_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All page links gathered, described and downloaded twice over, in waves, by functions that answer from the link alone."""
    from corpusmill.sources.archives import list_zips, stem
    from corpusmill.sources.fetch import Scrape

    links = table(spark, sf_dir, "pages").select(F.col("url").alias("page_link"))
    folder = scratch_path(spark)
    source = Scrape(spark, folder, "web", wave=max(100, links.count() // 4))

    def facts(url: str) -> dict | None:
        return {"title": f"T {url}", "year": 1900 + len(url), "download_link": f"pdf:{url}"} if len(url) % 3 else None

    def get(link: str) -> tuple[str, bytes]:
        return ("application/pdf; q" if len(link) % 3 == 2 else "text/html"), link.encode()

    for _ in range(2):
        state = source.run(links, facts, get)
    files = list_zips(spark, f"{folder}/files", content=True).select("name", F.md5("content").alias("body_md5"), stem(F.col("name")).alias("__stem"))
    out = state.withColumn("__stem", link_key(F.col("page_link"))).join(files, "__stem", "left")
    return out.select("page_link", "title", "year", "download_link", "downloaded", "name", "body_md5")
