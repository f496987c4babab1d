"""Queries over texts, tasks, checkpoints, near-equal titles, pages, outlines and the detector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import cleaning as C
from corpusmill.operators import detect as D
from corpusmill.operators import rewrites as R
from corpusmill.operators import texts as X
from corpusmill.plans.integration import VOTE
from corpusmill.plans.registry import query
from corpusmill.sources.io import parse_checkpoint
from corpusmill.sources.session import materialize, table

MODELS, SHARES = ["alpha", "beta"], (25, 50, 75)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


STRIP = r"regexp_replace({x}, '^[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\x{{A0}}]+|[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\x{{A0}}]+$', '', 'g')"
#: Sentences by the library's rule, merged by one-element lists in order.
SENTENCES = r"""(SELECT doc_id, lang, source, text, CASE WHEN len(raw) = 0 THEN []::VARCHAR[] ELSE list_reduce(list_transform(raw, lambda x: [x]), lambda a, x:
 CASE WHEN NOT regexp_matches(x[1], '^[A-Z]') OR regexp_matches(x[1], '^(?s:.)[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]') THEN list_concat(a[1:len(a) - 1], [a[len(a)] || ' ' || x[1]]) ELSE list_concat(a, x) END) END AS sents
 FROM (SELECT *, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]+)\s+', '\1' || chr(10), 'g'), chr(10)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS raw FROM documents))"""


def with_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).withColumn("sents", X.merged_sentences(F.col("text")))


@query(f"SELECT doc_id, CAST(len(sents) AS BIGINT) AS n, md5(array_to_string(sents, '|')) AS digest FROM {SENTENCES}")
def sentences_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_sentences(spark, sf_dir).select("doc_id", F.size("sents").cast("long").alias("n"), F.md5(F.array_join("sents", "|").cast("binary")).alias("digest"))


@query(f"SELECT doc_id, {VOTE.replace('{t}', 'text')} AS vote FROM documents")
def lang_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", X.vote_language(F.col("text")).alias("vote"))


@query()
def lang_trigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = X.learn_trigrams(docs(spark, sf_dir), "text", "lang")
    return docs(spark, sf_dir).select("doc_id", "lang", net.column(F.col("text")).alias("found"))


@query(f"""WITH s AS (SELECT doc_id, unnest(sents) AS t, generate_subscripts(sents, 1) AS i FROM {SENTENCES} WHERE lang = 'fr' AND length(text) >= 100), v AS (SELECT doc_id, i, t FROM s WHERE {VOTE.replace('{t}', 't')} = 'fr')
SELECT doc_id, count(*) AS n, md5(string_agg(t, '|' ORDER BY i)) AS digest FROM v GROUP BY doc_id""")
def select_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.select_texts(docs(spark, sf_dir), "text", "lang", "fr")
    return rows.select("doc_id", F.size("sentences").cast("long").alias("n"), F.md5(F.array_join("sentences", "|").cast("binary")).alias("digest"))


# -- tasks ----------------------------------------------------------------------------------------


def brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations, all their turns in order, as short articles with their sentences."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["text"]), " ").alias("text"))
    return c.withColumn("sents", X.merged_sentences(F.col("text")))


BRIEF = SENTENCES.replace("doc_id, lang, source, text", "conv_id, text").replace("FROM documents)", "FROM (SELECT conv_id, coalesce(string_agg(text, ' ' ORDER BY turn, role, text), '') AS text FROM conversations GROUP BY conv_id))")
TAGGED = "list_sort(list_transform(list_sort(list_transform(range(0, len(sents)), lambda i: md5(conv_id || '|' || p || '|' || i) || '|' || i))[1:greatest(1, CAST(round_even(len(sents) * (p / 100.0), 0) AS BIGINT))], lambda h: CAST(string_split(h, '|')[2] AS INTEGER)))"
TAGGED_TEXT = "array_to_string(list_transform(sents, lambda s, i: CASE WHEN list_contains(tagged, i - 1) THEN '<target>' || s || '</target>' ELSE s END), ' ')"
PENDING = f"""b AS (SELECT * FROM {BRIEF} WHERE len(sents) > 0), m AS (SELECT * FROM (VALUES ('alpha'), ('beta')) t(model)),
t AS (SELECT CAST(conv_id AS VARCHAR) AS id, model, 'sentence' AS type, CAST(generate_subscripts(sents, 1) - 1 AS INTEGER) AS sent_idx, CAST(NULL AS INTEGER) AS percentage, unnest(sents) AS text FROM b, m
 UNION ALL SELECT CAST(conv_id AS VARCHAR), model, 'percentage', NULL, p, {TAGGED_TEXT} FROM (SELECT conv_id, sents, p, {TAGGED} AS tagged FROM b, (VALUES (25), (50), (75)) q(p)), m
 UNION ALL SELECT CAST(conv_id AS VARCHAR), model, 'full_abstract', NULL, NULL, text FROM b, m),
done AS (SELECT * FROM t WHERE substr(md5(id || model || type || coalesce(sent_idx, -1) || coalesce(percentage, -1)), 1, 1) IN ('0', '1', '2', '3')),
pending AS (SELECT t.* FROM t LEFT JOIN done d ON t.id = d.id AND t.model = d.model AND t.type = d.type AND t.sent_idx IS NOT DISTINCT FROM d.sent_idx AND t.percentage IS NOT DISTINCT FROM d.percentage WHERE d.id IS NULL)"""


def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = R.all_tasks(brief(spark, sf_dir), "conv_id", "text", "sents", MODELS, SHARES)
    digest = F.md5(F.concat("id", "model", "type", F.coalesce("sent_idx", F.lit(-1)), F.coalesce("percentage", F.lit(-1))).cast("binary"))
    done = tasks.where(F.substring(digest, 1, 1).isin("0", "1", "2", "3")).withColumn("rewritten", F.lit("x"))
    return R.pending_tasks(tasks, done)


@query(f"WITH {PENDING} SELECT id, model, type, sent_idx, percentage, md5(text) AS digest FROM pending")
def pending_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pending(spark, sf_dir).select("id", "model", "type", "sent_idx", "percentage", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"WITH {PENDING} SELECT id, model, type, sent_idx FROM pending WHERE type <> 'percentage' ORDER BY CASE model WHEN 'beta' THEN 0 WHEN 'alpha' THEN 1 ELSE 99 END, CASE type WHEN 'sentence' THEN 0 ELSE 1 END, id, sent_idx")
def task_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.order_tasks(pending(spark, sf_dir).where("type <> 'percentage'"), ["beta", "alpha"]).select("id", "model", "type", "sent_idx")


@query(f"WITH {PENDING} SELECT id, model, type, sent_idx, percentage FROM (SELECT *, row_number() OVER (PARTITION BY model, type, percentage ORDER BY id, sent_idx) AS n FROM pending) WHERE n <= 5")
def debug_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_per_kind(pending(spark, sf_dir), 5).select("id", "model", "type", "sent_idx", "percentage")


@query(f"SELECT doc_id, unnest(sents) AS text, CAST(generate_subscripts(sents, 1) - 1 AS INTEGER) AS sent_idx FROM {SENTENCES}")
def sentence_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sentence_tasks(with_sentences(spark, sf_dir), "doc_id", "sents")


@query(f"SELECT conv_id, tagged, md5({TAGGED_TEXT}) AS digest FROM (SELECT conv_id, sents, {TAGGED.replace('p ', '50 ').replace(' p ', ' 50 ').replace('|| p ||', '|| 50 ||')} AS tagged FROM {BRIEF} WHERE len(sents) > 0)")
def tag_percentage(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = brief(spark, sf_dir).where(F.size("sents") > 0).withColumn("tagged", R.tagged_by_hash(F.col("conv_id"), F.lit(50), F.col("sents")))
    return b.select("conv_id", "tagged", F.md5(T.tag_targets(F.col("sents"), F.col("tagged")).cast("binary")).alias("digest"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged texts with replies that fail in every way, or pass."""
    b = brief(spark, sf_dir).where(F.size("sents") > 0).withColumn("tagged", R.tagged_by_hash(F.col("conv_id"), F.lit(50), F.col("sents")))
    tagged = T.tag_targets(F.col("sents"), F.col("tagged"))
    reply = F.expr("conv_id % 5")
    return b.withColumn("reply", F.when(reply == 0, "").when(reply == 1, F.concat(tagged, F.lit("<target>x</target>"))).when(reply == 2, F.regexp_replace(tagged, "(?s)<target>.*?</target>", "<target> </target>")).when(reply == 3, tagged).otherwise(F.regexp_replace(tagged, "(?s)<target>.*?</target>", "<TARGET>New text. </TARGET> junk")))


REPLIES = f"(SELECT conv_id, sents, tagged FROM (SELECT conv_id, sents, {TAGGED.replace('|| p ||', '|| 50 ||').replace('(p / 100.0)', '(50 / 100.0)')} AS tagged FROM {BRIEF} WHERE len(sents) > 0))"


@query(f"SELECT CASE conv_id % 5 WHEN 0 THEN 'empty' WHEN 1 THEN 'tag_count' WHEN 2 THEN 'empty_target' WHEN 3 THEN 'unchanged_target' ELSE 'success' END AS reason, count(*) AS n FROM {REPLIES} GROUP BY 1")
def validate_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.value_counts(replies(spark, sf_dir).select(R.validate(F.col("sents"), F.col("tagged"), F.col("reply"))["reason"].alias("reason")), ["reason"])


@query(f"SELECT conv_id, md5(array_to_string(list_transform(sents, lambda s, i: CASE WHEN list_contains(tagged, i - 1) THEN 'New text.' ELSE s END), ' ')) AS digest FROM {REPLIES} WHERE conv_id % 5 = 4")
def stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = replies(spark, sf_dir).select("conv_id", R.validate(F.col("sents"), F.col("tagged"), F.col("reply")).alias("v")).where("v.reason = 'success'")
    return v.select("conv_id", F.md5(F.col("v.stitched").cast("binary")).alias("digest"))


@query()
def generate_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.generate(pending(spark, sf_dir), R.swap_case, {"sentence": "Rewrite."}).select("id", "model", "type", "sent_idx", "percentage", "status", "attempts", F.md5(F.col("rewritten").cast("binary")).alias("digest"))


# -- checkpoints ----------------------------------------------------------------------------------


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkpoint of lines in both styles, with blank, truncated and unmatched ones."""
    s = R.sentence_tasks(brief(spark, sf_dir), "conv_id", "sents").withColumn("n", F.col("conv_id") * 1000 + F.col("sent_idx"))
    modern = F.to_json(F.struct(F.col("conv_id").alias("id"), F.lit("sentence").alias("type"), F.lit("alpha").alias("model"), F.col("sent_idx"), F.concat(F.lit(" "), "text").alias("text"), F.upper("text").alias("rewritten")))
    old = F.to_json(F.struct((F.col("conv_id") + F.when(F.col("n") % 10 == 4, 1_000_000).otherwise(0)).alias("_id"), F.col("sent_idx"), F.when(F.col("n") % 10 == 5, "nowhere").otherwise(F.col("text")).alias("text"), F.upper("text").alias("beta")))
    line = F.when(F.col("n") % 10 == 0, "  ").when(F.col("n") % 10 == 1, F.expr("substr(%s, 1, 20)" % "to_json(struct(conv_id, text))")).when(F.col("n") % 10 < 4, modern).otherwise(old)
    return s.select(line.alias("value"))


@query(f"""WITH s AS (SELECT conv_id, generate_subscripts(sents, 1) - 1 AS i, unnest(sents) AS t FROM {BRIEF}), l AS (SELECT *, (conv_id * 1000 + i) % 10 AS n FROM s), f AS (SELECT conv_id, t, min(i) AS fi FROM s GROUP BY conv_id, t),
c AS (SELECT CASE WHEN n = 0 THEN 'blank' WHEN n = 1 THEN 'corrupt' ELSE 'ok' END AS status, CASE WHEN n < 2 OR n = 4 THEN 'id_missing' WHEN n = 5 THEN 'text_missing' ELSE 'matched' END AS found, CASE WHEN n > 1 AND n NOT IN (4, 5) THEN fi END AS fi FROM l LEFT JOIN f ON l.conv_id = f.conv_id AND l.t = f.t)
SELECT status, found, count(*) AS n, CAST(coalesce(sum(fi), 0) AS BIGINT) AS positions FROM c GROUP BY status, found""")
def checkpoint_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    sentences = R.sentence_tasks(brief(spark, sf_dir), "conv_id", "sents").withColumnRenamed("conv_id", "id")
    aligned = R.align(parse_checkpoint(log_lines(spark, sf_dir)), sentences)
    return aligned.groupBy("status", "found").agg(F.count("*").alias("n"), F.coalesce(F.sum("sent_idx"), F.lit(0)).cast("long").alias("positions"))


@query(f"""WITH s AS (SELECT conv_id, generate_subscripts(sents, 1) - 1 AS i FROM {BRIEF}), l AS (SELECT (conv_id * 1000 + i) % 10 AS n FROM s)
SELECT count(*) FILTER (n > 1) AS loaded, count(*) FILTER (n > 1 AND n NOT IN (4, 5)) AS matched, 0::BIGINT AS other, count(*) FILTER (n = 5) AS unmatched, count(*) FILTER (n = 4) AS id_missing, count(*) FILTER (n = 1) AS corrupt, count(*) FILTER (n = 0) AS blank FROM l""")
def checkpoint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    sentences = R.sentence_tasks(brief(spark, sf_dir), "conv_id", "sents").withColumnRenamed("conv_id", "id")
    return R.align_report(R.align(parse_checkpoint(log_lines(spark, sf_dir)), sentences))


@query(f"""WITH s AS (SELECT conv_id, unnest(sents) AS t FROM {BRIEF}), m AS (SELECT unnest(['alpha', 'beta', 'gamma']) AS model), done AS (SELECT DISTINCT conv_id, t FROM s WHERE conv_id % 2 = 0)
SELECT s.conv_id, model, count(*) AS n FROM s, m WHERE NOT (model = 'beta' AND EXISTS (SELECT 1 FROM done d WHERE d.conv_id = s.conv_id AND d.t = s.t)) GROUP BY 1, 2""")
def older_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences times three models, of which one has written older lines for half the conversations."""
    tasks = R.sentence_tasks(brief(spark, sf_dir), "conv_id", "sents").withColumnRenamed("conv_id", "id").select("id", "sent_idx", "text")
    lines = R.older_lines(tasks.where("id % 2 = 0").withColumn("model", F.lit("beta")).withColumn("rewritten", F.upper("text")))
    due = R.older_pending(tasks, parse_checkpoint(lines).where("status = 'ok'"), ["alpha", "beta", "gamma"])
    return due.groupBy(F.col("id").alias("conv_id"), "model").agg(F.count("*").alias("n"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of rewrites: key (user_id, event_type), some values null."""
    return table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.expr("CASE WHEN event_id % 6 <> 0 THEN value END").alias("v"))


LOG = "(SELECT user_id, event_type, event_id, CASE WHEN event_id % 6 <> 0 THEN value END AS v FROM events)"


@query(f"""WITH m AS (SELECT user_id, event_type, min_by([v], event_id) AS x FROM {LOG} WHERE event_id % 4 = 0 AND event_type <> 'click' GROUP BY ALL), a AS (SELECT user_id, event_type, min_by([v], event_id) AS x FROM {LOG} WHERE event_id % 4 <> 0 GROUP BY ALL)
SELECT coalesce(m.user_id, a.user_id) AS user_id, coalesce(m.event_type, a.event_type) AS event_type, CASE WHEN m.x IS NOT NULL THEN m.x[1] ELSE a.x[1] END AS v FROM m FULL JOIN a ON m.user_id = a.user_id AND m.event_type = a.event_type""")
def merge_fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    return R.fill_missing(log.where("event_id % 4 = 0 AND event_type <> 'click'"), log.where("event_id % 4 <> 0"), ["user_id", "event_type"], "v", "event_id")


@query(f"SELECT user_id, event_type, max_by([v], [event_id % 4 = 0, event_id])[1] AS v FROM (SELECT user_id, event_type, v, event_id FROM {LOG}) WHERE user_id % 3 <> 0 GROUP BY ALL")
def merge_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    return R.last_wins([log.where("event_id % 4 <> 0"), log.where("event_id % 4 = 0")], ["user_id", "event_type"], "v", "event_id", log.where("user_id % 3 <> 0"))


@query(f"""WITH s AS (SELECT conv_id, CAST(generate_subscripts(sents, 1) - 1 AS INTEGER) AS i, unnest(sents) AS t, len(sents) AS n FROM {BRIEF}), l AS (SELECT conv_id, trim(t) AS t, max_by('r' || t || i, i) AS r FROM s WHERE i % 3 <> 1 GROUP BY ALL),
h AS (SELECT s.conv_id AS conv_id, i, r FROM s LEFT JOIN l ON s.conv_id = l.conv_id AND trim(s.t) = l.t)
SELECT CAST(conv_id AS VARCHAR) AS id, 'alpha' AS model, count(*) AS slots, count(r) AS filled, md5(string_agg(coalesce(r, '-'), '|' ORDER BY i)) AS digest FROM h GROUP BY conv_id HAVING count(r) > 0""")
def merge_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = brief(spark, sf_dir)
    log = R.sentence_tasks(b, "conv_id", "sents").where("sent_idx % 3 <> 1").select(F.col("conv_id").cast("string").alias("id"), F.lit("alpha").alias("model"), T.strip(F.col("text")).alias("text"), F.concat(F.lit("r"), "text", "sent_idx").alias("rewritten"), "sent_idx")
    merged = R.last_wins([log], ["id", "model", "text"], "rewritten", "sent_idx", skip_null=True)
    out = R.scatter(b, "conv_id", "sents", merged, "rewritten")
    return out.select("id", "model", F.size("values").cast("long").alias("slots"), F.size(F.filter("values", lambda x: x.isNotNull())).cast("long").alias("filled"), F.md5(F.array_join("values", "|", "-").cast("binary")).alias("digest"))


@query(f"""WITH s AS (SELECT conv_id, CAST(generate_subscripts(sents, 1) - 1 AS INTEGER) AS i, unnest(sents) AS t FROM {BRIEF}), f AS (SELECT conv_id, list('r' || t ORDER BY i) AS single FROM s GROUP BY conv_id)
SELECT CAST(f.conv_id AS VARCHAR) AS id, 'alpha' AS model, md5(array_to_string(single, '|')) AS single, md5('r' || b.text) AS full_text, 'half' AS p50 FROM f JOIN {BRIEF} b ON f.conv_id = b.conv_id""")
def rewrites_to_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = brief(spark, sf_dir).where(F.size("sents") > 0).withColumn("id", F.col("conv_id").cast("string"))
    none = F.lit(None).cast("int")
    cells = R.sentence_tasks(b, "id", "sents").select("id", F.lit("sentence").alias("type"), "sent_idx", none.alias("percentage"), F.concat(F.lit("r"), "text").alias("rewritten"))
    rest = b.select("id", F.lit("full_abstract").alias("type"), none.alias("sent_idx"), none.alias("percentage"), F.concat(F.lit("r"), "text").alias("rewritten")).unionByName(b.select("id", F.lit("percentage").alias("type"), none.alias("sent_idx"), F.lit(50).alias("percentage"), F.lit("half").alias("rewritten")))
    wide = R.to_wide(cells.unionByName(rest).withColumn("model", F.lit("alpha")).withColumn("ord", F.lit(1)))
    return wide.select("id", "model", F.md5(F.array_join("single", "|").cast("binary")).alias("single"), F.md5(F.col("full_text").cast("binary")).alias("full_text"), "p50")


# -- scalar functions -----------------------------------------------------------------------------


@query(r"""SELECT doc_id, md5(trim(regexp_replace(translate('  “Quoted” ‘it’s`' || chr(10) || text || chr(9), '‘’“”`', '''''""'''), '\s+', ' ', 'g'))) AS digest FROM documents""")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(T.normalize_text(F.concat(F.lit("  “Quoted” ‘it’s`\n"), "text", F.lit("\t"))).cast("binary")).alias("digest"))


@query(r"""WITH s AS (SELECT page_id, regexp_replace(CASE page_id % 5 WHEN 0 THEN 'con.txt' WHEN 1 THEN ' ..?.. ' WHEN 2 THEN '...' ELSE url END, '[\\/:"*?<>|]', '_', 'g') AS n FROM pages), r AS (SELECT page_id, regexp_replace(CASE WHEN upper(regexp_extract(n, '^(\.*.*?)(\.[^.]*)?$', 1)) IN ('CON', 'NUL') THEN '_' || n ELSE n END, '^[ .]+|[ .]+$', '', 'g') AS n FROM s)
SELECT page_id, CASE WHEN n = '' THEN '_empty_filename_' ELSE n END AS name, regexp_replace(plain, '^\.+|\.+$', '', 'g') AS plain FROM r JOIN (SELECT page_id AS pid, trim(regexp_replace(url, '[^A-Za-z0-9\-_ ËéèêëôöûüàâäîïçÏ]', '_', 'g')) AS plain FROM pages) ON page_id = pid""")
def sanitize_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("CASE page_id % 5 WHEN 0 THEN 'con.txt' WHEN 1 THEN ' ..?.. ' WHEN 2 THEN '...' ELSE url END")
    return table(spark, sf_dir, "pages").select("page_id", T.safe_filename(raw).alias("name"), T.plain_filename(F.col("url")).alias("plain"))


@query(r"""SELECT page_id, regexp_extract(url, '([^/]+?)(\.[^./]*)?$', 1) AS stem, CASE WHEN page_id % 3 = 0 THEN 'pdf' WHEN regexp_extract(string_split(url, '?')[1], '\.([^.]+)$', 1) IN ('pdf', 'docx') THEN regexp_extract(string_split(url, '?')[1], '\.([^.]+)$', 1) WHEN page_id % 3 = 1 THEN 'bin' END AS kind FROM pages""")
def stem_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.sources.archives import stem

    mime = F.expr("CASE page_id % 3 WHEN 0 THEN 'Application/PDF; charset=x' WHEN 1 THEN 'application/octet-stream' ELSE 'text/x' END")
    return table(spark, sf_dir, "pages").select("page_id", stem(F.col("url")).alias("stem"), T.file_kind(mime, F.col("url")).alias("kind"))


@query("SELECT conv_id, turn, md5(CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN 'final ' || length(text) ELSE text END) AS digest FROM (SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations)")
def clean_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("text", T.strip(F.col("text")))
    reply = F.when(F.col("turn") % 3 == 0, F.concat(F.lit(' "'), "text", F.lit('"\n'))).when(F.col("turn") % 3 == 1, F.concat(F.lit("think <channel|> final "), F.length("text"), F.lit(" <channel|> more"))).otherwise(F.concat(F.lit("\0"), "text"))
    return c.select("conv_id", "turn", F.md5(T.clean_reply(reply, F.lit("source")).cast("binary")).alias("digest"))


@query()
def seed_crc32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", T.task_seed(F.col("o_orderkey"), F.lit(25)).alias("seed"))


# -- titles, pages, outlines ----------------------------------------------------------------------

_SORTED = "array_to_string(list_sort(string_split(p_name, ' ')), ' ')"


@query(f"""WITH t AS (SELECT DISTINCT p_name AS t, {_SORTED} AS s FROM part), p AS (SELECT a.t AS t1, b.t AS t2, a.s AS x, b.s AS y FROM t a, t b),
l AS (SELECT t1, t2, length(x) + length(y) AS n, list_reduce(list_concat([list_transform(range(0, length(y) + 1), lambda i: 0)], list_transform(string_split(x, ''), lambda c: [unicode(c)])), lambda r, c: list_reduce(list_concat([[0]], list_transform(range(1, length(y) + 1), lambda j: [j])), lambda acc, j: list_concat(acc, [CASE WHEN unicode(substr(y, j[1], 1)) = c[1] THEN r[j[1]] + 1 ELSE greatest(r[j[1] + 1], acc[j[1]]) END])))[length(y) + 1] AS lcs FROM p),
k AS (SELECT t1, t2, 200.0::DOUBLE * lcs / n AS score FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY t1 ORDER BY score DESC, t2) AS pos FROM k WHERE score >= 60)
SELECT t1, t2, score FROM r WHERE pos <= 5 AND t1 <> t2""")
def fuzzy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.fuzzy_pairs(table(spark, sf_dir, "part"), "p_name")


@query()
def fuzzy_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id"), F.min("p_brand").alias("author"))
    return X.resolve_fuzzy(p.select("id", F.col("p_name").alias("title"), "author"), "title", "author", "id")


@query("SELECT source, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source HAVING count(*) > 1")
def repeated_author_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.repeated_authors(docs(spark, sf_dir).select("doc_id", "source"), "source", table(spark, sf_dir, "labels"), "doc_id")


@query(r"""SELECT page_id, trim(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)) AS h1, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1) AS lang, CAST(len(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1))) AS BIGINT) AS n_links FROM pages""")
def html_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", *[c.alias(n) for n, c in X.page_facts(F.col("html")).items()])


@query("""SELECT doc_id, 3 AS chapters, CAST(6 + (doc_id % 2) AS BIGINT) AS blocks FROM documents""")
def outline_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_replace("text", r"(?U)\s+", " ")
    parts = [F.lit("lead text"), F.lit("# One"), F.concat(F.lit("p "), words), F.lit("## Two\n\n- a\n- b\n\n### Deep"), F.concat(F.lit("q "), words), F.lit("para\ngoes on"), F.lit("# Last\n\n## Sub"), F.lit("end"), F.expr("CASE WHEN doc_id % 2 = 1 THEN 'more' ELSE '' END")]
    md = docs(spark, sf_dir).select("doc_id", F.concat_ws("\n\n", *parts).alias("md"))
    return X.outline(md, "doc_id", "md").groupBy("doc_id").agg(F.count_distinct("chapter_no").cast("int").alias("chapters"), F.count("*").alias("blocks"))


_BODY = r"trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\f\v]+', ' ', 'g'))"


@query(f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Introduction' ELSE 'One "1"' END AS title, '{{"title": ' || CASE WHEN doc_id % 2 = 0 THEN '"Introduction"' ELSE '"One \\"1\\""' END || ', "chapters": ['
|| CASE WHEN doc_id % 2 = 0 THEN '{{"type": "chapter", "title": "Introduction", "content": [{{"type": "text", "value": "lead"}}]}}, ' ELSE '' END
|| '{{"type": "chapter", "title": "One \\"1\\"", "content": [{{"type": "text", "value": ' || to_json(trim('p ' || {_BODY})) || '}}, {{"type": "section", "title": "Two", "level": 2, "content": [{{"type": "list_container", "value": "a | b"}}, {{"type": "section", "title": "Deep", "level": 4, "content": []}}]}}, {{"type": "section", "title": "Sub", "level": 2, "content": [{{"type": "text", "value": "end"}}]}}]}}, '
|| '{{"type": "chapter", "title": "Last", "content": []}}]}}' AS tree FROM documents""")
def outline_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\n\r\f\x0B]+", " "))
    parts = [F.expr("CASE WHEN doc_id % 2 = 0 THEN 'lead' ELSE '- early' END"), F.lit('# One "1"'), F.concat(F.lit("p "), words), F.lit("## Two\n\n- a\n- b\n\n#### Deep\n\n## Sub\nend\n# Last")]
    return X.outline_trees(docs(spark, sf_dir).select("doc_id", F.concat_ws("\n\n", *parts).alias("md")), "doc_id", "md")



# -- detector -------------------------------------------------------------------------------------


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of all turns with two stub rewrites, some blank or failed."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "text")
    return c.select("id", "text", F.expr("CASE WHEN id % 5 = 0 THEN 'FAILED_VALIDATION' ELSE concat('As noted, ', lower(text)) END").alias("alpha"), F.expr("CASE WHEN id % 4 = 0 THEN ' ' ELSE concat(text, ' In sum, so it is.') END").alias("beta"))


LONG = "(SELECT conv_id AS abstract_id, text, 0 AS label FROM conversations UNION ALL SELECT conv_id, 'As noted, ' || lower(text), 1 FROM conversations WHERE conv_id % 5 <> 0 UNION ALL SELECT conv_id, text || ' In sum, so it is.', 1 FROM conversations WHERE conv_id % 4 <> 0)"


@query(f"SELECT abstract_id, label, md5(text) AS digest FROM {LONG}")
def long_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.long_labels(labelled(spark, sf_dir), "id", "text", MODELS).select("abstract_id", "label", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"SELECT label, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM {LONG} GROUP BY label")
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.value_counts(D.long_labels(labelled(spark, sf_dir), "id", "text", MODELS).select("label"), ["label"], share=True)


@query("""WITH g AS (SELECT DISTINCT doc_id, md5(CAST(doc_id AS VARCHAR)) AS h FROM labels), r AS (SELECT doc_id, row_number() OVER (ORDER BY h) AS k, count(*) OVER () AS n FROM g)
SELECT l.doc_id AS doc_id, quality, k <= ceil(0.2 * n) AS is_test FROM labels l JOIN r ON l.doc_id = r.doc_id""")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.group_split(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


@query(r"""WITH g AS (SELECT item_id, regexp_replace(lower(text), '\s\s+', ' ', 'g') AS t FROM benchmark), x AS (SELECT item_id, substr(t, i, k) AS term FROM (SELECT item_id, t, k, unnest(range(1, length(t) - k + 2)) AS i FROM g, (VALUES (3), (4), (5)) q(k))),
c AS (SELECT item_id, term, count(*) AS tf FROM x GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM c GROUP BY term), w AS (SELECT item_id, c.term AS term, (1 + ln(tf)) * (ln((1.0 + (SELECT count(DISTINCT item_id) FROM benchmark)) / (1 + df)) + 1) AS w FROM c JOIN d ON c.term = d.term)
SELECT item_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 6) AS weight FROM w""")
def char_ngram_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.tfidf_table(table(spark, sf_dir, "benchmark"), "item_id", "text").withColumn("weight", F.round("weight", 6))


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(abstract_id, text, label): every labelled document that isn't blank, with its quality."""
    labels = table(spark, sf_dir, "labels").where("quality IS NOT NULL").select("doc_id", F.col("quality").alias("label"))
    rows = docs(spark, sf_dir).select("doc_id", "text").join(labels, "doc_id").select(F.col("doc_id").alias("abstract_id"), "text", "label")
    return rows.where(T.strip(F.coalesce(F.col("text"), F.lit(""))) != "")


@query()
def svm_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.group_split(materialize(rated(spark, sf_dir)), "abstract_id")
    net = D.Detector().fit(rows.where(~F.col("is_test")))
    scored = materialize(net.score(rows.where("is_test")).select("label", "score", "prediction"))
    return D.report(scored).crossJoin(F.broadcast(D.auc(scored, "score", "label")))


@query("SELECT CAST(a AS INTEGER) AS label, CAST(b AS INTEGER) AS prediction, (SELECT count(*) FROM labels WHERE quality = a AND CAST((doc_id * 37) % 101 > 50 AS INTEGER) = b) AS n FROM range(2) x(a), range(2) y(b)")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "labels").select(F.col("quality").alias("label"), ((F.col("doc_id") * 37) % 101 > 50).cast("int").alias("prediction"))
    return D.confusion(said)


@query()
def top_coefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.Detector().fit(rated(spark, sf_dir)).strongest(spark, sides=("quality 0", "quality 1"))


@query("""WITH s AS (SELECT quality AS label, (doc_id * 37) % 101 AS score FROM labels), p AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM s GROUP BY score), r AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM p)
SELECT round(CAST(sum(pos * (below + neg / 2)) AS DOUBLE) / (sum(pos) * sum(neg)), 9) AS auc FROM r""")
def auc_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "labels").select(F.col("quality").alias("label"), ((F.col("doc_id") * 37) % 101).alias("score"))
    return D.auc(s, "score", "label").withColumn("auc", F.round("auc", 9))


@query("SELECT label, count(*) AS n FROM (SELECT 0 AS label FROM conversations UNION ALL SELECT 1 FROM conversations) GROUP BY label")
def human_machine_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    both = D.mix_labels(rows.select(F.col("id").alias("source_id"), "text"), rows.select(F.col("id").alias("source_id"), F.col("alpha").alias("text")), "source_id")
    return C.value_counts(both.select("label"), ["label"])
