"""The engine's operators as queries over the tables at hand, each with its SQL.

``events`` serve as activity log, ``documents`` with ``embeddings`` as indexed
chunks, ``conversations`` as application log, ``supplier`` / ``part`` /
``lineitem`` as servers, their tools and their switches, ``customer`` /
``nation`` / ``region`` as keys, groups and scopes, ``orders`` as tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import json as js
from tidewell.functions import numbers as num
from tidewell.functions import text as txt
from tidewell.operators import activity, catalog, cost, documents, scope, search, skills, versions
from tidewell.plans import mutations

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

NOW = "2024-01-31 00:00:00"


def query(sql: str | None = None, name: str | None = None):
    """Register a function under its name, with the SQL that must give the same rows."""

    def keep(fn: Query) -> Query:
        QUERIES[name or fn.__name__] = fn
        if sql:
            ORACLES[name or fn.__name__] = sql
        return fn

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- activity log ------------------------------------------------------------

ACTIVITY = """(SELECT event_id AS id, ts AS created_at, CAST(user_id AS VARCHAR) AS server, event_type AS tool, value AS duration_ms,
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status, props AS input FROM events) a"""
FOLD = "translate(tool, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
STATS = """count(*) AS total, coalesce(sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END), 0)::BIGINT AS success,
  coalesce(sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END), 0)::BIGINT AS errors, round(coalesce(avg(duration_ms), 0), 6) AS avg_duration"""


def activity_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("user_id").cast("string").alias("server"), F.col("event_type").alias("tool"),
        F.col("value").alias("duration_ms"), F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"), F.col("props").alias("input"),
    )


@query(f"SELECT {STATS} FROM {ACTIVITY}")
def activity_stats(spark, sf_dir):
    return activity.activity_stats(activity_log(spark, sf_dir))


@query(f"SELECT {STATS} FROM {ACTIVITY} WHERE status = 'success' AND {FOLD} LIKE '%c_ick%'")
def activity_stats_filtered(spark, sf_dir):
    return activity.activity_stats(activity_log(spark, sf_dir), activity.activity_filter(status="success", tool="C_ick"))


@query(f"SELECT {STATS} FROM {ACTIVITY} WHERE server = 'nobody'")
def activity_stats_empty(spark, sf_dir):
    return activity.activity_stats(activity_log(spark, sf_dir), activity.activity_filter(server="nobody"))


@query(f"SELECT {STATS} FROM {ACTIVITY} WHERE created_at >= '2024-01-10' AND created_at < '2024-01-20'")
def activity_stats_period(spark, sf_dir):
    return activity.activity_stats(activity_log(spark, sf_dir), activity.activity_filter(since="2024-01-10 00:00:00", until="2024-01-20 00:00:00"))


@query(f"SELECT id, created_at, server, tool, duration_ms, status FROM {ACTIVITY} WHERE status = 'error' ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 50")
def activity_page(spark, sf_dir):
    where = activity.activity_filter(status="error")
    return activity.newest_page(activity_log(spark, sf_dir), 2, 50, where=where).select("id", "created_at", "server", "tool", "duration_ms", "status")


@query(f"SELECT id, tool FROM {ACTIVITY} ORDER BY created_at DESC, id DESC LIMIT 200")
def activity_page_clamped(spark, sf_dir):
    return activity.newest_page(activity_log(spark, sf_dir), 0, 500).select("id", "tool")


@query(f"SELECT count(*) AS total FROM {ACTIVITY} WHERE status = 'error'")
def activity_total(spark, sf_dir):
    return activity_log(spark, sf_dir).where(activity.activity_filter(status="error")).agg(F.count("*").alias("total"))


@query("SELECT conv_id, turn, role, text FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 50")
def app_log_page(spark, sf_dir):
    return read(spark, sf_dir, "conversations").orderBy(F.desc("conv_id"), F.desc("turn")).limit(activity.page_bounds(1, None, 50)[1]).select("conv_id", "turn", "role", "text")


@query(f"SELECT DISTINCT server FROM {ACTIVITY} WHERE server <> ''")
def activity_servers(spark, sf_dir):
    return activity.distinct_values(activity_log(spark, sf_dir), "server")


@query(f"SELECT tool, count(*) AS n FROM {ACTIVITY} WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 15 DAY GROUP BY tool")
def activity_retention(spark, sf_dir):
    return activity.retain(activity_log(spark, sf_dir), NOW, 15).groupBy("tool").agg(F.count("*").alias("n"))


@query(f"SELECT count(*) FILTER (created_at < TIMESTAMP '{NOW}' - INTERVAL 15 DAY) AS deleted, count(*) FILTER (NOT created_at < TIMESTAMP '{NOW}' - INTERVAL 15 DAY) AS kept FROM {ACTIVITY}")
def retention_counts(spark, sf_dir):
    return activity.retention_counts(activity_log(spark, sf_dir), NOW, 15)


@query("SELECT day, count(*) AS n FROM (SELECT strftime(ts, '%Y-%m-%d') AS day FROM events) WHERE day >= '2024-01-16' GROUP BY day")
def retention_day_files(spark, sf_dir):
    files = read(spark, sf_dir, "events").select(F.concat(F.lit("app-"), F.date_format("ts", "yyyy-MM-dd"), F.lit(".log")).alias("path"))
    return activity.retain_day_files(files, "2024-01-16").groupBy(F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})", 1).alias("day")).agg(F.count("*").alias("n"))


@query(f"SELECT id, CAST(NULL AS VARCHAR) AS input FROM {ACTIVITY}")
def activity_without_payload(spark, sf_dir):
    return activity.without_payload(activity_log(spark, sf_dir), False, ("input",)).select("id", "input")


@query(f"""SELECT strftime(created_at, '%Y-%m-%d') AS day, '[' || strftime(created_at, '%Y-%m-%d %H:%M:%S') || '] [' || status || '] ' ||
  CASE WHEN tool = 'view' THEN '' ELSE '[' || server || '] ' END || tool AS line FROM {ACTIVITY}""")
def activity_log_lines(spark, sf_dir):
    log = activity_log(spark, sf_dir).select("created_at", F.col("status").alias("level"), F.when(F.col("tool") != "view", F.col("server")).alias("server_name"), F.col("tool").alias("message"))
    return activity.log_lines(log)


@query("""SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'the') AND role IN ('user', 'assistant') AND role IN ('user')""")
def app_log_view(spark, sf_dir):
    log = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("message"), F.col("role").alias("level"), F.col("role").alias("source"))
    return activity.view_filter(log, "The", ["user", "assistant"], ["user"]).select("conv_id", "turn")


@query("SELECT conv_id, turn, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def app_log_tail(spark, sf_dir):
    return activity.tail(read(spark, sf_dir, "conversations"), 3, ["conv_id"], ["turn"]).select("conv_id", "turn", "text")


@query("""SELECT o_orderkey, o_orderdate, 3 AS page, (SELECT count(*) FROM orders) AS total, ((SELECT count(*) FROM orders) + 24) // 25 AS total_pages,
  3 < ((SELECT count(*) FROM orders) + 24) // 25 AS has_next, true AS has_prev FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25 OFFSET 50""")
def page_clamped(spark, sf_dir):
    page = activity.clamped_page(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 3, 25)
    return page.withColumn("total_pages", F.col("total_pages").cast("bigint"))


@query("""SELECT p_partkey, page FROM (SELECT p_partkey, ((count(*) OVER () + 29) // 30)::INTEGER AS page, row_number() OVER (ORDER BY p_partkey) AS rn, count(*) OVER () AS n
  FROM part WHERE p_size = 10) WHERE rn > (page - 1) * 30""")
def page_past_end(spark, sf_dir):
    return activity.clamped_page(read(spark, sf_dir, "part").where("p_size = 10").select("p_partkey"), ["p_partkey"], 9999, 30).select("p_partkey", "page")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 40")
def cursor_page(spark, sf_dir):
    return activity.after_cursor(read(spark, sf_dir, "orders"), "o_orderkey", 1000, 40).select("o_orderkey", "o_totalprice")


@query("""SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n_events FROM (
  SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nr FROM (
    SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 5 MINUTE THEN 1 ELSE 0 END AS opens FROM events))
  GROUP BY user_id, nr""")
def idle_sessions(spark, sf_dir):
    from tidewell.streaming.sessions import idle_sessions as run

    return run(read(spark, sf_dir, "events"), "user_id", "ts")


# ---- vectors and search ------------------------------------------------------

PROBE = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)"
TERMS = "the of ouon"
CHUNKS = f"""chunks AS (SELECT d.doc_id, 0::BIGINT AS chunk_index, 'doc-' || d.doc_id || '.md' AS doc_name, d.text AS chunk_text, [d.lang, d.source] AS tags,
  CASE WHEN d.doc_id % 3 = 0 THEN '' ELSE upper(d.lang) || ' ' || d.doc_id END AS title,
  list_cosine_similarity(e.embedding::DOUBLE[], {PROBE}) AS cos FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id)"""


def probe_vector(spark: SparkSession, sf_dir: str, vec_id: int = 7) -> list[float]:
    """A stored vector as the query's; one row, by key."""
    return read(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]


def indexed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, e = read(spark, sf_dir, "documents"), read(spark, sf_dir, "embeddings")
    return d.join(e, d.doc_id == e.vec_id).select(
        "doc_id", F.lit(0).cast("bigint").alias("chunk_index"), F.format_string("doc-%d.md", "doc_id").alias("doc_name"), F.col("text").alias("chunk_text"),
        F.array("lang", "source").alias("tags"), "embedding",
    )


def doc_titles_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.upper("lang"), F.lit(" "), F.col("doc_id").cast("string"))).alias("title"))


def hybrid_sql(vw: float, kw: float, limit: int, threshold: float, tags: str = "") -> str:
    fetch = limit * (4 if tags else 2)
    n = len(TERMS.split())
    hits = " + ".join(f"CASE WHEN contains(lower(chunk_text), '{t}') THEN 1 ELSE 0 END" for t in TERMS.split())
    any_hit = " OR ".join(f"contains(lower(chunk_text), '{t}')" for t in TERMS.split())
    tag = f"WHERE len(list_filter(tags, lambda t: lower(t) IN ({tags}))) > 0" if tags else ""
    return f"""WITH {CHUNKS},
v AS (SELECT doc_id, chunk_index, greatest(0, least(1, cos)) AS vs FROM chunks WHERE {vw} > 0 ORDER BY 1 - cos, doc_id, chunk_index LIMIT {fetch}),
k AS (SELECT doc_id, chunk_index, ({hits}) / {n}.0::DOUBLE AS ks FROM chunks WHERE {kw} > 0 AND ({any_hit}) ORDER BY doc_id, chunk_index LIMIT {fetch}),
m AS (SELECT doc_id, chunk_index, {vw}::DOUBLE * coalesce(vs, 0::DOUBLE) + {kw}::DOUBLE * coalesce(ks, 0::DOUBLE) AS score FROM v FULL OUTER JOIN k USING (doc_id, chunk_index))
SELECT doc_id, doc_name, coalesce(nullif(title, ''), doc_name) AS title, md5(chunk_text) AS snippet, round(score, 6) AS score
FROM (SELECT * FROM m JOIN chunks USING (doc_id, chunk_index) {tag}) WHERE score >= {threshold} ORDER BY score DESC, doc_id, chunk_index LIMIT {limit}"""


def hybrid(settings: search.Settings, tags: list[str] | None = None) -> Query:
    def run(spark, sf_dir):
        out = search.hybrid_search(indexed_chunks(spark, sf_dir), TERMS, probe_vector(spark, sf_dir), settings, tags, doc_titles_table(spark, sf_dir))
        return out.withColumns({"snippet": F.md5("snippet"), "score": F.round("score", 6)})

    return run


query(hybrid_sql(0.9, 0.1, 20, 0.05), "hybrid_search")(hybrid(search.Settings(score_threshold=0.05)))
query(hybrid_sql(0.9, 0.1, 20, 0.65), "hybrid_search_defaults")(hybrid(search.Settings()))
query(hybrid_sql(0.7, 0.3, 10, 0.1, "'en', 'src3'"), "hybrid_search_tags")(hybrid(search.Settings(0.7, 0.3, 10, 0.1), ["EN", "src3"]))
query(hybrid_sql(1.0, 0.0, 15, 0.1), "hybrid_vector_only")(hybrid(search.Settings(1.0, 0.0, 15, 0.1)))
query(hybrid_sql(0.0, 1.0, 15, 0.5), "hybrid_keyword_only")(hybrid(search.Settings(0.0, 1.0, 15, 0.5)))
query(hybrid_sql(0.5, 0.5, 30, 0.0), "hybrid_low_threshold")(hybrid(search.Settings(0.5, 0.5, 30, -1.0)))


@query(f"SELECT vec_id AS doc_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], {PROBE}), 6) AS distance FROM embeddings ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], {PROBE}), vec_id LIMIT 10")
def knn_topk(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return search.nearest(e, probe_vector(spark, sf_dir), 10, ["doc_id"]).select("doc_id", F.round("distance", 6).alias("distance"))


@query(f"""SELECT label, count(*) AS votes, round(avg(s), 6) AS mean_score FROM (SELECT label, greatest(0, list_cosine_similarity(embedding::DOUBLE[], {PROBE})) AS s FROM embeddings
  ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], {PROBE}), vec_id LIMIT 25) GROUP BY label""")
def knn_label_vote(spark, sf_dir):
    e, v = read(spark, sf_dir, "embeddings"), probe_vector(spark, sf_dir)
    best = search.nearest(e, v, 25, ["vec_id"]).withColumn("s", num.cosine_score("embedding", num.literal_vector(v)))
    return best.groupBy("label").agg(F.count("*").alias("votes"), F.round(F.avg("s"), 6).alias("mean_score"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id AS doc_id, list_cosine_similarity(embedding::DOUBLE[], v) AS c FROM q, embeddings)
SELECT query_id, doc_id, round(c, 5) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY c DESC, doc_id) <= 5""")
def knn_batch(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    chunks = e.select(F.col("vec_id").alias("doc_id"), F.lit(0).cast("bigint").alias("chunk_index"), "embedding")
    return search.nearest_to_each(asked, chunks, 5).select("query_id", "doc_id", F.round("score", 5).alias("score"))


@query("""SELECT doc_id, round((contains(lower(text), 'the')::INT + contains(lower(text), 'ouon')::INT + contains(lower(text), 'the')::INT) / 3.0::DOUBLE, 6) AS ratio
  FROM documents WHERE contains(lower(text), 'the') OR contains(lower(text), 'ouon') ORDER BY doc_id LIMIT 40""")
def keyword_search(spark, sf_dir):
    chunks = read(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("chunk_index"), F.col("text").alias("chunk_text"))
    return search.keyword_hits(chunks, "the Ouon the", 40).select("doc_id", F.round(search.match_ratio(F.col("chunk_text"), "the Ouon the"), 6).alias("ratio"))


@query("SELECT doc_id FROM documents WHERE lower(text) LIKE '%t_e%' ORDER BY doc_id LIMIT 30")
def keyword_search_wildcard(spark, sf_dir):
    chunks = read(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("chunk_index"), F.col("text").alias("chunk_text"))
    return search.keyword_hits(chunks, "t_e", 30).select("doc_id")


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm_before, round(sqrt(list_sum(list_transform(list_transform(embedding::DOUBLE[],
  lambda x: x / (sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y))) + 1e-12)), lambda x: x * x))), 6) AS norm_after FROM embeddings""")
def l2_normalize(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").withColumn("n", num.l2_normalize("embedding"))
    return e.select("vec_id", F.round(num.norm(num.as_doubles("embedding")), 6).alias("norm_before"), F.round(num.norm(F.col("n")), 6).alias("norm_after"))


@query("""SELECT label, pos::INTEGER AS pos, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY label, pos""")
def mean_vector(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("label", F.posexplode(num.as_doubles("embedding")).alias("pos", "x"))
    return e.groupBy("label", "pos").agg(F.round(F.avg("x"), 6).alias("mean"))


@query("""SELECT vec_id, round((embedding[1]::DOUBLE + embedding[3]::DOUBLE) / (2 + 1e-9), 6) AS mean0, round(embedding[1]::DOUBLE, 6) AS first0, round(embedding[3]::DOUBLE, 6) AS last0 FROM embeddings""")
def pooling_modes(spark, sf_dir):
    at = lambda i: F.array(F.element_at(num.as_doubles("embedding"), i))
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.array(at(1), at(2), at(3), at(4)).alias("t"), F.array(F.lit(1), F.lit(0), F.lit(1), F.lit(0)).alias("m"))
    return e.select("vec_id", *(F.round(num.pool("t", "m", mode)[0], 6).alias(n) for mode, n in ((1, "mean0"), (2, "first0"), (3, "last0"))))


# ---- documents ---------------------------------------------------------------


@query("SELECT tag, count(*) AS file_count FROM (SELECT DISTINCT doc_id, unnest([lang, source, lang]) AS tag FROM documents) WHERE tag <> '' GROUP BY tag")
def tag_stats(spark, sf_dir):
    return documents.tag_stats(read(spark, sf_dir, "documents").select(F.array("lang", "source", "lang", F.lit("")).alias("tags")))


@query("SELECT tag, count(*) AS file_count FROM (SELECT DISTINCT doc_id, unnest([lang, source]) AS tag FROM documents) WHERE contains(tag, 'src1') OR contains(tag, 'e') GROUP BY tag")
def tag_search(spark, sf_dir):
    stats = documents.tag_stats(read(spark, sf_dir, "documents").select(F.array("lang", "source").alias("tags")))
    return documents.search_tags(stats, [" SRC1 ", "", "E"])


@query("""SELECT doc_id, array_to_string(CASE WHEN lang = 'en' THEN [source, 'new'] WHEN lang = 'fr' THEN [lang, source, 'new'] ELSE [lang, source, 'new'] END, '|') AS tags FROM documents""")
def tag_edit(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.array("lang", "source").alias("tags"))
    return d.select("doc_id", F.array_join(documents.edit_tags(F.col("tags"), [" new ", "NEW", ""], ["EN "]), "|").alias("tags"))


@query("SELECT doc_id, lang, n_chars FROM documents WHERE contains(lower('Doc-' || doc_id), 'c-1') ORDER BY n_chars DESC, doc_id LIMIT 50")
def doc_list(spark, sf_dir):
    d = read(spark, sf_dir, "documents").where(F.contains(F.lower(F.concat(F.lit("Doc-"), F.col("doc_id").cast("string"))), F.lit("c-1")))
    return d.orderBy(F.desc("n_chars"), "doc_id").limit(50).select("doc_id", "lang", "n_chars")


@query("SELECT doc_id, lang, n_chars FROM documents ORDER BY n_chars DESC, doc_id")
def doc_list_all(spark, sf_dir):
    return documents.list_docs(read(spark, sf_dir, "documents"), newest="n_chars", key="doc_id").select("doc_id", "lang", "n_chars")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE contains(lower('Doc-' || doc_id), 'c-1') ORDER BY n_chars DESC, doc_id")
def doc_list_query(spark, sf_dir):
    d = read(spark, sf_dir, "documents").withColumn("name", F.concat(F.lit("Doc-"), F.col("doc_id").cast("string")))
    return documents.list_docs(d, " C-1 ", newest="n_chars", key="doc_id").select("doc_id", "lang", "n_chars")


@query(r"""SELECT doc_id, CASE WHEN starts_with(f, '# ') THEN trim(substr(f, 3)) ELSE trim(regexp_replace(f, '#+$', '')) END AS title FROM (
  SELECT doc_id, coalesce(list_filter(list_transform(string_split(CASE WHEN doc_id % 2 = 0 THEN chr(10) || '# ' || text ELSE text END, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], '') AS f FROM documents)""")
def doc_titles(spark, sf_dir):
    d = read(spark, sf_dir, "documents").withColumn("t", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\n# "), "text")).otherwise(F.col("text")))
    return d.select("doc_id", txt.extract_title("t", F.lit("x.md")).alias("title"))


@query("""SELECT page_id, regexp_extract(lower(url), '(\\.[^.]*)$', 1) AS ext FROM pages""")
def doc_extension(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", txt.doc_extension("url").alias("ext"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Markdown' WHEN 1 THEN 'Python' WHEN 2 THEN '' ELSE 'Rust' END AS label FROM documents""")
def doc_type_labels(spark, sf_dir):
    from tidewell.sources.files import type_catalog

    names = F.when(F.col("doc_id") % 4 == 0, "a.MD").when(F.col("doc_id") % 4 == 1, "b.x.py").when(F.col("doc_id") % 4 == 2, "none").otherwise("c.rs")
    d = read(spark, sf_dir, "documents").select("doc_id", names.alias("name"))
    return documents.type_labels(d, type_catalog(spark)).select("doc_id", "label")


WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"
WINDOWS = f"""(SELECT doc_id, i::BIGINT AS chunk_index, array_to_string(list_slice(words, i * 40 + 1, i * 40 + 50), ' ') AS chunk_text, least(50, len(words) - i * 40)::BIGINT AS n_tokens FROM (
  SELECT doc_id, words, unnest(range(0, greatest(0, ceil((len(words) - 50) / 40.0)::BIGINT) + 1)) AS i FROM (SELECT doc_id, {WORDS} AS words FROM documents) WHERE len(words) > 0))"""


@query(f"SELECT doc_id, chunk_index, md5(chunk_text) AS chunk, n_tokens FROM {WINDOWS}")
def doc_chunks_fixed(spark, sf_dir):
    return documents.token_windows(read(spark, sf_dir, "documents"), 50, 10).select("doc_id", "chunk_index", F.md5("chunk_text").alias("chunk"), "n_tokens")


@query(f"SELECT doc_id, count(*) AS chunk_count, sum(n_tokens)::BIGINT AS tokens FROM {WINDOWS} GROUP BY doc_id")
def chunk_counts(spark, sf_dir):
    return documents.token_windows(read(spark, sf_dir, "documents"), 50, 10).groupBy("doc_id").agg(F.count("*").alias("chunk_count"), F.sum("n_tokens").alias("tokens"))


@query(f"""SELECT doc_id, chunk_index, least(sum(length(chunk_text)) OVER (PARTITION BY doc_id ORDER BY chunk_index), n_chars)::BIGINT AS done
  FROM {WINDOWS} w JOIN (SELECT doc_id, n_chars FROM documents) d USING (doc_id)""")
def import_progress(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    chunks = documents.token_windows(d, 50, 10).join(d.select("doc_id", F.col("n_chars").alias("total_chars")), "doc_id")
    return documents.running_progress(chunks).select("doc_id", "chunk_index", "done")


@query("SELECT doc_id, chunk_index, n_tokens FROM (SELECT doc_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS chunk_index, length(text)::BIGINT AS n_tokens, conv_id AS doc_id FROM conversations)".replace("SELECT doc_id, (row", "SELECT (row"))
def chunk_ordinals(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.row_number().over(w) - 1).cast("bigint").alias("chunk_index"), F.length("text").cast("bigint").alias("n_tokens"))


# ---- changes -----------------------------------------------------------------


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id, 'new' AS lang FROM documents WHERE doc_id % 7 = 0 UNION ALL SELECT doc_id, 'two' AS lang FROM documents WHERE doc_id % 7 = 0")
def replace_doc_chunks(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "lang")
    own = d.where("doc_id % 7 = 0")
    return mutations.replace_matching(d, own.withColumn("lang", F.lit("new")).unionByName(own.withColumn("lang", F.lit("two"))), ["doc_id"])


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_doc(spark, sf_dir):
    gone = read(spark, sf_dir, "labels").where("toxic = 1")
    return mutations.delete_matching(read(spark, sf_dir, "documents").select("doc_id", "source"), gone, ["doc_id"])


@query("SELECT d.doc_id, coalesce('q' || l.quality, d.lang) AS tag FROM documents d LEFT JOIN labels l USING (doc_id)")
def retag_chunks(spark, sf_dir):
    chunks = read(spark, sf_dir, "documents").select("doc_id", F.array("lang").alias("tags"))
    new = read(spark, sf_dir, "labels").select("doc_id", F.array(F.concat(F.lit("q"), F.col("quality").cast("string"))).alias("tags"))
    return mutations.retag(chunks, new).select("doc_id", F.array_join("tags", ",").alias("tag"))


@query("""SELECT coalesce(b.k, r.k) AS k, coalesce(r.enabled, b.enabled) AS enabled, coalesce(b.id, r.id) AS id FROM
  (SELECT doc_id AS k, true AS enabled, doc_id * 10 AS id FROM documents WHERE doc_id % 2 = 0) b FULL OUTER JOIN
  (SELECT doc_id AS k, toxic = 1 AS enabled, doc_id * 100 AS id FROM labels) r USING (k)""")
def upsert_overrides(spark, sf_dir):
    before = read(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("k"), F.lit(True).alias("enabled"), (F.col("doc_id") * 10).alias("id"))
    rows = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("k"), (F.col("toxic") == 1).alias("enabled"), (F.col("doc_id") * 100).alias("id"))
    return mutations.upsert(before, rows, ["k"], ["enabled"])


@query("""SELECT s, a, id FROM (SELECT DISTINCT l_partkey AS s, l_suppkey AS a, 0::BIGINT AS id FROM lineitem WHERE l_linenumber = 1) WHERE (s, a) NOT IN (SELECT (l_partkey, l_suppkey) FROM lineitem WHERE l_linenumber = 2)
  UNION ALL SELECT DISTINCT l_partkey, l_suppkey, 1::BIGINT FROM lineitem WHERE l_linenumber = 2""")
def replace_export(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    pairs = lambda n, i: li.where(F.col("l_linenumber") == n).select(F.col("l_partkey").alias("s"), F.col("l_suppkey").alias("a")).distinct().withColumn("id", F.lit(i).cast("bigint"))
    return mutations.replace_matching(pairs(1, 0), pairs(2, 1), ["s", "a"])


@query("""SELECT l_partkey AS k, min(l_quantity) AS v FROM lineitem WHERE l_linenumber = 1 GROUP BY 1 UNION ALL
  SELECT l_partkey, min(l_quantity) FROM lineitem WHERE l_linenumber = 2 AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 1) GROUP BY 1""")
def insert_ignore(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    rows = lambda n: li.where(F.col("l_linenumber") == n).select(F.col("l_partkey").alias("k"), F.col("l_quantity").alias("v"))
    return mutations.insert_missing(rows(1).groupBy("k").agg(F.min("v").alias("v")), rows(2), ["k"])


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN NOT (p_partkey % 2 = 0) ELSE p_partkey % 2 = 0 END AS enabled FROM part")
def toggle_enabled(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 2 == 0).alias("enabled"))
    return mutations.toggle(p, F.col("p_size") > 25).select("p_partkey", "enabled")


@query("SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'x' ELSE d.lang END AS lang, d.source FROM documents d LEFT JOIN labels l USING (doc_id)")
def patch_columns(spark, sf_dir):
    ch = read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "x").alias("lang"), F.lit(None).cast("string").alias("source"))
    return mutations.patch_columns(read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ch, ["doc_id"], ["lang", "source"])


@query("""SELECT k AS doc_id, coalesce(d.lang, 'new') AS lang, CASE WHEN c.k2 IS NOT NULL THEN note ELSE d.source END AS source FROM documents d
  FULL JOIN (SELECT DISTINCT doc_id * 3 AS k2, 'n' || doc_id AS note FROM labels) c ON d.doc_id = c.k2, LATERAL (SELECT coalesce(d.doc_id, c.k2) AS k)""")
def set_or_insert(spark, sf_dir):
    l = read(spark, sf_dir, "labels").select((F.col("doc_id") * 3).alias("doc_id"), F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("source"))
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return mutations.set_or_insert(d, l.unionByName(l), ["doc_id"], "source", {"lang": "new"})


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN d.lang ELSE 'z' || l.n END AS lang FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS n FROM labels GROUP BY doc_id) l USING (doc_id)")
def patch_repeated_keys(spark, sf_dir):
    """Changes that repeat a key multiply no row; the greatest counts."""
    l = read(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("z"), F.col("toxic").cast("string")).alias("lang"))
    less = l.withColumn("lang", F.lit("a"))
    return mutations.patch_columns(read(spark, sf_dir, "documents").select("doc_id", "lang"), l.unionByName(less), ["doc_id"], ["lang"])


@query("SELECT doc_id, lang FROM documents UNION ALL SELECT doc_id + 1000000, lang FROM documents")
def append_rows(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "lang")
    return mutations.append(d, d.withColumn("doc_id", F.col("doc_id") + 1000000))


@query("SELECT count(*) AS gone, 0::BIGINT AS kept FROM documents")
def truncate_table(spark, sf_dir):
    left, gone = mutations.truncate(read(spark, sf_dir, "documents"))
    return left.agg(F.lit(gone).cast("bigint").alias("gone"), F.count("*").alias("kept"))


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier UNION ALL SELECT s_suppkey + 100000, s_name || ' copy', s_nationkey FROM supplier WHERE s_nationkey % 2 = 0")
def import_batch(spark, sf_dir):
    """Known names and entries with a strange key are passed by, all else is taken."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    odd = F.create_map(F.when(F.col("s_nationkey") % 2 == 0, "url").otherwise("strange"), F.lit("x"))
    new = s.select((F.col("s_suppkey") + 100000).alias("s_suppkey"), F.concat("s_name", F.lit(" copy")).alias("s_name"), "s_nationkey", odd.alias("entry"))
    return catalog.import_new(s, new.unionByName(s.withColumn("entry", F.create_map(F.lit("url"), F.lit("x")))), ["s_name"], ["url"])


@query("SELECT l_partkey, arg_max(l_quantity, (l_shipdate, l_orderkey, l_linenumber)) AS l_quantity FROM lineitem GROUP BY l_partkey")
def last_write_wins(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_shipdate", "l_orderkey", "l_linenumber")
    return mutations.last_write(rows, ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber"]).select("l_partkey", "l_quantity")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN lang || chr(10) || 'more' ELSE lang END AS content FROM documents")
def update_document(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("content"))
    return mutations.update_document(d, d.where("doc_id % 5 = 0").select("doc_id", F.lit("more").alias("content")), append_text=True)


@query("SELECT doc_id, 0::INTEGER AS chunk_count FROM documents")
def zero_chunk_counts(spark, sf_dir):
    return documents.zero_chunk_counts(read(spark, sf_dir, "documents").select("doc_id"))


# ---- cost --------------------------------------------------------------------

TOOLS = """tools AS (SELECT 'srv-' || (p_partkey % 50) AS server_name, 'tool_' || p_partkey AS name, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_name || ' é' END AS description,
  '{"type":"' || p_type || '"}' AS input_schema FROM part)"""
OVER = "over AS (SELECT DISTINCT 'srv-' || (l_partkey % 50) AS server_name, 'tool_' || l_partkey AS name, false AS enabled FROM lineitem WHERE l_quantity > 49)"
COSTS = f"""{TOOLS}, {OVER}, costs AS (SELECT server_name, name, (ceil(strlen(coalesce(description, '')) / 4.0) + ceil(strlen(input_schema) / 4.0))::BIGINT AS cost, coalesce(enabled, true) AS enabled
  FROM tools LEFT JOIN over USING (server_name, name)), servers AS (SELECT server_name AS name, sum(CASE WHEN enabled THEN cost ELSE 0 END)::BIGINT AS exposed, sum(cost)::BIGINT AS gross FROM costs GROUP BY 1)"""


def tools_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda c: F.concat(F.lit("srv-"), (F.col(c) % 50).cast("string"))
    return read(spark, sf_dir, "part").select(
        s("p_partkey").alias("server_name"), F.concat(F.lit("tool_"), F.col("p_partkey").cast("string")).alias("name"),
        F.when(F.col("p_partkey") % 11 != 0, F.concat("p_name", F.lit(" é"))).alias("description"), F.concat(F.lit('{"type":"'), "p_type", F.lit('"}')).alias("input_schema"),
    )


def overrides_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").where("l_quantity > 49").select("l_partkey").distinct()
    return li.select(
        F.concat(F.lit("srv-"), (F.col("l_partkey") % 50).cast("string")).alias("server_name"), F.lit("tool").alias("item_type"),
        F.concat(F.lit("tool_"), F.col("l_partkey").cast("string")).alias("item_name"), F.lit(False).alias("enabled"),
        F.when(F.col("l_partkey") % 3 == 0, F.lit("overridden")).alias("description"),
    )


def groups_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    name = lambda c: F.concat(F.lit("srv-"), c.cast("string"))
    return read(spark, sf_dir, "nation").select(n.cast("string").alias("id"), F.col("n_name").alias("name"), F.array(name(n), name(n * 2), name(n), F.lit("unknown")).alias("servers"))


@query(f"WITH {COSTS} SELECT * FROM costs")
def tool_cost(spark, sf_dir):
    return cost.tool_costs(tools_table(spark, sf_dir), overrides_table(spark, sf_dir))


@query(f"WITH {COSTS} SELECT * FROM servers")
def server_cost(spark, sf_dir):
    return cost.server_costs(tool_cost(spark, sf_dir))


@query(f"""WITH {COSTS}, m AS (SELECT n_name AS g, unnest(['srv-' || n_nationkey, 'srv-' || n_nationkey * 2, 'srv-' || n_nationkey, 'unknown']) AS name FROM nation)
  SELECT g AS name, count(*) AS server_count, coalesce(sum(exposed), 0)::BIGINT AS exposed, coalesce(sum(gross), 0)::BIGINT AS gross FROM m LEFT JOIN servers USING (name) GROUP BY g""")
def group_cost(spark, sf_dir):
    return cost.group_costs(groups_table(spark, sf_dir), server_cost(spark, sf_dir))


@query(f"WITH {COSTS} SELECT coalesce(sum(exposed), 0)::BIGINT AS footprint FROM servers WHERE right(name, 1) <> '3'")
def cost_footprint(spark, sf_dir):
    return cost.footprint(server_cost(spark, sf_dir).withColumn("connected", F.substring("name", -1, 1) != "3"))


@query(f"WITH {COSTS} SELECT coalesce(sum(cost), 0)::BIGINT AS cost FROM costs WHERE name IN (SELECT 'tool_' || p_partkey FROM part WHERE p_size = 7)")
def selected_cost(spark, sf_dir):
    chosen = read(spark, sf_dir, "part").where("p_size = 7").select(F.concat(F.lit("tool_"), F.col("p_partkey").cast("string")).alias("name"))
    return cost.selected_cost(tool_cost(spark, sf_dir), chosen, ["name"])


# ---- catalog -----------------------------------------------------------------


def items_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("display_name"), F.col("p_type").alias("description"), F.split("p_type", " ").alias("categories"), F.array("p_brand").alias("tags")
    )


@query("SELECT p_partkey FROM part WHERE (contains(lower(p_name), 'an') OR contains(lower(p_brand), 'an') OR contains(lower(p_type), 'an')) AND list_contains([p_brand], (SELECT min(p_brand) FROM part))")
def catalog_search(spark, sf_dir):
    items = items_table(spark, sf_dir)
    brand = items.agg(F.min("display_name")).first()[0]
    return catalog.search(items, "AN", tag=brand).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), ' b') OR contains(lower(p_brand), ' b') OR contains(lower(p_type), ' b')")
def catalog_search_blanks(spark, sf_dir):
    return catalog.search(items_table(spark, sf_dir), " B", category="", tag="").select("p_partkey")


@query("SELECT p_partkey FROM part")
def catalog_search_nothing(spark, sf_dir):
    return catalog.search(items_table(spark, sf_dir), "").select("p_partkey")


@query("SELECT s_suppkey FROM supplier WHERE contains(lower(s_name), '1 ') OR contains(lower(s_name || ' on ' || s_nationkey), '1 ')")
def cloud_search(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    return catalog.cloud_search(s.select("s_suppkey", F.col("s_name").alias("name"), F.concat("s_name", F.lit(" on "), F.col("s_nationkey").cast("string")).alias("description")), "1 ").select("s_suppkey")


TYPED = "(SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'builtin' WHEN 1 THEN NULL ELSE 'stdio' END AS server_type FROM supplier)"


def typed_servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 4
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.when(k == 0, "builtin").when(k > 1, "stdio").alias("server_type"))


@query(f"SELECT s_suppkey, server_type FROM {TYPED} WHERE server_type IS DISTINCT FROM 'builtin'")
def custom_servers(spark, sf_dir):
    return catalog.of_type(typed_servers(spark, sf_dir))


@query(f"SELECT s_suppkey, server_type FROM {TYPED} WHERE server_type = 'builtin'")
def builtin_servers(spark, sf_dir):
    return catalog.of_type(typed_servers(spark, sf_dir), "builtin")


@query("SELECT DISTINCT unnest(string_split(p_type, ' ')) AS categorie FROM part")
def catalog_categories(spark, sf_dir):
    return catalog.facet_values(items_table(spark, sf_dir), "categories")


@query("SELECT DISTINCT p_brand AS tag FROM part")
def catalog_tags(spark, sf_dir):
    return catalog.facet_values(items_table(spark, sf_dir), "tags")


SERVERS = """servers AS (SELECT s_name AS name, CASE s_suppkey % 4 WHEN 0 THEN 'connected' WHEN 1 THEN 'disconnected' WHEN 2 THEN 'connecting' ELSE 'oauth_required' END AS status,
  CASE WHEN s_suppkey % 5 = 0 THEN false WHEN s_suppkey % 5 = 1 THEN NULL ELSE true END AS enabled, s_suppkey % 9 AS n_tools, s_suppkey FROM supplier)"""


def servers_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"), F.when(k % 4 == 0, "connected").when(k % 4 == 1, "disconnected").when(k % 4 == 2, "connecting").otherwise("oauth_required").alias("status"),
        F.when(k % 5 == 0, False).when(k % 5 != 1, True).alias("enabled"), (k % 9).alias("n_tools"), "s_suppkey", F.lit(None).cast("string").alias("description"), F.array(F.concat(F.lit("T"), k.cast("string"))).alias("tools"),
    )


@query(f"""WITH {SERVERS} SELECT count(*) AS total, count_if(status = 'connected')::BIGINT AS online, count_if(enabled = false)::BIGINT AS disabled, count_if(status = 'disconnected' AND coalesce(enabled, true))::BIGINT AS offline,
  count_if(status IN ('connecting', 'oauth_required') AND coalesce(enabled, true))::BIGINT AS connecting, coalesce(sum(n_tools), 0)::BIGINT AS tools FROM servers""")
def dashboard_counters(spark, sf_dir):
    return catalog.dashboard(servers_table(spark, sf_dir))


@query(f"""WITH {SERVERS} SELECT count(*) AS "all", count_if(status = 'connected')::BIGINT AS online, count_if(status <> 'connected' AND coalesce(enabled, true))::BIGINT AS issues, count_if(enabled = false)::BIGINT AS disabled FROM servers""")
def server_facets(spark, sf_dir):
    return catalog.server_facets(servers_table(spark, sf_dir))


@query(f"WITH {SERVERS} SELECT s_suppkey FROM servers WHERE status <> 'connected' AND coalesce(enabled, true) AND contains(lower(name || '  ' || 'T' || s_suppkey), 't1')")
def server_filter(spark, sf_dir):
    return catalog.filter_servers(servers_table(spark, sf_dir), "issues", " T1").select("s_suppkey")


@query(f"WITH {SERVERS} SELECT count(*) AS \"all\", count_if(coalesce(enabled, true))::BIGINT AS active, count_if(NOT coalesce(enabled, true))::BIGINT AS inactive FROM servers")
def item_facets(spark, sf_dir):
    return catalog.item_facets(servers_table(spark, sf_dir))


@query(f"WITH {SERVERS} SELECT s_suppkey FROM servers WHERE NOT coalesce(enabled, true) AND contains(lower(name), '5')")
def item_filter(spark, sf_dir):
    return catalog.filter_items(servers_table(spark, sf_dir), "inactive", "5").select("s_suppkey")


@query("SELECT c_custkey FROM customer WHERE trim(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ' ' || c_mktsegment END) = 'BUILDING'")
def keys_of_owner(spark, sf_dir):
    keys = read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit(" "), "c_mktsegment")).alias("owner"))
    return catalog.keys_in_scope(keys, "user:BUILDING").select("c_custkey")


@query("SELECT DISTINCT trim(c_mktsegment) AS owner FROM customer WHERE trim(c_mktsegment) <> ''")
def key_owners(spark, sf_dir):
    return catalog.owners(read(spark, sf_dir, "customer").select(F.concat(F.lit(" "), "c_mktsegment").alias("owner")), ["BUILDING"])


@query("SELECT s.s_name AS name, coalesce(n.st, 'disconnected') AS status, coalesce(n.k, 0)::BIGINT AS n_tools FROM supplier s LEFT JOIN (SELECT s_name, 'connected' AS st, s_nationkey AS k FROM supplier WHERE s_acctbal > 0) n USING (s_name)")
def server_status(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    live = s.where("s_acctbal > 0").select(F.col("s_name").alias("name"), F.lit("connected").alias("status"), F.col("s_nationkey").cast("bigint").alias("n_tools"))
    return catalog.with_status(s.select(F.col("s_name").alias("name")), live)


@query(f"""WITH {TOOLS}, over AS (SELECT DISTINCT 'tool_' || l_partkey AS name, CASE WHEN l_partkey % 3 = 0 THEN 'overridden' END AS d FROM lineitem WHERE l_quantity > 49)
  SELECT name, NOT (o.name IS NOT NULL) AS enabled, coalesce(o.d, t.description) AS description FROM tools t LEFT JOIN over o USING (name)""".replace("SELECT name, NOT", "SELECT t.name, NOT"))
def tool_overrides(spark, sf_dir):
    return catalog.apply_overrides(tools_table(spark, sf_dir), overrides_table(spark, sf_dir)).select("name", "enabled", "description")


@query("SELECT count_if(l.doc_id IS NULL)::BIGINT AS imported, count_if(l.doc_id IS NOT NULL)::BIGINT AS skipped FROM documents d LEFT JOIN labels l USING (doc_id)")
def import_counts(spark, sf_dir):
    return catalog.import_counts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "doc_id")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN '2025-06-18' ELSE '2025-03-26' END AS version FROM nation")
def negotiate_version(spark, sf_dir):
    return read(spark, sf_dir, "nation").select("n_nationkey", catalog.negotiate(F.when(F.col("n_nationkey") % 3 == 0, "2025-06-18").otherwise("2099-01-01")).alias("version"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_name = (SELECT min(s_name) FROM supplier) OR CAST(s_suppkey AS VARCHAR) = (SELECT min(s_name) FROM supplier)")
def by_name_or_id(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_name").alias("name"), F.col("s_suppkey").cast("string").alias("id"))
    return catalog.by_name_or_id(s, s.agg(F.min("name")).first()[0]).select("s_suppkey", "s_name")


# ---- scope -------------------------------------------------------------------

MEMBERS = """members AS (SELECT n_name AS g, n_nationkey AS gk, unnest(['srv-' || n_nationkey, 'srv-' || (n_nationkey + 1)]) AS server FROM nation)"""


@query(f"""WITH {MEMBERS}, k AS (SELECT c_custkey, c_nationkey, CASE c_custkey % 4 WHEN 0 THEN 'all' WHEN 1 THEN 'servers' WHEN 2 THEN 'groups' ELSE 'custom' END AS t FROM customer)
  SELECT c_custkey AS key_id, 'srv-' || (c_custkey % 30) AS server FROM k WHERE t IN ('servers', 'custom')
  UNION SELECT c_custkey, server FROM k JOIN members ON gk = c_nationkey WHERE t IN ('groups', 'custom')""")
def allowed_servers(spark, sf_dir):
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    name = lambda x: F.concat(F.lit("srv-"), x.cast("string"))
    kind = F.when(F.col("c_custkey") % 4 == 0, "all").when(F.col("c_custkey") % 4 == 1, "servers").when(F.col("c_custkey") % 4 == 2, "groups").otherwise("custom")
    keys = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_custkey").alias("id"), kind.alias("access_type"), F.array("n_name").alias("allowed_groups"), F.array(name(F.col("c_custkey") % 30)).alias("allowed_servers"))
    groups = n.select(F.col("n_name").alias("name"), F.array(name(F.col("n_nationkey")), name(F.col("n_nationkey") + 1)).alias("servers"))
    return scope.allowed_servers(keys, groups)


def scope_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Statuses, groups with tool lists and tools of the scope queries."""
    n = read(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    name = lambda x: F.concat(F.lit("srv-"), x.cast("string"))
    statuses = n.select(name(k).alias("name"), (k % 2 == 0).alias("connected"), (k % 3 == 0).alias("start_on_demand"), k.alias("ord"))
    some = F.array(*(F.concat(F.lit("tool_"), (k + 50 * i).cast("string")) for i in range(3)))
    member = lambda x, tools: F.struct(name(x).alias("name"), tools.alias("tools"))
    groups = n.select(k.cast("string").alias("id"), F.col("n_name").alias("name"), F.array(member(k, some), member(k + 1, F.lit(None).cast("array<string>"))).alias("members"))
    return statuses, groups, tools_table(spark, sf_dir).withColumn("enabled", ~F.endswith("name", F.lit("7")))


SCOPED = f"""{TOOLS}, filters AS (SELECT 'srv-3' AS server_name, ['tool_3', 'tool_53', 'tool_103'] AS allowed, 0 AS ord UNION ALL SELECT 'srv-4', NULL, 1)"""


@query(f"""WITH {SCOPED} SELECT server_name, name, server_name || '-' || name AS exposed_name, coalesce(description, '') AS description FROM filters JOIN tools USING (server_name)
  WHERE right(name, 1) <> '7' AND (allowed IS NULL OR list_contains(allowed, name))""")
def scoped_tools(spark, sf_dir):
    statuses, groups, tools = scope_tables(spark, sf_dir)
    return scope.listed_tools(scope.scope_servers("/$smart/3", statuses, groups), tools)


LISTED = """live AS (SELECT 'srv-' || n_nationkey AS server_name FROM nation WHERE n_nationkey % 2 = 0 OR n_nationkey % 3 = 0),
  allowed AS (SELECT 'srv-' || n_nationkey AS server_name FROM nation WHERE n_nationkey % 3 < 2),
  o AS (SELECT 'srv-' || (p_partkey % 50) AS server_name, 'tool_' || p_partkey AS name, p_partkey % 2 = 0 AS enabled, CASE WHEN p_partkey % 3 = 0 THEN 'own ' || p_partkey END AS own FROM part WHERE p_partkey % 5 < 3)"""


@query(f"""WITH {TOOLS}, {LISTED} SELECT server_name, name, server_name || '-' || name AS exposed_name, coalesce(own, description, '') AS description, input_schema
  FROM live SEMI JOIN allowed USING (server_name) JOIN tools USING (server_name) LEFT JOIN o USING (server_name, name) WHERE coalesce(o.enabled, true)""")
def tools_list(spark, sf_dir):
    statuses, groups, tools = scope_tables(spark, sf_dir)
    n, p = F.col("n_nationkey"), F.col("p_partkey")
    allowed = read(spark, sf_dir, "nation").where(n % 3 < 2).select(F.concat(F.lit("srv-"), n.cast("string")).alias("server"))
    o = read(spark, sf_dir, "part").where(p % 5 < 3).select(
        F.concat(F.lit("srv-"), (p % 50).cast("string")).alias("server_name"), F.lit("tool").alias("item_type"), F.concat(F.lit("tool_"), p.cast("string")).alias("item_name"),
        (p % 2 == 0).alias("enabled"), F.when(p % 3 == 0, F.concat(F.lit("own "), p.cast("string"))).alias("description"),
    )
    return scope.tools_list(scope.scope_servers("", statuses, groups), tools.withColumn("output_schema", F.lit("{}")), allowed, o, "2024-11-05")


@query("SELECT 'srv-' || n_nationkey AS name FROM nation WHERE (n_nationkey % 2 = 0 OR n_nationkey % 3 = 0) AND n_nationkey % 3 < 2")
def restricted_scope(spark, sf_dir):
    statuses, groups, _ = scope_tables(spark, sf_dir)
    n = F.col("n_nationkey")
    allowed = read(spark, sf_dir, "nation").where(n % 3 < 2).select(F.concat(F.lit("srv-"), n.cast("string")).alias("server"))
    return scope.restrict(scope.scope_servers("", statuses, groups), allowed.unionByName(allowed)).select("name")


@query("SELECT 'srv-' || n_nationkey AS name FROM nation WHERE n_nationkey % 2 = 0 OR n_nationkey % 3 = 0 UNION ALL SELECT 'builtin'")
def scope_global(spark, sf_dir):
    statuses, groups, _ = scope_tables(spark, sf_dir)
    return scope.scope_servers("$smart", statuses, groups, "builtin").select("name")


@query(f"""WITH {SCOPED}, t AS (SELECT server_name, name, ord FROM filters JOIN tools USING (server_name) WHERE allowed IS NULL OR list_contains(allowed, name)),
  calls AS (SELECT p_partkey AS call_id, CASE p_partkey % 3 WHEN 0 THEN 'srv-' || (p_partkey % 50) || '-tool_' || p_partkey ELSE 'tool_' || p_partkey END AS tool_name FROM part)
  SELECT call_id, tool_name, coalesce(a.server_name, b.server_name) AS server_name, coalesce(a.name, b.name) AS name FROM calls
  LEFT JOIN t a ON tool_name = a.server_name || '-' || a.name LEFT JOIN t b ON tool_name = b.name""")
def route_tool(spark, sf_dir):
    statuses, groups, tools = scope_tables(spark, sf_dir)
    p = F.col("p_partkey")
    plain = F.concat(F.lit("tool_"), p.cast("string"))
    calls = read(spark, sf_dir, "part").select(p.alias("call_id"), F.when(p % 3 == 0, F.concat(F.lit("srv-"), (p % 50).cast("string"), F.lit("-"), plain)).otherwise(plain).alias("tool_name"))
    return scope.route(calls, scope.scope_servers("3", statuses, groups), tools)


@query(f"""WITH {TOOLS}, m AS (SELECT n_name AS g, 'srv-' || n_nationkey AS server_name, ['tool_' || n_nationkey, 'tool_' || (n_nationkey + 50), 'tool_' || (n_nationkey + 100)] AS allowed FROM nation
  UNION ALL SELECT n_name, 'srv-' || (n_nationkey + 1), NULL FROM nation)
  SELECT g AS name, count_if(right(name, 1) <> '7' AND (allowed IS NULL OR list_contains(allowed, name)))::BIGINT AS visible, count(*) AS total FROM m JOIN tools USING (server_name) GROUP BY g""")
def group_tally(spark, sf_dir):
    _, groups, tools = scope_tables(spark, sf_dir)
    return scope.group_tally(groups, tools)


@query("SELECT p_partkey FROM part WHERE p_size > 10 AND p_brand IN (SELECT min(p_brand) FROM part)")
def builtin_selected(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("name"), (F.col("p_size") > 10).alias("enabled"))
    return scope.builtin_items(p, [p.agg(F.min("name")).first()[0]]).select("p_partkey")


# ---- skills ------------------------------------------------------------------


def skill_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Exports, skills and directory listings."""
    li, p = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    dir_ = F.concat(F.lit("d"), F.col("p_partkey").cast("string"))
    skills_ = p.where("p_size <= 40").select(F.col("p_partkey").alias("id"), dir_.alias("dir_name"))
    exports = li.where("l_linenumber = 1").select(F.col("l_partkey").alias("skill_id"), F.concat(F.lit("a"), (F.col("l_suppkey") % 10).cast("string")).alias("agent_id")).distinct()
    listing = p.where("p_size % 2 = 0").select(F.explode(F.array(*(F.lit(f"a{i}") for i in range(8)))).alias("agent_id"), dir_.alias("dir_name"))
    return exports, skills_, listing


EXPORTS = """e AS (SELECT DISTINCT l_partkey AS skill_id, 'a' || (l_suppkey % 10) AS agent_id FROM lineitem WHERE l_linenumber = 1), s AS (SELECT p_partkey AS skill_id, 'd' || p_partkey AS dir_name, p_size FROM part WHERE p_size <= 40)"""
LISTED = "s.p_size % 2 = 0 AND agent_id IN ('a0','a1','a2','a3','a4','a5','a6','a7')"


@query(f"WITH {EXPORTS} SELECT skill_id, agent_id FROM e WHERE skill_id NOT IN (SELECT skill_id FROM s)")
def orphan_exports(spark, sf_dir):
    e, s, _ = skill_tables(spark, sf_dir)
    return skills.orphan_exports(e, s)


@query(f"WITH {EXPORTS} SELECT skill_id, agent_id, dir_name FROM e JOIN s USING (skill_id) WHERE NOT ({LISTED})")
def stale_exports(spark, sf_dir):
    return skills.stale_exports(*skill_tables(spark, sf_dir))


@query(f"WITH {EXPORTS} SELECT skill_id, string_agg(agent_id, ',' ORDER BY agent_id) AS agents FROM e JOIN s USING (skill_id) WHERE {LISTED} GROUP BY skill_id")
def verified_exports(spark, sf_dir):
    return skills.verified_exports(*skill_tables(spark, sf_dir))


@query("SELECT s AS skill_id, a AS agent_id, 'd' || s AS dir_name, 'p/' || a AS path FROM (SELECT unnest(['1','2','999999']) AS s), (SELECT unnest(['3','4']) AS a) WHERE s IN (SELECT CAST(p_partkey AS VARCHAR) FROM part)")
def export_plan(spark, sf_dir):
    s = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("d"), F.col("p_partkey").cast("string")).alias("dir_name"))
    a = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.concat(F.lit("p/"), F.col("s_suppkey").cast("string")).alias("path"))
    return skills.export_plan(["1", "2", "999999", "1"], ["3", "4", "x"], s, a)


@query("""SELECT p_partkey, CASE WHEN n = 1 THEN b ELSE b || '-' || n END AS slug FROM (SELECT p_partkey, b, row_number() OVER (PARTITION BY b ORDER BY p_brand || ' / ' || p_partkey) AS n FROM
  (SELECT p_partkey, p_brand, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS b FROM part))""")
def slug_numbers(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.concat("p_brand", F.lit(" / "), F.col("p_partkey").cast("string")).alias("name"))
    return skills.numbered_slugs(p, "brand", "name").select("p_partkey", "slug")


# ---- versions and tasks ------------------------------------------------------


@query("""SELECT major, arg_max(version, minor * 100000 + patch) AS version FROM (SELECT p_size AS major, p_partkey % 17 AS minor, p_partkey AS patch, p_size || '.' || (p_partkey % 17) || '.' || p_partkey AS version
  FROM part WHERE p_partkey % 2 = 0) GROUP BY major ORDER BY major DESC LIMIT 10""".replace("SELECT major,", "SELECT major::BIGINT AS major,", 1))
def latest_per_major(spark, sf_dir):
    p = F.col("p_partkey")
    rel = read(spark, sf_dir, "part").select(F.concat(F.lit("v"), F.concat_ws(".", F.col("p_size").cast("string"), (p % 17).cast("string"), p.cast("string"))).alias("version"), (p % 2 == 0).alias("lts"))
    return versions.latest_per_major(rel)


@query("""SELECT major, minor, latest FROM (SELECT p_size::BIGINT AS major, p_partkey AS minor, 'r' || p_partkey AS latest, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey DESC) AS rn FROM part WHERE p_size IN (2, 3) AND p_partkey % 5 <> 0) WHERE rn <= 10""")
def top_per_branch(spark, sf_dir):
    p = F.col("p_partkey")
    cycles = read(spark, sf_dir, "part").select(F.concat_ws(".", F.col("p_size").cast("string"), p.cast("string")).alias("cycle"), F.when(p % 5 != 0, F.concat(F.lit("r"), p.cast("string"))).alias("latest"))
    return versions.newest_of_branches(cycles)


@query("""SELECT p_partkey, state FROM (SELECT p_partkey, CASE WHEN lag(p_size) OVER w IS NULL THEN 'recorded' WHEN p_size > lag(p_size) OVER w THEN 'newer' ELSE 'clear' END AS state FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey))""")
def update_detection(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("package"), F.col("p_partkey").alias("at"), F.concat(F.lit("v1."), F.col("p_size").cast("string"), F.lit("-beta")).alias("version"))
    return versions.update_states(p).select("p_partkey", "state")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 0 WHEN p_partkey % 4 = 1 THEN -1 WHEN p_partkey % 4 = 2 THEN 1 ELSE 1 END AS cmp, p_partkey % 4 = 2 AS newer, p_size::BIGINT AS second FROM part""")
def version_compare(spark, sf_dir):
    m, s = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    cur = F.when(m == 0, F.concat(F.lit("1."), s)).when(m == 1, F.lit("10.0.0")).when(m == 2, F.lit("9.9.9")).otherwise(F.lit("dev"))
    new = F.when(m == 0, F.concat(F.lit("1."), s, F.lit(".0"))).when(m == 1, F.lit("9.9.9")).when(m == 2, F.lit("10.0.0")).otherwise(F.lit("0.0.1"))
    return read(spark, sf_dir, "part").select("p_partkey", num.compare_versions(cur, new).alias("cmp"), num.is_newer(new, cur).alias("newer") & (m != 3), num.version_parts(F.concat(F.lit("x.1."), s))["minor"].alias("second")).toDF("p_partkey", "cmp", "newer", "second")


@query("""SELECT o_orderkey, (epoch_ms(TIMESTAMP '1998-01-01') - epoch_ms(o_orderdate) > 86400000 * 100::BIGINT) OR (o_orderstatus = 'F' AND epoch_ms(TIMESTAMP '1998-01-01') - epoch_ms(o_orderdate) > 300000) AS expired FROM orders""")
def task_expired(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").otherwise("working")
    now = F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    return o.select("o_orderkey", num.expired(F.col("o_orderdate"), F.lit(86400000 * 100), status, F.col("o_orderdate"), now).alias("expired"))


@query("""SELECT user_id, coalesce(arg_min(CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END, (ts, event_id)) FILTER (event_type IN ('purchase', 'error')), 'working') AS status FROM events GROUP BY user_id""")
def task_final_state(spark, sf_dir):
    from tidewell.streaming.tasks import final_states

    e = read(spark, sf_dir, "events")
    state = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("working")
    return final_states(e.select("user_id", F.struct("ts", "event_id").alias("at"), state.alias("status")), "user_id", "at").select("user_id", "status")


@query("SELECT n_nationkey, least(8000, 1000 * pow(2, n_nationkey))::BIGINT AS wait_ms FROM nation")
def reconnect_backoff(spark, sf_dir):
    return read(spark, sf_dir, "nation").select("n_nationkey", num.backoff_ms("n_nationkey").alias("wait_ms"))


# ---- scalar functions --------------------------------------------------------


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def slugify(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", txt.slugify("p_name").alias("slug"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(trim(' ..' || url), '[/\\:*?"<>|]', '-', 'g'), '^\.+', '')) AS safe, CASE WHEN ends_with(lower(url), '.html') THEN url ELSE url || '.HTML' END AS named FROM pages""")
def sanitize_names(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", txt.sanitize_file_name(F.concat(F.lit(" .."), "url")).alias("safe"), txt.with_extension("url", F.lit(" .HTML")).alias("named"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN NULL ELSE role END AS server FROM conversations")
def server_prefix(spark, sf_dir):
    m = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("[] "), "text")).otherwise(F.concat(F.lit("["), "role", F.lit("] "), "text"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", txt.bracket_prefix(m).alias("server"))


@query("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warn' ELSE 'info' END AS level, role AS message FROM conversations")
def level_parse(spark, sf_dir):
    tag = F.when(F.col("turn") % 3 == 0, "[ERROR] ").when(F.col("turn") % 3 == 1, "[WARN]").otherwise("")
    level, message = txt.level_prefix(F.concat(F.lit(" "), tag, "role"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", level.alias("level"), message.alias("message"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '@scope/p' || p_partkey WHEN 1 THEN 'p' || p_partkey WHEN 2 THEN 'q' || p_partkey WHEN 3 THEN 'r' || p_partkey END AS package FROM part""")
def package_names(spark, sf_dir):
    n, m = F.col("p_partkey").cast("string"), F.col("p_partkey") % 5
    args = (
        F.when(m == 0, F.array(F.lit("-y"), F.concat(F.lit("@scope/p"), n, F.lit("@1.2.3")))).when(m == 1, F.array(F.lit("-q"), F.lit("--"), F.concat(F.lit("p"), n, F.lit("[all]"))))
        .when(m == 2, F.array(F.lit("tool"), F.lit("--from"), F.concat(F.lit("q"), n, F.lit(">=2"))))
        .when(m == 3, F.array(F.lit("--python"), F.concat(F.lit("r"), n, F.lit("@latest")))).otherwise(F.array(F.lit("x")))
    )
    command = F.when(m < 2, "npx").when(m < 4, "uvx").otherwise("node")
    return read(spark, sf_dir, "part").select("p_partkey", txt.package_of_command(command, args).alias("package"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN least(p_size * 4, 100) WHEN 1 THEN least(p_size * 100 // 40, 100) WHEN 2 THEN NULL ELSE 7 END::INTEGER AS pct, p_partkey % 4 <> 2 AS download FROM part")
def progress_pct(spark, sf_dir):
    s, m = F.col("p_size"), F.col("p_partkey") % 4
    line = F.when(m == 0, F.concat(F.lit("done "), (s * 4).cast("string"), F.lit(" %"))).when(m == 1, F.concat(s.cast("string"), F.lit(" / 40 files"))).when(m == 2, F.lit("step 3 of 4, 5/0")).otherwise(F.lit("1/0 then 7%"))
    return read(spark, sf_dir, "part").select("p_partkey", txt.progress_pct(line).alias("pct"), txt.looks_like_download(line).alias("download"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 100 WHEN 3 THEN 99 ELSE NULL END::INTEGER AS pct,
  CASE p_partkey % 5 WHEN 0 THEN 1048576 WHEN 1 THEN 1048576 WHEN 2 THEN p_size * 1048576 WHEN 3 THEN p_partkey ELSE 1048576 END::BIGINT AS bytes FROM part""")
def long_numbers(spark, sf_dir):
    m, s = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    line = F.when(m == 0, F.concat(F.lit("9" * 23), F.lit("%"))).when(m == 1, F.concat(s, F.lit("/"), F.lit("9" * 25))).when(m == 2, "18446744073709551615 %").when(m == 3, "18446744073709551614/18446744073709551615").otherwise(F.lit("18446744073709551616 of 7%"))
    text = F.when(m == 0, "99999999999999999999999mb").when(m == 1, "9999999999999mb").when(m == 2, F.concat(F.lit("+0"), s, F.lit(" mb"))).when(m == 3, F.col("p_partkey").cast("string")).otherwise("")
    return read(spark, sf_dir, "part").select("p_partkey", txt.progress_pct(line).alias("pct"), txt.body_limit(text).alias("bytes"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'b' || p_partkey WHEN 1 THEN 'b' || p_partkey WHEN 2 THEN 'x' || p_partkey ELSE '--from' END AS package FROM part")
def last_from(spark, sf_dir):
    n, m = F.col("p_partkey").cast("string"), F.col("p_partkey") % 4
    a, b, x = (F.concat(F.lit(c), n) for c in "abx")
    args = F.when(m == 0, F.array(F.lit("--from"), a, F.lit("--from"), b, x)).when(m == 1, F.array(F.lit("--from"), a, F.concat(F.lit("--from="), b))).when(m == 2, F.array(F.lit("-q"), x, F.lit("--from"))).otherwise(F.array(F.lit("--from"), F.lit("--from"), x))
    return read(spark, sf_dir, "part").select("p_partkey", txt.package_of_command(F.lit("uvx"), args).alias("package"))


@query("""SELECT o_orderkey, CASE WHEN b >= 1073741824 THEN printf('%.2f GB', b / 1073741824.0) WHEN b >= 1048576 THEN printf('%.2f MB', b / 1048576.0) WHEN b >= 1024 THEN printf('%.2f KB', b / 1024.0) ELSE b || ' B' END AS size
  FROM (SELECT o_orderkey, o_orderkey * o_orderkey * 40 AS b FROM orders)""")
def size_format(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", txt.format_size(F.col("o_orderkey") * F.col("o_orderkey") * 40).alias("size"))


@query("""SELECT o_orderkey, CASE WHEN ms IS NULL THEN '—' WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN printf('%d.%02ds', (ms * 100 + 500) // 1000 // 100, (ms * 100 + 500) // 1000 % 100)
  ELSE printf('%d.%02dm', (ms * 100 + 30000) // 60000 // 100, (ms * 100 + 30000) // 60000 % 100) END AS shown,
  CASE WHEN n < 1000 THEN n::VARCHAR ELSE printf('%d.%dk', (n * 10 + 500) // 1000 // 10, (n * 10 + 500) // 1000 % 10) END AS tokens FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 > 0 THEN o_orderkey * 16 END AS ms, o_orderkey * 2 AS n FROM orders)""")
def duration_format(spark, sf_dir):
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select("o_orderkey", txt.format_duration(F.when(k % 10 > 0, k * 16)).alias("shown"), txt.format_tokens(k * 2).alias("tokens"))


@query("SELECT p_partkey, greatest(0, least(100, floor((p_size * 10 - p_partkey % 300) / (p_size * 10.0)::DOUBLE * 100 + 0.5)))::INTEGER AS pct FROM part")
def percent_saved(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", txt.percent_saved(F.col("p_size") * 10, F.col("p_partkey") % 300).alias("pct"))


@query("SELECT c_custkey, 'a=' || c_name || ';API_KEY=***;Db_Password=***' AS env FROM customer")
def redact_env(spark, sf_dir):
    env = txt.redact_env(F.create_map(F.lit("a"), "c_name", F.lit("API_KEY"), "c_name", F.lit("Db_Password"), F.lit("x")))
    pairs = F.transform(F.map_entries(env), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return read(spark, sf_dir, "customer").select("c_custkey", F.array_join(pairs, ";").alias("env"))


@query("SELECT c_custkey, 'Dear ' || c_name || ', ' || c_name || ' has ' || c_nationkey AS text FROM customer")
def template_render(spark, sf_dir):
    t = F.lit("Dear {{name}}, {{who}} has {{n}}")
    return read(spark, sf_dir, "customer").select("c_custkey", txt.render_template(t, {"who": F.lit("{{name}}"), "name": F.col("c_name"), "n": F.col("c_nationkey")}).alias("text"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'HOST,' || c_mktsegment ELSE 'HOST' END AS names FROM customer")
def detect_variables(spark, sf_dir):
    t = F.concat(F.lit('{"a":"${HOST}/${HOST}'), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("${"), "c_mktsegment", F.lit("}"))).otherwise(""), F.lit('"}'))
    return read(spark, sf_dir, "customer").select("c_custkey", F.array_join(txt.detect_variables(t), ",").alias("names"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size * 1048576 WHEN 1 THEN p_size * 1024 WHEN 2 THEN p_size WHEN 3 THEN p_size ELSE 1048576 END::BIGINT AS bytes FROM part")
def body_limit(spark, sf_dir):
    s, m = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    t = F.when(m == 0, F.concat(F.lit(" "), s, F.lit("MB"))).when(m == 1, F.concat(s, F.lit(" kb"))).when(m == 2, F.concat(s, F.lit("b"))).when(m == 3, s).otherwise(F.concat(s, F.lit("x")))
    return read(spark, sf_dir, "part").select("p_partkey", txt.body_limit(t).alias("bytes"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '10.0.0.1' WHEN 1 THEN '10.0.0.2' WHEN 2 THEN '10.0.0.3' ELSE '127.0.0.1' END AS ip FROM customer")
def client_ip(spark, sf_dir):
    m = F.col("c_custkey") % 4
    return read(spark, sf_dir, "customer").select("c_custkey", txt.client_ip(F.when(m == 0, " 10.0.0.1 , 9.9.9.9"), F.when(m < 2, "10.0.0.2"), F.when(m < 3, "10.0.0.3")).alias("ip"))


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'streamable-http' WHEN 1 THEN 'sse' WHEN 2 THEN 'openapi' WHEN 3 THEN 'stdio' WHEN 4 THEN 'sse' ELSE 'streamable-http' END AS kind FROM part")
def server_kinds(spark, sf_dir):
    m = F.col("p_partkey") % 6
    kind = F.when(m == 0, " Streamable_HTTP").when(m == 1, "my sse server").when(m == 2, "Open API").when(m == 5, "plain-http")
    return read(spark, sf_dir, "part").select("p_partkey", txt.server_kind(kind, F.when(m == 4, "http://x"), F.lit(None).cast("string")).alias("kind"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, CASE WHEN event_id % 2 = 0 THEN true ELSE false END AS valid FROM events")
def safe_json(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    broken = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat("props", F.lit("}")))
    return e.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), txt.parse_json_or_null(broken).isNotNull().alias("valid"))


@query("SELECT d.doc_id, array_to_string([d.lang, 'x y'], ',') AS tags FROM documents d")
def clean_tags(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(txt.clean_tags(F.array(F.concat(F.lit("\t"), "lang", F.lit(" ")), F.lit("  "), F.lit("x y"), F.lit(""))), ",").alias("tags"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN NULL WHEN 2 THEN 'dockerfile' ELSE 'typescript' END AS syntax FROM pages")
def syntax_names(spark, sf_dir):
    m = F.col("page_id") % 4
    name = F.when(m == 0, "a/b.PY").when(m == 1, "README.md").when(m == 2, "x/Dockerfile").otherwise("c.ts")
    return read(spark, sf_dir, "pages").select("page_id", txt.syntax_of(name).alias("syntax"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'a,b' ELSE 'a' END AS names, CASE WHEN n_nationkey % 3 = 0 THEN 'x,y' END AS tools FROM nation")
def server_lists(spark, sf_dir):
    k = F.col("n_nationkey")
    servers = F.when(k % 2 == 0, '["a",{"name":"b","tools":"all"},{"x":1}]').otherwise('["a"]')
    tools = F.when(k % 3 == 0, '["x","y"]').when(k % 3 == 1, "[]").otherwise('"all"')
    return read(spark, sf_dir, "nation").select("n_nationkey", F.array_join(scope.server_names(servers), ",").alias("names"), F.array_join(scope.selection(tools), ",").alias("tools"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'extra' ELSE '' END AS unknown FROM nation")
def unknown_keys(spark, sf_dir):
    k = F.col("n_nationkey")
    e = read(spark, sf_dir, "nation").select("n_nationkey", F.when(k % 2 == 0, F.create_map(F.lit("url"), F.lit("u"), F.lit("extra"), F.lit("1"))).otherwise(F.create_map(F.lit("url"), F.lit("u"))).alias("entry"))
    return catalog.unknown_keys(e, ["url", "command"]).select("n_nationkey", F.array_join("unknown", ",").alias("unknown"))


# ---- JSON, chunking and indexing ----------------------------------------------


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN '{"a":{"b":1,"c":[9]},"d":null,"n":' || n_nationkey || '}' ELSE '{"a":{"b":1,"c":[1,2]},"d":0}' END AS config FROM nation""")
def deep_merge(spark, sf_dir):
    k = F.col("n_nationkey")
    patch = F.when(k % 2 == 0, F.concat(F.lit('{"a":{"c":[9]},"d":null,"n":'), k.cast("string"), F.lit("}"))).otherwise("{broken")
    return read(spark, sf_dir, "nation").select("n_nationkey", js.deep_merge(F.lit('{"a":{"b":1,"c":[1,2]},"d":0}'), patch).alias("config"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN '{"l":[{}],"x":' || n_nationkey || '}' ELSE '{"x":' || n_nationkey || '}' END AS stripped FROM nation""")
def strip_empty(spark, sf_dir):
    k = F.col("n_nationkey")
    value = F.concat(F.lit('{"e":{"f":null},'), F.when(k % 2 == 0, '"l":[{"g":[]}],').otherwise('"l":[],'), F.lit('"x":'), k.cast("string"), F.lit("}"))
    return read(spark, sf_dir, "nation").select("n_nationkey", js.strip_empty(value).alias("stripped"))


@query("SELECT n_nationkey, n_nationkey % 3 = 2 AS changed FROM nation")
def connection_changed(spark, sf_dir):
    k = F.col("n_nationkey")
    before = F.lit('{"id":1,"command":"x","env":null}')
    after = F.when(k % 3 == 0, '{"id":2,"description":"d","command":"x","env":{}}').when(k % 3 == 1, '{"command":"x","options":{"timeout":60000}}').otherwise('{"command":"x","options":{"timeout":5}}')
    return read(spark, sf_dir, "nation").select("n_nationkey", js.connection_changed(before, after).alias("changed"))


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'https://a.example/v1' WHEN 1 THEN 'http://localhost/api' WHEN 2 THEN 'http://h.example/b' END AS url FROM nation""")
def api_base_url(spark, sf_dir):
    m = F.col("n_nationkey") % 4
    spec = (
        F.when(m == 0, '{"servers":[{"url":"{host}/v1","variables":{"host":{"default":"https://a.example"}}}]}').when(m == 1, '{"servers":[{"url":"/api"}]}')
        .when(m == 2, '{"host":"h.example","basePath":"/b","schemes":["http"]}').otherwise('{"info":{}}')
    )
    return read(spark, sf_dir, "nation").select("n_nationkey", js.api_base_url(spec).alias("url"))


@query()
def doc_chunks(spark, sf_dir):
    from tidewell.operators.chunking import chunk_documents

    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".md").otherwise(".txt")).alias("name"), "text")
    return chunk_documents(d, 120, 20).select("doc_id", "doc_name", "chunk_index", "chunk_text")


@query()
def indexed_documents(spark, sf_dir):
    from tidewell.operators.embedding import index_documents

    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("name"), "text", F.array("lang").alias("tags"))
    return index_documents(d, 200, 40)[0]


# ---- settings and small lists --------------------------------------------------


@query("SELECT event_id, coalesce(json_extract(props, '$.k')::VARCHAR, 'none') AS k, 'true' AS skip FROM events")
def json_defaults(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_id", js.with_default(F.col("props"), "$.k", "none").alias("k"), js.with_default(F.col("props"), "$.routing.skipAuth", "true").alias("skip"))


@query("""SELECT s_suppkey, '{"name":"' || s_name || '","env":{"URL":"u","AUTH_TOKEN":"***"}}' AS entry FROM supplier""")
def export_redacted(spark, sf_dir):
    env = F.create_map(F.lit("URL"), F.lit("u"), F.lit("AUTH_TOKEN"), F.col("s_name"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", catalog.export_entry(F.col("s_name"), env).alias("entry"))


@query("SELECT n_nationkey, 'a,b,n' || n_nationkey AS added, 'b' AS removed FROM nation")
def member_lists(spark, sf_dir):
    a = F.array(F.lit("a"), F.lit("b"))
    new = F.array(F.lit("b"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")))
    return read(spark, sf_dir, "nation").select("n_nationkey", F.array_join(mutations.add_members(a, new), ",").alias("added"), F.array_join(mutations.remove_members(a, F.array(F.lit("a"))), ",").alias("removed"))


@query("SELECT p_partkey, p_size || '.' || (p_partkey % 13) AS version FROM part ORDER BY p_size DESC, p_partkey % 13 DESC, p_partkey LIMIT 60")
def version_order(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 13).cast("string")).alias("version"))
    return p.orderBy(num.version_parts("version").desc(), "p_partkey").limit(60)


@query("SELECT p_partkey, p_size || '.' || (p_partkey % 13) AS version FROM part ORDER BY p_size DESC, p_partkey % 13 DESC, p_partkey")
def version_order_all(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 13).cast("string")).alias("version"))
    return versions.newest_first(p, key="p_partkey")


@query("SELECT s_suppkey FROM supplier WHERE lower(s_name) NOT IN (SELECT lower(min(s_name)) FROM supplier)")
def reserved_names(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    return catalog.without_reserved(s, [s.agg(F.min("s_name")).first()[0].upper()], "s_name").select("s_suppkey")


@query("SELECT doc_id, strlen(text)::BIGINT AS size, strlen(text) > 5000 AS too_large FROM documents")
def size_guard(spark, sf_dir):
    size = F.octet_length("text").cast("bigint")
    return read(spark, sf_dir, "documents").select("doc_id", size.alias("size"), documents.too_large(F.col("text"), 5000).alias("too_large"))


@query("SELECT doc_id, strlen(text) > 67108864 AS too_large FROM documents")
def upload_guard(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", documents.too_large(F.col("text")).alias("too_large"))


@query("""SELECT n.n_name AS name, s.s_name AS server FROM nation n JOIN supplier s ON s.s_nationkey IN (n.n_nationkey, n.n_nationkey + 1)""")
def servers_of_groups(spark, sf_dir):
    n, s = read(spark, sf_dir, "nation"), read(spark, sf_dir, "supplier")
    own = s.groupBy("s_nationkey").agg(F.collect_set("s_name").alias("servers"))
    members = n.select("n_name", F.explode(F.array("n_nationkey", F.col("n_nationkey") + 1)).alias("s_nationkey"))
    return scope.servers_of_groups(members.join(own, "s_nationkey").select(F.col("n_name").alias("name"), "servers"))


@query("SELECT s_name AS name, 'stdio' AS kind FROM supplier UNION ALL SELECT 'builtin', 'builtin'")
def servers_with_builtin(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.lit("stdio").alias("kind"))
    return s.unionByName(spark.range(1).select(F.lit("builtin").alias("name"), F.lit("builtin").alias("kind")))
