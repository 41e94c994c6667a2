"""Queries of column functions over inputs made of the tables' own values, every row another one."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions import json as js
from tidewell.functions import text as txt
from tidewell.plans.catalogue import query, read


def _object(**fields) -> F.Column:
    """A JSON object of columns, null ones kept as null."""
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())), {"ignoreNullFields": "false"})


@query("""SELECT page_id, CASE WHEN starts_with(url, 'https') THEN url ELSE 'https://' || regexp_extract(url, '://([^/]*)', 1) || regexp_extract(url, '://[^/]*(.*)', 1) END AS base FROM pages""")
def api_urls_of_pages(spark, sf_dir):
    """Descriptions that name their server whole, or by host and path."""
    part = lambda i: F.regexp_extract("url", r"://([^/]*)(.*)", i)
    spec = F.when(F.startswith("url", F.lit("https")), _object(servers=F.array(F.struct("url")))).otherwise(_object(host=part(1), basePath=part(2)))
    return read(spark, sf_dir, "pages").select("page_id", js.api_base_url(spec).alias("base"))


@query("""SELECT o_orderkey, changed FROM (SELECT o_orderkey, lag(o_orderstatus) OVER w IS DISTINCT FROM o_orderstatus OR lag(o_totalprice > 250000) OVER w IS DISTINCT FROM (o_totalprice > 250000) AS changed,
  lag(o_orderkey) OVER w AS p FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) WHERE p IS NOT NULL""")
def connection_changed_orders(spark, sf_dir):
    """Each customer's orders as settings after one another: ids, descriptions and the default timeout don't count."""
    config = _object(
        id=F.col("o_orderkey"), description=F.col("o_orderpriority"), command=F.col("o_orderstatus"), env=F.lit(None).cast("string"),
        options=F.struct(F.when(F.col("o_totalprice") > 250000, 5000).otherwise(60000).alias("timeout")),
    )
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", config.alias("now"))
    both = orders.withColumn("before", F.lag("now").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    return both.where("before is not null").select("o_orderkey", js.connection_changed(F.col("before"), F.col("now")).alias("changed"))


@query("""SELECT event_id, '{"type":"' || event_type || '","p":{"k":' || json_extract_string(props, '$.k') || ',"u":' || user_id || '},"at":null}' AS merged FROM events""")
def deep_merge_events(spark, sf_dir):
    whole = F.concat(F.lit('{"type":"'), "event_type", F.lit('","p":'), "props", F.lit(',"at":1}'))
    patch = F.concat(F.lit('{"p":{"u":'), F.col("user_id").cast("string"), F.lit('},"at":null}'))
    return read(spark, sf_dir, "events").select("event_id", js.deep_merge(whole, patch).alias("merged"))


@query("""SELECT doc_id, '{"lang":"' || lang || '"' || coalesce(',"label":{"quality":' || quality || '}', '') || ',"n":' || n_chars || '}' AS stripped FROM documents LEFT JOIN labels USING (doc_id)""")
def strip_empty_documents(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    value = _object(lang=F.col("lang"), label=F.struct("quality", F.lit(None).cast("string").alias("by")), tags=F.array().cast("array<string>"), n=F.col("n_chars"))
    return d.select("doc_id", js.strip_empty(value).alias("stripped"))


@query("""SELECT doc_id, CASE lang WHEN 'en' THEN n_chars * 1048576 WHEN 'fr' THEN n_chars * 1024 WHEN 'de' THEN n_chars ELSE 1048576 END AS bytes FROM documents""")
def body_limits_of_documents(spark, sf_dir):
    """Sizes in words whose unit is the document's language's."""
    unit = F.when(F.col("lang") == "en", " MB").when(F.col("lang") == "fr", "kB ").when(F.col("lang") == "de", "b").otherwise(" words")
    return read(spark, sf_dir, "documents").select("doc_id", txt.body_limit(F.concat(F.col("n_chars").cast("string"), unit)).alias("bytes"))


@query("""SELECT l_orderkey, l_linenumber, l_suppkey % 256 || '.' || l_partkey % 256 || '.' || l_linenumber || '.1' AS ip FROM lineitem""")
def client_ips_of_lines(spark, sf_dir):
    """The first of forwarded addresses, where there are any, else the proxy's, else the socket's."""
    octet = lambda c: (F.col(c) % 256).cast("string")
    ip = F.concat_ws(".", octet("l_suppkey"), octet("l_partkey"), F.col("l_linenumber").cast("string"), F.lit("1"))
    cheap, few = F.col("l_extendedprice") < 20000, F.col("l_quantity") < 25
    given = txt.client_ip(F.when(cheap, F.concat(F.lit(" "), ip, F.lit(" , 9.9.9.9"))), F.when(~cheap & few, ip), F.when(~cheap & ~few, ip))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", given.alias("ip"))
