"""Views over the given tables, written once as SQL that Spark and DuckDB both run.

Clock of the listings: 2000-01-01. Clock of the scorecards: 2024-02-15 00:00:00. Row order is the order of
the ids, so no view needs a global row number.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2000-01-01"
SCORE_CLOCK = "2024-02-15 00:00:00"

MEMORY = """
SELECT regexp_extract(url, '^https://([^/]*)', 1) AS host, url, count(CASE WHEN added THEN 1 END) AS events_added,
  count(*) AS events_seen, count(DISTINCT run_id) AS runs_contributed, CAST(min(run_date) AS TIMESTAMP) AS first_seen,
  CAST(max(run_date) AS TIMESTAMP) AS last_seen
FROM r {when}GROUP BY url"""

VIEWS = {
    "l": """
SELECT concat('evt-', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS id,
  concat(p_name, CASE WHEN l_linenumber % 3 = 0 THEN concat(', with ', p_brand) ELSE '' END) AS act,
  CASE WHEN l_linenumber % 4 = 0 THEN lower(s_name) WHEN l_linenumber % 4 = 1 THEN concat('The ', s_name) ELSE s_name END AS venue_text,
  concat('v-', CAST(l_suppkey AS STRING)) AS venue_id, n_name AS location, CAST(l_shipdate AS DATE) AS date,
  concat('https://', CASE WHEN l_linenumber % 2 = 0 THEN 'www.' ELSE '' END, 'site', CAST(l_suppkey % 17 AS STRING), '.example/',
    CASE WHEN l_linenumber % 3 = 0 THEN 'e/' ELSE 'whats-on/' END, CAST(l_partkey AS STRING)) AS url,
  concat(lower(p_type), ' night with ', p_brand) AS summary,
  CASE l_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'https://img.example/site-logo.png' WHEN 2 THEN 'https://img.example/og.jpg'
    ELSE concat('https://img.example/2000/', replace(p_name, ' ', '-'), '.jpg') END AS thumbnail_url,
  split(concat(lower(p_type), ',', lower(p_brand)), ',') AS tags,
  l_orderkey AS order_key
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey""",
    "v": """
SELECT concat('v-', CAST(s_suppkey AS STRING)) AS id, s_name AS name, n_name AS location,
  split(concat(lower(s_name), ',', replace(s_name, '#', ' ')), ',') AS aliases,
  CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE concat('https://site', CAST(s_suppkey % 17 AS STRING), '.example/whats-on') END AS events_link,
  CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE concat('1999-12-', lpad(CAST(1 + s_suppkey % 28 AS STRING), 2, '0')) END AS last_mined,
  concat('2000-01-', lpad(CAST(1 + s_suppkey % 31 AS STRING), 2, '0'), 'T00:00:00') AS events_link_checked,
  CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST(concat('2000-0', CAST(1 + s_suppkey % 3 AS STRING), '-15') AS DATE) END AS last_event_date
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "r": """
SELECT concat('run-', CAST(CAST(ts AS DATE) AS STRING), '-', CAST(user_id % 5 AS STRING)) AS run_id, CAST(ts AS DATE) AS run_date, event_id AS ord,
  concat(event_type, ' gigs ', CAST(user_id % 11 AS STRING)) AS query,
  concat('https://host', CAST(event_id % 23 AS STRING), '.example/list/', CAST(event_id % 7 AS STRING)) AS url,
  concat('v-', CAST(event_id % 100 AS STRING)) AS venue_key,
  event_type IN ('purchase', 'signup') AS added
FROM {events}""",
    "pi": """
SELECT page_id, url, concat(html, '<img src="/uploads/page-', CAST(page_id % 40 AS STRING), '.jpg" alt="act ', CAST(page_id % 7 AS STRING),
  '"><img src="/static/site-logo.png" alt=""><meta property="og:image" content="/og/', CAST(page_id AS STRING), '.jpg">') AS html FROM {pages}""",
    "d": """
SELECT doc_id, substring(text, 1, 40) AS act, text AS summary, source AS venue, lang, DATE '2000-01-01' + CAST(doc_id % 60 AS INT) AS date,
  concat('https://docs.example/', CAST(doc_id AS STRING)) AS url FROM {documents}""",
    # images of the listings: one per poster address, every third one a placeholder without bytes
    "i": """
SELECT concat('img-', substring(md5(source_url), 1, 12)) AS id, source_url, 'image/jpeg' AS content_type,
  CASE WHEN length(source_url) % 3 = 0 THEN NULL ELSE CAST(source_url AS BINARY) END AS data
FROM (SELECT DISTINCT thumbnail_url AS source_url FROM l WHERE thumbnail_url IS NOT NULL) AS posters""",
    # runs as reports
    "rep": """
SELECT run_id AS report_id, CAST(min(run_date) AS TIMESTAMP) AS report_ts, count(CASE WHEN added THEN 1 END) AS added,
  count(CASE WHEN NOT added THEN 1 END) AS skipped FROM r GROUP BY run_id""",
    "rep_q": "\nSELECT run_id AS report_id, query, min(ord) AS pos FROM r GROUP BY run_id, query",
    "rep_u": """
SELECT run_id AS report_id, url, regexp_extract(url, '^https://([^/]*)', 1) AS host, min(ord) AS pos,
  count(CASE WHEN added THEN 1 END) AS events_added, count(*) AS events_seen, count(DISTINCT query) AS distinct_events
FROM r GROUP BY run_id, url""",
    # source memory after all runs, and after all but those of the newest day
    "mem": MEMORY.replace("{when}", ""),
    "mem_before": MEMORY.replace("{when}", "WHERE run_date < (SELECT max(run_date) FROM r) "),
    # venue scorecards of all runs
    "card": """
SELECT venue_key AS key, count(CASE WHEN added THEN 1 END) AS events_added, count(*) AS events_seen,
  count(DISTINCT run_id) % 4 AS zero_yield_runs, CAST(max(run_date) AS TIMESTAMP) AS last_seen
FROM r GROUP BY venue_key""",
}
NEEDS = {"i": ["l"], "rep": ["r"], "rep_q": ["r"], "rep_u": ["r"], "mem": ["r"], "mem_before": ["r"], "card": ["r"]}
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def view(spark: SparkSession, folder: str, name: str, **given: DataFrame) -> DataFrame:
    """A view as a DataFrame; ``given`` replaces tables, for instance by a batch of a stream."""
    text = VIEWS[name]
    frames = {t: given[t] if t in given else table(spark, folder, t) for t in TABLES if "{%s}" % t in text}
    for other in NEEDS.get(name, ()):
        text = re.sub(rf"\bFROM {other}\b", "FROM {%s}" % other, text)
        frames[other] = view(spark, folder, other, **given)
    return spark.sql(text, **frames)


def ctes(*names: str) -> str:
    """The same views as a ``WITH`` clause for DuckDB."""
    order: list[str] = []
    for name in names:
        for each in [*NEEDS.get(name, ()), name]:
            if each not in order:
                order.append(each)
    parts = [f"{n} AS ({VIEWS[n].format(**{t: t for t in TABLES})})" for n in order]
    return "WITH " + ",\n".join(parts) + "\n"


# Frames in the shapes the operators take ----------------------------------------------------


def listings(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "l").withColumn("ord", F.col("id"))


def stored(df: DataFrame) -> DataFrame:
    """Listing rows as stored events."""
    return df.select(
        "id", "act", F.col("venue_text").alias("venue"), "venue_id", "location", "date", "url",
        F.array().cast("array<string>").alias("sources"), F.coalesce("thumbnail_url", F.lit("")).alias("poster_url"), "summary",
        F.lit("").alias("added"), "tags", "ord",
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    return stored(listings(spark, folder))


def incoming(df: DataFrame) -> DataFrame:
    """Listing rows as incoming rows."""
    return df.select(
        "id", "act", F.col("venue_text").alias("venue"), "location", "date", "url",
        F.coalesce("thumbnail_url", F.lit("")).alias("poster_url"), "summary", "ord",
    )


def resources(spark: SparkSession, folder: str) -> DataFrame:
    """Listing rows as untouched resources with a title."""
    return listings(spark, folder).select(
        "id", F.concat("act", F.lit(" @ "), "venue_text", F.lit(", "), "location").alias("title"), "url",
        F.col("date").cast("string").alias("date"), "summary", "thumbnail_url", "ord",
    )


def split_store(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Stored rows (even orders) and incoming rows (odd orders)."""
    rows = listings(spark, folder)
    old = stored(rows.filter("order_key % 2 = 0")).withColumn("ord", F.concat(F.lit("0|"), "ord"))
    return old, incoming(rows.filter("order_key % 2 = 1"))


def venues(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "v").withColumn("ord", F.col("id"))


def images(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "i").withColumn("sha256", F.sha2("data", 256))


def events_with_images(spark: SparkSession, folder: str) -> DataFrame:
    """Stored events that show an image; every other poster address lives on the image only."""
    rows = listings(spark, folder)
    linked = F.when(F.col("thumbnail_url").isNotNull(), F.concat(F.lit("img-"), F.substring(F.md5("thumbnail_url"), 1, 12)))
    even = F.col("order_key") % 2 == 0
    base = rows.select(
        "id", "act", F.col("venue_text").alias("venue"), "venue_id", "location", "date", "url",
        F.array().cast("array<string>").alias("sources"), F.when(even, F.col("thumbnail_url")).alias("poster_url"), "summary",
        F.lit("").alias("added"), "tags", "ord", linked.alias("image_id"),
        F.when(F.col("order_key") % 3 == 0, F.lit(2)).when(F.col("order_key") % 3 == 1, F.lit(1)).alias("poster_quality"),
    )
    return base


EVENTS_WITH_IMAGES = """ei AS (SELECT *, CASE WHEN order_key % 2 = 0 THEN thumbnail_url END AS poster_url,
  CASE WHEN thumbnail_url IS NOT NULL THEN concat('img-', substring(md5(thumbnail_url), 1, 12)) END AS image_id,
  CASE order_key % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 END AS poster_quality FROM l)
"""


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "d").select(
        F.col("doc_id").cast("string").alias("id"), "doc_id", "act", "summary", "venue", F.lit("").alias("venue_id"),
        F.lit("").alias("location"), "date", "url", F.array("lang").alias("tags"), F.lit("").alias("poster_url"),
        F.format_string("%012d", "doc_id").alias("ord"),
    )
