"""Outcomes, scorecards, source memory, diagnostics and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from playbill.operators import diagnostics as D
from playbill.operators import images as I
from playbill.operators import pages as P
from playbill.operators import scorecards as K
from playbill.operators import venues as N
from playbill.plans import sql as S
from playbill.plans import views as X
from playbill.plans.join_queries import PLACES, places
from playbill.plans.registry import query

# decisions of a merge, one per listing: every third order was already known
DECISION = "order_key % 3 <> 0"


def decisions(spark, d):
    return X.listings(spark, d).select(
        "id", "ord", F.lower("act").alias("act_key"), F.expr("CASE WHEN order_key % 7 = 0 THEN NULL ELSE date END").alias("date"),
        F.expr("CASE WHEN order_key % 5 = 0 THEN '' ELSE venue_id END").alias("venue_id"), F.col("venue_text").alias("venue"),
        F.concat("url", F.lit("/#x")).alias("url"), F.expr(DECISION).alias("added"),
    )


@query("url_outcomes", "A8", X.ctes("l") + f"SELECT url, count(*) FILTER (WHERE {DECISION}) AS events_added, count(*) AS events_seen FROM l GROUP BY url")
def _(spark, d):
    return K.url_outcomes(decisions(spark, d))


@query("distinct_events_per_url", "A9", X.ctes("l") + "SELECT url, count(DISTINCT (lower(act), date)) AS distinct_events FROM l WHERE order_key % 7 <> 0 GROUP BY url")
def _(spark, d):
    return K.url_distinct(decisions(spark, d))


@query("venue_outcomes", "A10", X.ctes("l") + f"""SELECT CASE WHEN order_key % 5 = 0 THEN lower(venue_text) ELSE venue_id END AS key, CASE WHEN order_key % 5 = 0 THEN '' ELSE venue_id END AS venue_id, arg_min(venue_text, id) AS name,
  count(*) FILTER (WHERE {DECISION}) AS events_added, count(*) AS events_seen, count(*) FILTER (WHERE NOT ({DECISION})) AS duplicates FROM l GROUP BY 1, 2""")
def _(spark, d):
    return K.venue_outcomes(decisions(spark, d))


# Deltas -------------------------------------------------------------------------------------
# a report also crawled the page above every second list


def crawled(spark, d):
    urls = X.view(spark, d, "rep_u")
    return urls.select("report_id", "url").union(urls.filter("pos % 2 = 0").select("report_id", F.regexp_replace("url", "/list/.*", "/all/")))


CRAWLED = """crawled AS (SELECT report_id, url FROM rep_u UNION SELECT report_id, regexp_replace(url, '/list/.*', '/all') FROM rep_u WHERE pos % 2 = 0),
src AS (SELECT c.report_id, c.url, coalesce(u.events_added, 0) AS events_added, coalesce(u.events_seen, 0) AS events_seen FROM crawled c LEFT JOIN rep_u u USING (report_id, url)),
hst AS (SELECT report_id, regexp_extract(url, '^https://([^/]*)', 1) AS host, CAST(sum(events_added) AS BIGINT) AS events_added, CAST(sum(events_seen) AS BIGINT) AS events_seen FROM src GROUP BY 1, 2)
"""
ZERO = "CASE WHEN events_added = 0 THEN 1 ELSE 0 END AS zero_yield_runs"


def source_part(spark, d):
    return K.source_deltas(crawled(spark, d), X.view(spark, d, "rep_u"))


@query("source_deltas", "A11 U5", X.ctes("rep_u") + ", " + CRAWLED + f"SELECT report_id, url AS key, regexp_extract(url, '^https://([^/]*)', 1) AS host, events_added, events_seen, events_seen - events_added AS duplicates, {ZERO} FROM src")
def _(spark, d):
    return source_part(spark, d).select("report_id", "key", F.col("metadata")["host"].alias("host"), "events_added", "events_seen", "duplicates", "zero_yield_runs")


@query("host_deltas", "A12", X.ctes("rep_u") + ", " + CRAWLED + f"SELECT report_id, host AS key, events_added, events_seen, events_seen - events_added AS duplicates, {ZERO} FROM hst")
def _(spark, d):
    return K.host_deltas(source_part(spark, d)).select("report_id", "key", "events_added", "events_seen", "duplicates", "zero_yield_runs")


def venue_part(spark, d):
    rows = X.view(spark, d, "r").select(
        F.col("run_id").alias("report_id"), F.col("venue_key").alias("venue_id"), F.concat(F.lit("Venue "), "venue_key").alias("venue"), "added", "ord"
    )
    return K.venue_deltas(K.venue_outcomes(rows, ["report_id"]))


VEN = """ven AS (SELECT run_id AS report_id, venue_key, count(*) FILTER (WHERE added) AS events_added, count(*) AS events_seen FROM r GROUP BY 1, 2)
"""


@query("venue_deltas", "A13", X.ctes("r") + ", " + VEN + f"SELECT report_id, venue_key AS key, 'Venue ' || venue_key AS label, events_added, events_seen, events_seen - events_added AS duplicates, {ZERO} FROM ven")
def _(spark, d):
    return venue_part(spark, d).select("report_id", "key", "label", "events_added", "events_seen", "duplicates", "zero_yield_runs")


def query_part(spark, d):
    asked = X.view(spark, d, "rep_q").select("report_id", F.concat(F.lit("  "), F.regexp_replace("query", " ", "  ")).alias("query"), F.col("pos").alias("ord"))
    again = asked.withColumns({"query": F.upper("query"), "ord": F.col("ord") + 1_000_000_000})
    return K.query_deltas(asked.unionByName(again), X.view(spark, d, "rep").select("report_id", "added", "skipped"))


@query("query_deltas", "A14", X.ctes("rep_q", "rep") + "SELECT q.report_id, query AS key, query AS label, added AS events_added, added + skipped AS events_seen, skipped AS duplicates, CASE WHEN added = 0 THEN 1 ELSE 0 END AS zero_yield_runs FROM rep_q q JOIN rep USING (report_id)")
def _(spark, d):
    return query_part(spark, d).select("report_id", "key", "label", "events_added", "events_seen", "duplicates", "zero_yield_runs")


def all_deltas(spark, d):
    rows = K.score_deltas(source_part(spark, d), venue_part(spark, d), query_part(spark, d))
    return rows.join(X.view(spark, d, "rep").select("report_id", "report_ts"), "report_id")


DELTAS = VEN + ", " + CRAWLED + """, dl AS (SELECT report_id, 'source_url' AS kind, url AS key, events_added, events_seen, events_seen - events_added AS duplicates FROM src
  UNION ALL SELECT report_id, 'host', host, events_added, events_seen, events_seen - events_added FROM hst UNION ALL SELECT report_id, 'venue', venue_key, events_added, events_seen, events_seen - events_added FROM ven
  UNION ALL SELECT report_id, 'query', query, added, added + skipped, skipped FROM rep_q JOIN rep USING (report_id))
"""
BIG = lambda c: f"CAST(sum({c}) AS BIGINT) AS {c}"


@query("all_deltas", "U2", X.ctes("r", "rep_u", "rep_q", "rep") + ", " + DELTAS + f"SELECT kind, count(*) AS n, {BIG('events_added')}, {BIG('events_seen')}, {BIG('duplicates')} FROM dl GROUP BY kind")
def _(spark, d):
    return all_deltas(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("events_added", "events_seen", "duplicates")])


SCORED = DELTAS + f""", sc AS (SELECT kind, key, CAST(min(report_ts) AS TIMESTAMP) AS first_seen, CAST(max(report_ts) AS TIMESTAMP) AS last_seen, count(*) AS runs, {BIG('events_added')}, {BIG('events_seen')}, {BIG('duplicates')},
  count(*) FILTER (WHERE events_added = 0) AS zero_yield_runs FROM dl JOIN rep USING (report_id) GROUP BY kind, key)
"""
SCORE_COLS = ["kind", "key", "first_seen", "last_seen", "runs", "events_added", "events_seen", "duplicates", "zero_yield_runs"]


def scored(spark, d):
    """Scores after all runs, the first half applied before and delivered again."""
    rows = all_deltas(spark, d).select(
        "report_id", "report_ts", "kind", "key", "label", "events_added", "events_seen", "duplicates", "zero_yield_runs", "metadata"
    )
    empty = spark.createDataFrame([], "kind string, key string, label string, metadata map<string,string>, first_seen timestamp, last_seen timestamp, "
                                      "runs bigint, events_added bigint, events_seen bigint, duplicates bigint, zero_yield_runs bigint")
    none = spark.createDataFrame([], "kind string, key string, report_id string")
    first, ledger = K.apply_scores(empty, none, rows.filter("report_ts < '2024-01-16'"))
    return K.apply_scores(first, ledger, rows)[0]


@query("scorecards", "A15", X.ctes("r", "rep_u", "rep_q", "rep") + ", " + SCORED + f"SELECT {', '.join(SCORE_COLS)} FROM sc")
def _(spark, d):
    return scored(spark, d).select(*SCORE_COLS)


@query("score_list", "O4", X.ctes("r", "rep_u", "rep_q", "rep") + ", " + SCORED + "SELECT kind, key, events_added, events_seen FROM sc ORDER BY kind, events_added DESC, events_seen DESC, key LIMIT 40")
def _(spark, d):
    return K.list_scores(scored(spark, d).withColumn("label", F.col("key")), None, 40).select("kind", "key", "events_added", "events_seen")


# Source memory ------------------------------------------------------------------------------

STEP = f"""step AS (SELECT url, count(*) FILTER (WHERE added) AS a, count(*) AS s, count(DISTINCT query) AS dis FROM r WHERE run_date = (SELECT max(run_date) FROM r) GROUP BY url),
mem AS (SELECT * FROM mem_before),
grown AS (SELECT coalesce(mem.host, regexp_extract(step.url, '^https://([^/]*)', 1)) AS host, coalesce(mem.url, step.url) AS url, coalesce(events_added, 0) + coalesce(a, 0) AS events_added, coalesce(events_seen, 0) + coalesce(s, 0) AS events_seen,
  coalesce(runs_contributed, 0) + CASE WHEN s IS NULL THEN 0 ELSE 1 END AS runs_contributed, coalesce(first_seen, TIMESTAMP '{X.SCORE_CLOCK}') AS first_seen, CASE WHEN s IS NULL THEN last_seen ELSE TIMESTAMP '{X.SCORE_CLOCK}' END AS last_seen
  FROM mem FULL JOIN (SELECT * FROM step WHERE dis > 1) step ON step.url = mem.url),
kept AS (SELECT * FROM grown WHERE runs_contributed <= 3 * greatest(events_added, 0))
"""


def memory(spark, d):
    return X.view(spark, d, "mem").withColumn("last_picked", F.lit(None).cast("timestamp"))


def remembered(spark, d):
    runs = X.view(spark, d, "r")
    run = runs.filter(F.col("run_date") == runs.agg(F.max("run_date")).scalar())
    # the run table has no acts, so its queries stand in for the distinct events of a page
    pairs = run.select("url", "query").distinct().groupBy("url").agg(F.count(F.lit(1)).alias("distinct_events"))
    out = K.url_outcomes(run).join(pairs, "url")
    before = X.view(spark, d, "mem_before").withColumn("last_picked", F.lit(None).cast("timestamp"))
    return K.remember_sources(before, out, X.SCORE_CLOCK)


@query("source_memory", "A16 P16", X.ctes("r", "mem_before") + ", " + STEP + "SELECT host, url, events_added, events_seen, runs_contributed, first_seen, last_seen FROM kept")
def _(spark, d):
    return remembered(spark, d).drop("last_picked")


@query("sources_by_host", "A17", X.ctes("mem") + "SELECT host, 0 AS part, count(*) AS n, string_agg(url || ' ' || events_added || '/' || events_seen || '/' || runs_contributed, '|' ORDER BY url) AS urls FROM mem GROUP BY host")
def _(spark, d):
    nested = K.sources_by_host(memory(spark, d))
    text = F.transform("urls", lambda u: F.concat(u["url"], F.lit(" "), F.concat_ws("/", u["events_added"], u["events_seen"], u["runs_contributed"])))
    return nested.select("host", "part", F.size("urls").cast("bigint").alias("n"), F.array_join(text, "|").alias("urls"))


@query("urls_by_host", "A18", f"SELECT {S.host('url')} AS host, 0 AS part, string_agg(url, '|' ORDER BY page_id) AS urls FROM pages GROUP BY 1")
def _(spark, d):
    rows = X.table(spark, d, "pages").select("url", F.col("page_id").alias("ord"))
    return P.urls_by_host(rows).select("host", "part", F.array_join("urls", "|").alias("urls"))


# Diagnostics --------------------------------------------------------------------------------


def reports(spark, d):
    return X.view(spark, d, "rep").select("report_id", "report_ts", "added", "skipped")


NEWEST = lambda n: f"newest AS (SELECT report_id, report_ts FROM rep ORDER BY report_ts DESC, report_id DESC LIMIT {n})\n"


@query("top_sources", "O3", X.ctes("mem") + f"SELECT host, url, round({S.source_weight('events_added', 'events_seen')}, 6) AS weight FROM mem ORDER BY {S.source_weight('events_added', 'events_seen')} DESC, events_added DESC, events_seen DESC, url LIMIT 10")
def _(spark, d):
    return D.top_sources(memory(spark, d)).select("host", "url", F.round("weight", 6).alias("weight"))


COVERAGE = f"SELECT id AS venue_id, name, CAST(last_event_date - DATE '{X.AS_OF}' AS INT) AS days_until, coalesce(last_mined, '') AS last_mined FROM v ORDER BY days_until ASC NULLS FIRST, coalesce(last_mined, ''), lower(name), id LIMIT 20"


@query("venue_coverage", "O7", X.ctes("v") + COVERAGE)
def _(spark, d):
    return D.venue_coverage(X.venues(spark, d), X.AS_OF).select("venue_id", "name", "days_until", "last_mined")


LOW = """crawl AS (SELECT host, count(*) AS crawled_urls FROM rep_u WHERE report_id IN (SELECT report_id FROM newest) GROUP BY host),
yield AS (SELECT host, count(*) AS fruitful_urls, CAST(sum(events_added) AS BIGINT) AS source_events_added FROM mem GROUP BY host),
low AS (SELECT crawl.host, crawled_urls, coalesce(fruitful_urls, 0) AS fruitful_urls, coalesce(source_events_added, 0) AS source_events_added FROM crawl LEFT JOIN yield USING (host))
"""


@query("low_yield_hosts", "J10 O8", X.ctes("rep_u", "rep", "mem") + ", " + NEWEST(25) + ", " + LOW + "SELECT * FROM low ORDER BY source_events_added, fruitful_urls, crawled_urls DESC, host LIMIT 10")
def _(spark, d):
    return D.low_yield_hosts(reports(spark, d), X.view(spark, d, "rep_u"), memory(spark, d))


@query("repeated_queries", "A19 O9", X.ctes("rep_q", "rep") + ", " + NEWEST(50) + "SELECT query, count(*) AS n FROM rep_q JOIN newest USING (report_id) GROUP BY query HAVING count(*) > 1 ORDER BY n DESC, query LIMIT 10")
def _(spark, d):
    return D.repeated_queries(reports(spark, d), X.view(spark, d, "rep_q"))


@query("recent_queries", "W1", X.ctes("rep_q", "rep") + ", " + NEWEST(200) + "SELECT query FROM (SELECT query, max(report_ts) AS ts, arg_max(pos, (report_ts, pos)) AS pos FROM rep_q JOIN newest USING (report_id) GROUP BY query) ORDER BY ts DESC, pos DESC LIMIT 30")
def _(spark, d):
    return D.recent_queries(reports(spark, d), X.view(spark, d, "rep_q"))


@query("newest_reports", "O11", X.ctes("rep") + "SELECT report_id, report_ts FROM rep ORDER BY report_ts DESC, report_id DESC LIMIT 100")
def _(spark, d):
    return D.newest_reports(reports(spark, d)).select("report_id", "report_ts")


@query("report_rollup", "A24", X.ctes("rep_u", "rep") + "SELECT report_id, count(DISTINCT host) AS hosts, count(*) AS pages, any_value(added) || ' added' AS changes FROM rep_u JOIN rep USING (report_id) GROUP BY report_id")
def _(spark, d):
    return D.report_summary(X.view(spark, d, "rep_u"), reports(spark, d))


@query("image_blob_counts", "A25", X.ctes("l", "i") + "SELECT count(*) FILTER (WHERE data IS NOT NULL) AS with_data, count(*) FILTER (WHERE data IS NULL) AS without_data FROM i")
def _(spark, d):
    return I.blob_counts(X.images(spark, d))


@query("report_documents", "A26", X.ctes("rep_q", "rep_u", "rep") + """, q AS (SELECT report_id, string_agg(query, '|' ORDER BY pos) AS searches FROM rep_q GROUP BY 1), h AS (SELECT report_id, host, string_agg(url, '|' ORDER BY pos) AS urls FROM rep_u GROUP BY 1, 2),
u AS (SELECT report_id, string_agg(host || '=' || urls, ';' ORDER BY host) AS urls FROM h GROUP BY 1)
SELECT report_id, searches, urls, 'added (new rows)=' || added || ';skipped as duplicate=' || skipped AS changes, CASE WHEN added % 2 = 0 THEN 'seed' END AS memory_seed, round(added / 7.0::DOUBLE, 3) AS temperature,
  CASE WHEN skipped % 2 = 0 THEN 'slow' END AS crawl_note FROM rep JOIN q USING (report_id) JOIN u USING (report_id)""")
def _(spark, d):
    rep = reports(spark, d).withColumns({
        "memory_seed": F.when(F.col("added") % 2 == 0, " seed ").otherwise(" "), "model": F.lit(""), "temperature": F.col("added") / 7.0,
        "diagnostics": F.create_map(F.lit("crawl"), F.when(F.col("skipped") % 2 == 0, "slow ").otherwise(" ")),
    })
    docs = D.build_reports(rep, X.view(spark, d, "rep_q"), X.view(spark, d, "rep_u"), reports(spark, d).select("report_id", "added", "skipped"))
    pairs = lambda m, f, sep: F.array_join(F.transform(F.map_entries(m), f), sep)
    return docs.select(
        "report_id", F.array_join("searches", "|").alias("searches"),
        pairs("urls", lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "|")), ";").alias("urls"),
        pairs("changes", lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")), ";").alias("changes"),
        "memory_seed", "temperature", F.col("diagnostics")["crawl"].alias("crawl_note"),
    )


@query("mining_coverage", "A27", X.ctes("v") + f"SELECT id, name, {S.host('events_link')} AS host, last_mined, events_link_checked FROM v WHERE events_link IS NOT NULL")
def _(spark, d):
    return N.mining_coverage(X.venues(spark, d))


@query("mining_counts", "A27", X.ctes("v") + "SELECT count(*) AS venues, count(events_link) AS linked FROM v")
def _(spark, d):
    return N.coverage_counts(X.venues(spark, d))


@query("mining_reports", "A27", X.ctes("rep", "rep_u", "rep_q") + ", " + NEWEST(3) + "SELECT report_id, (SELECT count(*) FROM rep_q q WHERE q.report_id = n.report_id) AS searches, (SELECT string_agg(DISTINCT host, '|' ORDER BY host) FROM rep_u u WHERE u.report_id = n.report_id) AS hosts FROM newest n")
def _(spark, d):
    out = D.recent_mining(reports(spark, d).select("report_id", "report_ts"), X.view(spark, d, "rep_u"), X.view(spark, d, "rep_q"))
    return out.select("report_id", "searches", F.array_join("hosts", "|").alias("hosts"))


@query("strategy_summary", "A28", X.ctes("rep_u", "rep_q", "rep", "mem", "v") + f""", newest AS (SELECT report_id, report_ts FROM rep ORDER BY report_ts DESC, report_id DESC LIMIT 25), newest50 AS (SELECT report_id FROM rep ORDER BY report_ts DESC, report_id DESC LIMIT 50), {LOW.replace("WHERE url LIKE '%/list/3'", '')}
SELECT 1 AS section, 'Top remembered source URLs' AS title, line FROM (SELECT format('- {{}} ({{}}): added={{}}, seen={{}}, runs={{}}, weight={{:.2f}}', url, host, events_added, events_seen, runs_contributed, {S.source_weight('events_added', 'events_seen')}) AS line FROM mem
  ORDER BY {S.source_weight('events_added', 'events_seen')} DESC, events_added DESC, events_seen DESC, url LIMIT 10)
UNION ALL SELECT 2, 'Venues with weakest future coverage', line FROM (SELECT format('- {{}}: last_event_date={{}}, days_until={{}}, events_link={{}}, last_mined={{}}', name, coalesce(CAST(last_event_date AS VARCHAR), 'missing'), coalesce(CAST(last_event_date - DATE '{X.AS_OF}' AS VARCHAR), 'unknown'),
  CASE WHEN events_link IS NULL THEN 'no' ELSE 'yes' END, coalesce(last_mined, 'never')) AS line FROM v ORDER BY last_event_date - DATE '{X.AS_OF}' ASC NULLS FIRST, coalesce(last_mined, ''), lower(name), id LIMIT 20)
UNION ALL SELECT 3, 'Recently crawled low-yield hosts', line FROM (SELECT format('- {{}}: crawled_urls={{}}, fruitful_urls={{}}, source_events_added={{}}', host, crawled_urls, fruitful_urls, source_events_added) AS line FROM low ORDER BY source_events_added, fruitful_urls, crawled_urls DESC, host LIMIT 10)
UNION ALL SELECT 4, 'Repeated recent search queries', line FROM (SELECT format('- {{}} ({{}} runs)', query, count(*)) AS line FROM rep_q JOIN newest50 USING (report_id) GROUP BY query HAVING count(*) > 1 ORDER BY count(*) DESC, query LIMIT 10)""")
def _(spark, d):
    return D.strategy_summary(
        X.venues(spark, d), memory(spark, d), reports(spark, d), X.view(spark, d, "rep_u"), X.view(spark, d, "rep_q"), X.AS_OF
    )


# Venue upkeep -------------------------------------------------------------------------------


@query("linked_event_counts", "A1", X.ctes("l") + "SELECT venue_id, count(*) AS n FROM l WHERE venue_id IN ('v-1', 'v-2', 'v-30', 'v-77') GROUP BY venue_id")
def _(spark, d):
    wanted = X.venues(spark, d).filter("id in ('v-1', 'v-2', 'v-30', 'v-77')").select(F.col("id").alias("venue_id"))
    return N.linked_counts(X.listings(spark, d), wanted)


@query("last_event_dates", "A2", X.ctes("l", "v") + ", " + PLACES + """, m AS (SELECT venue_id, max(date) AS latest FROM l GROUP BY venue_id)
SELECT id, coalesce(latest, last_event_date) AS last_event_date, latest IS NOT NULL AND latest IS DISTINCT FROM last_event_date AS changed FROM places LEFT JOIN m ON m.venue_id = id""")
def _(spark, d):
    return N.last_event_dates(X.listings(spark, d), places(spark, d)).select("id", "last_event_date", "changed")


@query("added_aliases", "U6", X.ctes("v") + "SELECT id, array_to_string(aliases, '|') || CASE WHEN last_mined IS NULL THEN '' ELSE '|Hall of ' || name END AS aliases FROM v")
def _(spark, d):
    rows = X.venues(spark, d)
    new = rows.select("id", F.when(F.col("last_mined").isNull(), F.concat(F.lit("THE  "), F.upper("name"))).otherwise(F.concat(F.lit("Hall of "), "name")).alias("alias"))
    return N.add_alias(rows, new).select("id", F.array_join("aliases", "|").alias("aliases"))
