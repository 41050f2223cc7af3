"""Scans, filters, feeds and visitor tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from playbill.functions import fixed_values as V
from playbill.functions import urls
from playbill.functions.dates import is_fresh
from playbill.functions.scores import is_stale
from playbill.functions.text import act_eligible, clip_keep_tail
from playbill.operators import hygiene as H
from playbill.operators import images as I
from playbill.operators import listings as L
from playbill.operators import pages as P
from playbill.plans import sql as S
from playbill.plans import views as X
from playbill.plans.registry import query
from playbill.session import ensure_checkpoint_dir
from playbill.sources import readers, sinks

WINDOW = f"date BETWEEN DATE '{X.AS_OF}' AND DATE '{X.AS_OF}' + 30"
LABEL = "strftime(date, '%a %-d %b %Y')"
TAG_TEXT = "array_to_string(tags, '|')"
TERMS = ["small", "brand#2", "red ring"]
EXCLUDED = "(regexp_matches(' ' || lower(act || ' ' || venue_text || ' ' || location || ' ' || summary || ' ' || url) || ' ', '[^a-z0-9_](small|brand#2|red ring)[^a-z0-9_]'))"
DECIDED = "venue_id IN ('v-3', 'v-7')"


def folder(spark) -> str:
    """A fresh folder beside the checkpoints, which all executors can reach."""
    return f"{ensure_checkpoint_dir(spark).removeprefix('file:')}/table-{uuid.uuid4().hex}"


# Scans --------------------------------------------------------------------------------------


@query("hydrated_scan", "S1 J1", X.ctes("l", "i", "v") + ", " + X.EVENTS_WITH_IMAGES + f"""SELECT ei.id, act, CASE WHEN v.id IS NOT NULL THEN v.location ELSE 'elsewhere' END AS location,
  coalesce(poster_url, i.source_url, '') AS poster FROM ei LEFT JOIN v ON v.id = ei.venue_id AND v.events_link IS NOT NULL LEFT JOIN i ON i.id = ei.image_id""")
def _(spark, d):
    rows = X.events_with_images(spark, d).withColumn("location", F.lit("elsewhere"))
    known = X.venues(spark, d).filter("events_link is not null")
    return L.scan_events(rows, known, X.images(spark, d)).select("id", "act", "location", "poster")


@query("feed_import", "S2", X.ctes("l") + f"""SELECT act || ' @ ' || venue_text AS title, url, {LABEL} AS date, thumbnail_url, count(*) AS n FROM l WHERE {WINDOW} GROUP BY ALL""")
def _(spark, d):
    # feed documents, one a line, written from feed rows and read back
    feed = L.to_feed(L.in_window(X.events(spark, d), X.AS_OF))
    item = F.struct("id", "eventName", "venue", "url", "date", "summary", "thumbnailUrl")
    path = folder(spark) + "/feed"
    feed.select(F.lit(X.AS_OF).alias("generated"), F.array(item).alias("events")).write.json(path)
    return readers.read_feed(spark, path, multi_line=False).groupBy("title", "url", "date", "thumbnail_url").agg(F.count(F.lit(1)).alias("n"))


def result_texts(spark, d):
    """Search-result text per document, with its whole text as the title: one block for the document, one for its neighbour."""
    said = lambda c: F.coalesce(c, F.lit(""))
    rows = X.documents(spark, d).withColumn("act", F.regexp_replace("summary", r"[ \t\n\f\r]+", " "))
    block = lambda n: F.concat(
        F.lit("## Query\ntitle: "), said(F.col("act")), F.lit("\nsnippet: "), said(F.col("tags")[0]), F.lit("\nlink: "), F.concat("url", F.lit(n)), F.lit(").\n---\n")
    )
    return rows.select("doc_id", F.concat(block("/a"), block("/b"), block("/a")).alias("blob"))


ACT_LINE = "trim(regexp_replace(summary, '\\s+', ' ', 'g'))"


@query("search_result_blocks", "S3", X.ctes("d") + f"""SELECT doc_id, p.pos, {ACT_LINE} AS title, lang AS snippet, url || p.tail AS link
FROM d, (VALUES (0, '/a'), (1, '/b'), (2, '/a')) AS p(pos, tail)""")
def _(spark, d):
    return P.parse_result_blocks(result_texts(spark, d), "blob", "doc_id")


@query("link_lines", "S4", X.ctes("d") + """SELECT doc_id, p.pos, url || p.tail AS link FROM d, (VALUES (0, '/a'), (1, '/b')) AS p(pos, tail)""")
def _(spark, d):
    return P.extract_link_lines(result_texts(spark, d), "blob", "doc_id")


@query("asset_scan", "S5", X.ctes("l", "i") + """SELECT id || '.jpg' AS id, CASE WHEN contains(source_url, 'logo') THEN 'file://' || id || '.jpg' ELSE source_url END AS source_url,
  'image/jpeg' AS content_type, sha256(source_url) AS sha256 FROM i""")
def _(spark, d):
    # one small file per distinct poster; files of logos are left out of the index
    path = folder(spark) + "/assets"
    uri = path if "://" in path else "file://" + path
    posters = X.images(spark, d).select(F.concat("id", F.lit(".jpg")).alias("file"), "source_url")

    def write(batches):
        import pandas as pd
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for name, url in zip(batch["file"], batch["source_url"]):
                with store.open_output_stream(f"{root}/{name}") as out:
                    out.write(url.encode())
            yield pd.DataFrame({"n": [len(batch)]})

    posters.mapInPandas(write, "n long").agg(F.sum("n")).collect()
    index = posters.filter(~F.col("source_url").contains("logo")).select("file", F.col("file").alias("id"), F.col("source_url").alias("source"))
    return readers.read_assets(spark, path, index).select("id", "source_url", "content_type", "sha256")


@query("blob_upsert", "S6", X.ctes("l", "i") + """SELECT id, CASE WHEN length(source_url) % 2 = 0 THEN 'image/png' ELSE content_type END AS content_type,
  CASE WHEN length(source_url) % 2 = 0 THEN sha256(upper(source_url)) WHEN data IS NOT NULL THEN sha256(source_url) END AS sha256 FROM i""")
def _(spark, d):
    old = I.image_rows(X.images(spark, d))
    new = I.image_rows(
        old.filter("length(source_url) % 2 = 0").select(
            "id", "source_url", F.lit("image/png").alias("content_type"), F.upper("source_url").cast("binary").alias("data")
        )
    )
    return I.upsert_by_key(old, new).select("id", "content_type", "sha256")


@query("table_replace", "S7", X.ctes("l") + "SELECT date, count(*) AS n, min(id) AS first_id FROM l GROUP BY date")
def _(spark, d):
    path = folder(spark) + "/events"
    sinks.write_events(X.events(spark, d), path)
    return sinks.stored_table(spark, path).groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query("delete_by_ids", "S8", X.ctes("l") + f"SELECT id FROM l WHERE NOT ({DECIDED})")
def _(spark, d):
    rows = X.listings(spark, d)
    return H.delete_by_ids(rows, rows.filter(DECIDED).select("id")).select("id")


@query("feed_rows", "S9 O1", X.ctes("l") + f"""SELECT act AS "eventName", venue_text AS venue, location, {LABEL} AS date, CAST(date AS VARCHAR) AS "isoDate", url, summary,
  thumbnail_url AS "thumbnailUrl", venue_id AS "venueId", {TAG_TEXT} AS tags, true AS "youtubeEligible", id, '{X.AS_OF}' AS generated FROM l""")
def _(spark, d):
    return L.to_feed(X.events(spark, d), X.AS_OF).withColumn("tags", F.array_join("tags", "|"))


@query("resource_feed_rows", "S9", X.ctes("l") + f"""SELECT act AS "eventName", venue_text AS venue, location, {LABEL} AS date, CAST(date AS VARCHAR) AS "isoDate", url, summary,
  thumbnail_url AS "thumbnailUrl", id FROM l""")
def _(spark, d):
    return L.resources_to_feed(X.resources(spark, d))


@query("feed_window", "S9 P1 P2 J1 O1", X.ctes("l", "v") + f"""SELECT act AS "eventName", venue_text AS venue, coalesce(v.location, l.location) AS location, {LABEL} AS date,
  CAST(date AS VARCHAR) AS "isoDate", url, summary, thumbnail_url AS "thumbnailUrl", venue_id AS "venueId", {TAG_TEXT} AS tags, true AS "youtubeEligible", l.id
FROM l LEFT JOIN v ON v.id = l.venue_id WHERE {WINDOW}""")
def _(spark, d):
    return L.windowed_feed(X.events(spark, d), X.venues(spark, d), X.AS_OF).withColumn("tags", F.array_join("tags", "|"))


@query("sitemap_rows", "S10", X.ctes("l") + f"""SELECT part, path, '  <url><loc>https://gigs.example' || replace(path, '&', '&amp;') || '</loc><lastmod>{X.AS_OF}</lastmod></url>' AS xml FROM (
  SELECT 0 AS part, unnest(['/', '/about']) AS path UNION ALL SELECT DISTINCT 1, '/tags/' || t FROM (SELECT unnest(tags) AS t FROM l WHERE {WINDOW})
  UNION ALL SELECT DISTINCT 2, '/venues/' || {S.slug('venue_text')} FROM l WHERE {WINDOW})""")
def _(spark, d):
    return sinks.sitemap(L.in_window(X.events(spark, d), X.AS_OF), "https://gigs.example", X.AS_OF)


@query("structured_items", "S11", X.ctes("l") + f"""SELECT CAST(row_number() OVER (ORDER BY date, id) AS INT) AS position,
  '{{"@type":"ListItem","position":' || row_number() OVER (ORDER BY date, id) || ',"item":{{"@type":"MusicEvent","name":"' || act || '","startDate":"' || date || '","url":"' || url
  || '","description":"' || summary || '"' || CASE WHEN thumbnail_url IS NULL THEN '' ELSE ',"image":"' || thumbnail_url || '"' END
  || ',"location":{{"@type":"MusicVenue","name":"' || venue_text || '","address":"' || location || '"}}}}}}' AS item FROM l ORDER BY date, id LIMIT 100""")
def _(spark, d):
    return sinks.event_item_list(L.to_feed(X.events(spark, d)), "https://gigs.example")


@query("snapshot_round_trip", "S12 A23", X.ctes("l") + "SELECT count(*) AS n, true AS unchanged, false AS first_seen, false AS after_loss FROM l")
def _(spark, d):
    rows = X.resources(spark, d)
    path = folder(spark) + "/snapshot"
    first = sinks.unchanged(rows, sinks.load_snapshot(spark, path)).select(F.col("unchanged").alias("first_seen"))
    sinks.save_snapshot(rows, path, X.AS_OF)
    saved = sinks.load_snapshot(spark, path)
    same = sinks.unchanged(rows.orderBy("url"), saved).select("unchanged")
    less = sinks.unchanged(rows.filter("title not like 'red %'"), saved).select(F.col("unchanged").alias("after_loss"))
    return saved.select("n").withColumns(
        {"unchanged": same.scalar(), "first_seen": first.scalar(), "after_loss": less.scalar()}
    )


@query("rule_table", "S13", X.ctes("l") + f"""SELECT 'drop_term' AS kind, r AS rule, count(*) AS n FROM (SELECT unnest(['small', 'brand#2']) AS r) JOIN l ON contains(act || ' ' || summary, r) GROUP BY ALL
UNION ALL SELECT 'exclusion', 'ring', count(*) FROM l WHERE contains(act || ' ' || summary, 'ring')""")
def _(spark, d):
    import json

    path = folder(spark) + "/rules.json"
    spark.createDataFrame([(json.dumps({"drop_terms": ["small", "brand#2"], "exclusions": ["ring"]}),)], "value string").coalesce(1).write.text(path)
    rules = readers.load_rules(spark, path)
    listed = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(r).alias("rule")) for k, rs in (("drop_term", rules.drop_terms), ("exclusion", rules.exclusions)) for r in rs])
    text = F.concat_ws(" ", "act", "summary")
    hits = X.listings(spark, d).select(F.explode(F.filter(listed, lambda r: F.contains(text, r["rule"]))).alias("r"))
    return hits.groupBy("r.kind", "r.rule").agg(F.count(F.lit(1)).alias("n"))


# Filters ------------------------------------------------------------------------------------


@query("http_rows", "P1", X.ctes("l") + "SELECT id, CASE WHEN order_key % 3 = 0 THEN '  HTTP://x.example/' || id ELSE url END AS url FROM l WHERE order_key % 3 <> 1")
def _(spark, d):
    messy = F.expr("CASE WHEN order_key % 3 = 0 THEN '  HTTP://x.example/' || id WHEN order_key % 3 = 1 THEN 'ftp://x' ELSE url END")
    return L.only_http(X.listings(spark, d).withColumn("url", messy)).select("id", "url")


@query("display_window", "P2", X.ctes("l") + f"SELECT id, date FROM l WHERE {WINDOW}")
def _(spark, d):
    return L.in_window(X.listings(spark, d), X.AS_OF).select("id", "date")


@query("future_rows", "P3", X.ctes("l") + f"SELECT id FROM l WHERE order_key % 5 <> 0 AND date >= DATE '{X.AS_OF}'")
def _(spark, d):
    messy = F.expr("CASE WHEN order_key % 5 = 0 THEN 'tba' ELSE concat(date, ' 20:00') END")
    return L.future_only(X.listings(spark, d).withColumn("date", messy), X.AS_OF).select("id")


@query("past_pruned", "P4", X.ctes("l") + f"SELECT id FROM l WHERE order_key % 5 = 0 OR date >= DATE '{X.AS_OF}'")
def _(spark, d):
    loose = F.expr("CASE WHEN order_key % 5 <> 0 THEN date END")
    return L.prune_past(X.listings(spark, d).withColumn("date", loose), X.AS_OF).select("id")


@query("past_counts", "P4", X.ctes("l") + f"SELECT count(*) FILTER (WHERE date < DATE '{X.AS_OF}') AS removed, count(*) FILTER (WHERE date >= DATE '{X.AS_OF}') AS kept FROM l")
def _(spark, d):
    return L.past_counts(X.listings(spark, d), X.AS_OF)


@query("word_exclusions", "P5", X.ctes("l") + f"SELECT id FROM l WHERE NOT {EXCLUDED}")
def _(spark, d):
    return L.drop_terms(X.events(spark, d), TERMS).select("id")


@query("rule_and_decision_exclusions", "P6", X.ctes("l") + f"SELECT id FROM l WHERE NOT {EXCLUDED} AND NOT ({DECIDED})")
def _(spark, d):
    rows = X.listings(spark, d)
    decisions = rows.filter(DECIDED).select("id").union(rows.select(F.concat(F.lit("gone-"), "id")))
    return L.apply_exclusions(X.stored(rows), TERMS, decisions).select("id")


@query("excluded_ids", "U4", X.ctes("l") + f"SELECT id FROM l WHERE {EXCLUDED} OR ({DECIDED})")
def _(spark, d):
    rows = X.listings(spark, d)
    decisions = rows.filter(DECIDED).select("id").union(rows.select(F.concat(F.lit("gone-"), "id")))
    return L.excluded_ids(X.stored(rows), TERMS, decisions)


@query("facet_filter", "P7", X.ctes("l") + "SELECT id FROM l WHERE venue_id = 'v-5' AND list_contains(tags, 'standard')")
def _(spark, d):
    return L.facet(X.events(spark, d), "id:v-5", "standard").select("id")


@query("slug_keys", "P8", X.ctes("l") + f"""SELECT slug, arg_min(key, id) AS key FROM (SELECT {S.slug('venue_text')} AS slug, id,
  CASE WHEN order_key % 2 = 0 THEN 'id:' || venue_id ELSE 'name:' || lower(venue_text) END AS key FROM l) GROUP BY slug""")
def _(spark, d):
    rows = X.listings(spark, d).withColumn("venue_id", F.expr("CASE WHEN order_key % 2 = 0 THEN venue_id ELSE ' ' END"))
    return L.resolve_slug(X.stored(rows))


@query("untagged_rows", "P9", X.ctes("l") + "SELECT id FROM l WHERE order_key % 4 = 0")
def _(spark, d):
    rows = X.listings(spark, d).withColumn("tags", F.expr("CASE WHEN order_key % 8 = 0 THEN NULL WHEN order_key % 4 = 0 THEN array(' ') ELSE tags END"))
    return L.needs_tags(rows).select("id")


QUALITY = f"coalesce(poster_quality, {S.poster_quality('coalesce(poster_url, i.source_url)', 'act')})"


@query("spotlight_pool", "P10", X.ctes("l", "i") + ", " + X.EVENTS_WITH_IMAGES + f"""SELECT ei.id, coalesce(poster_url, i.source_url) AS poster, {QUALITY} AS quality, poster_quality IS NULL AS backfill
FROM ei JOIN i ON i.id = ei.image_id WHERE {WINDOW} AND (poster_quality IS NULL OR poster_quality >= 2) AND {QUALITY} >= 2""")
def _(spark, d):
    return L.spotlight_candidates(X.events_with_images(spark, d), X.images(spark, d), X.AS_OF).select(
        "id", "poster", F.col("quality").cast("int").alias("quality"), "backfill"
    )


@query("image_predicate", "P11", X.ctes("l") + f"""SELECT thumbnail_url AS src, order_key % 120 AS width, coalesce(thumbnail_url, '') <> '' AND NOT ({S.decoration('thumbnail_url')}) AND order_key % 120 >= 80 AS fits,
  count(*) AS n FROM l GROUP BY ALL""")
def _(spark, d):
    rows = X.listings(spark, d).withColumn("width", F.expr("order_key % 120"))
    fits = urls.is_candidate_image("thumbnail_url", F.col("width").cast("string"), F.lit("auto"))
    return rows.groupBy(F.col("thumbnail_url").alias("src"), "width", fits.alias("fits")).agg(F.count(F.lit(1)).alias("n"))


PAGE_LINK = "concat(url, CASE page_id % 7 WHEN 0 THEN '/cart' WHEN 1 THEN '/street-food-lineup' WHEN 2 THEN '/food-and-live-music' WHEN 3 THEN '/winery-sessions' WHEN 4 THEN '/menu/' WHEN 5 THEN '/search/x' ELSE '' END)"


@query("unlikely_pages", "P12", f"SELECT page_id, {PAGE_LINK} AS link, {S.unlikely_page(PAGE_LINK)} AS unlikely FROM pages")
def _(spark, d):
    link = F.expr(PAGE_LINK)
    return X.table(spark, d, "pages").select("page_id", link.alias("link"), urls.is_unlikely_event_page(link).alias("unlikely"))


@query("event_signals", "P13", f"SELECT page_id, {PAGE_LINK} AS link, {S.event_signal(PAGE_LINK)} AS signal FROM pages")
def _(spark, d):
    link = F.expr(PAGE_LINK)
    return X.table(spark, d, "pages").select("page_id", link.alias("link"), urls.has_event_signal(link).alias("signal"))


HOST_TEXT = "concat(CASE page_id % 3 WHEN 0 THEN 'www.facebook.com' WHEN 1 THEN 'linktr.ee' ELSE '' END, split(url, '/')[{}])"


@query("aggregator_hosts", "P14", f"SELECT page_id, {HOST_TEXT.format(3)} AS host, {S.any_of('lower(' + HOST_TEXT.format(3) + ')', V.AGGREGATOR_FRAGMENTS)} AS aggregator FROM pages")
def _(spark, d):
    name = F.expr(HOST_TEXT.format(2))
    return X.table(spark, d, "pages").select("page_id", name.alias("host"), urls.is_aggregator(name).alias("aggregator"))


@query("fresh_links", "P15", X.ctes("v") + "SELECT id, CASE WHEN last_mined IS NULL THEN false ELSE CAST(events_link_checked AS TIMESTAMP) > TIMESTAMP '2000-01-31' - INTERVAL 14 DAY END AS fresh FROM v")
def _(spark, d):
    checked = F.expr("CASE WHEN last_mined IS NULL THEN 'never' ELSE events_link_checked END")
    return X.venues(spark, d).select("id", is_fresh(checked, "2000-01-31 00:00:00", 14).alias("fresh"))


@query("stale_sources", "P16", X.ctes("mem") + "SELECT host, url, runs_contributed > 3 * greatest(events_added - 20, 0) AS stale FROM mem")
def _(spark, d):
    return X.view(spark, d, "mem").select("host", "url", is_stale("runs_contributed", F.col("events_added") - 20).alias("stale"))


EMAIL = "CASE c_custkey % 5 WHEN 0 THEN ' ' || replace(c_name, '#', '.') || '@Mail.example ' WHEN 1 THEN replace(c_name, '#', '') || '@list.example' WHEN 2 THEN c_name WHEN 3 THEN c_mktsegment || '@list.example' ELSE c_name || '@x..y' END"


@query("subscriptions", "P17", f"""WITH asked AS (SELECT lower(trim({EMAIL})) AS email FROM customer WHERE c_custkey % 5 IN (0, 1, 3)),
stored AS (SELECT DISTINCT lower(c_mktsegment || '@list.example') AS email FROM customer WHERE c_nationkey = 3)
SELECT email, TIMESTAMP '1999-01-01' AS subscribed_at FROM stored UNION ALL SELECT DISTINCT email, TIMESTAMP '{X.AS_OF}' FROM asked WHERE email NOT IN (SELECT email FROM stored)""")
def _(spark, d):
    rows = X.table(spark, d, "customer")
    users = rows.filter("c_nationkey = 3").select(F.lower(F.concat("c_mktsegment", F.lit("@list.example"))).alias("email")).distinct()
    users = users.withColumn("subscribed_at", F.lit("1999-01-01 00:00:00").cast("timestamp"))
    return H.subscribe(users, rows.select(F.expr(EMAIL).alias("email")), f"{X.AS_OF} 00:00:00")


@query("comment_checks", "P18", """SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'name is required' WHEN trim(text) = '' THEN 'comment is required' WHEN length(trim(text)) > 2000 THEN 'comment must be 2000 characters or fewer' END AS reason FROM conversations""")
def _(spark, d):
    rows = X.table(spark, d, "conversations").select("conv_id", "turn", F.expr("CASE WHEN turn % 3 = 2 THEN ' ' ELSE role END").alias("name"), F.col("text").alias("comment"))
    return H.check_comments(rows).select("conv_id", "turn", "reason")


NIGHT = "CASE order_key % 7 WHEN 0 THEN 'Tribute to ' || act WHEN 1 THEN 'Live  Music' WHEN 2 THEN act || ' covers night [18+]' WHEN 3 THEN '1234 5' ELSE act END"
NIGHT_TAGS = "CASE order_key % 5 WHEN 0 THEN ['Open  Mic'] WHEN 1 THEN ['cover band'] ELSE tags END"


@query("eligible_acts", "P19", X.ctes("l") + f"SELECT {NIGHT} AS act, array_to_string({NIGHT_TAGS}, '|') AS tags, order_key % 7 IN (4, 5, 6) AND order_key % 5 IN (2, 3, 4) AS eligible, count(*) AS n FROM l GROUP BY ALL")
def _(spark, d):
    rows = X.listings(spark, d).select(
        F.expr(NIGHT).alias("act"), F.expr("CASE order_key % 5 WHEN 0 THEN array('Open  Mic') WHEN 1 THEN array('cover band') ELSE tags END").alias("tags")
    )
    return rows.groupBy("act", F.array_join("tags", "|").alias("tags"), act_eligible("act", "tags").alias("eligible")).agg(F.count(F.lit(1)).alias("n"))


# Migrations ---------------------------------------------------------------------------------


@query("drop_column_migration", "P20", X.ctes("l") + "SELECT id, act FROM l")
def _(spark, d):
    rows = X.listings(spark, d).select("id", "act", "thumbnail_url")
    return H.drop_column(rows, "thumbnail_url")[0]


LOOSE = "CASE WHEN order_key % 3 = 0 THEN '' ELSE venue_id END"


@query("location_migration", "P20", X.ctes("l", "v") + f""", x AS (SELECT *, CASE WHEN order_key % 3 = 0 THEN k.vid ELSE venue_id END AS target, CASE WHEN order_key % 4 = 0 THEN ' ' ELSE location || ' ' || order_key END AS place
  FROM l LEFT JOIN (SELECT {S.core('name')} AS ck, id AS vid FROM v) k ON k.ck = {S.core('l.venue_text')})
SELECT v.id, coalesce(m.place, v.location) AS location FROM v LEFT JOIN (SELECT target, arg_max(trim(place), id) AS place FROM x WHERE trim(place) <> '' GROUP BY target) m ON m.target = v.id""")
def _(spark, d):
    rows = X.listings(spark, d)
    messy = X.stored(rows.withColumns({
        "venue_id": F.expr(LOOSE), "location": F.expr("CASE WHEN order_key % 4 = 0 THEN ' ' ELSE concat(location, ' ', order_key) END")}))
    return H.move_location_to_venues(messy, X.venues(spark, d))[1].select("id", "location")


@query("default_tags_migration", "P20", X.ctes("l") + "SELECT id, CASE WHEN order_key % 4 = 0 THEN '' ELSE array_to_string(tags, '|') END AS tags FROM l")
def _(spark, d):
    rows = X.listings(spark, d).withColumn("tags", F.expr("CASE WHEN order_key % 4 <> 0 THEN tags END"))
    return H.default_array(rows, "tags")[0].select("id", F.array_join("tags", "|").alias("tags"))


NEW_VENUE = "CASE WHEN order_key % 5 = 0 THEN concat('Hall ', location) WHEN order_key % 5 = 1 THEN '' ELSE venue_text END"
LINKED = f"""x AS (SELECT id, {NEW_VENUE} AS raw, {S.core(NEW_VENUE)} AS ck FROM l),
k AS (SELECT ck, arg_min(id, id) AS vid, arg_min(name, id) AS vname FROM (SELECT id, name, {S.core('name')} AS ck FROM v UNION ALL SELECT id, name, {S.core('a')} FROM (SELECT id, name, unnest(aliases) AS a FROM v)) GROUP BY ck),
n AS (SELECT ck, 'n-' || substr(sha256(ck), 1, 16) AS vid, arg_min(raw, id) AS vname FROM x WHERE ck <> '' AND ck NOT IN (SELECT ck FROM k) GROUP BY ck),
a AS (SELECT * FROM k UNION ALL SELECT * FROM n)
"""


@query("linked_venue_migration", "P21", X.ctes("l", "v") + ", " + LINKED + "SELECT x.id, coalesce(a.vname, '') AS venue, coalesce(a.vid, '') AS venue_id FROM x LEFT JOIN a USING (ck)")
def _(spark, d):
    rows = X.listings(spark, d).select("id", F.expr(NEW_VENUE).alias("venue"), "ord")
    out = H.link_venues(rows, X.venues(spark, d))[0]
    return out.select("id", F.coalesce("venue.name", F.lit("")).alias("venue"), F.coalesce("venue.id", F.lit("")).alias("venue_id"))


@query("linked_venue_counts", "P21", X.ctes("l", "v") + ", " + LINKED + """SELECT (SELECT count(*) FROM x) AS events_scanned, (SELECT count(*) FROM x WHERE ck <> '') AS events_linked,
  (SELECT count(*) FROM n) AS venues_created, (SELECT count(*) FROM v) + (SELECT count(*) FROM n) AS venues_total""")
def _(spark, d):
    rows = X.listings(spark, d).select("id", F.expr(NEW_VENUE).alias("venue"), "ord")
    return H.link_venues(rows, X.venues(spark, d))[2]


@query("clipped_texts", "P22", """SELECT doc_id, CASE WHEN length(text) <= 400 THEN text WHEN position('the ' IN text) = 0 THEN substr(text, 1, 400)
  WHEN length(text) - position('the ' IN text) + 1 >= 400 THEN substr(text, position('the ' IN text), 400)
  ELSE substr(text, 1, 400 - (length(text) - position('the ' IN text) + 1)) || substr(text, position('the ' IN text)) END AS clipped FROM documents""")
def _(spark, d):
    return X.table(spark, d, "documents").select("doc_id", clip_keep_tail("text", "the ", 400).alias("clipped"))


# Order and pages ----------------------------------------------------------------------------


@query("venue_page", "O5 O6", X.ctes("v") + f"""SELECT id, name, {S.core('name')} AS sort_name, (SELECT count(*) FROM v) AS total FROM v ORDER BY {S.core('name')}, name LIMIT 20 OFFSET 10""")
def _(spark, d):
    return L.page(L.venues_sorted(X.venues(spark, d)), ["sort_name", "name"], 20, 10).select("id", "name", "sort_name", "total")


@query("venue_order", "O6", X.ctes("v") + f"SELECT id, {S.core('CASE WHEN last_mined IS NULL THEN concat(chr(84), chr(104), chr(101), chr(32), name) ELSE name END')} AS sort_name FROM v")
def _(spark, d):
    named = X.venues(spark, d).withColumn("name", F.expr("CASE WHEN last_mined IS NULL THEN concat('The ', name) ELSE name END"))
    return L.venues_sorted(named).select("id", "sort_name")


@query("venue_events", "O10", X.ctes("l") + f"""SELECT id, act AS "eventName", {LABEL} AS date, CAST(date AS VARCHAR) AS "isoDate", url FROM l WHERE venue_id = 'v-12'""")
def _(spark, d):
    return L.events_for_venue(X.events(spark, d), "v-12")


@query("distinct_tags", "A20", X.ctes("l") + "SELECT DISTINCT lower(trim(t)) AS tag FROM (SELECT unnest(tags) AS t FROM l)")
def _(spark, d):
    return L.distinct_tags(X.listings(spark, d))


@query("incoming_dedupe", "W11", X.ctes("l") + f"""SELECT min(id) AS id FROM (SELECT id, lower(url) AS u, CASE WHEN order_key % 3 = 0 THEN 'soon' ELSE CAST(date AS VARCHAR) END AS dd, lower(act) AS t FROM l) GROUP BY u, dd, t""")
def _(spark, d):
    rows = X.listings(spark, d).select(
        "id", F.col("act").alias("title"), "url", F.expr("CASE WHEN order_key % 3 = 0 THEN ' Soon' ELSE concat(date, 'T20:00') END").alias("date"), "ord"
    )
    return L.dedupe_incoming(rows, keep=["id"])


@query("fingerprint_rows", "A22", X.ctes("l") + """, h AS (SELECT sha256(lower(url) || chr(1) || lower(act || ' @ ' || venue_text || ', ' || location)) AS h FROM l)
SELECT sha256(count(*) || '-' || sum(('0x' || substr(h, 1, 15))::BIGINT) || '-' || sum(('0x' || substr(h, 16, 15))::BIGINT) || '-' || sum(('0x' || substr(h, 31, 15))::BIGINT)
  || '-' || sum(('0x' || substr(h, 46, 15))::BIGINT)) AS fingerprint, count(*) AS n FROM h""")
def _(spark, d):
    return sinks.fingerprint(X.resources(spark, d))
