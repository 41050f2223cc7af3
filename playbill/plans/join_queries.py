"""Joins, entity resolution, duplicate removal and the merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from playbill.functions import urls
from playbill.operators import components as C
from playbill.operators import crawl as R
from playbill.operators import hygiene as H
from playbill.operators import images as I
from playbill.operators import listings as L
from playbill.operators import merge as M
from playbill.operators import pages as P
from playbill.operators import scorecards as K
from playbill.operators import venues as N
from playbill.plans import merge_sql as Q
from playbill.plans import sql as S
from playbill.plans import views as X
from playbill.plans.function_queries import SCORE
from playbill.plans.listing_queries import DECIDED, EXCLUDED, LINKED, NEW_VENUE, TERMS
from playbill.plans.registry import query

OLD = "old AS (SELECT * FROM l WHERE order_key % 2 = 0), new AS (SELECT * FROM l WHERE order_key % 2 = 1)\n"


def halves(spark, d):
    """Stored and incoming rows, both already linked to their venues."""
    rows = X.listings(spark, d)
    return X.stored(rows.filter("order_key % 2 = 1")), X.stored(rows.filter("order_key % 2 = 0"))


# Lookups ------------------------------------------------------------------------------------


@query("event_posters", "J2", X.ctes("l", "i") + ", " + X.EVENTS_WITH_IMAGES + "SELECT ei.id, coalesce(poster_url, i.source_url) AS poster FROM ei LEFT JOIN i ON i.id = ei.image_id WHERE coalesce(poster_url, i.source_url) IS NOT NULL")
def _(spark, d):
    return L.poster_urls(X.events_with_images(spark, d), X.images(spark, d))


@query("venue_resolution", "J3", X.ctes("l", "v") + ", " + LINKED + "SELECT coalesce(a.vid, '') AS venue_id, coalesce(a.vname, '') AS venue, count(*) AS n, count(DISTINCT x.raw) AS spellings FROM x LEFT JOIN a USING (ck) GROUP BY ALL")
def _(spark, d):
    rows = X.listings(spark, d).select("id", F.expr(NEW_VENUE).alias("venue_text"), "ord")
    linked, _ = N.resolve_venues(rows, X.venues(spark, d))
    # distinct spellings first, so a dominant venue is spread before it is counted
    per = linked.groupBy("venue_id", "venue", "venue_text").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("venue_id", "venue").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("spellings"))


@query("created_venues", "J3", X.ctes("l", "v") + ", " + LINKED + "SELECT vid AS id, vname AS name FROM n")
def _(spark, d):
    rows = X.listings(spark, d).select("id", F.expr(NEW_VENUE).alias("venue_text"), "ord")
    return N.resolve_venues(rows, X.venues(spark, d))[1].select("id", "name")


HOST_VENUES = f"""hv AS (SELECT DISTINCT regexp_extract({S.netloc('url')}, '([a-z0-9]+)[.]example', 1) AS id FROM pages),
names AS (SELECT id, 'The ' || upper(id) || '!' AS name, 'The ' || upper(id) || '!' AS spelling FROM hv UNION ALL SELECT id, 'The ' || upper(id) || '!', id || ' - arms' FROM hv),
vk AS (SELECT id, name, regexp_replace({S.core('spelling')}, '[^a-z0-9]', '', 'g') AS vkey FROM names),
hosts AS (SELECT DISTINCT {S.netloc('url')} AS host FROM pages),
parts AS (SELECT host, list_filter(string_split(host, '.'), lambda p: p <> '' AND p <> 'www') AS ps FROM hosts),
brands AS (SELECT host, ps[list_position([length(p) for p in ps], list_max([length(p) for p in ps]))] AS brand FROM parts)
"""


def host_venues(spark, d):
    """Venues named after the pages' own hosts."""
    label = F.regexp_extract(urls.netloc("url"), "([a-z0-9]+)[.]example", 1)
    rows = X.table(spark, d, "pages").select(label.alias("id")).distinct()
    return rows.select(
        "id", F.concat(F.lit("The "), F.upper("id"), F.lit("!")).alias("name"), F.array(F.concat("id", F.lit(" - arms"))).alias("aliases"),
        F.col("id").alias("ord"), F.lit("").alias("location"),
    )


@query("host_venue_match", "J4", "WITH " + HOST_VENUES + """SELECT host, brand, arg_min(id, id) AS venue_id, arg_min(name, id) AS venue FROM brands JOIN vk
ON length(vkey) >= 4 AND (contains(brand, vkey) OR contains(vkey, brand)) GROUP BY host, brand""")
def _(spark, d):
    hosts = X.table(spark, d, "pages").select(urls.netloc("url").alias("host"))
    return N.match_hosts(hosts, host_venues(spark, d))


@query("venue_mentions", "J5", f"""WITH k AS (SELECT DISTINCT item_id, {S.core('piece')} AS core FROM (SELECT item_id, unnest(string_split(text, '. ')) AS piece FROM benchmark)),
t AS (SELECT doc_id, {S.collapse('text')} AS t FROM documents) SELECT DISTINCT doc_id AS row_id, item_id AS venue_id FROM t JOIN k ON length(core) >= 4 AND contains(t, core)""")
def _(spark, d):
    # every sentence of a passage is a name of its item
    sentences = F.split("text", r"\. ")
    rows = X.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), sentences[0].alias("name"), sentences.alias("aliases"), F.col("item_id").alias("ord"))
    return N.mentions(X.table(spark, d, "documents"), rows, "text", "doc_id")


@query("reingested_rows", "J6", X.ctes("l") + ", " + OLD + "SELECT id FROM new WHERE EXISTS (SELECT 1 FROM old WHERE lower(old.url) = lower(new.url) AND lower(old.act) = lower(new.act) AND old.date = new.date)")
def _(spark, d):
    new, old = halves(spark, d)
    return M.reingest(new, old).select("id")


@query("exact_matches", "J7", X.ctes("l") + ", " + OLD + "SELECT new.id, m.match_id FROM new JOIN (SELECT lower(act) AS a, date AS dd, max(id) AS match_id FROM old GROUP BY ALL) m ON lower(new.act) = m.a AND new.date = m.dd")
def _(spark, d):
    new, old = halves(spark, d)
    return M.exact_match(new, old).select("id", "match_id")


@query("partial_matches", "J8", X.ctes("l") + ", " + OLD + """SELECT new.id, min(old.id) AS match_id FROM new JOIN old ON new.date = old.date AND new.venue_id = old.venue_id
AND length(new.act) >= 4 AND length(old.act) >= 4 AND (contains(lower(new.act), lower(old.act)) OR contains(lower(old.act), lower(new.act))) GROUP BY new.id""")
def _(spark, d):
    new, old = halves(spark, d)
    return M.partial_match(new, old).select("id", "match_id")


ODD = "CAST(substr(key, 3) AS INT) % 2 = 1"


@query("venue_score_lookup", "J9", X.ctes("v", "card") + f"""SELECT v.id, round(coalesce(a.score, b.score), 6) AS score FROM v LEFT JOIN (SELECT key, {SCORE} AS score FROM card WHERE NOT {ODD}) a ON a.key = v.id
LEFT JOIN (SELECT 'supplier#' || lpad(substr(key, 3), 9, '0') AS key, {SCORE} AS score FROM card WHERE {ODD}) b ON b.key = lower(v.name)""")
def _(spark, d):
    cards = X.view(spark, d, "card").withColumn("kind", F.lit("venue"))
    named = F.concat(F.lit("supplier#"), F.lpad(F.substr("key", F.lit(3)), 9, "0"))
    # every second card goes by the name of its venue, the others by its id
    keyed = cards.withColumn("key", F.when(F.expr(ODD), named).otherwise(F.col("key")))
    return K.venue_scores(X.venues(spark, d), keyed, X.SCORE_CLOCK).select("id", F.round("score", 6).alias("score"))


# Orphans and upkeep -------------------------------------------------------------------------


# customers stand in for venues without a listing, pages for images that no listing shows
PLACES = "places AS (SELECT id, name, last_event_date FROM v UNION ALL SELECT concat('c-', CAST(c_custkey AS VARCHAR)), c_name, NULL FROM customer)\n"


def places(spark, d):
    customers = X.table(spark, d, "customer").select(F.concat(F.lit("c-"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"))
    return X.venues(spark, d).unionByName(customers, allowMissingColumns=True)


@query("orphan_venues", "J11", X.ctes("l", "v") + ", " + PLACES + "SELECT id, name FROM places WHERE id NOT IN (SELECT venue_id FROM l)")
def _(spark, d):
    return N.orphans(places(spark, d), X.listings(spark, d)).select("id", "name")


@query("kept_venues", "J11", X.ctes("l", "v") + ", " + PLACES + "SELECT id, name FROM places WHERE id IN (SELECT venue_id FROM l)")
def _(spark, d):
    return N.drop_orphans(places(spark, d), X.listings(spark, d)).select("id", "name")


@query("image_gc", "J12", X.ctes("l", "i") + ", " + X.EVENTS_WITH_IMAGES + """, every AS (SELECT id, source_url FROM i UNION ALL SELECT concat('page-', CAST(page_id AS VARCHAR)), url FROM pages)
SELECT id, source_url, id IN (SELECT image_id FROM ei WHERE image_id IS NOT NULL) AS kept FROM every""")
def _(spark, d):
    unused = X.table(spark, d, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("id"), F.col("url").alias("source_url"))
    images, active = X.images(spark, d).unionByName(unused, allowMissingColumns=True), X.events_with_images(spark, d)
    kept = I.gc_images(images, active).withColumn("kept", F.lit(True))
    return kept.unionByName(I.dead_images(images, active).withColumn("kept", F.lit(False))).select("id", "source_url", "kept")


@query("deleted_venue_counts", "J16", X.ctes("l") + "SELECT 0 AS events_updated, (SELECT count(*) FROM l WHERE venue_id = 'v-3') AS events_deleted, 1 AS venues_deleted")
def _(spark, d):
    return N.delete_venue(X.venues(spark, d), X.events_with_images(spark, d), X.images(spark, d), "v-3", delete_linked=True)["counts"]


@query("reassigned_events", "J16", X.ctes("l", "v") + "SELECT l.id, CASE WHEN venue_id = 'v-3' THEN 'v-4' ELSE venue_id END AS venue_id, CASE WHEN venue_id = 'v-3' THEN (SELECT name FROM v WHERE id = 'v-4') ELSE venue_text END AS venue FROM l")
def _(spark, d):
    out = N.delete_venue(X.venues(spark, d), X.events_with_images(spark, d), X.images(spark, d), "v-3", "v-4")
    return out["events"].select("id", "venue_id", "venue")


@query("guarded_decisions", "J18", X.ctes("l") + f"SELECT id FROM l WHERE {DECIDED}")
def _(spark, d):
    rows = X.listings(spark, d)
    raw = rows.filter(DECIDED).select(F.concat(F.lit(" "), "id").alias("id")).union(rows.select(F.concat(F.lit("gone-"), "id")))
    return L.guard(raw, rows)


@query("assigned_tags", "J19", X.ctes("l") + """SELECT id, CASE WHEN order_key % 4 <> 0 THEN array_to_string(tags, '|') WHEN order_key % 3 = 0 THEN lower(location) || '|live' ELSE '' END AS tags FROM l""")
def _(spark, d):
    rows = X.listings(spark, d).withColumn("tags", F.expr("CASE WHEN order_key % 4 = 0 THEN array() ELSE tags END"))
    given = rows.filter("order_key % 3 = 0").select("id", F.array(F.col("location"), F.lit(" LIVE "), F.lit("live")).alias("tags"), "ord")
    first = given.withColumns({"tags": F.array(F.lit("older")), "ord": F.lit("")})
    return H.apply_tags(rows, given.unionByName(first)).select("id", F.array_join("tags", "|").alias("tags"))


PLACE = "CASE WHEN order_key % 4 = 0 THEN '' ELSE concat(location, ' ', CAST(order_key AS STRING)) END"


@query("synced_locations", "J20", X.ctes("l", "v") + f"""SELECT v.id, coalesce(m.place, v.location) AS location FROM v
LEFT JOIN (SELECT venue_id, arg_max(place, id) AS place FROM (SELECT id, venue_id, {PLACE} AS place FROM l) WHERE place <> '' GROUP BY venue_id) m ON m.venue_id = v.id""")
def _(spark, d):
    rows = X.listings(spark, d).withColumn("location", F.expr(PLACE))
    return N.sync_locations(rows, X.venues(spark, d)).select("id", "location")


@query("image_updates", "J21", X.ctes("l", "i") + ", " + X.EVENTS_WITH_IMAGES + """SELECT id, CASE WHEN order_key % 5 = 0 THEN 'new-' || id ELSE image_id END AS image_id,
  CASE WHEN order_key % 10 = 0 THEN 3 WHEN order_key % 5 = 0 THEN -1 ELSE poster_quality END AS poster_quality, CASE WHEN order_key % 10 = 0 THEN 'https://p.example/' || id ELSE poster_url END AS poster_url FROM ei""")
def _(spark, d):
    rows = X.events_with_images(spark, d)
    keyed = rows.withColumn("k", F.split("id", "-")[1].cast("bigint")).filter("k % 5 = 0")
    ten = F.col("k") % 10 == 0
    delta = keyed.select(
        "id", F.concat(F.lit("new-"), "id").alias("image_id"), F.when(ten, 3).alias("poster_quality"), F.when(ten, F.concat(F.lit("https://p.example/"), "id")).alias("poster_url")
    )
    return I.update_images(rows, delta).select("id", "image_id", "poster_quality", "poster_url")


THUMB = "CASE order_key % 5 WHEN 0 THEN '/api/gigs/images/x.jpg' WHEN 1 THEN 'ftp://x' ELSE thumbnail_url END"


@query("resolved_assets", "J22", X.ctes("l", "i") + f""", x AS (SELECT l.*, {THUMB} AS t FROM l), y AS (SELECT x.*, c.id AS image FROM x LEFT JOIN i c ON c.source_url = x.t AND c.data IS NOT NULL)
SELECT id, CASE WHEN t LIKE '/api/gigs/%' THEN t WHEN image IS NOT NULL THEN '/api/gigs/images/' || image END AS thumbnail_url, image AS image_id,
  CASE WHEN t LIKE '/api/gigs/%' THEN NULL WHEN image IS NOT NULL THEN {S.poster_quality('t', 'act')} ELSE -1 END AS poster_quality, CASE WHEN image IS NOT NULL THEN t END AS poster_url FROM y""")
def _(spark, d):
    rows = X.listings(spark, d).select("id", F.concat("act", F.lit(" @ "), "venue_text").alias("title"), F.expr(THUMB).alias("thumbnail_url"))
    return I.resolve_assets(rows, X.images(spark, d), "gigs").select(
        "id", "thumbnail_url", "image_id", F.col("poster_quality").cast("int").alias("poster_quality"), "poster_url"
    )


@query("registered_sources", "S6 J22", X.ctes("l", "i") + """, u AS (SELECT DISTINCT thumbnail_url AS url FROM l WHERE thumbnail_url IS NOT NULL),
m AS (SELECT url, substr(sha256(url), 1, 16) || '.jpg' AS id FROM u WHERE url NOT IN (SELECT source_url FROM i WHERE data IS NOT NULL))
SELECT id, source_url, data IS NOT NULL AS filled FROM i UNION ALL SELECT id, url, false FROM m""")
def _(spark, d):
    wanted = X.listings(spark, d).select(F.col("thumbnail_url").alias("url"))
    return I.register_sources(X.images(spark, d), wanted).select("id", "source_url", F.col("data").isNotNull().alias("filled"))


# Pages --------------------------------------------------------------------------------------


def page_resources(spark, d, per_page: int = 3):
    """Three incoming rows per page: two that ask for its picture by name and one with a poster of its own."""
    pages = X.view(spark, d, "pi")
    n = F.explode(F.array(*[F.lit(i) for i in range(per_page)]))
    rows = pages.select("page_id", "url", n.alias("k"))
    title = F.when(F.col("k") < 2, F.concat(F.lit("page-"), (F.col("page_id") % 40).cast("string"), F.lit(" band @ Hall"))).otherwise("Someone Else @ Hall")
    thumb = F.when(F.col("k") == 2, F.concat(F.lit("https://own.example/"), F.col("page_id").cast("string"), F.lit(".jpg")))
    return rows.select(
        F.concat_ws("-", "page_id", "k").alias("id"), title.alias("title"), "url", thumb.alias("thumbnail_url"), F.format_string("%012d-%d", "page_id", "k").alias("ord")
    )


ABS_IMG = f"{S.scheme('url')} || '://' || {S.netloc('url')}"


@query("assigned_images", "J13", X.ctes("pi") + f""", g AS (SELECT page_id, url, {ABS_IMG} || '/uploads/page-' || page_id % 40 || '.jpg' AS src FROM pi),
s AS (SELECT url, src, row_number() OVER (PARTITION BY url ORDER BY min(page_id)) AS n FROM g GROUP BY url, src),
r AS (SELECT page_id, url, k, row_number() OVER (PARTITION BY url ORDER BY page_id, k) AS n FROM pi, (SELECT unnest([0, 1]) AS k))
SELECT page_id || '-' || k AS id, src AS thumbnail_url FROM r LEFT JOIN s USING (url, n)
UNION ALL SELECT page_id || '-2', 'https://own.example/' || page_id || '.jpg' FROM pi""")
def _(spark, d):
    return I.assign_images(page_resources(spark, d), X.view(spark, d, "pi")).select("id", "thumbnail_url")


@query("fallback_images", "J14", X.ctes("pi") + f""", o AS (SELECT url, min({ABS_IMG} || '/og/' || page_id || '.jpg') AS og FROM pi GROUP BY url)
SELECT page_id || '-' || k AS id, CASE WHEN k = 2 THEN 'https://own.example/' || page_id || '.jpg' ELSE og END AS thumbnail_url FROM pi JOIN o USING (url), (SELECT unnest([0, 1, 2]) AS k)""")
def _(spark, d):
    return I.fallback_image(page_resources(spark, d), X.view(spark, d, "pi")).select("id", "thumbnail_url")


@query("merged_seeds", "J17", f"""WITH e AS (SELECT min(page_id) AS ord, url || ').' AS link FROM pages WHERE page_id % 4 = 0 GROUP BY url),
x AS (SELECT lower(rtrim(rtrim(link, ').,]}}"'''), '>')) AS k, arg_min(rtrim(rtrim(link, ').,]}}"'''), '>'), ord) AS link, min(ord) AS ord FROM e GROUP BY 1),
f AS (SELECT lower(url) AS k, arg_min(url, page_id) AS link, min(page_id) AS ord FROM pages WHERE {S.netloc('url')} NOT IN (SELECT {S.netloc('link')} FROM x) AND lower(url) NOT IN (SELECT k FROM x) GROUP BY 1)
SELECT 0 AS tier, ord, link FROM x UNION ALL SELECT 1, ord, link FROM f""")
def _(spark, d):
    rows = X.table(spark, d, "pages").select(F.col("url").alias("link"), F.col("page_id").alias("ord"))
    extra = rows.filter("ord % 4 = 0").withColumn("link", F.concat("link", F.lit(").")))
    return P.merge_seeds(extra, rows)


@query("discovered_venue_links", "W16")
def _(spark, d):
    # every site's first page stands in for its home page and names its listing page
    pages = X.table(spark, d, "pages")
    results = pages.select(F.col("url").alias("link"), F.col("page_id").alias("ord"))
    listing = F.concat("html", F.lit('<a href="/whats-on">Gigs</a>'))
    homes = pages.select("page_id", urls.root_url("url").alias("url"), listing.alias("html"))
    return R.discover(results, host_venues(spark, d), homes, 3)


# Clusters -----------------------------------------------------------------------------------

PAIRS = """pairs AS (SELECT doc_id AS a, lead(doc_id) OVER (PARTITION BY n_chars ORDER BY doc_id) AS b FROM documents
  UNION ALL SELECT doc_id, lead(doc_id) OVER (PARTITION BY text ORDER BY doc_id) FROM documents)"""


def copy_groups(spark, d):
    """Documents of equal length, and documents with equal texts, as groups."""
    docs = X.table(spark, d, "documents").select("doc_id", "n_chars", F.md5("text").alias("copy"))
    groups = [docs.select(F.concat_ws(":", F.lit(key), key).alias("group_id"), F.col("doc_id").alias("id")) for key in ("n_chars", "copy")]
    return groups[0].union(groups[1])


@query("duplicate_clusters", "J15", f"""WITH RECURSIVE {PAIRS}, sym AS (SELECT a, b FROM pairs WHERE b IS NOT NULL UNION SELECT b, a FROM pairs WHERE b IS NOT NULL),
reach AS (SELECT a, b FROM sym UNION SELECT reach.a, sym.b FROM reach JOIN sym ON reach.b = sym.a)
SELECT a AS id, min(b) AS cluster FROM reach GROUP BY a""")
def _(spark, d):
    return C.connected_components(C.group_edges(copy_groups(spark, d))).select(F.col("node").alias("id"), F.col("label").alias("cluster"))


SURVIVORS = f"""g AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY lower(act), date ORDER BY thumbnail_url IS NULL, length(summary) DESC, length(act) DESC, id) AS rank FROM l WINDOW w AS (PARTITION BY lower(act), date)),
p AS (SELECT lower(act) AS ka, date AS kd, arg_min(id, rank) AS id, min(n) AS n, arg_min(url, rank) AS url, arg_min(venue_text, (-length(venue_text), id)) AS venue,
  arg_min(location, (-length(location), id)) AS location, arg_min(summary, (-length(summary), id)) AS summary, arg_min(venue_id, id) AS venue_id,
  coalesce(arg_min(thumbnail_url, id) FILTER (WHERE thumbnail_url IS NOT NULL), '') AS poster_url, arg_min(array_to_string(tags, '|'), rank) AS tags FROM g GROUP BY ALL),
o AS (SELECT p.id, l.url, min(l.id) AS pos FROM p JOIN l ON lower(l.act) = p.ka AND l.date = p.kd AND l.id <> p.id WHERE {S.domain('l.url')} <> {S.domain('p.url')} GROUP BY ALL),
s AS (SELECT id, string_agg(url, '|' ORDER BY pos) AS sources FROM o GROUP BY id)
"""


@query("exact_duplicates", "A3 A4 U3", X.ctes("l") + ", " + SURVIVORS + "SELECT p.id, kd AS date, venue, venue_id, location, summary, poster_url, url, tags, coalesce(sources, '') AS sources, n FROM p LEFT JOIN s USING (id)")
def _(spark, d):
    out = M.dedupe_exact(X.events(spark, d))
    return out.select(
        "id", "date", "venue", "venue_id", "location", "summary", "poster_url", "url", F.array_join("tags", "|").alias("tags"), F.array_join("sources", "|").alias("sources"), "n"
    )


@query("cluster_survivors", "A3 J15", f"""WITH RECURSIVE {PAIRS}, sym AS (SELECT a, b FROM pairs WHERE b IS NOT NULL UNION SELECT b, a FROM pairs WHERE b IS NOT NULL),
reach AS (SELECT a, b FROM sym UNION SELECT reach.a, sym.b FROM reach JOIN sym ON reach.b = sym.a), lab AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
m AS (SELECT coalesce(c, doc_id) AS c, doc_id, length(text) AS k, length(substr(text, 1, 40)) AS ka, source FROM documents LEFT JOIN lab ON a = doc_id)
SELECT c AS cluster, arg_min(doc_id, (-k, -ka, doc_id)) AS doc_id, count(*) AS n, arg_min(source, (-length(source), doc_id)) AS venue FROM m GROUP BY c""")
def _(spark, d):
    docs = X.documents(spark, d)
    rows = docs.select(
        F.col("doc_id"), F.col("ord").alias("id"), "act", "venue", "venue_id", "location", "date", "url", F.array().cast("array<string>").alias("sources"),
        "poster_url", "summary", F.lit("").alias("added"), "tags", "ord",
    )
    groups = copy_groups(spark, d).withColumn("id", F.format_string("%012d", F.col("id").cast("bigint")))
    labels = C.clusters(groups, rows)
    keyed = rows.join(labels, "id", "left").withColumn("cluster", F.coalesce("cluster", "id"))
    out = M.survivor(keyed, "cluster")
    return out.select(F.col("cluster").cast("bigint").alias("cluster"), F.col("id").cast("bigint").alias("doc_id"), "n", "venue")


@query("partial_duplicates", "A5 F18", Q.partial_duplicates(SURVIVORS))
def _(spark, d):
    exact = M.dedupe_exact(X.events(spark, d))
    out = M.dedupe_partial(exact.select(*M.EVENT_COLUMNS))
    return out.select("id", "act", "date", "venue_id", "url", F.array_join("sources", "|").alias("sources"), "poster_url", "summary")


@query("full_remediation", "A6", Q.full_remediation(SURVIVORS))
def _(spark, d):
    rows = X.events(spark, d).withColumn("venue_id", F.lit(""))
    groups = X.listings(spark, d).select(F.concat_ws("/", "date", "venue_id").alias("group_id"), "id")
    return M.remediate(rows, X.venues(spark, d), groups)[1]


def merged(spark, d):
    old, new = X.split_store(spark, d)
    return old, M.merge(old, new, X.venues(spark, d), X.AS_OF)


@query("merged_store", "A7", Q.merged_store(Q.MERGED_COLUMNS + ", added"))
def _(spark, d):
    rows = merged(spark, d)[1][0]
    return rows.select("id", "act", "venue", "venue_id", "date", "url", F.array_join("sources", "|").alias("sources"), "poster_url", "summary", "added")


@query("merge_changes", "A21", Q.merge_changes(EXCLUDED, DECIDED))
def _(spark, d):
    from playbill.operators.diagnostics import change_rows

    old, (rows, decisions, created) = merged(spark, d)
    listings = X.listings(spark, d)
    known = X.venues(spark, d).select("id", "name", "aliases", "location", "ord").unionByName(created)
    untagged = listings.select("id", F.array(F.lit("late")).alias("tags"), "ord").filter("false")
    _, counts = H.counted_upkeep(
        rows, known.withColumn("last_event_date", F.lit(None).cast("date")), X.images(spark, d), TERMS, listings.filter(DECIDED).select("id"), untagged,
        listings.select(F.concat_ws("/", "date", "venue_id").alias("group_id"), "id"),
    )
    return change_rows(H.run_counts(M.merge_counts(old, decisions, rows, X.AS_OF), counts))
