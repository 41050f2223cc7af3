"""Samples, rotations, planned queries, search, pages and the crawl frontier."""

from __future__ import annotations

from pyspark.sql import functions as F

from playbill.functions import fixed_values as V
from playbill.operators import crawl as R
from playbill.operators import images as I
from playbill.operators import pages as P
from playbill.operators import ranking as G
from playbill.operators import search as Q
from playbill.operators import venues as N
from playbill.plans import sql as S
from playbill.plans import views as X
from playbill.plans.function_queries import VENUE_WEIGHT, SCORE, listing_score_sql
from playbill.plans.join_queries import page_resources
from playbill.plans.listing_queries import QUALITY, WINDOW, folder
from playbill.plans.registry import query
from playbill.plans.score_queries import memory
from playbill.session import cut_lineage
from playbill.sources.sinks import replace_tables, stored_table

SEED = 7


# Samples ------------------------------------------------------------------------------------


@query("spotlight_sample", "W8", X.ctes("l", "i") + ", " + X.EVENTS_WITH_IMAGES + f"""SELECT ei.id, ei.act FROM ei JOIN i ON i.id = ei.image_id WHERE {WINDOW} AND (poster_quality IS NULL OR poster_quality >= 2) AND {QUALITY} >= 2
ORDER BY {S.uniform('ei.id', SEED)}, ei.id LIMIT 4""")
def _(spark, d):
    return G.spotlight(X.events_with_images(spark, d), X.images(spark, d), X.AS_OF, 9, (), SEED).select("id", "act")


@query("weighted_seed_url", "W9", X.ctes("mem") + f"SELECT host, url FROM mem WHERE events_seen > 0 ORDER BY -ln({S.uniform('url', SEED)}) / ({S.source_weight('events_added', 'events_seen')}) LIMIT 1")
def _(spark, d):
    return G.weighted_seed(memory(spark, d), SEED).select("host", "url")


WEIGHT = "CAST(length(location) + CASE WHEN last_mined IS NULL THEN 0 ELSE 3 END - 8 AS DOUBLE)"


@query("weighted_venue_sample", "W10", X.ctes("v") + f"SELECT id FROM (SELECT id, greatest({WEIGHT}, 0) AS w FROM v) ORDER BY CASE WHEN w > 0 THEN -ln({S.uniform('id', SEED)}) / w END ASC NULLS LAST, {S.uniform('id', SEED)}, id LIMIT 25")
def _(spark, d):
    return G.weighted_sample(X.venues(spark, d).withColumn("w", F.greatest(F.expr(WEIGHT), F.lit(0.0))), "w", 25, SEED).select("id")


@query("mining_rotation", "W6", X.ctes("v") + f"""SELECT id, events_link FROM (SELECT *, row_number() OVER (PARTITION BY lower(events_link) ORDER BY coalesce(last_mined, ''), {S.uniform('id', SEED)}, id) AS rn FROM (
  SELECT * FROM v WHERE events_link IS NOT NULL AND CAST(events_link_checked AS TIMESTAMP) > TIMESTAMP '2000-01-31' - INTERVAL 20 DAY ORDER BY coalesce(last_mined, ''), {S.uniform('id', SEED)}, id LIMIT 12)) WHERE rn = 1""")
def _(spark, d):
    return G.rotate(X.venues(spark, d), 12, "2000-01-31 00:00:00", 20, SEED).select("id", "events_link")


@query("mined_marks", "W7", X.ctes("v") + "SELECT id, CASE WHEN events_link IS NULL THEN '2000-01-31' ELSE last_mined END AS last_mined FROM v")
def _(spark, d):
    rows = X.venues(spark, d)
    return N.mark_mined(rows, rows.filter("events_link is null"), "2000-01-31").select("id", "last_mined")


PLACES = ["Northside", "Riverbank", "Old Town"]


@query("targeted_queries", "W14", X.ctes("v", "card") + f""", w AS (SELECT v.id, v.name, CASE WHEN events_link IS NOT NULL THEN location END AS place, {VENUE_WEIGHT} AS w FROM v LEFT JOIN (SELECT key, {SCORE} AS score FROM card) c ON c.key = v.id),
c AS (SELECT * FROM w ORDER BY -ln({S.uniform('id', SEED)}) / w, {S.uniform('id', SEED)}, id LIMIT {4 + SEED % 5})
SELECT id, 'What''s on in ' || name || ' in ' || coalesce(place, {S.text_list(PLACES)}[CAST(floor({S.uniform("id || '/place'", SEED)} * 3) AS INT) + 1]) || ', live' AS query FROM c""")
def _(spark, d):
    from playbill.functions.scores import venue_weight
    from playbill.operators.scorecards import venue_scores

    cards = X.view(spark, d, "card").withColumn("kind", F.lit("venue"))
    scored = venue_scores(X.venues(spark, d), cards, X.SCORE_CLOCK).withColumn("location", F.when(F.col("events_link").isNotNull(), F.col("location")))
    w = venue_weight("score", "events_link", "last_mined", "last_event_date", X.AS_OF)
    return G.targeted_queries(scored.withColumn("w", w), "w", "What's on in {venue} in {location}, live", 4, 8, SEED, PLACES)


@query("sampled_angles", "W15", X.ctes("r") + f"SELECT query AS angle FROM (SELECT DISTINCT query FROM r) ORDER BY {S.uniform('query', SEED)}, query LIMIT 5")
def _(spark, d):
    angles = X.view(spark, d, "r").select(F.concat(F.lit(" "), "query").alias("angle")).distinct()
    return G.sample_angles(angles, 5, SEED)


@query("merged_queries", "U1", X.ctes("v", "rep_q") + """, q AS (SELECT 0 AS tier, CAST(substr(id, 3) AS BIGINT) AS ord, 'gigs at ' || name AS query FROM v UNION ALL SELECT 1, pos, query FROM rep_q UNION ALL SELECT 1, CAST(substr(id, 3) AS BIGINT), upper('gigs at ' || name) FROM v)
SELECT tier, query FROM (SELECT lower(query) AS k, min(tier) AS tier, arg_min(ord, (tier, ord)) AS ord, arg_min(query, (tier, ord)) AS query FROM q GROUP BY 1) ORDER BY tier, ord LIMIT 140""")
def _(spark, d):
    rows = X.venues(spark, d).select(F.concat(F.lit("gigs at "), "name").alias("query"), F.substr("id", F.lit(3)).cast("bigint").alias("ord"))
    planned = X.view(spark, d, "rep_q").select("query", F.col("pos").alias("ord")).unionByName(rows.withColumn("query", F.upper("query")))
    return G.merge_queries(rows, planned, 140).select("tier", "query")


# Search -------------------------------------------------------------------------------------

SEARCH = "the ouen src1 zzthx retitioned"
TERMS = Q.query_terms(SEARCH)
DOC_BLOB = "lower(act || ' ' || summary || ' ' || lang || ' ' || venue)"


def score_sql(blob: str, words: str) -> str:
    """The plain reading of the score: look at every word of the text."""
    terms = S.text_list(TERMS)
    one = (
        f"CASE WHEN contains({blob}, t) THEN 2.0 * length(t) WHEN len(list_filter({words}, lambda w: starts_with(w, t) OR starts_with(t, w))) > 0 THEN 1.5 * length(t) "
        f"WHEN len(list_filter({words}, lambda w: contains(w, t) OR contains(t, w))) > 0 THEN 1.0 * length(t) ELSE 0.0 END"
    )
    return f"[CAST({one} AS DOUBLE) FOR t IN {terms}]"


SCORED_DOCS = f"""b AS (SELECT *, {DOC_BLOB} AS blob FROM d), w AS (SELECT *, list_distinct(regexp_extract_all(blob, '[a-z0-9]+')) AS ws FROM b),
p AS (SELECT *, {score_sql('blob', 'ws')} AS ps FROM w),
s AS (SELECT *, list_sum(ps) * CASE WHEN len(list_filter(ps, lambda x: x > 0)) = {len(TERMS)} THEN 1.25 ELSE 1 END AS score FROM p)
"""
FOUND = " OR ".join(f"contains(lower({c}), '{t}')" for t in TERMS for c in ("act", "summary", "venue", "lang"))


@query("query_terms", "T1", "SELECT doc_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) >= 2), ' ') AS terms FROM documents")
def _(spark, d):
    return X.table(spark, d, "documents").select("doc_id", F.array_join(Q.terms("text"), " ").alias("terms"))


@query("search_scores", "T2 F24", X.ctes("d") + ", " + SCORED_DOCS + "SELECT doc_id, round(score, 6) AS score FROM s")
def _(spark, d):
    return X.documents(spark, d).select("doc_id", F.round(Q.score(Q.search_blob(), TERMS), 6).alias("score"))


@query("ranked_search", "T3 O2", X.ctes("d") + ", " + SCORED_DOCS + f"SELECT doc_id, date, round(score, 6) AS score FROM s WHERE {WINDOW} AND score > 0 AND ({FOUND})")
def _(spark, d):
    return Q.search(X.documents(spark, d), SEARCH, X.AS_OF).select("doc_id", "date", F.round("score", 6).alias("score"))


@query("indexed_search", "T2 T3 F24", X.ctes("d") + ", " + SCORED_DOCS + f"SELECT doc_id, date, round(score, 6) AS score FROM s WHERE {WINDOW} AND score > 0 AND ({FOUND})")
def _(spark, d):
    docs = X.documents(spark, d)
    store = folder(spark)
    index = Q.build_index(docs)
    postings = cut_lineage(index["postings"])
    replace_tables({"postings": postings, "vocabulary": Q.vocabulary(postings)}, store)
    stored = {name: stored_table(spark, store, name) for name in index}
    return Q.indexed_search(docs, stored, SEARCH, X.AS_OF).select("doc_id", "date", F.round("score", 6).alias("score"))


@query("search_feed", "T4", X.ctes("d") + ", " + SCORED_DOCS + f"""SELECT CAST(doc_id AS VARCHAR) AS id, CAST(date AS VARCHAR) AS "isoDate", url, venue, lang AS tags FROM s WHERE {WINDOW} AND score > 0 AND ({FOUND})""")
def _(spark, d):
    return Q.search_feed(X.documents(spark, d), SEARCH, X.AS_OF).select("id", "isoDate", "url", "venue", F.array_join("tags", "|").alias("tags"))


# Pages --------------------------------------------------------------------------------------

BASE = f"{S.scheme('url')} || '://' || {S.netloc('url')}"
# anchors of the pages are root-relative; entities of their addresses are decoded
LINKS = f"""a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\\s+href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a\\s+href="([^"]*)"', 1), 1) AS k FROM pages),
b AS (SELECT page_id, url, k, {BASE} || split_part(replace(replace(replace(trim(href), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '#', 1) AS link FROM a WHERE href <> '' AND href NOT LIKE '#%'),
c AS (SELECT page_id, url, link, min(k) AS k FROM b WHERE NOT regexp_matches(lower(link), '\\.(pdf|zip|jpg|jpeg|png|gif|webp|svg|mp4|mp3|wav|m4a|doc|docx)(\\?|$)') AND NOT {S.unlikely_page('link')} GROUP BY ALL),
e AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS INT) AS pos FROM c)
"""


@query("link_graph", "T5", "WITH " + LINKS + "SELECT page_id, pos, link FROM e")
def _(spark, d):
    return P.link_edges(X.table(spark, d, "pages")).select("page_id", "pos", "link")


@query("top_page_links", "W3", "WITH " + LINKS + f"""SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY {S.link_priority('link')} DESC, length(link), pos) - 1 AS INT) AS rank, link, CAST({S.link_priority('link')} AS INT) AS priority
FROM e""")
def _(spark, d):
    return P.top_links(X.table(spark, d, "pages")).select("page_id", "rank", "link", F.col("priority").cast("int").alias("priority"))


LISTED = """concat(html, '<p><a class="x" href="/whats-on/', CAST(page_id % 9 AS STRING), '"> Gigs </a><a href="/about">About us</a><a href="/calendar?m=1#now">Calendar</a></p>')"""


@query("listing_links", "W4", f"""WITH p AS (SELECT page_id, url, {LISTED} AS html FROM pages), a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?s)<a\\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1)) AS href,
  unnest(regexp_extract_all(html, '(?s)<a\\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2)) AS words, generate_subscripts(regexp_extract_all(html, '(?s)<a\\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1), 1) AS k FROM p),
b AS (SELECT page_id, k, {BASE} || split_part(replace(href, '&amp;', '&'), '#', 1) AS link, replace(regexp_replace(words, '<[^>]*>', '', 'g'), '&amp;', '&') AS words FROM a WHERE href <> ''),
s AS (SELECT *, {listing_score_sql('link', 'words')} AS score FROM b)
SELECT page_id, arg_min(link, (-score, k)) AS link, CAST(max(score) AS INT) AS score FROM s WHERE score > 0 GROUP BY page_id""")
def _(spark, d):
    pages = X.table(spark, d, "pages").withColumn("html", F.expr(LISTED))
    return P.best_listing_link(pages).select("page_id", "link", F.col("score").cast("int").alias("score"))


UNSEEN = "html"
for _name in P.UNSEEN:
    UNSEEN = f"regexp_replace({UNSEEN}, '(?is)<{_name}\\b[^>]*>.*?</{_name}\\s*>', ' <br> ', 'g')"
_marked = (
    "regexp_replace(replace(" + UNSEEN + ", '<img src=\"/static/site-logo.png\" alt=\"\">', '<br>'), '<img src=\"(/uploads/[^\"]*)\" alt=\"([^\"]*)\">', "
    "chr(1) || '[IMG alt=\"\\2\" src=' || " + BASE + " || '\\1]' || chr(1), 'g')"
)
_nodes = f"string_split(regexp_replace({_marked}, '(?s)<!--.*?-->|</?[A-Za-z!?][^>]*>', chr(1), 'g'), chr(1))"
_decode = "x"
for _ref, _char in (("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
    _decode = f"replace({_decode}, '{_ref}', '{_char}')"


@query("page_text", "T6", X.ctes("pi") + f""", n AS (SELECT page_id, url, list_filter([trim({_decode}, ' ' || chr(9) || chr(10) || chr(13)) FOR x IN {_nodes}], lambda x: x <> '') AS ns FROM pi),
t AS (SELECT page_id, url, array_to_string(list_filter(string_split_regex(array_to_string(ns, chr(10)), '\\r\\n|\\r|\\n'), lambda x: trim(x) <> ''), chr(10)) AS body FROM n)
SELECT page_id, '### Fetched: ' || url || chr(10) || chr(10) || body AS text FROM t""")
def _(spark, d):
    return P.page_text(X.view(spark, d, "pi")).select("page_id", "text")


@query("page_images", "T7 P11", X.ctes("pi") + f"SELECT page_id, 0 AS pos, {BASE} || '/uploads/page-' || page_id % 40 || '.jpg' AS src, 'act ' || page_id % 7 AS alt, 'act|page' AS words FROM pi")
def _(spark, d):
    return P.page_images(X.view(spark, d, "pi")).select("page_id", "pos", "src", "alt", F.array_join(F.array_sort("words"), "|").alias("words"))


@query("preview_images", "T8", X.ctes("pi") + f"SELECT page_id, {BASE} || '/og/' || page_id || '.jpg' AS og FROM pi")
def _(spark, d):
    return P.og_image(X.view(spark, d, "pi")).select("page_id", "og")


@query("best_page_images", "W5 F16 F17", X.ctes("pi") + f"SELECT page_id || '-' || k AS id, {BASE} || '/uploads/page-' || page_id % 40 || '.jpg' AS src FROM pi, (SELECT unnest([0, 1]) AS k)")
def _(spark, d):
    pages = X.view(spark, d, "pi")
    rows = page_resources(spark, d)
    board = P.page_images(pages)
    # several pages can share an address; their own row numbers keep them apart here
    own = F.split("id", "-")[0]
    titles = rows.select(F.concat_ws("#", "url", own).alias("url"), "id", "title")
    return I.best_image(titles, board.withColumn("url", F.concat_ws("#", "url", "page_id"))).select("id", "src")


@query("picked_seeds", "W2", f"""WITH s AS (SELECT url AS link, page_id AS ord, {S.netloc('url')} AS host, 2 * len(list_filter({S.text_list(V.SEED_KEYWORDS)}, lambda k: contains(lower(url), k))) AS score FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY score DESC, length(link), ord) AS rn FROM (SELECT link, host, score, min(ord) AS ord FROM s GROUP BY ALL))
SELECT link, host, ord FROM r WHERE rn = 1 ORDER BY score DESC, length(link), ord LIMIT 5""")
def _(spark, d):
    links = X.table(spark, d, "pages").select(F.col("url").alias("link"), F.col("page_id").alias("ord"))
    return P.pick_seeds(links).select("link", "host", "ord")


def linked_pages(spark, d):
    """Pages that also link to the next two pages of their host, so that a crawl finds its way."""
    pages = X.table(spark, d, "pages")
    from pyspark.sql.window import Window

    # sites of one host are few; the window only serves this fixture
    w = Window.partitionBy(F.regexp_extract("url", "^(https?://[^/]*)", 1)).orderBy("page_id")
    more = F.concat(*[F.concat(F.lit('<a href="'), F.coalesce(F.lead("url", n).over(w), F.lit("")), F.lit('">more</a>')) for n in (1, 2)])
    return pages.withColumn("html", F.concat(more, "html"))


@query("crawl_frontier", "W13 W12")
def _(spark, d):
    pages = linked_pages(spark, d)
    links = pages.select(F.col("url").alias("link"), F.col("page_id").alias("ord"))
    seeds = P.pick_seeds(links).select(F.col("ord").cast("int").alias("seed"), "link")
    return R.frontier(seeds, pages)


@query("round_robin_pages", "W12", f"""WITH p AS (SELECT page_id % 8 AS seed, page_id, url, CASE WHEN page_id % 3 <> 0 THEN page_id END AS got, row_number() OVER (PARTITION BY page_id % 8 ORDER BY page_id) AS round FROM pages),
q AS (SELECT *, count(got) OVER (PARTITION BY seed ORDER BY round) AS won FROM p)
SELECT CAST(seed AS INT) AS seed, CAST(round AS INT) AS round, url FROM q WHERE got IS NOT NULL AND won <= 12 ORDER BY round, seed LIMIT 28""")
def _(spark, d):
    rows = X.table(spark, d, "pages").select(
        (F.col("page_id") % 8).cast("int").alias("seed"), "url", F.lit(0).alias("depth"), F.array("page_id").alias("path"),
        F.when(F.col("page_id") % 3 != 0, F.col("page_id")).alias("page_id"),
    )
    return R.round_robin(rows).select("seed", "round", "url")
