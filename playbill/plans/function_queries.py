"""Scalar rules over whole view columns: every distinct input with its result and how often it occurs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.functions import dates, scores, structured, text, urls
from playbill.functions import fixed_values as V
from playbill.operators.listings import coerce_rows
from playbill.plans import sql as S
from playbill.plans import views as X
from playbill.plans.registry import query


def tally(df: DataFrame, **cols: Column) -> DataFrame:
    return df.select(*[c.alias(n) for n, c in cols.items()]).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def tally_sql(view: str, source: str | None = None, **cols: str) -> str:
    items = ", ".join(f"{c} AS {n}" for n, c in cols.items())
    return X.ctes(view) + f"SELECT {items}, count(*) AS n FROM {source or view} GROUP BY ALL"


TITLE = "concat(act, ' @ ', venue_text, ', ', location)"
MESSY_DATE = "concat(CAST(date AS STRING), CASE WHEN order_key % 3 = 0 THEN ' 20:00' WHEN order_key % 3 = 1 THEN '' ELSE 'T19:30:00' END)"
BAD_DATE = "CASE WHEN order_key % 4 = 0 THEN replace(CAST(date AS STRING), '-', '/') WHEN order_key % 4 = 1 THEN 'soon' ELSE CAST(date AS STRING) END"


@query("event_dates", "F1", tally_sql(
    "l", text=f"{BAD_DATE}", parsed=f"try_cast(CASE WHEN regexp_matches({BAD_DATE}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN substr({BAD_DATE}, 1, 10) END AS DATE)"))
def _(spark, d):
    raw = F.expr(BAD_DATE)
    return tally(X.listings(spark, d), text=raw, parsed=dates.parse_event_date(raw))


@query("store_dates", "F2", tally_sql("l", text=MESSY_DATE, parsed="date"))
def _(spark, d):
    return tally(X.listings(spark, d), text=F.expr(MESSY_DATE), parsed=dates.store_date(F.expr(MESSY_DATE)))


@query("weekday_labels", "F3", tally_sql(
    "l", text=BAD_DATE, label=f"CASE WHEN order_key % 4 IN (0, 1) THEN {BAD_DATE} ELSE strftime(date, '%a %-d %b %Y') END"))
def _(spark, d):
    return tally(X.listings(spark, d), text=F.expr(BAD_DATE), label=dates.weekday_label(F.expr(BAD_DATE)))


@query("title_parts", "F4", tally_sql(
    "l", title=TITLE, act="act", venue="venue_text", location="location"))
def _(spark, d):
    parts = text.split_title(F.expr(TITLE))
    return tally(X.listings(spark, d), title=F.expr(TITLE), act=parts["act"], venue=parts["venue"], location=parts["location"])


@query("linked_act_names", "F5", tally_sql("l", title=TITLE, act="act", suffix="concat(' @ ', venue_text, ', ', location)"))
def _(spark, d):
    parts = text.split_act_suffix(F.expr(TITLE))
    return tally(X.listings(spark, d), title=F.expr(TITLE), act=parts["act"], suffix=parts["suffix"])


@query("collapsed_keys", "F6", tally_sql(
    "l", text="concat('  ', replace(venue_text, '#', '  #'), ' ')", key=S.collapse("concat('  ', replace(venue_text, '#', '  #'), ' ')")))
def _(spark, d):
    raw = F.expr("concat('  ', replace(venue_text, '#', '  #'), ' ')")
    return tally(X.listings(spark, d), text=raw, key=text.collapse_key(raw))


@query("core_keys", "F7", tally_sql("l", text="venue_text", key=S.core("venue_text")))
def _(spark, d):
    return tally(X.listings(spark, d), text=F.col("venue_text"), key=text.core_key("venue_text"))


@query("alnum_keys", "F8", tally_sql("l", text="venue_text", key=f"regexp_replace({S.core('venue_text')}, '[^\\p{{L}}\\p{{N}}]', '', 'g')"))
def _(spark, d):
    return tally(X.listings(spark, d), text=F.col("venue_text"), key=text.alnum_key("venue_text"))


@query("slugs", "F9", tally_sql("l", text="concat(venue_text, '''s ', act)", slug=S.slug("concat(venue_text, '''s ', act)")))
def _(spark, d):
    raw = F.concat("venue_text", F.lit("'s "), "act")
    return tally(X.listings(spark, d), text=raw, slug=text.slug(raw))


TAGS = "split(concat(tags[1], ', ', upper(tags[1]), ',live  ', location, ',,', tags[2], ',extra'), ',')"
TAGS_SPARK = "split(concat(tags[0], ', ', upper(tags[0]), ',live  ', location, ',,', tags[1], ',extra'), ',')"


@query("normalized_tags", "F10", tally_sql(
    "l", raw=f"array_to_string({TAGS}, '|')",
    tags="concat_ws('|', tags[1], 'live ' || lower(location), tags[2])"))
def _(spark, d):
    raw = F.expr(TAGS_SPARK)
    return tally(X.listings(spark, d), raw=F.array_join(raw, "|"), tags=F.array_join(text.normalize_tags(raw), "|"))


MESSY_URL = "concat(replace(url, 'site', 'Site'), CASE WHEN order_key % 3 = 0 THEN '/#top' WHEN order_key % 3 = 1 THEN '/?a=1#x' ELSE '' END)"


@query("normalized_urls", "F11", tally_sql("l", url=MESSY_URL, key=S.normalize_url(MESSY_URL)))
def _(spark, d):
    return tally(X.listings(spark, d), url=F.expr(MESSY_URL), key=urls.normalize_url(F.expr(MESSY_URL)))


@query("url_domains", "F12", tally_sql("l", url="url", domain=S.domain("url")))
def _(spark, d):
    return tally(X.listings(spark, d), url=F.col("url"), domain=urls.domain("url"))


@query("url_hosts", "F13", "SELECT url, " + S.host("url") + " AS host, " + f"{S.scheme('url')} || '://' || {S.netloc('url')} AS root, count(*) AS n FROM pages GROUP BY ALL")
def _(spark, d):
    return tally(X.table(spark, d, "pages"), url=F.col("url"), host=urls.host("url"), root=urls.root_url("url"))


JUNK = "concat(url, CASE WHEN order_key % 3 = 0 THEN ').' WHEN order_key % 3 = 1 THEN '\">' ELSE '>,' END)"


@query("cleaned_links", "F14", tally_sql(
    "l", link=JUNK, line_link=f"rtrim(rtrim({JUNK}, ').,]}}\"'''), '>')", result_link=f"rtrim({JUNK}, ').,]}}\"''>')"))
def _(spark, d):
    raw = F.expr(JUNK)
    return tally(X.listings(spark, d), link=raw, line_link=urls.strip_link_junk(raw), result_link=urls.strip_result_junk(raw))


REL = "CASE page_id % 5 WHEN 0 THEN '/a/b?x=1' WHEN 1 THEN 'gigs/list' WHEN 2 THEN '?page=2' WHEN 3 THEN '//cdn.example/i.jpg' ELSE 'https://else.example/z' END"
BASE = f"{S.scheme('url')} || '://' || {S.netloc('url')}"


@query("absolute_links", "F15", f"""SELECT page_id, {REL} AS link, CASE page_id % 5
  WHEN 0 THEN {BASE} || '/a/b?x=1' WHEN 1 THEN {BASE} || regexp_extract({S.path('url')}, '^(.*/)[^/]*$', 1) || 'gigs/list'
  WHEN 2 THEN {BASE} || {S.path('url')} || '?page=2' WHEN 3 THEN {S.scheme('url')} || '://cdn.example/i.jpg'
  ELSE 'https://else.example/z' END AS target FROM pages""")
def _(spark, d):
    rel = F.expr(REL)
    return X.table(spark, d, "pages").select("page_id", rel.alias("link"), urls.absolute_url("url", rel).alias("target"))


@query("title_keywords", "F16", tally_sql("l", act="act", words=f"array_to_string(list_sort({S.keywords('act')}), '|')"))
def _(spark, d):
    return tally(X.listings(spark, d), act=F.col("act"), words=F.array_join(F.array_sort(text.title_words(F.expr(TITLE))), "|"))


@query("filename_keywords", "F17", tally_sql(
    "l", url="thumbnail_url", words=f"CASE WHEN thumbnail_url IS NULL THEN '' ELSE array_to_string(list_sort({S.filename_words('thumbnail_url')}), '|') END"))
def _(spark, d):
    return tally(X.listings(spark, d), url=F.col("thumbnail_url"), words=F.array_join(F.array_sort(urls.filename_words("thumbnail_url")), "|"))


@query("act_containment", "F18", """SELECT p_name AS a, p_type AS b, p_brand AS c, contains(lower(p_type || ' ' || p_name), lower(p_name)) AS inside,
  length(p_type) >= 4 AND length(p_brand) >= 4 AND (contains(lower(p_type), lower(p_brand)) OR contains(lower(p_brand), lower(p_type))) AS apart,
  count(*) AS n FROM part GROUP BY ALL""")
def _(spark, d):
    part = X.table(spark, d, "part")
    return tally(
        part, a=F.col("p_name"), b=F.col("p_type"), c=F.col("p_brand"),
        inside=text.acts_overlap(F.concat_ws(" ", "p_type", "p_name"), "p_name"), apart=text.acts_overlap("p_type", "p_brand"),
    )


@query("cleaned_acts", "F19", tally_sql("l", act="concat(act, ' (', location, ') [live] ')", name="act"))
def _(spark, d):
    raw = F.concat("act", F.lit(" ("), "location", F.lit(") [live] "))
    return tally(X.listings(spark, d), act=raw, name=text.clean_act(raw))


@query("poster_quality", "F20", tally_sql("l", poster="thumbnail_url", act="act", quality=S.poster_quality("thumbnail_url", "act")))
def _(spark, d):
    return tally(X.listings(spark, d), poster=F.col("thumbnail_url"), act=F.col("act"), quality=urls.poster_quality("thumbnail_url", "act").cast("int"))


LINK = "concat(url, CASE page_id % 6 WHEN 0 THEN '/events/1' WHEN 1 THEN '?page=3' WHEN 2 THEN '/about/food-menu' WHEN 3 THEN '/shop/tickets?a=1?b=2' WHEN 4 THEN '/facebook.com/events/9' ELSE '' END)"


@query("link_priorities", "F21", f"SELECT page_id, {LINK} AS link, CAST({S.link_priority(LINK)} AS INT) AS priority FROM pages")
def _(spark, d):
    link = F.expr(LINK)
    return X.table(spark, d, "pages").select("page_id", link.alias("link"), urls.link_priority(link).cast("int").alias("priority"))


@query("seed_scores", "F22", f"SELECT page_id, {LINK} AS link, CAST(2 * len(list_filter({S.text_list(V.SEED_KEYWORDS)}, lambda k: contains(lower({LINK}), k))) AS INT) AS score FROM pages")
def _(spark, d):
    link = F.expr(LINK)
    return X.table(spark, d, "pages").select("page_id", link.alias("link"), urls.seed_score(link).cast("int").alias("score"))


def listing_score_sql(href: str, words: str) -> str:
    hint = f"CASE WHEN {S.any_of(f'lower({href})', V.LISTING_HREF_HINTS)} THEN 6 ELSE 0 END"
    first = f"list_filter({S.text_list(V.LISTING_PHRASES)}, lambda p: contains(trim(lower({words})), p))[1]"
    base = f"({hint} + CASE WHEN {first} IS NULL THEN 0 WHEN {first} = trim(lower({words})) THEN 8 ELSE 3 END)"
    return f"CASE WHEN {base} = 0 THEN 0 ELSE {base} + CASE WHEN length({href}) - length(replace({href}, '/', '')) <= 4 THEN 1 ELSE 0 END END"


@query("listing_link_scores", "F23", f"SELECT url, summary, CAST({listing_score_sql('url', 'summary')} AS INT) AS score, count(*) AS n FROM ({X.VIEWS['l'].format(**{t: t for t in X.TABLES})}) GROUP BY ALL")
def _(spark, d):
    return tally(X.listings(spark, d), url=F.col("url"), summary=F.col("summary"), score=urls.listing_score("url", "summary").cast("int"))


@query("source_weights", "F25", X.ctes("mem") + f"SELECT host, url, round({S.source_weight('events_added', 'events_seen')}, 6) AS weight FROM mem")
def _(spark, d):
    return X.view(spark, d, "mem").select("host", "url", F.round(scores.source_weight("events_added", "events_seen"), 6).alias("weight"))


WEEKS = f"greatest(epoch(TIMESTAMP '{X.SCORE_CLOCK}') - epoch(last_seen), 0) / 604800.0::DOUBLE"
SCORE = (
    "greatest(0.15::DOUBLE, (1.0::DOUBLE + 1.5::DOUBLE * sqrt(events_added) + 0.25::DOUBLE * sqrt(events_seen) - zero_yield_runs) * "
    f"pow(0.85::DOUBLE, {WEEKS}))"
)


@query("score_weights", "F26", X.ctes("card") + f"SELECT key, round({SCORE}, 6) AS weight FROM card")
def _(spark, d):
    w = scores.score_weight("events_added", "events_seen", "zero_yield_runs", "last_seen", X.SCORE_CLOCK)
    return X.view(spark, d, "card").select("key", F.round(w, 6).alias("weight"))


VENUE_WEIGHT = (
    "greatest(0.15::DOUBLE, coalesce(score, 1.0::DOUBLE) + CASE WHEN events_link IS NULL THEN 0.5 ELSE 0 END + "
    "CASE WHEN last_mined IS NULL THEN 0.5 ELSE 0 END + CASE WHEN last_event_date IS NULL THEN 0.75 "
    f"WHEN last_event_date - DATE '{X.AS_OF}' < 30 THEN 0.5 ELSE 0 END)"
)


@query("venue_weights", "F27", X.ctes("v", "card") + f"""SELECT v.id, round({VENUE_WEIGHT}, 6) AS weight FROM v
LEFT JOIN (SELECT key, {SCORE} AS score FROM card) c ON c.key = v.id""")
def _(spark, d):
    from playbill.operators.scorecards import venue_scores

    cards = X.view(spark, d, "card").withColumn("kind", F.lit("venue"))
    scored = venue_scores(X.venues(spark, d), cards, X.SCORE_CLOCK)
    w = scores.venue_weight("score", "events_link", "last_mined", "last_event_date", X.AS_OF)
    return scored.select("id", F.round(w, 6).alias("weight"))


@query("safe_numbers", "F28", """SELECT props, CASE WHEN event_id % 3 = 0 THEN regexp_extract(props, '[0-9]+') WHEN event_id % 3 = 1 THEN '-' || regexp_extract(props, '[0-9]+') ELSE props END AS raw,
  CASE WHEN event_id % 3 = 0 THEN CAST(regexp_extract(props, '[0-9]+') AS BIGINT) ELSE 0 END AS value, count(*) AS n FROM events GROUP BY ALL""")
def _(spark, d):
    raw = F.expr("CASE WHEN event_id % 3 = 0 THEN regexp_extract(props, '[0-9]+', 0) WHEN event_id % 3 = 1 THEN '-' || regexp_extract(props, '[0-9]+', 0) ELSE props END")
    return tally(X.table(spark, d, "events"), props=F.col("props"), raw=raw, value=text.safe_int(raw))


@query("image_ids", "F29", tally_sql(
    "l", url="thumbnail_url", id="substr(sha256(thumbnail_url), 1, 16) || CASE WHEN contains(thumbnail_url, 'logo') THEN '.png' ELSE '.jpg' END"))
def _(spark, d):
    kind = F.when(F.col("thumbnail_url").contains("logo"), "image/png; q=1").otherwise("IMAGE/JPEG")
    rows = X.listings(spark, d)
    return tally(rows, url=F.col("thumbnail_url"), id=F.when(F.col("thumbnail_url").isNotNull(), urls.image_id("thumbnail_url", urls.extension_for(kind))))


@query("display_paths", "F30", X.ctes("l", "i") + """SELECT l.location, l.venue_text AS venue, i.id AS image, '/api/gigs/images/' || i.id AS asset, coalesce(l.thumbnail_url, NULL) AS src,
  l.venue_text || ', ' || l.location AS line, count(*) AS n FROM l LEFT JOIN i ON l.thumbnail_url = i.source_url GROUP BY ALL""")
def _(spark, d):
    rows = X.listings(spark, d).join(X.images(spark, d).select(F.col("id").alias("image"), F.col("source_url").alias("thumbnail_url")), "thumbnail_url", "left")
    return tally(
        rows, location=F.col("location"), venue=F.col("venue_text"), image=F.col("image"), asset=urls.asset_path("gigs", "image"),
        src=urls.poster_src("thumbnail_url"), line=urls.venue_line("venue_text", "location"),
    )


TEMPLATE = "What's on at {venue} in {location}, soon in ."


@query("rendered_queries", "F31", X.ctes("v") + """SELECT id, CASE WHEN events_link IS NULL THEN 'What''s on at ' || name || ', soon.'
  ELSE 'What''s on at ' || name || ' in ' || location || ', soon.' END AS query FROM v""")
def _(spark, d):
    place = F.when(F.col("events_link").isNotNull(), F.col("location")).otherwise("")
    return X.venues(spark, d).select("id", text.render_query(TEMPLATE, "name", place).alias("query"))


LOG = "concat(event_type, CASE user_id % 6 WHEN 0 THEN ': Rate limit hit' WHEN 1 THEN ': billing problem' WHEN 2 THEN ': 401 Unauthorized' WHEN 3 THEN ': read timed out' WHEN 4 THEN ': 503 from host' ELSE ': odd' END)"


@query("error_classes", "F32", f"""SELECT {LOG} AS log, CASE user_id % 6 WHEN 0 THEN 'rate_limit' WHEN 1 THEN 'quota' WHEN 2 THEN 'authentication'
  WHEN 3 THEN 'timeout' WHEN 4 THEN 'unavailable' ELSE 'other' END AS class, count(*) AS n FROM events GROUP BY ALL""")
def _(spark, d):
    return tally(X.table(spark, d, "events"), log=F.expr(LOG), **{"class": text.error_class(F.expr(LOG))})


@query("coerced_rows", "F33", tally_sql(
    "l", venue="trim(venue_text)", venue_id="venue_id", location="location", tags="array_to_string([lower(t) for t in tags], '|')"))
def _(spark, d):
    rows = X.listings(spark, d)
    docs = rows.select(
        "id", F.struct(F.col("venue_text").alias("name"), F.col("venue_id").alias("id")).alias("venue"),
        F.concat(F.lit(" "), "location").alias("location"), F.concat(F.transform("tags", F.upper), F.array(F.lit(" "))).alias("tags"),
    )
    c = coerce_rows(docs)
    return tally(c, venue=F.col("venue"), venue_id=F.col("venue_id"), location=F.col("location"), tags=F.array_join("tags", "|"))


@query("rebuilt_titles", "F34", tally_sql("l", title=TITLE))
def _(spark, d):
    parts = text.split_title(F.expr(TITLE))
    return tally(X.listings(spark, d), title=text.build_title(parts["act"], parts["venue"], parts["location"]))


NUMBERED = "concat('1. \"', query, '\"\n2) ', upper(query), '\n 3. list of ', run_id, '\nno item\n')"


@query("numbered_items", "F35", X.ctes("rep_q") + """, x AS (SELECT report_id || '/' || query AS k, report_id, query FROM rep_q)
SELECT k, 0 AS pos, query AS item FROM x UNION ALL SELECT k, 1, 'list of ' || report_id FROM x""")
def _(spark, d):
    rows = X.view(spark, d, "rep_q").select(
        F.concat_ws("/", "report_id", "query").alias("k"), F.expr(NUMBERED.replace("run_id", "report_id").replace("\n", "\\n")).alias("t")
    )
    return structured.numbered_rows(rows, "t", "k")


@query("json_items", "F36", X.ctes("rep_q") + """SELECT report_id || '/' || query AS k, 0 AS pos, query, CAST(pos AS BIGINT) AS rank FROM rep_q""")
def _(spark, d):
    body = F.to_json(F.struct(F.array(F.struct("query", F.col("pos").alias("rank"))).alias("queries")))
    fenced = F.concat(F.lit("Here you are:\n```json\n"), body, F.lit("\n```\nDone"))
    bare = F.concat(F.lit("Result: "), body, F.lit(" end"))
    rows = X.view(spark, d, "rep_q").select(
        F.concat_ws("/", "report_id", "query").alias("k"), F.when(F.col("pos") % 2 == 0, fenced).otherwise(bare).alias("t")
    )
    return structured.json_rows(rows, "t", "k", "query string, rank bigint", "queries")
