"""Scans, filters and projections over listing rows."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.functions import fixed_values as V
from playbill.functions.dates import as_date, date_label, parse_event_date
from playbill.functions.text import (
    act_eligible, blank_to_null, clean_tags, col, collapse_key, core_key, slug, split_title, strip,
)
from playbill.functions.urls import is_http, poster_quality

Day = dt.date | str | Column


# Filters ------------------------------------------------------------------------------------


def only_http(df: DataFrame, url: str = "url") -> DataFrame:
    return df.filter(is_http(url))


def in_window(df: DataFrame, as_of: Day, days: int = V.WINDOW_DAYS) -> DataFrame:
    """Rows dated within ``days`` of ``as_of``, both ends included. The bounds reach the scan."""
    start = as_date(as_of)
    return df.filter(F.col("date").between(start, F.date_add(start, days)))


def future_only(df: DataFrame, as_of: Day, date: str = "date") -> DataFrame:
    """Incoming rows with a readable date that has not passed."""
    return df.filter(parse_event_date(date) >= as_date(as_of))


def prune_past(df: DataFrame, as_of: Day) -> DataFrame:
    """Stored rows that have not passed; undated rows stay."""
    return df.filter(F.col("date").isNull() | (F.col("date") >= as_date(as_of)))


def past_counts(df: DataFrame, as_of: Day) -> DataFrame:
    past = F.col("date") < as_date(as_of)
    return df.agg(
        F.count_if(F.coalesce(past, F.lit(False))).alias("removed"),
        F.count_if(~F.coalesce(past, F.lit(False))).alias("kept"),
    )


def term_match(terms: Sequence[str], fields: Sequence[str]) -> Column:
    """Some term stands as a whole word in the joined fields."""
    cleaned = [t.strip().lower() for t in terms if str(t).strip()]
    if not cleaned:
        return F.lit(False)
    blob = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(f), F.lit("")) for f in fields]))
    return blob.rlike(r"(?U)\b(?:" + "|".join(re.escape(t) for t in cleaned) + r")\b")


EXCLUSION_FIELDS = ("act", "venue", "location", "summary", "url")


def drop_terms(df: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Rows without any excluded word; a row without an id is never dropped."""
    hit = term_match(terms, EXCLUSION_FIELDS) & (strip("id") != "")
    return df.filter(~hit)


def guard(decisions: DataFrame, df: DataFrame, key: str = "id") -> DataFrame:
    """Decisions about known rows only; ids are trimmed and blanks ignored."""
    clean = decisions.withColumn(key, strip(key)).filter(F.col(key) != "")
    return clean.join(df.select(F.col(key)), key, "left_semi")


def excluded_ids(df: DataFrame, terms: Sequence[str], decisions: DataFrame) -> DataFrame:
    """Union of the rule ids and the supplied ids that exist."""
    by_rule = df.filter(term_match(terms, EXCLUSION_FIELDS) & (strip("id") != "")).select("id")
    return by_rule.union(guard(decisions.select("id"), df)).distinct()


def apply_exclusions(df: DataFrame, terms: Sequence[str], decisions: DataFrame) -> DataFrame:
    """Drop rule hits in the scan and supplied ids by anti-join; unknown ids change nothing."""
    supplied = decisions.select(strip("id").alias("id")).filter("id <> ''").distinct()
    return drop_terms(df, terms).join(supplied, "id", "left_anti")


def venue_filter_key(venue_id: Column | str = "venue_id", venue: Column | str = "venue") -> Column:
    return (
        F.when(strip(venue_id) != "", F.concat(F.lit("id:"), strip(venue_id)))
        .when(strip(venue) != "", F.concat(F.lit("name:"), F.lower(strip(venue))))
    )


def facet(df: DataFrame, venue_key: str | None = None, tag: str | None = None) -> DataFrame:
    if venue_key:
        df = df.filter(venue_filter_key() == venue_key)
    if tag:
        df = df.filter(F.array_contains("tags", tag))
    return df


def resolve_slug(df: DataFrame) -> DataFrame:
    """Filter key of every venue slug: the key of the first row that has it."""
    rows = df.select(slug("venue").alias("slug"), venue_filter_key().alias("key"), "ord").filter("slug <> ''")
    return rows.groupBy("slug").agg(F.min_by("key", "ord").alias("key"))


def needs_tags(df: DataFrame) -> DataFrame:
    return df.filter((F.size(clean_tags("tags")) == 0) & (strip("id") != ""))


# Scans --------------------------------------------------------------------------------------


def coerce_rows(df: DataFrame) -> DataFrame:
    """Flat rows from stored documents: nested or flat venue, trimmed texts, at most three lower-case tags."""
    names = dict(df.dtypes)
    nested = names.get("venue", "").startswith("struct")
    flat_id = strip("venue_id") if "venue_id" in names else F.lit("")
    venue = strip("venue.name") if nested else strip("venue")
    venue_id = F.when(flat_id != "", flat_id).otherwise(strip("venue.id")) if nested else flat_id
    tags = F.slice(F.transform(clean_tags("tags"), lambda t: F.lower(t)), 1, V.MAX_TAGS)
    return df.withColumns(
        {"venue_id": F.nullif(venue_id, F.lit("")), "venue": venue, "location": strip("location"), "tags": tags}
    )


def venue_location(known: Column, stored: Column | str, own: Column | str) -> Column:
    """A known venue decides the location even when it has none; the row's own counts only for unknown venues."""
    return F.when(known, strip(stored)).otherwise(strip(own))


def with_locations(events: DataFrame, venues: DataFrame) -> DataFrame:
    places = venues.select(F.col("id").alias("venue_id"), F.col("location").alias("_place"), F.lit(True).alias("_known"))
    joined = events.join(places, "venue_id", "left")
    known = F.coalesce(F.col("_known"), F.lit(False))
    return joined.withColumn("location", venue_location(known, "_place", "location")).drop("_place", "_known")


def poster_urls(events: DataFrame, images: DataFrame) -> DataFrame:
    """Poster per event: its own address, else the source of its image; events without either are left out."""
    return with_posters(events, images).filter("poster <> ''").select("id", "poster")


def with_posters(events: DataFrame, images: DataFrame) -> DataFrame:
    sources = images.select(F.col("id").alias("image_id"), blank_to_null("source_url").alias("_source"))
    joined = events.join(sources, "image_id", "left")
    poster = F.coalesce(blank_to_null("poster_url"), F.col("_source"), F.lit(""))
    return joined.withColumn("poster", poster).drop("_source")


def scan_events(events: DataFrame, venues: DataFrame, images: DataFrame) -> DataFrame:
    """Stored events with http address, venue location and poster. Image bytes are never read."""
    return with_posters(with_locations(only_http(events), venues), images)


# Feeds --------------------------------------------------------------------------------------


def soonest(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("date").asc_nulls_last(), "ord")


def to_feed(df: DataFrame, as_of: dt.datetime | str | None = None) -> DataFrame:
    """Public feed rows, soonest first."""
    text = lambda c: strip(c)
    feed = soonest(df).select(
        F.when(text("act") != "", text("act")).otherwise(V.UNTITLED).alias("eventName"),
        text("venue").alias("venue"),
        text("location").alias("location"),
        date_label("date").alias("date"),
        F.col("date").cast("string").alias("isoDate"),
        text("url").alias("url"),
        text("summary").alias("summary"),
        blank_to_null("poster_url").alias("thumbnailUrl"),
        blank_to_null("venue_id").alias("venueId"),
        clean_tags("tags").alias("tags"),
        act_eligible(F.when(text("act") != "", text("act")).otherwise(V.UNTITLED), "tags").alias("youtubeEligible"),
        text("id").alias("id"),
    )
    return feed if as_of is None else feed.withColumn("generated", F.lit(str(as_of)))


def resources_to_feed(df: DataFrame) -> DataFrame:
    """Feed rows straight from incoming rows, their titles taken apart."""
    parts = df.withColumn("_t", split_title("title")).withColumn("_d", parse_event_date("date"))
    return parts.orderBy(F.col("_d").asc_nulls_last(), "ord").select(
        F.when(F.col("_t.act") != "", F.col("_t.act")).otherwise(V.UNTITLED).alias("eventName"),
        F.col("_t.venue").alias("venue"),
        F.col("_t.location").alias("location"),
        F.when(F.col("_d").isNotNull(), date_label("_d"))
        .otherwise(F.coalesce(blank_to_null("date"), F.lit(V.BLANK_LABEL))).alias("date"),
        blank_to_null("date").alias("isoDate"),
        strip("url").alias("url"),
        strip("summary").alias("summary"),
        blank_to_null("thumbnail_url").alias("thumbnailUrl"),
        F.col("id"),
    )


def windowed_feed(events: DataFrame, venues: DataFrame, as_of: Day, days: int = V.WINDOW_DAYS) -> DataFrame:
    """The public listing: rows of the display window with venue locations, soonest first."""
    return to_feed(with_locations(only_http(in_window(events, as_of, days)), venues))


def events_for_venue(df: DataFrame, venue_id: str) -> DataFrame:
    """Drill-down list of one venue, undated rows last."""
    rows = df.filter(strip("venue_id") == venue_id)
    return soonest(rows).select(
        strip("id").alias("id"),
        F.when(strip("act") != "", strip("act")).otherwise(V.UNTITLED).alias("eventName"),
        date_label("date").alias("date"),
        F.col("date").cast("string").alias("isoDate"),
        strip("url").alias("url"),
    )


# Spotlight ----------------------------------------------------------------------------------


def spotlight_candidates(df: DataFrame, images: DataFrame, as_of: Day, exclude: Sequence[str] = ()) -> DataFrame:
    """Window rows with an act-specific poster. ``backfill`` marks rows whose quality was scored just now."""
    rows = in_window(df, as_of).filter(
        (F.coalesce(F.col("image_id"), F.lit("")) != "")
        & (F.col("poster_quality").isNull() | (F.col("poster_quality") >= V.SPOTLIGHT_MIN_QUALITY))
        & F.lower(F.col("url")).rlike("^https?://")
    )
    if exclude:
        rows = rows.filter(~F.col("id").isin(list(exclude)))
    scored = with_posters(rows, images).withColumn(
        "quality", F.coalesce(F.col("poster_quality"), poster_quality("poster", "act"))
    )
    fresh = F.col("poster_quality").isNull() & (F.col("poster") != "")
    return scored.filter(F.col("quality") >= V.SPOTLIGHT_MIN_QUALITY).withColumn("backfill", fresh)


def distinct_tags(df: DataFrame) -> DataFrame:
    tags = df.select(F.explode("tags").alias("t")).select(collapse_key("t").alias("tag"))
    return tags.filter("tag <> ''").distinct().orderBy("tag")


def venues_sorted(venues: DataFrame) -> DataFrame:
    return venues.withColumn("sort_name", core_key("name")).orderBy("sort_name", "name")


def page(df: DataFrame, order: Sequence[Column | str], limit: int = 50, skip: int = 0) -> DataFrame:
    """One page of an ordered list with the total count on every row."""
    limit, skip = max(1, min(50, int(limit))), max(0, int(skip))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    rows = df.orderBy(*[col(c) for c in order]).offset(skip).limit(limit)
    return rows.withColumn("total", total.scalar())


# Resources ----------------------------------------------------------------------------------


def dedupe_incoming(df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """First row per address, day and title among incoming http rows, with the columns in ``keep`` (default: all). Only those are shuffled."""
    parsed = parse_event_date("date").cast("string")
    day = F.coalesce(parsed, F.substr(F.lower(strip("date")), F.lit(1), F.lit(32)))
    keyed = only_http(df).withColumns(
        {"_u": F.lower(strip("url")), "_d": day, "_t": collapse_key("title")}
    )
    row = F.struct(*(df.columns if keep is None else keep))
    return keyed.groupBy("_u", "_d", "_t").agg(F.min_by(row, "ord").alias("r")).select("r.*")


def resource_rows(df: DataFrame) -> DataFrame:
    """Incoming resources taken apart into listing columns."""
    parts = df.withColumn("_t", split_title("title"))
    return parts.select(
        F.col("id"),
        F.col("_t.act").alias("act"),
        F.col("_t.venue").alias("venue"),
        F.col("_t.location").alias("location"),
        parse_event_date("date").alias("date"),
        strip("url").alias("url"),
        strip("thumbnail_url").alias("poster_url"),
        strip("summary").alias("summary"),
        F.col("ord"),
    )
