"""Yield scorecards: outcomes of a run, their roll-ups, idempotent counters and source memory."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.functions.dates import as_ts
from playbill.functions.scores import is_stale, score_weight
from playbill.functions.text import collapse_key, squeeze, strip
from playbill.functions.urls import host, normalize_url
from playbill.operators.listings import only_http
from playbill.operators.pages import chunked_lists


def _zero_flag(added: str = "events_added") -> Column:
    return F.when(F.col(added) == 0, 1).otherwise(0).cast("bigint")


def _zero() -> Column:
    return F.lit(0).cast("bigint")


# Outcomes of one merge ----------------------------------------------------------------------


def url_outcomes(decisions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows added and seen per normalised address."""
    rows = only_http(decisions).withColumn("url", normalize_url("url"))
    return rows.groupBy(*(by or []), "url").agg(
        F.count_if("added").alias("events_added"), F.count(F.lit(1)).alias("events_seen")
    )


def url_distinct(decisions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Distinct acts and days per normalised address; rows without a day do not count."""
    rows = only_http(decisions).filter("act_key <> '' and date is not null").withColumn("url", normalize_url("url"))
    # distinct first, so a dominant address is spread over its acts before it is counted
    return rows.select(*(by or []), "url", "act_key", "date").distinct().groupBy(*(by or []), "url").agg(
        F.count(F.lit(1)).alias("distinct_events")
    )


def venue_outcomes(decisions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows added, seen and skipped per venue: by id, else by lower-case name."""
    key = F.when(strip("venue_id") != "", strip("venue_id")).otherwise(F.lower(strip("venue")))
    rows = decisions.withColumn("key", key).filter("key <> ''")
    first = lambda c: F.min_by(strip(c), F.when(strip(c) != "", F.col("ord")))
    return rows.groupBy(*(by or []), "key").agg(
        F.coalesce(first("venue_id"), F.lit("")).alias("venue_id"),
        F.coalesce(first("venue"), F.lit("")).alias("name"),
        F.count_if("added").alias("events_added"),
        F.count(F.lit(1)).alias("events_seen"),
        F.count_if(~F.col("added")).alias("duplicates"),
    )


# Deltas per report --------------------------------------------------------------------------


def source_deltas(crawled: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Crawled and merged addresses of each report with their yield; 0 where nothing was merged.

    ``crawled`` has ``report_id, url``; ``outcomes`` has ``report_id, url, events_added, events_seen``.
    """
    clean = lambda d: only_http(d).withColumn("url", normalize_url("url"))
    known = clean(outcomes).groupBy("report_id", "url").agg(
        F.max("events_added").alias("events_added"), F.max("events_seen").alias("events_seen")
    )
    visited = clean(crawled).select("report_id", "url").distinct()
    both = visited.join(known, ["report_id", "url"], "full")
    added, seen = F.coalesce("events_added", _zero()), F.coalesce("events_seen", _zero())
    return both.select(
        "report_id", F.lit("source_url").alias("kind"), F.col("url").alias("key"), F.col("url").alias("label"),
        F.greatest(added, _zero()).alias("events_added"), F.greatest(seen, _zero()).alias("events_seen"),
    ).withColumns(
        {
            "duplicates": F.greatest(F.col("events_seen") - F.col("events_added"), _zero()),
            "zero_yield_runs": _zero_flag(),
            "metadata": F.create_map(F.lit("host"), host("key")),
        }
    )


def host_deltas(sources: DataFrame) -> DataFrame:
    """Source deltas summed by host; the zero flag comes from the sum."""
    rows = sources.withColumn("host", F.col("metadata")["host"])
    summed = rows.groupBy("report_id", "host").agg(
        *[F.sum(c).alias(c) for c in ("events_added", "events_seen", "duplicates")]
    )
    return summed.select(
        "report_id", F.lit("host").alias("kind"), F.col("host").alias("key"), F.col("host").alias("label"),
        "events_added", "events_seen", "duplicates", _zero_flag().alias("zero_yield_runs"), _no_metadata(),
    )


def venue_deltas(outcomes: DataFrame) -> DataFrame:
    """Venue outcomes (``report_id, key, venue_id, name`` and counters) as deltas."""
    label = F.when(strip("name") != "", strip("name")).otherwise(strip("key"))
    key = F.when(strip("venue_id") != "", strip("venue_id")).otherwise(F.lower(label))
    return outcomes.select(
        "report_id", F.lit("venue").alias("kind"), key.alias("key"),
        F.when(label != "", label).otherwise(key).alias("label"),
        "events_added", "events_seen", "duplicates", _zero_flag().alias("zero_yield_runs"),
        F.create_map(F.lit("venue_id"), strip("venue_id")).alias("metadata"),
    ).filter("key <> ''")


def query_deltas(searches: DataFrame, totals: DataFrame) -> DataFrame:
    """Every distinct query of a report takes the report's whole yield.

    ``searches`` has ``report_id, query, ord``; ``totals`` has ``report_id, added, skipped``.
    """
    first = (
        searches.withColumns({"key": collapse_key("query"), "label": squeeze("query")}).filter("key <> ''")
        .groupBy("report_id", "key").agg(F.min_by("label", "ord").alias("label"))
    )
    joined = first.join(totals, "report_id", "left")
    added, skipped = F.coalesce("added", _zero()), F.coalesce("skipped", _zero())
    return joined.select(
        "report_id", F.lit("query").alias("kind"), "key", "label", added.alias("events_added"),
        (added + skipped).alias("events_seen"), skipped.alias("duplicates"),
    ).withColumns({"zero_yield_runs": _zero_flag(), "metadata": F.lit(None).cast("map<string,string>")})


def _no_metadata() -> Column:
    return F.lit(None).cast("map<string,string>").alias("metadata")


def score_deltas(sources: DataFrame, venues: DataFrame, queries: DataFrame) -> DataFrame:
    """All updates of the reports: addresses, hosts, venues, queries."""
    return sources.unionByName(host_deltas(sources)).unionByName(venues).unionByName(queries)


def apply_scores(scores: DataFrame, applied: DataFrame, deltas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add deltas to the scorecards, each report once per score. Returns the new scores and the new ledger.

    ``deltas`` also has ``report_ts`` (order of application). The label, metadata and last time of a score
    are those of the report applied last.
    """
    key = ["kind", "key"]
    once = deltas.groupBy(*key, "report_id").agg(
        F.min_by(F.struct("label", "metadata", "report_ts", "events_added", "events_seen", "duplicates", "zero_yield_runs"),
                 F.struct("report_ts", "label")).alias("d")
    ).select(*key, "report_id", "d.*")
    fresh = once.join(applied, [*key, "report_id"], "left_anti")
    order = F.struct("report_ts", "report_id")
    counters = ["events_added", "events_seen", "duplicates", "zero_yield_runs"]
    grown = fresh.groupBy(*key).agg(
        F.max_by(F.struct("label", "metadata", "report_ts"), order).alias("last"),
        F.min_by("report_ts", order).alias("first_ts"),
        F.count(F.lit(1)).alias("_runs"),
        *[F.sum(F.greatest(F.col(c), _zero())).alias(f"_{c}") for c in counters],
    )
    merged = scores.join(grown, key, "full")
    total = lambda c: (F.coalesce(F.col(c), _zero()) + F.coalesce(F.col(f"_{c}"), _zero())).alias(c)
    out = merged.select(
        *key, F.coalesce("last.label", "label").alias("label"),
        F.when(F.col("last").isNotNull(), F.col("last.metadata")).otherwise(F.col("metadata")).alias("metadata"),
        F.coalesce("first_seen", "first_ts").alias("first_seen"), F.coalesce("last.report_ts", "last_seen").alias("last_seen"),
        total("runs"), *[total(c) for c in counters],
    )
    return out, applied.select(*key, "report_id").unionByName(fresh.select(*key, "report_id"))


def list_scores(scores: DataFrame, kind: str | None = None, limit: int = 200) -> DataFrame:
    rows = scores.filter(F.col("kind") == kind) if kind else scores
    return rows.orderBy("kind", F.desc("events_added"), F.desc("events_seen"), "label").limit(max(1, limit))


def venue_scores(venues: DataFrame, scores: DataFrame, as_of: dt.datetime | str | Column) -> DataFrame:
    """Venues with their score weight, found by id first and by lower-case name else; null when there is none."""
    cards = scores.filter("kind = 'venue'").select(
        "key", score_weight("events_added", "events_seen", "zero_yield_runs", "last_seen", as_of).alias("w")
    )
    by_id = cards.select(F.col("key").alias("_id"), F.col("w").alias("_w1"))
    by_name = cards.select(F.col("key").alias("_name"), F.col("w").alias("_w2"))
    keyed = venues.withColumns({"_id": strip("id"), "_name": F.lower(strip("name"))})
    return (
        keyed.join(by_id, "_id", "left").join(by_name, "_name", "left")
        .withColumn("score", F.coalesce("_w1", "_w2")).drop("_id", "_name", "_w1", "_w2")
    )


# Source memory ------------------------------------------------------------------------------


def remember_sources(memory: DataFrame, outcomes: DataFrame, when: dt.datetime | str | Column) -> DataFrame:
    """Add one run's outcomes of listing pages to the memory and drop stale addresses.

    ``outcomes`` has ``url, events_added, events_seen, distinct_events``; only pages with two or more
    distinct events count. A stale address leaves whether it was touched or not.
    """
    now = as_ts(when)
    zero = _zero()
    touched = (
        only_http(outcomes).filter("(events_added > 0 or events_seen > 0) and distinct_events > 1")
        .withColumn("url", normalize_url("url"))
        .groupBy("url").agg(
            F.sum(F.greatest("events_added", zero)).alias("_added"), F.sum(F.greatest("events_seen", zero)).alias("_seen")
        )
        .withColumn("host", host("url"))
    )
    both = memory.join(touched, ["host", "url"], "full")
    hit = F.col("_seen").isNotNull()
    grown = both.select(
        "host", "url",
        (F.coalesce("events_added", zero) + F.coalesce("_added", zero)).alias("events_added"),
        (F.coalesce("events_seen", zero) + F.coalesce("_seen", zero)).alias("events_seen"),
        (F.coalesce("runs_contributed", zero) + hit.cast("bigint")).alias("runs_contributed"),
        F.coalesce(F.col("first_seen"), now).alias("first_seen"),
        F.when(hit, now).otherwise(F.col("last_seen")).alias("last_seen"),
        F.col("last_picked"),
    )
    return grown.filter(~is_stale("runs_contributed", "events_added"))


def sources_by_host(memory: DataFrame, chunk: int | None = None) -> DataFrame:
    """Nested view of the memory: one list of address entries per host (with ``chunk``, several for a dominant host)."""
    entry = F.struct("url", "events_added", "events_seen", "runs_contributed")
    rows = memory.filter(strip("host") != "")
    return chunked_lists(rows, ["host"], entry, "url", chunk).withColumnRenamed("items", "urls")
