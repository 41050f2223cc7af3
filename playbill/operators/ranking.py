"""Reproducible samples, rotations and planned queries. Every draw is fixed by a seed."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.functions import fixed_values as V
from playbill.functions.dates import is_fresh
from playbill.functions.scores import draw_key, source_weight, uniform
from playbill.functions.text import blank_to_null, render_query, strip
from playbill.operators.listings import Day, spotlight_candidates


def uniform_sample(df: DataFrame, k: int, seed: int | str, key: str = "id") -> DataFrame:
    return df.withColumn("_u", uniform(key, seed)).orderBy("_u", key).limit(k).drop("_u")


def spotlight(
    events: DataFrame, images: DataFrame, as_of: Day, k: int = V.SPOTLIGHT_MAX, exclude: Sequence[str] = (), seed: int | str = 0
) -> DataFrame:
    """Between one and four window rows with act-specific posters, drawn without favour."""
    return uniform_sample(spotlight_candidates(events, images, as_of, exclude), max(1, min(V.SPOTLIGHT_MAX, int(k))), seed)


def weighted_sample(df: DataFrame, weight: Column | str, k: int, seed: int | str, key: str = "id") -> DataFrame:
    """``k`` rows without replacement, heavier rows more likely; weight 0 only when nothing else is left."""
    keyed = df.withColumns({"_k": draw_key(weight, key, seed), "_u": uniform(key, seed)})
    return keyed.orderBy(F.col("_k").asc_nulls_last(), "_u", key).limit(max(0, k)).drop("_k", "_u")


def weighted_seed(memory: DataFrame, seed: int | str) -> DataFrame:
    """One remembered address, those with more yield more likely."""
    pool = memory.filter((strip("host") != "") & (strip("url") != "") & (F.col("events_seen") > 0))
    return weighted_sample(pool, source_weight("events_added", "events_seen"), 1, seed, "url")


def mark_picked(memory: DataFrame, picked: DataFrame, when: dt.datetime | str) -> DataFrame:
    chosen = picked.select("host", "url", F.lit(True).alias("_hit"))
    stamp = F.when(F.col("_hit"), F.lit(str(when)).cast("timestamp")).otherwise(F.col("last_picked"))
    return memory.join(chosen, ["host", "url"], "left").withColumn("last_picked", stamp).drop("_hit")


def rotate(venues: DataFrame, limit: int, as_of: dt.datetime | str, ttl_days: int, seed: int | str) -> DataFrame:
    """Venues with a fresh listing link, longest unmined first, ties by lot; each link once."""
    fresh = venues.filter(blank_to_null("events_link").isNotNull()).filter(is_fresh("events_link_checked", as_of, ttl_days))
    picked = (
        fresh.withColumns({"_m": F.coalesce("last_mined", F.lit("")), "_u": uniform("id", seed)})
        .orderBy("_m", "_u", "id").limit(max(0, limit))
    )
    # at most ``limit`` rows are left here
    order = F.struct("_m", "_u", "id")
    first = picked.groupBy(F.lower(strip("events_link")).alias("_k")).agg(F.min_by(F.struct(*picked.columns), order).alias("r"))
    return first.select("r.*").drop("_m", "_u")


def targeted_queries(
    venues: DataFrame,
    weight: Column | str,
    template: str,
    low: int,
    high: int,
    seed: int,
    locations: Sequence[str] = (),
) -> DataFrame:
    """Between ``low`` and ``high`` venue queries for venues drawn by weight.

    A venue without a location borrows one of ``locations``. Queries are distinct whatever their case.
    """
    low, high = max(0, int(low)), max(int(low), int(high), 0)
    want = low + int(seed) % (high - low + 1)
    named = venues.filter(strip("name") != "")
    chosen = weighted_sample(named, weight, want if template.strip() else 0, seed)
    places = [p.strip() for p in locations if p.strip()]
    own = blank_to_null("location")
    if places:
        options = F.array(*[F.lit(p) for p in places])
        spare = F.get(options, F.floor(uniform(F.concat("id", F.lit("/place")), seed) * len(places)).cast("int"))
        own = F.coalesce(own, spare)
    drawn = chosen.withColumns({"query": render_query(template.strip(), strip("name"), F.coalesce(own, F.lit(""))), "_u": uniform("id", seed)})
    first = drawn.filter("query <> ''").groupBy(F.lower("query").alias("_k")).agg(F.min_by(F.struct("id", "query"), "_u").alias("r"))
    return first.select("r.id", "r.query")


def sample_angles(df: DataFrame, k: int, seed: int | str, col: str = "angle") -> DataFrame:
    return uniform_sample(df.select(strip(col).alias(col)).filter(F.col(col) != ""), k, seed, col)


def merge_queries(targeted: DataFrame, planned: DataFrame, limit: int) -> DataFrame:
    """Targeted queries first, then planned ones, each text once whatever its case. Both have ``query, ord``."""
    tagged = targeted.select(F.lit(0).alias("tier"), "ord", strip("query").alias("query")).unionByName(
        planned.select(F.lit(1).alias("tier"), "ord", strip("query").alias("query"))
    )
    first = (
        tagged.filter("query <> ''").groupBy(F.lower("query").alias("_k"))
        .agg(F.min_by(F.struct("tier", "ord", "query"), F.struct("tier", "ord")).alias("r")).select("r.*")
    )
    ordered = first.orderBy("tier", "ord")
    return ordered.limit(limit) if limit > 0 else ordered
