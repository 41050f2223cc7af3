"""Yield weights and reproducible random numbers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from playbill.functions import fixed_values as V
from playbill.functions.dates import as_date, as_ts
from playbill.functions.text import blank_to_null, col


def uniform(key: Column | str, seed: int | str) -> Column:
    """Number in (0, 1) fixed by the key and the seed, so a sample is the same on any cluster."""
    digest = F.md5(F.concat_ws("-", col(key).cast("string"), F.lit(str(seed))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + 1) / F.lit(float(2**52 + 1))


def draw_key(weight: Column | str, key: Column | str, seed: int | str) -> Column:
    """Exponential key: the smallest keys are a weighted sample without replacement; null when the weight is 0."""
    w = col(weight)
    return F.when(w > 0, F.try_divide(-F.log(uniform(key, seed)), w))


def source_weight(added: Column | str, seen: Column | str) -> Column:
    a, s = F.greatest(col(added), F.lit(0)), F.greatest(col(seen), F.lit(0))
    return F.lit(1.0) + F.sqrt(a) + F.lit(0.25) * F.sqrt(s)


def is_stale(runs: Column | str, added: Column | str) -> Column:
    """Revisited often without new rows."""
    return col(runs) > F.greatest(col(added), F.lit(0)) * 3


def score_weight(
    added: Column | str,
    seen: Column | str,
    zero_runs: Column | str,
    last_seen: Column | str,
    as_of: dt.datetime | str | Column,
) -> Column:
    """Selection weight of a scorecard, fading by the week and never below the exploration floor."""
    zero = F.lit(0).cast("bigint")
    a, s, z = (F.greatest(F.coalesce(col(c), zero), zero) for c in (added, seen, zero_runs))
    base = F.lit(1.0) + F.lit(1.5) * F.sqrt(a) + F.lit(0.25) * F.sqrt(s) - z
    now = as_ts(as_of)
    seconds = F.unix_micros(now) - F.unix_micros(F.coalesce(col(last_seen), now))
    weeks = F.greatest(seconds / F.lit(7.0 * 24 * 3600 * 1_000_000), F.lit(0.0))
    return F.greatest(F.lit(V.EXPLORATION_FLOOR), base * F.pow(F.lit(V.DECAY_PER_WEEK), weeks))


def venue_weight(
    score: Column | str,
    events_link: Column | str,
    last_mined: Column | str,
    last_event: Column | str,
    as_of: dt.date | str | Column,
) -> Column:
    """Venue query weight: the score (1 when there is none) plus boosts for thin coverage."""
    def missing(c: Column | str) -> Column:
        return blank_to_null(col(c).cast("string")).isNull()

    date = F.substr(F.coalesce(col(last_event).cast("string"), F.lit("")), F.lit(1), F.lit(10)).try_cast("date")
    coverage = F.when(date.isNull(), 0.75).when(F.datediff(date, as_date(as_of)) < 30, 0.5).otherwise(0.0)
    total = (
        F.coalesce(col(score), F.lit(1.0))
        + F.when(missing(events_link), 0.5).otherwise(0.0)
        + F.when(missing(last_mined), 0.5).otherwise(0.0)
        + coverage
    )
    return F.greatest(F.lit(V.EXPLORATION_FLOOR), total)
