"""Venue entity resolution and venue upkeep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.functions import fixed_values as V
from playbill.functions.text import alnum_key, blank_to_null, collapse_key, core_key, let, strip
from playbill.functions.urls import host
from playbill.session import cut_lineage

SPREAD = 1024


def venue_names(venues: DataFrame) -> DataFrame:
    """One row per spelling of a venue: its name and every alias."""
    aliases = F.coalesce(F.col("aliases"), F.array().cast("array<string>"))
    return venues.select("id", "name", "ord", F.explode(F.concat(F.array("name"), aliases)).alias("spelling"))


def venue_keys(venues: DataFrame) -> DataFrame:
    """Core key → the first venue in store order that answers to it."""
    keys = venue_names(venues).withColumn("core", core_key("spelling")).filter("core <> ''")
    return keys.groupBy("core").agg(F.min_by(F.struct("id", "name"), "ord").alias("v")).select("core", "v.id", "v.name")


def new_venue_id(core: Column | str) -> Column:
    return F.concat(F.lit("n-"), F.substring(F.sha2(core, 256), 1, 16))


def resolve_venues(df: DataFrame, venues: DataFrame, text: str = "venue_text") -> tuple[DataFrame, DataFrame]:
    """Link venue texts to venues, creating one per unknown core key.

    Returns the rows with ``venue_id`` and ``venue`` (canonical name) and the new venues. The first text
    in row order names a new venue. Blank text gives no venue.
    """
    known = cut_lineage(venue_keys(venues))
    keyed = df.drop("venue_id", *([] if text == "venue" else ["venue"])).withColumn("_core", core_key(text))
    unknown = cut_lineage(
        keyed.filter("_core <> ''")
        .join(known.select(F.col("core").alias("_core")), "_core", "left_anti")
        .groupBy("_core")
        .agg(F.min_by(strip(text), "ord").alias("name"), F.min("ord").alias("ord"))
        .withColumn("id", new_venue_id("_core"))
    )
    # stored first, so the join knows how small it is; rows without a name are spread, as they meet nothing
    lookup = known.select(F.col("core").alias("_core"), F.col("id").alias("venue_id"), F.col("name").alias("_canon")).unionByName(
        unknown.select("_core", F.col("id").alias("venue_id"), F.col("name").alias("_canon"))
    )
    spread = F.when(F.col("_core") == "", F.pmod(F.xxhash64("ord"), F.lit(SPREAD)).cast("int")).otherwise(0)
    linked = (
        keyed.withColumn("_spread", spread).join(lookup.withColumn("_spread", F.lit(0)), ["_core", "_spread"], "left")
        .withColumn("venue", F.coalesce("_canon", F.lit("")))
        .withColumn("venue_id", F.coalesce("venue_id", F.lit("")))
        .drop("_core", "_canon", "_spread")
    )
    created = unknown.select(
        "id", "name", F.array().cast("array<string>").alias("aliases"), F.lit("").alias("location"), "ord"
    )
    return linked, created


# Names in other texts -----------------------------------------------------------------------
# Containment is found by equal pieces of text, so no side is ever crossed with the other.


def pieces(text: Column, size: int) -> Column:
    """Distinct substrings of ``size`` characters."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    every = F.transform(starts, lambda p: F.substr(text, p, F.lit(size)))
    return F.when(F.length(text) >= size, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


RUN_CHARS = 128
#: lengths of the grams by which keys and texts meet; a key of 2 n - 1 characters holds a whole gram of n however it lies in a text
GRAM_SIZES = (16, 8, 4)
#: so many short keys are looked for in whole texts
FEW_KEYS = 256


def text_runs(text: Column, size: int, around: int) -> Column:
    """Text cut into runs: ``own`` has ``size`` characters and the three that follow, ``run`` also ``around`` characters on both sides.

    ``size`` is at least ``around`` and a multiple of every gram length, so grams cut from the runs are those cut from the text.
    """
    cut = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % size), F.lit(0))
    head = lambda r, n: F.substr(F.coalesce(r, F.lit("")), F.lit(1), F.lit(n))
    tail = lambda r: F.right(F.coalesce(r, F.lit("")), F.lit(around))

    def wide(runs: Column) -> Column:
        own = lambda r, i: F.concat(r, head(F.get(runs, i + 1), V.MIN_VENUE_KEY - 1))
        run = lambda r, i: F.concat(tail(F.get(runs, i - 1)), r, head(F.get(runs, i + 1), around))
        return F.transform(runs, lambda r, i: F.struct(own(r, i).alias("own"), run(r, i).alias("run")))

    return let(cut, wide)


def text_grams(text: Column, kinds: set[tuple[int, int]]) -> Column:
    """Distinct grams of a run, for pairs of length and step: one after the other, or from every character on."""
    cut = [
        F.regexp_extract_all(text, F.lit("(?s)(?=(.{%d}))" % n), F.lit(1)) if step == 1 else F.regexp_extract_all(text, F.lit("(?s).{%d}" % n), F.lit(0))
        for n, step in sorted(kinds)
    ]
    return F.array_distinct(F.concat(*cut))


def key_grams(keys: DataFrame) -> DataFrame:
    """The grams a key waits under, with their length ``n`` and ``step``.

    A text offers every ``step``-th gram, so as many neighbouring ones of a key are needed: those that fewest keys share.
    """
    long = F.length("core")
    n, step = F.lit(V.MIN_VENUE_KEY), F.lit(1)
    for size in reversed(GRAM_SIZES):
        n, step = (F.when(long >= 2 * size - 1, size).otherwise(other) for other in (n, step))
    sized = keys.withColumns({"n": n, "step": step})
    cut = F.transform(F.sequence(F.lit(1), long - F.col("n") + 1), lambda p: F.substr("core", p, F.col("n")))
    spread = sized.select("core", "n", "step", F.posexplode(cut).alias("at", "gram"))
    rarity = spread.groupBy("gram").agg(F.count(F.lit(1)).alias("held"))
    listed = spread.join(rarity, "gram").groupBy("core", "n", "step").agg(F.array_sort(F.collect_list(F.struct("at", "gram", "held"))).alias("all"))
    part = lambda at: F.slice("all", at, F.col("step"))
    worst = lambda at: F.struct(F.array_max(F.transform(part(at), lambda g: g["held"])).alias("held"), at.alias("at"))
    best = F.array_min(F.transform(F.sequence(F.lit(1), F.size("all") - F.col("step") + 1), worst))
    chosen = let(best, lambda b: F.transform(part(b["at"]), lambda g: g["gram"]))
    return listed.select("core", "n", "step", F.explode(F.array_distinct(chosen)).alias("gram"))


def brand_label(host_col: Column | str) -> Column:
    """Longest label of a host, the first one on ties; ``www`` does not count."""
    name = F.substring_index(F.lower(F.col(host_col) if isinstance(host_col, str) else host_col), ":", 1)
    labels = F.filter(F.split(name, r"\."), lambda p: (p != "") & (p != "www"))
    best = F.aggregate(
        labels, F.lit(""), lambda acc, p: F.when(F.length(p) > F.length(acc), p).otherwise(acc)
    )
    return F.nullif(best, F.lit(""))


def host_venue_pairs(hosts: DataFrame, venues: DataFrame) -> DataFrame:
    """Hosts with every venue whose name or alias key contains the host's brand label, or is contained in it."""
    brands = hosts.select("host").distinct().withColumn("brand", brand_label("host")).filter("brand is not null")
    labels = brands.select("brand").distinct()
    names = venue_names(venues).withColumn("vkey", alnum_key("spelling")).filter(F.length("vkey") >= V.MIN_VENUE_KEY)
    names = names.select(F.col("id").alias("venue_id"), F.col("name").alias("venue"), F.col("ord").alias("venue_ord"), "vkey")
    keys = names.select("vkey").distinct()
    size = V.MIN_VENUE_KEY
    # key inside brand: every piece of the brand meets the keys that start with it
    inside = (
        labels.withColumn("piece", F.explode(pieces(F.col("brand"), size)))
        .join(keys.withColumn("piece", F.substr("vkey", F.lit(1), F.lit(size))), "piece")
        .filter(F.contains("brand", "vkey")).select("brand", "vkey")
    )
    # brand inside key: every piece of the key meets the brands that start with it; short brands are whole pieces
    starts = labels.withColumn("piece", F.substr("brand", F.lit(1), F.lit(size)))
    key_pieces = keys.withColumn(
        "piece", F.explode(F.concat(*[pieces(F.col("vkey"), n) for n in range(1, size + 1)]))
    )
    around = key_pieces.join(starts, "piece").filter(F.contains("vkey", "brand")).select("brand", "vkey")
    met = inside.union(around).distinct().join(names, "vkey")
    by_brand = met.select("brand", "venue_id", "venue", "venue_ord").distinct()
    return brands.join(by_brand, "brand").select("host", "brand", "venue_id", "venue", "venue_ord")


def match_hosts(hosts: DataFrame, venues: DataFrame) -> DataFrame:
    """The first venue in store order that a host's brand label matches."""
    best = host_venue_pairs(hosts, venues).groupBy("host", "brand").agg(
        F.min_by(F.struct("venue_id", "venue"), "venue_ord").alias("v")
    )
    return best.select("host", "brand", "v.venue_id", "v.venue")


def mentions(df: DataFrame, venues: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """Pairs of rows and venues where the whole text names the venue or an alias of it.

    Each venue key waits under its rarest grams, and a text visits the keys that wait under its own. Texts are cut into
    short runs first, with as many characters around them as a key has, so neither whole texts nor all pairs are ever
    shuffled. Short keys, whose grams stand in most texts, are looked for in place as long as they are few.
    """
    cores = cut_lineage(
        venue_names(venues).withColumn("core", core_key("spelling")).filter(F.length("core") >= V.MIN_VENUE_KEY)
        .select(F.col("id").alias("venue_id"), "core").distinct()
    )
    brief = F.length("core") < 2 * GRAM_SIZES[-2] - 1
    few = [r.core for r in cores.filter(brief).select("core").distinct().limit(FEW_KEYS + 1).collect()]
    waited, pairs = cores, []
    if 0 < len(few) <= FEW_KEYS:
        waited = cores.filter(~brief)
        held = let(collapse_key(text), lambda t: F.filter(F.array(*[F.lit(k) for k in few]), lambda k: F.contains(t, k)))
        pairs.append(df.select(F.col(key).alias("row_id"), F.explode(held).alias("core")).join(cores.filter(brief), "core"))
    waiting = cut_lineage(waited.join(key_grams(waited.select("core").distinct()), "core"))
    found = waiting.groupBy("n", "step").agg(F.max(F.length("core")).alias("longest")).collect()
    if found:
        longest = max(r.longest for r in found)
        size = -(-max(RUN_CHARS, longest) // GRAM_SIZES[0]) * GRAM_SIZES[0]
        spots = df.select(F.col(key).alias("row_id"), F.explode(text_runs(collapse_key(text), size, longest)).alias("r")).select(
            "row_id", "r.run", F.explode(text_grams(F.col("r.own"), {(r.n, r.step) for r in found})).alias("gram")
        )
        pairs.append(spots.join(waiting.select("venue_id", "core", "gram"), "gram").filter(F.contains("run", "core")))
    if not pairs:
        pairs.append(df.select(F.col(key).alias("row_id")).limit(0).crossJoin(cores.select("venue_id")))
    return reduce(DataFrame.unionByName, [p.select("row_id", "venue_id") for p in pairs]).distinct()


# Upkeep -------------------------------------------------------------------------------------


def linked_counts(events: DataFrame, ids: DataFrame) -> DataFrame:
    """Linked events per venue id of a list; blank ids and venues without events are left out."""
    rows = events.select(strip("venue_id").alias("venue_id")).filter("venue_id <> ''")
    counts = rows.groupBy("venue_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(ids.select("venue_id").distinct(), "venue_id", "left_semi")


def last_event_dates(events: DataFrame, venues: DataFrame) -> DataFrame:
    """Venues with their latest event date; ``changed`` marks the ones that differ from what is stored."""
    latest = (
        events.filter(strip("venue_id") != "").groupBy(strip("venue_id").alias("id")).agg(F.max("date").alias("_latest"))
        .filter("_latest is not null")
    )
    joined = venues.join(latest, "id", "left")
    changed = F.col("_latest").isNotNull() & ~F.col("_latest").eqNullSafe(F.col("last_event_date"))
    return joined.withColumns(
        {"changed": changed, "last_event_date": F.coalesce("_latest", "last_event_date")}
    ).drop("_latest")


def drop_orphans(venues: DataFrame, events: DataFrame) -> DataFrame:
    linked = events.select(strip("venue_id").alias("id")).filter("id <> ''").distinct()
    return venues.join(linked, "id", "left_semi")


def orphans(venues: DataFrame, events: DataFrame) -> DataFrame:
    linked = events.select(strip("venue_id").alias("id")).filter("id <> ''").distinct()
    return venues.join(linked, "id", "left_anti")


def sync_locations(events: DataFrame, venues: DataFrame) -> DataFrame:
    """Venues with the location of their last linked row that has one."""
    rows = events.select(strip("venue_id").alias("id"), strip("location").alias("_place"), F.col("ord").alias("_ord"))
    last = rows.filter("id <> '' and _place <> ''").groupBy("id").agg(F.max_by("_place", "_ord").alias("_place"))
    return venues.join(last, "id", "left").withColumn("location", F.coalesce("_place", "location")).drop("_place")


def add_alias(venues: DataFrame, additions: DataFrame) -> DataFrame:
    """Append one alias per venue unless its name or an alias already says the same."""
    extra = additions.select("id", strip("alias").alias("_alias")).filter("_alias <> ''")
    aliases = F.coalesce(F.col("aliases"), F.array().cast("array<string>"))
    known = F.exists(F.concat(F.array("name"), aliases), lambda s: core_key(s) == core_key("_alias"))
    grown = F.when(F.col("_alias").isNotNull() & ~known, F.array_append(aliases, F.col("_alias"))).otherwise(aliases)
    return venues.join(extra, "id", "left").withColumn("aliases", grown).drop("_alias")


def mark_mined(venues: DataFrame, ids: DataFrame, when: str) -> DataFrame:
    chosen = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return venues.join(chosen, "id", "left").withColumn(
        "last_mined", F.when(F.col("_hit"), F.lit(when)).otherwise(F.col("last_mined"))
    ).drop("_hit")


def delete_venue(
    venues: DataFrame,
    events: DataFrame,
    images: DataFrame,
    venue_id: str,
    replacement_id: str | None = None,
    delete_linked: bool = False,
) -> dict[str, DataFrame]:
    """Remove a venue after moving or deleting its events. Returns the new tables and the counts."""
    from playbill.operators.images import gc_images

    if replacement_id is not None and replacement_id == venue_id:
        raise ValueError("the replacement must be another venue")
    if venues.filter(F.col("id") == venue_id).isEmpty():
        raise KeyError(f"venue not found: {venue_id}")
    mine = strip("venue_id") == venue_id
    linked = not events.filter(mine).isEmpty()
    new_events, new_images = events, images
    if linked and delete_linked:
        new_events = events.filter(~mine)
        new_images = gc_images(images, new_events)
    elif linked:
        if not replacement_id:
            raise ValueError("linked events need a replacement venue")
        target = venues.filter(F.col("id") == replacement_id).select("name").head()
        if target is None:
            raise KeyError(f"replacement venue not found: {replacement_id}")
        new_events = events.withColumns(
            {
                "venue": F.when(mine, F.lit(target["name"])).otherwise(F.col("venue")),
                "venue_id": F.when(mine, F.lit(replacement_id)).otherwise(F.col("venue_id")),
            }
        )
    count = events.agg(F.count_if(mine).alias("n"))
    zero = F.lit(0).cast("bigint")
    counts = count.select(
        (zero if delete_linked else F.col("n")).alias("events_updated"),
        (F.col("n") if delete_linked else zero).alias("events_deleted"),
        F.lit(1).cast("bigint").alias("venues_deleted"),
    )
    return {
        "venues": venues.filter(F.col("id") != venue_id), "events": new_events, "images": new_images, "counts": counts,
    }


def mining_coverage(venues: DataFrame) -> DataFrame:
    """Per linked venue: host of its listing page and when it was mined and checked."""
    linked = venues.filter(blank_to_null("events_link").isNotNull())
    return linked.select("id", "name", host("events_link").alias("host"), "last_mined", "events_link_checked")


def coverage_counts(venues: DataFrame) -> DataFrame:
    return venues.agg(
        F.count(F.lit(1)).alias("venues"), F.count_if(blank_to_null("events_link").isNotNull()).alias("linked")
    )


