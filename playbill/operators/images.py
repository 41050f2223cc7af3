"""Poster images: lookup, upkeep, assignment to rows that share a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playbill.functions import fixed_values as V
from playbill.functions.text import blank_to_null, split_title, strip, title_words
from playbill.functions.urls import asset_path, extension_for, image_id, is_http, poster_quality
from playbill.operators.matching import serve_in_order
from playbill.operators.pages import og_image, page_images
from playbill.session import cut_lineage

SALTS = 32
#: an address of more rows is spread over several tasks
HOT_ROWS = 100_000


def upsert_by_key(target: DataFrame, delta: DataFrame, key: str = "id") -> DataFrame:
    """Replace rows by key and add new ones."""
    return target.join(delta.select(key).distinct(), key, "left_anti").unionByName(delta)


def image_rows(df: DataFrame) -> DataFrame:
    """Image rows with the digest of their bytes."""
    return df.select(
        "id", strip("source_url").alias("source_url"), "content_type", "data", F.sha2("data", 256).alias("sha256")
    )


def register_sources(images: DataFrame, urls: DataFrame) -> DataFrame:
    """Add a placeholder per poster address that has no image with bytes yet.

    A placeholder that exists keeps its content type and takes the address.
    """
    wanted = urls.select(strip("url").alias("source_url")).filter("source_url <> ''").distinct()
    cached = images.filter("sha256 is not null").select("source_url").distinct()
    missing = wanted.join(cached, "source_url", "left_anti").select(
        image_id("source_url", F.lit(".jpg")).alias("id"), F.col("source_url").alias("_url")
    )
    merged = images.join(missing, "id", "full")
    return merged.select(
        "id", F.coalesce("_url", "source_url").alias("source_url"),
        F.coalesce("content_type", F.lit("image/jpeg")).alias("content_type"), "data", "sha256",
    )


def gc_images(images: DataFrame, events: DataFrame) -> DataFrame:
    """Images some event still shows. Without any such event nothing is kept."""
    used = events.select(strip("image_id").alias("id")).filter("id <> ''").distinct()
    return images.join(used, "id", "left_semi")


def dead_images(images: DataFrame, events: DataFrame) -> DataFrame:
    used = events.select(strip("image_id").alias("id")).filter("id <> ''").distinct()
    return images.join(used, "id", "left_anti")


def blob_counts(images: DataFrame) -> DataFrame:
    return images.agg(
        F.count_if(F.col("sha256").isNotNull()).alias("with_data"), F.count_if(F.col("sha256").isNull()).alias("without_data")
    )


def update_images(events: DataFrame, delta: DataFrame) -> DataFrame:
    """Set image, quality (-1 when none is given) and, when given, the poster address by event id."""
    changes = delta.select(
        "id", F.col("image_id").alias("_image"), F.col("poster_quality").alias("_quality"),
        blank_to_null("poster_url").alias("_poster"), F.lit(True).alias("_hit"),
    )
    hit = F.col("_hit").isNotNull()
    return events.join(changes, "id", "left").withColumns(
        {
            "image_id": F.when(hit, blank_to_null("_image")).otherwise(F.col("image_id")),
            "poster_quality": F.when(hit, F.coalesce("_quality", F.lit(-1))).otherwise(F.col("poster_quality")),
            "poster_url": F.coalesce("_poster", "poster_url"),
        }
    ).drop("_image", "_quality", "_poster", "_hit")


def _join_spread(rows: DataFrame, cached: DataFrame) -> DataFrame:
    """Rows with the cached image of their ``_url``. Rows without an address meet nothing and are dealt out; addresses of very many rows take ``SALTS`` places."""
    counts = rows.filter("_url is not null").groupBy("_url").agg(F.count(F.lit(1)).alias("_n"))
    # at most one in HOT_ROWS rows
    hot = F.broadcast(cut_lineage(counts.filter(F.col("_n") > HOT_ROWS).select("_url", F.lit(True).alias("_hot"))))
    salt = F.pmod(F.xxhash64("id", "title"), F.lit(SALTS)).cast("int")
    places = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    held = cached.join(hot, "_url", "left").select("_url", "_image", F.explode(places).alias("_salt"))
    dealt = rows.join(hot, "_url", "left").withColumn("_salt", F.when(F.col("_url").isNull() | F.col("_hot"), salt).otherwise(0))
    return dealt.join(held, ["_url", "_salt"], "left").drop("_hot", "_salt")


def resolve_assets(resources: DataFrame, images: DataFrame, db: str) -> DataFrame:
    """Image id, quality and display path of every row's poster. Image bytes are not read.

    Paths of this store pass through untouched; addresses without a cached image lose their poster.
    """
    url = strip("thumbnail_url")
    passing = url.startswith(f"/api/{db}/images/")
    usable = (strip("id") != "") & is_http("thumbnail_url")
    cached = (
        images.filter("sha256 is not null").groupBy(strip("source_url").alias("_url")).agg(F.min("id").alias("_image"))
    )
    joined = _join_spread(resources.withColumn("_url", F.when(usable & ~passing, url)), cached)
    found = F.col("_image").isNotNull()
    act = split_title("title")["act"]
    return joined.withColumns(
        {
            "image_id": F.when(passing, F.lit(None).cast("string")).otherwise(F.col("_image")),
            "poster_quality": F.when(passing, F.lit(None).cast("int")).when(found, poster_quality("_url", act)).otherwise(-1),
            "poster_url": F.when(found, F.col("_url")),
            "thumbnail_url": F.when(passing | found, F.when(passing, url).otherwise(asset_path(db, "_image"))),
            "passed": passing,
        }
    ).drop("_url", "_image")


# Images of listing pages --------------------------------------------------------------------


def best_image(titles: DataFrame, images: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """Per title the image of its page that shares most words with it, the first one on ties.

    ``titles`` has ``url, id, title``; ``images`` has ``url, pos, src, words``. Rows and images meet by
    shared word, so unrelated pairs never arise.
    """
    if exclude is not None:
        images = images.join(exclude.select("url", "src").distinct(), ["url", "src"], "left_anti")
    wanted = titles.select("url", "id", F.explode(title_words("title")).alias("word"))
    image_words = images.select("url", "pos", "src", F.explode("words").alias("word"))
    hits = wanted.join(image_words, ["url", "word"]).groupBy("url", "id", "pos", "src").agg(F.count(F.lit(1)).alias("score"))
    best = hits.groupBy("url", "id").agg(F.max_by(F.struct("src", "score"), F.struct("score", -F.col("pos"))).alias("b"))
    return best.select("url", "id", F.col("b.src").alias("src"), F.col("b.score").alias("score"))


def assign_images(resources: DataFrame, pages: DataFrame) -> DataFrame:
    """Give rows that share a page their own image of it.

    A thumbnail that is unique on its page stays. The others take, in row order, the best image still
    free; a duplicate that finds none is cleared. Rows with equal words on a page compete for the same
    images, so only as many of them as the page has images can win: later ones never take part in the
    proposals that hand the images out.
    """
    rows = resources.withColumns({"_url": strip("url"), "_thumb": strip("thumbnail_url")})
    shared = (
        rows.filter("_url <> ''").groupBy("_url").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_url")
    )
    thumbs = rows.filter("_url <> '' and _thumb <> ''").groupBy("_url", "_thumb").agg(F.count(F.lit(1)).alias("_times"))
    marked = (
        rows.join(shared.withColumn("_shared", F.lit(True)), "_url", "left").join(thumbs, ["_url", "_thumb"], "left")
        .withColumn("_needs", F.col("_shared").isNotNull() & ((F.col("_thumb") == "") | (F.col("_times") > 1)))
    )
    kept = thumbs.filter("_times = 1").select("_url", F.col("_thumb").alias("src"))
    # pages are read once, and only those some row waits for
    waiting = marked.filter("_needs").select(F.col("_url").alias("url")).distinct()
    wanted = pages.join(waiting, "url", "left_semi")
    # an address may have been read more than once: its pages count in their order, an image where it stands first
    found = page_images(wanted).withColumn("pos", F.struct("page_id", "pos"))
    once = found.groupBy(F.col("url").alias("_url"), "src").agg(F.min("pos").alias("pos"), F.min_by("words", "pos").alias("words"))
    everything = cut_lineage(once)
    with_images = everything.select("_url").distinct().withColumn("_paged", F.lit(True))
    free = everything.join(kept, ["_url", "src"], "left_anti")
    room = free.groupBy("_url").agg(F.count(F.lit(1)).alias("_room"), F.array_distinct(F.flatten(F.collect_list("words"))).alias("vocabulary"))
    marked = marked.join(with_images, "_url", "left")
    looking = (
        marked.filter("_needs").join(room, "_url")
        .withColumn("wish", F.array_sort(F.array_intersect(title_words("title"), "vocabulary")))
        .filter(F.size("wish") > 0).select("_url", "ord", "wish", "_room")
        .withColumn("salt", F.pmod(F.xxhash64("ord"), F.lit(SALTS)))
    )
    part = Window.partitionBy("_url", "wish", "salt").orderBy("ord")
    whole = Window.partitionBy("_url", "wish").orderBy("ord")
    ahead = looking.withColumn("_r", F.row_number().over(part)).filter("_r <= _room")
    # the n-th row with one wish can get the n-th image of its list at best
    ahead = cut_lineage(ahead.withColumn("at", F.row_number().over(whole)).filter("at <= _room").select("_url", "wish", "ord", "at"))
    lists = image_lists(ahead.select("_url", "wish").distinct(), free)
    given = serve_in_order(ahead, lists, ["_url", "wish"], ["_url", "src"], part="_url")
    done = marked.join(given.select("_url", "ord", F.col("src").alias("_won")), ["_url", "ord"], "left")
    cleared = F.col("_needs") & F.col("_paged").isNotNull() & (F.col("_times") > 1)
    thumb = F.coalesce("_won", F.when(~F.coalesce(cleared, F.lit(False)), F.col("thumbnail_url")))
    return done.withColumn("thumbnail_url", thumb).select(*resources.columns)


def image_lists(wishes: DataFrame, images: DataFrame) -> DataFrame:
    """Per page and wish the images that share words with it, most shared words first, then in page order: ``at`` counts from 1."""
    words = wishes.select("_url", "wish", F.explode("wish").alias("word"))
    hits = words.join(images.select("_url", "pos", "src", F.explode("words").alias("word")), ["_url", "word"])
    scored = hits.groupBy("_url", "wish", "pos", "src").agg(F.count(F.lit(1)).alias("score"))
    order = Window.partitionBy("_url", "wish").orderBy(F.desc("score"), "pos", "src")
    return cut_lineage(scored.select("_url", "wish", "src", F.row_number().over(order).alias("at")))


def fallback_image(resources: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows without a thumbnail take the preview image their page names."""
    rows = resources.withColumn("_url", F.when(F.coalesce("thumbnail_url", F.lit("")) == "", strip("url")))
    waiting = rows.filter("_url is not null").select("_url").distinct()
    # only pages some row waits for are parsed
    wanted = pages.withColumn("_url", strip("url")).join(waiting, "_url", "left_semi").drop("_url")
    previews = og_image(wanted).groupBy(strip("url").alias("_url")).agg(F.min("og").alias("_og"))
    return rows.join(previews, "_url", "left").withColumn(
        "thumbnail_url", F.coalesce(F.nullif(F.col("thumbnail_url"), F.lit("")), "_og")
    ).select(*resources.columns)


def stored_image_id(url: Column | str, content_type: Column | str) -> Column:
    return image_id(url, F.coalesce(extension_for(content_type), F.lit(V.CONTENT_TYPE_EXTENSIONS["image/jpeg"])))
