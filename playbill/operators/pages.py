"""Web pages: links, text and images taken from HTML with native expressions.

Everything is worked out inside the scan of a page, so HTML itself is never shuffled. Tags are read by
pattern, which is exact on well-formed pages and approximate on broken ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.functions import fixed_values as V
from playbill.functions.text import decode_entities, keyword_set, let, strip
from playbill.functions.urls import (
    absolute_image_url, absolute_url, filename_words, host, is_candidate_image, is_unlikely_event_page, link_priority,
    listing_score, netloc, resolve, root_url, scheme, seed_score, strip_link_junk, strip_result_junk, url_struct,
    without_fragment,
)

# possessive, so long tags neither backtrack nor recurse
TAG_BODY = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
ANCHOR = r"(?i)<a\b" + TAG_BODY + ">"
ANCHOR_TEXT = r"(?is)<a\b" + TAG_BODY + r">.*?</a\s*>"
IMAGE = r"(?i)<img\b" + TAG_BODY + ">"
ANY_TAG = r"(?s)<!--.*?-->|</?[A-Za-z!?]" + TAG_BODY + ">"
UNSEEN = ("script", "style", "noscript", "template", "svg")


def attribute(tag: Column, name: str) -> Column:
    """Decoded attribute value of a tag; blank when missing."""
    pattern = r"""(?i)(?<![\w-])%s\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""" % name
    raw = F.regexp_extract(tag, pattern, 1)
    quoted = lambda v: v.startswith('"') | v.startswith("'")
    return decode_entities(let(raw, lambda v: F.when(quoted(v), F.substr(v, F.lit(2), F.length(v) - 2)).otherwise(v)))


def _clip(html: Column | str, limit: int | None) -> Column:
    text = F.col(html) if isinstance(html, str) else html
    return text if limit is None else F.when(F.length(text) > limit, F.substr(text, F.lit(1), F.lit(limit))).otherwise(text)


# Links --------------------------------------------------------------------------------------


def _page_links(skip_utility: bool = True, html_chars: int | None = None) -> Column:
    """Distinct same-host links of a page in document order."""
    tags = F.regexp_extract_all(_clip("html", html_chars), F.lit(ANCHOR), F.lit(0))
    hrefs = F.filter(
        F.transform(tags, lambda t: strip(attribute(t, "href"))),
        lambda h: (h != "") & ~h.startswith("#") & ~F.lower(h).startswith("javascript:"),
    )

    def on_page(base: Column) -> Column:
        full = lambda h: let(
            F.struct(base["url"].alias("url"), base["b"].alias("b"), url_struct(h).alias("l")),
            lambda v: without_fragment(resolve(v["url"], v["b"], h, v["l"])),
        )
        links = F.array_distinct(F.transform(hrefs, full))

        def fits(u: Column) -> Column:
            here = scheme(u).isin("http", "https") & (netloc(u) == F.lower(base["b"]["site"])) & ~u.rlike(V.BINARY_PATTERN)
            return here & ~is_unlikely_event_page(u) if skip_utility else here

        return F.filter(links, fits)

    return let(F.struct(F.col("url").alias("url"), url_struct("url").alias("b")), on_page)


def link_edges(pages: DataFrame, skip_utility: bool = True, html_chars: int | None = None) -> DataFrame:
    """Page → link edges with the position of the link on its page."""
    return pages.select("page_id", "url", F.posexplode(_page_links(skip_utility, html_chars)).alias("pos", "link"))


def top_links(pages: DataFrame, found: int | None = None, kept: int | None = None, html_chars: int | None = None) -> DataFrame:
    """The links of each page ranked by priority, shorter first; ``rank`` counts from 0.

    A budget may rank the first ``found`` links only and keep ``kept`` of them.
    """
    def ranked(links: Column) -> Column:
        key = lambda u, i: F.struct((-link_priority(u)).alias("a"), F.length(u).alias("b"), i.alias("c"), u.alias("link"))
        cut = lambda items, n: items if n is None else F.slice(items, 1, n)
        return cut(F.array_sort(F.transform(cut(links, found), key)), kept)

    return (
        pages.select("page_id", "url", F.posexplode(let(_page_links(html_chars=html_chars), ranked)).alias("rank", "l"))
        .select("page_id", "url", "rank", F.col("l.link").alias("link"), (-F.col("l.a")).alias("priority"))
    )


def best_listing_link(pages: DataFrame, html_chars: int | None = None) -> DataFrame:
    """The link of a page that looks most like the host's listing page, the first one on ties."""
    tags = F.regexp_extract_all(_clip("html", html_chars), F.lit(ANCHOR_TEXT), F.lit(0))

    def on_page(base: Column) -> Column:
        def look(tag: Column, i: Column) -> Column:
            found = let(
                F.struct(
                    strip(attribute(tag, "href")).alias("href"),
                    decode_entities(F.regexp_replace(tag, ANY_TAG, "")).alias("words"), base["url"].alias("url"), base["b"].alias("b"),
                ),
                lambda v: F.struct(
                    without_fragment(let(
                        F.struct(v["url"].alias("url"), v["b"].alias("b"), v["href"].alias("h"), url_struct(v["href"]).alias("l")),
                        lambda w: resolve(w["url"], w["b"], w["h"], w["l"]),
                    )).alias("link"),
                    v["href"].alias("href"), v["words"].alias("words"),
                ),
            )

            def judged(v: Column) -> Column:
                fits = (
                    (v["href"] != "") & ~v["href"].startswith("#") & ~F.lower(v["href"]).startswith("javascript:")
                    & scheme(v["link"]).isin("http", "https") & (netloc(v["link"]) == F.lower(base["b"]["site"]))
                )
                points = F.when(fits, listing_score(v["link"], v["words"])).otherwise(0)
                return F.struct((-points).alias("a"), i.alias("b"), v["link"].alias("link"))

            return let(found, judged)

        return F.array_min(F.filter(F.transform(tags, look), lambda s: s["a"] < 0))

    home = root_url("url")
    best = let(F.struct(home.alias("url"), url_struct(home).alias("b")), on_page)
    return (
        pages.select("page_id", "url", best.alias("l")).filter("l is not null")
        .select("page_id", "url", F.col("l.link").alias("link"), (-F.col("l.a")).alias("score"))
    )


# Text ---------------------------------------------------------------------------------------


def visible_text(html: Column, url: Column, alt_chars: int | None = None) -> Column:
    """Lines of a page: visible text between tags, with image markers where likely images stand."""
    for name in UNSEEN:
        html = F.regexp_replace(html, rf"(?is)<{name}\b{TAG_BODY}>.*?</{name}\s*>", " <br> ")
    empty = F.array().cast("array<string>")

    def text_nodes(piece: Column) -> Column:
        bare = decode_entities(F.regexp_replace(piece, ANY_TAG, "\u0001"))
        return F.filter(F.transform(F.split(bare, "\u0001"), lambda n: strip(n)), lambda n: n != "")

    def marker(tag: Column) -> Column:
        def mark(v: Column) -> Column:
            alt = F.replace(F.replace(v["alt"], F.lit("\n"), F.lit(" ")), F.lit('"'), F.lit("'"))
            short = alt if alt_chars is None else let(
                alt, lambda a: F.when(F.length(a) > alt_chars, F.concat(F.substr(a, F.lit(1), F.lit(alt_chars - 3)), F.lit("…"))).otherwise(a)
            )
            text = F.concat(F.lit('[IMG alt="'), short, F.lit('" src='), absolute_url(url, v["src"]), F.lit("]"))
            return F.when(is_candidate_image(v["src"], v["w"], v["h"]), F.array(text)).otherwise(empty)

        return let(_image_struct(tag), mark)

    def lines(text: Column) -> Column:
        images = F.regexp_extract_all(text, F.lit(IMAGE), F.lit(0))
        markers = let(images, lambda tags: F.transform(tags, marker))
        parts = F.arrays_zip(F.transform(F.split(text, IMAGE), text_nodes).alias("t"), markers.alias("m"))
        nodes = F.flatten(F.transform(parts, lambda p: F.concat(p["t"], F.coalesce(p["m"], empty))))
        return F.flatten(F.transform(nodes, lambda n: F.split(n, r"\r\n|\r|\n")))

    return F.array_join(F.filter(let(html, lines), lambda n: strip(n) != ""), "\n")


def _image_struct(tag: Column) -> Column:
    return F.struct(
        image_source(tag).alias("src"), strip(attribute(tag, "alt")).alias("alt"), attribute(tag, "width").alias("w"),
        attribute(tag, "height").alias("h"),
    )


def page_text(pages: DataFrame, limit: int | None = None, html_chars: int | None = None, alt_chars: int | None = None) -> DataFrame:
    """Readable text per page under a header line; a ``limit`` clips it to so many characters (4000 at least)."""
    body = visible_text(_clip("html", html_chars), F.col("url"), alt_chars)
    clipped = body if limit is None else F.substr(body, F.lit(1), F.lit(max(V.MIN_PAGE_TEXT, limit)))
    return pages.select("page_id", "url", F.concat(F.lit("### Fetched: "), F.col("url"), F.lit("\n\n"), clipped).alias("text"))


# Images -------------------------------------------------------------------------------------


def image_source(tag: Column) -> Column:
    sources = [let(attribute(tag, n), lambda v: F.nullif(v, F.lit(""))) for n in ("src", "data-src", "data-lazy-src")]
    return strip(F.coalesce(*sources, F.lit("")))


def page_images(pages: DataFrame, html_chars: int | None = None) -> DataFrame:
    """Plausible poster images of a page in document order, each address once, with their keywords."""
    tags = F.regexp_extract_all(_clip("html", html_chars), F.lit(IMAGE), F.lit(0))

    def found(base: Column) -> Column:
        fit = F.filter(F.transform(tags, _image_struct), lambda i: is_candidate_image(i["src"], i["w"], i["h"]))
        full = lambda i: F.struct(
            let(F.struct(i["src"].alias("s"), url_struct(i["src"]).alias("l")), lambda v: resolve(base["url"], base["b"], v["s"], v["l"])).alias("src"),
            i["alt"].alias("alt"),
        )
        once = lambda all_, srcs: F.filter(all_, lambda x, i: F.array_position(srcs, x["src"]) == i + 1)
        first = lambda all_: let(F.transform(all_, lambda f: f["src"]), lambda srcs: once(all_, srcs))
        return let(F.transform(fit, full), first)

    folder = F.concat("url", F.lit("/"))
    once = let(F.struct(folder.alias("url"), url_struct(folder).alias("b")), found)
    return pages.select("page_id", "url", F.posexplode(once).alias("pos", "i")).select(
        "page_id", "url", "pos", F.col("i.src").alias("src"), F.col("i.alt").alias("alt"),
        F.array_union(keyword_set(F.col("i.alt")), filename_words(F.col("i.src"))).alias("words"),
    )


META = r"(?i)<meta\b" + TAG_BODY + ">"


def og_image(pages: DataFrame, html_chars: int | None = None) -> DataFrame:
    """Preview image a page names for itself: the content of its first filled ``og:image`` tag, whatever the order of attributes."""
    tags = F.filter(F.regexp_extract_all(_clip("html", html_chars), F.lit(META), F.lit(0)), lambda t: F.lower(t).contains("og:image"))
    named = F.filter(tags, lambda t: F.lower(strip(attribute(t, "property"))) == "og:image")
    filled = F.filter(F.transform(named, lambda t: strip(attribute(t, "content"))), lambda c: c != "")
    raw = F.coalesce(F.get(filled, F.lit(0)), F.lit(""))
    rows = pages.select("page_id", "url", raw.alias("raw")).filter("raw <> ''")
    return rows.select("page_id", "url", absolute_image_url("url", "raw").alias("og"))


# Links in search results --------------------------------------------------------------------


def parse_result_blocks(df: DataFrame, text: str, key: str) -> DataFrame:
    """``title/snippet/link`` blocks of search-result texts, in order."""
    grab = lambda g: F.regexp_extract_all(text, F.lit(V.RESULT_BLOCK_PATTERN), F.lit(g))
    blocks = F.arrays_zip(grab(1).alias("title"), grab(2).alias("snippet"), grab(3).alias("link"))
    return df.select(key, F.posexplode(blocks).alias("pos", "b")).select(
        key, "pos", strip("b.title").alias("title"), strip("b.snippet").alias("snippet"), strip_result_junk("b.link").alias("link")
    )


def extract_link_lines(df: DataFrame, text: str, key: str) -> DataFrame:
    """Links of ``link:`` lines, cleaned; the first occurrence of an address counts."""
    links = F.transform(F.regexp_extract_all(text, F.lit(V.LINK_LINE_PATTERN), F.lit(1)), lambda u: strip_link_junk(u))
    kept = F.array_distinct(F.filter(links, lambda u: u.startswith("http")))
    return df.select(key, F.posexplode(kept).alias("pos", "link"))


def pick_seeds(links: DataFrame, limit: int = V.MAX_SEEDS) -> DataFrame:
    """One seed address per host, best keyword score first. ``links`` has ``link`` and ``ord``.

    When no link has a host the first links found are taken as they are.
    """
    first = links.groupBy("link").agg(F.min("ord").alias("ord"))
    rank = F.struct(-F.col("score"), F.length("link"), F.col("ord"))
    scored = first.withColumns({"score": seed_score("link"), "host": netloc("link")})
    best = (
        scored.filter("host <> ''").groupBy("host").agg(F.min_by(F.struct("link", "score", "ord"), rank).alias("b"))
        .select("host", "b.link", "b.score", "b.ord").withColumn("tier", F.lit(0))
    )
    # hosts come first; bare links only fill in when there is no host at all
    bare = scored.select("host", "link", F.lit(0).alias("score"), "ord", F.lit(1).alias("tier"))
    top = best.orderBy(F.desc("score"), F.length("link"), "ord").limit(limit)
    spare = bare.filter("host = ''").orderBy("ord").limit(limit)
    none = top.agg(F.count(F.lit(1)).alias("n")).scalar() == 0
    return top.unionByName(spare.filter(none)).select("link", "host", "score", "ord")


def merge_seeds(extra: DataFrame, found: DataFrame) -> DataFrame:
    """Remembered seeds first, then found seeds on other hosts. Both have ``link`` and ``ord``."""
    clean = extra.select(strip_link_junk(strip("link")).alias("link"), "ord").filter(F.col("link").startswith("http"))
    firsts = clean.groupBy(F.lower("link").alias("k")).agg(F.min_by(F.struct("link", "ord"), "ord").alias("r")).select("k", "r.link", "r.ord")
    hosts = firsts.select(netloc("link").alias("host")).distinct()
    others = (
        found.select("link", "ord", netloc("link").alias("host"), F.lower("link").alias("k"))
        .join(hosts, "host", "left_anti").join(firsts.select("k"), "k", "left_anti")
        .groupBy("k").agg(F.min_by(F.struct("link", "ord"), "ord").alias("r")).select("r.link", "r.ord")
    )
    return firsts.select(F.lit(0).alias("tier"), "ord", "link").unionByName(others.select(F.lit(1).alias("tier"), "ord", "link"))


def urls_by_host(df: DataFrame, group: list[str] | None = None, chunk: int | None = None) -> DataFrame:
    """Addresses per host in order, one list per group and host. ``df`` has ``url`` and ``ord``.

    With ``chunk``, a host with more addresses is spread over several lists, numbered by ``part``, so that no single row has to
    hold a dominant host.
    """
    keys = [*(group or []), "host"]
    rows = df.filter("url <> ''").withColumn("host", host("url"))
    return chunked_lists(rows, keys, F.struct("ord", "url"), "ord", chunk).select(
        *keys, "part", F.transform("items", lambda s: s["url"]).alias("urls")
    )


def chunked_lists(rows: DataFrame, keys: list[str], item: Column, spread: str, chunk: int | None) -> DataFrame:
    """Sorted lists of items per key, with ``chunk`` split into hashed parts of about so many items."""
    if chunk is None:
        return rows.groupBy(*keys).agg(F.lit(0).alias("part"), F.array_sort(F.collect_list(item)).alias("items"))
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / chunk).alias("_parts"))
    part = F.pmod(F.xxhash64(spread), F.col("_parts")).cast("int")
    spreaded = rows.join(sizes, keys).withColumn("part", part)
    return spreaded.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(item)).alias("items"))
