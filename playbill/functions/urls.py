"""Address expressions: parts, normal forms, link tests and link scores."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from playbill.functions import fixed_values as V
from playbill.functions.text import blank_to_null, col, keyword_set, let, strip, title_words

PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def one_of(fragments: Iterable[str]) -> str:
    """One pattern that finds any of the literal fragments."""
    return "|".join(re.escape(f) for f in fragments)


DECORATION = r"(?i)(?:^|[/_\-])(?:" + one_of(V.DECORATION_TOKENS) + ")"


def is_http(c: Column | str) -> Column:
    return F.lower(strip(c)).startswith("http")


def url_part(c: Column | str, group: int) -> Column:
    return F.regexp_extract(F.coalesce(col(c), F.lit("")), PARTS, group)


def scheme(c: Column | str) -> Column:
    return F.lower(url_part(c, 1))


def netloc(c: Column | str) -> Column:
    return F.lower(url_part(c, 2))


def url_path(c: Column | str) -> Column:
    return url_part(c, 3)


def host(c: Column | str) -> Column:
    return F.coalesce(F.nullif(netloc(c), F.lit("")), F.lit(V.UNKNOWN_HOST))


def root_url(c: Column | str) -> Column:
    def built(u: Column) -> Column:
        ok = u["scheme"].isin("http", "https") & (u["site"] != "")
        return F.when(ok, F.concat(u["scheme"], F.lit("://"), u["site"])).otherwise("")

    return let(F.struct(scheme(c).alias("scheme"), url_part(c, 2).alias("site")), built)


def domain(c: Column | str) -> Column:
    """Host without ``www.``; the strip also eats further ``w`` and ``.`` characters at the start."""
    return let(netloc(c), lambda n: F.when(n.startswith("www."), F.ltrim(n, F.lit("w."))).otherwise(n))


def normalize_url(c: Column | str) -> Column:
    """Stable form: lower-case host, no fragment, no slash at the end of the path. Blank unless http."""

    def built(u: Column) -> Column:
        params = F.regexp_extract(u["path"], r"(;[^/]*)$", 1)
        with_params = let(
            params,
            lambda p: F.concat(
                F.rtrim(F.substr(u["path"], F.lit(1), F.length(u["path"]) - F.length(p)), F.lit("/")), F.when(p == ";", "").otherwise(p)
            ),
        )
        return F.concat(
            F.when(u["scheme"] != "", F.concat(u["scheme"], F.lit(":"))).otherwise(""),
            F.when(u["site"] != "", F.concat(F.lit("//"), F.lower(u["site"]))).otherwise(""),
            F.when(u["path"].contains(";"), with_params).otherwise(F.rtrim(u["path"], F.lit("/"))),
            F.when(u["query"] != "", F.concat(F.lit("?"), u["query"])).otherwise(""),
        )

    return let(strip(c), lambda u: F.when(F.lower(u).startswith("http"), let(url_struct(u), built)).otherwise(""))


def strip_link_junk(c: Column | str) -> Column:
    return F.rtrim(F.rtrim(col(c), F.lit(V.LINK_JUNK)), F.lit(">"))


def strip_result_junk(c: Column | str) -> Column:
    return F.rtrim(strip(c), F.lit(V.RESULT_LINK_JUNK))


def _fold_dots(segments: Column) -> Column:
    """Path segments with ``.`` and ``..`` worked off."""
    empty = F.array().cast("array<string>")

    def step(acc: Column, seg: Column) -> Column:
        shorter = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(seg == "..", shorter).when(seg == ".", acc).otherwise(F.concat(acc, F.array(seg)))

    folded = F.aggregate(segments, empty, step)
    open_end = F.element_at(segments, -1).isin(".", "..")
    return F.when(open_end, F.concat(folded, F.array(F.lit("")))).otherwise(folded)


WHOLE = r"(?s)" + PARTS + r".*$"


def url_struct(c: Column | str) -> Column:
    """Parts of an address in one value, from one match: ``scheme``, ``site`` (as written), ``path``, ``query``."""
    flat = F.regexp_replace(F.coalesce(col(c), F.lit("")), WHOLE, "$1\u0001$2\u0001$3\u0001$4")
    return let(
        F.split(flat, "\u0001"),
        lambda p: F.struct(F.lower(p[0]).alias("scheme"), p[1].alias("site"), p[2].alias("path"), p[3].alias("query")),
    )


def absolute_url(base: Column | str, c: Column | str) -> Column:
    """Resolve a link against the page it stands on."""
    both = F.struct(col(base).alias("base"), url_struct(base).alias("b"), col(c).alias("link"), url_struct(c).alias("l"))
    return let(both, lambda v: resolve(v["base"], v["b"], v["link"], v["l"]))


def resolve(base: Column, b: Column, link: Column, part: Column) -> Column:
    """The resolution itself, over addresses whose parts are known."""
    prefix = F.concat(b["scheme"], F.lit("://"), b["site"])
    path = part["path"]

    def join_path() -> Column:
        rest = F.substr(link, F.length(path) + 1)
        folder = F.split(F.regexp_extract(b["path"], r"^(.*/)?[^/]*$", 1), "/")
        inside = F.when(F.size(folder) > 1, F.slice(folder, F.lit(1), F.greatest(F.size(folder) - 1, F.lit(1)))).otherwise(F.array(F.lit("")))
        joined = F.when(path.startswith("/"), F.split(path, "/")).otherwise(F.concat(inside, F.split(path, "/")))

        def tidy(segments: Column) -> Column:
            last = F.size(segments) - 1
            return F.filter(segments, lambda s, i: (s != "") | (i == 0) | (i == last))

        segments = F.when(path.startswith("/"), joined).otherwise(let(joined, tidy))
        return F.concat(prefix, F.array_join(let(segments, _fold_dots), "/"), rest)

    # most links are plain paths from the root; only the others walk over segments
    dotted = F.concat(F.lit("/"), path).contains("/.")
    plain = link.startswith("/") & ~dotted
    same_page = F.concat(prefix, b["path"])
    asked = F.when(b["query"] != "", F.concat(F.lit("?"), b["query"])).otherwise("")
    return (
        F.when(link == "", base)
        .when(part["scheme"] != "", link)
        .when(link.startswith("//"), F.concat(b["scheme"], F.lit(":"), link))
        .when(plain, F.concat(prefix, link))
        .when(link.startswith("?"), F.concat(same_page, link))
        .when(link.startswith("#"), F.concat(same_page, asked, link))
        .otherwise(join_path())
    )


def absolute_image_url(base: Column | str, c: Column | str) -> Column:
    """Image addresses resolve against the page address taken as a folder."""
    return absolute_url(F.concat(col(base), F.lit("/")), c)


def without_fragment(c: Column | str) -> Column:
    return F.substring_index(col(c), "#", 1)


# Link tests ---------------------------------------------------------------------------------


def has_event_signal(c: Column | str) -> Column:
    return F.lower(col(c)).rlike(one_of(V.EVENT_SIGNALS))


def _has_food_word(path: Column) -> Column:
    return path.rlike(r"(?:^|[/_-])\s*(?:" + one_of(V.FOOD_WORDS) + r")\s*(?:[/_-]|$)")


UTILITY_PAGE = r"(?:^|/)(?:" + one_of(V.NON_EVENT_SEGMENTS) + r")(?:/|$)"


def is_unlikely_event_page(c: Column | str) -> Column:
    """Cart, account, legal and food pages. Whole path segments count, not parts of words."""
    path = F.lower(url_path(c))
    return let(path, lambda p: p.rlike(UTILITY_PAGE) | (~has_event_signal(c) & _has_food_word(p)))


def is_aggregator(c: Column | str) -> Column:
    return F.lower(F.coalesce(col(c), F.lit(""))).rlike(one_of(V.AGGREGATOR_FRAGMENTS))


def link_priority(c: Column | str) -> Column:
    """Crawl priority of a link; each tier counts once."""

    def tiers(low: Column) -> Column:
        def points(pattern: str, n: int) -> Column:
            return F.when(low.rlike(pattern), n).otherwise(0)

        return (
            F.when(low.contains(V.SOCIAL_EVENT_FRAGMENT), 12).otherwise(0)
            + points(one_of(V.EVENT_LINK_FRAGMENTS), 10)
            + points(one_of(V.LISTING_LINK_FRAGMENTS), 2)
            + points(V.PAGING_PATTERN, 8)
            + points(one_of(V.LOW_VALUE_FRAGMENTS), -4)
        )

    def total(v: Column) -> Column:
        low, base = v["low"], v["base"]
        food = (base <= 0) & ~has_event_signal(low) & _has_food_word(url_path(low))
        marks = F.length(low) - F.length(F.replace(low, F.lit("?"), F.lit("")))
        return base + F.when(food, -8).otherwise(0) + F.when(marks > 1, -1).otherwise(0)

    return let(F.lower(col(c)), lambda low: let(F.struct(low.alias("low"), tiers(low).alias("base")), total))


def seed_score(c: Column | str) -> Column:
    low = F.lower(col(c))
    total = F.lit(0)
    for word in V.SEED_KEYWORDS:
        total = total + F.when(low.contains(word), 2).otherwise(0)
    return total


def listing_score(href: Column | str, text: Column | str) -> Column:
    """How much a link looks like a venue's listing page; 0 means not at all."""
    words = strip(F.lower(F.coalesce(col(text), F.lit(""))))

    def base(v: Column) -> Column:
        phrase = None
        for each in V.LISTING_PHRASES:
            hit = v["words"].contains(each)
            value = F.when(v["words"] == each, 8).otherwise(3)
            phrase = F.when(hit, value) if phrase is None else phrase.when(hit, value)
        return F.when(v["low"].rlike(one_of(V.LISTING_HREF_HINTS)), 6).otherwise(0) + phrase.otherwise(0)

    def total(v: Column) -> Column:
        slashes = F.length(v["low"]) - F.length(F.replace(v["low"], F.lit("/"), F.lit("")))
        near = F.when(slashes <= 4, 1).otherwise(0)
        return let(base(v), lambda b: F.when(b == 0, 0).otherwise(b + near))

    return let(F.struct(F.lower(col(href)).alias("low"), words.alias("words")), total)


# Images -------------------------------------------------------------------------------------


def is_decoration(c: Column | str) -> Column:
    return col(c).rlike(DECORATION) | col(c).rlike(V.AD_PATTERN)


def is_candidate_image(src: Column | str, width: Column | str, height: Column | str) -> Column:
    def too_small(side: Column | str) -> Column:
        return F.coalesce(strip(side).try_cast("int") < V.MIN_IMAGE_SIDE, F.lit(False))

    source = F.coalesce(col(src), F.lit(""))
    return (source != "") & ~source.startswith("data:") & ~is_decoration(source) & ~too_small(width) & ~too_small(height)


def filename_words(c: Column | str) -> Column:
    """Keywords of the last path segment, its extension dropped."""

    def last(u: Column) -> Column:
        return let(url_path(u), lambda p: F.when(p != "", F.substring_index(p, "/", -1)).otherwise(u))

    return let(F.coalesce(col(c), F.lit("")), lambda u: keyword_set(F.regexp_replace(last(u), V.FILE_EXTENSION_PATTERN, "")))


def poster_quality(url: Column | str, act: Column | str) -> Column:
    """-1 no poster, 0 decoration, 1 generic, 2 and more when the file name shares words with the act."""

    def graded(p: Column) -> Column:
        shared = F.size(F.array_intersect(title_words(act), filename_words(p)))
        return (
            F.when(p == "", -1)
            .when(is_decoration(p), 0)
            .otherwise(let(shared, lambda n: F.when(n > 0, n + 2).otherwise(1)))
        )

    return let(strip(url), graded)


def extension_for(content_type: Column | str) -> Column:
    kind = F.lower(strip(F.substring_index(F.coalesce(col(content_type), F.lit("")), ";", 1)))
    known = F.create_map(*[F.lit(x) for pair in V.CONTENT_TYPE_EXTENSIONS.items() for x in pair])
    return F.try_element_at(known, kind)


def content_type_for(extension: Column | str) -> Column:
    known = F.create_map(*[F.lit(x) for pair in V.EXTENSION_CONTENT_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(col(extension))), F.lit(V.DEFAULT_CONTENT_TYPE))


def image_id(url: Column | str, extension: Column | str) -> Column:
    return F.concat(F.substring(F.sha2(strip(url), 256), 1, 16), col(extension))


def asset_path(db: str, image: Column | str) -> Column:
    return F.concat(F.lit(f"/api/{db}/images/"), blank_to_null(image))


def poster_src(c: Column | str) -> Column:
    """Address a page can load: remote addresses as they are, paths from the root."""
    url = F.nullif(col(c), F.lit(""))
    return F.when(url.rlike("^(?:https?://|/)"), url).otherwise(F.concat(F.lit("/"), url))


def venue_line(venue: Column | str, location: Column | str) -> Column:
    return F.concat_ws(", ", blank_to_null(venue), blank_to_null(location))
