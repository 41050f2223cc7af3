"""Text and title expressions. All are native columns; none runs Python per row."""

from __future__ import annotations

import re
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from playbill.functions import fixed_values as V


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Work out ``value`` once and use it several times in ``body``; inside lambdas nothing else shares work."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column | str) -> Column:
    """Text without white space at both ends; null becomes empty."""
    return F.btrim(F.coalesce(col(c), F.lit("")), F.lit(V.WHITESPACE))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(strip(c), F.lit(""))


def squeeze(c: Column | str) -> Column:
    """Text with runs of white space turned into one space."""
    return strip(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)\s+", " "))


def collapse_key(c: Column | str) -> Column:
    """Comparison key for venues, tags and queries: lower case, single spaces."""
    return F.lower(squeeze(c))


def core_key(c: Column | str) -> Column:
    """Comparison key without one leading ``the``."""
    return let(collapse_key(c), lambda key: F.when(key.startswith("the "), F.substr(key, F.lit(5))).otherwise(key))


sort_name = core_key


def alnum_key(c: Column | str) -> Column:
    """Letters and digits of the core key, for comparison with host labels."""
    return F.regexp_replace(core_key(c), r"[^\p{L}\p{N}]", "")


def slug(c: Column | str) -> Column:
    text = F.regexp_replace(F.lower(strip(c)), "[‘’']", "")
    return F.btrim(F.regexp_replace(text, "[^a-z0-9]+", "-"), F.lit("-"))


def normalize_tags(c: Column | str, limit: int | None = V.MAX_TAGS) -> Column:
    """Distinct tag keys in order, at most ``limit``."""
    keys = F.transform(F.coalesce(col(c), F.array().cast("array<string>")), lambda t: collapse_key(t))
    kept = F.array_distinct(F.filter(keys, lambda t: t != ""))
    return kept if limit is None else F.slice(kept, 1, limit)


def clean_tags(c: Column | str) -> Column:
    """Stored tags as read back: trimmed, blanks out, nothing else changed."""
    tags = F.transform(F.coalesce(col(c), F.array().cast("array<string>")), lambda t: strip(t))
    return F.filter(tags, lambda t: t != "")


def _before(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, 1)


def _after(text: Column, mark: str) -> Column:
    return F.substr(text, F.length(_before(text, mark)) + len(mark) + 1)


def split_title(c: Column | str) -> Column:
    """``Act @ Venue, Location`` as a struct of its three parts; missing parts are blank."""
    part = lambda act, venue, place: F.struct(act.alias("act"), venue.alias("venue"), place.alias("location"))

    def placed(act: Column, rest: Column) -> Column:
        return F.when(
            rest.contains(", "), part(act, strip(_before(rest, ", ")), strip(_after(rest, ", ")))
        ).otherwise(part(act, rest, F.lit("")))

    def parts(title: Column) -> Column:
        act = strip(_before(title, " @ "))
        with_venue = let(strip(_after(title, " @ ")), lambda rest: placed(act, rest))
        return F.when(title.contains(" @ "), with_venue).otherwise(part(title, F.lit(""), F.lit("")))

    return let(strip(c), parts)


def split_act_suffix(c: Column | str) -> Column:
    """Linkable act name and the `` @ rest`` text that follows it."""
    title = strip(c)
    has_venue = title.contains(" @ ")
    act = strip(_before(title, " @ "))
    rest = strip(_after(title, " @ "))
    return F.struct(
        F.when(title == "", V.UNTITLED).when(has_venue & (act != ""), act).otherwise(title).alias("act"),
        F.when(has_venue & (act != "") & (rest != ""), F.concat(F.lit(" @ "), rest)).alias("suffix"),
    )


def build_title(act: Column | str, venue: Column | str, location: Column | str) -> Column:
    place = F.concat_ws(", ", blank_to_null(venue), blank_to_null(location))
    return F.when(place != "", F.concat(strip(act), F.lit(" @ "), place)).otherwise(strip(act))


def keyword_set(c: Column) -> Column:
    """Distinct words of at least three characters that are no stop words."""
    words = F.split(F.regexp_replace(F.lower(c), "[^a-z0-9']+", " "), " ")
    stop = F.array(*[F.lit(w) for w in V.STOP_WORDS])
    return F.array_except(F.filter(words, lambda w: F.length(w) >= 3), stop)


def title_words(c: Column | str) -> Column:
    act = let(split_title(c)["act"], lambda a: F.when(a != "", a).otherwise(F.coalesce(col(c), F.lit(""))))
    return keyword_set(act)


def acts_overlap(a: Column | str, b: Column | str) -> Column:
    """One act name contains the other and both are long enough to tell."""
    left, right = F.lower(strip(a)), F.lower(strip(b))
    long_enough = (F.length(left) >= V.MIN_ACT_LENGTH) & (F.length(right) >= V.MIN_ACT_LENGTH)
    return long_enough & (left.contains(right) | right.contains(left))


def clean_act(c: Column | str) -> Column:
    """Act name without venue part and trailing bracket groups."""
    name = strip(c)
    name = F.when(name.contains(" @ "), strip(_before(name, " @ "))).otherwise(name)
    return strip(F.regexp_replace(name, V.TRAILING_BRACKETS_PATTERN, ""))


def act_eligible(act: Column | str, tags: Column | str) -> Column:
    """The row names one recognisable act: no tribute, no generic night."""
    keys = F.transform(F.coalesce(col(tags), F.array().cast("array<string>")), lambda t: collapse_key(t))

    def eligible(both: Column) -> Column:
        keys, name = both["keys"], both["name"]
        tribute = (
            F.array_contains(keys, "tribute")
            | F.exists(keys, lambda t: t.contains("cover"))
            | name.rlike(V.COVER_PATTERN)
        )
        named = (
            ~F.arrays_overlap(keys, F.array(*[F.lit(t) for t in V.NON_BAND_TAGS]))
            & (F.length(name) >= 2)
            & name.rlike("[a-zA-Z]")
            & ~name.rlike(V.GENERIC_ACT_PATTERN)
            & name.rlike(r"(?s)\p{L}.*\p{L}")
        )
        return named & ~tribute

    # both are used several times and worked out once
    return let(F.struct(keys.alias("keys"), clean_act(act).alias("name")), eligible)


def render_query(template: str, venue: Column | str, location: Column | str) -> Column:
    """Fill a query template; a template with unknown fields falls back to a plain question."""
    fields = set(re.findall(r"\{([^{}]*)\}", template))
    if fields <= {"venue", "location"}:
        text = F.replace(F.lit(template), F.lit("{venue}"), col(venue))
        text = F.replace(text, F.lit("{location}"), F.coalesce(col(location), F.lit("")))
    else:
        text = F.concat(F.lit("What's on at "), col(venue))
    text = F.replace(F.replace(text, F.lit(" in ,"), F.lit(",")), F.lit(" in ."), F.lit("."))
    return squeeze(text)


def clip_keep_tail(c: Column | str, marker: str, limit: int) -> Column:
    """Clip to ``limit`` characters, giving the part from ``marker`` on the first claim to the room."""
    text = F.coalesce(col(c), F.lit(""))
    at = F.locate(marker, text)
    tail = F.substr(text, at)
    room = F.lit(limit) - F.length(tail)
    return (
        F.when(F.length(text) <= limit, text)
        .when(at == 0, F.substr(text, F.lit(1), F.lit(limit)))
        .when(room <= 0, F.substr(tail, F.lit(1), F.lit(limit)))
        .otherwise(F.concat(F.substr(text, F.lit(1), room), tail))
    )


def safe_int(c: Column | str) -> Column:
    """Non-negative whole number; anything else is 0."""
    return F.greatest(F.coalesce(strip(col(c).cast("string")).try_cast("bigint"), F.lit(0)), F.lit(0).cast("bigint"))


def error_class(c: Column | str) -> Column:
    """First matching class of a step error text."""
    low = F.lower(strip(c))
    result = None
    for name, fragments in V.ERROR_CLASSES:
        test = low.rlike("|".join(re.escape(f) for f in fragments))
        result = F.when(test, name) if result is None else result.when(test, name)
    return result.otherwise("other")


NAMED = "\u0002".join(f"{name}\u0003{chr(point)}" for name, point in sorted(name2codepoint.items()) if name != "amp")


def decode_entities(c: Column) -> Column:
    """Named and numeric character references turned into characters; ``&amp;`` goes last."""

    def code_point(n: Column) -> Column:
        return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")

    def numbers(text: Column, pattern: str, base: int) -> Column:
        lead = "&#" if base == 10 else "&#x"

        def put(acc: Column, digits: Column) -> Column:
            value = F.conv(digits, base, 10).cast("bigint")
            valid = (value > 0) & (value <= 0x10FFFF) & ~value.between(0xD800, 0xDFFF)
            return F.replace(acc, F.concat(F.lit(lead), digits, F.lit(";")), F.when(valid, code_point(value)).otherwise("\ufffd"))

        return let(text, lambda t: F.aggregate(F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), F.lit(1))), t, put))

    names = F.str_to_map(F.lit(NAMED), F.lit("\u0002"), F.lit("\u0003"))

    def named(acc: Column, name: Column) -> Column:
        ref = F.concat(F.lit("&"), name, F.lit(";"))
        return F.replace(acc, ref, F.coalesce(F.try_element_at(names, name), ref))

    def whole(raw: Column) -> Column:
        text = numbers(numbers(raw, r"&#(\d{1,7});", 10), r"&#x([0-9a-fA-F]{1,6});", 16)
        found = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(r"&([a-zA-Z]+[0-9]*);"), F.lit(1)))
        text = let(text, lambda t: F.aggregate(found(t), t, named))
        text = F.replace(F.replace(text, F.lit("&apos;"), F.lit("'")), F.lit("&amp;"), F.lit("&"))
        return F.when(raw.contains("&"), text).otherwise(raw)

    return let(c, whole)
