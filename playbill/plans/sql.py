"""DuckDB spellings of the scalar rules, used only by the oracle texts."""

from __future__ import annotations

from collections.abc import Iterable

from playbill.functions import fixed_values as V


def text_list(items: Iterable[str]) -> str:
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


def collapse(x: str) -> str:
    return f"lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"


def core(x: str) -> str:
    return f"regexp_replace({collapse(x)}, '^the ', '')"


def slug(x: str) -> str:
    return f"trim(regexp_replace(replace(lower(trim({x})), '''', ''), '[^a-z0-9]+', '-', 'g'), '-')"


def scheme(x: str) -> str:
    return f"lower(regexp_extract({x}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"


def netloc(x: str) -> str:
    return f"lower(regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"


def path(x: str) -> str:
    return f"regexp_extract({x}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


def host(x: str) -> str:
    return f"coalesce(nullif({netloc(x)}, ''), '{V.UNKNOWN_HOST}')"


def domain(x: str) -> str:
    return f"CASE WHEN {netloc(x)} LIKE 'www.%' THEN ltrim({netloc(x)}, 'w.') ELSE {netloc(x)} END"


def normalize_url(x: str) -> str:
    query = f"regexp_extract({x}, '^[^?#]*\\?([^#]*)', 1)"
    return (
        f"CASE WHEN lower(trim({x})) NOT LIKE 'http%' THEN '' ELSE {scheme(x)} || '://' || {netloc(x)} || rtrim({path(x)}, '/') || "
        f"CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END END"
    )


def uniform(key: str, seed: int | str) -> str:
    return f"((('0x' || substr(md5({key} || '-{seed}'), 1, 13))::BIGINT + 1) / 4503599627370497.0::DOUBLE)"


def any_of(x: str, fragments: Iterable[str]) -> str:
    return f"len(list_filter({text_list(fragments)}, lambda f: contains({x}, f))) > 0"


def keywords(x: str) -> str:
    return (
        f"list_distinct(list_filter(string_split_regex(lower({x}), '[^a-z0-9'']+'), "
        f"lambda w: length(w) >= 3 AND NOT list_contains({text_list(V.STOP_WORDS)}, w)))"
    )


def filename_words(x: str) -> str:
    last = f"regexp_extract(CASE WHEN {path(x)} <> '' THEN {path(x)} ELSE {x} END, '([^/]*)$', 1)"
    return keywords(f"regexp_replace({last}, '\\.[A-Za-z0-9]{{1,5}}$', '')")


def decoration(x: str) -> str:
    tokens = "|".join(V.DECORATION_TOKENS)
    return f"regexp_matches(lower({x}), '(^|[/_-])({tokens})') OR regexp_matches(lower({x}), '(^|[/_-])ads?([/_.-]|$)')"


def poster_quality(url: str, act: str) -> str:
    shared = f"len(list_intersect({keywords(act)}, {filename_words(url)}))"
    return (
        f"CAST(CASE WHEN coalesce({url}, '') = '' THEN -1 WHEN {decoration(url)} THEN 0 "
        f"WHEN {shared} > 0 THEN 2 + {shared} ELSE 1 END AS INT)"
    )


def source_weight(added: str, seen: str) -> str:
    return f"1.0::DOUBLE + sqrt({added}) + 0.25::DOUBLE * sqrt({seen})"


def event_signal(x: str) -> str:
    return any_of(f"lower({x})", V.EVENT_SIGNALS)


def segments(x: str) -> str:
    return f"list_filter(string_split(lower({path(x)}), '/'), lambda s: s <> '')"


def words_of_path(x: str) -> str:
    return f"list_concat({segments(x)}, string_split_regex(lower({path(x)}), '[/_-]'))"


def unlikely_page(x: str) -> str:
    return (
        f"(len(list_intersect({segments(x)}, {text_list(V.NON_EVENT_SEGMENTS)})) > 0 OR (NOT ({event_signal(x)}) AND "
        f"len(list_intersect({words_of_path(x)}, {text_list(V.FOOD_WORDS)})) > 0))"
    )


def link_priority(x: str) -> str:
    low = f"lower({x})"
    pts = lambda frags, n: f"CASE WHEN {any_of(low, frags)} THEN {n} ELSE 0 END"
    base = (
        f"(CASE WHEN contains({low}, '{V.SOCIAL_EVENT_FRAGMENT}') THEN 12 ELSE 0 END + {pts(V.EVENT_LINK_FRAGMENTS, 10)} + "
        f"{pts(V.LISTING_LINK_FRAGMENTS, 2)} + CASE WHEN regexp_matches({low}, '([?&](page|paged|pg|p)=[0-9]+|/page/[0-9]+|/p/[0-9]+)') "
        f"THEN 8 ELSE 0 END + {pts(V.LOW_VALUE_FRAGMENTS, -4)})"
    )
    food = f"len(list_intersect({words_of_path(x)}, {text_list(V.FOOD_WORDS)})) > 0"
    return (
        f"({base} + CASE WHEN {base} <= 0 AND NOT ({event_signal(x)}) AND {food} THEN -8 ELSE 0 END + "
        f"CASE WHEN length({low}) - length(replace({low}, '?', '')) > 1 THEN -1 ELSE 0 END)"
    )
