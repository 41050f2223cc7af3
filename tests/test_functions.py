"""Scalar rules on examples."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from playbill.functions import dates, scores, structured, text, urls
from playbill.operators import search

L = F.lit
D = dt.date


def arr(*items):
    return F.array(*[L(i) for i in items])


def cases():
    yield dates.parse_event_date(L(" 2026-05-07 8pm")), D(2026, 5, 7)
    for bad in ("2026-5-7", "2026-13-01", "07/05/2026", "", "2026-02-30", "0000-01-01"):
        yield dates.parse_event_date(L(bad)), None
    yield dates.store_date(L("20260507")), D(2026, 5, 7)
    yield dates.store_date(L("2026-05-07T10:00")), D(2026, 5, 7)
    yield dates.weekday_label(L("2026-05-07")), "Thu 7 May 2026"
    yield dates.weekday_label(L(" soon ")), "soon"
    yield dates.weekday_label(L(None).cast("string")), "—"
    yield dates.is_fresh(L("2026-01-20"), "2026-01-31 00:00:00", 14), True
    yield dates.is_fresh(L("2026-01-10"), "2026-01-31 00:00:00", 14), False
    yield dates.is_fresh(L("never"), "2026-01-31 00:00:00", 14), False
    yield dates.is_fresh(L(""), "2026-01-31 00:00:00", 0), True
    yield text.split_title(L(" A @ B, C, D ")), ("A", "B", "C, D")
    yield text.split_title(L("A @ B")), ("A", "B", "")
    yield text.split_title(L("A, B")), ("A, B", "", "")
    yield text.split_title(L("A @ B @ C, D")), ("A", "B @ C", "D")
    yield text.split_act_suffix(L("A @ B, C")), ("A", " @ B, C")
    yield text.split_act_suffix(L("")), ("—", None)
    yield text.split_act_suffix(L("x @  @ y")), ("x", " @ @ y")
    yield text.collapse_key(L("  The\t Big  HALL ")), "the big hall"
    yield text.core_key(L("The  Hall")), "hall"
    yield text.core_key(L("Theatre")), "theatre"
    yield text.alnum_key(L("The Crème-Brûlée 2!")), "crèmebrûlée2"
    yield text.slug(L(" The Joe’s \"Bar\" & Grill ")), "the-joes-bar-grill"
    yield text.normalize_tags(arr(" Rock ", "ROCK", "", "indie  pop", "x", "y")), ["rock", "indie pop", "x"]
    yield text.clean_act(L("Band (melb) [USA]  ")), "Band"
    yield text.clean_act(L("Band (a) Trio @ Hall (x)")), "Band (a) Trio"
    yield text.act_eligible(L("The Beths"), arr("indie")), True
    yield text.act_eligible(L("Tribute to X"), arr("rock")), False
    yield text.act_eligible(L("Live Music"), arr("rock")), False
    yield text.act_eligible(L("Band"), arr(" Open  MIC ")), False
    yield text.act_eligible(L("123 4"), arr("rock")), False
    yield text.act_eligible(L("X"), arr("rock")), False
    yield text.acts_overlap(L("Singer One"), L(" singer one, with Two")), True
    yield text.acts_overlap(L("One"), L("One and Two")), False
    yield text.build_title(L("A"), L(""), L("C")), "A @ C"
    yield text.build_title(L("A"), L(" "), L("")), "A"
    yield text.render_query("Gigs at {venue} in {location}, AU", L("Hall"), L("")), "Gigs at Hall, AU"
    yield text.render_query("Gigs at {place}", L("Hall"), L("")), "What's on at Hall"
    yield text.clip_keep_tail(L("abcdefMARKxyz"), "MARK", 10), "abcMARKxyz"
    yield text.clip_keep_tail(L("abcdefMARKxyz"), "MARK", 5), "MARKx"
    yield text.clip_keep_tail(L("abcdefghijkl"), "MARK", 5), "abcde"
    for raw, want in (("12", 12), (" 7 ", 7), ("-3", 0), ("1.5", 0), ("x", 0), (None, 0)):
        yield text.safe_int(L(raw).cast("string")), want
    yield text.error_class(L("HTTP 429")), "rate_limit"
    yield text.error_class(L("odd")), "other"
    yield text.decode_entities(L("a &amp;lt; b &lt;c&gt; &#233;&#x20AC; &eacute; &nope; &copy;")), "a &lt; b <c> é€ é &nope; ©"
    yield text.title_words(L("The Big Band live! @ Hall")), ["big", "band"]
    yield urls.normalize_url(L(" HTTPS://WWW.Ex.com/a/b//?q=1#frag")), "https://www.ex.com/a/b?q=1"
    yield urls.normalize_url(L("http://x.com/a/;v=1")), "http://x.com/a;v=1"
    yield urls.normalize_url(L("ftp://x.com")), ""
    yield urls.domain(L("https://www.wow.example/x")), "ow.example"
    yield urls.domain(L("https://Sub.example:80/x")), "sub.example:80"
    yield urls.host(L("no url")), "(unknown host)"
    yield urls.root_url(L("HTTP://A.b/c?d")), "http://A.b"
    yield urls.root_url(L("mailto:x@y")), ""
    yield urls.strip_link_junk(L("http://x/a).>")), "http://x/a)."
    yield urls.strip_link_junk(L("http://x/a>).")), "http://x/a"
    base = L("https://h.example/a/b/page.html?x=1#f")
    for link, want in (
        ("c.html", "https://h.example/a/b/c.html"), ("../c", "https://h.example/a/c"), ("./c/./d", "https://h.example/a/b/c/d"),
        ("/x/../y", "https://h.example/y"), ("?p=2", "https://h.example/a/b/page.html?p=2"), ("#top", "https://h.example/a/b/page.html?x=1#top"),
        ("//cdn.example/i", "https://cdn.example/i"), ("mailto:a@b", "mailto:a@b"), ("", "https://h.example/a/b/page.html?x=1#f"),
        ("..", "https://h.example/a/"), ("c/", "https://h.example/a/b/c/"),
    ):
        yield urls.absolute_url(base, L(link)), want
    yield urls.absolute_url(L("https://h.example"), L("c")), "https://h.example/c"
    yield urls.absolute_image_url(L("https://h.example/list"), L("i.jpg")), "https://h.example/list/i.jpg"
    for link, want in (
        ("https://x/cart", True), ("https://x/winery-sessions", False), ("https://x/win", True), ("https://x/street-food-lineup", True),
        ("https://x/food-and-live-music", False), ("https://x/menu", True), ("https://x/search-live-music", False), ("https://x/gigs/search", True),
    ):
        yield urls.is_unlikely_event_page(L(link)), want
    for link, want in (
        ("https://facebook.com/events/1", 22), ("https://x/whats-on?page=2", 10), ("https://x/about", -4), ("https://x/menu", -8),
        ("https://x/shop/tickets", 6), ("https://x/a?b?c", -1), ("https://x/concerts", 12),
    ):
        yield urls.link_priority(L(link)), want
    yield urls.seed_score(L("https://x/events/tickets")), 4
    yield urls.listing_score(L("https://x/gigs"), L(" Gigs ")), 15
    yield urls.listing_score(L("https://x/about"), L("About")), 0
    yield urls.listing_score(L("https://x/a/b/c"), L("See the gig guide now")), 3
    yield urls.is_candidate_image(L("/a/loading/x.jpg"), L("200"), L("auto")), True
    yield urls.is_candidate_image(L("/a/ad-1.jpg"), L(""), L("")), False
    yield urls.is_candidate_image(L("/a/x.jpg"), L("79"), L("")), False
    yield urls.is_candidate_image(L("data:x"), L(""), L("")), False
    yield urls.poster_quality(L(" "), L("Band")), -1
    yield urls.poster_quality(L("https://x/toowong-logo-600.jpg"), L("Boy & Bear")), 0
    yield urls.poster_quality(L("https://x/og.jpg"), L("The Beths")), 1
    yield urls.poster_quality(L("https://x/Boy-Bear-with-Dreggs.jpg"), L("Boy & Bear")), 4
    yield urls.extension_for(L("IMAGE/PNG; q=1")), ".png"
    yield urls.content_type_for(L(".xyz")), "application/octet-stream"
    yield urls.poster_src(L("a/b.jpg")), "/a/b.jpg"
    yield urls.poster_src(L("")), None
    yield urls.is_aggregator(L("www.Facebook.com")), True
    yield scores.is_stale(L(4), L(1)), True
    yield scores.is_stale(L(3), L(1)), False
    yield F.round(scores.source_weight(L(4), L(16)), 4), 4.0
    at = L("2026-01-15 00:00:00").cast("timestamp")
    yield F.round(scores.score_weight(L(4), L(16), L(0), L("2026-01-08 00:00:00").cast("timestamp"), at), 4), 4.25
    yield scores.score_weight(L(0), L(0), L(9), L("2027-01-08 00:00:00").cast("timestamp"), at), 0.15
    yield scores.venue_weight(L(None).cast("double"), L(""), L(None).cast("string"), L("junk"), "2026-01-01"), 2.75
    yield scores.venue_weight(L(2.0), L("http://x"), L("2025"), L("2026-01-20"), "2026-01-01"), 2.5


def test_examples(spark):
    pairs = list(cases())
    for start in range(0, len(pairs), 20):
        part = pairs[start : start + 20]
        row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(part)]).head()
        for i, (_, want) in enumerate(part):
            got = tuple(row[i]) if isinstance(want, tuple) else row[i]
            assert got == want, (start + i, got, want)


@pytest.mark.parametrize("query", ["jazz trio", "classical", "zz jaz"])
def test_search_score_reads_every_word(spark, query):
    blobs = ["classical quartet live", "jazzy nights trio", "jaz z", "triple a", "", "tri jazz"]
    terms = search.query_terms(query)

    def plain(blob):
        import re

        words, total, hits = re.findall(r"[a-z0-9]+", blob), 0.0, 0
        for t in terms:
            best = 0.0
            if t in blob:
                best = 2.0 * len(t)
            else:
                for w in words:
                    if w.startswith(t) or t.startswith(w):
                        best = max(best, 1.5 * len(t))
                    elif t in w or w in t:
                        best = max(best, 1.0 * len(t))
            hits += best > 0
            total += best
        return total * 1.25 if hits == len(terms) and hits else total

    df = spark.createDataFrame([(b,) for b in blobs], "b string").select("b", search.score(F.col("b"), terms).alias("s"))
    assert {r.b: round(r.s, 6) for r in df.collect()} == {b: round(plain(b), 6) for b in blobs}


def test_rows_in_free_text(spark):
    df = spark.createDataFrame(
        [(1, '1. "Red"\n2) red\n 3. Blue'), (2, 'x ```json\n{"items":[{"a":1},{"a":2}]}\n``` y'), (3, 'so [{"a": 5}] end'), (4, "nothing")], "k int, t string"
    )
    items = [(r.k, r.item) for r in structured.numbered_rows(df, "t", "k").orderBy("k", "pos").collect()]
    assert items == [(1, "Red"), (1, "Blue")]
    rows = [(r.k, r.a) for r in structured.json_rows(df, "t", "k", "a int", "items").orderBy("k", "pos").collect()]
    assert rows == [(2, 1), (2, 2), (3, 5)]


def test_uniform_numbers_do_not_depend_on_partitions(spark):
    df = spark.range(500).withColumn("id", F.col("id").cast("string"))
    one = {r[0]: r[1] for r in df.repartition(1).select("id", scores.uniform("id", 3)).collect()}
    many = {r[0]: r[1] for r in df.repartition(7).select("id", scores.uniform("id", 3)).collect()}
    assert one == many and all(0 < v < 1 for v in one.values())
