"""Operators on small tables, several against a plain reading of their rule."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from playbill.operators import components, crawl, diagnostics, hygiene, images, listings, pages, ranking, scorecards, venues
from playbill.sources import readers, sinks

VENUE = "id string, name string, aliases array<string>, location string, ord string"


def names(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


# Venues -------------------------------------------------------------------------------------


def test_venue_resolution(spark):
    known = spark.createDataFrame([("a", "The Triffid", ["Triffid Newstead"], "", "1"), ("b", "Triffid", [], "", "2")], VENUE)
    rows = spark.createDataFrame(
        [("1", "the  TRIFFID", "1"), ("2", "triffid newstead", "2"), ("3", " ", "3"), ("4", "New Hall", "4"), ("5", "THE new hall", "5")], "id string, venue_text string, ord string"
    )
    linked, created = venues.resolve_venues(rows, known)
    got = {r.id: (r.venue_id, r.venue) for r in linked.collect()}
    new = created.head()
    assert got["1"] == got["2"] == ("a", "The Triffid") and got["3"] == ("", "")
    assert got["4"] == got["5"] == (new.id, "New Hall") and created.count() == 1


def test_locations_come_down_to_one_row_per_venue_before_the_join(spark):
    known = spark.createDataFrame([("a", "Hall", ["The Old Hall"], "old", "1"), ("b", "Barn", [], "kept", "2")], VENUE)
    rows = [("a", "", "one", "1"), ("", "old hall", "two", "2"), ("a", "x", " ", "3"), ("", "Nowhere", "gone", "4"), ("", "", "none", "5"), ("c", "", "none", "6")]
    told = spark.createDataFrame(rows, "venue_id string, venue string, location string, ord string")
    _, moved, counts = hygiene.move_location_to_venues(told, known)
    assert names(moved, "id", "location") == [("a", "two"), ("b", "kept")]
    assert tuple(counts.head()) == (3, 6)
    # the rows, the venues' keys and the moves of a venue are brought together, the rows before they meet the keys
    assert moved._jdf.queryExecution().optimizedPlan().toString().count("Aggregate ") == 3


def test_lookup_of_venues_is_known_to_be_small(spark):
    known = spark.createDataFrame([("a", "The Triffid", [], "", "1")], VENUE)
    rows = spark.createDataFrame([("1", "triffid", "1"), ("2", " ", "2"), ("3", None, "3"), ("4", "New", "4")], "id string, venue_text string, ord string")
    linked, created = venues.resolve_venues(rows, known)
    assert "SortMergeJoin" not in linked._jdf.queryExecution().executedPlan().toString()
    assert names(linked, "id", "venue") == [("1", "The Triffid"), ("2", ""), ("3", ""), ("4", "New")] and created.count() == 1


def test_host_match_reads_both_ways(spark):
    known = spark.createDataFrame([("z", "Example Arms", [], "", "1"), ("t", "The Triffid", [], "", "2"), ("q", "Abc", [], "", "3")], VENUE)
    hosts = spark.createDataFrame([("www.thetriffid.com.au:80",), ("example.org",), ("www.abc.io",), ("triff.id",)], "host string")
    assert names(venues.match_hosts(hosts, known), "host", "venue_id") == [("example.org", "z"), ("triff.id", "t"), ("www.thetriffid.com.au:80", "t")]


def test_mentions_in_whole_texts(spark):
    known = spark.createDataFrame([("t", "The Triffid", [], "", "1"), ("l", "A Very Long Name For A Hall", [], "", "2"), ("x", "Abc", [], "", "3")], VENUE)
    filler = "words and more words " * 60
    rows = spark.createDataFrame(
        [("1", filler + "at the triffid tonight"), ("2", filler[:110] + "a very LONG  name for a hall" + filler), ("3", "abc"), ("4", "xtriffidx"), ("5", "tri ffid")], "id string, text string"
    )
    assert names(venues.mentions(rows, known), "row_id", "venue_id") == [("1", "t"), ("2", "l"), ("4", "t")]


@pytest.mark.parametrize("few", [0, 256])
def test_mentions_at_every_place_and_of_every_length(spark, monkeypatch, few):
    monkeypatch.setattr(venues, "FEW_KEYS", few)
    rng = random.Random(5)
    letters = "ab𝄞 é"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    texts = [(str(i), word(700)) for i in range(12)]
    cut = [t[at : at + n] for n in (4, 5, 6, 7, 8, 14, 15, 16, 30, 31, 47, 130) for _, t in texts for at in (rng.randrange(560),)]
    known = spark.createDataFrame([(str(i), "q" + c, [c], "", str(i)) for i, c in enumerate(cut)], VENUE)
    rows = spark.createDataFrame(texts, "id string, text string")
    want = rows.select("id", venues.collapse_key("text").alias("t")).crossJoin(
        known.select(F.col("id").alias("v"), venues.core_key(F.col("aliases")[0]).alias("c"))
    ).filter("length(c) >= 4 and contains(t, c)")
    assert names(venues.mentions(rows, known), "row_id", "venue_id") == names(want, "id", "v")


def test_texts_offer_few_grams_to_long_venue_keys(spark):
    row = spark.range(1).select(F.repeat(F.lit("0123456789abcdefghijklmnopqrstu"), 33).alias("t"))
    grams = F.transform(venues.text_runs(F.col("t"), 128, 100), lambda r: venues.text_grams(r["own"], {(16, 16)}))
    assert row.select(F.size(F.flatten(grams))).head()[0] <= 33 * 31 // 16


def test_deleting_a_venue_checks_its_input(spark):
    known = spark.createDataFrame([("a", "A", [], "", "1"), ("b", "B", [], "", "2")], VENUE)
    events = spark.createDataFrame([("1", "a", "A", "i1"), ("2", "b", "B", "i2")], "id string, venue_id string, venue string, image_id string")
    blobs = spark.createDataFrame([("i1",), ("i2",)], "id string")
    for error, args in ((KeyError, ("x",)), (ValueError, ("a", "a")), (ValueError, ("a",)), (KeyError, ("a", "x"))):
        with pytest.raises(error):
            venues.delete_venue(known, events, blobs, *args)
    out = venues.delete_venue(known, events, blobs, "a", delete_linked=True)
    assert names(out["images"], "id") == [("i2",)] and names(out["events"], "id") == [("2",)]
    assert out["counts"].head().asDict() == {"events_updated": 0, "events_deleted": 1, "venues_deleted": 1}


def test_known_venue_with_blank_location_hides_the_rows_own(spark):
    known = spark.createDataFrame([("a", "A", [], None, "1")], VENUE)
    rows = spark.createDataFrame([("1", "a", "Old"), ("2", "zz", "Own"), ("3", None, "Own")], "id string, venue_id string, location string")
    assert names(listings.with_locations(rows, known), "id", "location") == [("1", ""), ("2", "Own"), ("3", "Own")]


# Pages and images ---------------------------------------------------------------------------

PAGE = "page_id bigint, url string, html string"


def page(spark, *rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], PAGE)


def test_an_unlinked_venue_is_deleted(spark):
    stays = spark.createDataFrame([("v-1", "One"), ("v-2", "Two")], "id string, name string")
    rows = spark.createDataFrame([("e1", "One", "v-1", "")], "id string, venue string, venue_id string, image_id string")
    blobs = spark.createDataFrame([], "id string")
    out = venues.delete_venue(stays, rows, blobs, "v-2")
    assert [r.id for r in out["venues"].collect()] == ["v-1"] and out["events"].count() == 1
    assert tuple(out["counts"].head()) == (0, 0, 1)


def test_page_text_keeps_images_in_place(spark):
    html = (
        '<html><head><title>T &amp; Co</title><script>var a = "<p>no</p>";</script></head><body><p>One <b>two</b></p><!-- gone -->'
        "<IMG data-src='/u/poster.jpg' alt='A \"B\"'><img src=/static/logo.png><img src='x.jpg' width=40>end\n line&nbsp;</body>"
    )
    text = pages.page_text(page(spark, ("https://h.example/a/list", html))).head().text
    assert text == "### Fetched: https://h.example/a/list\n\nT & Co\nOne\ntwo\n[IMG alt=\"A 'B'\" src=https://h.example/u/poster.jpg]\nend\n line"


def test_links_of_a_page(spark):
    html = (
        '<a href="/about">a</a><a href="#x">b</a><a href="/cart">c</a><a class=q href=\'/events/1#top\'>d</a><a href="/events/1">e</a>'
        '<a href="https://other.example/">f</a><a href="/x.pdf">g</a><a href="JavaScript:void(0)">h</a><a href="list?page=2">i</a>'
    )
    df = page(spark, ("https://h.example/a/", html))
    assert [r.link for r in pages.link_edges(df).orderBy("pos").collect()] == [
        "https://h.example/about", "https://h.example/events/1", "https://h.example/a/list?page=2"]
    assert [r.priority for r in pages.top_links(df).orderBy("rank").collect()] == [10, 8, -4]


def test_listing_link_of_a_home_page(spark):
    html = '<a href="/about">About</a><a href="/calendar">See all</a><a href="/whats-on"><b>What\'s On</b></a><a href="https://x.example/gigs">Gigs</a>'
    row = pages.best_listing_link(page(spark, ("https://h.example/home", html), ("https://e.example/", "<a href='/about'>x</a>"))).collect()
    assert [(r.link, r.score) for r in row] == [("https://h.example/whats-on", 15)]


def test_images_are_handed_out_in_row_order(spark):
    url = "https://h.example/list"
    html = '<img src="one-alpha.jpg" alt=""><img src="two-bravo.jpg" alt="">'
    full = lambda name: f"https://h.example/list/{name}.jpg"
    rows = [
        ("r0", "alpha @ Hall", None), ("r1", "alpha @ Hall", None), ("r2", "bravo alpha @ Hall", None), ("r3", "bravo @ Hall", "https://own/1.jpg"),
        ("r4", "bravo @ Hall", "https://own/2.jpg"), ("r5", "charlie @ Hall", "https://own/2.jpg"),
    ]
    df = spark.createDataFrame([(r, title, url, t, r) for r, title, t in rows] + [("solo", "alpha", "https://h.example/one", None, "z")],
                               "id string, title string, url string, thumbnail_url string, ord string")
    got = {r.id: r.thumbnail_url for r in images.assign_images(df, page(spark, (url, html))).collect()}
    assert got == {"r0": full("one-alpha"), "r1": None, "r2": full("two-bravo"), "r3": "https://own/1.jpg", "r4": None, "r5": None, "solo": None}


# Crawl --------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("limits", "want"),
    [
        ((12, 28, 2), ["a/p0", "a/p1", "a/p2", "a/p3", "b/q0", "b/q1"]),
        ((12, 28, 1), ["a/p0", "a/p1", "a/p2", "b/q0", "b/q1"]),
        ((2, 28, 2), ["a/p0", "a/p1", "b/q0", "b/q1"]),
        ((12, 3, 2), ["a/p0", "a/p1", "b/q0"]),
    ],
)
def test_frontier(spark, limits, want):
    site = lambda u: f"https://{u[0]}.example{u[1:]}"
    web = {"a/p0": ["a/p1", "a/p2", "a/no"], "a/p1": ["a/p0", "a/p3"], "a/p2": ["a/p1"], "a/p3": ["a/p4"], "a/p4": [], "b/q0": ["b/q1", "a/p4"], "b/q1": []}
    df = page(spark, *[(site(u), "".join(f'<a href="{site(x)}">x</a>' for x in links)) for u, links in web.items()])
    seeds = spark.createDataFrame([(0, site("a/p0")), (1, site("b/q0"))], "seed int, link string")
    per_seed, total, depth = limits
    got = crawl.frontier(seeds, df, depth, per_seed, total)
    assert sorted(r.url for r in got.collect()) == [site(u) for u in want]


def test_frontier_ranks_all_links_of_a_page(spark):
    late = "https://h.example/events"
    many = [f"https://h.example/some/long/way/{i:03d}" for i in range(300)]
    df = page(spark, ("https://h.example/", "".join(f'<a href="{x}">x</a>' for x in [*many, late])), (late, ""), (many[-1], ""))
    seeds = spark.createDataFrame([(0, "https://h.example/")], "seed int, link string")
    crawled = lambda *budget, **limits: {r.url for r in crawl.frontier(seeds, df, 1, *budget, **limits).collect()}
    assert crawled(2, 28) == {"https://h.example/", late}
    assert crawled(12, 28) == {"https://h.example/", late, many[-1]}
    assert crawled(12, 28, found=220, kept=96) == {"https://h.example/"}


def test_whole_pages_are_read(spark):
    filler = "<p>words of a long page</p>" * 40_000
    html = "".join(f'<a href="/e/{i:04d}">x</a>' for i in range(400)) + filler + '<a href="/last">x</a><img src="/late-poster.jpg" alt="late poster">'
    df = page(spark, ("https://h.example/", html))
    assert pages.link_edges(df).count() == pages.top_links(df).count() == 401
    assert [r.src for r in pages.page_images(df).collect()] == ["https://h.example/late-poster.jpg"]
    assert pages.page_text(df).head().text.endswith("late-poster.jpg]")


def test_preview_image_in_either_order(spark):
    rows = [("https://h.example/1", '<meta content="/a.jpg" property="og:image">'), ("https://h.example/2", "<META property='og:image' content=' /b.jpg '/>"),
            ("https://h.example/3", '<meta property="og:image:width" content="7">')]
    assert sorted(r.og for r in pages.og_image(page(spark, *rows)).collect()) == ["https://h.example/a.jpg", "https://h.example/b.jpg"]


def test_discovery_tries_each_venue_once(spark):
    known = spark.createDataFrame([("a", "Triffid", [], "", "1"), ("b", "Triffid Two", [], "", "2"), ("c", "Tivoli", [], "", "3")], VENUE)
    results = spark.createDataFrame(
        [("https://triffid.com/x", 1), ("https://www.facebook.com/tivoli", 2), ("https://triffid.com/y", 3), ("https://thetivoli.com", 4), ("https://triffid.com/z", 5)], "link string, ord int"
    )
    homes = page(spark, ("https://triffid.com", '<a href="/gigs">Gigs</a>'), ("https://thetivoli.com", '<a href="/whats-on">x</a>'))
    assert names(crawl.discover(results, known, homes, 3), "venue_id", "events_link") == [("a", "https://triffid.com/gigs"), ("c", "https://thetivoli.com/whats-on")]
    assert names(crawl.discover(results, known, homes, 1), "venue_id") == [("a",)]
    # a page that is known already uses up a try and its venue, but is no discovery
    seen = spark.createDataFrame([("https://TRIFFID.com/gigs",), ("https://other.example",)], "link string")
    assert names(crawl.discover(results, known, homes, 1, known=seen), "venue_id") == [("c",)]
    assert names(crawl.discover(results, known, homes, 3, known.filter("id = 'a'"), seen), "venue_id") == [("c",)]
    assert names(crawl.discover(results, known, homes, 0), "venue_id") == []


# Scores -------------------------------------------------------------------------------------


def test_reports_count_once(spark):
    ddl = "report_id string, report_ts timestamp, kind string, key string, label string, events_added bigint, events_seen bigint, duplicates bigint, zero_yield_runs bigint, metadata map<string,string>"
    at = lambda d: dt.datetime(2026, 1, d)
    rows = [("r1", at(2), "query", "q", "Q", 1, 3, 2, 0, {"a": "1"}), ("r2", at(1), "query", "q", "q!", 0, 1, 1, 1, None), ("r1", at(2), "query", "q", "again", 9, 9, 9, 9, None)]
    scores = spark.createDataFrame([], "kind string, key string, label string, metadata map<string,string>, first_seen timestamp, last_seen timestamp, runs bigint, events_added bigint, events_seen bigint, duplicates bigint, zero_yield_runs bigint")
    ledger = spark.createDataFrame([], "kind string, key string, report_id string")
    deltas = spark.createDataFrame(rows, ddl)
    one, led = scorecards.apply_scores(scores, ledger, deltas)
    two, _ = scorecards.apply_scores(one, led, deltas)
    for state in (one, two):
        r = state.head()
        assert (r.runs, r.events_added, r.events_seen, r.duplicates, r.zero_yield_runs, r.label) == (2, 1, 4, 3, 1, "Q")
        assert (r.first_seen, r.last_seen) == (at(1), at(2))


def test_source_memory(spark):
    ddl = "host string, url string, events_added bigint, events_seen bigint, runs_contributed bigint, first_seen timestamp, last_seen timestamp, last_picked timestamp"
    at = dt.datetime(2026, 1, 1)
    memory = spark.createDataFrame([("h", "https://h/a", 1, 2, 3, at, at, None), ("h", "https://h/b", 0, 1, 1, at, at, None)], ddl)
    run = spark.createDataFrame([("https://H/a/", 2, 3, 2), ("https://h/new", 0, 2, 2), ("https://h/one", 5, 5, 1), ("https://h/two", 1, 2, 2)], "url string, events_added bigint, events_seen bigint, distinct_events bigint")
    out = scorecards.remember_sources(memory, run, "2026-01-02 00:00:00")
    assert names(out, "url", "events_added", "events_seen", "runs_contributed") == [("https://h/a", 3, 5, 4), ("https://h/two", 1, 2, 1)]


def test_dominant_hosts_are_split_into_parts(spark):
    rows = spark.range(50).select(F.concat(F.lit("https://h.example/"), "id").alias("url"), F.col("id").alias("ord"))
    out = pages.urls_by_host(rows, chunk=10).collect()
    assert len(out) > 1 and sum(len(r.urls) for r in out) == 50


# Samples ------------------------------------------------------------------------------------


def test_weighted_samples(spark):
    df = spark.createDataFrame([(str(i), float(i % 3)) for i in range(30)], "id string, w double")
    picks = [r.id for r in ranking.weighted_sample(df, "w", 22, 1).collect()]
    assert len(set(picks)) == 22 and sum(int(p) % 3 == 0 for p in picks) == 2
    assert picks == [r.id for r in ranking.weighted_sample(df.repartition(5), "w", 22, 1).collect()]
    heavy = sum(int(ranking.weighted_sample(df, F.when(F.col("id") == "7", 1000.0).otherwise(1.0), 1, s).head().id) == 7 for s in range(5))
    assert heavy == 5


def test_merged_queries_keep_targeted_ones_first(spark):
    q = lambda rows: spark.createDataFrame(rows, "query string, ord int")
    out = ranking.merge_queries(q([("A", 1), (" ", 2)]), q([("b", 1), ("a", 2), ("C", 3)]), 2)
    assert [r.query for r in out.orderBy("tier", "ord").collect()] == ["A", "b"]


# Hygiene, sources, sinks --------------------------------------------------------------------


def test_whole_words_only(spark):
    rows = spark.createDataFrame([("1", "drag night"), ("2", "dragon"), ("3", "édrag"), ("", "drag")], "id string, act string").withColumns(
        {c: F.lit("") for c in ("venue", "location", "summary", "url")})
    assert names(listings.drop_terms(rows, ["DRAG"]), "id") == [("",), ("2",), ("3",)]
    assert listings.drop_terms(rows, []).count() == 4


def test_clusters_ignore_unknown_ids(spark):
    groups = spark.createDataFrame([("g", "x"), ("g", "b"), ("g", "c"), ("h", "c"), ("h", "d"), ("i", "e")], "group_id string, id string")
    ids = spark.createDataFrame([(i,) for i in "bcdef"], "id string")
    assert names(components.clusters(groups, ids), "id", "cluster") == [("b", "b"), ("c", "b"), ("d", "b")]
    chain = spark.range(60).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert components.connected_components(chain).filter("label <> 0").isEmpty()


def test_subscriptions_and_comments(spark):
    users = spark.createDataFrame([("a@b.co", dt.datetime(2020, 1, 1))], "email string, subscribed_at timestamp")
    new = spark.createDataFrame([(" A@B.co ",), ("x@y.org",), ("X@Y.org",), ("bad@",), ("a" * 250 + "@b.co",)], "email string")
    assert names(hygiene.subscribe(users, new, "2026-01-01 00:00:00"), "email") == [("a@b.co",), ("x@y.org",)]
    rows = spark.createDataFrame([("n", "c"), ("", "c"), ("n", " "), ("n" * 101, "c"), ("n", "c" * 2001)], "name string, comment string")
    good, bad = hygiene.valid_comments(rows)
    assert good.count() == 1 and bad.count() == 4


def test_feed_document_and_rules(spark, tmp_path):
    (tmp_path / "feed.json").write_text('{"generated": "x", "events": [\n {"id": "1", "eventName": "A", "venue": "V", "url": "u", "date": "d"},\n {"id": "2", "eventName": "B"}]}')
    assert names(readers.read_feed(spark, str(tmp_path / "feed.json")), "id", "title") == [("1", "A @ V"), ("2", "B")]
    (tmp_path / "rules.json").write_text('{"drop_terms": ["x"]}')
    (tmp_path / "bad.json").write_text("[1")
    assert readers.load_rules(spark, str(tmp_path / "rules.json")).drop_terms == ("x",)
    assert readers.load_rules(spark, str(tmp_path / "bad.json")) == readers.load_rules(spark, str(tmp_path / "none.json")) == readers.Rules()


def test_a_replayed_batch_changes_nothing_but_what_follows_runs(spark, tmp_path):
    from playbill import schemas
    from playbill.streaming import jobs

    rows = [("n1", "Band", "Hall", "", "Town", dt.date(2026, 1, 10), "https://a.example/1", [], "", "", "", [], "n1")]
    spark.createDataFrame(rows, schemas.EVENTS).write.parquet(f"{tmp_path}/in")
    start = spark.createDataFrame([("v-1", "Hall", [], "", "1", "https://hall.example")], VENUE + ", website string")
    calls = []

    def once(checkpoint, fail):
        def after(events, venues):
            calls.append((events.count(), venues.columns))
            if fail:
                raise ValueError("stop here")

        src = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
        return jobs.merge_stream(src, lambda b: b, f"{tmp_path}/store", start, "2026-01-10", f"{tmp_path}/{checkpoint}", after)

    with pytest.raises(Exception):
        once("c", True)
    once("c", False)
    once("d", False)  # the same batch from a new checkpoint: its marks are there
    assert len(calls) == 2 and calls[1][0] == 1 and "website" in calls[1][1]
    assert sinks.stored_table(spark, f"{tmp_path}/store", "events").count() == 1
    assert sinks.stored_table(spark, f"{tmp_path}/store", "venues").head().website == "https://hall.example"


def test_coverage_puts_unknown_dates_first(spark):
    rows = spark.createDataFrame(
        [("a", "A", "2026-03-01", None), ("b", "B", None, "2"), ("c", "C", "x", "1")], "id string, name string, last_event_date string, last_mined string"
    ).withColumns({"location": F.lit(""), "events_link": F.lit("")})
    assert [r.venue_id for r in diagnostics.venue_coverage(rows, "2026-01-01").collect()] == ["c", "b", "a"]
