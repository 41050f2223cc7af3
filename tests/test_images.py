"""Images of one page handed out by proposals, against serving the rows one after the other."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from playbill.operators import images
from playbill.operators.matching import serve_in_order


def serve(rows, board):
    """The rule, told plainly: each row in turn takes the free image that shares most words with it."""
    free, out = list(board), {}
    for ord_, wish in rows:
        scores = [len(words & wish) for _, words in free]
        if scores and max(scores):
            out[ord_] = free.pop(scores.index(max(scores)))[0]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_proposals_serve_rows_in_order(spark, seed):
    draw = random.Random(seed)
    words = [f"word{c}" for c in "abcdefg"]
    pages, rows, want = [], [], {}
    for page in range(6):
        board = [(f"p{page}i{n}", set(draw.sample(words, draw.randint(1, 3)))) for n in range(draw.randint(0, 9))]
        mine = [(f"{page}{n:03d}", set(draw.sample(words, draw.randint(1, 4)))) for n in range(draw.randint(0, 14))]
        pages += [(f"u{page}", n, src, sorted(w)) for n, (src, w) in enumerate(board)]
        rows += [(f"u{page}", ord_, sorted(w)) for ord_, w in mine]
        want |= serve(mine, board)
    board = spark.createDataFrame(pages, "_url string, pos int, src string, words array<string>")
    waiting = spark.createDataFrame(rows, "_url string, ord string, wish array<string>").withColumn("at", F.lit(1))
    lists = images.image_lists(waiting.select("_url", "wish").distinct(), board)
    for part in ("_url", None):
        got = serve_in_order(waiting, lists, ["_url", "wish"], ["_url", "src"], part)
        assert {r.ord: r.src for r in got.collect()} == want


def test_a_page_with_a_hundred_thousand_rows(spark):
    shown = [("red", "fox"), ("red",), ("blue", "fox"), ("blue",), ("owl", "red"), ("owl",)]
    html = "".join(f'<img src="/i/{"-".join(w)}{n}.jpg" alt="{" ".join(w)}">' for n, w in enumerate(shown))
    page = spark.createDataFrame([(1, "https://a.example/x", html)], "page_id bigint, url string, html string")
    titles = ["red fox night", "blue fox", "owl show", "red owl", "nothing shared"]
    rows = spark.range(100_000).select(
        F.format_string("r%06d", "id").alias("id"), F.element_at(F.array(*map(F.lit, titles)), (F.col("id") % 5 + 1).cast("int")).alias("title"),
        F.lit("https://a.example/x").alias("url"), F.lit("").alias("thumbnail_url"), F.format_string("%06d", "id").alias("ord"),
    )
    got = {r.id: r.thumbnail_url for r in images.assign_images(rows, page).filter("thumbnail_url <> ''").collect()}
    board = [(f"https://a.example/i/{'-'.join(w)}{n}.jpg", set(w)) for n, w in enumerate(shown)]
    want = serve([(f"r{i:06d}", set(titles[i % 5].split())) for i in range(1000)], board)
    assert got == want and len(got) == len(shown)


def test_pages_of_one_address_offer_their_images_in_page_order(spark):
    tag = '<img src="/uploads/band-{}.jpg" alt="band {}">'
    pages = [(page, "https://a.example/x", "".join(tag.format(n, n) for n in names)) for page, names in ((2, ("beta", "alpha")), (1, ("gamma", "delta", "beta")))]
    rows = [(f"r{n}", "The band @ Hall", "https://a.example/x", None, f"{n}") for n in range(5)]
    got = images.assign_images(
        spark.createDataFrame(rows, "id string, title string, url string, thumbnail_url string, ord string"),
        spark.createDataFrame(pages, "page_id long, url string, html string"),
    )
    path = "https://a.example/uploads/band-{}.jpg"
    assert {r.id: r.thumbnail_url for r in got.collect()} == {
        "r0": path.format("gamma"), "r1": path.format("delta"), "r2": path.format("beta"), "r3": path.format("alpha"), "r4": None
    }


@pytest.mark.parametrize("hot", [100_000, 3])
def test_assets_of_rows_that_share_an_address_or_have_none_are_dealt_out(spark, monkeypatch, hot):
    monkeypatch.setattr(images, "HOT_ROWS", hot)
    address = lambda i: None if i % 3 == 0 else f"https://i/{0 if i % 2 else i % 5}.jpg"
    rows = spark.createDataFrame([(str(i), f"Act {i}", address(i)) for i in range(60)], "id string, title string, thumbnail_url string")
    stored = spark.createDataFrame([(f"img{i}", f"https://i/{i}.jpg", "x") for i in range(3)], "id string, source_url string, sha256 string")
    out = images.resolve_assets(rows, stored, "gigs")
    want = {str(i): f"img{address(i)[10]}" if address(i) and address(i)[10] < "3" else None for i in range(60)}
    assert {r.id: r.image_id for r in out.collect()} == want and out.count() == 60
    assert "_salt" in out._jdf.queryExecution().optimizedPlan().toString()
