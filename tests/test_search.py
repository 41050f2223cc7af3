"""Search scores against a plain reading of the rule, and the index against the scan."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from playbill import schemas
from playbill.operators import pages, search

DAY = dt.date(2026, 1, 10)


def plain_score(text, words):
    points = []
    for term in words:
        found = re.findall("[a-z0-9]+", text)
        if term in text:
            points.append(2.0 * len(term))
        elif any(term.startswith(w) for w in found):
            points.append(1.5 * len(term))
        else:
            points.append(float(len(term)) if any(w in term for w in found) else 0.0)
    return sum(points) * (1.25 if points and all(points) else 1)


def texts():
    draw = random.Random(2)
    parts = ["ban", "band", "bands", "an", "b", "solo", "olo", "so", "éband", "x9", "9", "the", "Rock-Band", "", "SOLO!"]
    return [" ".join(draw.choice(parts) for _ in range(draw.randint(0, 5))) for _ in range(120)]


@pytest.fixture(scope="module")
def rows(spark):
    all_rows = [
        (f"{i:03d}", t, "Hall", "", "", DAY + dt.timedelta(days=i % 40), f"https://a.example/{i}" if i % 7 else "ftp://x", [], "", t[::-1] if i % 3 else None, "", ["Band", "x"] if i % 11 == 0 else None, f"{i:03d}")
        for i, t in enumerate(texts())
    ]
    return spark.createDataFrame(all_rows, schemas.EVENTS).repartition(3).cache()


@pytest.mark.parametrize("query", ["band", "bands solo", "x9 an", "Band, band! b", "", "zz", "9x solo-band"])
def test_scores_and_index(spark, rows, query):
    words = search.query_terms(query)
    scored = rows.select("ord", search.search_blob().alias("blob")).withColumn("score", search.score(F.col("blob"), words)).collect()
    assert [r.score for r in scored] == [plain_score(r.blob, words) for r in scored]
    index = search.build_index(rows)
    by_scan = [(r.id, r.score) for r in search.search(rows, query, DAY).collect()]
    assert [(r.id, r.score) for r in search.indexed_search(rows, index, query, DAY).collect()] == by_scan
    if words:
        every = {r.ord: r.score for r in search.index_scores(index, words).collect()}
        assert every == {r.ord: r.score for r in scored if r.score}


def test_an_index_of_nothing(spark, rows):
    index = search.build_index(rows.limit(0))
    assert search.indexed_search(rows, index, "band", DAY).count() == 0 and index["vocabulary"].count() == 0


def test_blocks_without_a_title_or_snippet_stay_apart(spark):
    block = "## Query\ntitle: {}\nsnippet: {}\nlink: https://a.example/{}).\n---\n"
    texts = [(1, block.format("", "s", 1) + block.format("t", "", 2) + block.format(" \t", " ", 3) + block.format("u", "v", 4)), (2, block.format("\n", "\nw", 5))]
    got = pages.parse_result_blocks(spark.createDataFrame(texts, "k int, t string"), "t", "k").orderBy("k", "pos").collect()
    assert [tuple(r) for r in got] == [
        (1, 0, "", "s", "https://a.example/1"), (1, 1, "t", "", "https://a.example/2"), (1, 2, "", "", "https://a.example/3"),
        (1, 3, "u", "v", "https://a.example/4"), (2, 0, "", "w", "https://a.example/5"),
    ]
