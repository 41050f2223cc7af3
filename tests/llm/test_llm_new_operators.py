"""Packing, importance resampling and hard negatives against plain versions, on small rows that hold the awkward cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from playbill.llm import hard_negatives, importance, packing

SCHEMA = "doc_id long, text string, length string, ids string, score string, rank string, n double, vector string"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def sentence(draw, n):
    return " ".join(draw.choice(["alpha", "Beta,", "gamma.", "don't", "x-9", "éta", "日本語", "Σσς", "İı"]) + str(draw.randint(0, 60)) for _ in range(n))


def awkward():
    draw = random.Random(3)
    texts = [(i, sentence(draw, draw.randint(1, 60))) for i in range(40)]
    texts += [(100 + i, "the same text of every copy, again and again and again, twenty words or more so that it is drawn or not drawn") for i in range(60)]
    texts += [(None, None), (None, None), (None, "null id"), (200, None), (201, ""), (202, " \t\n"), (203, "one"), (204, sentence(draw, 9000)), (7, texts[7][1])]
    return [*texts, (7, "another text of id seven"), (205, "a" * 200_000), (206, "w" * 600 + " " + "v" * 700), (207, "<|endoftext|> a<|endoftext|>b 'S it's")]


def make(spark, texts):
    return spark.createDataFrame([(i, t, "l", "i", "s", "r", 1.5, "v") for i, t in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return make(spark, awkward()).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return make(spark, [])


# 11: packing


@pytest.fixture(scope="module")
def library():
    out = Tokenizer.from_file(VOCABULARY)
    out.encode_special_tokens = True
    return lambda text: out.encode(text or "", add_special_tokens=False).ids


def encoded(words, texts):
    raw = [t.encode() for t in texts]
    return [np.frombuffer(x, "<u4").tolist() for x in words.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))]


@pytest.mark.parametrize("block", [packing.BLOCK, 40])
def test_words_have_the_ids_of_whole_texts(library, monkeypatch, block):
    monkeypatch.setattr(packing, "BLOCK", block)
    draw = random.Random(2)
    with open(VOCABULARY, "rb") as file:
        words = packing.WordIds(file.read())
    assert words.by_word
    pool = [*map(chr, range(1, 0x300)), *"ΣσςİıſḰ 　日本한\U0001f600", "<|endoftext|>", "'s", "'ll", " ", " "]
    texts = ["".join(draw.choice(pool) for _ in range(draw.randint(0, 50))) for _ in range(1500)] + [f"a{chr(c)}b {chr(c)}'s {chr(c) * 2}" for c in range(0x250)]
    texts += ["".join(draw.choice("abZ.,-19' <|>\n\t") for _ in range(draw.randint(0, 200))) for _ in range(500)]
    assert encoded(words, texts) == [library(t) for t in texts]
    assert encoded(words, []) == [] and encoded(words, ["", " "]) == [[], []]


def test_generations_of_words_and_other_rules(monkeypatch, library):
    monkeypatch.setattr(packing, "MAX_WORDS", 5)
    with open(VOCABULARY, "rb") as file:
        content = file.read()
    words = packing.WordIds(content)
    texts = [t or "" for _, t in awkward() if len(t or "") < 5000]
    for _ in range(2):
        for text in texts:
            assert encoded(words, [text]) == [library(text)]
    other = packing.WordIds(content.replace(b'"Lowercase"', b'"NFKC"', 1))
    assert not other.by_word and encoded(other, ["some words", ""]) == [library("some words"), []]


def check_layout(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("seed", range(12))
def test_patterns_place_every_rank_once(seed):
    draw = random.Random(seed)
    capacity = draw.choice([1, 7, 64, 2048])
    counts = {draw.randint(1, capacity): draw.randint(1, 300) for _ in range(draw.randint(0, 40))}
    packs, seen = {}, Counter()
    for length, first, stop, sequence, width, offset in packing.patterns(counts, capacity):
        for i in range(stop - first):
            seen[length, first + i] += 1
            packs.setdefault(sequence + i % width, []).append((offset + i // width * length, length))
    assert seen == Counter({(length, r): 1 for length, n in counts.items() for r in range(n)})
    assert sorted(packs) == list(range(len(packs)))
    for places in packs.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity


def test_patterns_go_to_the_shortest_pack_longest_first():
    # two packs of 6, then both 3s go to packs with 4 free before a 1 is placed, the last 1s fill up
    assert packing.patterns({6: 2, 3: 2, 1: 2}, 10) == [(6, 0, 2, 0, 2, 0), (3, 0, 2, 0, 2, 6), (1, 0, 2, 0, 2, 9)]
    assert packing.patterns({}, 10) == []
    with pytest.raises(ValueError):
        packing.patterns({11: 1}, 10)


@pytest.mark.parametrize("sent", [packing.MAX_SENT, 0])
def test_packed_documents_round_trip(spark, docs, library, monkeypatch, sent):
    monkeypatch.setattr(packing, "MAX_SENT", sent)
    packed = packing.pack(packing.tokenise(docs, VOCABULARY)).cache()
    rows = packed.collect()
    used = check_layout(rows, packing.CAPACITY)
    assert used <= -(-sum(r.length for r in rows) // packing.CAPACITY) + 1
    want = Counter((i, n, np.array(ids[n : n + 2048], "<u4").tobytes(), len(ids)) for i, t in awkward() for ids in [[*library(t), 1]] for n in range(0, len(ids), 2048))
    assert Counter((r.doc_id, r.start, bytes(r.ids), r.doc_tokens) for r in rows) == want
    whole = {r.sequence_id: r for r in packing.sequences(packed, pad_id=0).collect()}
    assert len(whole) == used
    for r in rows:
        s = whole[r.sequence_id]
        assert bytes(s.ids)[4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids) and len(s.ids) == 4 * 2048
        assert s.n_tokens == sum(s.lengths)


def test_packing_does_not_depend_on_the_files(spark, docs):
    some = [sorted(map(repr, packing.packed_documents(docs.repartition(n), VOCABULARY).collect())) for n in (1, 5)]
    assert some[0] == some[1]


def test_packing_of_nothing(spark, nothing):
    packed = packing.pack(packing.tokenise(nothing, VOCABULARY))
    assert packed.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    assert packed.count() == 0 and packing.sequences(packed).count() == 0


# 12: importance resampling


def plain_features(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return len(words), [zlib.crc32(f) % 10_000 for f in [*words, *(a + b" " + b for a, b in zip(words, words[1:]))]]


def plain_draw(docs, target):
    rows = [(i, *plain_features(t)) for i, t in docs]
    s, t = Counter(b for r in rows for b in r[2]), Counter(b for _, x in target for b in plain_features(x)[1])
    alls, allt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (alls + 10_000) / ((s[b] + 1) * (allt + 10_000))))
    out = []
    for i, n, found in rows:
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((o for o in out if o[4] >= 20), key=lambda o: (-o[3], o[0] is not None, o[0] or 0, o[1]))
    ranks = {}
    for place, o in enumerate(able[: 25 * len(able) // 100], 1):
        ranks.setdefault(o, []).append(place)
    return Counter((*o[:4], ranks[o].pop() if ranks.get(o) else None) for o in reversed(out))


def drawn(docs, target):
    return Counter(tuple(r) for r in importance.draw(importance.weigh(docs, target)).select("doc_id", "n_features", "weight", "score", "rank").collect())


def test_draw_matches_brute_force(spark, docs, monkeypatch):
    target = [(1, "the same text, again and gamma"), (2, None), (3, "alpha1 alpha2")]
    assert drawn(docs, make(spark, target)) == plain_draw(awkward(), target)


@pytest.mark.parametrize("block", [1, 3])
def test_blocks_of_words_lose_no_pair(monkeypatch, block):
    monkeypatch.setattr(importance, "BLOCK", block)
    monkeypatch.setattr(importance, "MATRIX", 16)
    texts = [t or "" for _, t in awkward() if len(t or "") < 2000]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    found = [Counter() for _ in texts]
    for of, buckets, _ in importance.features(data, offsets, 10_000):
        for row, bucket in zip(of.tolist(), buckets.tolist()):
            found[row][bucket] += 1
    assert found == [Counter(plain_features(t)[1]) for t in texts]


def test_crc_columns_are_crcs():
    draw = random.Random(4)
    for width in (0, 1, 5, 33):
        rows = [bytes(draw.randrange(256) for _ in range(width)) for _ in range(20)]
        matrix = np.frombuffer(b"".join(rows), np.uint8).reshape(20, width)
        assert importance.crc_columns(matrix).tolist() == [zlib.crc32(r) for r in rows]


def test_repeated_rows_are_all_drawn_in_order(spark):
    same = [(5, "word " * 30)] * 40 + [(i, "word " * 30) for i in range(10, 50)]
    assert drawn(make(spark, same), make(spark, [(1, "word")])) == plain_draw(same, [(1, "word")])


def test_draw_of_nothing(spark, nothing, docs):
    assert drawn(nothing, docs) == Counter()
    assert drawn(docs, nothing) == plain_draw(awkward(), [])
    few = make(spark, [(1, "a b c"), (2, None)])
    assert drawn(few, nothing) == plain_draw([(1, "a b c"), (2, None)], [])


def test_resample_keeps_all_columns(spark, docs):
    target = make(spark, [(1, "the same text")])
    kept = importance.resample(docs, target)
    ranks = importance.draw(importance.weigh(docs, target)).filter("rank IS NOT NULL")
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in ranks.collect()} - {None}


# 13: hard negatives

VECTORS = "vec_id long, embedding array<float>, label int, rank string, score string, vector string"


def plain_mine(rows, anchors, k=5, n=5):
    out = []
    for a, label, v in anchors:
        width = lambda x, y: sum(int(p) * int(q) for p, q in zip(x, y))
        scored = sorted(((-width(v, x), i, other == label) for i, other, x in rows if i != a))
        for s, p, _ in [s for s in scored if s[2]][:k]:
            fits = [(-t, i) for t, i, own in scored if not own and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(a, p, rank, i, -s, t) for rank, (t, i) in enumerate(fits[:n], 1)]
    return Counter(out)


def vectors(draw, n, width=24, labels=3):
    centres = [[draw.gauss(0, 1) for _ in range(width)] for _ in range(labels)]
    out = []
    for i in range(n):
        label = draw.randrange(labels)
        base = centres[draw.randrange(labels)]
        out.append((i, [c + draw.gauss(0, 0.5) for c in base], label))
    return out + [(n + i, list(out[0][1]), i % labels) for i in range(30)]


def mined(table, test="vec_id % 10 = 0", **kw):
    rows = hard_negatives.valid_rows(table)
    return Counter(tuple(r) for r in hard_negatives.mine(rows, rows.filter(test), **kw).collect())


def of(table):
    out = {}
    for i, v, label in table:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, [math.floor(256 * float(np.float32(x))) for x in v])
        out[i] = min(out.get(i, row), row)
    return [(i, *r) for i, r in out.items()]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "r", "s", "v") for r in rows], VECTORS).repartition(3)


@pytest.mark.parametrize("settings", [{}, {"ROWS": 7, "ANCHORS": 3}, {"DENSE": 0.0}, {"DENSE": 2.0}])
def test_hard_negatives_match_brute_force(spark, monkeypatch, settings):
    draw = random.Random(6)
    table = vectors(draw, 150)
    table += [(None, table[1][1], 1), (900, None, 1), (910, table[2][1], None), (920, [1.0, None], 1), (930, [float("nan")] * 24, 2), (940, [float("inf")] * 24, 2)]
    table += [table[3], table[3], (5, [0.0] * 24, 0), (950, [], 0), (951, [1.0, 2.0], 1), (960, [0.5] * 3, 2), (970, [-x for x in table[0][1]], 0)]
    rows = of(table)
    # settings are patched where tasks read them: functions travel by value with the module's own state
    for name, value in settings.items():
        monkeypatch.setattr(hard_negatives, name, value)
    pad = [(i, label, v + [0] * (24 - len(v))) for i, label, v in rows]
    assert mined(frame(spark, table)) == plain_mine(pad, [r for r in pad if r[0] % 10 == 0])
    assert mined(frame(spark, table), anchor_bytes=24 * 8 * 4) == plain_mine(pad, [r for r in pad if r[0] % 10 == 0])


def test_scores_stay_exact_beyond_doubles(spark):
    draw = random.Random(8)
    table = [(i, [draw.uniform(-1, 1) * 2.0**20 for _ in range(6)], i % 3) for i in range(60)]
    rows = of(table)
    assert mined(frame(spark, table)) == plain_mine(rows, [r for r in rows if r[0] % 10 == 0])


def test_bounds_hold_every_score():
    draw = np.random.default_rng(1)
    for width in (1, 3, 16, 50):
        a, b = draw.integers(-300, 300, (40, width)).astype(float), draw.integers(-300, 300, (50, width)).astype(float)
        score, last = a @ b.T, np.inf
        for (ma, da), (mb, db) in zip(hard_negatives.summaries(a), hard_negatives.summaries(b)):
            middle, reach = ma @ mb.T, da @ db.T
            assert (np.abs(score - middle) <= reach + 1e-6 * np.abs(score).max()).all()
            assert reach.sum() <= last + 1e-6
            last = reach.sum()


def test_negatives_of_nothing(spark):
    nothing = frame(spark, [])
    assert mined(nothing) == Counter()
    alone = frame(spark, [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 2)])
    assert mined(alone) == Counter()
    assert mined(frame(spark, [(0, [], 1), (1, [], 1), (2, [], 2)])) == Counter()
    assert hard_negatives.mine(hard_negatives.valid_rows(nothing), hard_negatives.valid_rows(nothing)).columns == [
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score",
    ]
