"""Packing of tokenised documents into training sequences, shortest pack first over the histogram of lengths.

A document is cut only where it is longer than a sequence. The pieces' lengths are counted, and the histogram alone is packed: lengths go
longest first into the group of packs that is shortest so far, a whole group at a time. What comes out is a short list of patterns saying
which ranks of which length lie in which packs at which offset. Pieces get a rank among those of their length and meet the patterns by it.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer, pre_tokenizers

from playbill.llm.arrow import hex_digest, parts, slices, text_bytes, worker_cache
from playbill.llm.words import LOWER, SPACE_WORDS, find_words, spread
from playbill.session import cut_lineage

CAPACITY = 2048
END_ID = 1
#: most bytes of a vocabulary file that is sent to the executors
MAX_FILE = 64 << 20
#: a worker remembers the ids of two generations of so many keys of at most so many bytes
MAX_WORDS, MAX_WORD = 400_000, 64
#: ranks of one length are dealt out in parts of about so many pieces, in at least so many parts
PART_ROWS, LEAST_PARTS = 100_000, 1024
#: patterns are broadcast up to this number (48 bytes each); more of them are joined like any table
MAX_SENT = 500_000
#: fixed values: the rules of a vocabulary whose words stand alone
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
RULES = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: kinds of bytes: white space, letters, digits, signs, and those that leave their word whole
_SPACE, _LETTER, _DIGIT, _SIGN, _ODD = range(5)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[0x21:0x7F] = _SIGN
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
_KIND[~SPACE_WORDS] = _SPACE
_KIND[[ord("'"), ord("<")]] = _ODD
#: characters U+00C0 to U+023F are letters in two bytes, with normal forms and one lower-case letter each, but for these
_NO_LETTER = ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0))
_PLAIN = re.compile(rb"(?:[a-z]|[\xc3-\xc8][\x80-\xbf](?<!\xc3[\x97\xb7])(?<!\xc4\xb0))+|[0-9]|[!-&(-/:;=-@\[-`{-~]+").fullmatch
#: texts are taken in blocks of about so many bytes
BLOCK = 1 << 21
PATTERNS = "length long, first_rank long, stop_rank long, first_sequence long, width long, first_offset long"


class WordIds:
    """Ids of texts, as little-endian 32-bit integers.

    The rules of a vocabulary with ``RULES`` drop white space and never look across it, so a text's ids are those of its words in a row. Plain Latin
    words are cut into the pieces of the rules by array operations, which makes far fewer different keys than words; every other word is a key as a
    whole. The library gives the ids of each key once. Vocabularies with other rules have whole texts encoded by the library.
    """

    def __init__(self, content: bytes):
        self.whole = Tokenizer.from_buffer(content)
        self.whole.encode_special_tokens = True
        rules = json.loads(content)
        self.by_word = rules["normalizer"] == RULES["normalizer"] and rules["pre_tokenizer"] == RULES["pre_tokenizer"]
        self.bare = Tokenizer(self.whole.model)
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)
        self.keys: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}  # keys of the generation before

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Ids of each row of UTF-8 bytes."""
        if not self.by_word:
            return [self._ids(data[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        out = []
        for a, b in slices(offsets, BLOCK):
            if offsets[b] - offsets[a] > BLOCK:  # a long row, cut where the words end
                out.append(b"".join(x for c, d in _long(data, offsets[a], offsets[b]) for x in self._rows(data[c:d], np.array([0, d - c]))))
            else:
                out += self._rows(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        return out

    def _rows(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        flat, starts, ends, firsts = _keys(data, offsets)
        lengths = ends - starts
        places = np.append(0, np.cumsum(lengths))
        texts = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(flat)]).dictionary_encode()
        found = self._look_up(texts.dictionary.to_pylist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first = np.cumsum(sizes) - sizes
        key = texts.indices.to_numpy()
        every = np.frombuffer(b"".join(found), "<u4")[spread(first[key], sizes[key])]
        cuts = np.append(0, np.cumsum(sizes[key]))[firsts].tolist()
        return [every[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]

    def _look_up(self, keys: list[bytes]) -> list[bytes]:
        if len(self.keys) > MAX_WORDS:
            self.keys, self.before = {}, self.keys
        out = list(map(self.keys.get, keys))
        plain = []
        for n, ids in enumerate(out):
            if ids is None:
                key = keys[n]
                if (old := self.before.get(key)) is not None:
                    self.keys[key] = out[n] = old
                elif len(key) <= MAX_WORD and _PLAIN(key):
                    plain.append(n)
                else:
                    out[n] = self._ids(key)
                    if len(key) <= MAX_WORD:
                        self.keys[key] = out[n]
        for n, found in zip(plain, self.bare.encode_batch_fast([keys[n].decode().lower() for n in plain], add_special_tokens=False)):
            ids = found.ids
            self.keys[keys[n]] = out[n] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def _ids(self, text: bytes) -> bytes:
        return np.array(self.whole.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()


def _keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words without white space, start and end of every key, and the number of keys before each row.

    Words of Latin letters, ASCII digits and signs are lower-cased in A-Z and cut into runs of letters, single digits and runs of signs. A word with an
    apostrophe, a sign of added tokens, a control character or any other character stands whole and unchanged.
    """
    starts, ends, firsts = find_words(data, offsets, SPACE_WORDS)
    kind = _KIND[data]
    after = np.append(data[1:], np.uint8(0))
    latin = (data >= 0xC3) & (data <= 0xC8) & (after & 0xC0 == 0x80)
    for lead, last in _NO_LETTER:
        latin &= (data != lead) | (after != last)
    kind[latin] = _LETTER
    kind[1:][latin[:-1]] = _LETTER
    odd = np.append(0, np.cumsum(kind == _ODD))
    whole = odd[ends] > odd[starts]
    change = np.zeros(len(data) + 1, np.int8)
    change[starts[whole]] += 1
    change[ends[whole]] -= 1
    kind[np.cumsum(change[:-1], dtype=np.int8) > 0] = _ODD
    lowered = np.where(kind == _ODD, data, LOWER[data])
    inside = kind != _SPACE
    begins = np.zeros(len(data), bool)
    begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    begins[starts] = True
    begins &= inside
    at = np.flatnonzero(begins)
    before = np.append(0, np.cumsum(inside))
    begin = before[at]
    return lowered[inside], begin, np.append(begin[1:], before[-1])[: len(begin)], np.searchsorted(at, offsets, "left")


def _long(data: np.ndarray, start: int, stop: int) -> Iterator[tuple[int, int]]:
    """A long row in blocks that end with a word; a word is never cut, whatever its length."""
    spaces = start + np.flatnonzero(~SPACE_WORDS[data[start:stop]])
    while start < stop:
        end = stop
        if stop - start > BLOCK:
            n = int(np.searchsorted(spaces, start + BLOCK, "right"))
            near = spaces[n - 1] if n and spaces[n - 1] > start else (spaces[n] if n < len(spaces) else stop)
            end = int(near) if near < stop else stop
        yield start, end
        start = end


def _load(content: bytes) -> WordIds:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    held, key = worker_cache(), hex_digest(content)
    if held.get("packing_key") != key:
        held["packing_words"], held["packing_key"] = WordIds(content), key
    return held["packing_words"]


def tokenise(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all texts: ``doc_id``, ``start`` (ids of the document before it), ``length``, ``ids`` (binary, little-endian unsigned
    32-bit integers) and ``doc_tokens``. A document's ids end with ``end_id``; it is cut after every ``capacity`` ids.

    A null text is empty and an empty text has the end id alone; null ids and repeated rows are cut like any other row; bytes that are no
    UTF-8 read as replacement characters; other columns are not looked at; an empty table gives an empty table. A task holds the ids of 1,024 texts.
    """
    with open(vocabulary, "rb") as file:
        content = file.read(MAX_FILE + 1)
    if len(content) > MAX_FILE:
        raise ValueError("the vocabulary file is too large to broadcast")
    shipped = docs.sparkSession.sparkContext.broadcast(content)
    end, most = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _load(shipped.value)
        for part in parts(batches, 1024):
            keys, starts, cuts, totals = [], [], [], []
            for row, ids in enumerate(words.encode(*text_bytes(part.column(1)))):
                ids += end
                for at in range(0, len(ids), most):
                    keys.append(row)
                    starts.append(at // 4)
                    cuts.append(ids[at : at + most])
                    totals.append(len(ids) // 4)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(keys, pa.int64())), pa.array(starts, pa.int64()), pa.array([len(x) // 4 for x in cuts], pa.int64()),
                    pa.array(cuts, pa.binary()), pa.array(totals, pa.int64()),
                ],
                ["doc_id", "start", "length", "ids", "doc_tokens"],
            )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return plain.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long")


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of a histogram go: (length, first rank, rank after the last, first sequence, width, first offset).

    Rank ``first + i`` lies in sequence ``first_sequence + i % width`` at ``first_offset + (i // width) * length``. New packs are opened
    only where no pack has room, and not more than all tokens still to come need beside the room there is.
    """
    groups: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # (first sequence, number of packs) by room left
    left, room, packs = sum(length * n for length, n in counts.items()), 0, 0
    out: list[tuple[int, int, int, int, int, int]] = []
    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit a sequence of {capacity}")
        waiting, rank, top = counts[length], 0, capacity
        while waiting:
            while top >= length and not groups[top]:
                top -= 1
            if top < length:
                fresh = min(waiting, max(1, -(-(left - room) // capacity)))
                groups[capacity].append((packs, fresh))
                packs, room, top = packs + fresh, room + fresh * capacity, capacity
            first, width = groups[top].pop()
            n = min(waiting, width)
            if n < width:
                groups[top].append((first + n, width - n))
            groups[top - length].append((first, n))
            at = capacity - top
            if out and out[-1][0] == length and out[-1][3:5] == (first, n) and at == out[-1][5] + (rank - out[-1][1]) // n * length:
                out[-1] = (length, out[-1][1], rank + n, first, n, out[-1][5])
            else:
                out.append((length, rank, rank + n, first, n, at))
            waiting, rank, left, room = waiting - n, rank + n, left - n * length, room - n * length
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, keys: Iterable[str] = ("doc_id", "start")) -> DataFrame:
    """All rows of ``pieces`` with ``sequence_id`` (gapless from 0) and ``offset`` of their first token there.

    ``length`` says how many tokens a row stands for, 1 to ``capacity``; it may not be null. All other columns come along. Rows of one length
    are ranked by ``keys`` and then by their other plain columns, so the layout does not depend on how the table is stored; rows that are equal
    in all of that are interchangeable. An empty table gives an empty table. The driver holds one count for each length; a very common length
    is ranked in many parts. Names that begin with ``pack_`` are taken.
    """
    spark, keys = pieces.sparkSession, list(keys)
    plain = [c for c, kind in pieces.dtypes if c not in (*keys, "length") and not kind.startswith(("array", "map", "struct", "variant"))]
    stored = cut_lineage(pieces)
    rows = stored.count()
    many = max(LEAST_PARTS, rows // PART_ROWS)
    stored = stored.withColumn("pack_part", F.pmod(F.xxhash64(*keys, *plain), F.lit(many)).cast("long"))
    counts = cut_lineage(stored.groupBy("length", "pack_part").agg(F.count("*").alias("pack_n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("pack_n").alias("n")).collect()}
    placed = spark.createDataFrame(patterns(histogram, capacity), PATTERNS).withColumnRenamed("length", "pack_length")
    if placed.count() <= MAX_SENT:
        placed = F.broadcast(placed)
    earlier = Window.partitionBy("length").orderBy("pack_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "pack_part", F.coalesce(F.sum("pack_n").over(earlier), F.lit(0)).alias("pack_before"))
    order = Window.partitionBy("length", "pack_part").orderBy(*keys, *plain)
    ranked = stored.withColumn("pack_nth", F.row_number().over(order) - 1).join(before, ["length", "pack_part"])
    ranked = ranked.withColumn("pack_rank", F.col("pack_before") + F.col("pack_nth"))
    hit = (F.col("length") == F.col("pack_length")) & (F.col("pack_rank") >= F.col("first_rank")) & (F.col("pack_rank") < F.col("stop_rank"))
    nth = F.col("pack_rank") - F.col("first_rank")
    return ranked.join(placed, hit).select(
        *pieces.columns,
        (F.col("first_sequence") + nth % F.col("width")).alias("sequence_id"),
        (F.col("first_offset") + F.floor(nth / F.col("width")) * F.col("length")).cast("long").alias("offset"),
    )


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int | None = None) -> DataFrame:
    """The training sequences: ``sequence_id``, ``ids`` (binary, as in the pieces), ``n_tokens`` and ``lengths`` of the pieces in order.

    ``packed`` is the result of ``pack`` with ``ids``. With ``pad_id`` every sequence is filled up to ``capacity`` ids. A sequence is built in one
    group, which holds ``capacity`` ids at most. An empty table gives an empty table; a null ``ids`` counts as none.
    """
    rows = packed.select("sequence_id", F.struct("offset", "length", F.coalesce("ids", F.lit(b"")).alias("ids")).alias("piece"))
    ordered = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    ids = F.aggregate("pieces", F.lit(b""), lambda done, piece: F.concat(done, piece["ids"]))
    out = ordered.select("sequence_id", ids.alias("ids"), F.col("pieces.length").alias("lengths"))
    out = out.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))
    if pad_id is not None:
        out = out.withColumn("ids", F.rpad("ids", F.lit(4 * capacity), F.lit(np.array([pad_id], "<u4").tobytes())))
    return out.select("sequence_id", "ids", "n_tokens", "lengths")


def packed_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """All documents packed, without texts and ids: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``."""
    pieces = tokenise(docs, vocabulary)
    return pack(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"))
