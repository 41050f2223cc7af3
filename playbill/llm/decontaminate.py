"""Benchmark decontamination: document words inside an occurrence of a benchmark window are hits.

The hashes of all benchmark windows travel to the workers as one sorted array. A document is scanned window by window; a hash that
is found there counts only if the words themselves are equal. Documents are never shuffled. The size of the benchmark is checked
first: one that is too large to be sent to every worker is joined with the document windows by hash instead, with equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playbill.llm.arrow import hex_digest, slices, text_bytes
from playbill.llm.words import LOWER, PLAIN_WORDS, find_words, fold, span_hashes

WINDOW = 13
#: bytes of benchmark text that may be broadcast; a larger benchmark is joined
BROADCAST_BYTES = 8 << 20
FOUND = (
    T.StructType().add("n_words", T.LongType()).add("n_hit", T.LongType())
    .add("hits", T.ArrayType(T.ArrayType(T.LongType()))).add("items", T.ArrayType(T.LongType()))
)
ARROW_FOUND = pa.struct(
    [("n_words", pa.int64()), ("n_hit", pa.int64()), ("hits", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.int64()))]
)


class Windows:
    """The windows of some items, found by hash."""

    def __init__(self, items: list[tuple[int | None, str]], window: int):
        self.items = [i for i, _ in items]
        raw = [(t or "").encode() for _, t in items]
        offsets = np.cumsum([0, *map(len, raw)])
        data = LOWER[np.frombuffer(b"".join(raw), np.uint8)]
        starts, ends, firsts = find_words(data, offsets, PLAIN_WORDS)
        hashes = span_hashes(data, starts, ends)
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        whole = fold(hashes, window)
        for item, (a, b) in enumerate(zip(firsts[:-1].tolist(), firsts[1:].tolist())):
            width = min(window, b - a)
            if width:
                windows = whole[a : b - window + 1] if width == window else fold(hashes[a:b], width)
                found.setdefault(width, []).append((windows, np.stack([np.full(len(windows), item), np.arange(a, a + len(windows))])))
        #: by width: sorted hashes, and for each the item and its first word
        self.windows = {}
        for width, parts in found.items():
            h, at = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts], axis=1)
            order = np.argsort(h, kind="stable")
            self.windows[width] = (h[order], at[0][order], at[1][order])
        self.data, self.starts, self.ends = data, starts, ends

    def words(self, first: int, width: int) -> list[bytes]:
        return [self.data[s:e].tobytes() for s, e in zip(self.starts[first : first + width].tolist(), self.ends[first : first + width].tolist())]

    def scan(self, hashes: np.ndarray, rows: np.ndarray, word) -> Iterator[tuple[int, int, int]]:
        """First word, width and item of every verified window. ``rows`` names the document of each word."""
        for width, (keys, item, first) in self.windows.items():
            if len(hashes) < width:
                continue
            probe = fold(hashes, width)
            slot = np.minimum(np.searchsorted(keys, probe), len(keys) - 1)
            hit = np.flatnonzero((keys[slot] == probe) & (rows[: len(probe)] == rows[width - 1 :]))
            for at in hit.tolist():
                k = int(slot[at])
                wanted = None
                while k < len(keys) and keys[k] == probe[at]:
                    wanted = wanted or [word(at + j) for j in range(width)]
                    if self.words(int(first[k]), width) == wanted:
                        yield at, width, int(item[k])
                    k += 1


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    return merged


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``row`` with the columns of ``docs`` and ``found``: words, hit words, merged hit ranges of bytes, and the items found.

    Words are lower-cased runs of letters, digits and non-ASCII characters. An item with fewer than ``window`` words is one window,
    one without words is never found. Null texts have no words; null ids stay null; repeated documents are scanned like others,
    repeated items count once by id; empty tables give no hits or no rows; other columns pass through.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    size = items.select(F.sum(F.octet_length("text") + 64).alias("n")).first()["n"] or 0
    if size > broadcast_bytes:
        return _joined(docs, items, window)
    shipped = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in items.collect()])

    def each(column: pa.Array, windows: Windows) -> Iterator[dict]:
        data_all, offsets_all = text_bytes(column)
        for lo, hi in slices(offsets_all):
            offsets = offsets_all[lo : hi + 1] - offsets_all[lo]
            data = LOWER[data_all[offsets_all[lo] : offsets_all[hi]]]
            starts, ends, firsts = find_words(data, offsets, PLAIN_WORDS)
            hashes = span_hashes(data, starts, ends)
            counts = np.diff(firsts)
            rows = np.repeat(np.arange(hi - lo), counts)
            word = lambda k: data[starts[k] : ends[k]].tobytes()
            spans: dict[int, list[tuple[int, int]]] = {}
            named: dict[int, set] = {}
            for at, width, item in windows.scan(hashes, rows, word):
                row = int(rows[at])
                spans.setdefault(row, []).append((at, at + width))
                named.setdefault(row, set()).add(windows.items[item])
            for row in range(hi - lo):
                if row not in spans:
                    yield {"n_words": int(counts[row]), "n_hit": 0, "hits": [], "items": []}
                    continue
                merged = _merged(spans[row])
                yield {
                    "n_words": int(counts[row]),
                    "n_hit": sum(b - a for a, b in merged),
                    "hits": [[int(starts[a] - offsets[row]), int(ends[b - 1] - offsets[row])] for a, b in merged],
                    "items": list(named[row]),
                }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(shipped.value, window)
        for batch in batches:
            if batch.num_rows:
                found = pa.array(list(each(batch.column(0).field("text"), windows)), ARROW_FOUND)
                yield pa.RecordBatch.from_arrays([batch.column(0).field("row"), found], ["row", "found"])

    packed = docs.select(F.struct(F.struct("*").alias("row"), F.col("text").cast("string").alias("text")).alias("both"))
    row = packed.schema["both"].dataType["row"].dataType
    return packed.mapInArrow(run, T.StructType().add("row", row).add("found", FOUND))


def _windows(texts: DataFrame, keys: list[str], widths: list[int], window: int | None) -> DataFrame:
    """``keys``, hash, width, first word, its byte range and the words of every window; ``window`` given: one width per text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data_all, offsets_all = text_bytes(batch.column(len(keys)))
            for lo, hi in slices(offsets_all):
                offsets = offsets_all[lo : hi + 1] - offsets_all[lo]
                data = LOWER[data_all[offsets_all[lo] : offsets_all[hi]]]
                starts, ends, firsts = find_words(data, offsets, PLAIN_WORDS)
                hashes = span_hashes(data, starts, ends)
                for row in range(hi - lo):
                    a, b = int(firsts[row]), int(firsts[row + 1])
                    for width in widths if window is None else [min(window, b - a)]:
                        probe = fold(hashes[a:b], width) if width else ()
                        if not len(probe):
                            continue
                        at = np.arange(a, a + len(probe))
                        words = [b" ".join(data[starts[k + j] : ends[k + j]].tobytes() for j in range(width)) for k in at.tolist()]
                        same = [batch.column(c).take(pa.array(np.full(len(at), lo + row))) for c in range(len(keys))]
                        yield pa.RecordBatch.from_arrays(
                            [*same, pa.array(probe.view(np.int64)), pa.array(np.full(len(at), width)), pa.array(at - a),
                             pa.array(starts[at] - offsets[row]), pa.array(ends[at + width - 1] - offsets[row]), pa.array(words, pa.binary())],
                            [*keys, "hash", "width", "first", "start", "end", "words"],
                        )

    schema = T.StructType([texts.schema[k] for k in keys])
    for name in ("hash", "width", "first", "start", "end"):
        schema = schema.add(name, T.LongType())
    return texts.select(*keys, "text").mapInArrow(run, schema.add("words", T.BinaryType()))


def _joined(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """``find_hits`` by a join of windows. Hits depend on the text only, so equal texts share them."""
    wanted = _windows(items, ["item_id"], [], window).select("hash", "width", "words", "item_id").distinct()
    widths = sorted(r["width"] for r in wanted.select("width").distinct().collect())
    packed = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    packed = packed.withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256))
    texts = packed.groupBy("key").agg(F.first(F.coalesce("text", F.lit(""))).alias("text"))
    hits = _windows(texts, ["key"], widths, None).join(wanted, ["hash", "width", "words"])
    spans = hits.groupBy("key").agg(
        F.array_sort(F.collect_set(F.array("first", F.col("first") + F.col("width"), "start", "end"))).alias("spans"),
        F.collect_set("item_id").alias("items"), F.max(F.col("item_id").isNull()).alias("unnamed"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(0).field("text"))
            counts = np.diff(find_words(LOWER[data], offsets, PLAIN_WORDS)[2]).tolist()
            found = []
            for n, spans, items, unnamed in zip(counts, *(batch.column(0).field(k).to_pylist() for k in ("spans", "items", "unnamed"))):
                words = _merged([(s[0], s[1]) for s in spans or []])
                starts, ends = {s[0]: s[2] for s in spans or []}, {s[1]: s[3] for s in spans or []}
                names = [*(items or []), *([None] if unnamed else [])]
                found.append({"n_words": n, "n_hit": sum(b - a for a, b in words), "hits": [[starts[a], ends[b]] for a, b in words], "items": names})
            yield pa.RecordBatch.from_arrays([batch.column(0).field("row"), pa.array(found, ARROW_FOUND)], ["row", "found"])

    both = packed.join(spans, "key", "left").select(F.struct("row", "text", "spans", "items", "unnamed").alias("both"))
    return both.mapInArrow(run, T.StructType().add("row", packed.schema["row"].dataType).add("found", FOUND))


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """Per document: words, hit words, items found and whether it is contaminated (one hit word in ``share`` or more)."""
    found = find_hits(docs.select("doc_id", "text"), benchmark, window).select("row.doc_id", "found.*")
    ids = F.array_sort(F.transform(F.filter("items", lambda i: i.isNotNull()), lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), contaminated(share).alias("contaminated"),
    )


def contaminated(share: int, prefix: str = ""):
    n_hit = F.col(f"{prefix}n_hit")
    return (n_hit > 0) & (share * n_hit >= F.col(f"{prefix}n_words"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """Documents that are not contaminated, with all their columns."""
    return find_hits(docs, benchmark, window).filter(~contaminated(share, "found.")).select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """All documents with the hit passages cut out of ``text``. Texts without hits are unchanged."""
    found = find_hits(docs, benchmark, window)
    cut = F.expr(
        """decode(aggregate(found.hits, named_struct('at', 0L, 'kept', cast('' as binary)),
             (s, h) -> named_struct('at', h[1], 'kept', concat(s.kept, substring(cast(row.text as binary), cast(s.at + 1 as int), cast(h[0] - s.at as int)))),
             s -> concat(s.kept, substring(cast(row.text as binary), cast(s.at + 1 as int), octet_length(row.text)))), 'UTF-8')"""
    )
    text = F.when(F.size("found.hits") > 0, cut).otherwise(F.col("row.text"))
    return found.select(*[(text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
