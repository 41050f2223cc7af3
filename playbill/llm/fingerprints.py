"""Document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes of a text; where some of its bits are zero, a chunk may end. Chunking is normalised: below the
normal size more bits must be zero than above it, so sizes gather around the normal one. Borders depend on the bytes just before
them only, so an insertion moves the chunks around it and leaves the others as they are. A fingerprint is the sorted set of chunk digests,
each with its length; the length of the chunks that two fingerprints share measures how much of a text another one contains.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playbill.llm.arrow import SLICE, hex_digest

#: bytes: no border before the least size, one at the greatest size at the latest
LEAST, NORMAL, MOST = 16, 48, 256
#: bits that must be zero below and above the normal size
STRICT_BITS, LOOSE_BITS = 7, 4
#: bytes that the hash covers; not more than the least size, so a chunk never depends on the one before it
REACH = 16
_gear = np.frombuffer(b"".join(hashlib.blake2b(bytes([i]), digest_size=4).digest() for i in range(256)), np.uint32)


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """The gear hash of the last ``REACH`` bytes at every position, by doubling the reach."""
    h = _gear[data]
    reach = 1
    while reach < REACH:
        longer = h.copy()
        longer[reach:] += h[:-reach] << np.uint32(reach)
        h, reach = longer, reach * 2
    return h


def candidates(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """End positions where a chunk may end below and above the normal size, in blocks of bounded memory."""
    strict, loose = [], []
    for at in range(0, len(data), SLICE):
        low = max(0, at - REACH)
        # the top bits of the covered bytes: bit REACH - 1 and below hold all of them
        h = rolling_hash(data[low : at + SLICE])[at - low :] & np.uint32((1 << REACH) - 1)
        ends = np.flatnonzero(h >> np.uint32(REACH - LOOSE_BITS) == 0)
        loose.append(ends + at + 1)
        strict.append(ends[h[ends] >> np.uint32(REACH - STRICT_BITS) == 0] + at + 1)
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return join(strict), join(loose)


def borders(data: np.ndarray) -> list[int]:
    """Ends of all chunks."""
    strict, loose = candidates(data)
    size, out, at = len(data), [], 0
    # for every position's wish, the next candidate: looked up with two moving pointers
    s, l, ns, nl = 0, 0, len(strict), len(loose)
    strict, loose = strict.tolist(), loose.tolist()
    while size - at > LEAST:
        first, normal = at + LEAST, at + NORMAL
        while s < ns and strict[s] < first:
            s += 1
        if s < ns and strict[s] < normal:
            at = strict[s]
        else:
            while l < nl and loose[l] < normal:
                l += 1
            at = min(loose[l] if l < nl else size, at + MOST, size)
        out.append(at)
    if at < size or not out and size:
        out.append(size)
    return out


def chunks_of(data: bytes, ends: list[int]) -> set[str]:
    """Digests with lengths, 12 and 4 hex digits."""
    out, start = set(), 0
    for end in ends:
        out.add(f"{hashlib.blake2b(data[start:end], digest_size=6).hexdigest()}{end - start:04x}")
        start = end
    return out


def pack(chunks: set[str]) -> str:
    return "".join(sorted(chunks))


def likeness(one: set[str], other: set[str]) -> float:
    """Length of the shared chunks against that of the shorter text's chunks: 1 if one contains the other, 1 for two empty texts."""
    weigh = lambda chunks: sum(int(c[12:], 16) for c in chunks)
    least = min(weigh(one), weigh(other))
    if not least:
        return float(one == other)
    return weigh(one & other) / least


def fingerprint_text(text: str) -> tuple[bytes, list[int], set[str]]:
    data = text.encode("utf-8", "replace")
    ends = borders(np.frombuffer(data, np.uint8))
    return data, ends, chunks_of(data, ends)


def fingerprint(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fingerprint`` of every whole text. Null texts are empty and have an empty fingerprint; ids may be null or repeat;
    other columns are not looked at; an empty table gives an empty table. A very long text is chunked in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [pack(fingerprint_text(t or "")[2]) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.string())], ["doc_id", "fingerprint"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, fingerprint string")


def in_order(docs: DataFrame, part_bytes: int = 8 << 20, most_parts: int = 20_000) -> DataFrame:
    """Documents by ascending id in ranges: ``range``, ``guest``, ``doc_id``, ``text``, each range in one partition and in order.

    Borders are ids at even quantiles of the table, as many as its bytes ask for. A border is an id of the table, so the rows with it
    are the first of their range, and copies of them (``guest``) end the range before. Copies of the very first rows end the last range.
    Rows with equal ids are ordered by text and rows without an id come first; nulls in the text are empty. Texts are shuffled once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    seen = rows.agg(
        F.sum(F.octet_length("text") + 32).alias("size"), F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("unnamed")
    ).first()
    parts = max(1, min(most_parts, -(-(seen["size"] or 0) // part_bytes)))
    cuts: list[int] = []
    if parts > 1:
        shares = [i / parts for i in range(1, parts)]
        cuts = sorted(set(rows.agg(F.percentile_approx("doc_id", shares, 20 * parts).alias("q")).first()["q"] or []))
    first = None if seen["unnamed"] else seen["first"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.array(cuts, np.int64)
        for batch in batches:
            ids = batch.column(0)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            values = ids.fill_null(0).to_numpy()
            at = np.where(known, np.searchsorted(bounds, values, "right"), 0)
            head = known & np.isin(values, bounds)
            lead = (~known) if first is None else known & (values == first)
            for take, where, guest in ((None, at, False), (np.flatnonzero(head), at - 1, True), (np.flatnonzero(lead), at * 0 + len(cuts), True)):
                rows_ = batch if take is None else batch.take(pa.array(take))
                where = where if take is None else where[take]
                if rows_.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(where.astype(np.int64)), pa.array(np.full(rows_.num_rows, guest)), *rows_.columns], ["range", "guest", "doc_id", "text"]
                    )

    placed = rows.mapInArrow(spread, "range long, guest boolean, doc_id long, text string")
    return placed.repartition("range").sortWithinPartitions("range", "guest", "doc_id", "text")


class _Doc:
    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text = doc_id, text
        self.data, self.ends, self.chunks = fingerprint_text(text)

    def edited(self, other: str) -> tuple[bytes, set[str]]:
        """The text whose last quarter is replaced by the beginning of another one. Chunks before the change are taken over."""
        quarter = len(self.text) // 4
        if not quarter:
            return self.data, self.chunks
        kept = self.text[: len(self.text) - quarter].encode("utf-8", "replace")
        data = kept + other[:quarter].encode("utf-8", "replace")
        ends, at = [], 0
        for end in self.ends:
            if end > len(kept) or len(data) - at <= LEAST:
                break
            ends.append(end)
            at = end
        ends += [at + e for e in borders(np.frombuffer(data, np.uint8)[at:])]
        return data, chunks_of(data, ends)


def near_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, with the likeness to that text and to the next document.

    See ``in_order`` for the order and for ties, nulls and repeated rows. A lone document is its own next one; an empty table gives an
    empty table. A task holds two documents at a time.
    """
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
    kind = pa.schema(
        [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
         ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    )

    def finish(doc: _Doc, after: _Doc) -> dict:
        data, chunks = doc.edited(after.text)
        return {
            "doc_id": doc.doc_id, "n_chars": len(doc.text), "edited_sha256": hex_digest(data), "fingerprint": pack(doc.chunks),
            "edited_fingerprint": pack(chunks), "near_edited": likeness(doc.chunks, chunks), "near_next": likeness(doc.chunks, after.chunks),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, where = None, None
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                at, guest = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if at != where:
                    last, where = None, at
                if guest and last is None:
                    continue
                doc = _Doc(batch.column(2)[i].as_py(), batch.column(3)[i].as_py())
                if last is not None:
                    out.append(finish(last, doc))
                last = None if guest else doc
                if len(out) == 256:
                    yield pa.RecordBatch.from_pylist(out, schema=kind)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=kind)

    return in_order(docs).mapInArrow(run, schema)
