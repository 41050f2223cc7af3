"""Fuzzy line dedup: of all lines that are alike, anywhere in the table, the first one stays.

Lines are compared by their normal form: A to Z in lower case, runs of white space as one space. Equal lines are one class. Classes get MinHash
signatures of their character shingles, meet in buckets of sixteen bands of four symbols (a pair at a similarity of 0.8 meets with 99.98 %,
one at 0.9 all but always), are verified by exact Jaccard similarity, and joined to components by a distributed union-find.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from playbill.llm.arrow import parts
from playbill.llm.near_links import Sketch, may_be_wanted, near_links, wanted_filter
from playbill.llm.words import fold
from playbill.operators.components import connected_components
from playbill.session import cut_lineage, release_shuffles, working_tables

#: characters of a shingle; a shorter line is one shingle
SHINGLE = 5
BANDS, ROWS = 16, 4
#: linked lines may differ in 30 of 64 symbols; at a similarity of 0.8, 12.8 do on average, and more than 30 less than once in a million times.
#: Symbols have eight bits, as a signature of every line is stored and shuffled
SKETCH = Sketch(BANDS * ROWS, tuple(tuple(range(b * ROWS, (b + 1) * ROWS)) for b in range(BANDS)), 30, 8)
#: characters that are hashed at once
GROUP = 1 << 18


def normal_line(line: str) -> bytes:
    return b" ".join(line.encode("utf-8", "replace").lower().split())


def blank(line: str) -> bool:
    """Whether the normal form is empty."""
    return not line.strip(" \t\n\x0b\x0c\r")


def digest_spots(digests: list[bytes]) -> np.ndarray:
    """What Spark's xxhash64 gives for the digests."""
    return np.array([xxhash.xxh64_intdigest(d, 42) for d in digests], np.uint64).view(np.int64)


def line_hashes(lines: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character shingles of all lines, one line after the other, and their number for each line."""
    texts = [line.decode("utf-8", "replace") for line in lines]
    lengths = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    whole = fold(points, shingle)
    owner = np.repeat(np.arange(len(texts)), lengths)
    inside = owner[: len(whole)] == owner[shingle - 1 :][: len(whole)]
    hashes, counts = whole[inside], np.maximum(lengths - shingle + 1, 0)
    short = np.flatnonzero(counts == 0)
    if len(short):
        ends = np.cumsum(lengths)
        own = [fold(points[ends[i] - lengths[i] : ends[i]], int(lengths[i])) for i in short.tolist()]
        hashes = np.insert(hashes, np.cumsum(counts)[short], np.concatenate(own))
        counts[short] = 1
    return hashes, counts


def _groups(rows: list[tuple], size: int = GROUP) -> Iterator[list[tuple]]:
    """Consecutive rows whose first entries have about ``size`` bytes together."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[0])
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def _docs(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").alias("text")
    )


def line_classes(docs: DataFrame, shingle: int) -> DataFrame:
    """One row for each distinct normal line: digest, number of lines, bytes, signature and the place of the first of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            ids, keys = batch.column(0), batch.column(1)
            rows = (
                (form, row, number)
                for row, text in enumerate(batch.column(2).to_pylist())
                for number, form in enumerate(map(normal_line, (text or "").split("\n")))
                if form
            )
            for group in _groups(rows):
                sig = SKETCH.signatures(*line_hashes([g[0] for g in group], shingle))
                at = pa.array([g[1] for g in group], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids.take(at), keys.take(at), pa.array([g[2] for g in group], pa.int64()),
                     pa.array([hashlib.md5(g[0]).digest() for g in group], pa.binary()), pa.array([len(g[0]) for g in group], pa.int64()),
                     pa.array([s.tobytes() for s in sig], pa.binary())],
                    ["doc_id", "text_key", "line", "digest", "bytes", "sig"],
                )

    lines = _docs(docs).mapInArrow(run, "doc_id long, text_key long, line long, digest binary, bytes long, sig binary")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key", "line")
    return lines.groupBy("digest").agg(F.min(place).alias("place"), F.count("*").alias("lines"), F.first("bytes").alias("bytes"), F.first("sig").alias("sig"))


def _fates(docs: DataFrame, shingle: int, share: int) -> DataFrame:
    """``digest`` and ``root``, the place of the line that stays, of every line that is there twice or linked with another."""
    classes = cut_lineage(line_classes(docs, shingle).withColumn("id", F.monotonically_increasing_id()))  # stored, so the ids stay
    release_shuffles(docs.sparkSession)

    def sets_of(ids: DataFrame) -> DataFrame:
        spots = classes.select("id", "digest", F.xxhash64("digest").alias("spot"), "place.text_key")
        wanted = cut_lineage(spots.join(ids, "id", "left_semi"))
        bits, texts = wanted_filter(wanted, "spot"), wanted_filter(wanted, "text_key")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(pa.array(may_be_wanted(texts.value, batch.column(0).to_numpy())))
                forms = list({f for text in batch.column(1).to_pylist() for f in map(normal_line, (text or "").split("\n")) if f})
                digests = [hashlib.md5(f).digest() for f in forms]
                at = np.flatnonzero(may_be_wanted(bits.value, digest_spots(digests))).tolist()
                arrays = [pa.array([digests[i] for i in at], pa.binary()), pa.array([forms[i] for i in at], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["digest", "members"])

        found = _docs(docs).select("text_key", "text").mapInArrow(run, "digest binary, members binary")
        found = found.groupBy("digest").agg(F.first("members").alias("members"))
        return found.join(wanted, "digest").select("id", "members")

    items = classes.select("id", F.lit(1).cast("long").alias("n"), "bytes", "sig")
    links = near_links(items, SKETCH, sets_of, share, lambda lines: line_hashes(lines, shingle))
    labels = cut_lineage(connected_components(links, "a", "b").select(F.col("node").alias("id"), "label"))
    roots = classes.join(labels, "id").groupBy("label").agg(F.min("place").alias("root"))
    linked = labels.join(roots, "label").select("id", "root")
    fates = classes.join(linked, "id", "left").filter("lines > 1 or root is not null")
    return fates.select("digest", F.coalesce("root", "place").alias("root"))


def dropped_lines(docs: DataFrame, shingle: int = SHINGLE, share: int = 80) -> DataFrame:
    """``doc_id``, ``text_key`` and the numbers of the lines that go (``lines``), for every document that loses any."""
    with working_tables(docs.sparkSession):
        fates = cut_lineage(_fates(docs, shingle, share), outlive=True)
    release_shuffles(docs.sparkSession)
    bits = wanted_filter(fates.select(F.xxhash64("digest").alias("spot")), "spot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            forms = [
                (form, row, number)
                for row, text in enumerate(batch.column(2).to_pylist())
                for number, form in enumerate(map(normal_line, (text or "").split("\n")))
                if form
            ]
            digests = [hashlib.md5(f[0]).digest() for f in forms]
            some = np.flatnonzero(may_be_wanted(bits.value, digest_spots(digests))).tolist()
            at = pa.array([forms[i][1] for i in some], pa.int64())
            arrays = [batch.column(0).take(at), batch.column(1).take(at), pa.array([forms[i][2] for i in some], pa.int64())]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([digests[i] for i in some], pa.binary())], ["doc_id", "text_key", "line", "digest"])

    lines = _docs(docs).mapInArrow(run, "doc_id long, text_key long, line long, digest binary")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key", "line")
    gone = lines.join(fates, "digest").filter(~place.eqNullSafe(F.col("root")))
    return gone.groupBy("doc_id", "text_key").agg(F.collect_set("line").alias("lines"))


def drop_lines(docs: DataFrame, shingle: int = SHINGLE, share: int = 80) -> DataFrame:
    """``row`` with the columns of ``docs`` and the remaining ``text``, ``n_lines`` (not blank) and ``n_kept``.

    Lines end at line feeds. Blank lines are never compared and stay. The first line of a component, by id, text hash and line number,
    stays; rows without an id come last. A repeated row (same id and text) keeps no line after its first occurrence. Null texts stay null
    and have no lines; other columns pass through; an empty table gives an empty table.
    """
    id_key = F.xxhash64(F.col("doc_id").cast("long")).alias("id_key")
    gone = dropped_lines(docs, shingle, share).select(id_key, "text_key", "lines")
    packed = docs.select(F.struct("*").alias("row"), id_key, F.xxhash64(F.col("text").cast("string")).alias("text_key"))
    met = packed.join(gone, ["id_key", "text_key"], "left")
    again = F.row_number().over(Window.partitionBy("id_key", "text_key").orderBy(F.lit(0))) > 1
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            both = batch.column(0)
            row = both.field("row")
            texts, counts, kept = [], [], []
            for text, lines, repeat in zip(row.field(at).to_pylist(), both.field("lines").to_pylist(), both.field("again").to_pylist()):
                gone = set(lines or ())
                split = (text or "").split("\n")
                full = [not blank(p) for p in split]
                stay = [not f or not (repeat or i in gone) for i, f in enumerate(full)]
                texts.append(text if all(stay) else "\n".join(p for p, s in zip(split, stay) if s))
                counts.append(sum(full))
                kept.append(sum(f and s for f, s in zip(full, stay)))
            fields = [row.field(i) for i in range(row.type.num_fields)]
            fields[at] = pa.array(texts, row.type.field(at).type)
            new = pa.StructArray.from_arrays(fields, fields=[row.type.field(i) for i in range(row.type.num_fields)])
            yield pa.RecordBatch.from_arrays([new, pa.array(counts, pa.int64()), pa.array(kept, pa.int64())], ["row", "n_lines", "n_kept"])

    schema = T.StructType().add("row", packed.schema["row"].dataType).add("n_lines", T.LongType()).add("n_kept", T.LongType())
    return met.select(F.struct("row", "lines", again.alias("again")).alias("both")).mapInArrow(run, schema)


def keep_first_lines(docs: DataFrame, shingle: int = SHINGLE, share: int = 80) -> DataFrame:
    """The documents with their remaining lines. A document that had lines and lost all of them goes."""
    return drop_lines(docs, shingle, share).filter("n_lines = 0 or n_kept > 0").select("row.*")


def line_report(docs: DataFrame, shingle: int = SHINGLE, share: int = 80) -> DataFrame:
    """Per row: lines, kept lines, and the digest of the remaining text."""
    found = drop_lines(docs.select("doc_id", "text"), shingle, share)
    return found.select("row.doc_id", "n_lines", "n_kept", F.sha2(F.coalesce("row.text", F.lit("")), 256).alias("kept_sha256"))
