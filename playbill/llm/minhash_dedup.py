"""MinHash near-duplicates by a multi-index Hamming join.

Signatures have 40 symbols of 16 bits in ten chunks of four. Two documents are candidates if their signatures differ in at most 19
symbols. Then, by the pigeonhole principle, some chunk differs in at most one symbol, so a document is put into one bucket for every
chunk and every symbol of it that may be wrong: all pairs within the distance meet. At a similarity of 0.8 a pair lies beyond it about once
in a hundred thousand times. Candidates are confirmed on their full shingle sets. Documents with equal sets are one class from the start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playbill.llm.arrow import slices, text_bytes
from playbill.llm.near_links import Sketch, may_be_wanted, near_links, wanted_filter
from playbill.llm.words import shingle_sets
from playbill.operators.components import connected_components
from playbill.session import cut_lineage

CHUNKS, CHUNK = 10, 4
SKETCH = Sketch(
    CHUNKS * CHUNK,
    tuple(tuple(c * CHUNK + j for j in range(CHUNK) if j != wrong) for c in range(CHUNKS) for wrong in range(CHUNK)),
    2 * CHUNKS - 1,
)


def _sets(batch_texts: pa.Array, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    data, offsets = text_bytes(batch_texts)
    for lo, hi in slices(offsets):
        yield lo, shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width)


def _digest(members: np.ndarray) -> bytes | None:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest() if len(members) else None


def document_sets(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id``, ``text_key``, set size ``n``, set digest (null: no words) and signature of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, sets in _sets(batch.column(2), width):
                counts = np.array([len(s) for s in sets], np.int64)
                sig = SKETCH.signatures(np.concatenate(sets), counts)
                part = batch.slice(lo, len(sets))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(counts), pa.array([_digest(s) for s in sets], pa.binary()),
                     pa.array([row.tobytes() for row in sig], pa.binary())],
                    ["doc_id", "text_key", "n", "digest", "sig"],
                )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key(), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, text_key long, n long, digest binary, sig binary")


def _text_key():
    return F.xxhash64(F.col("text").cast("string")).alias("text_key")


def components(docs: DataFrame, width: int, share: int = 80) -> DataFrame:
    """``doc_id``, ``text_key``, ``n_shingles``, ``component_id``, ``kept`` and ``chosen`` of every row.

    Words are runs of characters other than ASCII white space, lower-cased from A to Z; a set holds the distinct runs of ``width`` words,
    or the one run of all words if they are fewer. Rows are linked if their sets have 100 * intersection >= ``share`` * union; a component
    is named by its smallest id. Texts without words (null, empty, white space) are linked with nothing. Rows without an id take
    part, and are not kept if their component has an id; repeated rows are one class, and all of them are kept or not. ``chosen`` is
    stricter: of several texts with the smallest id, the one with the smallest hash. Other columns are not looked at; an empty table
    gives an empty table.
    """
    rows = cut_lineage(document_sets(docs, width))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    grouped = rows.filter("n > 0").groupBy("digest").agg(F.min(place).alias("place"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = cut_lineage(grouped.withColumn("id", F.monotonically_increasing_id()))  # stored, so the ids stay

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = cut_lineage(classes.select("id", "digest", F.xxhash64("place.doc_id").alias("spot")).join(ids, "id", "left_semi"))
        bits = wanted_filter(wanted, "spot")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(pa.array(may_be_wanted(bits.value, batch.column(0).to_numpy())))
                if batch.num_rows:
                    for _, sets in _sets(batch.column(1), width):
                        arrays = [pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
                        yield pa.RecordBatch.from_arrays(arrays, ["digest", "members"])

        texts = docs.select(F.xxhash64(F.col("doc_id").cast("long")).alias("spot"), F.col("text").cast("string").alias("text"))
        found = texts.mapInArrow(run, "digest binary, members binary").groupBy("digest").agg(F.first("members").alias("members"))
        return found.join(wanted, "digest").select("id", "members")

    links = near_links(classes.select("id", "n", (8 * F.col("n")).alias("bytes"), "sig"), SKETCH, sets_of, share)
    labels = cut_lineage(connected_components(links, "a", "b").select(F.col("node").alias("id"), "label"))
    roots = classes.join(labels, "id").groupBy("label").agg(F.min("place").alias("root"))
    linked = labels.join(roots, "label").select("id", F.col("root"))
    named = classes.join(linked, "id", "left").select("digest", F.coalesce("root", "place").alias("root"))
    out = rows.join(named, "digest", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("root.doc_id")).otherwise(F.col("doc_id")))
    same = F.col("doc_id").eqNullSafe(F.col("root.doc_id")) & (F.col("text_key") == F.col("root.text_key"))
    return out.select(
        "doc_id", "text_key", F.col("n").alias("n_shingles"), "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"),
        ((F.col("n") == 0) | same).alias("chosen"),
    )


def near_duplicates(docs: DataFrame, width: int = 5, share: int = 80) -> DataFrame:
    """``components`` without what tells texts of one id apart."""
    return components(docs, width, share).drop("text_key", "chosen")


def keep_one(docs: DataFrame, width: int = 5, share: int = 80) -> DataFrame:
    """One row of each component, with all columns of ``docs``; rows without words all stay.

    It is the row with the smallest id. Of several rows with that id, one of those with the smallest text hash stays.
    """
    found = components(docs, width, share).filter("chosen")
    keys = found.groupBy("doc_id", "text_key").agg(F.max(F.col("n_shingles") == 0).alias("all"))
    id_key = F.xxhash64(F.col("doc_id").cast("long")).alias("id_key")
    packed = docs.select(F.struct("*").alias("row"), id_key, _text_key())
    met = packed.join(keys.select(id_key, "text_key", "all"), ["id_key", "text_key"])
    nth = F.row_number().over(Window.partitionBy("id_key", "text_key").orderBy(F.lit(0)))
    return met.withColumn("nth", nth).filter(F.col("all") | (F.col("nth") == 1)).select("row.*")
