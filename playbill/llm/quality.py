"""Quality by compression: texts that a dictionary of good texts shortens better than one of bad texts are good.

Two zstandard dictionaries are built from bounded samples of good and bad labelled texts. A text is compressed block by block with each;
the difference of the two sizes, normalised by their sum, is the evidence, and how far the text can be compressed at all goes with it,
since a text that repeats itself suits either dictionary. A logistic curve fitted on other labelled rows turns this into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: bytes of a block; every block starts from the dictionary, so long texts count with all their parts
BLOCK = 1024
DICTIONARY_BYTES = 112_640
LEVEL = 3
#: bounds of the fit: texts of each label in a dictionary, bytes of such a text at most, rows for the calibration
FIT_TEXTS, FIT_TEXT_BYTES, FIT_ROWS = 600, 65_536, 4_000
THRESHOLD = 0.3
#: texts that a worker holds as Python objects at once
ROWS = 256


@dataclass(frozen=True)
class Model:
    """Dictionaries (empty: none could be built), calibration weights, and the centre and scale of the evidence."""

    bad: bytes
    good: bytes
    weights: tuple[float, ...]
    centre: tuple[float, ...]
    scale: tuple[float, ...]


def build_dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary, or the texts' own bytes where there are too few to train one."""
    blocks = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-DICTIONARY_BYTES:]


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    if len(dictionary) < 8:
        return zstandard.ZstdCompressor(level=LEVEL)
    held = zstandard.ZstdCompressionDict(dictionary)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held)


def evidence(text: bytes, bad: zstandard.ZstdCompressor, good: zstandard.ZstdCompressor) -> tuple[float, ...]:
    """Normalised size difference, compressed share and length, in the form that the calibration takes."""
    blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)] or [b""]
    b, g = sum(len(bad.compress(x)) for x in blocks), sum(len(good.compress(x)) for x in blocks)
    difference, share, length = (b - g) / (b + g), g / max(1, len(text)), np.log1p(len(text)) / 10
    return difference, share, min(share, 0.3), length, difference * length


def calibrate(rows: np.ndarray, labels: np.ndarray) -> tuple[tuple[float, ...], tuple[float, ...], tuple[float, ...]]:
    """Weights of a logistic curve by Newton steps, with a weak pull to zero, on standardised evidence."""
    if not len(rows):
        return (0.0,) * 6, (0.0,) * 5, (1.0,) * 5
    centre, scale = rows.mean(0), rows.std(0)
    scale[scale == 0] = 1
    x = np.column_stack([np.ones(len(rows)), (rows - centre) / scale])
    w = np.zeros(x.shape[1])
    pull = np.diag([1e-3, *[0.05] * 5])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (labels - p) - pull @ w)
    return tuple(w.tolist()), tuple(centre.tolist()), tuple(scale.tolist())


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _evidence_of(rows: DataFrame, bad: bytes, good: bytes) -> DataFrame:
    """``row`` (the columns of ``rows``, which have a ``text``) and ``evidence``. Only texts go to the Python workers; rows stay where they are."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one, other = compressor(bad), compressor(good)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                texts = batch.slice(at, ROWS).to_pylist()
                yield pa.array([evidence(t or b"", one, other) for t in texts], pa.list_(pa.float64()))

    # not deterministic: a filter on the score would work it out once more, below this step
    return rows.select(F.struct("*").alias("row"), found.asNondeterministic()(F.col("text").cast("binary")).alias("evidence"))


def fit(docs: DataFrame, labels: DataFrame, fit_texts: int = FIT_TEXTS, fit_rows: int = FIT_ROWS) -> Model:
    """Build dictionaries and calibration from labelled rows that are not held out.

    Rows are taken in the order of a hash of their id, half of all ids for dictionaries and half for the calibration, up to the bounds.
    Labels other than 0 and 1 and labels without a document are not used. The sampled ids, of bounded number, are broadcast to
    the scan of ``docs``. Without labels of either kind, the score is what the labels there are allow, and a half without any.
    """
    order = F.xxhash64(F.col("doc_id"), F.lit(17))
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    usable = usable.filter("quality in (0, 1)").filter(~held_out(F.col("doc_id"))).distinct()
    for_texts = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(2)) == 0
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).filter("text is not null")
    # twice the ids, since some documents may be missing or too long
    dictionaries = []
    for quality in (0, 1):
        ids = usable.filter(for_texts & (F.col("quality") == quality)).orderBy(order).limit(2 * fit_texts)
        texts = plain.filter(F.octet_length("text") <= FIT_TEXT_BYTES).join(F.broadcast(ids), "doc_id").orderBy(order, "text").limit(fit_texts)
        dictionaries.append(build_dictionary([bytes(r["text"]) for r in texts.select("text").collect()]))
    rows = plain.join(F.broadcast(usable.filter(~for_texts).orderBy(order).limit(fit_rows)), "doc_id")
    found = _evidence_of(rows.select("text", "quality"), *dictionaries).select("row.quality", "evidence").limit(2 * fit_rows).collect()
    found = sorted((r["quality"], tuple(r["evidence"])) for r in found)
    weights = calibrate(np.array([e for _, e in found]).reshape(-1, 5), np.array([q for q, _ in found], float))
    return Model(*dictionaries, *weights)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``row`` with the columns of ``docs``, and ``score`` from 0 to 1. Only the text counts; a null text is empty."""
    weights = model.weights
    z = F.lit(weights[0])
    for i in range(5):
        z = z + F.lit(weights[i + 1]) * (F.col("evidence")[i] - F.lit(model.centre[i])) / F.lit(model.scale[i])
    return _evidence_of(docs, model.bad, model.good).select("row", (1 / (1 + F.exp(-z))).alias("score"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document. Null ids are not held out; repeated rows are scored alike;
    other columns are not looked at; an empty table gives an empty table."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return score(plain, fit(docs, labels)).select(
        "row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents predicted good, with all their columns."""
    return score(docs, fit(docs, labels)).filter(F.col("score") >= THRESHOLD).select("row.*")
