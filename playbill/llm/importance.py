"""Resampling of documents towards a target distribution, by importance weights over hashed features.

Features are runs of one and two words; a feature's bucket is a CRC of its bytes. Two passes over the texts: one counts buckets over all
documents, one weighs each document. CRCs are taken for many features at once: distinct features of equal length stand as rows of a byte matrix,
whose columns advance all CRCs together, and the buckets go back to every place where the features occur.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playbill.llm.arrow import parts, slices, text_bytes
from playbill.llm.words import LOWER, PLAIN_WORDS, find_words, spread
from playbill.session import cut_lineage

BUCKETS = 10_000
#: words are handled in blocks of so many, whatever the length of their text
BLOCK = 1 << 17
#: features of more bytes are rare and have a matrix of few rows each; the C function takes them one by one
LONG = 512
#: a matrix holds about so many bytes at most
MATRIX = 4 << 20
_SPACE = 0x20


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_TABLE = _crc_table()


def crc_columns(matrix: np.ndarray) -> np.ndarray:
    """CRC-32 of every row of a byte matrix, column by column."""
    crc = np.full(len(matrix), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(matrix.T):
        crc = _TABLE[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
    return crc ^ np.uint32(0xFFFFFFFF)


def crc_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of byte spans, by length: spans of one length are gathered into a matrix, and its results are scattered back."""
    out = np.empty(len(starts), np.uint32)
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, cuts) if len(order) else []:
        width = int(lengths[group[0]])
        if width > LONG:
            out[group] = [zlib.crc32(data[s : s + width]) for s in starts[group].tolist()]
            continue
        step = max(1, MATRIX // max(width, 1))
        for at in range(0, len(group), step):
            some = group[at : at + step]
            out[some] = crc_columns(data[starts[some][:, None] + np.arange(width)])
    return out


def _feature_buckets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, fresh: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and buckets of all features of a block of words. The first ``fresh`` words of the block were in the block before."""
    lengths = ends - starts
    # the block's words in a row, each followed by one space; words and pairs of neighbours are then spans of it
    places = np.cumsum(lengths + 1) - (lengths + 1)
    flat = np.full(int(lengths.sum()) + len(lengths), _SPACE, np.uint8)
    flat[np.repeat(places - starts, lengths) + spread(starts, lengths)] = data[spread(starts, lengths)]
    # exact numbers of distinct words, by the library's dictionary of their bytes
    offsets = np.append(places, len(flat)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
    number = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    pairs = np.flatnonzero(rows[1:] == rows[:-1])
    keys = number[pairs] * (len(lengths) + 1) + number[pairs + 1]
    _, first_word, word_of = np.unique(number, return_index=True, return_inverse=True)
    _, first_pair, pair_of = np.unique(keys, return_index=True, return_inverse=True)
    first_pair = pairs[first_pair]
    crcs = crc_spans(
        flat, np.concatenate([places[first_word], places[first_pair]]),
        np.concatenate([lengths[first_word], lengths[first_pair] + 1 + lengths[first_pair + 1]]),
    )
    found = (crcs % np.uint32(buckets)).astype(np.int64)
    single, double = found[: len(first_word)][word_of][fresh:], found[len(first_word) :][pair_of]
    return np.concatenate([rows[fresh:], rows[pairs]]), np.concatenate([single, double])


def features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (row of each feature, its bucket, row of each word) of UTF-8 texts; a feature occurs in one block."""
    lowered = LOWER[data]
    starts, ends, firsts = find_words(lowered, offsets, PLAIN_WORDS)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    for at in range(0, len(starts), BLOCK):
        low = max(at - 1, 0)  # a pair may begin with the last word of the block before
        block = slice(low, at + BLOCK)
        of, found = _feature_buckets(lowered, starts[block], ends[block], rows[block], at - low, buckets)
        yield of, found, rows[at : at + BLOCK]


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """How many features of all texts fall into each bucket: ``bucket``, ``n``; buckets without features are left out.

    Texts are lower-cased in A-Z and split at everything in ASCII but letters and digits. A null or empty text has no features; repeated rows
    count each; other columns are not looked at; an empty table gives an empty table. A task sends one row for each bucket at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in parts(batches):
            data, offsets = text_bytes(part.column(0))
            for a, b in slices(offsets):
                for _, found, _ in features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], buckets):
                    total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    counted = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """The floored gain of each bucket in thousandths: the log of its smoothed share of the target against that of the source."""
    source_all, target_all = sum(source.values()), sum(target.values())
    return np.array(
        [
            math.floor(1000 * math.log(
                float(target.get(b, 0) + 1) * float(source_all + buckets) / (float(source.get(b, 0) + 1) * float(target_all + buckets))
            ))
            for b in range(buckets)
        ],
        np.int64,
    )


def weigh(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, seed: int = 7) -> DataFrame:
    """Every document with its importance: ``doc_id``, ``n_words``, ``n_features``, ``weight`` and ``score``.

    ``weight`` is the floored mean gain of a document's features, 0 without features. ``score`` adds Gumbel noise in thousandths made from
    ``seed`` and the id, so that the highest scores are a draw without replacement by weight. Null and empty texts have no words and weight 0; a
    null id draws its noise from an empty id; repeated rows are weighed each; columns of other names are not looked at; empty tables have no counts
    and an empty ``docs`` gives an empty table. The driver holds one number for each bucket.
    """
    count = lambda table: {r["bucket"]: r["n"] for r in bucket_counts(table, buckets).collect()}  # noqa: E731  one row for each bucket
    gain = gains(count(docs), count(target), buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            data, offsets = text_bytes(part.column(1))
            n, words, total = np.zeros((3, part.num_rows), np.int64)
            for a, b in slices(offsets):
                for of, found, word_rows in features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], buckets):
                    n[a:b] += np.bincount(of, minlength=b - a)
                    words[a:b] += np.bincount(word_rows, minlength=b - a)
                    np.add.at(total[a:b], of, gain[found])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))], ["doc_id", "n_words", "n_features", "weight"]
            )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    weighed = plain.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weighed.withColumn("score", (F.col("weight") + noise).cast("long"))


def draw(weighed: DataFrame, percent: int = 25, least_words: int = 20) -> DataFrame:
    """All rows of ``weigh`` with ``rank``: 1, 2, 3... for the drawn ones, null for the rest.

    Of the documents with at least ``least_words`` words, ``percent`` in a hundred are drawn, rounded down: the highest scores, ties to the smaller
    id (null first), then to fewer features. Equal rows are counted together before they meet, and take neighbouring ranks. An empty table gives an
    empty table. The driver holds one count for each different score in thousandths; their number is bounded by the range of logarithms.
    """
    kept = ["doc_id", "n_words", "n_features", "weight", "score"]
    groups = cut_lineage(weighed.groupBy(*kept).agg(F.count("*").alias("copies")))
    able = F.col("n_words") >= least_words
    by_score = {r["score"]: r["n"] for r in groups.filter(able).groupBy("score").agg(F.sum("copies").alias("n")).collect()}
    wanted, above, starts = sum(by_score.values()) * percent // 100, 0, []
    for score in sorted(by_score, reverse=True):
        if above >= wanted:
            break
        starts.append((score, above))
        above += by_score[score]
    lowest = starts[-1][0] if starts else None
    chosen = able & (F.col("score") >= F.lit(lowest).cast("long")) if starts else F.lit(False)
    table = F.broadcast(weighed.sparkSession.createDataFrame(starts, "score long, above long"))
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_first(), "n_features", "weight", "n_words")
    before = F.coalesce(F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = groups.filter(chosen).join(table, "score").withColumn("first", F.col("above") + before + 1)
    ranked = ranked.select(*kept, F.explode(F.sequence("first", F.col("first") + F.col("copies") - 1)).alias("place"))
    ranked = ranked.select(*kept, F.when(F.col("place") <= wanted, F.col("place")).alias("rank"))
    rest = groups.filter(~chosen).select(*kept, F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("place"))
    return ranked.unionByName(rest.select(*kept, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = BUCKETS, seed: int = 7) -> DataFrame:
    """The drawn documents with all their columns. Rows of one id are drawn together if one of them is; a null id stays out."""
    drawn = draw(weigh(docs, target, buckets, seed), percent, least_words).filter("rank IS NOT NULL")
    return docs.join(drawn.select("doc_id").distinct(), "doc_id", "left_semi")
