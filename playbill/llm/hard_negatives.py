"""Hard negatives: rows of another label that score nearly as high with an anchor as its positives do.

Each vector is summarised by the mean and the deviation of its segments. For two segments of equal length the inner product lies within the product of
their means plus or minus the product of their deviations, times the length; summed over segments this bounds the score of two vectors. Bounds
come from one segment first, then from finer ones for what is left, and only what no bound decides is scored exactly. Anchors are sent to the
rows in blocks of a stated size; every row meets every anchor, and what a task returns for an anchor is bounded by the numbers asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playbill.llm.arrow import parts
from playbill.session import cut_lineage

#: segments of a vector, coarse to fine
LEVELS = (1, 4, 16)
#: most bytes of the vectors of one block of anchors, which is sent to all executors
ANCHOR_BYTES = 16 << 20
#: rows and anchors that are compared at once
ROWS, ANCHORS = 1024, 256
#: above this share of undecided pairs a finer bound is taken for the whole block
DENSE = 0.2
#: integers up to here are exact as doubles
_EXACT = 2.0**53


def _segment_sizes(width: int, segments: int) -> np.ndarray:
    cuts = np.arange(segments + 1) * width // segments
    return np.diff(cuts)


def summaries(vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level, means and deviations of all segments, both times the root of the segment's length."""
    out, width = [], vectors.shape[1]
    total = np.concatenate([np.zeros((len(vectors), 1)), np.cumsum(vectors, axis=1)], axis=1)
    for level in LEVELS:
        size = _segment_sizes(width, level)
        cuts = np.concatenate([[0], np.cumsum(size)])
        mean = (total[:, cuts[1:]] - total[:, cuts[:-1]]) / np.maximum(size, 1)
        rest = vectors - np.repeat(mean, size, axis=1)
        squares = np.stack([np.einsum("ij,ij->i", rest[:, a:b], rest[:, a:b]) for a, b in zip(cuts, cuts[1:])], axis=1)
        out.append((mean * np.sqrt(size), np.sqrt(squares)))
    return out


def valid_rows(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """Rows that take part: ``vec_id``, ``label`` and ``vector``, whose components are 256 times the given ones, floored.

    Rows with a null id, label or vector, or with any null or non-finite component, take no part. Of rows with one id that are not equal the one with the
    smallest label, then vector, stays; equal rows count once. Other columns are not looked at; an empty table gives an empty table.
    """
    x = F.col(vector_column).cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    # F.floor makes a long, which is too short for the largest components; x - x % 1 is exact
    down = lambda c: F.when(c < 0, -(-c - (-c) % 1) - F.when((-c) % 1 > 0, 1).otherwise(0)).otherwise(c - c % 1) + F.lit(0.0)
    rows = table.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("long").alias("label"), x.alias("vector"))
    rows = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").filter(sound)
    rows = rows.withColumn("vector", F.transform("vector", lambda c: down(c * 256.0)))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.label", "row.vector")


@dataclass
class _Block:
    """Anchors with their vectors, labels, summaries and, for negatives, the scores of their positives in descending order."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    goals: np.ndarray | None = None  # scores of the positives, (anchors, positives)
    has: np.ndarray | None = None  # where there is one


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    column = column.cast(pa.large_list(pa.float64()))
    offsets = column.offsets.to_numpy()
    lengths = np.diff(offsets)
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    if len(lengths) and (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], lengths)] = values
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all pairs; beyond the range of a long they are the nearest long."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] >= _EXACT:
        whole = np.frompyfunc(int, 1, 1)
        return np.clip(whole(a) @ whole(b).T, -(2**63), 2**63 - 1).astype(np.int64)
    return (a @ b.T).astype(np.int64)


def _pair_scores(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact inner products of the pairs (i, j)."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] >= _EXACT:
        return np.array([_scores(a[x : x + 1], b[y : y + 1])[0, 0] for x, y in zip(i.tolist(), j.tolist())], np.int64)
    return np.einsum("ij,ij->i", a[i], b[j]).astype(np.int64)


def undecided(mine: list, theirs: list, open_pairs: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which open pairs of anchors and rows may have a score from ``low`` to ``high`` (both by anchor), by finer and finer bounds."""
    for (ma, da), (mb, db) in zip(mine, theirs):
        n = np.count_nonzero(open_pairs)
        if not n:
            break
        if n > DENSE * open_pairs.size:
            middle, reach = ma @ mb.T, da @ db.T
            slack = 1 + 1e-9 * (np.abs(middle) + reach)
            open_pairs &= (middle + reach + slack >= low[:, None]) & (middle - reach - slack <= high[:, None])
        else:
            i, j = np.nonzero(open_pairs)
            middle, reach = np.einsum("ij,ij->i", ma[i], mb[j]), np.einsum("ij,ij->i", da[i], db[j])
            slack = 1 + 1e-9 * (np.abs(middle) + reach)
            open_pairs[i, j] = (middle + reach + slack >= low[i]) & (middle - reach - slack <= high[i])
    return open_pairs


class _Best:
    """The ``k`` best (score, id) of every place, best first: higher scores, ties to smaller ids."""

    def __init__(self, places: int, k: int):
        self.scores = np.full((places, k), np.iinfo(np.int64).min, np.int64)
        self.ids = np.full((places, k), np.iinfo(np.int64).max, np.int64)
        self.full = np.zeros((places, k), bool)

    def add(self, place: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        some, k = np.unique(place), self.scores.shape[1]
        held = self.full[some]
        p = np.concatenate([np.repeat(some, held.sum(axis=1)), place])
        s = np.concatenate([self.scores[some][held], score])
        v = np.concatenate([self.ids[some][held], ids])
        order = np.lexsort((v, -s.astype(object) if (s == np.iinfo(np.int64).min).any() else -s, p))
        p, s, v = p[order], s[order], v[order]
        nth = np.arange(len(p)) - np.searchsorted(p, p, "left")
        keep = nth < k
        p, s, v, nth = p[keep], s[keep], v[keep], nth[keep]
        self.scores[p, nth], self.ids[p, nth], self.full[p, nth] = s, v, True

    def worst(self) -> np.ndarray:
        """The score that a new row must reach, by place."""
        return np.where(self.full[:, -1], self.scores[:, -1].astype(float), -np.inf)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        place, nth = np.nonzero(self.full)
        return place, self.scores[place, nth], self.ids[place, nth]


def _scan(rows: DataFrame, block: _Block, k: int, share: tuple[int, int] | None) -> DataFrame:
    """For every task, anchor and (with ``share``) positive, the ``k`` best rows: ``anchor_id``, ``nth`` positive, ``vec_id``, ``score``."""
    shipped = rows.sparkSession.sparkContext.broadcast(block)
    width = block.vectors.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = shipped.value
        count = len(anchors.ids)
        depth = anchors.goals.shape[1] if share else 1
        best = _Best(count * depth, k)
        mine = summaries(anchors.vectors)
        for part in parts(batches, ROWS):
            ids, labels = part.column(0).to_numpy(), part.column(1).to_numpy()
            vectors = _matrix(part.column(2), width)
            theirs = summaries(vectors)
            for at in range(0, count, ANCHORS):
                some = slice(at, at + ANCHORS)
                own = anchors.labels[some][:, None] == labels[None, :]
                if share:
                    goals, has = anchors.goals[some].astype(float), anchors.has[some]
                    reach = goals * (share[0] / share[1]) - 1 - 1e-9 * np.abs(goals)
                    held = best.worst().reshape(count, depth)[some]
                    low = np.where(has, np.maximum(reach, held), np.inf).min(axis=1)
                    high = np.where(has, goals, -np.inf).max(axis=1)
                    open_pairs = ~own
                else:
                    low, high = best.worst()[some], np.full(len(own), np.inf)
                    open_pairs = own & (anchors.ids[some][:, None] != ids[None, :])
                level = lambda all_levels: [(m[some], d[some]) for m, d in all_levels]
                i, j = np.nonzero(undecided(level(mine), theirs, open_pairs, low, high))
                if not len(i):
                    continue
                if len(i) > DENSE * open_pairs.size:
                    score = _scores(anchors.vectors[some], vectors)[i, j]
                else:
                    score = _pair_scores(anchors.vectors[some], vectors, i, j)
                if not share:
                    best.add(at + i, score, ids[j])
                    continue
                for nth in range(depth):
                    goal = anchors.goals[some][i, nth]
                    fits = anchors.has[some][i, nth] & (score <= goal) & _reaches(score, goal, share)
                    if fits.any():
                        best.add((at + i[fits]) * depth + nth, score[fits], ids[j[fits]])
        place, score, ids = best.rows()
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchors.ids[place // depth]), pa.array((place % depth).astype(np.int32)), pa.array(ids), pa.array(score)],
            ["anchor_id", "nth", "vec_id", "score"],
        )

    return rows.select("vec_id", "label", "vector").mapInArrow(run, "anchor_id long, nth int, vec_id long, score long")


def _reaches(score: np.ndarray, goal: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """share[0] * goal <= share[1] * score, in whole numbers."""
    if len(score) and max(int(np.abs(score).max()), int(np.abs(goal).max())) >= 2**63 // (max(share) + 1):
        return np.array([share[0] * g <= share[1] * s for s, g in zip(score.tolist(), goal.tolist())], bool)
    return share[0] * goal <= share[1] * score


def _first(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of all tasks together, with their ``rank``."""
    order = Window.partitionBy("anchor_id", "nth").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), anchor_bytes: int = ANCHOR_BYTES
) -> DataFrame:
    """Hard negatives: ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``rows`` and ``anchors`` are tables as ``valid_rows`` makes them, with one row for each id; an anchor need not be among the rows. An anchor's positives
    are the ``positives`` best-scoring other rows of its label. For each of them the ``negatives`` best rows of other labels are returned whose score
    is at most the positive's and at least ``share[0]`` in ``share[1]`` of it. Ties go to the smaller id. All rows are looked at for all anchors; a
    vector that is shorter than the longest counts as if it ended in zeros; scores beyond a long are the nearest long. Without rows, anchors or
    positives nothing is returned. The driver holds one block of anchors with their positives, ``anchor_bytes`` of vectors or so, at a time.
    """
    spark = rows.sparkSession
    stored, starts = cut_lineage(rows), cut_lineage(anchors)
    wide = stored.agg(F.max(F.size("vector")).alias("n")).unionAll(starts.agg(F.max(F.size("vector")).alias("n"))).agg(F.max("n")).first()[0] or 0
    count = starts.count()
    blocks = max(1, -(-count * 8 * wide // anchor_bytes))
    out = None
    for number in range(blocks):
        some = starts.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number).orderBy("vec_id").toArrow()
        if not some.num_rows or not wide:
            continue
        vectors = _matrix(some["vector"].combine_chunks(), wide)
        block = _Block(some["vec_id"].to_numpy(), some["label"].to_numpy(), vectors)
        near = cut_lineage(_first(_scan(stored, block, positives, None), positives).select("anchor_id", "rank", "vec_id", "score"))
        held = near.toArrow()
        place = (np.searchsorted(block.ids, held["anchor_id"].to_numpy()), held["rank"].to_numpy() - 1)
        block.goals, block.has = np.zeros((len(block.ids), positives), np.int64), np.zeros((len(block.ids), positives), bool)
        block.goals[place], block.has[place] = held["score"].to_numpy(), True
        hard = _first(_scan(stored, block, negatives, share), negatives)
        close = near.select("anchor_id", (F.col("rank") - 1).alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        part = hard.select("anchor_id", "nth", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        part = cut_lineage(part.join(close, ["anchor_id", "nth"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out
