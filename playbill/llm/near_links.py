"""Links between similar sets: MinHash signatures, buckets, exact verification inside the bucket, and a forest of links.

An item has a signature of symbols of 16 or 8 bits, each a part of one minimum hash. ``slots`` name the groups of symbols of which one must be
equal for two items to meet in a bucket. Buckets are not joined with themselves. First every member is held against the smallest
member of its bucket, and verified links are merged to components. That settles all pairs of the smallest member, so it leaves the bucket, and
buckets of two are done. Of buckets whose rest still holds several components, equal ones count once. Their members are compared by signature, block against block; those with a close partner in another component come again with their sets,
and all close pairs are verified inside the block, where a union-find leaves out pairs that are connected by then. So a block emits fewer
links than it has members, whatever the number of its pairs, and no link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playbill.llm.arrow import run_groups
from playbill.llm.words import distinct, mix, spread
from playbill.operators.components import connected_components
from playbill.session import cut_lineage, release_shuffles, working_tables

#: members of a bucket that are compared at once, and the bytes of their sets, of which a larger one stands alone
BLOCK, BLOCK_BYTES = 4096, 1 << 21
#: bits of the filter that tells which rows of a table may be wanted; it has this size at any scale
FILTER_BITS = 1 << 25
#: low bits of a bucket key that name its slot
SLOT_BITS = 8
#: rows that are compared with a block at once; buckets up to SMALL members are compared many at a time, HELD rows together
ROWS, SMALL, HELD = 128, 32, 8192
#: sets that are turned into hashes at once
FEW = 512
#: bits that number the pairs of sets that are verified at once, and the values of sets whose minima are taken at once, which fit a cache
PAIR_BITS, CACHED = 6, 1 << 16


def minima(hashes: np.ndarray, counts: np.ndarray, symbols: int, seed: int, bits: int = 16) -> np.ndarray:
    """Some bits of the minimum of each set under ``symbols`` hash functions."""
    out = np.zeros((len(counts), symbols), np.uint32)
    full = np.flatnonzero(counts)
    if len(full):
        draw = np.random.default_rng(seed)
        factors, masks = draw.integers(0, 1 << 32, symbols, np.uint32) | np.uint32(1), draw.integers(0, 1 << 32, symbols, np.uint32)
        values = (hashes >> np.uint64(32)).astype(np.uint32)
        ends = np.cumsum(counts[full])
        starts = ends - counts[full]
        done = 0
        while done < len(full):
            stop = max(done + 1, int(np.searchsorted(ends, starts[done] + CACHED, "right")))
            some, at = values[starts[done] : ends[stop - 1]], starts[done:stop] - starts[done]
            drawn, least = np.empty_like(some), np.empty((symbols, stop - done), np.uint32)
            for k in range(symbols):
                np.multiply(np.bitwise_xor(some, masks[k], out=drawn), factors[k], out=drawn)
                np.minimum.reduceat(drawn, at, out=least[k])
            out[full[done:stop]] = ((least * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)).T
            done = stop
    return out


@dataclass(frozen=True)
class Sketch:
    """Number of symbols, the slots (equally long tuples of symbol numbers), the most symbols in which linked items may differ, and the bits of a symbol.

    Symbols of fewer bits are equal by chance more often. That gives more candidates, never fewer.
    """

    symbols: int
    slots: tuple[tuple[int, ...], ...]
    most_errors: int
    bits: int = 16

    @property
    def kind(self) -> type:
        return np.uint8 if self.bits == 8 else np.uint16

    def signatures(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """One row of symbols for each set: ``counts`` says how many of the 64-bit hashes belong to it. Empty sets have zeros."""
        return minima(hashes, counts, self.symbols, 20, self.bits).astype(self.kind)

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """One 64-bit bucket key for each row and slot, with the slot in its low bits."""
        out = np.empty((len(signatures), len(self.slots)), np.uint64)
        for s, members in enumerate(self.slots):
            h = np.full(len(signatures), s, np.uint64)
            for m in members:
                h = h * np.uint64(0xD6E8FEB86659FD93) + signatures[:, m].astype(np.uint64) + np.uint64(1)
            out[:, s] = mix(h) >> np.uint64(SLOT_BITS) << np.uint64(SLOT_BITS) | np.uint64(s)
        return out.view(np.int64)

    def read(self, column: pa.ChunkedArray | pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), self.kind).reshape(-1, self.symbols)


def bucket_keys(items: DataFrame, sketch: Sketch) -> DataFrame:
    """``key`` and ``id`` for every slot of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = sketch.keys(sketch.read(batch.column(1)))
                ids = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], ["key", "id"])

    return items.select("id", "sig").mapInArrow(run, "key long, id long")


def stored_hashes(members: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of stored sets, one set after the other, and their numbers."""
    return np.frombuffer(b"".join(members), np.uint64), np.array([len(m) // 8 for m in members], np.int64)


def near_links(
    items: DataFrame, sketch: Sketch, sets_of: Callable[[DataFrame], DataFrame], share: int = 80,
    hashes_of: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]] = stored_hashes,
) -> DataFrame:
    """Links ``a``, ``b`` that connect all items whose similarity is ``share`` percent or more, where their signatures show it.

    ``items`` has ``id``, ``n`` (set size, or 1 for all), ``bytes`` (of the set as stored) and ``sig`` and is stored, so it can be read again.
    ``sets_of`` takes a table of ids and gives ``id`` and ``members``, which ``hashes_of`` turns into 64-bit hashes; sets are fetched only for
    items whose signature is close to another's. Not every link inside a component is listed, but the components are those of all links.
    """
    of_key = Window.partitionBy("key")
    spark = items.sparkSession
    with working_tables(spark):
        with working_tables(spark):  # what candidates need, gone before blocks are compared
            met = bucket_keys(items, sketch).withColumns({"members": F.count("*").over(of_key), "leader": F.min("id").over(of_key)})
            live = cut_lineage(met.filter("members > 1"))
            release_shuffles(spark)
            pairs = live.filter("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
            one, other = (items.select(*[F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "sig")]) for x in "ab")
            near = _close_pairs(pairs.join(one, F.col("a") == F.col("id_a")).join(other, F.col("b") == F.col("id_b")), sketch, share)
            near = cut_lineage(near)
            release_shuffles(spark)
            fetched = near.select(F.col("a").alias("id")).union(near.select("b")).distinct()
            sets = cut_lineage(sets_of(fetched), outlive=True)
            release_shuffles(spark)
            links = cut_lineage(linked_pairs(near, sets, share, hashes_of), outlive=True)
            release_shuffles(spark)
            rest = live.filter("members > 2 and id <> leader").select("key", "id")  # pairs with the leader are settled
            placed = _placed(rest, connected_components(links, "a", "b"), items.select("id", "bytes"))
        release_shuffles(spark)
        compared = cut_lineage(_compare(_block_pairs(placed).join(items.select("id", "n", "sig"), "id"), sketch, share))
        release_shuffles(spark)
        more = sets_of(compared.select("id").distinct().join(sets.select("id"), "id", "left_anti"))
        cross = _compare(compared.join(sets.select("id", "members").union(more.select("id", "members")), "id"), sketch, share, hashes_of)
        links = cut_lineage(links.union(cross), outlive=True)
    release_shuffles(spark)
    return links


def _placed(rows: DataFrame, labels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows of buckets that hold several components, with their ``block`` and the ``last`` one of the bucket, stored beyond the innermost block of working tables.

    Of buckets with the same members, the one of the lowest slot stays; it is where pairs are looked at that meet in all of them.
    """
    of_key = Window.partitionBy("key")
    named = rows.join(labels.withColumnRenamed("node", "id"), "id", "left").join(sizes, "id").withColumn("label", F.coalesce("label", "id"))
    spread = named.withColumns({
        "low": F.min("label").over(of_key), "high": F.max("label").over(of_key), "members": F.count("*").over(of_key),
        "first": F.min("id").over(of_key), "print": F.sum(F.xxhash64("id").cast("decimal(20,0)")).over(of_key),
    })
    several = cut_lineage(spread.filter("low <> high").drop("low", "high"))
    release_shuffles(rows.sparkSession)
    slot = F.col("key").bitwiseAND(F.lit((1 << SLOT_BITS) - 1))
    once = several.filter("id = first").groupBy("first", "members", "print").agg(F.min_by("key", slot).alias("key")).select("key")
    placed = several.join(once, "key", "left_semi").select("key", "id", "label", "bytes")
    order = of_key.orderBy("label", "id")
    filled = F.coalesce(F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumn("block", F.floor((F.row_number().over(order) - 1) / BLOCK) + F.floor(filled / BLOCK_BYTES))
    return cut_lineage(placed.withColumn("last", F.max("block").over(of_key)).drop("bytes"), outlive=True)


def _block_pairs(placed: DataFrame) -> DataFrame:
    """Every row once for every pair of blocks that it takes part in."""
    blocked = placed.select("key", "id", "label", "block", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("against"))
    return blocked.select(
        "key", "id", "label", F.least("block", "against").alias("one"), F.greatest("block", "against").alias("other"),
        (F.col("block") <= F.col("against")).alias("left_side"), (F.col("block") >= F.col("against")).alias("right_side"),
    )


def _close_pairs(pairs: DataFrame, sketch: Sketch, share: int) -> DataFrame:
    """Pairs whose signatures and sizes allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            n, m = columns["n_a"].to_numpy(), columns["n_b"].to_numpy()
            keep = (sketch.read(columns["sig_a"]) != sketch.read(columns["sig_b"])).sum(1) <= sketch.most_errors
            keep &= 100 * np.minimum(n, m) >= share * np.maximum(n, m)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], ["a", "b"])

    return pairs.select("a", "b", "sig_a", "n_a", "sig_b", "n_b").mapInArrow(run, "a long, b long")


class Forest:
    """Exact verification of pairs of rows of one table, with a union-find that skips what is connected already."""

    def __init__(self, table: pa.Table, share: int, hashes_of: Callable) -> None:
        self.ids, self.share = table.column("id").to_numpy(), share
        self.root = np.unique(table.column("label").to_numpy(), return_inverse=True)[1]
        members = table.column("members")
        # sets are hashed a few at a time, as hashing takes several times the room of its result
        parts = [hashes_of(members.slice(at, FEW).to_pylist()) for at in range(0, max(1, len(members)), FEW)]
        counts = np.concatenate([n for _, n in parts])
        codes = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)[1]
        del parts
        self.mark = np.zeros(int(codes.max(initial=0)) + 1, bool)
        both = distinct(np.repeat(np.arange(len(counts)), counts) * len(self.mark) + codes)
        self.codes, owner = both % len(self.mark), both // len(self.mark)
        self.counts = np.bincount(owner, minlength=len(counts))
        self.starts = np.cumsum(self.counts) - self.counts
        self.found: list[tuple[int, int]] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Verify pairs; those that connect two components are added to ``found``."""
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        cuts = np.flatnonzero(np.diff(i, prepend=-1)).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(i)]):
            row, others = i[a], j[a:b]
            others = others[self.root[others] != self.root[row]]
            if len(others):
                for other in others[self._linked(row, others)].tolist():
                    if self.root[other] != self.root[row]:
                        self.root[self.root == self.root[other]] = self.root[row]
                        one, two = int(self.ids[row]), int(self.ids[other])
                        self.found.append((min(one, two), max(one, two)))

    def _linked(self, row: int, others: np.ndarray) -> np.ndarray:
        own = self.codes[self.starts[row] : self.starts[row] + self.counts[row]]
        sizes = self.counts[others]
        of = np.repeat(np.arange(len(others)), sizes)
        spots = np.arange(len(of)) + np.repeat(self.starts[others] - np.cumsum(sizes) + sizes, sizes)
        self.mark[own] = True
        both = np.bincount(of[self.mark[self.codes[spots]]], minlength=len(others))
        self.mark[own] = False
        return 100 * both >= self.share * (len(own) + sizes - both)


class SmallForest:
    """Like ``Forest``, for rows of many small buckets, which have few pairs each."""

    def __init__(self, table: pa.Table, share: int, hashes_of: Callable) -> None:
        self.ids, self.share = table.column("id").to_numpy(), share
        self.root = np.unique(table.column("label").to_numpy(), return_inverse=True)[1]
        self.members, self.hashes_of = table.column("members"), hashes_of
        self.found: list[tuple[int, int]] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Verify pairs; those that connect two components are added to ``found``."""
        used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        members = self.members.take(pa.array(used))
        parts = [self.hashes_of(members.slice(k, FEW).to_pylist()) for k in range(0, len(members), FEW)]
        if not parts:
            return
        hashes, counts = (np.concatenate(p) for p in zip(*parts))
        starts = np.cumsum(counts) - counts
        one, other = at[: len(i)], at[len(i) :]
        for k in range(0, len(i), 1 << PAIR_BITS):
            open_ = k + np.flatnonzero(self.root[i[k : k + (1 << PAIR_BITS)]] != self.root[j[k : k + (1 << PAIR_BITS)]])
            a, b = one[open_], other[open_]
            linked = similar(hashes[spread(starts[a], counts[a])], counts[a], hashes[spread(starts[b], counts[b])], counts[b], self.share)
            for x, y in zip(i[open_[linked]].tolist(), j[open_[linked]].tolist()):
                if self.root[x] != self.root[y]:
                    self.root[self.root == self.root[y]] = self.root[x]
                    self.found.append((min(int(self.ids[x]), int(self.ids[y])), max(int(self.ids[x]), int(self.ids[y]))))


def similar(one: np.ndarray, n: np.ndarray, other: np.ndarray, m: np.ndarray, share: int) -> np.ndarray:
    """For pairs of sets, 1 << PAIR_BITS at most, whether 100 * intersection >= share * union; ``n`` and ``m`` of the hashes belong to each."""
    shift = np.uint64(64 - PAIR_BITS)

    def numbered(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return distinct(np.repeat(np.arange(len(counts), dtype=np.uint64) << shift, counts) | hashes >> np.uint64(PAIR_BITS))

    def sizes(values: np.ndarray) -> np.ndarray:
        return np.bincount((values >> shift).astype(np.int64), minlength=len(n))

    x, y = numbered(one, n), numbered(other, m)
    both = sizes(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= share * (sizes(x) + sizes(y) - both)


def _compare(rows: DataFrame, sketch: Sketch, share: int, hashes_of: Callable | None = None) -> DataFrame:
    """Rows of blocks that have a close partner of another component; with ``hashes_of``, the links between components.

    A pair is looked at in the first bucket that both are in. Rows of links come with their sets in ``members``.
    """

    def new(sig: np.ndarray, i: np.ndarray, j: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Pairs that have not met in an earlier slot."""
        out = np.ones(len(i), bool)
        for s, members in enumerate(sketch.slots):
            late = np.flatnonzero(out & (slot > s))
            if len(late):
                out[late] = (sig[i[late]][:, list(members)] != sig[j[late]][:, list(members)]).any(1)
        return out

    def read(table: pa.Table) -> list[np.ndarray]:
        slot = table.column("key").to_numpy() & ((1 << SLOT_BITS) - 1)
        return [table.column(c).to_numpy() for c in ("label", "n", "left_side", "right_side")] + [sketch.read(table.column("sig")), slot]

    def one_bucket(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        labels, n, left, right, sig, slot = read(table)
        if labels.min() == labels.max():
            return
        alone = bool((left & right).all())  # a block with itself
        left, right = np.flatnonzero(left), np.flatnonzero(right)
        columns = np.ascontiguousarray(sig[right].T)
        for at in range(0, len(left), ROWS):
            some = left[at : at + ROWS]
            fits = labels[some][:, None] != labels[right][None, :]
            fits &= 100 * np.minimum(n[some][:, None], n[right][None, :]) >= share * np.maximum(n[some][:, None], n[right][None, :])
            if alone:
                fits &= some[:, None] < right[None, :]
            if fits.any():
                errors = np.zeros(fits.shape, np.uint8)
                for s, column in enumerate(columns):
                    errors += sig[some, s][:, None] != column[None, :]
                i, j = np.nonzero(fits & (errors <= sketch.most_errors))
                i, j = some[i], right[j]
                fresh = new(sig, i, j, slot[i])
                yield i[fresh], j[fresh]

    def small_buckets(table: pa.Table, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Many small buckets at once: every row with the one ``d`` rows further on, for all ``d``."""
        labels, n, left, right, sig, slot = read(table)
        bucket = np.repeat(np.arange(len(sizes)), sizes)
        found = [(bucket[:0], bucket[:0])]
        for d in range(1, int(sizes.max())):
            i = np.flatnonzero(bucket[:-d] == bucket[d:])
            j = i + d
            fits = (labels[i] != labels[j]) & ((left[i] & right[j]) | (left[j] & right[i]))
            fits &= 100 * np.minimum(n[i], n[j]) >= share * np.maximum(n[i], n[j])
            i, j = i[fits], j[fits]
            close = (sig[i] != sig[j]).sum(1) <= sketch.most_errors
            found.append((i[close], j[close]))
        i, j = (np.concatenate(f) for f in zip(*found))
        fresh = new(sig, i, j, slot[i])
        return i[fresh], j[fresh]

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, bool, Iterator[tuple[np.ndarray, np.ndarray]]]]:
        """Tables with the close pairs of their rows, and whether they are one large bucket or many small ones."""
        held: list[tuple[pa.Table, np.ndarray]] = []
        rows = size = 0

        def all_held() -> tuple[pa.Table, bool, Iterator[tuple[np.ndarray, np.ndarray]]]:
            table = pa.concat_tables([t for t, _ in held]).combine_chunks()
            return table, False, iter([small_buckets(table, np.concatenate([n for _, n in held]))])

        for table, sizes in run_groups(batches, ["key", "one", "other"], SMALL):
            if table.num_rows > SMALL and len(sizes) == 1:
                yield table, True, one_bucket(table)
                continue
            ends = np.cumsum(sizes)
            weights = pc.binary_length(table.column("members")).to_numpy() if hashes_of else np.zeros(table.num_rows, np.int64)
            filled = np.cumsum(np.add.reduceat(weights, ends - sizes, dtype=np.int64))
            done = 0
            while done < len(sizes):  # as many buckets as there is room for, one at least
                start, before = (int(ends[done - 1]), int(filled[done - 1])) if done else (0, 0)
                stop = min(int(np.searchsorted(ends, start + HELD - rows)), int(np.searchsorted(filled, before + BLOCK_BYTES // 4 - size)))
                stop = min(max(stop, done) + 1, len(sizes))
                held.append((table.slice(start, int(ends[stop - 1]) - start), sizes[done:stop]))
                rows += int(ends[stop - 1]) - start
                size += int(filled[stop - 1]) - before
                done = stop
                if rows >= HELD or size >= BLOCK_BYTES // 4:
                    yield all_held()
                    held, rows, size = [], 0, 0
        if held:
            yield all_held()

    def in_doubt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _, pairs in groups(batches):
            keep = np.zeros(table.num_rows, bool)
            for i, j in pairs:
                keep[i] = keep[j] = True
            yield from table.filter(pa.array(keep)).combine_chunks().to_batches()

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, large, pairs in groups(batches):
            forest = (Forest if large else SmallForest)(table, share, hashes_of)
            for i, j in pairs:
                forest.add(i, j)
            a, b = zip(*forest.found) if forest.found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    # little data and much work: as many tasks as there are shuffle partitions, not as the bytes would ask for
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    taken = rows.select("key", "one", "other", "id", "label", "n", "sig", "left_side", "right_side", *(["members"] if hashes_of else []))
    ordered = taken.repartition(tasks, "key", "one", "other").sortWithinPartitions("key", "one", "other")
    return ordered.mapInArrow(links, "a long, b long").distinct() if hashes_of else ordered.mapInArrow(in_doubt, taken.schema)


def linked_pairs(pairs: DataFrame, sets: DataFrame, share: int, hashes_of: Callable) -> DataFrame:
    """The pairs of sets (``id``, ``members``) with 100 * intersection >= share * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << PAIR_BITS):
                part = batch.slice(at, 1 << PAIR_BITS)
                keep = similar(*hashes_of(part.column(2).to_pylist()), *hashes_of(part.column(3).to_pylist()), share)
                yield pa.RecordBatch.from_arrays([part.column(i).filter(pa.array(keep)) for i in (0, 1)], ["a", "b"])

    one, other = (sets.select(F.col("id").alias(x), F.col("members").alias(f"members_{x}")) for x in "ab")
    return pairs.join(one, "a").join(other, "b").select("a", "b", "members_a", "members_b").mapInArrow(run, "a long, b long")


def wanted_filter(hashes: DataFrame, column: str):
    """A broadcast bit set of the hashes in ``column``. Its size is fixed; with very many hashes it lets more rows through than needed."""
    spot = F.pmod(F.col(column), F.lit(FILTER_BITS))
    words = hashes.select(F.floor(spot / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (spot % 64).cast("int")).alias("bit"))
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # FILTER_BITS / 64 rows at most
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return hashes.sparkSession.sparkContext.broadcast(bits)


def may_be_wanted(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    spot = hashes.astype(np.int64) % FILTER_BITS
    return (bits[spot >> 6] >> (spot & 63)) & 1 == 1
