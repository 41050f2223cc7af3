"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard has virtual nodes on a ring; a row belongs to the first node clockwise from its own point. A shard takes rows of its own
arcs until it is full; what is over goes on clockwise to the next shard with room. Which rows of an arc go on is decided by their rank
on the arc, so rows are never moved one by one: counts by arc are enough to work out, arc by arc, which ranks land where.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playbill.session import cut_lineage

VIRTUAL_NODES = 128
#: rows of one arc are ranked in so many parts, told by their keys
PARTS = 64
#: repeated rows are one row with a count, written out again in pieces of so many
COPIES = 1 << 16


def ring(shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """Points of all virtual nodes with their shards, clockwise. A shard's points do not depend on the number of shards."""
    point = lambda s, v: int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big") >> 1
    return sorted((point(s, v), s) for s in range(shards) for v in range(virtual_nodes))


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """Most rows of each shard. Without slack they sum up to all rows and differ by one at most."""
    if slack:
        return [int(-(-rows * (1 + slack) // shards))] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def overflow(counts: list[int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Pieces (arc, first rank, end rank, shard, first slot): own arcs fill a shard first, then the rest goes on clockwise."""
    room, slots, pieces, left = list(room), [0] * len(room), [], []

    def take(arc: int, first: int, end: int, shard: int) -> int:
        n = min(end - first, room[shard])
        if n > 0:
            pieces.append((arc, first, first + n, shard, slots[shard]))
            room[shard] -= n
            slots[shard] += n
        return first + max(n, 0)

    for arc, n in enumerate(counts):
        first = take(arc, 0, n, owners[arc])
        if first < n:
            left.append((arc, first, n))
    arcs = len(owners)
    skip = list(range(1, arcs + 1))  # next arc clockwise whose shard may still have room, followed with shortcuts
    skip[-1] = 0

    def next_open(arc: int) -> int:
        seen = []
        while room[owners[arc]] <= 0:
            seen.append(arc)
            arc = skip[arc]
        for a in seen:
            skip[a] = arc
        return arc

    for arc, first, end in left:
        at = arc
        while first < end:
            at = next_open(at)
            first = take(arc, first, end, owners[at])
    return pieces


def assign(docs: DataFrame, shards: int, virtual_nodes: int = VIRTUAL_NODES, slack: float = 0.0) -> DataFrame:
    """Shard and slot of every row: ``doc_id``, ``size`` (UTF-8 bytes and 16 more), ``text_crc32``, ``shard``, ``slot``.

    A row's point comes from its id and text; rows of an arc are ranked by key, id and text checksum, so the assignment does not depend
    on how the table is laid out or which task is run again. Repeated rows are counted before anything is shuffled by arc and follow
    each other; a null id or text is a value of its own. No shard gets more than its capacity: with ``slack`` that is so much more than
    the mean, without it all shards are full and counts differ by one at most. Slots of a shard count from 0 without gaps. Other columns
    are not looked at; an empty table gives an empty table. The driver holds one count for each virtual node, whatever the number of rows.
    """
    nodes = ring(shards, virtual_nodes)
    points, owners = [p for p, _ in nodes], [s for _, s in nodes]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("key"),
    )
    values = ["key", "doc_id", "size", "text_crc32"]
    slim = slim.groupBy(*values).agg(F.count("*").alias("n"))
    slim = slim.withColumns({"point": F.shiftrightunsigned("key", 1), "part": F.pmod("key", F.lit(PARTS))})
    slim = cut_lineage(_with_arcs(slim, points))
    counts = slim.groupBy("arc", "part").agg(F.sum("n").alias("n"))
    so_far = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("arc", "part", so_far(Window.partitionBy("arc").orderBy("part")).alias("before"))
    by_arc = {r["arc"]: r["n"] for r in counts.groupBy("arc").agg(F.sum("n").alias("n")).collect()}
    loads = [by_arc.get(i, 0) for i in range(len(nodes))]
    pieces = overflow(loads, owners, capacities(sum(loads), shards, slack))
    table = docs.sparkSession.createDataFrame(pieces, "arc int, first long, stop long, shard int, slot long")
    nth = so_far(Window.partitionBy("arc", "part").orderBy(*values))
    ranked = slim.withColumn("nth", nth).join(offsets, ["arc", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    pieces_of = ranked.withColumn("copies", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))))
    every = F.sequence("copies", F.least(F.col("copies") + COPIES, "n") - 1)
    ranked = pieces_of.repartition("key", "copies").withColumn("copy", F.explode(every)).withColumn("rank", F.col("rank") + F.col("copy"))
    placed = ranked.join(F.broadcast(table), "arc").filter("rank >= first and rank < stop")
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("rank") - F.col("first")).cast("long").alias("slot"))


def _with_arcs(rows: DataFrame, points: list[int]) -> DataFrame:
    """Add the number of the first node clockwise. Nodes are listed by ring cell; only those of a row's own cell are compared."""
    bits = max(1, (len(points) - 1).bit_length())
    cells: list[list[int]] = [[] for _ in range(1 << bits)]
    for p in points:
        cells[p >> (63 - bits)].append(p)
    table, before = [], 0
    for cell, inside in enumerate(cells):
        table.append((cell, before, inside))
        before += len(inside)
    nodes = rows.sparkSession.createDataFrame(table, "cell int, before int, inside array<long>")  # two lists for each node at most
    joined = rows.withColumn("cell", F.shiftright("point", 63 - bits).cast("int")).join(F.broadcast(nodes), "cell")
    arc = F.pmod(F.col("before") + F.size(F.filter("inside", lambda p: p < F.col("point"))), F.lit(len(points)))
    return joined.withColumn("arc", arc).drop("cell", "before", "inside")
