"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playbill.session import cut_lineage, working_tables


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Label every node of ``edges`` with the smallest node it is connected to.

    Each round takes the smallest label among the neighbours, then follows labels of labels, so paths
    shrink by half or better. Neighbour minima combine before the shuffle, so a hub costs no more than
    its edges. Rounds end when no label changes.
    """
    with working_tables(edges.sparkSession):
        pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a is not null and b is not null and a <> b")
        both = cut_lineage(pairs.union(pairs.select("b", "a")).distinct())
        labels = cut_lineage(
            both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label"))
        )
        while True:
            offered = (
                both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("offer"))
                .withColumnRenamed("a", "node")
            )
            spread = labels.join(offered, "node").select(
                "node", F.col("label").alias("old"), F.least("label", "offer").alias("label")
            )
            hop = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
            jumped = spread.join(hop, "label", "left").select(
                "node", "old", F.least("label", F.coalesce("next", "label")).alias("label")
            )
            jumped = cut_lineage(jumped, outlive=True)
            changed = not jumped.filter("label <> old").isEmpty()
            labels = jumped.select("node", "label")
            if not changed:
                return labels


def group_edges(groups: DataFrame, group: str = "group_id", member: str = "id") -> DataFrame:
    """Edges from the smallest member of every group to the others."""
    hubs = groups.groupBy(group).agg(F.min(member).alias("src"))
    return groups.join(hubs, group).select("src", F.col(member).alias("dst")).filter("src <> dst").distinct()


def clusters(groups: DataFrame, ids: DataFrame, group: str = "group_id") -> DataFrame:
    """Disjoint clusters from overlapping groups of ids: ``id`` and ``cluster`` (its smallest id).

    Unknown ids leave their groups first, so a group still joins the known ids it names.
    """
    named = groups.select(group, F.trim("id").alias("id"))
    known = named.join(ids.select("id").distinct(), "id", "left_semi")
    return connected_components(group_edges(known, group)).select(F.col("node").alias("id"), F.col("label").alias("cluster"))


def pair_groups(pairs: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Pairs as groups of two."""
    name = F.concat_ws("\u0001", F.col(src).cast("string"), F.col(dst).cast("string"))
    return pairs.select(name.alias("group_id"), F.explode(F.array(src, dst)).alias("id"))
