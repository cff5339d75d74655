"""Connected components of links as a DataFrame, without collecting links or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import discard, stage


def connected_components(links: DataFrame) -> DataFrame:
    """node and comp, the smallest id reachable, for every node of the links (columns a and b).

    Each round takes the smallest label among a node's neighbours, then the label's own label; labels only fall, and a
    round that changes none ends it. Every round is a written table, so its lineage is one round long.
    """
    both = links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct()
    edges = stage(both, "edges")
    labels = stage(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), "labels")
    while True:
        seen = edges.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(seen, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("comp").alias("far"))
        step = stage(step.join(jump, "next", "left").select("node", "was", F.least("next", F.coalesce("far", "next")).alias("comp")), "labels")
        changed = step.where("comp <> was").limit(1).count()
        discard(links.sparkSession, labels)
        labels = step.select("node", "comp")
        if not changed:
            discard(links.sparkSession, edges)
            return labels


def joined_components(comps: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, comp) of earlier links together with more links (a, b): only their components are joined."""
    ends = [comps.select(F.col("node").alias(x), F.col("comp").alias(f"comp_{x}")) for x in ("a", "b")]
    named = links.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b"))
    named = stage(named.where("a <> b").distinct(), "joins")
    some = named.limit(1).count()
    up = connected_components(named) if some else None
    discard(links.sparkSession, named)
    if up is None:
        return comps
    up = up.select(F.col("node").alias("was"), F.col("comp").alias("now"))
    # what was no node of a link before is a component of its own
    moved = comps.join(up, F.col("comp") == F.col("was"), "left").select("node", F.coalesce("now", "comp").alias("comp"))
    new = up.join(comps, F.col("was") == F.col("node"), "left_anti").select(F.col("was").alias("node"), F.col("now").alias("comp"))
    return stage(moved.unionByName(new), "components")
