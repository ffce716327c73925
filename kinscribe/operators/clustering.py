"""Two-stage clustering of the papers of one name, and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import pairs_of
from .graph import components, stored


def by_shared_partner(bridge: DataFrame, focus: str, pub: str, partner: str) -> DataFrame:
    """(focus, pub, cluster): papers of one focus that a chain of common partners joins, named by the least of them.

    Partners, not papers, are what is linked: those of a paper to its least one. A paper then goes where its least partner went."""
    d = bridge.select(F.col(focus).alias("focus"), F.col(pub).alias("pub"), F.col(partner).alias("partner")).distinct()
    d = stored(d.withColumn("lead", F.min("partner").over(Window.partitionBy("focus", "pub"))))
    papers, linked = d.where("partner <=> lead").select("focus", "pub", "lead"), "focus is not null and pub is not null and lead is not null"
    key = lambda c: F.struct(F.col("focus"), F.col(c).alias("partner"))
    parts = components(d.where(linked).where("lead != partner").select(key("lead").alias("a"), key("partner").alias("b")))
    leads = papers.where(linked).groupBy(key("lead").alias("node")).agg(F.min("pub").alias("low"))
    leads = stored(leads.join(parts, "node", "left").select("node", "low", F.coalesce("component", "node").alias("component")))
    least = leads.groupBy("component").agg(F.min("low").alias("cluster"))
    low = leads.join(least, "component").select(F.col("node.focus").alias("focus"), F.col("node.partner").alias("lead"), "cluster")
    return papers.join(low, ["focus", "lead"], "left").select("focus", "pub", F.when(F.col("pub").isNotNull(), F.coalesce("cluster", "pub")).alias("cluster"))


def agglomerate(scores, n: int, stop_at: int, threshold: float, merge) -> list[list[int]]:
    """Best pair first, the earliest of equals, until a threshold or a number of clusters; only pairs of the merged cluster are scored again."""
    clusters, at = {k: [k] for k in range(n)}, {}
    for i in range(n):
        for j in range(i + 1, n):
            at[i, j] = scores(i, j)
    while len(clusters) > stop_at and at:
        (i, j), best = max(at.items(), key=lambda x: (x[1], -x[0][0], -x[0][1]))
        if best < threshold:
            break
        clusters[i] += clusters.pop(j)
        merge(i, j)
        at = {k: v for k, v in at.items() if j not in k}
        for k in clusters:
            if k != i:
                at[min(i, k), max(i, k)] = scores(min(i, k), max(i, k))
    return list(clusters.values())


def pair_scores(assigned: DataFrame, group: list[str], cluster: str, truth: str) -> DataFrame:
    """(group, right, predicted, actual, p, r, f1) of pairs: contingency counts, not pairs, are what is grouped."""
    cell = stored(assigned.groupBy(*group, cluster, truth).agg(F.count("*").alias("n")))
    right = cell.groupBy(*group).agg(F.sum(pairs_of(F.col("n"))).alias("right"))
    side = lambda c, name: cell.groupBy(*group, c).agg(F.sum("n").alias("n")).groupBy(*group).agg(F.sum(pairs_of(F.col("n"))).alias(name))
    j = right.join(side(cluster, "predicted"), group).join(side(truth, "actual"), group)
    p, r = F.try_divide("right", "predicted"), F.try_divide("right", "actual")
    return j.select(*group, *[F.col(c).cast("long").alias(c) for c in ("right", "predicted", "actual")], F.round(p, 4).alias("p"), F.round(r, 4).alias("r"), F.round(F.try_divide(2 * p * r, p + r), 4).alias("f1"))
