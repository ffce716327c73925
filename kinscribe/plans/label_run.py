"""From label files to scores: names put in order, papers of each focus merged by coauthors, pairs scored against identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merging as M
from ..operators import name_order as O
from ..operators.clustering import pair_scores
from ..operators.graph import checkpointed
from ..sources.records import read_labels, read_words


def cluster_labels(labels: DataFrame, syllables: DataFrame, other_syllables: DataFrame | None = None, threshold: float = 0.03, pair_surnames: list[str] | None = None) -> DataFrame:
    """(focus, pub, identity, cluster) of read_labels' records with an identity; pub follows the file's order.

    Focus names in syllables merge by Jaccard similarity of coauthors, others by any coauthor in common. Papers whose
    names are in mixed order, or that don't have the focus among their standard names, stay clusters of their own."""
    pubs = checkpointed(labels.where("identity is not null").select("focus", (F.shiftleft(F.col("cluster").cast("long"), 20) + F.col("record")).alias("pub"), "identity", "authors"))
    rows = pubs.select("focus", "pub", F.explode("authors").alias("name")).withColumn("key", F.concat_ws("\t", "focus", F.col("pub").cast("string")))
    votes = checkpointed(O.order_votes(rows, "key", "name", syllables, other_syllables, pair_surnames))
    named = O.standard_names(rows, "key", "name", votes, syllables, other_syllables, pair_surnames).join(votes.select("key", "verdict"), "key")
    named = named.where("verdict >= 0").groupBy("focus", "pub").agg(F.collect_list("standard").alias("names")).where(F.array_contains("names", F.col("focus")))
    named = checkpointed(named.select("focus", "pub", F.filter("names", lambda x: x != F.col("focus")).alias("partners")))
    own = checkpointed(O.known_names(named.select(F.col("focus").alias("name")), syllables, other_syllables, pair_surnames).select(F.col("name").alias("focus")))
    merged = M.merge_in_order(named.join(own, "focus", "left_semi"), M.JaccardRule(threshold)).unionByName(M.merge_in_order(named.join(own, "focus", "left_anti"), M.SharedRule(1)))
    return pubs.select("focus", "pub", "identity").join(merged, ["focus", "pub"], "left").withColumn("clustered", F.col("cluster").isNotNull()).withColumn("cluster", F.coalesce("cluster", "pub"))


def label_scores(clustered: DataFrame) -> DataFrame:
    """(focus, right, predicted, actual, p, r, f1, clusters, pubs) of cluster_labels."""
    sizes = clustered.groupBy("focus").agg(F.count_distinct(F.when(F.col("clustered"), F.col("cluster"))).alias("clusters"), F.count("*").alias("pubs"))
    return pair_scores(clustered, ["focus"], "cluster", "identity").join(sizes, "focus")


def run_labels(spark: SparkSession, folder: str, syllables: str, other_syllables: str | None = None, threshold: float = 0.03) -> DataFrame:
    """label_scores of a folder of label files; syllables: files of one syllable a line."""
    other = read_words(spark, other_syllables) if other_syllables else None
    return label_scores(cluster_labels(read_labels(spark, folder), read_words(spark, syllables), other, threshold))
