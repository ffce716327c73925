"""Counts, statistics and windows of the bibliographic model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a bridge to a partition: a paper's rows, and pairs, are dealt to as many as keep each near it.
ROWS_A_PART = 500_000


def coauthor_pairs(bridge: DataFrame, pub: str, author: str) -> DataFrame:
    """(a, b, n) of authors a < b with common papers. One equi-join on the paper.

    Rows are counted first: the number of partitions grows with them, so that what a task sorts or sums does not."""
    d = bridge.select(F.col(pub).alias("p"), F.col(author).alias("x")).where("p is not null and x is not null")
    parts = 1 + d.count() // ROWS_A_PART
    d = (d.repartition(parts, "p") if parts > 1 else d).distinct()
    both = d.alias("l").join(d.alias("r"), "p").where("l.x < r.x").select(F.col("l.x").alias("a"), F.col("r.x").alias("b"))
    return (both.repartition(parts, "a", "b") if parts > 1 else both).groupBy("a", "b").agg(F.count("*").alias("n"))


def rank_ranges(df: DataFrame, by: list[Column]) -> DataFrame:
    """Adds first_rank and last_rank of ties. Ranks need a total order: use it on grouped data."""
    w = Window.orderBy(*by)
    return df.withColumn("first_rank", F.rank().over(w).cast("long")).withColumn("last_rank", F.col("first_rank") + F.count("*").over(Window.partitionBy(*[F.col("first_rank")])) - 1)


def top_with_ties(df: DataFrame, group: list[str], value: str, n: int) -> DataFrame:
    return df.withColumn("rank", F.rank().over(Window.partitionBy(*group).orderBy(F.desc(value))).cast("long")).where(F.col("rank") <= n)


def within_budget(df: DataFrame, group: list[str], order: list[str], value: str, budget: float) -> DataFrame:
    """Rows whose running sum in ascending order stays within the budget."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("running", F.sum(value).over(w)).where(F.col("running") <= budget)


def encoded(df: DataFrame, value: str, position: str) -> DataFrame:
    """(value, id): ids from 0 by first position, over distinct values."""
    return df.groupBy(value).agg(F.min(position).alias("first")).withColumn("id", F.row_number().over(Window.orderBy("first", value)).cast("long") - 1)


def runs(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """Adds the number of the consecutive run of equal values."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("new", F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w).cast("long")).drop("new")


def venue_similarity(counts: DataFrame, venue: str, author: str, n: str) -> DataFrame:
    """(v1, v2, relative, slope, residual) of venues that share authors: regression through the origin of counts in v2 on those in v1."""
    c = counts.select(F.col(venue).alias("v"), F.col(author).alias("a"), F.col(n).cast("double").alias("n"))
    size = c.groupBy("v").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("xx"))
    both = c.alias("l").join(c.alias("r"), "a").where("l.v != r.v").groupBy(F.col("l.v").alias("v1"), F.col("r.v").alias("v2")).agg(F.sum("r.n").alias("y"), F.sum(F.col("l.n") * F.col("r.n")).alias("xy"), F.sum(F.col("r.n") * F.col("r.n")).alias("yy"))
    j = both.join(size, both.v1 == size.v)
    slope = F.col("xy") / F.col("xx")
    left = F.sqrt(F.greatest(F.col("yy") - 2 * slope * F.col("xy") + slope * slope * F.col("xx"), F.lit(0.0)) / F.col("xx"))
    return j.select("v1", "v2", (F.col("y") / F.col("total")).alias("relative"), slope.alias("slope"), (left / slope).alias("residual"))


def tfiaf(hits: DataFrame, papers: DataFrame) -> DataFrame:
    """(gram, tf, iaf, tfiaf). hits: gram, author, hit; papers: author, pubs. Authors with few papers count less; grams met once weigh nothing."""
    j = hits.join(papers, "author").withColumn("scale", F.least("pubs", F.lit(3)) / 3)
    g = j.groupBy("gram").agg(F.sum(F.col("hit") * F.col("scale")).alias("h"), F.sum(F.greatest(F.col("hit").cast("double"), F.pow("pubs", F.lit(0.666))) * F.col("scale")).alias("t"), F.sum("scale").alias("a"), F.sum("hit").alias("freq"))
    m = g.agg(F.max("a").alias("most"))
    tf, iaf = F.col("h") / F.col("t"), F.log(F.col("most") / F.col("a")) + 0.5
    once = F.col("freq") == 1
    return g.crossJoin(F.broadcast(m)).select("gram", *[F.when(once, 0.0).otherwise(F.round(x, 3)).alias(n) for n, x in (("tf", tf), ("iaf", iaf), ("tfiaf", tf * iaf))])


def ambiguity_rounds(counts: DataFrame, rounds: int = 20, stop: float = 500) -> DataFrame:
    """(s, g, m): estimates of names (surname s, given name g) by the product of their marginals, kept growing until they settle. One checkpoint a round."""
    at_least = F.greatest("m", F.lit(1.0))
    for k in range(rounds):
        weight = F.col("m") if k == 0 else at_least
        d = counts.withColumn("w", weight)
        total = d.agg(F.sum("w").alias("q"), F.round(F.sum(at_least)).alias("n"))
        s, g = d.groupBy("s").agg(F.sum("w").alias("ps")), d.groupBy("g").agg(F.sum("w").alias("pg"))
        new = d.join(s, "s").join(g, "g").crossJoin(F.broadcast(total)).select("s", "g", F.col("m").alias("old"), F.greatest("m", F.col("ps") / F.col("q") * F.col("pg") / F.col("q") * 1.22 * F.col("n")).alias("m"))
        new = new.checkpoint() if new.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else new.persist()
        moved = new.agg(F.sum(F.abs(F.greatest("m", F.lit(1.0)) - F.greatest("old", F.lit(1.0))))).first()[0]
        counts = new.select("s", "g", "m")
        if moved is None or moved < stop:
            break
    return counts


def slope_without_intercept(df: DataFrame, y: str, x1: str, x2: str) -> DataFrame:
    """(b1, b2) of y = b1 x1 + b2 x2 by normal equations: one pass of sums."""
    a = {n: F.sum(F.col(p) * F.col(q)) for n, p, q in (("s11", x1, x1), ("s12", x1, x2), ("s22", x2, x2), ("t1", x1, y), ("t2", x2, y))}
    s = df.agg(*[v.alias(n) for n, v in a.items()])
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    return s.select(((F.col("t1") * F.col("s22") - F.col("t2") * F.col("s12")) / det).alias("b1"), ((F.col("t2") * F.col("s11") - F.col("t1") * F.col("s12")) / det).alias("b2"))
