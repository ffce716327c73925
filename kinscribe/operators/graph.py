"""Taxonomy closure, subsumers, information content, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's shared folder, which a cluster names in spark.checkpoint.dir; a temporary one where executors are on this machine and none is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and sc.master.split("[")[0] != "local":
            raise RuntimeError("a cluster has to name a shared folder in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df, written as parquet to the shared folder and read from there: lineage ends here, and plans know its size."""
    at = f"{checkpoint_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def ancestors(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, ancestor, depth) with the least depth; cycles end at what is known. edges: parent, child.

    Goes on until nothing is new; where max_depth is given and ancestors lie beyond it, it raises."""
    e = edges.select("parent", "child").where("parent != child").distinct()
    known = frontier = checkpointed(e.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("depth")))
    for depth in count(2):
        up = e.withColumnsRenamed({"child": "ancestor", "parent": "higher"})
        step = frontier.join(up, "ancestor").select("node", F.col("higher").alias("ancestor")).where("node != ancestor").distinct()
        frontier = checkpointed(step.join(known, ["node", "ancestor"], "left_anti").withColumn("depth", F.lit(depth).cast("long")))
        if frontier.isEmpty():
            return known
        if max_depth is not None and depth > max_depth:
            raise RuntimeError(f"ancestors lie beyond max_depth={max_depth}")
        known = checkpointed(known.unionAll(frontier))


def least_common_subsumer(closure: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, lcs, depth): the shared ancestor of least summed depth, then of least name."""
    x, y = closure.withColumnsRenamed({"node": "a", "depth": "da"}), closure.withColumnsRenamed({"node": "b", "depth": "db"})
    m = pairs.join(x, "a").join(y, ["b", "ancestor"]).groupBy("a", "b").agg(F.min(F.struct((F.col("da") + F.col("db")).alias("depth"), F.col("ancestor"))).alias("m"))
    return m.select("a", "b", F.col("m.ancestor").alias("lcs"), F.col("m.depth").alias("depth"))


def information_content(freq: DataFrame, closure: DataFrame) -> DataFrame:
    """(term, freq, ic): frequencies of terms with all they subsume; ic = ln(total) - ln(freq), -1 where nothing was met."""
    own = freq.select(F.col("term"), F.col("freq"))
    up = own.join(closure, own.term == closure.node).select(F.col("ancestor").alias("term"), "freq")
    total = own.agg(F.sum("freq").alias("mc"))
    return own.unionAll(up).groupBy("term").agg(F.sum("freq").alias("freq")).crossJoin(F.broadcast(total)).select("term", "freq", F.when(F.col("freq") > 0, F.round(F.log("mc") - F.log("freq"), 4)).otherwise(-1.0).alias("ic"))


def _roots(up: DataFrame) -> DataFrame:
    """(node, up) with the root of each node's tree, of pointers (node, up) whose only cycles are pairs; their lesser end is the root."""
    far = lambda up: up.select(F.col("node").alias("up"), F.col("up").alias("far"))
    up = stored(up.join(far(up), "up").select("node", F.when(F.col("far") == F.col("node"), F.least("node", "up")).otherwise(F.col("up")).alias("up")))
    while True:
        new = stored(up.join(far(up), "up").select("node", F.col("far").alias("up"), (F.col("far") != F.col("up")).alias("moved")))
        up = new.select("node", "up")
        if new.where("moved").isEmpty():
            return up


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component), the smallest node reachable over edges (a, b); nodes are numbered first, so any type that orders will do.

    Each round every node points to its smallest neighbour and the trees that this makes become one node each, so that
    nodes halve at least and only edges between trees are left for the next round. Where rounds is given and too few, it raises."""
    e = stored(edges.select("a", "b").where("a != b").distinct())
    nodes = stored(e.select(F.col("a").alias("node")).unionAll(e.select("b")).distinct().withColumn("id", F.monotonically_increasing_id()))
    ends = lambda e, of, node, to: e.join(of.select(F.col(node).alias("a"), F.col(to).alias("x")), "a").join(of.select(F.col(node).alias("b"), F.col(to).alias("y")), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    e, steps = stored(ends(e, nodes, "node", "id")), []
    while not e.isEmpty():
        if rounds is not None and len(steps) >= rounds:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        steps.append(_roots(stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")))))
        e = stored(ends(e, steps[-1], "node", "up").where("a != b").distinct())
    root = nodes.select(F.col("id").alias("node"), F.col("id").alias("up")).limit(0) if not steps else steps.pop()
    while steps:
        last = root.select(F.col("node").alias("up"), F.col("up").alias("root"))
        root = stored(steps.pop().join(last, "up", "left").select("node", F.coalesce("root", "up").alias("up")))
    named = stored(nodes.join(root.select(F.col("node").alias("id"), F.col("up").alias("root")), "id").select("node", "root"))
    return named.join(named.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component")
