"""Taxonomies: admission of edges in order, inheritance of ancestors by in-degree, attenuated counts, entropies of tokens."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.strings import capitals, decapitalised
from .graph import checkpointed, components
from .grouped import over_runs

#: Edges of one tangle of cycles that a task decides in order; a larger one is an error, not a cut.
MAX_TANGLE = 500_000


def spelled(edges: DataFrame) -> DataFrame:
    """(parent, child, place, shown): children of one parent that differ in case only are one edge, that of the first.

    shown is the spelling with the most capitals beyond the first letters' own, the first one where none has more than it."""
    caps = capitals(decapitalised(F.col("child")))
    g = edges.groupBy("parent", F.lower("child").alias("low")).agg(F.min(F.struct("place", "child")).alias("first"), F.max(F.struct(caps.alias("caps"), (-F.col("place")).alias("late"), F.col("child"))).alias("best"))
    return g.select("parent", "first.child", "first.place", F.when(F.col("best.caps") > capitals(F.col("first.child")), F.col("best.child")).otherwise(F.col("first.child")).alias("shown"))


def cyclic_core(edges: DataFrame) -> DataFrame:
    """The edges (parent, child, ...) that lie on a cycle or between cycles: the rest can close none.

    Edges from nodes without parents and to nodes without children go, round by round, until nothing does."""
    core, size = checkpointed(edges), None
    while size != (now := core.count()) and now:
        size = now
        inner = core.join(core.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi")
        core = checkpointed(inner.join(core.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").select(core.columns))
    return core


def _closing(rows: list[dict]):
    """The edges of one tangle, in order, that would close a cycle with those admitted before."""
    below = defaultdict(list)
    for r in rows:
        todo, seen = [r["child"]], {r["child"]}
        while todo and r["parent"] not in seen:
            new = [x for x in below[todo.pop()] if x not in seen]
            seen.update(new)
            todo += new
        if r["parent"] in seen:
            yield r["parent"], r["child"]
        else:
            below[r["parent"]].append(r["child"])


def admitted(edges: DataFrame, stop: DataFrame | None = None, barred: DataFrame | None = None) -> DataFrame:
    """(parent, child, place, shown): the edges that a taxonomy takes, offered in order of place, then of names.

    Left out are stopped children (stop: term), barred edges (barred: parent, child), terms of fewer than two letters or
    digits, children that equal their parent but for case, and edges that would close a cycle with edges taken before.
    Null terms are left out; repeated edges count once, at their first place.

    Only cycles depend on order. What can't lie on one is peeled off with joins; a connected tangle of the rest is decided
    by one task, tangles side by side. One beyond MAX_TANGLE edges raises."""
    plain = lambda c: F.regexp_count(c, F.lit("[A-Za-z0-9]")) > 1
    e = edges.select("parent", "child", F.col("place").cast("long").alias("place")).where(plain(F.col("parent")) & plain(F.col("child")) & (F.lower("parent") != F.lower("child")))
    if stop is not None:
        e = e.join(stop.select(F.col("term").alias("child")).distinct(), "child", "left_anti")
    if barred is not None:
        e = e.join(barred.select("parent", "child").distinct(), ["parent", "child"], "left_anti")
    e = checkpointed(spelled(e))
    core = cyclic_core(e.select("parent", "child", "place"))
    if core.isEmpty():
        return e
    part = components(core.select(F.col("parent").alias("a"), F.col("child").alias("b")))
    tangles = checkpointed(core.join(part.withColumnRenamed("node", "parent"), "parent"))
    if not tangles.groupBy("component").count().where(F.col("count") > MAX_TANGLE).isEmpty():
        raise RuntimeError(f"a tangle of cycles has more than {MAX_TANGLE} edges")
    names = StructType([StructField("parent", StringType()), StructField("child", StringType())])
    return e.join(over_runs(tangles, ["component"], ["place", "parent", "child"], _closing, names), ["parent", "child"], "left_anti").select("parent", "child", "place", "shown")


def _ready(arrived: DataFrame) -> DataFrame:
    """Nodes all of whose parents have arrived, with what they inherit: a batch a parent, in order of arrival."""
    turn = Window.partitionBy("node").orderBy("level", "path")
    a = arrived.withColumn("batch", F.row_number().over(turn) - 1)
    own = a.groupBy("node").agg(F.max(F.struct("batch", "level", "path", "place")).alias("last"), (F.min("depth") + 1).alias("depth"))
    each = a.select("node", "batch", F.explode("above").alias("x")).groupBy("node", F.col("x.ancestor").alias("ancestor")).agg(F.min(F.struct("batch", (F.col("x.steps") + 1).alias("steps"), F.col("x.down").alias("down"))).alias("m"))
    batches = each.groupBy("node", F.col("m.batch").alias("batch")).agg(F.max(F.col("m.steps") + F.col("m.down")).alias("reach"), F.collect_list(F.struct("ancestor", "m.steps", "m.down")).alias("new"))
    sets = batches.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("batch", "reach", "new"))).alias("batches"))
    first = F.element_at("batches", 1)["reach"]

    def rows(b: Column) -> Column:
        share = F.least(F.lit(1.0), first / b["reach"])
        return F.transform(b["new"], lambda x: F.struct(x["ancestor"].alias("ancestor"), x["steps"].alias("steps"), x["down"].alias("down"), b["batch"].alias("batch"), share.alias("share")))

    own_row = F.struct(F.col("node").alias("ancestor"), F.lit(0).alias("steps"), F.col("depth").alias("down"), F.lit(0).alias("batch"), F.lit(1.0).alias("share"))
    path = F.concat("last.path", F.array(F.struct(F.col("last.place").alias("place"), F.col("node"))))
    return own.join(sets, "node").select("node", (F.col("last.level") + 1).alias("level"), path.alias("path"), "depth", F.concat(F.flatten(F.transform("batches", rows)), F.array(own_row)).alias("above"))


def inheritance(edges: DataFrame, root: str = "") -> DataFrame:
    """(node, depth, ancestor, steps, batch, share) of a taxonomy without cycles; edges: parent, child, place.

    A root is put above all nodes without parents. A node inherits when its last parent has; parents arrive in the order in
    which a breadth-first queue would finish them (children of one parent by place, then by name), each with a batch of what
    it brings that is new, one step farther than it was there. depth is a node's least distance from the root; share, at
    most 1, is how much of a count passes up in one step: the first batch's reach (steps up and depth there) over that of
    the batch. A node has itself at 0 steps. Edges that hold a cycle raise: admit them first. An empty table gives the root.

    Nodes of one level go side by side. An edge is met once and carries its parent's ancestors as one row, so a hot parent or
    child is a matter of rows that joins and windows split or spill; one row holds one node's ancestors."""
    e = edges.where("parent != child").groupBy("parent", "child").agg(F.min(F.col("place").cast("long")).alias("place"))
    e = checkpointed(e)
    tops = e.select("parent").distinct().join(e.select(F.col("child").alias("parent")).distinct(), "parent", "left_anti")
    e = checkpointed(e.unionByName(tops.select(F.lit(root).alias("parent"), F.col("parent").alias("child"), F.lit(0).cast("long").alias("place"))))
    parents = checkpointed(e.groupBy("child").agg(F.count("*").alias("parents")).withColumnRenamed("child", "node"))
    own = F.array(F.struct(F.lit(root).alias("ancestor"), F.lit(0).alias("steps"), F.lit(0).alias("down"), F.lit(0).alias("batch"), F.lit(1.0).alias("share")))
    none = F.array().cast("array<struct<place:bigint,node:string>>")
    frontier = checkpointed(e.sparkSession.range(1).select(F.lit(root).alias("node"), F.lit(0).alias("level"), none.alias("path"), F.lit(0).alias("depth"), own.alias("above")))
    levels, pending = [frontier], None
    while True:
        out = e.withColumnRenamed("parent", "node").join(frontier, "node")
        arrived = out.select(F.col("child").alias("node"), "level", "path", "depth", "place", F.transform("above", lambda x: F.struct(x["ancestor"].alias("ancestor"), x["steps"].alias("steps"), x["down"].alias("down"))).alias("above"))
        arrived = checkpointed(arrived if pending is None else pending.unionByName(arrived))
        done = arrived.groupBy("node").agg(F.count("*").alias("n")).join(parents, "node").where("n = parents").select("node")
        frontier = checkpointed(_ready(arrived.join(done, "node", "left_semi")))
        if frontier.isEmpty():
            break
        levels.append(frontier)
        pending = arrived.join(frontier.select("node"), "node", "left_anti")
    met = reduce(DataFrame.unionByName, levels)
    if not parents.join(met.select("node"), "node", "left_anti").isEmpty():
        raise ValueError("edges hold a cycle: admit them first")
    return met.select("node", "depth", F.inline("above")).select("node", "depth", "ancestor", "steps", "batch", "share")


def attenuated_counts(counts: DataFrame, inherited: DataFrame) -> DataFrame:
    """(term, freq): counts (term, n) of each term and what passes up to it, share ** steps of it; nulls and unknown terms add nothing."""
    c = counts.groupBy(F.col("term").alias("node")).agg(F.sum("n").alias("n"))
    return c.join(inherited, "node").groupBy(F.col("ancestor").alias("term")).agg(F.sum(F.col("n") * F.pow("share", "steps")).alias("freq"))


def contents(freqs: DataFrame, root: str = "") -> DataFrame:
    """(term, freq, ic): ln of the root's count less ln of the term's, -1 where a term has no count."""
    total = freqs.where(F.col("term") == root).agg(F.max("freq").alias("total"))  # one row
    return freqs.crossJoin(F.broadcast(total)).select("term", "freq", F.when(F.col("freq") > 0, F.log("total") - F.log("freq")).otherwise(-1.0).alias("ic"))


def dominated(freqs: DataFrame, edges: DataFrame, share: float = 0.99, least: float = 1000) -> DataFrame:
    """(term, freq, of_children, child, of_child): terms of at least `least` with several children, one of which has nearly
    all (share) of what the counted ones sum to; of equal ones the first by name. A sign of a wrong edge."""
    e = edges.select("parent", "child").distinct()
    met = e.join(freqs.select(F.col("term").alias("child"), "freq"), "child", "left")
    names = met.groupBy("parent").agg(F.count("*").alias("children"), F.sum("freq").alias("of_children"), F.max("freq").alias("of_child"), F.min(F.when(F.col("freq").isNotNull(), F.struct((-F.col("freq")).alias("f"), F.col("child")))).alias("top"))
    big = names.where((F.col("children") > 1) & (F.col("of_children") * share <= F.col("of_child")))
    return big.join(freqs.where(F.col("freq") >= least).withColumnRenamed("term", "parent"), "parent").select(F.col("parent").alias("term"), "freq", "of_children", F.col("top.child").alias("child"), "of_child")


def token_entropies(postings: DataFrame, inherited: DataFrame, freqs: DataFrame, root: str = "", stop: list[str] = ()) -> DataFrame:
    """(token, entropy, n_terms, n_top) of postings (token, term): how widely a token's use is spread over the taxonomy.

    A posting below another of the same token is subsumed by it; entropy, in bits, sums -p log2 p over the others, p being
    a term's count by the root's. Terms outside of the taxonomy are no postings; stop words and tokens whose top terms
    have no count have 0. Null tokens and terms are left out; repeated postings count once."""
    known = inherited.where("node = ancestor").select(F.col("node").alias("term"))
    p = checkpointed(postings.select("token", "term").where("token is not null").distinct().join(known, "term", "left_semi"))
    up = inherited.where("steps > 0").select(F.col("node").alias("term"), "ancestor")
    below = p.join(up, "term").join(p.select("token", F.col("term").alias("ancestor")), ["token", "ancestor"], "left_semi").select("token", "term").distinct()
    top = p.join(below.withColumn("is_below", F.lit(True)), ["token", "term"], "left").join(freqs.select("term", "freq"), "term", "left")
    total = freqs.where(F.col("term") == root).agg(F.max("freq").alias("total"))  # one row
    share = F.when(F.col("is_below").isNull() & (F.col("freq") > 0), F.col("freq") / F.col("total"))
    bits = F.coalesce(-F.sum(F.col("share") * F.log("share")) / F.log(F.lit(2.0)), F.lit(0.0)) + 0.0
    g = top.crossJoin(F.broadcast(total)).withColumn("share", share).groupBy("token").agg(bits.alias("entropy"), F.count("*").alias("n_terms"), F.count("share").alias("n_top"))
    return g.withColumn("entropy", F.when(F.col("token").isin(list(stop)), 0.0).otherwise(F.col("entropy"))) if stop else g
