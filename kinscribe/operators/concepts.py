"""Weighted concept vectors: terms that are close in a taxonomy merge, greedily and in order, into what subsumes them."""

from __future__ import annotations

import json
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .graph import checkpointed
from .grouped import over_runs

#: Fixed value: nodes nearer to the root than this are too general to merge, or to merge into.
LEAST_DEPTH = 2
#: What is known of a near ancestor.
NEAR = ("ancestor", "steps", "long")


def near_ancestors(inherited: DataFrame, reach: int) -> DataFrame:
    """(node, depth, near) of an inheritance: ancestors at most `reach` steps up, itself included; steps are stretched by the
    share of a count that passes. A node's list is one row."""
    near = inherited.where(F.col("steps") <= reach).select("node", "depth", F.struct("ancestor", "steps", (F.col("steps") / F.col("share")).alias("long")).alias("x"))
    return near.groupBy("node").agg(F.first("depth").alias("depth"), F.sort_array(F.collect_list("x")).alias("near"))


class _Vector:
    """The slots of one vector in order, and an index from ancestors of LEAST_DEPTH, by steps, to the live slots below them.

    Rows hold the terms and those of their ancestors that have LEAST_DEPTH; a node without a row is nearer to the root. near is
    JSON of lists side by side, as Arrow takes much longer to give Python many small structs than the merging takes."""

    def __init__(self, rows: list[dict], reach: int):
        self.reach = reach
        self.depth = {r["node"]: r["depth"] for r in rows}
        self.near = {r["node"]: {a: (k, x) for a, k, x in zip(*(near[c] for c in NEAR))} for r in rows for near in [json.loads(r["near"])]}
        self.deep = {n: [(a, steps) for a, (steps, _) in near.items() if self.depth.get(a, 0) >= LEAST_DEPTH] for n, near in self.near.items()}
        self.weight = {r["node"]: r["weight"] for r in rows if r["weight"] is not None}
        self.slots = sorted(self.weight, key=lambda n: (-self.weight[n], n))
        self.start = list(self.slots)
        self.below = defaultdict(set)
        for i in range(len(self.slots)):
            self.put(i)
        self.barred, self.into = set(), {}

    def put(self, i: int):
        for at in self.deep[self.slots[i]]:
            self.below[at].add(i)

    def drop(self, i: int):
        for at in self.deep[self.slots[i]]:
            self.below[at].discard(i)
        self.slots[i] = None

    def subsumer(self, p: str, q: str):
        """(steps, stretched steps, node) of the closest common ancestor within reach, or None."""
        a, b = self.near[p], self.near[q]
        both = [(a[s][0] + b[s][0], a[s][1] + b[s][1], s) for s in a.keys() & b.keys() if a[s][0] + b[s][0] <= self.reach]
        return min(both) if both else None

    def close(self, i: int, limit: int) -> list[int]:
        """The slots, in order, that have an ancestor of LEAST_DEPTH with i within reach. No other pair can merge, and what bars
        such a pair never changes. Limit 1 bars nothing by weight, so there pairs more than one step apart need no look."""
        far = 1 if limit == 1 else self.reach
        met = (self.below.get((a, there)) for a, here in self.deep[self.slots[i]] for there in range(far - here + 1))
        return sorted(set().union(*filter(None, met)) - {i})

    def partner(self, i: int, limit: int):
        """The first slot that i merges with at this limit, and the node they merge into."""
        p = self.slots[i]
        for j in self.close(i, limit):
            q = self.slots[j]
            if p == q:
                self.drop(j)
                continue
            if self.depth[q] < LEAST_DEPTH or (p, q) in self.barred or (found := self.subsumer(p, q)) is None:
                continue
            low, high = sorted((self.weight[p], self.weight[q]))
            alike = low / high if low > 0 else 0.0
            if self.depth.get(found[2], 0) < LEAST_DEPTH or alike < 1 - 1 / limit:
                self.barred |= {(p, q), (q, p)}
            elif found[0] <= limit:
                return j, found[2]
        return None

    def merge(self):
        for limit in range(1, self.reach + 1):
            for i in range(len(self.slots)):
                while (p := self.slots[i]) is not None and self.depth[p] >= LEAST_DEPTH and (hit := self.partner(i, limit)):
                    j, s = hit
                    q = self.slots[j]
                    total = self.weight[p] + self.weight[q]
                    self.into |= {x: (s, self.near[x][s][1]) for x in (p, q) if x != s}
                    self.drop(i)
                    self.drop(j)
                    self.slots[i], self.weight[s] = s, total
                    self.put(i)
        for term in self.start:
            at, steps = term, 0.0
            while at in self.into:
                at, more = self.into[at]
                steps += more
            yield term, at, steps


def merged_terms(vectors: DataFrame, inherited: DataFrame, reach: int = 1) -> DataFrame:
    """(vector, term, weight, concept, steps): what each term of a vector merges into, and how many stretched steps above it.

    vectors: (vector, term, weight), vector of any type; weights of repeated terms add up. inherited: `taxonomy.inheritance`.
    A vector's terms stand in order of falling weight, then of name. At limit 1, then 2, up to `reach`, each in turn takes
    in the first other term whose closest common subsumer is at most that many steps away (both ways together; ties by
    stretched steps, then name), stands in its place as the subsumer with both weights, and looks again. A pair is barred
    for good once its subsumer is nearer to the root than LEAST_DEPTH or its lesser weight is under 1 - 1 / limit of the
    greater. Terms nearer to the root than LEAST_DEPTH stay; so do terms outside of the taxonomy, null terms excepted,
    which go, as do null vectors and weights. Concepts without weight of their own may appear.

    A term that shares no ancestor of LEAST_DEPTH with another of its vector can't merge and meets no Python. The others go
    vector by vector, one vector's terms and their ancestors at a time; an index leads from ancestors to slots."""
    v = vectors.where("vector is not null and term is not null and weight is not null").groupBy("vector", "term").agg(F.sum(F.col("weight").cast("double")).alias("weight"))
    v = checkpointed(v)
    depths = inherited.where("node = ancestor").select(F.col("node").alias("ancestor"), F.col("depth").alias("high"))
    deep = inherited.join(depths.where(F.col("high") >= LEAST_DEPTH), "ancestor").select(F.col("node").alias("term"), "ancestor")
    above = v.join(deep, "term")
    shared = above.groupBy("vector", "ancestor").agg(F.count("*").alias("n")).where("n > 1").select("vector", "ancestor")
    close = checkpointed(above.join(shared, ["vector", "ancestor"], "left_semi").select("vector", "term", "weight").distinct())
    own = close.select("vector", F.col("term").alias("node"))
    up = close.join(deep, "term").select("vector", F.col("ancestor").alias("node")).unionByName(own).distinct()
    near = near_ancestors(inherited, reach).withColumn("near", F.to_json(F.struct(*(F.col(f"near.{c}").alias(c) for c in NEAR))))
    rows = up.join(close.withColumnRenamed("term", "node"), ["vector", "node"], "left").join(near, "node")
    schema = StructType([v.schema["vector"], StructField("term", StringType()), StructField("concept", StringType()), StructField("steps", DoubleType())])

    def one(held: list[dict]):
        return ((held[0]["vector"], *x) for x in _Vector(held, reach).merge())

    found = over_runs(rows.select("vector", "node", "depth", "weight", "near"), ["vector"], ["node"], one, schema)
    return v.join(found, ["vector", "term"], "left").select("vector", "term", "weight", F.coalesce("concept", "term").alias("concept"), F.coalesce("steps", F.lit(0.0)).alias("steps"))


def compacted(merged: DataFrame) -> DataFrame:
    """(vector, concept, weight, n_terms): a vector with its concepts' weights; terms that merged stay beside, with their own."""
    entry = lambda concept, taken, own: F.struct(F.col(concept).alias("concept"), taken.alias("taken"), own.alias("own"))
    none, weight = F.lit(None).cast(merged.schema["weight"].dataType), F.col("weight")
    itself = F.array(entry("concept", weight, none))
    both = F.when(F.col("concept") != F.col("term"), F.concat(itself, F.array(entry("term", none, weight)))).otherwise(itself)
    g = merged.select("vector", F.inline(both)).groupBy("vector", "concept").agg(F.sum("taken").alias("taken"), F.max("own").alias("own"), F.count("taken").alias("n"))
    return g.select("vector", "concept", F.coalesce("taken", "own").alias("weight"), F.greatest("n", F.lit(1)).alias("n_terms"))
