"""Order-dependent merging of one name's papers by shared partners.

A cluster looks for the first other one, in order of position, that it may join, takes it in and looks again from the
start; what it has taken in is gone. The result depends on order, so a cluster's rule runs over a list. But papers that
no chain of shared partners links can never meet: a focus beyond SMALL_FOCUS rows is first split into such blocks by
distributed components, and a block, not a focus, is what one task holds. Within a block an index of partners names the clusters that share
one, so that others are never compared.

Clusters are named by the paper they grew from: the one whose position they keep. Order is that of `pub`.

Defined cases: papers without partners (null or empty) are clusters of their own; null partners are ignored; repeated
rows of a paper are one paper with their partners together; an empty table gives no row.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.numbers import sampling_ratio
from .clustering import by_shared_partner
from .graph import stored
from .grouped import over_runs


#: Rows (papers times partners) up to which a focus is one block without a look at its chains.
SMALL_FOCUS = 20_000


def merged_in_order(sets: list[Counter], may_join: Callable[[Counter, Counter, list], bool]) -> list[int]:
    """For each set the position that its cluster keeps. may_join gets two sets and what they share, at least one."""
    sets, where = [Counter(s) for s in sets], defaultdict(set)
    kept = list(range(len(sets)))
    for k, s in enumerate(sets):
        for x in s:
            where[x].add(k)
    for i in range(len(sets)):
        moved = kept[i] == i
        while moved:
            moved = False
            for j in sorted(set().union(*(where[x] for x in sets[i])) - {i}):
                if may_join(sets[i], sets[j], [x for x in sets[j] if x in sets[i]]):
                    for x in sets[j]:
                        where[x].discard(j)
                        where[x].add(i)
                    sets[i] += sets[j]
                    sets[j], kept[j], moved = Counter(), i, True
                    break
    for k in range(len(kept)):
        while kept[kept[k]] != kept[k]:
            kept[k] = kept[kept[k]]
    return kept


def jaccard(a: Counter, b: Counter) -> float:
    """Of the kinds in both; what is UNKNOWN in one is never that of the other."""
    if a.keys().isdisjoint(b.keys()):
        return 0.0
    known = lambda s: s.keys() - {"UNKNOWN"}
    both = len(known(a) & known(b))
    whole = len(known(a) | known(b)) + ("UNKNOWN" in a) + ("UNKNOWN" in b)
    return both / whole if whole else 0.0


@dataclass(frozen=True)
class SharedRule:
    """Clusters join that share at least so many partners."""

    least: int = 1

    def __call__(self, a, b, shared, about=None):
        return len(shared) >= self.least


@dataclass(frozen=True)
class JaccardRule:
    """Clusters join that share a partner and are so similar."""

    threshold: float = 0.03

    def __call__(self, a, b, shared, about=None):
        return jaccard(a, b) >= self.threshold


@dataclass(frozen=True)
class EvidenceRule:
    """Clusters join where one's partners lie within the other's, where a shared partner's error is tolerable, or where
    the smaller one looks like a sample of the larger. about: (error, whether it counts for the likelihood) by partner."""

    tolerance: float = 0.05
    least_ratio: float = 1.0
    prior: float = 0.5
    reduction: float = 0.3334

    def __call__(self, a, b, shared, about=None):
        if len(shared) in (len(a), len(b)) or min(about[x][0] for x in shared) <= self.tolerance:
            return True
        a, b = (self.counting(s, about) for s in (a, b))
        return len(a) > 1 and len(b) > 1 and sampling_ratio(a, b, self.prior, 0.0, self.prior, self.reduction) >= self.least_ratio

    @staticmethod
    def counting(s, about):
        left = {x: n for x, n in s.items() if about[x][1]}
        return left if len(left) > 2 else dict(s)


def with_blocks(pubs: DataFrame, extra: DataFrame | None = None, small_focus: int = SMALL_FOCUS) -> DataFrame:
    """pubs (focus, pub, partner) with `block`: the least paper that a chain of shared partners (or of extra ones)
    reaches, or null for a focus of at most small_focus rows, which stays whole."""
    large = pubs.groupBy("focus").agg(F.count("*").alias("n")).where((F.col("n") > small_focus) & F.col("focus").isNotNull()).select("focus")
    if large.isEmpty():
        return pubs.withColumn("block", F.lit(None).cast("long"))
    links = pubs.select("focus", "pub", "partner").where("partner is not null")
    links = (links if extra is None else links.unionByName(extra)).join(large, "focus", "left_semi")
    blocks = by_shared_partner(links, "focus", "pub", "partner").select(F.col("focus").alias("__f"), F.col("pub").alias("__p"), F.col("cluster").alias("__b"))
    j = pubs.join(blocks, (pubs["focus"] == blocks["__f"]) & (pubs["pub"] == blocks["__p"]), "left").join(large.withColumn("__large", F.lit(True)), "focus", "left")
    return j.withColumn("block", F.when(F.col("__large"), F.coalesce("__b", "pub"))).drop("__f", "__p", "__b", "__large")


def per_paper(rows: DataFrame) -> DataFrame:
    """One row per paper of rows (focus, block, pub, partner, error, counts)."""
    entry = F.when(F.col("partner").isNotNull(), F.struct("partner", "error", "counts"))
    return rows.groupBy("focus", "block", "pub").agg(F.sort_array(F.collect_list(entry)).alias("p")).select("focus", "block", "pub", F.col("p.partner").alias("names"), F.col("p.error").alias("errors"), F.col("p.counts").alias("counts"))


def meeting(rows: DataFrame) -> DataFrame:
    """(focus, pub, meets) of rows (focus, pub, partner): whether a paper shares a partner with another one of its focus."""
    pubs = rows.where("partner is not null").groupBy("focus", "partner").agg(F.min("pub").alias("low"), F.max("pub").alias("high"), F.count("pub").alias("n"), F.count("*").alias("all"))
    met = pubs.where("low != high or (n > 0 and n < all)").select(F.col("focus").alias("__f"), F.col("partner").alias("__n"), F.lit(True).alias("meets"))
    flagged = rows.join(met, F.col("focus").eqNullSafe(F.col("__f")) & (F.col("partner") == F.col("__n")), "left")
    return flagged.groupBy("focus", "pub").agg(F.coalesce(F.max("meets"), F.lit(False)).alias("meets"))


def merge_in_order(pubs: DataFrame, rule, evidence: DataFrame | Callable[[DataFrame], DataFrame] | None = None, small_focus: int = SMALL_FOCUS) -> DataFrame:
    """(focus, pub, cluster) of pubs (focus string, pub long, partners array<string>); evidence: (focus, partner, error, counts),
    see partner_evidence, or what gives that for pairs (focus, partner).

    A paper that shares no partner with another one of its focus is a cluster of its own and meets no Python."""
    every = stored(pubs.select("focus", "pub", F.explode_outer("partners").alias("partner")))
    who = stored(meeting(every))
    meet = who.where("meets").select(F.col("focus").alias("__f"), F.col("pub").alias("__p"))
    rows = stored(every.join(meet, F.col("focus").eqNullSafe(F.col("__f")) & F.col("pub").eqNullSafe(F.col("__p")), "left_semi"))
    blocks = with_blocks(rows, small_focus=small_focus)
    if evidence is not None:
        about = evidence(rows.select("focus", "partner")) if callable(evidence) else evidence
        blocks = blocks.join(about.select("focus", "partner", "error", "counts"), ["focus", "partner"], "left")
    else:
        blocks = blocks.withColumns({"error": F.lit(None).cast("double"), "counts": F.lit(None).cast("boolean")})

    def run(block):
        about = {n: (e or 0.0, c is None or c) for x in block for n, e, c in zip(x["names"], x["errors"], x["counts"])}
        kept = merged_in_order([Counter(x["names"]) for x in block], lambda a, b, shared: rule(a, b, shared, about))
        return [(x["focus"], x["pub"], block[k]["pub"]) for x, k in zip(block, kept)]

    merged = over_runs(per_paper(blocks), ["focus", "block"], ["pub"], run, StructType.fromDDL("focus string, pub long, cluster long"))
    return who.where("not meets").select("focus", "pub", F.col("pub").alias("cluster")).unionByName(merged)


def overestimated(ambiguity):
    """An ambiguity (null: the name isn't known), raised the more the smaller it is, at least 1."""
    raised = F.when(ambiguity > 200, ambiguity).when(ambiguity > 50, ambiguity * 1.5).otherwise(ambiguity * 2.5)
    return F.when(ambiguity.isNull(), 0.0).otherwise(F.greatest(raised, F.lit(1.0)))


def partner_evidence(pairs: DataFrame, partner_counts: DataFrame, ambiguities: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """(focus, partner, error, counts) of the distinct pairs (focus, partner).

    error: the chance that two clusters which share the partner are nevertheless two people; 0 where a name isn't known.
    counts: whether the partner is rare enough for the likelihood ratio. partner_counts: (name, n) partners of a name;
    ambiguities: (name, ambiguity), whose sum over all names is the total."""
    n, m = partner_counts.toDF("name", "n"), ambiguities.toDF("name", "m")
    total = m.agg(F.sum("m").alias("total"))  # one row
    known = n.join(m, "name", "full_outer")
    of = lambda key, end: known.select(F.col("name").alias(key), F.col("n").alias(f"n_{end}"), F.col("m").alias(f"m_{end}"))
    p = pairs.select("focus", "partner").distinct()
    p = p.join(of("focus", "f"), "focus", "left").join(of("partner", "p"), "partner", "left").crossJoin(F.broadcast(total))
    one = (F.col("n_p") + 1) * overestimated(F.col("m_f")) / F.col("total") / 2
    two = (F.col("n_f") + 1) * overestimated(F.col("m_p")) / F.col("total") / 2
    known = F.col("m_f").isNotNull() & F.col("n_f").isNotNull() & F.col("n_p").isNotNull()
    most_partners = F.round(F.try_divide(F.lit(2 * tolerance) * F.col("total"), overestimated(F.col("m_f"))) - 1, 3)
    most_ambiguity = F.when(F.coalesce(F.col("n_f"), F.lit(0)) == 0, 0.0).otherwise(F.round(2 * tolerance * F.col("total") / (F.col("n_f") + 1), 3))
    counts = F.col("n_p").isNull() | ((most_partners.isNull() | (F.col("n_p") <= most_partners)) & (overestimated(F.col("m_p")) <= most_ambiguity))
    return p.select("focus", "partner", F.when(known, F.greatest(one, two)).otherwise(0.0).alias("error"), counts.alias("counts"))


def seeds_in_order(free: list[Counter], seeds: list[Counter]) -> tuple[list[int | None], list[int]]:
    """(seed of each free set or None, position that each free set's cluster keeps).

    Round by round the pair that shares most partners, two at least, joins; of equals the first free set, then its first
    seed. What is left joins each other by two shared partners."""
    seeds, taken = [Counter(s) for s in seeds], [None] * len(free)
    where = defaultdict(set)
    for k, s in enumerate(seeds):
        for x in s:
            where[x].add(k)
    shared = {}
    for i, s in enumerate(free):
        shared[i] = Counter(k for x in s for k in where[x])
    while True:
        best = max(((n, -i, -k) for i, c in shared.items() for k, n in c.items()), default=(0, 0, 0))
        if best[0] < 2:
            break
        i, k = -best[1], -best[2]
        taken[i] = k
        del shared[i]
        new = [x for x in free[i] if x not in seeds[k]]
        seeds[k] += free[i]
        for other, c in shared.items():
            c[k] += sum(x in free[other] for x in new)
    left = [i for i, k in enumerate(taken) if k is None]
    kept = list(range(len(free)))
    for at, to in zip(left, merged_in_order([free[i] for i in left], SharedRule(2))):
        kept[at] = left[to]
    return taken, kept


def merge_into_seeds(pubs: DataFrame, seeds: DataFrame, small_focus: int = SMALL_FOCUS) -> DataFrame:
    """(focus, pub, seed, cluster) of pubs (focus, pub, partners); seeds: (focus, pub, seed long), papers known to belong together.

    seed is null where a paper joined none; cluster is then the paper that its cluster grew from, else the least paper of the seed."""
    given = seeds.select("focus", "pub", "seed").dropDuplicates(["focus", "pub"])
    own = F.concat(F.lit("\x00seed "), F.col("seed").cast("string")).alias("partner")
    rows = with_blocks(pubs.select("focus", "pub", F.explode_outer("partners").alias("partner")), given.select("focus", "pub", own), small_focus)
    rows = rows.join(given, ["focus", "pub"], "left")
    papers = rows.groupBy("focus", "block", "pub").agg(F.first("seed").alias("seed"), F.sort_array(F.collect_list("partner")).alias("names"))

    def run(block):
        numbers = sorted({x["seed"] for x in block if x["seed"] is not None})
        held, low = {n: Counter() for n in numbers}, {}
        for x in block:
            if x["seed"] is not None:
                held[x["seed"]].update(x["names"])
                low.setdefault(x["seed"], x["pub"])
        free = [x for x in block if x["seed"] is None]
        taken, kept = seeds_in_order([Counter(x["names"]) for x in free], [held[n] for n in numbers])
        out = [(x["focus"], x["pub"], x["seed"], low[x["seed"]]) for x in block if x["seed"] is not None]
        for x, t, to in zip(free, taken, kept):
            out.append((x["focus"], x["pub"], None, free[to]["pub"]) if t is None else (x["focus"], x["pub"], numbers[t], low[numbers[t]]))
        return out

    return over_runs(papers, ["focus", "block"], ["pub"], run, StructType.fromDDL("focus string, pub long, seed long, cluster long"))


def greedy_jaccard(sets: list[set], threshold: float) -> list[int]:
    """Cluster numbers, in order of the positions that clusters keep, of sets merged in order."""
    kept = merged_in_order([Counter(s) for s in sets], JaccardRule(threshold))
    number = {k: n for n, k in enumerate(sorted(set(kept)))}
    return [number[k] for k in kept]


def stage_one(pubs: DataFrame, threshold: float = 0.03) -> DataFrame:
    """(focus, pub, cluster) by merge_in_order with the Jaccard rule; clusters are numbered from 0 in each focus."""
    merged = merge_in_order(pubs, JaccardRule(threshold))
    numbers = merged.select("focus", "cluster").distinct().groupBy("focus").agg(F.sort_array(F.collect_list("cluster")).alias("all"))
    return merged.join(numbers, "focus").select("focus", "pub", (F.array_position("all", F.col("cluster")) - 1).alias("cluster"))
