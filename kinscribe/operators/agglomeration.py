"""Stage two: clusters of one name's papers join by what their titles, venues and partners have in common, best pair first.

A cluster is a sparse vector of title terms (each with its years), a map of venues and a set of partners. Vectors of a
joined cluster follow from sums, so nothing is read again. Pairs wait in a heap under the numbers that their clusters
had; a pair whose cluster has joined since is passed over, and only the new cluster is scored anew. An index of terms
names the clusters that share one; others can only matter where one of the two has no terms.

The best pair is chosen among all pairs of a name and the number of clusters left may stop it, so a name is what one
task holds, as vectors of its stage-one clusters; names are dealt and streamed one after the other.

Defined cases: papers without terms have the prior of empty vectors, a null venue is UNKNOWN, a null year spans nothing;
a term without a weight counts nothing; repeated rows of a paper count twice; an empty table gives no row.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from dataclasses import dataclass
from math import log, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.numbers import sampling_ratio
from .grouped import over_runs
from .merging import jaccard

#: Terms kept per paper of a cluster, at least and at most; the largest prior of an empty vector; the
#: least venue factors; years without a discount, the discount of each further one, and years beyond which nothing counts.
KEPT, KEPT_LEAST, KEPT_MOST, EMPTY_MOST = 3, 20, 100, 0.5
VENUE_RATIO_LEAST, VENUE_JACCARD_LEAST = 0.1, 0.003
YEARS_FREE, YEAR_DISCOUNT, YEARS_MOST = 2, 0.7, 6


@dataclass(frozen=True)
class Joining:
    """threshold: least similarity of a pair. least_clusters: where to stop. venue_threshold: the Jaccard similarity of
    venues that counts as 1; without one the likelihood ratio of venues is the factor."""

    threshold: float = 0.2
    least_clusters: int = 1
    venue_threshold: float | None = 0.04


class Cluster:
    """Sums over the papers of a cluster."""

    def __init__(self):
        self.size, self.venues, self.partners = 0, Counter(), set()
        self.sums: dict[str, list] = {}  # term: weight, papers, first and last year

    def add(self, size: int, sums: dict, venues: Counter, partners: set) -> None:
        self.size += size
        self.venues += venues
        self.partners |= partners
        for term, (w, c, first, last) in sums.items():
            x = self.sums.setdefault(term, [0.0, 0, first, last])
            x[0] += w
            x[1] += c
            x[2] = min((y for y in (x[2], first) if y is not None), default=None)
            x[3] = max((y for y in (x[3], last) if y is not None), default=None)

    def vector(self) -> dict[str, tuple]:
        """term: weight, first and last year; the heaviest terms, of equals the first by name."""
        by = max(1.0, log(self.size)) if self.size else 1.0
        all_ = {t: (w / (sqrt(c) * by), first, last) for t, (w, c, first, last) in self.sums.items()}
        most = min(max(KEPT * self.size, KEPT_LEAST), KEPT_MOST)
        return dict(sorted(all_.items(), key=lambda x: (-x[1][0], x[0]))[:most])


def year_factor(a: tuple, b: tuple) -> float:
    """For two (weight, first year, last year)."""
    if a[1] is None or b[1] is None:
        return 1.0
    gap = max(b[1] - a[2], a[1] - b[2], 0)
    return 0.0 if gap > YEARS_MOST else YEAR_DISCOUNT ** max(gap - YEARS_FREE, 0)


def venue_factor(a: Cluster, b: Cluster, how: Joining) -> float:
    if how.venue_threshold is None:
        return sampling_ratio(a.venues, b.venues, floor=VENUE_RATIO_LEAST)
    return max(jaccard(a.venues, b.venues), VENUE_JACCARD_LEAST) / how.venue_threshold


def similarity(a: Cluster, b: Cluster, va: dict, vb: dict, weights: dict[str, float], boosts: dict[str, float], how: Joining, venues: float | None = None) -> float:
    """Of two clusters with their vectors: shared terms, times the venues' factor, times the strongest shared partner's."""
    prior = min(how.threshold / 2, EMPTY_MOST)
    if not va or not vb:
        score = prior
    else:
        score = sum(weights.get(t, 0.0) * va[t][0] * vb[t][0] * year_factor(va[t], vb[t]) for t in va if t in vb)
        score = max(score, prior) if score > 0 else score
    venues = venue_factor(a, b, how) if venues is None else venues
    return score * venues * max((boosts.get(x, 1.0) for x in a.partners & b.partners), default=1.0)


def joined(clusters: list[Cluster], weights: dict[str, float], boosts: dict[str, float], how: Joining) -> list[int]:
    """For each cluster the position that its final cluster keeps, the first of the two at each joining."""
    kept, alive, number = list(range(len(clusters))), set(range(len(clusters))), list(range(len(clusters)))
    vectors = [c.vector() for c in clusters]
    holders, empty, heap = defaultdict(set), set(), []
    prior, boost = min(how.threshold / 2, EMPTY_MOST), max(boosts.values(), default=1.0)
    sizes = [(0.0, 0.0)] * len(clusters)  # what bounds a vector's products: its weighted sum and its largest value

    def note(k):
        for t in vectors[k]:
            holders[t].add(k)
        if not vectors[k]:
            empty.add(k)

    def score(k, others):
        """Pairs that may reach the threshold; others never join."""
        v = vectors[k].items()
        sizes[k] = (sum(abs(weights.get(t, 0.0)) * x[0] for t, x in v), max((x[0] for _, x in v), default=0.0))
        for m in others:
            i, j = min(k, m), max(k, m)
            venues = venue_factor(clusters[i], clusters[j], how)
            most = max(min(sizes[i][0] * sizes[j][1], sizes[j][0] * sizes[i][1]) * (1 + 1e-9), prior)
            if most * venues * boost * (1 + 1e-9) < how.threshold:
                continue
            s = similarity(clusters[i], clusters[j], vectors[i], vectors[j], weights, boosts, how, venues)
            if s > 0 and s >= how.threshold:
                heapq.heappush(heap, (-s, i, j, number[i], number[j]))

    for k in sorted(alive):
        near = set().union(*(holders[t] for t in vectors[k])) | empty if vectors[k] else set(range(k))
        score(k, near)
        note(k)
    while heap and len(alive) > how.least_clusters:
        s, i, j, a, b = heapq.heappop(heap)
        if number[i] != a or number[j] != b:
            continue
        if -s < how.threshold:
            break
        for t in (*vectors[i], *vectors[j]):
            holders[t] -= {i, j}
        empty -= {i, j}
        alive.discard(j)
        clusters[i].add(clusters[j].size, clusters[j].sums, clusters[j].venues, clusters[j].partners)
        vectors[i], number[j], kept[j] = clusters[i].vector(), -1, i
        number[i] = max(number) + 1
        near = (set().union(*(holders[t] for t in vectors[i])) | empty if vectors[i] else alive) - {i}
        score(i, near)
        note(i)
    for k in range(len(kept)):
        while kept[kept[k]] != kept[k]:
            kept[k] = kept[kept[k]]
    return kept


def agglomerate_papers(papers: DataFrame, term_weights: DataFrame, how: Joining = Joining(), evidence: DataFrame | None = None) -> DataFrame:
    """(focus, pub, cluster) of papers (focus string, pub long, cluster long, terms array<string>, venue, year int, partners array<string>).

    cluster: of stage one; clusters stand in that order, and the first of two names what they make. A term counts 1 in a
    paper. term_weights: (term, weight). evidence: (focus, partner, error) as merging.partner_evidence gives it; a shared
    partner multiplies by 1 / (2 * error), where that is over 1 and the error is known."""
    weights = term_weights.toDF("term", "weight").groupBy("term").agg(F.max("weight").alias("weight"))
    terms = papers.select("focus", "pub", F.explode(F.array_distinct("terms")).alias("term")).distinct().join(weights, "term", "left")
    terms = terms.groupBy("focus", "pub").agg(F.sort_array(F.collect_list(F.struct("term", F.coalesce("weight", F.lit(0.0)).alias("weight")))).alias("entries"))
    rows = papers.select("focus", "pub", "cluster", "venue", "year", "partners").join(terms, ["focus", "pub"], "left")
    if evidence is not None:
        met = papers.select("focus", "pub", F.explode("partners").alias("partner")).distinct().join(evidence.where("error > 0").select("focus", "partner", "error"), ["focus", "partner"])
        met = met.groupBy("focus", "pub").agg(F.sort_array(F.collect_list(F.struct("partner", "error"))).alias("known"))
        rows = rows.join(met, ["focus", "pub"], "left")
    else:
        rows = rows.withColumn("known", F.lit(None).cast("array<struct<partner:string,error:double>>"))

    def run(block):
        order = sorted({x["cluster"] for x in block})
        place = {c: k for k, c in enumerate(order)}
        clusters, seen, boosts = [Cluster() for _ in order], {}, {}
        for x in block:
            entries = x["entries"] or []
            seen.update((e["term"], e["weight"]) for e in entries)
            boosts.update((e["partner"], max(1.0, 1 / (2 * e["error"]))) for e in x["known"] or [])
            partners = {p for p in x["partners"] or [] if p is not None}
            clusters[place[x["cluster"]]].add(1, {e["term"]: (1.0, 1, x["year"], x["year"]) for e in entries}, Counter([x["venue"] or "UNKNOWN"]), partners)
        kept = joined(clusters, seen, boosts, how)
        return [(x["focus"], x["pub"], order[kept[place[x["cluster"]]]]) for x in block]

    return over_runs(rows, ["focus"], ["pub"], run, StructType.fromDDL("focus string, pub long, cluster long"))
