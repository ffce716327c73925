"""Merging of concept vectors against loops over all pairs of slots."""

import random

from kinscribe.operators import concepts as C
from kinscribe.operators import taxonomy as T


def plain(weights, depth, up, reach):
    """up: node -> {ancestor: (steps, stretched)}; every pair is looked at, in order, as the rule says."""
    w, slots, into, barred = dict(weights), sorted(weights, key=lambda n: (-weights[n], n)), {}, set()
    for limit in range(1, reach + 1):
        i = 0
        while i < len(slots):
            p, again = slots[i], False
            for j in range(len(slots) if p and depth[p] >= 2 else 0):
                q = slots[j]
                if j == i or not q or depth[q] < 2 or (p, q) in barred:
                    continue
                if p == q:
                    slots[j] = None
                    continue
                best = min(((up[p][s][0] + up[q][s][0], up[p][s][1] + up[q][s][1], s) for s in up[p] if s in up[q]), default=None)
                if best is None or best[0] > reach:
                    continue
                ratio = min(w[p], w[q]) / max(w[p], w[q]) if min(w[p], w[q]) > 0 else 0
                if depth[best[2]] < 2 or ratio < 1 - 1 / limit:
                    barred |= {(p, q), (q, p)}
                elif best[0] <= limit:
                    s, total = best[2], w[p] + w[q]
                    into.update({x: (s, up[x][s][1]) for x in (p, q) if x != s})
                    slots[i], slots[j], w[s], again = s, None, total, True
                    break
            i += not again
    out = {}
    for t in weights:
        at, steps = t, 0.0
        while at in into:
            steps += into[at][1]
            at = into[at][0]
        out[t] = (at, steps)
    return out


def test_against_all_pairs(spark):
    r = random.Random(3)
    nodes = [f"node{k:02d}" for k in range(60)]
    edges = sorted({(nodes[r.randrange(k // 4, max(1, k // 2 + 1))], nodes[k], k) for k in range(1, 60) for _ in range(r.choice([1, 1, 2]))})
    edges = [e for e in edges if e[0] != e[1]]
    inherited = T.inheritance(spark.createDataFrame(edges, "parent string, child string, place long")).cache()
    depth, up = {}, {}
    for x in inherited.collect():
        depth[x.node] = x.depth
        up.setdefault(x.node, {})[x.ancestor] = (x.steps, x.steps / x.share)
    vectors = {v: {n: float(r.choice([0, 1, 1, 2, 3, 5, 8, -1])) for n in r.sample(nodes, r.choice([1, 2, 8, 25, 60]))} for v in range(40)}
    rows = [(v, n, w) for v, x in vectors.items() for n, w in x.items()]
    merged_some = 0
    for reach in (1, 2, 3):
        got = C.merged_terms(spark.createDataFrame(rows, "vector long, term string, weight double"), inherited, reach).collect()
        assert len(got) == len(rows)
        want = {v: plain(x, depth, {n: {a: s for a, s in y.items() if s[0] <= reach} for n, y in up.items()}, reach) for v, x in vectors.items()}
        for x in got:
            concept, steps = want[x.vector][x.term]
            assert x.concept == concept and abs(x.steps - steps) < 1e-9, (reach, x)
            merged_some += x.concept != x.term
    assert merged_some > 200


def test_edges_of_the_rule(spark):
    edges = [("top", "mid", 1), ("mid", "low", 2), ("low", "aa", 3), ("low", "bb", 4), ("low", "cc", 5)]
    inherited = T.inheritance(spark.createDataFrame(edges, "parent string, child string, place long"))
    schema = "vector string, term string, weight double"
    rows = [("a", "aa", 4.0), ("a", "bb", 1.0), ("a", "bb", 1.0), ("a", "cc", 1.0), ("a", "away", 9.0), (None, "aa", 1.0), ("a", None, 1.0), ("b", "aa", None), ("c", "aa", 1.0), ("c", "low", 1.0)]
    m = C.merged_terms(spark.createDataFrame(rows, schema), inherited, 2)
    got = {(x.vector, x.term): (x.weight, x.concept, x.steps) for x in m.collect()}
    # bb (2) may join aa (4); what they become (6) stands above cc (1), too light for it
    assert got == {("a", "aa"): (4.0, "low", 1.0), ("a", "bb"): (2.0, "low", 1.0), ("a", "cc"): (1.0, "cc", 0.0), ("a", "away"): (9.0, "away", 0.0), ("c", "aa"): (1.0, "low", 1.0), ("c", "low"): (1.0, "low", 0.0)}
    small = {(x.vector, x.concept): (x.weight, x.n_terms) for x in C.compacted(m).collect()}
    assert small == {("a", "low"): (6.0, 2), ("a", "aa"): (4.0, 1), ("a", "bb"): (2.0, 1), ("a", "cc"): (1.0, 1), ("a", "away"): (9.0, 1), ("c", "low"): (2.0, 2), ("c", "aa"): (1.0, 1)}
    assert C.merged_terms(spark.createDataFrame([], schema), inherited).count() == 0
