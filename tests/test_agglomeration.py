"""The heap and its index against rescoring every pair in every round, from the papers themselves."""

import random
from collections import Counter
from math import log, sqrt

import pytest

from kinscribe.functions.numbers import sampling_ratio
from kinscribe.operators import agglomeration as A


def plain(groups, weights, boosts, how):
    """groups: lists of papers (terms, venue, year, partners), in order of position."""
    groups = [(k, list(g)) for k, g in enumerate(groups)]
    kept = {k: k for k, _ in groups}

    def vector(g):
        out = {}
        for terms, _, year, _ in g:
            for t in set(terms):
                out.setdefault(t, []).append(year)
        v = {t: (len(y) / (sqrt(len(y)) * max(1, log(len(g)))), [x for x in y if x is not None]) for t, y in out.items()}
        return dict(sorted(v.items(), key=lambda x: (-x[1][0], x[0]))[: min(max(3 * len(g), 20), 100)])

    def score(g, h):
        v, w = vector(g), vector(h)
        prior = min(how.threshold / 2, 0.5)
        s = 0.0
        for t in v.keys() & w.keys():
            x, y = v[t][1], w[t][1]
            gap = max(min(y) - max(x), min(x) - max(y), 0) if x and y else 0
            s += weights.get(t, 0) * v[t][0] * w[t][0] * (0 if gap > 6 else 0.7 ** max(0, gap - 2))
        s = prior if not v or not w else max(s, prior) if s > 0 else s
        a, b = (Counter(p[1] or "UNKNOWN" for p in x) for x in (g, h))
        if how.venue_threshold is None:
            s *= sampling_ratio(a, b, floor=0.1)
        else:
            both, whole = len((a.keys() & b.keys()) - {"UNKNOWN"}), len((a.keys() | b.keys()) - {"UNKNOWN"}) + ("UNKNOWN" in a) + ("UNKNOWN" in b)
            s *= max(both / whole, 0.003) / how.venue_threshold
        shared = {x for p in g for x in p[3]} & {x for p in h for x in p[3]}
        return s * max([boosts.get(x, 1.0) for x in shared], default=1.0)

    while len(groups) > how.least_clusters:
        best, at = 0, None
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                s = score(groups[i][1], groups[j][1])
                if s > best * (1 + 1e-12):
                    best, at = s, (i, j)
        if at is None or best < how.threshold:
            break
        i, j = at
        kept[groups[j][0]] = groups[i][0]
        groups[i] = (groups[i][0], groups[i][1] + groups[j][1])
        del groups[j]
    for k in kept:
        while kept[kept[k]] != kept[k]:
            kept[k] = kept[kept[k]]
    return kept


def paper(r):
    return [r.choice("abcdefghijkl") for _ in range(r.choice([0, 2, 3, 4]))], r.choice(["v", "w", "x", "y", None]), r.choice([None, 1990, 1995, 1999, 2001, 2008]), [r.choice("pqrs") for _ in range(r.choice([0, 0, 1]))]


HOWS = [A.Joining(0.3, 1, 0.3), A.Joining(0.8, 4, None), A.Joining(0.5, 1, None), A.Joining(1.5, 1, 0.04)]


@pytest.mark.parametrize("how", HOWS)
def test_operator_equals_rescoring_all(spark, how):
    r = random.Random(how.threshold)
    weights = {t: 0.1 + r.random() for t in "abcdefghij"}
    rows, focuses = [], {}
    for f in ("x", "y", "z"):
        groups = [[paper(r) for _ in range(r.choice([1, 1, 2, 3]))] for _ in range(14)]
        focuses[f] = groups
        pub = 0
        for k, g in enumerate(groups):
            for p in g:
                rows.append((f, pub, k, *p))
                pub += 1
    df = spark.createDataFrame(rows, "focus string, pub long, cluster long, terms array<string>, venue string, year int, partners array<string>").repartition(3)
    errors = {"p": 0.05, "q": 0.4, "r": 0.9}
    evidence = spark.createDataFrame([(f, p, e) for f in "xy" for p, e in errors.items()], "focus string, partner string, error double")
    table = spark.createDataFrame(list(weights.items()), "term string, weight double")
    got = {(x.focus, x.pub): x.cluster for x in A.agglomerate_papers(df, table, how, evidence).collect()}
    joined = 0
    for f, groups in focuses.items():
        kept = plain(groups, weights, {p: max(1, 1 / (2 * e)) for p, e in errors.items()} if f in "xy" else {}, how)
        joined += sum(k != v for k, v in kept.items())
        assert {p: c for (g, p), c in got.items() if g == f} == {p: kept[k] for g, p, k, *_ in rows if g == f}
    assert joined > 3
    assert A.agglomerate_papers(df.limit(0), table, how).count() == 0
