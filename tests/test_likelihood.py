import math
import random

import numpy as np
import pytest

from kinscribe.functions.numbers import sampling_ratio
from kinscribe.operators import likelihood as L


def test_log_gamma():
    x = np.concatenate((np.arange(1, 40) / 7, np.arange(5, 300), [1e4, 12345.678, 1e7, 0.01]))
    assert np.allclose(L.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)


def random_map(r):
    return {k: r.randint(1, 9) for k in r.sample(["a", "b", "c", "d", "e", "f", "UNKNOWN"], r.randint(0, 6))}


@pytest.mark.parametrize("how", [{}, {"unknown": 0.0}, {"reduction": 0.0, "cap": 2, "floor": 0.3}, {"known": 0.1, "unseen": 1.5}])
def test_columns_equal_the_scalar(spark, how):
    r = random.Random(len(how) + 1)
    rows = [(k, random_map(r), random_map(r), "x") for k in range(300)] + [(300, None, {"a": 1}, ""), (301, {"a": 2}, None, None)]
    df = spark.createDataFrame(rows, "id long, one map<string,int>, two map<string,int>, ratio_ string")
    got = {x.id: x.ratio for x in L.categorical_ratios(df, "one", "two", **how).collect()}
    assert got[300] is None and got[301] is None and len(got) == len(rows)
    for k, one, two, _ in rows[:300]:
        assert got[k] == pytest.approx(sampling_ratio(one, two, **how), rel=1e-9), (one, two)


def plain_expansion(own, other, similar, least):
    best = {}
    for v, n in own.items():
        for (a, b), s in similar.items():
            if a == v and b not in own and b in other and s >= least:
                best[b] = max(best.get(b, 0), n * s * L.DISCOUNT)
    out, left = dict(own), L.BUDGET * sum(own.values())
    for b in sorted(best, key=lambda b: (-other[b], b)):
        take = min(best[b], L.MOST, left)
        if take > 0:
            out[b] = take
            left -= take
    return out


def test_expansion_under_a_budget(spark):
    r = random.Random(5)
    similar = {(a, b): r.random() for a in "abcdef" for b in "abcdef" if a != b and r.random() < 0.6}
    s = spark.createDataFrame([(a, b, v) for (a, b), v in similar.items()], "a string, b string, s double")
    rows = [(k if k else None, k % 2, random_map(r), random_map(r)) for k in range(120)]
    df = spark.createDataFrame([(k, p, {x: float(n) for x, n in a.items()}, {x: float(n) for x, n in b.items()}) for k, p, a, b in rows], "id long, side int, one map<string,double>, two map<string,double>")
    got = {(x.id, x.side): x.one for x in L.expanded(df, ["id", "side"], "one", "two", s, 0.3).collect()}
    for k, p, a, b in rows:
        want = plain_expansion(a, b, similar, 0.3)
        assert got[k, p] == pytest.approx(want), (a, b)
    whole = {x.id: x.ratio for x in L.categorical_ratios(df, "one", "two", similar=s, keys=["id", "side"]).collect()}
    for k, _, a, b in rows:
        base, sample = sorted((a, b), key=lambda m: (-sum(m.values()), -len(m)))
        base = plain_expansion({x: n if x == "UNKNOWN" else min(n, 4) for x, n in base.items()}, sample, similar, L.BASE_LEAST)
        sample = plain_expansion(sample, base, similar, L.SAMPLE_LEAST)
        if sum(base.values()) > sum(sample.values()):  # so that the scalar takes the same one as base
            assert whole[k] == pytest.approx(sampling_ratio(base, sample), rel=1e-9)
