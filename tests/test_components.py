"""components against a plain union of sets, and what by_shared_partner links."""

import random

import pytest

from kinscribe.operators import clustering
from kinscribe.operators.graph import components


def plain(edges):
    at = {}
    for a, b in edges:
        if a != b:
            both = at.get(a, {a}) | at.get(b, {b})
            at |= dict.fromkeys(both, both)
    return {n: min(s) for n, s in at.items()}


def test_components_of_chains_stars_and_loops(spark):
    r = random.Random(5)
    path = r.sample(range(1000), 70)
    edges = [*zip(path, path[1:]), *[(5000, x) for x in range(4000, 4030)], *[(k, k + 1) for k in range(6000, 6040)], (6040, 6000), (7000, 7000)]
    edges = [(f"n{a}", f"n{b}") if r.random() < 0.5 else (f"n{b}", f"n{a}") for a, b in edges]
    got = components(spark.createDataFrame([*edges, *edges[:5], ("x", None)], "a string, b string"), rounds=7).collect()  # trees at least halve the nodes
    assert {x.node: x.component for x in got} == plain(edges) and len(got) == len(plain(edges))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame([(1, 2)], "a long, b long"), rounds=0)


def test_partners_are_linked_not_papers(spark, monkeypatch):
    met = []
    monkeypatch.setattr(clustering, "components", lambda edges: met.append(edges.selectExpr("inline(array(struct(a as n), struct(b as n)))").distinct().count()) or components(edges))
    rows = [(k % 2, k, f"p{(k + j) % 20}") for k in range(400) for j in (0, 10)]
    rows += [(0, 1000, None), (0, 1001, None), (None, 1002, "p1"), (None, 1003, "p1"), (1, 1004, "q"), (1, 1004, None), (1, 1005, "r"), (1, 1005, None)]
    got = {x.pub: x.cluster for x in clustering.by_shared_partner(spark.createDataFrame(rows, "f long, p long, x string"), "f", "p", "x").collect()}
    assert met == [20]  # ten names of each focus's kind; papers are 400
    assert got == {k: k % 10 for k in range(400)} | {k: k for k in range(1000, 1006)}
