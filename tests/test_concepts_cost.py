"""What merging of concept vectors costs: how often its Python runs, and which pairs of a vector it looks at."""

import json

from kinscribe.operators import concepts as C
from kinscribe.operators import taxonomy as T


def shop(n, per):
    """Edges of n items below n / per lines, which stand below one top; one item of each line has the same brand. Top and brands are nearer to the root than LEAST_DEPTH."""
    return [e for k in range(n) for e in [("top", f"line{k // per:03}", k), (f"line{k // per:03}", f"item{k:03}", k), (f"brand{k % per}", f"item{k:03}", k)]]


def test_python_runs_once(spark):
    inherited = T.inheritance(spark.createDataFrame(shop(6, 3), "parent string, child string, place long"))
    vectors = spark.createDataFrame([("a", f"item{k:03}", float(k // 2 + 1)) for k in range(6)], "vector string, term string, weight double")
    small = C.compacted(C.merged_terms(vectors, inherited, 2))
    assert small._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") == 1
    # line 0: 2 and 1 merge, 3 and 1 are too far apart in weight; line 1: 3 and 3 merge, 6 and 2 are too far apart
    got = {(x.vector, x.concept): (x.weight, x.n_terms) for x in small.collect()}
    assert got == {("a", "line000"): (3.0, 2), ("a", "line001"): (6.0, 2), ("a", "item000"): (1.0, 1), ("a", "item001"): (1.0, 1), ("a", "item002"): (2.0, 1), ("a", "item003"): (2.0, 1), ("a", "item004"): (3.0, 1), ("a", "item005"): (3.0, 1)}


def test_pairs_that_only_meet_near_the_root_get_no_look(spark, monkeypatch):
    n, looks, kept = 120, [], C._Vector.subsumer
    inherited = T.inheritance(spark.createDataFrame(shop(n, 2), "parent string, child string, place long"))
    near = {}
    for x in inherited.where("steps <= 2").collect():
        near.setdefault((x.node, x.depth), []).append((x.ancestor, x.steps, x.steps / x.share))
    rows = [{"node": node, "depth": depth, "weight": 1.0 if node.startswith("item") else None, "near": json.dumps(dict(zip(C.NEAR, zip(*up))))} for (node, depth), up in near.items() if depth >= C.LEAST_DEPTH]
    monkeypatch.setattr(C._Vector, "subsumer", lambda self, p, q: looks.append((p, q)) or kept(self, p, q))
    merged = {term: concept for term, concept, _ in C._Vector(rows, 2).merge()}
    assert merged == {f"item{k:03}": f"line{k // 2:03}" for k in range(n)}
    assert len(looks) <= 2 * n
