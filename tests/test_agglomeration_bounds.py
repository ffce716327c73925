import random

from kinscribe.operators import agglomeration as A


def test_pairs_that_cannot_reach_the_threshold_are_not_scored(monkeypatch):
    r, calls, real = random.Random(3), [], A.similarity
    monkeypatch.setattr(A, "similarity", lambda *x: calls.append(1) or real(*x))
    clusters = []
    for _ in range(30):
        c, y = A.Cluster(), r.randint(1990, 1999)
        c.add(1, {f"w{k}": (1.0, 1, y, y) for k in r.sample(range(12), 4)}, A.Counter([f"v{r.randint(0, 4)}"]), {"p"})
        clusters.append(c)
    A.joined(clusters, {f"w{k}": 1.2 for k in range(12)}, {}, A.Joining(threshold=2.0, venue_threshold=0.5))
    assert 0 < len(calls) < 30 * 29 / 2
