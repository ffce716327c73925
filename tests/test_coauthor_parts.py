from collections import Counter
from itertools import combinations

from kinscribe.operators import relational as R


def test_partitions_grow_with_rows(spark, monkeypatch):
    rows = [(k % 40, (k * 7 + k // 40) % 23) for k in range(400)] + [(1, 2), (1, 2), (None, 3), (None, 4), (5, None)]
    papers = {}
    for p, x in rows:
        if p is not None and x is not None:
            papers.setdefault(p, set()).add(x)
    wanted = Counter(pair for xs in papers.values() for pair in combinations(sorted(xs), 2))
    bridge = spark.createDataFrame(rows, "p long, x long")
    monkeypatch.setattr(R, "ROWS_A_PART", 20)
    got = R.coauthor_pairs(bridge, "p", "x")
    assert {(r.a, r.b): r.n for r in got.collect()} == dict(wanted)
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().toString()
