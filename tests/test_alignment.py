import random
from collections import defaultdict

import pytest

from kinscribe.operators.alignment import align, with_ordinals


def sides(r, n):
    key = lambda: r.choice([None, "hot", "hot", "hot", "a", "b", "c", "d"])
    return [(key(), r.choice([None, 1, 2]), r.randint(0, 9), k) for k in range(n)]


@pytest.mark.parametrize("batch", ["10000", "3"])
def test_alignment_equals_ordinals_by_key(spark, batch):
    had = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that small ranges stay apart and a key reaches over several
    try:
        r = random.Random(len(batch))
        left, right = sides(r, 90), sides(r, 40)
        a = spark.createDataFrame(left, "k string, y int, la int, lb long").repartition(5)
        b = spark.createDataFrame(right, "k string, y int, ra int, rb long").repartition(3)
        got = align(a, b, ["k", "y"], ["la", "lb"], ["ra", "rb"]).collect()
        by = defaultdict(lambda: ([], []))
        for n, rows in enumerate((left, right)):
            for k, y, o, i in rows:
                by[k, y][n].append((o, i))
        want = []
        for (k, y), (x, z) in by.items():
            x, z = sorted(x), sorted(z)
            for n in range(max(len(x), len(z))):
                both = (x[n] if n < len(x) else (None, None)) + (z[n] if n < len(z) else (None, None))
                want.append((k, y, n + 1, *both, "both" if n < min(len(x), len(z)) else "left" if n < len(x) else "right"))
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
        same = spark.createDataFrame([("z", 1)] * 50, "k string, o int").repartition(4)
        assert sorted(x.ordinal for x in with_ordinals(same, ["k"], ["o"]).collect()) == list(range(1, 51))
        assert align(a.limit(0), b, ["k", "y"], ["la"], ["ra"]).where("side = 'right'").count() == 40
        assert align(a, b.limit(0), ["k", "y"], ["la"], ["ra"]).where("side = 'left'").count() == 90
    finally:
        for k, v in had.items():
            spark.conf.set(k, v)
