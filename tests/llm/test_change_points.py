import math
import random
from datetime import datetime, timedelta

import pytest

from kinscribe.llm.change_points import Cutter, change_points


def level(n, s, q):
    v = 1 + (n * q - s * s) // (n * n)
    return v, n * math.floor(1000 * math.log(v))


def every_cut(x, least):
    """All lists of starts whose segments have least days or more."""

    def after(a):
        if len(x) - a >= least:
            yield [a]
        for b in range(a + least, len(x) - least + 1):
            for rest in after(b):
                yield [a, *rest]

    return list(after(0)) or [[0]]


def brute(x, penalty, least):
    def judge(starts):
        total = penalty * (len(starts) - 1)
        for a, b in zip(starts, [*starts[1:], len(x)]):
            total += level(b - a, sum(x[a:b]), sum(y * y for y in x[a:b]))[1]
        return total, len(starts), starts[::-1]

    return min(map(judge, every_cut(x, least)))


@pytest.mark.parametrize("seed", range(60))
def test_cutter_equals_every_cut(seed):
    r = random.Random(seed)
    least, penalty = r.choice([(1, 0), (2, 500), (3, 2000), (5, 10_000), (2, 0)])
    high = r.choice([1, 3, 100, 10**6, 10**11])
    x, at = [], 0
    for _ in range(r.randint(1, 15 if least > 1 else 11)):
        at = r.randint(0, high) if r.random() < 0.3 else at
        x.append(max(0, at + r.randint(-1, 1)))
    c = Cutter(penalty, least)
    for y in x:
        c.add(y)
    cost, count, back = brute(x, penalty, least)
    got = c.segments()
    assert [s[0] for s in got] == back[::-1]
    assert sum(s[4] for s in got) + penalty * (len(got) - 1) == cost and len(got) == count
    for first, n, s, v, k in got:
        assert (v, k) == level(n, sum(x[first : first + n]), sum(y * y for y in x[first : first + n])) and s == sum(x[first : first + n])


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "vendor long, value int, at timestamp, day string, key string")


def test_nulls_gaps_ties_and_repeats(spark):
    day = lambda k: datetime(2024, 2, 27) + timedelta(days=k, hours=k % 24)
    rows = [(1, 5, day(0), "a", "b"), (1, 5, day(0), "a", "b"), (1, None, day(1), "", None), (1, 7, None, "", None), (1, 3, day(3), "", "")]  # four days
    rows += [(None, 1, day(k), "x", "y") for k in range(6)]
    rows += [(2, 4 if k < 8 else 900 + 40 * (k % 3), day(k), None, None) for k in range(16)]
    got = sorted(map(tuple, change_points(rows_of(spark, rows), "vendor", "at", "value").collect()), key=str)
    first = 19780  # 2024-02-27
    assert (1, 1, first, 4, 13, 1 + (4 * 109 - 169) // 16, 4 * math.floor(1000 * math.log(17)), 1, 4 * math.floor(1000 * math.log(17))) in got
    assert (None, 1, first, 6, 6, 1, 0, 1, 0) in got
    two = [x for x in got if x[0] == 2]
    assert [(x[1], x[2], x[3]) for x in two] == [(1, first, 8), (2, first + 8, 8)] and len(got) == 4
    assert change_points(rows_of(spark, []), "vendor", "at", "value").count() == 0


def test_a_long_series_over_several_batches(spark):
    had = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        days = spark.sql("select 3 as v, timestamp'2020-01-01' + make_interval(0, 0, 0, cast(id as int)) as at, cast(id div 200 * 50 + id % 3 as int) as n from range(600)")
        got = change_points(days, "v", "at", "n").orderBy("segment_no").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", had)
    c = Cutter()
    for k in range(600):
        c.add(k // 200 * 50 + k % 3)
    assert [(x.first_day - 18262, x.n_days, x.total, x.spread, x.cost) for x in got] == c.segments() and len(got) == 3
