"""Taxonomies against plain loops over queues, edges one by one and all pairs of postings."""

import math
import random
from collections import defaultdict, deque

import pytest

from kinscribe.functions.strings import decapitalised
from kinscribe.operators import taxonomy as T

EDGES = "parent string, child string, place long"


def reach(below, a):
    seen, todo = {a}, [a]
    while todo:
        for x in below[todo.pop()]:
            if x not in seen:
                seen.add(x)
                todo.append(x)
    return seen


def plainly_admitted(rows):
    below, out = defaultdict(list), []
    for p, c, k in sorted(rows, key=lambda r: (r[2], r[0], r[1])):
        if p not in reach(below, c) and c not in below[p]:
            below[p].append(c)
            out.append((p, c))
    return sorted(out)


def plainly_inherited(rows):
    """A queue: a node is expanded when its last parent has handed its ancestors on."""
    place = {}
    for p, c, k in rows:
        place[p, c] = min(k, place.get((p, c), k))
    kids, missing = defaultdict(list), defaultdict(int)
    for (p, c), k in place.items():
        kids[p].append((k, c))
        missing[c] += 1
    for p in [p for p in kids if p not in missing]:
        kids[""].append((0, p))
        missing[p] += 1
    depth, above, batches, queue = {"": 0}, {"": {"": (0, 0)}}, defaultdict(int), deque([""])
    reach_of, arrived = defaultdict(dict), defaultdict(list)
    while queue:
        p = queue.popleft()
        for k, c in sorted(kids[p]):
            arrived[c].append(p)
            missing[c] -= 1
            if missing[c]:
                continue
            depth[c], above[c] = 1 + min(depth[x] for x in arrived[c]), {}
            for b, x in enumerate(arrived[c]):
                new = {a: (s + 1, b) for a, (s, _) in above[x].items() if a not in above[c]}
                above[c].update(new)
                if new:
                    reach_of[c][b] = max(s + depth[a] for a, (s, _) in new.items())
            above[c][c] = (0, 0)
            queue.append(c)
    share = lambda n, b, s: 1.0 if s == 0 else min(1.0, reach_of[n][0] / reach_of[n][b])
    return sorted((n, depth[n], a, s, b, round(share(n, b, s), 9)) for n in above for a, (s, b) in above[n].items())


def got(df):
    return sorted((r.node, r.depth, r.ancestor, r.steps, r.batch, round(r.share, 9)) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_admission_in_order(spark, seed):
    r = random.Random(seed)
    rows = [(f"n{a}x", f"n{b}x", k // 2) for k in range(160) for a, b in [r.sample(range(r.choice([12, 60])), 2)]] + [("hub1", f"leaf{k}", k) for k in range(50)] + [("n1x", "hub1", 3)]
    kept = T.admitted(spark.createDataFrame(rows, EDGES)).collect()
    assert sorted((x.parent, x.child) for x in kept) == plainly_admitted(rows)


@pytest.mark.parametrize("seed", [3, 4])
def test_inheritance_by_queue(spark, seed):
    r = random.Random(seed)
    rows = [(f"n{a:02}", f"n{b:02}", r.randrange(5)) for _ in range(70) for a, b in [sorted(r.sample(range(30), 2))]]
    assert got(T.inheritance(spark.createDataFrame(rows, EDGES))) == plainly_inherited(rows)


def test_what_is_left_out(spark):
    rows = [("Arts", "Music", 1), ("Arts", "music", 2), ("Arts", "MUSIC", 3), ("Arts", "arts", 4), ("A-", "Music", 5), (None, "Music", 6), ("Arts", None, 7), ("Arts", "stopped", 8), ("Arts", "barred", 9), ("Music", "barred", 10), ("Music", "Arts", 11), ("Arts", "Music", 12), ("Arts", "McCoy", 13), ("Arts", "mccoy", 14)]
    stop, barred = spark.createDataFrame([("stopped",)], "term string"), spark.createDataFrame([("Arts", "barred")], "parent string, child string")
    kept = sorted(map(tuple, T.admitted(spark.createDataFrame(rows, EDGES), stop, barred).collect()))
    assert kept == [("Arts", "McCoy", 13, "McCoy"), ("Arts", "Music", 1, "MUSIC"), ("Music", "barred", 10, "barred")]


def test_empty_and_cyclic(spark):
    none = spark.createDataFrame([], EDGES)
    assert T.admitted(none).count() == 0 and got(T.inheritance(none)) == [("", 0, "", 0, 0, 1.0)]
    for rows in ([("aa", "bb", 1), ("bb", "aa", 2)], [("rr", "aa", 1), ("aa", "bb", 1), ("bb", "aa", 2)]):
        with pytest.raises(ValueError):
            T.inheritance(spark.createDataFrame(rows, EDGES))
    with pytest.MonkeyPatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(T, "MAX_TANGLE", 1)
        T.admitted(spark.createDataFrame([("aa", "bb", 1), ("bb", "aa", 2)], EDGES))


def test_counts_entropies_and_dominance(spark):
    r = random.Random(7)
    rows = [(f"n{a:02}", f"n{b:02}", 0) for _ in range(40) for a, b in [sorted(r.sample(range(20), 2))]]
    plain = plainly_inherited(rows)
    up = T.inheritance(spark.createDataFrame(rows, EDGES)).cache()
    n = {f"n{k:02}": k * 10 for k in range(0, 25)}
    freq = defaultdict(float)
    for node, _, a, s, _, share in plain:
        if node in n:
            freq[a] += n[node] * share**s
    counts = spark.createDataFrame([(k, v) for k, v in n.items()] + [(None, 5), ("n03", None)], "term string, n long")
    freqs = T.attenuated_counts(counts, up).cache()
    assert {x.term: round(x.freq, 5) for x in freqs.collect()} == {k: round(v, 5) for k, v in freq.items()}
    ic = {x.term: x.ic for x in T.contents(freqs).collect()}
    assert ic[""] == 0 and all(abs(ic[k] - (math.log(freq[""]) - math.log(v))) < 1e-6 if v else ic[k] == -1 for k, v in freq.items())
    post = [(f"t{k % 6}", f"n{r.randrange(24):02}") for k in range(60)] + [("t1", "nowhere"), (None, "n01"), ("t2", None), ("the", "n05")]
    above = defaultdict(set)
    for node, _, a, s, _, _ in plain:
        above[node] |= {a} if s else set()
    want = {}
    for tok in {x for x, _ in post if x}:
        terms = {y for x, y in post if x == tok and y in {p[0] for p in plain}}
        top = [freq[y] / freq[""] for y in terms if not above[y] & terms and freq[y]]
        want[tok] = (0.0 if tok == "the" else round(-sum(p * math.log2(p) for p in top), 6), len(terms), len(top))
    e = T.token_entropies(spark.createDataFrame(post, "token string, term string"), up, freqs, stop=["the"]).collect()
    assert {x.token: (round(x.entropy, 6), x.n_terms, x.n_top) for x in e} == want
    pairs = spark.createDataFrame([("big", "one", 0), ("big", "two", 0), ("big", "new", 0), ("even", "one", 0), ("even", "also", 0), ("only", "one", 0), ("few", "one", 0), ("few", "two", 0)], EDGES)
    f = spark.createDataFrame([("big", 2000.0), ("even", 2000.0), ("only", 2000.0), ("few", 10.0), ("one", 995.0), ("two", 5.0), ("also", 995.0)], "term string, freq double")
    assert [tuple(x) for x in T.dominated(f, pairs).collect()] == [("big", 2000.0, 1000.0, "one", 995.0)]


def test_decapitalised(spark):
    given = ["Big Data", "IBM Research", "IBM", "A-Level McCoy", "x", "", None, "PhD B"]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(given)], "k int, x string")
    assert [x.y for x in rows.select("k", decapitalised(rows.x).alias("y")).orderBy("k").collect()] == ["big data", "IBM research", "IBM", "a-level mcCoy", "x", "", None, "phD b"]
