"""Order-dependent merging against the plain double loop, ratios by definition, evidence and seeds by hand."""

import math
import random
from collections import Counter

import pytest

from kinscribe.functions.numbers import sampling_ratio
from kinscribe.operators import merging as M


def plain_loop(sets, may_join):
    """Every pair of positions in order, starting again after each merge; no blocks, no index."""
    sets = [Counter(s) for s in sets]
    members = [[k] for k in range(len(sets))]
    i = 0
    while i < len(sets):
        for j in range(len(sets)):
            if i != j and members[i] and members[j]:
                shared = [x for x in sets[i] if x in sets[j]]
                if shared and may_join(sets[i], sets[j], shared):
                    sets[i] = sets[i] + sets[j]
                    members[i] += members[j]
                    members[j] = []
                    break
        else:
            i += 1
    kept = [0] * len(sets)
    for i, m in enumerate(members):
        for k in m:
            kept[k] = i
    return kept


def papers(r, n):
    return [[r.choice("abcdefghijklmnop") for _ in range(r.choice([0, 1, 2, 2, 3, 5]))] for _ in range(n)]


@pytest.mark.parametrize("seed", range(25))
def test_index_equals_the_plain_loop(seed):
    r = random.Random(seed)
    sets = [Counter(s) for s in papers(r, 25)]
    about = {x: (r.random(), r.random() < 0.5) for x in "abcdefghijklmnop"}
    for rule in (M.JaccardRule(0.4), M.JaccardRule(0.15), M.SharedRule(2), M.EvidenceRule(0.1), M.EvidenceRule(0.02, 1.5)):
        join = lambda a, b, shared: rule(a, b, shared, about)
        assert M.merged_in_order(sets, join) == plain_loop(sets, join)


def test_a_merge_keeps_the_place_of_the_cluster_that_looks():
    # 1 finds nothing, 2 takes 1 in by what 2 and 3 hold together
    sets = [Counter("ab"), Counter("xyz"), Counter("bx"), Counter("yz")]
    assert M.merged_in_order(sets, lambda a, b, s: len(s) >= 2) == plain_loop(sets, lambda a, b, s: len(s) >= 2)
    assert M.greedy_jaccard([{"a"}, {"b"}], 0.0001) == [0, 1]
    assert M.jaccard(Counter(["UNKNOWN", "a"]), Counter(["UNKNOWN", "a"])) == pytest.approx(1 / 3)


@pytest.mark.parametrize("small", [M.SMALL_FOCUS, 30])
def test_operator_equals_the_plain_loop(spark, small):
    r = random.Random(3)
    rows = [(f, 100 * k + n, p) for k, f in enumerate(["x", "y", "z"]) for n, p in enumerate(papers(r, 18))]
    rows += [("x", 900, None), ("x", 901, [None, "q"]), ("x", 902, ["q", None])]
    df = spark.createDataFrame(rows, "focus string, pub long, partners array<string>").repartition(4)
    got = {(x.focus, x.pub): x.cluster for x in M.merge_in_order(df, M.JaccardRule(0.3), small_focus=small).collect()}
    assert len(got) == len(rows)
    for f in "xyz":
        own = sorted((p, [x for x in s or [] if x]) for g, p, s in rows if g == f)
        kept = plain_loop([s for _, s in own], lambda a, b, s: M.jaccard(a, b) >= 0.3)
        assert [got[f, p] for p, _ in own] == [own[k][0] for k in kept]
    assert M.merge_in_order(df.limit(0), M.SharedRule()).count() == 0


def test_evidence_and_its_rule(spark):
    pairs = spark.createDataFrame([("f", "p"), ("f", "p"), ("f", "q"), ("f", "r"), ("west", "p")], "focus string, partner string")
    counts = spark.createDataFrame([("f", 9), ("p", 3), ("q", 99)], "name string, n long")
    ambiguities = spark.createDataFrame([("f", 100.0), ("p", 4.0), ("zz", 896.0)], "name string, m double")
    got = {(x.focus, x.partner): (x.error, x.counts) for x in M.partner_evidence(pairs, counts, ambiguities).collect()}
    # total 1000; f counts as 150, p as 10; at most 100/150 - 1 partners and an ambiguity of 10
    assert got == {("f", "p"): (pytest.approx(max(4 * 150 / 2000, 10 * 10 / 2000)), False), ("f", "q"): (pytest.approx(100 * 150 / 2000), False), ("f", "r"): (0.0, True), ("west", "p"): (0.0, False)}
    rows = [("f", 1, ["p", "a"]), ("f", 2, ["p", "b"]), ("f", 3, ["r", "b", "c"]), ("f", 4, ["r", "d"]), ("f", 5, ["p"])]
    df = spark.createDataFrame(rows, "focus string, pub long, partners array<string>")
    evidence = M.partner_evidence(df.selectExpr("focus", "explode(partners) partner"), counts, ambiguities)
    merged = {x.pub: x.cluster for x in M.merge_in_order(df, M.EvidenceRule(), evidence).collect()}
    about = {x.partner: (x.error, x.counts) for x in evidence.collect()}
    rule = M.EvidenceRule()
    kept = plain_loop([s for _, _, s in rows], lambda a, b, s: rule(a, b, s, about))
    assert [merged[p] for _, p, _ in rows] == [rows[k][1] for k in kept] and len(set(kept)) < 5


def plain_seeds(free, seeds):
    free, seeds, taken = [set(s) for s in free], [set(s) for s in seeds], [None] * len(free)
    while True:
        found = [(len(free[i] & seeds[k]), -i, -k) for i in range(len(free)) if taken[i] is None for k in range(len(seeds))]
        if not found or max(found)[0] < 2:
            break
        _, i, k = max(found)
        i, k = -i, -k
        taken[i] = k
        seeds[k] |= free[i]
    left = [i for i, k in enumerate(taken) if k is None]
    kept = list(range(len(free)))
    for at, to in zip(left, plain_loop([free[i] for i in left], lambda a, b, s: len(s) >= 2)):
        kept[at] = left[to]
    return taken, kept


@pytest.mark.parametrize("seed", range(20))
def test_seeds_equal_the_plain_rounds(seed):
    r = random.Random(seed)
    free, seeds = papers(r, 14), papers(r, 3)
    assert M.seeds_in_order([Counter(x) for x in free], [Counter(x) for x in seeds]) == plain_seeds(free, seeds)


@pytest.mark.parametrize("small", [M.SMALL_FOCUS, 5])
def test_seed_operator(spark, small):
    r = random.Random(8)
    rows = [("f", k, p) for k, p in enumerate(papers(r, 30))] + [("g", 70, ["a", "b"]), ("g", 71, ["a", "b"]), ("g", 72, None)]
    given = [("f", 3, 5), ("f", 9, 5), ("f", 4, 2), ("f", 20, 7)]
    df = spark.createDataFrame(rows, "focus string, pub long, partners array<string>").repartition(3)
    got = {(x.focus, x.pub): (x.seed, x.cluster) for x in M.merge_into_seeds(df, spark.createDataFrame(given, "focus string, pub long, seed long"), small).collect()}
    seeds = {5: [3, 9], 2: [4], 7: [20]}
    numbers = sorted(seeds)
    free = [k for k in range(30) if k not in (3, 9, 4, 20)]
    taken, kept = plain_seeds([rows[k][2] for k in free], [[x for p in seeds[s] for x in rows[p][2]] for s in numbers])
    want = {("f", p): (s, seeds[s][0]) for s in seeds for p in seeds[s]}
    for k, t, to in zip(free, taken, kept):
        want["f", k] = (None, free[to]) if t is None else (numbers[t], seeds[numbers[t]][0])
    want |= {("g", 70): (None, 70), ("g", 71): (None, 70), ("g", 72): (None, 72)}
    assert got == want


def test_unknown_outcomes_by_hand():
    # UNKNOWN of the larger one gets no prior: a has 3.5 of 3.5 + 1 + 0.5
    assert sampling_ratio({"a": 3, "UNKNOWN": 1}, {"a": 1}) == pytest.approx(3 * 3.5 / 5)
    # in both, and a pooled outcome that the reduction takes away from three draws: UNKNOWN has 1.5 of 5.5, a 3.5
    two = {"a": 1, "UNKNOWN": 1, "b": 1}
    assert sampling_ratio({"a": 3, "UNKNOWN": 1}, two) == pytest.approx(2 * (3.5 / 5.5) * (1.5 / 5.5) * math.comb(4, 2))
    # only in the sample: shared prior with pooled outcomes, a prior of its own without
    assert sampling_ratio({"a": 5}, {"UNKNOWN": 1, "b": 1}, reduction=0) == pytest.approx(2 * (0.25 / 5) ** 2 * math.comb(4, 2))
    assert sampling_ratio({"a": 5}, {"UNKNOWN": 1}, reduction=0) == pytest.approx(0.5 / 5.5 * 3)
    assert sampling_ratio({"a": 5}, {"UNKNOWN": 1}, unknown=0.0, reduction=0) == 0
