"""Numbers, dates and likelihoods."""

from __future__ import annotations

from collections.abc import Mapping
from math import exp, lgamma, log

from pyspark.sql import Column
from pyspark.sql import functions as F


def pairs_of(n: Column) -> Column:
    return n * (n - 1) / 2


def f1(p: Column, r: Column) -> Column:
    return F.try_divide(2 * p * r, p + r)


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def round_at_least_1(c: Column) -> Column:
    return F.when(c <= 0, 0).when(c < 1, 1).otherwise(half_up(c))


def at_least_1(c: Column, up: bool = False) -> Column:
    return F.ceil(c) if up else F.greatest(c, F.lit(1.0))


def or_zero(c: Column, places: int | None = None) -> Column:
    return F.coalesce(F.round(c, places) if places is not None else c, F.lit(0))


def between(c: Column, a: Column, b: Column) -> Column:
    return F.coalesce(c.between(F.least(a, b), F.greatest(a, b)), F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    return F.when((a <= 0) | (b <= 0), 0.0).otherwise(F.least(a, b) / F.greatest(a, b))


def close(a: Column, b: Column, eps: float) -> Column:
    return F.abs(a - b) <= eps


def weighted(w: float, a: Column, b: Column) -> Column:
    if not 0 <= w <= 1:
        raise ValueError("weight outside 0..1")
    return w * a + (1 - w) * b


def linear(terms: Mapping[str, float], constant: float = 0.0) -> Column:
    """A linear function of named columns."""
    return sum((F.col(c) * t for c, t in terms.items()), F.lit(constant))


def overestimated(c: Column) -> Column:
    """An ambiguity estimate, raised the more the smaller it is."""
    return F.ceil(F.when(c > 200, c).when(c > 50, c * 1.5).when(c > 0, c * 2.5).otherwise(0))


def predicted_ambiguity(clusters: Column, solo: Column, factor: float = 0.6) -> Column:
    """From clusters and single papers of a name; a factor of 1 gives the plain prediction."""
    first = 0.9 * clusters - 1.3 * solo
    return factor * F.when(first > 0, first).when(clusters > 0, 0.7 * clusters).otherwise(0.5 * solo)


def threshold_for(base: float, ambiguity: Column) -> Column:
    return base * F.greatest(F.lit(1.0), ambiguity / 10)


def topic_papers(n: Column) -> Column:
    return F.pow(n, F.lit(0.666))


def year_gap(f1_: Column, t1: Column, f2: Column, t2: Column) -> Column:
    return F.greatest(f2 - t1, f1_ - t2, F.lit(0))


def year_discount(gap: Column) -> Column:
    return F.when(gap > 6, 0.0).when(gap <= 2, 1.0).otherwise(F.pow(F.lit(0.7), gap - 2))


def year_range(a: Column, b: Column) -> Column:
    return F.when(a == b, a.cast("string")).otherwise(F.concat_ws("-", a, b))


def duration(seconds: Column) -> Column:
    h, m, s = F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600)) / 60), F.pmod(seconds, F.lit(60))
    return F.concat(F.when(h > 0, F.concat(h.cast("string"), F.lit("h"))).otherwise(""), F.when((h > 0) | (m > 0), F.concat(m.cast("string"), F.lit("m"))).otherwise(""), s.cast("string"), F.lit("s"))


def log_factorial(n: float, m: float) -> float:
    """Logarithm of the falling factorial of m terms; real arguments."""
    return lgamma(n + 1) - lgamma(n - m + 1)


def log_combination(n: float, m: float) -> float:
    return log_factorial(n, m) - lgamma(m + 1)


def sampling_ratio(one: Mapping[str, float], two: Mapping[str, float], known: float = 0.5, unknown: float = 0.5, unseen: float = 0.5, reduction: float = 0.3334, cap: float = 4, floor: float = 0.0) -> float:
    """How much likelier the smaller multiset is as a sample of the larger one than a sample of all
    multisets of its size over the same outcomes. Outcomes that the larger one lacks are pooled.

    UNKNOWN gets its prior only where the sample holds it; where the larger one lacks it and the sample has pooled
    outcomes as well, both share the prior of the pool. An outcome without weight makes the ratio 0."""
    base, sample = sorted((dict(one), dict(two)), key=lambda m: (-sum(m.values()), -len(m)))
    weight = {k: v if k == "UNKNOWN" else min(v, cap) + known for k, v in base.items()}
    pooled = sum(v for k, v in sample.items() if k not in base and k != "UNKNOWN")
    drawn = {k: v for k, v in sample.items() if k in base or k == "UNKNOWN"}
    weight["UNSEEN"] = unseen
    if drawn.get("UNKNOWN"):
        if weight.get("UNKNOWN") or not pooled:
            weight["UNKNOWN"] = weight.get("UNKNOWN", 0) + unknown
        else:
            weight["UNKNOWN"], weight["UNSEEN"] = (x * unseen / (unknown + unseen) for x in (unknown, unseen))
    pooled -= min(int((sum(drawn.values()) + pooled) * reduction), pooled)
    if pooled:
        drawn["UNSEEN"] = pooled
    n, total = sum(drawn.values()), sum(weight.values())
    if n <= 0:
        return max(1.0, floor)
    if any(v and not weight[o] for o, v in drawn.items()):
        out = 0.0
    else:
        value = lgamma(n + 1) + sum(k * log(weight[o] / total) - lgamma(k + 1) for o, k in drawn.items() if k) + log_combination(len(weight) + n - 1, n)
        out = exp(min(value, 700.0))
    return out if out >= floor else floor if 100 * out >= floor else floor / 100
