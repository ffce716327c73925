"""Whether two maps of counts look like draws of one distribution, for whole columns of pairs.

Maps are prepared by built-in map and array functions; only the sums of log-gammas run over Arrow batches, with numpy.
A pair is a row with two maps, so nothing is shuffled unless maps are expanded by a table of similar outcomes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least similarity to expand the larger map and the smaller one by, the discount of a similarity,
#: the most that an expanded outcome counts, and the most that all of them may add to a map's sum.
BASE_LEAST, SAMPLE_LEAST, DISCOUNT, MOST, BUDGET = 0.2, 0.3, 0.7, 1.0, 0.5


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers: Stirling's series from 8 up, reached by the recurrence."""
    x = np.asarray(x, float)
    y = np.where(x < 8, x + 8, x)
    z = 1 / (y * y)
    series = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z * (1 / 1188 - z * (691 / 360360 - z / 156)))))) / y
    steps = np.ones_like(x)
    for k in range(8):
        steps *= np.where(x < 8, x + k, 1.0)
    return series - np.log(steps)


def log_likelihood_ratios(weights: pd.Series, drawn: pd.Series) -> pd.Series:
    """Per row: log of the chance of drawing these counts by these weights, times the number of ways to draw as many."""
    out = np.full(len(weights), np.nan)
    rows = [k for k, w in enumerate(weights) if w is not None and len(w)]
    if rows:
        sizes = np.array([len(weights[k]) for k in rows])
        w, d = (np.concatenate([np.asarray(x[k], float) for k in rows]) for x in (weights, drawn))
        first = np.cumsum(sizes) - sizes
        total, n = np.add.reduceat(w, first), np.add.reduceat(d, first)
        with np.errstate(divide="ignore", invalid="ignore"):
            terms = np.where(d > 0, d * np.log(w / np.repeat(total, sizes)), 0.0) - log_gamma(d + 1)
        out[rows] = np.where(n > 0, np.add.reduceat(terms, first) + log_gamma(sizes + n) - log_gamma(sizes), 0.0)
    return pd.Series(out)


def total(m: Column) -> Column:
    return F.aggregate(F.map_values(m), F.lit(0.0), lambda a, x: a + x)


def expanded(pairs: DataFrame, keys: list[str], own: str, other: str, similar: DataFrame, least: float, discount: float = DISCOUNT, most: float = MOST, budget: float = BUDGET) -> DataFrame:
    """pairs whose map `own` also has outcomes of `other` that are similar to its own ones.

    similar: (a, b, similarity) by which a's count predicts b's. An outcome counts its best prediction, `most` at most;
    those that `other` holds more of come first (of equals by name), until they add `budget` of own's sum. keys name a pair."""
    s = similar.toDF("a", "b", "similarity").where(F.col("similarity") >= least)
    e = pairs.select(*keys, own, other, F.explode(own).alias("a", "n")).join(s, "a")
    e = e.where(F.map_contains_key(other, F.col("b")) & ~F.map_contains_key(own, F.col("b")))
    e = e.groupBy(*keys, "b").agg(F.least(F.max(F.col("n") * F.col("similarity") * discount), F.lit(most)).alias("n"), F.first(F.element_at(other, F.col("b"))).alias("theirs"))
    listed = e.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("theirs")).alias("order"), "b", "n"))).alias("__new"))
    before = lambda i: F.aggregate(F.slice("__new", F.lit(1), i), F.lit(0.0), lambda a, x: a + x["n"])
    taken = F.filter(F.transform("__new", lambda x, i: F.struct(x["b"].alias("key"), F.least(x["n"], F.lit(budget) * total(F.col(own)) - before(i)).alias("value"))), lambda x: x["value"] > 0)
    theirs = [F.col(k).alias(f"__{k}") for k in keys]
    met = pairs.join(listed.select(*theirs, "__new"), [pairs[k].eqNullSafe(F.col(f"__{k}")) for k in keys], "left")
    return met.withColumn(own, F.when(F.col("__new").isNull(), F.col(own)).otherwise(F.map_concat(own, F.map_from_entries(taken)))).drop("__new", *(f"__{k}" for k in keys))


def categorical_ratios(pairs: DataFrame, one: str, two: str, known: float = 0.5, unknown: float = 0.5, unseen: float = 0.5, reduction: float = 0.3334, cap: float = 4, floor: float = 0.0, similar: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """pairs with log_ratio and ratio: how much likelier the smaller of two maps (outcome to count) is as a sample of the
    larger one than any multiset of its size. numbers.sampling_ratio says the same of two dictionaries and has the rules.

    similar and keys: expand both maps first, see `expanded`. A null map has a null ratio, two empty ones have 1."""
    pairs = pairs.withColumns({one: F.col(one).cast("map<string,double>"), two: F.col(two).cast("map<string,double>")})
    swap = (total(F.col(one)) < total(F.col(two))) | ((total(F.col(one)) == total(F.col(two))) & (F.size(one) < F.size(two)))
    p = pairs.withColumns({"__base": F.when(swap, F.col(two)).otherwise(F.col(one)), "__sample": F.when(swap, F.col(one)).otherwise(F.col(two))})
    p = p.withColumn("__base", F.transform_values("__base", lambda k, v: F.when(k == "UNKNOWN", v).otherwise(F.least(v, F.lit(float(cap))))))
    if similar is not None:
        p = expanded(p, keys, "__base", "__sample", similar, BASE_LEAST)
        p = expanded(p, keys, "__sample", "__base", similar, SAMPLE_LEAST)
    base, sample = F.col("__base"), F.col("__sample")
    at = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0.0))
    pooled = total(F.map_filter(sample, lambda k, v: (k != "UNKNOWN") & ~F.map_contains_key(base, k)))
    p = p.withColumns({"__pooled": pooled, "__u": at(sample, F.lit("UNKNOWN")), "__bu": F.try_element_at(base, F.lit("UNKNOWN"))})
    pool, u, bu = F.col("__pooled"), F.col("__u"), F.col("__bu")
    shared = (u > 0) & (F.coalesce(bu, F.lit(0.0)) == 0) & (pool > 0)
    half = lambda x: F.lit(x * unseen / (unknown + unseen) if unknown + unseen else 0.0)
    unknown_weight = F.when(shared, half(unknown)).when(u > 0, F.coalesce(bu, F.lit(0.0)) + unknown).otherwise(bu)
    kinds = F.filter(F.map_keys(base), lambda k: k != "UNKNOWN")
    more = lambda x: F.when(unknown_weight.isNotNull(), F.array(x)).otherwise(F.array().cast("array<double>"))
    weights = F.concat(F.transform(kinds, lambda k: F.element_at(base, k) + known), more(unknown_weight), F.array(F.when(shared, half(unseen)).otherwise(F.lit(float(unseen)))))
    drawn = F.concat(F.transform(kinds, lambda k: at(sample, k)), more(u), F.array(pool - F.least(F.floor(total(sample) * reduction).cast("double"), pool)))
    out = p.withColumn("log_ratio", F.pandas_udf(log_likelihood_ratios, "double")(weights, drawn))
    out = out.withColumn("log_ratio", F.when(base.isNotNull() & sample.isNotNull(), F.col("log_ratio")))
    plain = F.exp(F.least("log_ratio", F.lit(700.0)))
    ratio = F.when(plain >= floor, plain).when(100 * plain >= floor, F.lit(float(floor))).otherwise(floor / 100)
    return out.withColumn("ratio", F.when(F.col("log_ratio").isNotNull(), ratio)).drop("__base", "__sample", "__pooled", "__u", "__bu")
