"""Arrays, maps and bit sets as multisets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def intersect(a: Column, b: Column) -> Column:
    """Elements of the longer array that the other has, repeats kept."""
    keep = lambda x, y: F.filter(x, lambda e: F.array_contains(y, e))
    return F.when(F.size(a) >= F.size(b), keep(a, b)).otherwise(keep(b, a))


def subtract(a: Column, b: Column) -> Column:
    return F.filter(a, lambda e: ~F.array_contains(b, e))


def union(*arrays: Column) -> Column:
    return F.array_distinct(F.flatten(F.array(*arrays)))


def sum_maps(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def subtract_maps(a: Column, b: Column) -> Column:
    return F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k))


def merge_maps(a: Column, b: Column) -> Column:
    """b wins."""
    return F.map_concat(subtract_maps(a, b), b)


def index_of_max(a: Column) -> Column:
    """First place of the greatest value that is neither null nor zero; -1 where there is none."""
    return F.coalesce(F.array_position(a, F.array_max(F.filter(a, lambda x: x != 0))) - 1, F.lit(-1))


def bits(x: Column, n: int) -> Column:
    return F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.getbit(x, i) == 1)


def normalized(a: Column) -> Column:
    s = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(s >= 1, F.transform(a, lambda x: x / s)).otherwise(a)


def skips(a: Column) -> Column:
    """Positions left out between neighbours of an ascending array."""
    n = F.greatest(F.size(a) - 1, F.lit(0))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(2), n), lambda x, y: F.greatest(y - x - 1, F.lit(0))), F.lit(0), lambda s, x: s + x)


def inversions(a: Column) -> Column:
    return F.aggregate(F.transform(a, lambda x, i: F.size(F.filter(a, lambda y, j: (j > i) & (y < x)))), F.lit(0), lambda s, x: s + x)


def jaccard(a: Column, b: Column, weighted: bool = False, floor: float = 0.0) -> Column:
    """Of two frequency maps; UNKNOWN matches nothing but widens the union."""
    known = lambda m: F.map_filter(m, lambda k, v: k != "UNKNOWN")
    one = lambda v: v.cast("double") if weighted else (v > 0).cast("double")
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, v: s + v)
    low = F.map_zip_with(known(a), known(b), lambda k, x, y: F.least(one(F.coalesce(x, F.lit(0))), one(F.coalesce(y, F.lit(0)))))
    all_ = F.map_zip_with(known(a), known(b), lambda k, x, y: F.greatest(one(F.coalesce(x, F.lit(0))), one(F.coalesce(y, F.lit(0)))))
    extra = sum(F.coalesce(one(F.try_element_at(m, F.lit("UNKNOWN"))), F.lit(0.0)) for m in (a, b))
    return F.greatest(F.coalesce(F.try_divide(total(low), total(all_) + extra), F.lit(0.0)), F.lit(floor))
