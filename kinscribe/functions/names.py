"""Personal names: reversal, standard form, and membership in a syllable table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def standard_name(c: Column, reverse: Column) -> Column:
    """Lower case, without a homonym number and hyphens, parts swapped where reversed."""
    name = F.replace(F.regexp_replace(F.lower(F.trim(c)), r" \d{4}$", ""), F.lit("-"), F.lit(""))
    p = F.split(name, r"\s+")
    return F.when(reverse & (F.size(p) == 2), F.concat_ws(" ", p[1], p[0])).otherwise(name)


def syllables(part: Column, table: Column) -> Column:
    """1 for a syllable of the table, 2 for two of them, null otherwise (one wins over two)."""
    cuts = F.exists(F.sequence(F.lit(1), F.greatest(F.length(part) - 1, F.lit(1))), lambda i: F.array_contains(table, F.substring(part, F.lit(1), i)) & F.array_contains(table, F.substring(part, i + 1, F.length(part))))
    return F.when(F.array_contains(table, part), 1).when(cuts, 2)


def pinyin_length(name: Column, table: Column, surnames: Column | None = None) -> Column:
    """Syllables of a two-part name whose parts are both in the table, 2 or 3 together; else 0. Parts among the two-syllable surnames count as one."""
    p = F.split(F.replace(F.lower(name), F.lit("-"), F.lit("")), r"\s+")

    def count(part: Column) -> Column:
        n = syllables(part, table)
        return n if surnames is None else F.when(n.isNotNull() & F.array_contains(surnames, part), 1).otherwise(n)

    n = count(F.get(p, 0)) + count(F.get(p, 1))
    return F.when((F.size(p) == 2) & n.between(2, 3), n).otherwise(0)


def same_person(a: Column, b: Column) -> Column:
    """First initial and last part agree."""
    last = lambda x: F.element_at(F.split(F.lower(x), r"\s+"), -1)
    return (F.substring(F.lower(a), 1, 1) == F.substring(F.lower(b), 1, 1)) & (last(a) == last(b))
