"""Which way round the names of a record are written: an aggregated vote over its syllable-table names.

A record's names are one list in one order, so evidence of any of them speaks for all: a hyphen or a two-syllable part
is a given name; where both parts are one syllable, known surnames and given names decide, or their log-likelihoods
break the tie. Everything is joins and aggregates: parts are counted once per distinct part, by equi-joins of its cuts
with the syllable table, and a record's vote is combined before it is shuffled, however many names it has.

Rows with a null key vote together, null names never vote; repeated rows vote again, which only doubles their likelihoods.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Surnames of two syllables, which count as one.
PAIR_SURNAMES = ["ouyang", "shangguan", "duanmu", "sima", "situ", "zhuge", "huangpu", "linghu", "murong"]


def syllable_counts(parts: DataFrame, syllables: DataFrame) -> DataFrame:
    """(part, n) of the distinct parts that are one syllable of the table (1) or two of them (2); one wins over two."""
    p, s = parts.select("part").where("part is not null").distinct(), syllables.select(F.col(syllables.columns[0]).alias("s")).distinct()
    cuts = p.where("length(part) > 1").select("part", F.explode(F.sequence(F.lit(1), F.length("part") - 1)).alias("i"))
    halves = cuts.select("part", F.expr("substring(part, 1, i)").alias("left"), F.expr("substring(part, i + 1)").alias("right"))
    two = halves.join(s.withColumnRenamed("s", "left"), "left").join(s.withColumnRenamed("s", "right"), "right").select("part", F.lit(2).alias("n"))
    one = p.join(s.withColumnRenamed("s", "part"), "part").select("part", F.lit(1).alias("n"))
    return one.unionAll(two).groupBy("part").agg(F.min("n").alias("n"))


def known_names(names: DataFrame, syllables: DataFrame, other_syllables: DataFrame | None = None, pair_surnames: list[str] | None = None) -> DataFrame:
    """One row per distinct name (lower case, without a homonym number) that is written in syllables of the table, two or
    three together: name, first, second (without hyphens), hyphen1, hyphen2, own1, own2 (syllables), other1, other2
    (syllables of the other table), given1, given2 (the part can't be a surname)."""
    pairs = F.array(*map(F.lit, PAIR_SURNAMES if pair_surnames is None else pair_surnames)).cast("array<string>")
    split = F.split("name", " ")
    part = lambda i: F.regexp_replace(split[i], "^([^-]*)-", "$1")  # noqa: E731  the first hyphen
    n = names.select("name").where("name is not null").distinct().where((F.size(split) == 2))
    n = n.select("name", part(0).alias("first"), part(1).alias("second"), split[0].contains("-").alias("hyphen1"), split[1].contains("-").alias("hyphen2"))
    parts = n.select(F.explode(F.array("first", "second")).alias("part"))
    own = syllable_counts(parts, syllables)
    other = syllable_counts(parts, other_syllables) if other_syllables is not None else own.select("part", F.lit(None).cast("int").alias("n")).limit(0)
    for side, at in (("first", "1"), ("second", "2")):
        n = n.join(own.select(F.col("part").alias(side), F.col("n").alias("own" + at)), side)
        n = n.join(other.select(F.col("part").alias(side), F.col("n").alias("other" + at)), side, "left")
    count = lambda side, own: F.when(F.array_contains(pairs, F.col(side)), 1).otherwise(F.col(own))
    given = lambda side, at: (F.col("own" + at) == 2) & ~F.array_contains(pairs, F.col(side)) & ~F.coalesce(F.col("other" + at) == 1, F.lit(False))
    return n.where((count("first", "own1") + count("second", "own2")).between(2, 3)).withColumns({"given1": given("first", "1"), "given2": given("second", "2")})


def plain_name(c):
    """Lower case, without a homonym number."""
    return F.regexp_replace(F.lower(c), r" \d{4}$", "")


def order_votes(rows: DataFrame, key: str, name: str, syllables: DataFrame, other_syllables: DataFrame | None = None, pair_surnames: list[str] | None = None, surname_logs: DataFrame | None = None, given_logs: DataFrame | None = None) -> DataFrame:
    """One row per key: key, n_known, reversed_sure, forward_sure, forward_log, reverse_log, verdict.

    verdict: 0 forward (given name first, or no syllable name at all), 1 reversed, -1 both are sure. surname_logs and
    given_logs: (part, log of its probability); without them one-syllable names do not vote."""
    named = rows.select(F.col(key).alias("key"), plain_name(F.col(name)).alias("name"))
    known = known_names(named, syllables, other_syllables, pair_surnames)
    logs = surname_logs is not None and given_logs is not None
    if logs:
        for side, at in (("first", "1"), ("second", "2")):
            for table, what in ((surname_logs, "surname"), (given_logs, "given_log")):
                known = known.join(table.toDF("x", "log").select(F.col("x").alias(side), F.col("log").alias(what + at)), side, "left")
        short = (F.col("own1") == 1) & (F.col("own2") == 1)
        not_forward = short & (F.col("surname2").isNull() | F.col("given_log1").isNull())
        not_reversed = short & (F.col("surname1").isNull() | F.col("given_log2").isNull())
        weighed = short & ~not_forward & ~not_reversed
        forward, back = (F.when(weighed, F.col(a) + F.col(b)).otherwise(0.0) for a, b in (("surname2", "given_log1"), ("surname1", "given_log2")))
    else:
        not_forward = not_reversed = F.lit(False)
        forward = back = F.lit(0.0)
    known = known.select(
        "name",
        ((F.col("hyphen2") & ~F.col("hyphen1")) | F.col("given2") | not_forward).alias("r"),
        ((F.col("hyphen1") & ~F.col("hyphen2")) | F.col("given1") | not_reversed).alias("f"),
        forward.alias("forward"),
        back.alias("back"),
    )
    v = named.join(known, "name", "left").groupBy("key").agg(
        F.count("r").alias("n_known"),
        F.coalesce(F.bool_or("r"), F.lit(False)).alias("reversed_sure"),
        F.coalesce(F.bool_or("f"), F.lit(False)).alias("forward_sure"),
        F.coalesce(F.sum("forward"), F.lit(0.0)).alias("forward_log"),
        F.coalesce(F.sum("back"), F.lit(0.0)).alias("reverse_log"),
    )
    likelier = F.round(F.col("forward_log") - F.col("reverse_log"), 6) < 0
    return v.withColumn("verdict", F.when(F.col("reversed_sure") & F.col("forward_sure"), -1).when(F.col("reversed_sure"), 1).when(F.col("forward_sure"), 0).otherwise(likelier.cast("int")))


def standard_names(rows: DataFrame, key: str, name: str, votes: DataFrame, syllables: DataFrame, other_syllables: DataFrame | None = None, pair_surnames: list[str] | None = None) -> DataFrame:
    """rows with `standard`: syllable names lose their hyphens and stand given name first, where the record's vote is
    known and they aren't better read by the other table; other names are in lower case without a homonym number."""
    plain = rows.withColumn("__name", plain_name(F.col(name)))
    known = known_names(plain.select(F.col("__name").alias("name")), syllables, other_syllables, pair_surnames)
    front = lambda at: F.col("own" + at).isNotNull() | F.col("other" + at).isNotNull()
    # in the order that the vote gives, the second part is a surname of the other table only
    foreign = lambda a, b: ~(F.col("own" + b) == 1) & front(a) & F.coalesce(F.col("other" + b) == 1, F.lit(False))
    known = known.select(F.col("name").alias("__name"), foreign("1", "2").alias("__f0"), foreign("2", "1").alias("__f1"))
    j = plain.join(known, "__name", "left").join(votes.select(F.col("key").alias("__key"), F.col("verdict").alias("__v")), F.col(key).eqNullSafe(F.col("__key")), "left")
    bare = F.replace(F.col("__name"), F.lit("-"), F.lit(""))
    p = F.split(bare, " ")
    standard = F.when(F.col("__f0").isNull() | (F.col("__v") < 0), F.col("__name")).when(F.col("__v") == 1, F.when(F.col("__f1"), F.col("__name")).otherwise(F.concat_ws(" ", p[1], p[0]))).otherwise(F.when(F.col("__f0"), F.col("__name")).otherwise(bare))
    return j.withColumn("standard", standard).drop("__name", "__f0", "__f1", "__key", "__v")
