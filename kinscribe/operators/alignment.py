"""Matching two multisets of rows by key: the first of a key with the other side's first, the second with the second, ...

Ordinals are counted without a window over a key, so a key may hold any share of the rows: rows are dealt by ranges of
(key, order), numbered along each range, and what a range starts with is corrected by the rows of its first key in the
ranges before. Only keys that reach over the end of a range need that, at most one a range, so the table of corrections
has at most as many rows as there are ranges and is broadcast. The join is on key and ordinal, which spreads a key too.

Null keys match null keys; rows equal in key and order are numbered in the order they were read; an empty side leaves
every row of the other unmatched.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .graph import checkpoint_folder


def numbered_runs(keys: list[str], schema: StructType):
    """Adds the task's number and, along its sorted rows, the place of each row among those of its key, from 1."""
    arrow = to_arrow_schema(schema)

    def run(batches):
        from pyspark import TaskContext

        task, last, count = TaskContext.get().partitionId(), None, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            columns = [b.column(b.schema.get_field_index(k)) for k in keys]
            new = np.zeros(n, bool)
            for c in columns:
                code = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            key = [c[0].as_py() for c in columns]
            place = np.arange(n)
            start = np.maximum.accumulate(np.where(new, place, 0))
            ordinal = place - start + 1
            if key == last:
                ordinal[start == 0] += count
            last, count = [c[n - 1].as_py() for c in columns], int(ordinal[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, task), pa.int32()), pa.array(ordinal, pa.int64())], schema=arrow)

    return run


def with_ordinals(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with `ordinal`, the place of a row among those of its key, from 1."""
    spark = df.sparkSession
    # a null comes first in a range as in a sort
    dealt = df.withColumn("__id", F.monotonically_increasing_id()).repartitionByRange(*keys, *order, "__id").sortWithinPartitions(*keys, *order, "__id").drop("__id")
    schema = StructType([*dealt.schema.fields, StructField("__range", IntegerType()), StructField("ordinal", LongType())])
    at = f"{checkpoint_folder(spark)}/ordinals-{uuid.uuid4().hex}"
    dealt.mapInArrow(numbered_runs(keys, schema), schema).write.parquet(at)
    rows = spark.read.parquet(at)
    ends = rows.groupBy(*keys, "__range").agg(F.max("ordinal").alias("n"))
    per_key = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    late = ends.withColumn("before", F.sum("n").over(per_key)).where("before is not null").select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__range").alias("__r"), "before")
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    met = rows.join(F.broadcast(late), [F.col("__range") == F.col("__r"), *same], "left")
    return met.withColumn("ordinal", F.col("ordinal") + F.coalesce("before", F.lit(0))).select(*df.columns, "ordinal")


def align(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows of both sides with their keys, `ordinal` and `side`: both, left or right. Other columns must have different names."""
    a, b = with_ordinals(left, keys, left_order), with_ordinals(right, keys, right_order)
    on = [*keys, "ordinal"]
    b = b.withColumnsRenamed({k: f"__{k}" for k in on})
    j = a.withColumn("__left", F.lit(True)).join(b.withColumn("__right", F.lit(True)), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in on], "full_outer")
    shared = [F.when(F.col("__left"), F.col(k)).otherwise(F.col(f"__{k}")).alias(k) for k in on]
    rest = [c for c in (*left.columns, *right.columns) if c not in keys]
    return j.select(*shared, *rest, F.when(F.col("__left") & F.col("__right"), "both").when(F.col("__left"), "left").otherwise("right").alias("side"))
