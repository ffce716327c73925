"""Python over sorted runs: many small groups in one pass over a task's rows, one group held at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of one batch that goes back to the JVM.
ROWS = 4096


def over_runs(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[list[dict]], Iterable[tuple]], schema: StructType) -> DataFrame:
    """fn of the rows of each key, in order, as dictionaries; it gives tuples of schema.

    Says the same as groupBy(keys).applyInPandas(fn) without a pandas frame a group: rows are dealt by key, sorted and
    read as Arrow batches."""
    arrow = to_arrow_schema(schema)

    def run(batches):
        held, at, out = [], None, []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), arrow)], schema=arrow)

        for b in batches:
            for row in b.to_pylist():
                key = [row[k] for k in keys]
                if key != at:
                    if held:
                        out += fn(held)
                    held, at = [], key
                    if len(out) >= ROWS:
                        yield batch()
                        out = []
                held.append(row)
        if held:
            out += fn(held)
        if out:
            yield batch()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
