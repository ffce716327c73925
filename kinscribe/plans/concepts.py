"""Vendors as vectors of the items that they sold, merged along the taxonomy of items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import concepts as C
from ..operators import taxonomy as T
from ..operators.graph import checkpointed
from .queries import query, t
from .taxonomies import offered


@query(None)
def merged_concepts(s, d):
    """Order-dependent, so without SQL: tested against plain loops."""
    up = checkpointed(T.inheritance(T.admitted(offered(s, d))))
    sold = t(s, d, "sale_lines").groupBy("vendor_id", "item_id").agg(F.sum("quantity").alias("weight"))
    m = C.merged_terms(sold.select(F.col("vendor_id").alias("vector"), F.concat(F.lit("item:"), F.col("item_id").cast("string")).alias("term"), "weight"), up, reach=2)
    return C.compacted(m).withColumnRenamed("vector", "vendor_id")
