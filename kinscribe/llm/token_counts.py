"""Token counts (operator 4): a separator scan over flat token files without an index.

A token file is a stream of ids, each document followed by an end id. Files are read as blocks
cut at fixed sizes, wherever documents end. In each block numpy searches all end ids at once;
a prefix scan over the blocks of a file then stitches documents that cross blocks: the number of
ends before a block, and where the last of them stood.

Scale: only ends leave a block, and are written once, so blocks are made and scanned once. The
scan has two levels, blocks within groups of GROUP and groups within a file, so that no window
holds more than GROUP rows of a file of 2**40 tokens.

Defined cases: an empty file has no document; two ends in a row are an empty document; tokens
after the last end of a file are a document with terminated false; files may hold any number of
blocks of any size, also empty ones, and rows in any order; null data counts as empty. For
documents: null text is an empty document, repeated rows are counted each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, small_batches
from .tokens import Encoder

END_ID, BLOCK_TOKENS, GROUP = 50256, 1 << 18, 4096
BLOCKS = "file string, block long, data binary, ended array<long>"


def token_files(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS, width: int = 2) -> DataFrame:
    """Blocks (file, block, data, ended) of raw little-endian token files below 2 GB at path, by Spark's own reader."""
    size = block_tokens * width
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    cut = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.length("content") - 1, F.lit(0)) / size)))
    return files.select("file", cut.alias("block"), "content").select("file", "block", F.substring(F.col("content"), (F.col("block") * size + 1).cast("int"), F.lit(size)).alias("data"), F.lit(None).cast("array<long>").alias("ended"))


def flattened(tokenizer: str, end_id: int, block_tokens: int):
    def run(batches):
        from pyspark import TaskContext

        encode, name, block = Encoder(tokenizer), f"part-{TaskContext.get().partitionId():06d}", 0
        held, size, ended, marks = [], 0, [], []

        def cut(n):
            nonlocal held, size, ended, marks, block
            flat = np.concatenate(held) if held else np.zeros(0, np.uint16)
            mine = [d for d, at in zip(ended, marks) if at < n]
            out = pa.RecordBatch.from_pydict({"file": pa.array([name]), "block": pa.array([block], pa.int64()), "data": pa.array([flat[:n].tobytes()], pa.binary()), "ended": pa.array([mine], pa.list_(pa.int64()))})
            held, size, block = [flat[n:]], len(flat) - n, block + 1
            ended, marks = ended[len(mine) :], [at - n for at in marks[len(mine) :]]
            return out

        for batch in batches:
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array(encode.fast.encode_ordinary(text or ""), np.uint16)
                held += [ids, np.array([end_id], np.uint16)]
                size += len(ids) + 1
                ended.append(d)
                marks.append(size - 1)
                while size >= block_tokens:
                    yield cut(block_tokens)
        if size:
            yield cut(size)

    return run


def flat_blocks(docs: DataFrame, tokenizer: str, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The flat token stream of each partition of docs, as blocks; `ended` names the documents whose end lies in a block. Special strings in texts are ordinary text, so end ids stand only between documents."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(flattened(tokenizer, end_id, block_tokens), BLOCKS)


def scan(end_id: int, dtype: str):
    def run(batches):
        for batch in batches:
            n, ends = [], []
            for data in batch.column("data"):
                ids = np.frombuffer(data.as_py() or b"", dtype)
                n.append(len(ids))
                ends.append(np.flatnonzero(ids == end_id))
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(n, pa.int64()), pa.array(ends, pa.list_(pa.int64())), batch.column("ended")], ["file", "block", "n", "ends", "ended"])

    return run


def count_tokens(blocks: DataFrame, end_id: int = END_ID, dtype: str = "<u2") -> DataFrame:
    """(file, ordinal, doc_id, start, n_tokens, terminated) of every document of the files; doc_id where blocks name it."""
    s = checkpointed(blocks.mapInArrow(scan(end_id, dtype), "file string, block long, n long, ends array<long>, ended array<long>"))
    s = s.withColumn("grp", F.expr(f"block div {GROUP}")).withColumn("m", F.size("ends").cast("long"))
    inside = Window.partitionBy("file", "grp").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero, none = F.lit(0).cast("long"), F.lit(-1).cast("long")
    s = s.withColumn("at", F.coalesce(F.sum("n").over(inside), zero)).withColumn("before", F.coalesce(F.sum("m").over(inside), zero))
    s = s.withColumn("last", F.when(F.col("m") > 0, F.col("at") + F.element_at("ends", -1))).withColumn("prior", F.max("last").over(inside))
    groups = s.groupBy("file", "grp").agg(F.sum("n").alias("gn"), F.sum("m").alias("gm"), F.max("last").alias("gl"))
    over = Window.partitionBy("file").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("gat", F.coalesce(F.sum("gn").over(over), zero)).withColumn("gbefore", F.coalesce(F.sum("gm").over(over), zero)).withColumn("gprior", F.coalesce(F.max(F.col("gat") + F.col("gl")).over(over), none))
    j = s.join(groups.select("file", "grp", "gat", "gbefore", "gprior"), ["file", "grp"])
    j = j.withColumn("base", F.col("gat") + F.col("at")).withColumn("prev", F.coalesce(F.col("gat") + F.col("prior"), F.col("gprior")))
    lone = F.transform("ends", lambda x: x + F.col("base"))
    starts = F.concat(F.array(F.col("prev")), lone)
    pairs = F.zip_with(F.slice(starts, F.lit(1), F.size("ends")), lone, lambda a, b: F.struct((a + 1).alias("start"), (b - a - 1).alias("n_tokens")))
    docs = j.select("file", (F.col("gbefore") + F.col("before")).alias("first"), "ended", F.posexplode(pairs).alias("k", "d")).select("file", (F.col("first") + F.col("k")).alias("ordinal"), F.get("ended", F.col("k")).alias("doc_id"), "d.start", "d.n_tokens", F.lit(True).alias("terminated"))
    tails = j.groupBy("file").agg(F.max(F.col("base") + F.col("n")).alias("total"), F.sum("m").alias("ordinal"), F.max(F.greatest("prev", F.coalesce(F.col("gat") + F.col("last"), none))).alias("end")).where("total > end + 1")
    return docs.unionAll(tails.select("file", "ordinal", F.lit(None).cast("long"), F.col("end") + 1, F.col("total") - F.col("end") - 1, F.lit(False)))
