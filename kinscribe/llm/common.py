"""Shared parts of the training-data operators: Arrow text buffers, vectorised words and
hashes, packed rows, checkpoints and connected components.

Texts are handled as the UTF-8 bytes of Arrow buffers, so that whole batches are scanned by
numpy without a Python object per document.
"""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Odd multiplier of the polynomial hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
#: Bytes of text that one vectorised step takes (a longer document is one step of its own).
STEP_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64) * U64(0xD1342543DE82EF95))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for later calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        x = np.full(max(n, STEP_BYTES + 1), base, np.uint64)
        x[0] = 1
        have = np.cumprod(x, dtype=np.uint64)
        if n <= 4 * STEP_BYTES:
            _powers[base] = have
    return have[:n]


class Hasher:
    """Hashes of any byte ranges of one buffer, from one running sum."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_HASH[data] * powers(BASE, len(data)), out=self.sums[1:])
        self.back = powers(BASE_INV, len(data) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not wide and not pa.types.is_string(column.type) and not pa.types.is_binary(column.type):
        column = column.cast(pa.string())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def steps(data: np.ndarray, offsets: np.ndarray, size: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of documents of about size bytes."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        j = min(j, n, i + 20_000)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def class_table(separators: str) -> np.ndarray:
    """True for bytes that belong to words; separators: 'space' or 'ascii'."""
    t = np.ones(256, bool)
    if separators == "space":
        t[[0x20, *range(0x09, 0x0E)]] = False
    else:
        t[:0x80] = False
        t[0x30:0x3A] = True
        t[0x61:0x7B] = True
    return t


#: Words of [^\x20\x09-\x0D]+ and of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after A-Z are lower-cased).
SPACE_WORDS, PLAIN_WORDS = class_table("space"), class_table("ascii")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, number of words of each document); words never cross documents."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = table[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def groups_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first places in that order) of equal keys."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return order, first


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs twice or more."""
    order, first = groups_of(keys)
    sizes = np.diff(np.append(first, len(keys)))
    out = np.zeros(len(keys), bool)
    out[order] = np.repeat(sizes > 1, sizes)
    return out


def by_shard(shard: np.ndarray):
    """(shard, places) of each shard that occurs."""
    order, first = groups_of(shard)
    for a, b in zip(first, np.append(first[1:], len(order))):
        yield int(shard[order[a]]), order[a:b]


def pack(*arrays: np.ndarray, level: int = 3) -> bytes:
    """One compressed row from arrays; wider items are split into planes of bytes, which compress better."""
    head = [len(arrays)]
    body = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head += ["BHIQqif?".index(a.dtype.char if a.dtype.char not in "lL" else {"l": "q", "L": "Q"}[a.dtype.char]), len(a)]
        body.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b"")
    return zstandard.ZstdCompressor(level=level).compress(np.array(head, np.int64).tobytes() + b"".join(body))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(n, 2)
    at, out = 8 + 16 * n, []
    for kind, size in head:
        dtype = np.dtype("BHIQqif?"[kind])
        planes = np.frombuffer(raw, np.uint8, size * dtype.itemsize, at).reshape(dtype.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype) if size else np.zeros(0, dtype))
        at += size * dtype.itemsize
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of ranges, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return np.arange(total, dtype=np.int64) + shift


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of documents small; long texts otherwise make batches of gigabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's shared folder: the one that the cluster names in spark.checkpoint.dir.

    Only where none is set and executors are on this machine (tests) a temporary folder is taken."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.split("[")[0] == "local":
            raise RuntimeError("a cluster has to name a shared folder in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the reliable checkpoint folder and read from there: lineage ends here."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def let_go(spark: SparkSession) -> None:
    """Collects garbage here and in the driver's JVM. Spark deletes shuffles, broadcasts and checkpoints only once the JVM
    has collected what refers to them, which a driver with room to spare puts off while disk and heap fill."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def pieces(spark: SparkSession, total_bytes: int, target: int = 8 << 20, least: int = 48) -> int:
    """How many buckets keep each near target bytes; grows with the input."""
    return max(least, -(-total_bytes // target))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column, over all rows."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b); nodes without an edge are absent.

    Alternating large-star and small-star rounds: the longest path shortens by a constant
    factor each time. A hub costs a minimum and a join on the hub, never a list of its neighbours.
    Null ends and loops are ignored; repeated edges count once; an empty input gives no rows."""
    spark = edges.sparkSession
    a, b = edges.columns[:2]
    e = checkpointed(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"`{a}` is not null and `{b}` is not null and u != v").distinct())
    seen = None
    for _ in range(max_rounds):
        now = tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
        if now[0] == 0 or now == seen:
            break
        seen = now
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        e = checkpointed(small.where("u != v").distinct())
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
