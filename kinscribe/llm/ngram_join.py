"""N-gram Jaccard join (operator 10): adaptive multi-match prefixes.

A document's set is its distinct shingles of WORDS words. Documents link when
100 * intersection >= PERCENT * union; the result is their components. Both are parameters (op10: 4 and 85).

Method: shingles are ordered from rare to frequent by their exact document frequency. A
document's prefix with level l is its first n - ceil(n * PERCENT / 100) + l shingles; two linked documents
share at least the lesser of their levels in their prefixes, and more where their sizes ask for it. Each document picks the level
whose estimated cost (postings read, and candidates that would be verified, fewer the more
shared tokens they need) is least. Candidates are verified exactly.

Scale: shingle hashes are packed by shard, so a shuffle row is thousands of shingles. Shingles
of one document only, most of them, end there. A document that shares under PERCENT % of its
shingles with any other can have no partner and goes no further. Documents with equal sets are
one item. The rest is similarity.py.

A shingle's 64-bit hash is dealt by its remainder of the number of shards; the quotient's lowest 48
bits, all of it from 65536 shards up, stand for the shingle within its shard, at any number of shards.

Defined cases: null, empty or wordless text has an empty set and links with nothing; under WORDS
words the whole sequence is the one shingle; rows with a null doc_id get a null component; rows
that share a doc_id are one document for links and keep a row each; an empty table gives an
empty one. Only the two named columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE_WORDS, Hasher, by_shard, checkpointed, connected_components, groups_of, mix, pack, pieces, ranges, small_batches, steps, text_buffers, text_bytes, unpack, word_spans
from .similarity import similar_links

WORDS, PERCENT, LEVELS = 4, 85, 6
U64 = np.uint64
#: What of a hash's quotient by the number of shards is kept; beside the shard it makes a token of 64 bits.
REST = U64((1 << 48) - 1)
ORDER = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles, document by document; their number in each document)."""
    data = LOWER[data]
    starts, ends, words = word_spans(data, offsets, SPACE_WORDS)
    h = Hasher(data).of(starts, ends)
    first = np.concatenate(([0], np.cumsum(words)[:-1])).astype(np.int64)
    count = np.where(words >= width, words - width + 1, (words > 0).astype(np.int64))
    at = ranges(first, count)
    doc = np.repeat(np.arange(len(words)), count)
    have = np.minimum(words, width)[doc]
    key = np.zeros(len(at), np.uint64)
    for k in range(width):
        live = have > k
        key[live] = mix(key[live] * ORDER[k % 4] + h[at[live] + k] + U64(k))
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))) if len(key) else np.zeros(0, bool)
    return key[new], np.bincount(doc[new], minlength=len(words))


def shingle_batches(batches, size: int, width: int = WORDS):
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        keys, counts = [], []
        for _, _, d, o in steps(data, offsets):
            k, c = shingles(d, o, width)
            keys.append(k)
            counts.append(c)
            if sum(map(len, keys)) > size:
                m = sum(map(len, counts))
                yield ids[:m], np.concatenate(keys), np.concatenate(counts)
                ids, keys, counts = ids[m:], [], []
        if counts:
            yield ids, np.concatenate(keys), np.concatenate(counts)


def send_shingles(shards: int, width: int = WORDS):
    def run(batches):
        for ids, keys, counts in shingle_batches(batches, 2_000_000, width):
            ids = ids.astype(np.int64)
            doc = np.repeat(np.arange(len(ids)), counts)
            out = []
            for s, x in by_shard((keys % U64(shards)).astype(np.int64)):
                who, n = np.unique(doc[x], return_counts=True)
                out.append((s, pack(ids[who], n.astype(np.uint32), counts[who].astype(np.uint32), keys[x] // U64(shards) & REST)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], ["shard", "payload"])

    return run


def shared_shingles(homes: int):
    """Of one shard: the shingles that two documents or more have, with their frequency, sent to each document's home."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        ids, n, total, keys = (np.concatenate(x) for x in zip(*(unpack(x.as_py()) for x in table.column("payload"))))
        row = np.repeat(np.arange(len(ids)), n)
        order, first = groups_of(keys)
        size = np.diff(np.append(first, len(keys)))
        often = np.empty(len(keys), np.int64)
        often[order] = np.repeat(size, size)
        place = np.flatnonzero(often > 1)
        token = (keys[place] * U64(homes) + U64(shard)).view(np.int64)
        row, often = row[place], np.minimum(often[place], 0xFFFFFFFF).astype(np.uint32)
        out = []
        for h, x in by_shard((mix(ids[row].view(np.uint64)) % U64(homes)).astype(np.int64)):
            who, m = np.unique(row[x], return_counts=True)
            out.append((h, pack(ids[who], m.astype(np.uint32), total[who], token[x], often[x])))
        return pa.Table.from_arrays([pa.array([h for h, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], ["shard", "payload"])

    return run


ITEM_DDL = "id long, n long, bound long, need long, rest long, digest binary, tokens binary, prefix array<long>"
ITEM = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("bound", pa.int64()), ("need", pa.int64()), ("rest", pa.int64()), ("digest", pa.binary()), ("tokens", pa.binary()), ("prefix", pa.list_(pa.int64()))])


def level_of(often: np.ndarray, base: int) -> int:
    """The level of least estimated cost. often: frequencies of the shared tokens in their order; base: how many a prefix of level 0 has.

    Reading a posting costs 1, verifying 40; about postings / level**2 partners are met level times."""
    read = np.concatenate(([0], np.cumsum(often - 1)))
    best, least = 1, None
    for level in range(1, LEVELS + 1):
        postings = float(read[min(max(base + level, 0), len(often))])
        cost = postings + 40.0 * postings / level**2
        if least is None or cost < least:
            best, least = level, cost
        if base + level >= len(often):
            break
    return best


def gather(percent: int):
    """Of one home: the documents that can have partners, with their shared tokens from rare to frequent and their adaptive prefix."""

    def run(table: pa.Table) -> pa.Table:
        ids, m, total, token, often = (np.concatenate(x) for x in zip(*(unpack(x.as_py()) for x in table.column("payload"))))
        row = np.repeat(np.arange(len(ids)), m)
        order = np.lexsort((token, often, ids[row]))
        doc, token, often, total = ids[row][order], token[order], often[order].astype(np.int64), total[row][order]
        first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, np.int64)
        out = []
        for a, b in zip(first.tolist(), np.append(first[1:], len(doc)).tolist()):
            n, t, f = int(total[a:b].max()), token[a:b], often[a:b]
            if b - a > 1:
                new = np.concatenate(([True], t[1:] != t[:-1]))
                t, f = t[new], f[new]
            if 100 * len(t) < percent * n:
                continue
            base = n - -(-percent * n // 100) - (n - len(t))
            level = level_of(f, base)
            ordered = np.sort(t)
            digest = hashlib.sha1(ordered.tobytes()).digest() if len(t) == n else None
            out.append((int(doc[a]), n, len(t), level, max(len(t) - base - level, 0), digest, pack(ordered), t[: base + level].tolist()))
        return pa.Table.from_arrays([pa.array([x[i] for x in out], ITEM.field(i).type) for i in range(8)], schema=ITEM)

    return run


def sizes(width: int):
    def run(batches):
        for ids, _, counts in shingle_batches(batches, 1 << 62, width):
            yield pa.RecordBatch.from_arrays([pa.array(ids, from_pandas=True).cast(pa.int64()), pa.array(counts.astype(np.int64))], ["doc_id", "n_shingles"])

    return run


def ngram_jaccard_join(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS, percent: int = PERCENT, shard_bytes: int = 12 << 20) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document, for shingles of so many words and links from so many percent; see the module."""
    spark = docs.sparkSession
    small_batches(spark)
    pick = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    shards = pieces(spark, text_bytes(pick), shard_bytes)
    sent = pick.where("doc_id is not null").mapInArrow(send_shingles(shards, words), "shard long, payload binary")
    homes = sent.groupBy("shard").applyInArrow(shared_shingles(shards), "shard long, payload binary")
    found = checkpointed(homes.groupBy("shard").applyInArrow(gather(percent), ITEM_DDL))
    copies = checkpointed(found.where("digest is not null").groupBy("n", "digest").agg(F.min("id").alias("rep"), F.count("*").alias("m")).where("m > 1").select("digest", "rep"))
    same = found.select("id", "digest").join(copies, "digest").where("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    same = checkpointed(same)
    items = found.join(same.select(F.col("a").alias("id")), "id", "left_anti")
    links = similar_links(items, items.select(F.explode("prefix").alias("token"), "id"), percent, shards)
    parts = connected_components(links.unionAll(same))
    own = pick.mapInArrow(sizes(words), "doc_id long, n_shingles long")
    return own.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs without those that have a smaller doc_id in their component."""
    gone = ngram_jaccard_join(docs, id_column, text_column, words, percent).where("component_id < doc_id").select(F.col("doc_id").alias(id_column))
    return docs.join(gone, id_column, "left_anti").select(docs.columns)
