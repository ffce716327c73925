"""Suffix-array dedup (operator 1): removes bytes that repeat earlier documents.

A byte goes if a string of `length` bytes that covers it also starts in a document with a
smaller doc_id. All is judged on the input; matches never cross documents.

Method: prefix-free parsing over shards. A rolling hash of GRAM bytes gives every window of
`length` bytes a trigger, the least hash inside it; a phrase is a run of windows with one
trigger, with all their bytes. Equal windows have equal triggers, so the shard of a trigger
holds every copy of its windows and its suffix order is the corpus order for them. In a shard
the distinct phrases are put into suffix order (suffix_order.py: suffix arrays of dictionary
and parse); neighbours that agree on `length` bytes are one string, whose least doc_id wins.

Scale: documents are packed into blocks of a few MB (one checkpoint). A first round sends
trigger hashes only, so phrases without a second document are never sent. Phrases are made
distinct in each block before they are sent, so a passage in a third of all documents costs
one entry a block. The number of shards follows the bytes of the input.

Defined cases: null text counts as empty; a text shorter than `length` loses nothing; rows
with a null doc_id come back as they are; a doc_id that occurs on several rows is one
document for the rule (its rows never remove from each other); an empty table gives an empty
one. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BASE_INV, Hasher, by_shard, checkpointed, groups_of, mix, pack, pieces, powers, ranges, repeated, small_batches, steps, text_buffers, unpack
from .suffix_order import suffix_order

GRAM, BLOCK_BYTES = 20, 4 << 20
U64 = np.uint64


def pack_blocks(batches):
    """Documents to rows (block, bytes, blob); a block's number is made of its first doc_id and size, and is fixed by the checkpoint."""
    from pyspark import TaskContext

    part, n = TaskContext.get().partitionId(), 0
    ids, sizes, texts, held = [], [], [], 0

    def flush():
        nonlocal ids, sizes, texts, held, n
        blob = pack(np.concatenate(ids), np.concatenate(sizes), np.concatenate(texts))
        out = pa.RecordBatch.from_pydict({"block": pa.array([(part << 32) + n], pa.int64()), "bytes": pa.array([held], pa.int64()), "blob": pa.array([blob], pa.binary())})
        ids, sizes, texts, held, n = [], [], [], 0, n + 1
        return out

    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        doc = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for i, j, d, o in steps(data, offsets, BLOCK_BYTES // 4):
            ids.append(doc[i:j])
            sizes.append(np.diff(o))
            texts.append(d.copy())
            held += len(d)
            if held >= BLOCK_BYTES or sum(map(len, ids)) > 50_000:
                yield flush()
    if ids:
        yield flush()


def gram_hashes(h: Hasher, size: int) -> np.ndarray:
    """Of every GRAM bytes of a buffer of that size."""
    return mix((h.sums[GRAM:] - h.sums[:-GRAM]) * powers(BASE_INV, size + 1)[: size - GRAM + 1])


def key_of(trigger: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return mix(trigger ^ mix(whole))


class Phrases:
    """The phrases of a block: trigger, hash, document, first place and number of windows of each."""

    def __init__(self, blob: bytes, length: int):
        self.ids, sizes, self.data = unpack(blob)
        self.offsets = np.concatenate(([0], np.cumsum(sizes)))
        span = length - GRAM + 1
        parts = []
        for i, _, d, o in steps(self.data, self.offsets):
            count = np.maximum(np.diff(o) - length + 1, 0)
            if not count.any():
                continue
            h = Hasher(d)
            low = gram_hashes(h, len(d))
            width = 1
            while width * 2 <= span:
                low = np.minimum(low[:-width], low[width:])
                width *= 2
            if width < span:
                low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
            at = ranges(o[:-1], count)
            low, doc = low[at], np.repeat(np.arange(len(count)), count)
            new = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]))))
            windows = np.diff(np.append(new, len(at)))
            start = at[new]
            parts.append((low[new], h.of(start, start + windows + length - 1), doc[new] + i, start + self.offsets[i], windows))
        empty = (np.zeros(0, U64), np.zeros(0, U64), *[np.zeros(0, np.int64)] * 3)
        self.trigger, self.hash, self.doc, self.start, self.windows = (np.concatenate(x) for x in zip(*parts)) if parts else empty
        self.key = key_of(self.trigger, self.hash)


def distinct(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a place of each distinct key, its least document, its largest one)."""
    order, first = groups_of(keys)
    if not len(order):
        return order, docs[:0], docs[:0]
    return order[first], np.minimum.reduceat(docs[order], first), np.maximum.reduceat(docs[order], first)


def rows(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v, pa.binary() if k == "payload" else pa.int64()) for k, v in columns.items()})


ROW = "shard long, block long, payload binary"


def send_triggers(shards: int, length: int):
    def run(batches):
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("blob")):
                p = Phrases(blob.as_py(), length)
                place, least, most = distinct(p.trigger, p.ids[p.doc])
                t = p.trigger[place]
                out = [(s, block, pack(t[x] >> U64(16), least[x] != most[x])) for s, x in by_shard((t % U64(shards)).astype(np.int64))]
                if out:
                    yield rows(**dict(zip(("shard", "block", "payload"), zip(*out))))

    return run


def shared_triggers(table: pa.Table) -> pa.Table:
    """Of one shard: for each block a bit for each trigger that it sent, set where a second document has it."""
    got = [unpack(x.as_py()) for x in table.column("payload")]
    keys = np.concatenate([x[0] for x in got])
    alone = ~np.concatenate([x[1] for x in got])
    order, first = groups_of(keys)
    size = np.diff(np.append(first, len(keys)))
    keep = np.empty(len(keys), bool)
    keep[order] = np.repeat(size > 1, size)
    keep |= ~alone
    cut = np.split(keep, np.cumsum([len(x[0]) for x in got])[:-1])
    out = [(s, b, pack(np.packbits(k))) for s, b, k in zip(table.column("shard").to_pylist(), table.column("block").to_pylist(), cut) if k.any()]
    return pa.Table.from_batches([rows(**{n: [x[i] for x in out] for i, n in enumerate(("shard", "block", "payload"))})])


def send_phrases(shards: int, length: int):
    def run(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        if blocks.num_rows and replies.num_rows:
            marks = dict(zip(replies.column("shard").to_pylist(), replies.column("payload")))
            block, p = blocks.column("block")[0].as_py(), Phrases(blocks.column("blob")[0].as_py(), length)
            t = p.trigger[distinct(p.trigger, p.ids[p.doc])[0]]
            wanted = [t[x][np.unpackbits(unpack(marks[s].as_py())[0], count=len(x)).astype(bool)] for s, x in by_shard((t % U64(shards)).astype(np.int64)) if s in marks]
            shared = np.sort(np.concatenate(wanted))
            at = np.searchsorted(shared, p.trigger)
            mine = np.flatnonzero(shared[np.minimum(at, len(shared) - 1)] == p.trigger)
            place, least, most = distinct(p.key[mine], p.ids[p.doc[mine]])
            place = mine[place]
            for s, x in by_shard((p.trigger[place] % U64(shards)).astype(np.int64)):
                q = place[x]
                size = p.windows[q] + length - 1
                out.append((s, block, pack(size.astype(np.uint32), least[x], most[x], p.data[ranges(p.start[q], size)])))
        return pa.Table.from_batches([rows(**{n: [x[i] for x in out] for i, n in enumerate(("shard", "block", "payload"))})])

    return run


def first_documents(trigger, key, size, least, text, length):
    """Runs (phrase, first window, windows, first document) for the distinct phrases of a shard.

    A phrase alone with its trigger has one run. The others are put into suffix order, where
    equal windows are neighbours."""
    _, kind, count = np.unique(trigger, return_inverse=True, return_counts=True)
    several = count[kind] > 1
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    windows = size - length + 1
    one = np.flatnonzero(~several)
    found = [(one, np.zeros(len(one), np.int64), windows[one], least[one])]
    many = np.flatnonzero(several)
    if len(many):
        # phrases that share a trigger by chance hold no window twice: they need no order
        at = ranges(begin[many], windows[many])
        twice = repeated(Hasher(text).of(at, at + length))
        some = np.add.reduceat(twice, np.cumsum(windows[many]) - windows[many]) > 0
        lone = many[~some]
        found.append((lone, np.zeros(len(lone), np.int64), windows[lone], least[lone]))
        many = many[some]
    if len(many):
        data = text[ranges(begin[many], size[many])]
        order = suffix_order(data, size[many])
        phrase = np.repeat(np.arange(len(many)), size[many])
        start = np.concatenate(([0], np.cumsum(size[many])[:-1]))
        inside = np.arange(len(data)) - start[phrase]
        order = order[inside[order] < windows[many][phrase[order]]]  # suffixes that hold a whole window
        h = Hasher(data).of(order, order + length)
        lead = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        doc = least[many][phrase[order]]
        winner = np.empty(len(data), np.int64)
        winner[order] = np.repeat(np.minimum.reduceat(doc, lead), np.diff(np.append(lead, len(order))))
        at = ranges(start, windows[many])
        w, p = winner[at], phrase[at]
        new = np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1]) | (p[1:] != p[:-1]))))
        found.append((many[p[new]], inside[at[new]], np.diff(np.append(new, len(at))), w[new]))
    return tuple(np.concatenate(x) for x in zip(*found))


def resolve(length: int):
    def run(table: pa.Table) -> pa.Table:
        got = [unpack(x.as_py()) for x in table.column("payload")]
        size, least, most, text = (np.concatenate([x[i] for x in got]) for i in range(4))
        size = size.astype(np.int64)
        begin = np.concatenate(([0], np.cumsum(size)[:-1]))
        h = Hasher(text)
        grams = size - GRAM + 1
        trigger = np.minimum.reduceat(gram_hashes(h, len(text))[ranges(begin, grams)], np.cumsum(grams) - grams)
        key = key_of(trigger, h.of(begin, begin + size))
        order, first = groups_of(key)
        kind = np.empty(len(key), np.int64)
        kind[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
        own, low = order[first], np.minimum.reduceat(least[order], first)
        phrase, start, windows, doc = first_documents(trigger[own], key[own], size[own], low, text[ranges(begin[own], size[own])], length)
        by = np.argsort(phrase, kind="stable")
        phrase, start, windows, doc = phrase[by], start[by], windows[by], doc[by]
        left, right = np.searchsorted(phrase, kind), np.searchsorted(phrase, kind, "right")
        out, at = [], 0
        for s, b, x in zip(table.column("shard").to_pylist(), table.column("block").to_pylist(), got):
            mine = np.arange(at, at + len(x[0]))
            at += len(x[0])
            run_at = ranges(left[mine], right[mine] - left[mine])
            whose = np.repeat(mine, right[mine] - left[mine])
            hit = doc[run_at] < most[whose]
            if hit.any():
                run_at, whose = run_at[hit], whose[hit]
                out.append((s, b, pack(key[whose], start[run_at].astype(np.uint32), windows[run_at].astype(np.uint32), doc[run_at])))
        return pa.Table.from_batches([rows(**{n: [x[i] for x in out] for i, n in enumerate(("shard", "block", "payload"))})])

    return run


OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def cut(length: int):
    def run(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return OUT.empty_table()
        p = Phrases(blocks.column("blob")[0].as_py(), length)
        gone = np.zeros(len(p.data) + 1, np.int32)
        if replies.num_rows:
            key, start, windows, doc = (np.concatenate(x) for x in zip(*(unpack(x.as_py()) for x in replies.column("payload"))))
            by = np.argsort(key, kind="stable")
            key, start, windows, doc = key[by], start[by].astype(np.int64), windows[by].astype(np.int64), doc[by]
            left, right = np.searchsorted(key, p.key), np.searchsorted(key, p.key, "right")
            mine = np.repeat(np.arange(len(p.key)), right - left)
            run_at = ranges(left, right - left)
            hit = doc[run_at] < p.ids[p.doc[mine]]
            mine, run_at = mine[hit], run_at[hit]
            begin = p.start[mine] + start[run_at]
            np.add.at(gone, begin, 1)
            np.add.at(gone, begin + windows[run_at] + length - 1, -1)
        covered = np.cumsum(gone[:-1]) > 0
        size = np.diff(p.offsets)
        edge = np.zeros(len(p.data) + 1, bool)
        edge[p.offsets] = True
        new = covered.copy()
        new[1:] &= ~covered[:-1] | edge[1:-1]
        end = covered.copy()
        end[:-1] &= ~covered[1:] | edge[1:-1]
        a, b = np.flatnonzero(new), np.flatnonzero(end) + 1
        whose = np.searchsorted(p.offsets, a, "right") - 1
        kept = np.concatenate(([0], np.cumsum(~covered)))[p.offsets]
        base = p.offsets[whose]
        spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(a, p.offsets), pa.int32()), pa.StructArray.from_arrays([pa.array(a - base), pa.array(b - base)], ["start", "end"]))
        left_over = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(kept.astype(np.int32).tobytes()), pa.py_buffer(p.data[~covered].tobytes())])
        return pa.Table.from_arrays([pa.array(p.ids), pa.array(size), spans, left_over], schema=OUT)

    return run


def suffix_dedup(docs: DataFrame, length: int = 50, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<start, end>> of removed bytes, kept binary) of every document; see the module."""
    spark = docs.sparkSession
    small_batches(spark)
    pick = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    blocks = checkpointed(pick.where("doc_id is not null").mapInArrow(pack_blocks, "block long, bytes long, blob binary"))
    total = int(blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0])
    shards = pieces(spark, total, BLOCK_BYTES)
    triggers = blocks.mapInArrow(send_triggers(shards, length), ROW).groupBy("shard").applyInArrow(shared_triggers, ROW)
    phrases = blocks.groupBy("block").cogroup(triggers.groupBy("block")).applyInArrow(send_phrases(shards, length), ROW)
    runs = phrases.groupBy("shard").applyInArrow(resolve(length), ROW)
    done = blocks.groupBy("block").cogroup(runs.groupBy("block")).applyInArrow(cut(length), "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
    nothing: Column = F.array().cast("array<struct<start: long, end: long>>")
    rest = pick.where("doc_id is null").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), nothing.alias("spans"), F.coalesce("text", F.lit("")).cast("binary").alias("kept"))
    return done.unionAll(rest)
