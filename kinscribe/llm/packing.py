"""Packing (operator 6): best-fit decreasing into windows of a fixed number of tokens.

Documents are tokenised (each ends with one end id) and overlong ones are first cut into full
windows. The rests are placed in falling order of length: a segment tree indexed by remaining
capacity finds the tightest open window. What stays open at the end of a shard is closed by
moving tokens of the emptiest windows into the gaps of fuller ones, so that a shard leaves at
most one window that isn't full; that one is cut into lengths of powers of two, which need no
padding.

Scale: a shard is SHARD_TOKENS tokens of one task's documents, so there is no shuffle, no
collection and a bounded memory; nothing depends on other shards. Sequence numbers are
partition * 2**40 + a counter.

Defined cases: null text is empty, and an empty text is its end id alone; documents that
repeat are packed each; an empty table gives no piece; only the two named columns are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .tokens import Encoder

CAPACITY, END_ID = 2048, 1
SHARD_TOKENS = 4 << 20
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
SCHEMA = pa.schema([(x.split()[0], pa.int64()) for x in DDL.split(", ")])


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree that knows which capacities occur."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = bytearray(2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        i = room + self.size
        while i and not self.tree[i]:
            self.tree[i] = 1
            i >>= 1

    def tightest(self, length: int) -> tuple[int, int] | None:
        """(room, window) of the least room of length or more; the window is taken out."""
        i = length + self.size
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        room = i - self.size
        window = self.windows[room].pop()
        if not self.windows[room]:
            while i and not (i < self.size and (self.tree[2 * i] or self.tree[2 * i + 1])):
                self.tree[i] = 0
                i >>= 1
        return room, window


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Windows of (document, start, length) for documents of the given lengths; see the module."""
    windows: list[list[tuple[int, int, int]]] = []
    rests = []
    for d, n in enumerate(lengths):
        for k in range(n // capacity):
            windows.append([(d, k * capacity, capacity)])
        if n % capacity:
            rests.append((n % capacity, d, n - n % capacity))
    rests.sort(key=lambda x: (-x[0], x[1]))
    open_windows, room = OpenWindows(capacity), {}
    for n, d, start in rests:
        found = open_windows.tightest(n)
        if found is None:
            windows.append([])
            found = capacity, len(windows) - 1
        left, w = found
        windows[w].append((d, start, n))
        room[w] = left - n
        if left > n:
            open_windows.add(left - n, w)
    # the emptiest open window fills the gaps of the fullest
    ragged = sorted((w for w, r in room.items() if r), key=lambda w: (room[w], w))
    low, high = 0, len(ragged) - 1
    while low < high:
        w, donor = ragged[low], ragged[high]
        while room[w] and windows[donor]:
            d, start, n = windows[donor].pop()
            take = min(n, room[w])
            windows[w].append((d, start, take))
            room[w] -= take
            if take < n:
                windows[donor].append((d, start + take, n - take))
        low += not room[w]
        high -= not windows[donor]
    if low == high and windows[ragged[low]]:
        w = ragged[low]
        parts, windows[w] = windows[w], []
        total = sum(n for _, _, n in parts)
        for bit in reversed(range(total.bit_length())):
            need, seq = total & (1 << bit), []
            while need:
                d, start, n = parts.pop()
                take = min(n, need)
                seq.append((d, start, take))
                need -= take
                if take < n:
                    parts.append((d, start + take, n - take))
            if seq:
                windows.append(seq)
    return [w for w in windows if w]


def packer(tokenizer: str, end_id: int, capacity: int, shard_tokens: int):
    def run(batches):
        from pyspark import TaskContext

        encode, sequence = Encoder(tokenizer), TaskContext.get().partitionId() << 40
        ids: list[int] = []
        tokens: list[np.ndarray] = []
        held = 0

        def flush():
            nonlocal ids, tokens, held, sequence
            out = []
            for window in best_fit([len(t) for t in tokens], capacity):
                offset = 0
                for d, start, n in window:
                    out.append((ids[d], start, n, zlib.crc32(tokens[d][start : start + n]), len(tokens[d]), sequence, offset))
                    offset += n
                sequence += 1
            ids, tokens, held = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], schema=SCHEMA)

        for batch in batches:
            for d, text in zip(batch.column(0), batch.column(1)):
                t = encode(text.as_py() or "", end_id)
                ids.append(d.as_py())
                tokens.append(t)
                held += len(t)
                if held >= shard_tokens:
                    yield flush()
        if tokens:
            yield flush()

    return run


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. tokenizer: path of a vocabulary file, there on every executor."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(packer(tokenizer, end_id, capacity, shard_tokens), DDL)
