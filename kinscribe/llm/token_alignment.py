"""Cross-tokenizer alignment (operator 12): which tokens of two vocabularies cover the same bytes, corpus-wide.

Every text is encoded once, in blocks of some megabytes. Byte ends where both sides end a token cut the text into
groups; each stretch between neighbouring ends of either side belongs to one token of each, which makes one link.
Texts whose tokens don't spell space+text byte by byte have no tokens here.

Pair counts live in dense matrices, striped by side-A id: stripe a % stripes has a row for each of its ids and a column
for each B id, and fits Bounds.cells cells whatever the corpus is. Striping by remainder spreads frequent ids, which have
low numbers. A task adds up document counts of the pairs of its blocks first, so that the shuffle to stripes grows with
tasks and distinct pairs and not with documents; np.add.at puts them into the stripe's block, and row maxima are the
best partners.

Scoring is co-partitioned with links: links of a block are packed by stripe and travel to their stripe's slot, counts
first, links after them, one after the other. A stripe has as many slots as its links need (Bounds.slot_bytes each), and every
slot gets the stripe's counts, which the vocabularies bound. Sums go back to their block, packed.

Scale: no group is held, only one block or one stripe at a time; nothing goes to the driver but two sums of bytes.
The encoded table is written to the session's shared folder once and read twice, and lineage ends there.

Defined cases: null and empty texts have zeros and empty groups; repeated rows count as documents each, and so do rows
with a null id; an empty table gives no row; other columns are never read.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_shard, checkpoint_folder, pack, small_batches, unpack
from .tokens import load

@dataclass(frozen=True)
class Bounds:
    """What a task holds at once; results don't depend on it."""

    #: Cells of a stripe's dense block.
    cells: int = 1 << 22
    #: Characters and documents of a block of texts.
    block_chars: int = 2 << 20
    block_docs: int = 4096
    #: Distinct pairs that an encoding task gathers before it hands their counts on.
    held_pairs: int = 2 << 20
    #: Packed links that one slot of a stripe takes, and packed counts that are added up at once.
    slot_bytes: int = 32 << 20


COUNTS, LINKS, DOCS = 0, 1, 2
ROW_DDL = "part int, block long, stripe int, payload binary"
ROW_SCHEMA = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("stripe", pa.int32()), ("payload", pa.binary())])
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

_sides: dict[tuple[str, str], "Sides"] = {}


def slim(x: np.ndarray) -> np.ndarray:
    """x, none of it negative, in the narrowest unsigned type up to 32 bits, else as 64-bit integers."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.int64)


class Sides:
    """Two vocabularies: byte-level (A) and pieces with byte fallback (B)."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a, plain, _ = load(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        n_a, n_b = plain.get_vocab_size(), self.b.get_piece_size()
        self.a_bytes = [b""] * n_a
        for token in self.a.token_byte_values():
            self.a_bytes[self.a.encode_single_token(token)] = token
        pieces = [self.b.id_to_piece(i) for i in range(n_b)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.n_a, self.n_b = n_a, n_b
        # what a token adds to the text of groups, by (side, id, whether its group ends there)
        self.written = [f"{i}{end}".encode() for i in range(n_a) for end in ",|"] + [f"{i}{end}".encode() for i in range(n_b) for end in ",;"]

    def stripes(self, cells: int) -> tuple[int, int]:
        """(rows of a stripe, stripes) for blocks of about so many cells."""
        rows = max(1, cells // self.n_b)
        return rows, -(-self.n_a // rows)

    def encode(self, texts: list[str | None]) -> list[tuple[list[int], list[int]]]:
        """Ids of both sides per text; none where their bytes differ from space+text."""
        out = []
        for text, b in zip(texts, self.b.encode([t or "" for t in texts], num_threads=1)):
            if text:
                a, data = self.a.encode_ordinary(" " + text), b" " + text.encode()
                if b"".join(map(self.a_bytes.__getitem__, a)) == data and b"".join(map(self.b_bytes.__getitem__, b)) == data:
                    out.append((a, b))
                    continue
            out.append(([], []))
        return out


def sides(a_path: str, b_path: str) -> Sides:
    if (a_path, b_path) not in _sides:
        _sides[a_path, b_path] = Sides(a_path, b_path)
    return _sides[a_path, b_path]


class Aligned:
    """The tokens of a block of texts, aligned. doc, a, b: of every link, in order of texts and bytes."""

    def __init__(self, s: Sides, texts: list[str | None], digest: bool):
        tokens = s.encode(texts)
        self.n_a, self.n_b = (np.array([len(t[k]) for t in tokens], np.int64) for k in (0, 1))
        a_ids, b_ids = (np.array([i for t in tokens for i in t[k]], np.int64) for k in (0, 1))
        a_end, b_end = np.cumsum(s.a_size[a_ids]), np.cumsum(s.b_size[b_ids])
        total = int(a_end[-1]) if len(a_end) else 0
        ends_a, ends_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        ends_a[a_end] = True
        ends_b[b_end] = True
        at = np.flatnonzero(ends_a | ends_b)
        both = ends_a & ends_b
        before_a, before_b, before = (np.cumsum(x, dtype=np.int64) - x for x in (ends_a, ends_b, both))
        self.a, self.b = a_ids[before_a[at]], b_ids[before_b[at]]
        a_last = np.cumsum(self.n_a)  # tokens up to each text's end
        text_end = np.concatenate(([0], a_end))[a_last]  # bytes
        upto = np.searchsorted(at, text_end, "right")
        self.n_links = np.diff(upto, prepend=0)
        self.n_groups = np.diff(np.searchsorted(np.flatnonzero(both), text_end, "right"), prepend=0)
        self.doc = np.repeat(np.arange(len(texts)), self.n_links)
        # groups as text: A tokens of a group stand before its B tokens
        group_a, group_b = before[a_end], before[b_end]
        n = int(self.n_groups.sum())
        a_upto, b_upto = (np.concatenate(([0], np.cumsum(np.bincount(g, minlength=n)))) for g in (group_a, group_b))
        order = np.zeros(len(a_ids) + len(b_ids), np.int64)
        order[np.arange(len(a_ids)) + b_upto[group_a]] = 2 * a_ids + both[a_end]
        order[np.arange(len(b_ids)) + a_upto[group_b + 1]] = 2 * s.n_a + 2 * b_ids + both[b_end]
        self.groups, lo = [], 0
        for hi in np.cumsum(self.n_a + self.n_b).tolist():
            text = b"".join(map(s.written.__getitem__, order[lo:hi].tolist()))[:-1]
            self.groups.append((hashlib.sha256(text).hexdigest() if hi > lo else "") if digest else text.decode())
            lo = hi


class PairCounts:
    """Documents of each pair key so far, in bounded memory."""

    def __init__(self, most: int):
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, self.most = 0, most

    def add(self, keys: np.ndarray, counts: np.ndarray) -> bool:
        """True where it is time to hand the counts on."""
        self.held.append((keys, counts))
        self.size += len(keys)
        if self.size >= 2 * self.most:
            self.held = [self.merged()]
            self.size = len(self.held[0][0])
        return self.size >= self.most and len(self.held) == 1

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(x) for x in zip(*self.held))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[first], np.add.reduceat(counts[order], first)

    def rows(self, cells: int):
        """(stripe, payload) of everything held, which is let go."""
        if self.held and self.size:
            keys, counts = self.merged()
            stripe = keys // cells
            for k, at in by_shard(stripe):
                yield k, pack(slim(keys[at] - k * cells), slim(counts[at]))
        self.held, self.size = [], 0


def distinct(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, how often each occurs)."""
    first = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))) if len(sorted_keys) else np.zeros(0, np.int64)
    return sorted_keys[first], np.diff(np.append(first, len(sorted_keys)))


def encoder(a_path: str, b_path: str, digest: bool, bounds: Bounds):
    def run(batches):
        from pyspark import TaskContext

        s, block = sides(a_path, b_path), TaskContext.get().partitionId() << 40
        n_rows, stripes = s.stripes(bounds.cells)
        cells, counts = n_rows * s.n_b, PairCounts(bounds.held_pairs)
        ids: list = []
        texts: list = []
        held = 0

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), ROW_SCHEMA.types)], schema=ROW_SCHEMA)

        def flush():
            nonlocal ids, texts, held, block
            x = Aligned(s, texts, digest)
            stripe, row = x.a % stripes, x.a // stripes
            n = len(texts)
            keys, times = distinct(np.sort(((stripe * n + x.doc) * n_rows + row) * s.n_b + x.b))
            cell, rest = keys % cells, keys // cells
            doc, stripe = rest % n, rest // n
            known = np.array([i is not None for i in ids], bool)
            rows = [(DOCS, block, -1, pack(np.array([i or 0 for i in ids], np.int64), known, x.n_a, x.n_b, x.n_groups, x.n_links, np.array([len(g) for g in x.groups], np.int64), np.frombuffer("".join(x.groups).encode(), np.uint8)))]
            for k, at in by_shard(stripe):
                rows.append((LINKS, block, k, pack(slim(doc[at]), slim(cell[at]), slim(times[at]))))
            full = counts.add(*distinct(np.sort(stripe * cells + cell)))
            block += 1
            ids, texts, held = [], [], 0
            yield batch_of(rows)
            if full:
                yield from hand_on()

        def hand_on():
            rows = [(COUNTS, None, k, payload) for k, payload in counts.rows(cells)]
            if rows:
                yield batch_of(rows)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                texts.append(text)
                held += len(text or "")
                if held >= bounds.block_chars or len(ids) == bounds.block_docs:
                    yield from flush()
        if ids:
            yield from flush()
        yield from hand_on()

    return run


def adder(cells: int):
    """Rows (stripe, payload), sorted, to one row per run of a stripe: its cells, counts and row maxima come from a dense block."""

    def run(batches):
        dense, at = np.zeros(cells, np.int64), None

        def close():
            found = np.flatnonzero(dense)
            payload = pack(slim(found), slim(dense[found]))
            dense[found] = 0
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([payload], pa.binary())], names=["stripe", "payload"])

        for batch in batches:
            for stripe, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                if at is not None and stripe != at:
                    yield close()
                at = stripe
                cell, count = unpack(payload.as_py())
                np.add.at(dense, cell, count)
        if at is not None:
            yield close()

    return run


PARTIAL_DDL = "block long, payload binary"


def scorer(rows: int, n_b: int):
    """Rows (stripe, part, block, payload) of slots, counts before links, to packed sums per block."""

    def run(batches):
        dense = np.zeros((rows, n_b), np.int64)
        flat, best = dense.reshape(-1), np.zeros(rows, np.int64)
        for batch in batches:
            blocks, out = [], []
            for part, block, payload in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if part == COUNTS:
                    flat[:] = 0
                    cell, count = unpack(payload.as_py())
                    flat[cell] = count
                    best = dense.max(axis=1)
                    continue
                doc, cell, times = (x.astype(np.int64) for x in unpack(payload.as_py()))
                count = flat[cell]
                first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
                sums = np.add.reduceat(times * count, first), np.add.reduceat(times * (count == best[cell // n_b]), first)
                blocks.append(block)
                out.append(pack(slim(doc[first]), *(slim(x) for x in sums)))
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(out, pa.binary())], names=["block", "payload"])

    return run


def closer():
    """Rows (block, part, payload) in order, documents before sums, to documents."""
    schema = pa.schema([*((c, pa.int64()) for c in COLUMNS), ("groups", pa.string())])

    def run(batches):
        held = None

        def close():
            ids, known, n_a, n_b, n_groups, n_links, sizes, text = held
            ends, data = np.cumsum(sizes), text.tobytes()
            groups = [data[e - n : e].decode() for e, n in zip(ends.tolist(), sizes.tolist())]
            columns = [pa.array(ids, pa.int64(), mask=~known), *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links, n_best, count_sum)), pa.array(groups)]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            for part, payload in zip(batch.column(1).to_pylist(), batch.column(2)):
                values = unpack(payload.as_py())
                if part == 0:
                    if held:
                        yield close()
                    held = values
                    n_best, count_sum = np.zeros(len(held[0]), np.int64), np.zeros(len(held[0]), np.int64)
                else:
                    doc, total, best = values
                    count_sum[doc] += total
                    n_best[doc] += best
        if held:
            yield close()

    return run


def align_tokens(docs: DataFrame, a_path: str, b_path: str, digest: bool = False, bounds: Bounds = Bounds(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    groups is `a1,a2|b1;a3|b2,b3` by ids, or its SHA-256 (lowercase hex; '' without tokens) where digest is set.
    a_path, b_path: vocabulary files, there on the driver and every executor."""
    spark = docs.sparkSession
    small_batches(spark)
    s = sides(a_path, b_path)
    n_rows, stripes = s.stripes(bounds.cells)
    cells, at = n_rows * s.n_b, f"{checkpoint_folder(spark)}/alignment-{uuid.uuid4().hex}"
    own = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    own.mapInArrow(encoder(a_path, b_path, digest, bounds), ROW_DDL).write.option("compression", "uncompressed").parquet(at)
    rows = spark.read.parquet(at)
    sizes = {r["part"]: r["size"] for r in rows.groupBy("part").agg(F.sum(F.octet_length("payload")).alias("size")).collect()}  # three rows at most
    slots, turns = (max(1, -(-sizes.get(part, 0) // (stripes * bounds.slot_bytes))) for part in (LINKS, COUNTS))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def added(found: DataFrame, key) -> DataFrame:
        return found.withColumn("slot", key).repartitionById(tasks, F.col("slot").cast("int")).sortWithinPartitions("slot").select("stripe", "payload").mapInArrow(adder(cells), "stripe int, payload binary")

    counts = rows.where(F.col("part") == COUNTS).select("stripe", "payload")
    if turns > 1:
        counts = added(counts, F.col("stripe") * turns + F.pmod(F.xxhash64("payload"), F.lit(turns)))
    counts = added(counts, F.col("stripe"))
    told = counts.select("stripe", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("turn"), F.lit(COUNTS).alias("part"), F.lit(None).cast("long").alias("block"), "payload")
    links = rows.where(F.col("part") == LINKS).select("stripe", F.pmod(F.xxhash64("block"), F.lit(slots)).cast("int").alias("turn"), "part", "block", "payload")
    slot = (F.col("stripe") * slots + F.col("turn")).alias("slot")
    met = told.unionByName(links).select(slot, "stripe", "part", "block", "payload").repartitionById(tasks, F.col("slot").cast("int")).sortWithinPartitions("slot", "part", "block")
    sums = met.select("stripe", "part", "block", "payload").mapInArrow(scorer(n_rows, s.n_b), PARTIAL_DDL).select("block", F.lit(1).alias("part"), "payload")
    bases = rows.where(F.col("part") == DOCS).select("block", F.lit(0).alias("part"), "payload")
    return bases.unionByName(sums).repartition("block").sortWithinPartitions("block", "part").mapInArrow(closer(), ", ".join(f"{c} long" for c in COLUMNS) + ", groups string")
