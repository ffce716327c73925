"""Links of an exact set-similarity join, given posting lists that hold every similar pair.

First each item is compared with one partner, its best among the least items of its posting
lists; links found so make components. Items with parity sketches are then compared, in
NEAREST_ROUNDS rounds, with the nearest item of another component. Then, list by list, only pairs across components are
compared: pairs inside one are connected already, so large groups of near copies never give
all their pairs. Every pair across components that passes the bounds is verified, so the
components are those of all links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_shard, checkpointed, connected_components, mix, pack, ranges, repeated, unpack

PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("hits", pa.int64()), ("need", pa.int64())])
PAIRS_DDL = "a long, b long, hits long, need long"
ROWS_AT_ONCE = 2_000_000
NEAREST_ROUNDS = 2


def possible(n1, n2, most1, most2, percent: int) -> np.ndarray:
    """Whether sizes and shared-token counts allow 100 * intersection >= percent * union."""
    need = percent * (n1 + n2)
    return (100 + percent) * np.minimum(most1, most2) >= need


def counted(a: list, b: list, need: list) -> pa.Table:
    """Pairs with the number of lists that hold them."""
    if not a:
        return PAIRS.empty_table()
    x, y, m = np.concatenate(a), np.concatenate(b), np.concatenate(need)
    order = np.lexsort((y, x))
    x, y, m = x[order], y[order], m[order]
    first = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))) if len(x) else np.zeros(0, np.int64)
    return pa.Table.from_arrays([pa.array(x[first]), pa.array(y[first]), pa.array(np.diff(np.append(first, len(x)))), pa.array(m[first])], schema=PAIRS)


def columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


def stars(percent: int):
    def run(table: pa.Table) -> pa.Table:
        token, i, n, most, need = columns(table, "token", "id", "n", "bound", "need")
        order = np.lexsort((i, token))
        token, i, n, most, need = (x[order] for x in (token, i, n, most, need))
        first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        lead = np.repeat(first, np.diff(np.append(first, len(token))))
        ok = (i != i[lead]) & possible(n, n[lead], most, most[lead], percent)
        return counted([i[ok]], [i[lead][ok]], [np.minimum(need, need[lead])[ok]])

    return run


def differences(sketch: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A lower bound of the symmetric difference of items x and y: bits in which their parity sketches differ."""
    out = np.zeros(len(x), np.int64)
    for k in range(sketch.shape[1]):
        out += np.bitwise_count(sketch[x, k] ^ sketch[y, k])
    return out


def across(percent: int, table: pa.Table):
    """(x, y, difference, columns), a bounded number of pairs at once: rows x and y of one list in different components whose sizes, counts and sketches allow the similarity.

    Where items have parity sketches, pairs whose sketches differ in more bits than the sets may
    differ in values are left out; that bound is exact, so no link is lost."""
    c = dict(zip(("id", "n", "bound", "need", "rest"), columns(table, "id", "n", "bound", "need", "rest")))
    token, part = columns(table, "token", "part")
    order = np.lexsort((c["id"], part, token))
    token, part, c = token[order], part[order], {k: v[order] for k, v in c.items()}
    i, n, most = c["id"], c["n"], c["bound"]
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(i), -1)[order] if "sketch" in table.column_names else None
    first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    stop = np.append(first[1:], len(token))
    mixed = part[first] != part[stop - 1]
    begin = np.concatenate(([True], (token[1:] != token[:-1]) | (part[1:] != part[:-1])))
    run_stop = np.append(np.flatnonzero(begin)[1:], len(token))[np.cumsum(begin) - 1]
    list_stop = np.repeat(stop, stop - first)
    rows = np.flatnonzero(np.repeat(mixed, stop - first) & (run_stop < list_stop))
    width = (list_stop - run_stop)[rows]
    held, at = np.cumsum(width), 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(held, (held[at - 1] if at else 0) + ROWS_AT_ONCE, "right")))
        x = np.repeat(rows[at:to], width[at:to])
        y = ranges(run_stop[rows[at:to]], width[at:to])
        ok = (i[x] != i[y]) & possible(n[x], n[y], most[x], most[y], percent)
        x, y = x[ok], y[ok]
        d = np.zeros(len(x), np.int64)
        if sketch is not None:
            d = differences(sketch, x, y)
            ok = (100 + percent) * d <= (100 - percent) * (n[x] + n[y])
            x, y, d = x[ok], y[ok], d[ok]
        yield x, y, d, c
        at = to


def nearest(percent: int):
    """Of each item of a shard's lists: (id, score, other), the partner in another component whose sketch differs least for its size."""

    def least(who, score, other):
        order = np.lexsort((other, score, who))
        who, score, other = who[order], score[order], other[order]
        keep = np.ones(len(who), bool)
        keep[1:] = who[1:] != who[:-1]
        return who[keep], score[keep], other[keep]

    def run(table: pa.Table) -> pa.Table:
        best = tuple(np.zeros(0, np.int64) for _ in range(3))
        for x, y, d, c in across(percent, table):
            i, score = c["id"], 10_000 * d // (c["n"][x] + c["n"][y])
            best = least(*(np.concatenate(z) for z in zip(best, (i[x], score, i[y]), (i[y], score, i[x]))))
        return pa.Table.from_arrays([pa.array(z, pa.int64()) for z in best], ["id", "score", "other"])

    return run


def crossing(percent: int, homes: int):
    """Pairs across components of the lists of a shard, with their number of lists, packed by the home of the lesser item.

    Prefixes come first in a common order, so two items share at most their common postings
    plus what follows the prefix that ends first; a pair needs as many postings as that leaves."""

    def run(table: pa.Table) -> pa.Table:
        a, b, m = [], [], []
        for x, y, _, c in across(percent, table):
            i, n, need, rest = c["id"], c["n"], c["need"], c["rest"]
            a.append(np.minimum(i[x], i[y]))
            b.append(np.maximum(i[x], i[y]))
            least = -(-percent * (n[x] + n[y]) // (100 + percent))
            m.append(np.maximum(np.minimum(need[x], need[y]), least - np.maximum(rest[x], rest[y])))
        x, y, hits, m = columns(counted(a, b, m), "a", "b", "hits", "need")
        out = [(h, pack(x[q], y[q], hits[q], m[q])) for h, q in by_shard(((mix(x.view(np.uint64))) % np.uint64(homes)).astype(np.int64))]
        return pa.Table.from_arrays([pa.array([h for h, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], ["shard", "payload"])

    return run


def enough(table: pa.Table) -> pa.Table:
    """Of one home: the pairs that meet in as many lists as they need."""
    x, y, hits, need = (np.concatenate(c) for c in zip(*(unpack(p.as_py()) for p in table.column("payload"))))
    order = np.lexsort((y, x))
    x, y, hits, need = x[order], y[order], hits[order], need[order]
    first = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
    keep = first[np.add.reduceat(hits, first) >= need[first]]
    return pa.Table.from_arrays([pa.array(x[keep]), pa.array(y[keep])], ["a", "b"])


def packed_set(blob: bytes) -> np.ndarray:
    return unpack(blob)[0]


def verifier(percent: int, decode):
    def run(batches):
        sets: dict[int, np.ndarray] = {}
        for batch in batches:
            keep = []
            for a, b, n1, n2, t1, t2 in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "n1", "n2", "t1", "t2"))):
                if len(sets) > 2000:
                    sets.clear()
                for i, t in ((a, t1), (b, t2)):
                    if i not in sets:
                        sets[i] = decode(t)
                x, y = sets[a], sets[b]
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
                keep.append(100 * both >= percent * (n1 + n2 - both) and both > 0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def send_sets(shards: int, decode):
    """(shard, payload): the values of items, by shard, with their items."""

    def run(batches):
        for batch in batches:
            sets = [decode(t) for t in batch.column("tokens").to_pylist()]
            ids, size = batch.column("id").to_numpy(), np.array([len(x) for x in sets])
            value, row = np.concatenate(sets).view(np.uint64), np.repeat(np.arange(len(ids)), size)
            out = [(s, pack(ids[np.unique(row[x])], np.unique(row[x], return_counts=True)[1].astype(np.uint32), value[x] >> np.uint64(16))) for s, x in by_shard((value % np.uint64(shards)).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], ["shard", "payload"])

    return run


def shared_counts(table: pa.Table) -> pa.Table:
    """Of one shard: how many values of each item another item has too."""
    ids, n, value = (np.concatenate(x) for x in zip(*(unpack(x.as_py()) for x in table.column("payload"))))
    hit = repeated(value)
    who, m = np.unique(np.repeat(ids, n)[hit], return_counts=True)
    return pa.Table.from_arrays([pa.array(who, pa.int64()), pa.array(m, pa.int64())], ["id", "shared"])


def verified(pairs: DataFrame, items: DataFrame, verify) -> DataFrame:
    one = items.select(F.col("id").alias("a"), F.col("n").alias("n1"), F.col("tokens").alias("t1"))
    two = items.select(F.col("id").alias("b"), F.col("n").alias("n2"), F.col("tokens").alias("t2"))
    return checkpointed(pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "n1", "n2", "t1", "t2").mapInArrow(verify, "a long, b long"))


def across_components(lists: DataFrame, links: DataFrame) -> DataFrame:
    """lists with each item's component (part), without lists that lie in one component."""
    parts = connected_components(links).withColumnsRenamed({"node": "id", "component": "part"})
    labelled = checkpointed(lists.join(parts, "id", "left").withColumn("part", F.coalesce("part", "id")))
    mixed = labelled.groupBy("token").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x != y").select("token")
    return labelled.join(mixed, "token", "left_semi").select(labelled.columns)


def similar_links(items: DataFrame, postings: DataFrame, percent: int, shards: int, decode=packed_set, refine: bool = False, verify=None) -> DataFrame:
    """Edges (a, b) between items, of which the components are those of all pairs with 100 * intersection >= percent * union.

    items: id, n (set size), bound (tokens that any other item may share), need (shared postings
    that a similar pair has at least; a pair has the lesser of both), rest (tokens after the
    item's own postings in the common order; n where there is no order), tokens (what decode makes a
    set of distinct values from), sketch if there is one (parity bits of the set, a multiple of
    8 bytes); verify: what keeps the pairs (a, b, n1, n2, t1, t2) that are similar, by mapInArrow;
    refine: bounds are counted here, for items that still have a
    list across components. postings:
    token, id; every similar pair meets in at least `need` lists."""
    verify = verify or verifier(percent, decode)
    lists = checkpointed(postings.join(items.select("id", "n", "bound", "need", "rest"), "id").withColumn("shard", F.pmod(F.xxhash64("token"), F.lit(shards))))
    near = lists.groupBy("shard").applyInArrow(stars(percent), PAIRS_DDL)
    best = near.groupBy("a", "b").agg(F.sum("hits").alias("hits")).groupBy("a").agg(F.max(F.struct("hits", F.negative("b").alias("b"))).alias("x")).select("a", F.negative("x.b").alias("b"))
    links = verified(best, items, verify)
    for left in range(NEAREST_ROUNDS if "sketch" in items.columns else 0, -1, -1):
        labelled = across_components(lists, links)
        if left:
            sketched = checkpointed(labelled.join(items.select("id", "sketch"), "id"))
            found = sketched.groupBy("shard").applyInArrow(nearest(percent), "id long, score long, other long")
            best = found.groupBy("id").agg(F.min(F.struct("score", "other")).alias("x")).select(F.least("id", "x.other").alias("a"), F.greatest("id", "x.other").alias("b")).distinct()
            links = links.unionAll(verified(best, items, verify))
    if refine:
        labelled = checkpointed(labelled)
        left = items.join(labelled.select("id").distinct(), "id", "left_semi").select("id", "tokens")
        bounds = left.mapInArrow(send_sets(shards, decode), "shard long, payload binary").groupBy("shard").applyInArrow(shared_counts, "id long, shared long").groupBy("id").agg(F.sum("shared").alias("shared"))
        labelled = labelled.join(bounds, "id").withColumn("bound", F.col("shared")).drop("shared")
    if "sketch" in items.columns:
        labelled = labelled.join(items.select("id", "sketch"), "id")
    rest = labelled.groupBy("shard").applyInArrow(crossing(percent, shards), "shard long, payload binary").groupBy("shard").applyInArrow(enough, "a long, b long")
    return links.unionAll(verified(rest, items, verify))
