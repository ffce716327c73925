"""Penalised change points (operator 11): every key's daily sums are cut where their level or spread changes.

Rows are summed per key and day before any key's days come together, so a key's group holds its days and
never its rows. An ordered Python UDTF per key then consumes the days one after the other: it fills gaps with
zeros, keeps for every live start the exact integers n, S, Q and D = n*Q - S*S of the days since then (one
addition each per day, in the manner of Welford's update but without division), settles the best cut of the
days so far, and emits the segments at the end by walking back.

A start is live when the days before it can be cut themselves, and opens a segment once it has `least` days.
No start is given up early: the usual pruning needs costs that only grow when segments are joined, and the
floors in this cost break that.

Cost of n days with sum S and sum of squares Q: n * floor(1000 * ln(1 + floor(D / n**2))), plus `penalty` a cut.
Ties: fewest segments, then earliest starts from the last segment backwards.

Scale: memory is linear in a key's days and time quadratic in them (150 days here); nothing depends on its rows.
Sums stay in 64-bit integers while they provably fit and go on as Python's integers beyond.

Defined cases: rows with a null day or value are left out; a null key is a key of its own; repeated rows count each;
a key with fewer than `least` days is one segment; an empty table gives no row; other columns are never read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PENALTY, LEAST = 10_000, 5
DDL = "key long, segment_no int, first_day long, n_days long, total long, spread long, cost long, n_segments long, best_cost long"
NAMES = [x.split()[0] for x in DDL.split(", ")]
#: floor(1000 * ln(V)) of the small spreads, by V - 1, with the same double logarithm as beyond.
SMALL = np.array([math.floor(1000 * math.log(v)) for v in range(1, 1 << 16)], np.int64)


#: A total of costs and a number of segments share one integer: the total is shifted by so many bits.
COUNT_BITS = 22
#: Days after which the range of the sums is looked at again.
LOOK = 64


def levels(spread: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(V)) of each spread V less one."""
    if spread.dtype != object:
        try:
            return SMALL.take(spread)
        except IndexError:
            pass
    return np.array([math.floor(1000 * math.log(v + 1)) for v in spread.tolist()], np.int64)


class Cutter:
    """The best cut of a series that grows at its end; see the module.

    Sums are doubles while every one is an integer below 2**53, where division is exact to the floor, then 64-bit
    integers below 2**62, then Python's."""

    def __init__(self, penalty: int = PENALTY, least: int = LEAST):
        self.penalty, self.least = penalty, least
        self.days, self.largest, self.live = 0, 0, 0
        self.start = np.zeros(192, np.int64)
        self.base = np.zeros(192, np.int64)  # best cost before the start with the penalty of the cut there, and segments before it
        self.s2, self.q, self.d = (np.zeros(192) for _ in range(3))  # 2*S, Q and D since the start
        self.sums, self.squares = [0], [0]
        self.best: list[tuple[int, int] | None] = [(0, 0)]  # of each length: cost and segments, last start

    def open(self) -> None:
        """The day to come may start a segment."""
        k = self.live
        if k == len(self.start):
            for name in ("start", "base", "s2", "q", "d"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate((old, np.zeros(len(old), old.dtype))))
        self.start[k], self.base[k] = self.days, self.best[self.days][0] + ((self.penalty << COUNT_BITS) if self.days else 0) + 1
        self.live += 1

    def fit(self, x: int) -> None:
        """Widens the sums where the next days, none larger than x or those so far, could leave their range."""
        self.largest = max(self.largest, abs(x))
        bound = 4 * ((self.days + 2 + LOOK) * self.largest) ** 2
        kind = np.dtype(np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object)
        if kind != self.d.dtype:
            self.s2, self.q, self.d = (np.array([int(v) for v in a], kind) for a in (self.s2, self.q, self.d))

    def add(self, x: int) -> None:
        if self.best[self.days] is not None:
            self.open()
        if abs(x) > self.largest or self.days % LOOK == 0:
            self.fit(x)
        k, kind = self.live, self.d.dtype
        n, q, d = self.days - self.start[:k], self.q[:k], self.d[:k]
        d += q
        if x:
            s2 = self.s2[:k]
            step = n.astype(kind)
            step *= x
            step -= s2
            step *= x
            d += step
            s2 += 2 * x
            q += x * x
        self.days += 1
        self.sums.append(self.sums[-1] + x)
        self.squares.append(self.squares[-1] + x * x)
        if self.days < self.least:
            self.best.append(None)
            return
        k = 1 + max(0, self.days - 2 * self.least + 1)  # starts are 0 and all from least on
        n = n[:k] + 1
        spread = (d[:k] / (n * n).astype(kind)).astype(np.int64) if kind == np.float64 else d[:k] // (n.astype(kind) ** 2)
        total = levels(spread)
        total *= n
        total <<= COUNT_BITS
        total += self.base[:k]
        j = total.argmin()
        self.best.append((int(total[j]), int(self.start[j])))

    def segments(self) -> list[tuple[int, int, int, int, int]]:
        """(first day from 0, days, sum, spread, cost) in order."""
        out, end = [], self.days
        while end:
            first = self.best[end][1] if self.best[end] else 0
            n, s, q = end - first, self.sums[end] - self.sums[first], self.squares[end] - self.squares[first]
            spread = 1 + (n * q - s * s) // (n * n)
            out.append((first, n, s, spread, n * math.floor(1000 * math.log(spread))))
            end = first
        return out[::-1]


def make_udtf(penalty: int, least: int):
    class DaysInOrder:
        """Arrow batches of one key's (key, day, value) in order of days."""

        def __init__(self):
            self.cutter, self.key, self.first, self.next = Cutter(penalty, least), None, None, None

        def eval(self, batch):
            key, day, value = (batch.column(i) for i in range(3))
            self.key = key[0].as_py() if len(key) else self.key
            for at, x in zip(day.to_pylist(), value.to_pylist()):
                if self.first is None:
                    self.first = self.next = at
                while self.next < at:
                    self.cutter.add(0)
                    self.next += 1
                self.cutter.add(x)
                self.next += 1
            return iter(())

        def terminate(self):
            found = self.cutter.segments()
            if found:
                penalties = penalty * (len(found) - 1)
                best = sum(x[4] for x in found) + penalties
                rows = [(self.key, i + 1, self.first + first, n, s, v, c, len(found), best) for i, (first, n, s, v, c) in enumerate(found)]
                kinds = [pa.int32() if name == "segment_no" else pa.int64() for name in NAMES]
                yield pa.table([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=NAMES)

    return F.arrow_udtf(DaysInOrder, returnType=DDL)


def change_points(rows: DataFrame, key: str, day: str, value: str, penalty: int = PENALTY, least: int = LEAST) -> DataFrame:
    """One row per segment: key, segment_no, first_day (days since 1970), n_days, total, spread, cost, n_segments, best_cost.

    day is a date or timestamp column, value an integer one."""
    days = (
        rows.where(F.col(day).isNotNull() & F.col(value).isNotNull())
        .groupBy(F.col(key).cast("long").alias("key"), F.unix_date(F.to_date(day)).cast("long").alias("day"))
        .agg(F.sum(F.col(value).cast("long")).alias("value"))
    )
    return make_udtf(penalty, least)(days.asTable().partitionBy("key").orderBy("day"))
