"""Benchmark decontamination (operator 5): a generalised suffix automaton of the test items.

Items are normalised to words; the automaton holds all of them over word numbers. Training
words are streamed through it and the longest match that ends at each word is tracked. A
window is `window` consecutive words of an item (a shorter item is one window); words inside
any occurrence of a window are hit. Only stretches of words whose neighbouring pairs occur in
some item reach the automaton; numpy finds them by hash, the automaton decides exactly.

Scale: no shuffle. Items stream to the driver and fill one automaton of MAX_BENCHMARK_BYTES at a
time, the only broadcast at that time. A larger benchmark takes several passes: each pass scans the
documents with one automaton and writes their hits beside them, the last one unites all. So neither
driver nor executors hold more than one automaton, whatever the benchmark's size; an item above the
bound makes one of its own.

Defined cases: null, empty or wordless text has no words and no hits; null, empty or wordless
items have no window and hit nothing; items that repeat are separate items and all are named;
an item with a null item_id can hit but is not named; an empty benchmark hits nothing; an empty
table gives an empty one. Other columns of either table, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, PLAIN_WORDS, Hasher, checkpointed, small_batches, steps, text_buffers, word_spans

WINDOW = 10
#: UTF-8 bytes of the items of one automaton: a million words at the very most, and two states a word.
MAX_BENCHMARK_BYTES = 2 << 20
#: Limits of the filter: a span longer than this many words goes, and every occurrence of a whole item shorter than a window; so does a document that is hit in more than this share of its words.
MAX_SPAN_WORDS, MAX_COVERAGE = 9, 0.5
U64 = np.uint64
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_LOWER))


class Automaton:
    """Generalised suffix automaton over word numbers, with the windows that end in each state."""

    def __init__(self, items: list[tuple[str | None, list[str]]], window: int):
        self.window = window
        vocabulary: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ids, ends, whole, pairs = [], [], [], set()
        for name, words in items:
            if not words:
                continue
            numbers = [vocabulary.setdefault(w, len(vocabulary)) for w in words]
            pairs.update(zip(numbers, numbers[1:]))
            last, path = 0, []
            for x in numbers:
                last = self._extend(last, x)
                path.append(last)
            ids.append(name)
            ends.append(path[window - 1 :])
            whole.append(numbers if len(numbers) < window else None)
        states = len(self.next)
        self.items = ids
        #: the state whose strings of exactly `window` words end there, for states of longer matches
        self.at_window = [-1] * states
        order = sorted(range(1, states), key=self.length.__getitem__)
        for s in order:
            up = self.link[s]
            self.at_window[s] = s if self.length[s] >= window > self.length[up] else self.at_window[up] if self.length[s] >= window else -1
        self.named: dict[int, set[int]] = {}
        for i, path in enumerate(ends):
            for s in path:
                self.named.setdefault(self.at_window[s], set()).add(i)
        short: dict[int, list[tuple[int, int]]] = {}
        for i, numbers in enumerate(whole):
            if numbers is not None:
                s = 0
                for x in numbers:
                    s = self.next[s][x]
                short.setdefault(s, []).append((len(numbers), i))
        #: short items that end with each state's strings, own ones and those of shorter suffixes
        self.short: list[tuple[tuple[int, int], ...]] = [()] * states
        for s in order:
            up = self.link[s]
            self.short[s] = (self.short[up] if up > 0 else ()) + tuple(short.get(s, ()))
        self.shortest = min([window, *(len(x) for x in whole if x)])
        data = "\n".join(vocabulary).encode()
        raw, off = np.frombuffer(data, np.uint8), np.array([0, len(data)])
        a, b, _ = word_spans(raw, off, PLAIN_WORDS)
        h = Hasher(raw).of(a, b)
        by = np.argsort(h)
        self.word_hash, self.word_number = h[by], by.astype(np.int64)
        self.pairs = np.sort(np.array([(a << 32) | b for a, b in pairs], np.int64))
        self.single = np.zeros(len(vocabulary), bool)
        for numbers in whole:
            if numbers is not None and len(numbers) == 1:
                self.single[numbers[0]] = True

    def _new(self, length: int, link: int, arrows: dict[int, int]) -> int:
        self.next.append(arrows)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, x: int) -> int:
        q = self.next[p][x]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, x: int) -> int:
        if x in self.next[last]:
            return self._split(last, x)
        new, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, x)
        return new

    def stream(self, numbers: list[int]):
        """(place, words, items) of every window that ends at each word of a stretch of known words."""
        state = length = 0
        for at, x in enumerate(numbers):
            while state and x not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            state = self.next[state].get(x, 0)
            length = length + 1 if state else 0
            if length >= self.window:
                yield at, self.window, self.named[self.at_window[state]]
            if self.short[state]:
                for size, item in self.short[state]:
                    if size <= length:
                        yield at, size, (item,)

    def scan(self, data: np.ndarray, offsets: np.ndarray):
        """(starts, ends, words by document, hit flag of each word, flag of words in a whole short item, {document: items}) of lower-cased bytes."""
        starts, ends, words = word_spans(data, offsets, PLAIN_WORDS)
        hit, whole, found = np.zeros(len(starts), bool), np.zeros(len(starts), bool), {}
        if not len(starts) or not len(self.word_hash):
            return starts, ends, words, hit, whole, found
        h = Hasher(data).of(starts, ends)
        at = np.minimum(np.searchsorted(self.word_hash, h), len(self.word_hash) - 1)
        known = self.word_hash[at] == h
        number = np.where(known, self.word_number[at], -1)
        doc = np.repeat(np.arange(len(words)), words)
        joined = np.zeros(len(starts), bool)  # to the word before, as in some item
        both = np.flatnonzero(known[1:] & known[:-1] & (doc[1:] == doc[:-1]))
        if len(both) and len(self.pairs):
            pair = (number[both] << 32) | number[both + 1]
            q = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined[both[self.pairs[q] == pair] + 1] = True
        begin = np.flatnonzero(known & ~joined)
        after = np.append(np.flatnonzero(~joined), len(starts))
        stop = after[np.searchsorted(after, begin, "right")]
        enough = stop - begin >= self.shortest
        for a, b in zip(begin[enough].tolist(), stop[enough].tolist()):
            for place, size, items in self.stream(number[a:b].tolist()):
                hit[a + place + 1 - size : a + place + 1] = True
                if size < self.window:
                    whole[a + place + 1 - size : a + place + 1] = True
                found.setdefault(int(doc[a]), set()).update(items)
        return starts, ends, words, hit, whole, found


def each_automaton(benchmark: DataFrame, window: int, most_bytes: int = MAX_BENCHMARK_BYTES) -> Iterator[Automaton]:
    """Automata over most_bytes of items each, one after the other; an empty one of an empty benchmark."""
    table = benchmark.select(F.col(benchmark.columns[0]).cast("string"), F.col(benchmark.columns[1]).cast("string"))
    parts, held, none = [], 0, True
    for name, text in table.toLocalIterator(prefetchPartitions=False):
        size = len((text or "").encode())
        if parts and held + size > most_bytes:
            yield Automaton(parts, window)
            parts, held, none = [], 0, False
        parts.append((name, words_of(text)))
        held += size
    if parts or none:
        yield Automaton(parts, window)


def automata(benchmark: DataFrame, window: int, most_bytes: int = MAX_BENCHMARK_BYTES) -> list[Automaton]:
    """All of each_automaton at once, for benchmarks that are known to be small."""
    return list(each_automaton(benchmark, window, most_bytes))


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64())])))])
DDL = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long, words: long>>"


MARKS = T.StructType([T.StructField("hit", T.BinaryType()), T.StructField("whole", T.BinaryType()), T.StructField("items", T.ArrayType(T.StringType()))])
MARK_TYPES = [pa.binary(), pa.binary(), pa.list_(pa.string())]


def packed(flags: np.ndarray, words: np.ndarray) -> list[bytes | None]:
    """The flags of each document's words as bits; None where there is none."""
    at = np.concatenate(([0], np.cumsum(words))).tolist()
    return [np.packbits(flags[a:b]).tobytes() if flags[a:b].any() else None for a, b in zip(at, at[1:])]


def unpacked(bits: list[bytes | None], words: np.ndarray) -> np.ndarray:
    out = np.zeros(int(words.sum()), bool)
    at = np.cumsum(words) - words
    for a, n, x in zip(at.tolist(), words.tolist(), bits):
        if x is not None:
            out[a : a + n] = np.unpackbits(np.frombuffer(x, np.uint8), count=n)
    return out


def united(machine: Automaton, data: np.ndarray, offsets: np.ndarray, before: list[list]):
    """What the automaton finds, with the marks of earlier passes over these documents, if there are any."""
    starts, ends, words, hit, whole, found = machine.scan(data, offsets)
    named = {d: [machine.items[i] for i in items if machine.items[i] is not None] for d, items in found.items()}
    if before:
        hit, whole = hit | unpacked(before[0], words), whole | unpacked(before[1], words)
        for d, names in enumerate(before[2]):
            if names:
                named[d] = [*names, *named.get(d, ())]
    return starts, ends, words, hit, whole, named


def marks_of(batch: pa.RecordBatch, width: int, i: int, j: int) -> list[list]:
    return [c.slice(i, j - i).to_pylist() for c in batch.columns[width:]]


def marker(machine, width: int, at: int):
    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(at))
            marks = [[], [], []]
            for i, j, d, o in steps(data, offsets):
                _, _, words, hit, whole, named = united(machine.value, LOWER[d], o, marks_of(batch, width, i, j))
                for held, new in zip(marks, (packed(hit, words), packed(whole, words), [named.get(k) for k in range(j - i)])):
                    held += new
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *(pa.array(m, t) for m, t in zip(marks, MARK_TYPES))], names=[*batch.schema.names[:width], *MARKS.names])

    return run


def passes(docs: DataFrame, benchmark: DataFrame, window: int, at: int, most_bytes: int):
    """(docs by column numbers, with the marks of all automata but the last, if there are more; the last automaton's broadcast)."""
    spark, width = docs.sparkSession, len(docs.columns)
    small_batches(spark)
    docs = docs.toDF(*(f"c{i}" for i in range(width)))
    schema, shared = T.StructType([*docs.schema.fields, *MARKS.fields]), None
    for machine in each_automaton(benchmark, window, most_bytes):
        if shared is not None:
            docs = checkpointed(docs.mapInArrow(marker(shared, width, at), schema))
            shared.unpersist()
        shared = spark.sparkContext.broadcast(machine)
    return docs, shared


def scanner(machine):
    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j, d, o in steps(data, offsets):
                starts, ends, words, hit, _, named = united(machine.value, LOWER[d], o, marks_of(batch, 2, i, j))
                doc = np.repeat(np.arange(j - i), words)
                apart = np.concatenate(([True], doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, bool)
                new = np.flatnonzero(hit & (apart | ~np.concatenate(([False], hit[:-1]))))
                stop = np.flatnonzero(hit & np.concatenate((apart[1:] | ~hit[1:], [True])[: 2 if len(hit) else 0])) if len(hit) else new
                spans = [[] for _ in range(j - i)]
                for a, b in zip(new.tolist(), stop.tolist()):
                    k = int(doc[a])
                    spans[k].append({"start": int(starts[a] - o[k]), "end": int(ends[b] - o[k]), "words": b - a + 1})
                counts = np.bincount(doc[hit], minlength=j - i)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(words), pa.array(counts), pa.array([sorted(named.get(k, ())) for k in range(j - i)], pa.list_(pa.string())), pa.array(spans, SCHEMA.field("spans").type)], schema=SCHEMA)

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text", most_bytes: int = MAX_BENCHMARK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) of every document; spans are byte ranges of runs of hit words. benchmark: its first two selected columns are item and text."""
    own = docs.select(F.col(id_column).cast("long"), F.col(text_column).cast("string"))
    own, machine = passes(own, benchmark, window, 1, most_bytes)
    return own.mapInArrow(scanner(machine), DDL)


def cleaner(machine, max_span_words: int, max_coverage: float, width: int, at: int):
    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(at))
            texts, keep = [], []
            for i, j, d, o in steps(data, offsets):
                starts, ends, words, hit, whole, _ = united(machine.value, LOWER[d], o, marks_of(batch, width, i, j))
                word_at = np.concatenate(([0], np.cumsum(words)))
                flagged = np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(hit)))[word_at]))
                cut = {}
                for k in flagged.tolist():
                    a, b = word_at[k], word_at[k + 1]
                    own = np.concatenate(([False], hit[a:b], [False]))
                    new, stop = np.flatnonzero(own[1:] & ~own[:-1]) + a, np.flatnonzero(own[:-1] & ~own[1:]) - 1 + a
                    if own.sum() > max_coverage * (b - a):
                        cut[k] = None
                        continue
                    gone = np.concatenate(([False], whole[a:b], [False]))
                    for x, y in zip(new.tolist(), stop.tolist()):
                        if y - x + 1 > max_span_words:
                            gone[x - a + 1 : y - a + 2] = True
                    new, stop = np.flatnonzero(gone[1:] & ~gone[:-1]) + a, np.flatnonzero(gone[:-1] & ~gone[1:]) - 1 + a
                    raw, out, last = d[o[k] : o[k + 1]].tobytes(), [], 0
                    for x, y in zip(new.tolist(), stop.tolist()):
                        out.append(raw[last : starts[x] - o[k]])
                        last = int(ends[y] - o[k])
                    cut[k] = b"".join([*out, raw[last:]]).decode()
                texts += [cut.get(k, False) for k in range(j - i)]
            keep = [t is not None for t in texts]
            old = batch.column(at)
            new = [None if t is None else old[k].as_py() if t is False else t for k, t in enumerate(texts)]
            columns = list(batch.columns[:width])
            columns[at] = pa.array(new, old.type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:width]).filter(pa.array(keep, pa.bool_()))

    return run


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_span_words: int = MAX_SPAN_WORDS, max_coverage: float = MAX_COVERAGE, text_column: str = "text", most_bytes: int = MAX_BENCHMARK_BYTES) -> DataFrame:
    """docs with its own columns: hit spans of more than max_span_words words, and whole items shorter than a window, are cut out of the text, and a document hit in more than max_coverage of its words goes. Documents without a hit stay as they are."""
    width, at = len(docs.columns), docs.columns.index(text_column)
    marked, machine = passes(docs, benchmark, window, at, most_bytes)
    plain = T.StructType(marked.schema.fields[:width])
    return marked.mapInArrow(cleaner(machine, max_span_words, max_coverage, width, at), plain).toDF(*docs.columns)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
