"""Quality rules by repetition coverage (operator 2).

Rolling hashes of several n-gram lengths, in numpy, mark the words inside n-grams that a text
holds twice or more, and lines that equal an earlier one; the characters that they cover are
measured against all characters in words. Every text is judged by itself, whole: no shuffle.
A window of n + 1 words can repeat only where two windows of n words do, so longer lengths
sort only what shorter ones left.

Defined cases: a null or empty text has no words and fails the base rule (under MIN_WORDS);
rows that repeat are judged one by one; an empty table gives an empty one; only the two named
columns are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_WORDS, Hasher, groups_of, mix, powers, repeated, small_batches, steps, text_buffers, word_spans

U64 = np.uint64
#: The largest share of characters that may lie in repeated n-grams of each length, and in repeated lines.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_CHAR_LIMIT, LINE_LIMIT = 0.20, 0.30
MIN_WORDS, REPEAT_PERCENT = 10, 20
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
STEP = U64(0xD6E8FEB86659FD93)

SCHEMA = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", "n_lines")], *[(f"dup_{n}gram_chars", pa.int64()) for n in NGRAM_LIMITS]])


def per_document(offsets: np.ndarray, flags: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[offsets])


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of each document of one buffer."""
    docs = len(offsets) - 1
    starts, ends, words = word_spans(data, offsets, SPACE_WORDS)
    doc = np.repeat(np.arange(docs), words)
    hasher = Hasher(data)
    h = hasher.of(starts, ends)
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    size = chars[ends] - chars[starts]
    word_at = np.concatenate(([0], np.cumsum(words)))
    total = np.concatenate(([0], np.cumsum(size)))
    out = {"n_words": words, "word_chars": np.diff(total[word_at]), "n_symbols": per_document(offsets, SYMBOLS[data])}

    breaks = np.flatnonzero(data == 10)
    lines = np.diff(np.searchsorted(breaks, offsets)) + 1
    line_start, line_end = np.sort(np.concatenate((offsets[:-1], breaks + 1))), np.sort(np.concatenate((offsets[1:], breaks)))
    line_doc = np.repeat(np.arange(docs), lines)
    has = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_doc = line_start[has], line_end[has], line_doc[has]
    order, first = groups_of(hasher.of(line_start, line_end) ^ mix(line_doc.astype(np.uint64) + U64(1)))
    again = np.ones(len(order), bool)
    again[order[first]] = False
    out["n_lines"] = np.bincount(line_doc, minlength=docs)
    out["n_dup_lines"] = np.bincount(line_doc[again], minlength=docs)
    out["dup_line_chars"] = np.bincount(line_doc[again], (chars[line_end] - chars[line_start])[again], docs).astype(np.int64)

    # sums of word hashes times powers: the hash of any run of words, as for bytes
    run = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(int(STEP), len(h)), out=run[1:])
    back = powers(pow(int(STEP), -1, 1 << 64), len(h) + 1)
    salt = mix(doc.astype(np.uint64) + U64(7))
    live = None
    for n in NGRAM_LIMITS:
        if live is None:
            at = np.flatnonzero(doc[: max(0, len(doc) - n + 1)] == doc[n - 1 :]) if len(doc) >= n else np.zeros(0, np.int64)
        else:
            two = live[:-1][np.diff(live) == 1] if len(live) else live
            at = two[two + n <= len(doc)]
            at = at[doc[at] == doc[at + n - 1]]
        key = mix((run[at + n] - run[at]) * back[at]) ^ salt[at]
        live = at[repeated(key)]
        cover = np.zeros(len(doc) + 1, np.int32)
        np.add.at(cover, live, 1)
        np.add.at(cover, live + n, -1)
        inside = np.cumsum(cover[:-1]) > 0
        if n == min(NGRAM_LIMITS):
            out["n_repeat_words"] = per_document(word_at, inside)
        out[f"dup_{n}gram_chars"] = np.bincount(doc[inside], size[inside], docs).astype(np.int64)
    return out


def measure_batches(batches):
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        for i, j, d, o in steps(data, offsets):
            found = measure(d, o)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *[pa.array(found[c.name].astype(np.int64)) for c in list(SCHEMA)[1:]]], schema=SCHEMA)


def repetition_quality(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Measures of every document with base_failed and kept.

    base_failed: under MIN_WORDS words, or more than REPEAT_PERCENT of them in repeated 5-word
    windows. kept: the base holds, and neither repeated n-grams nor repeated lines cover more
    than their limits."""
    small_batches(docs.sparkSession)
    ddl = ", ".join(f"{f.name} long" for f in SCHEMA)
    m = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(measure_batches, ddl)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    fine = (F.col("dup_line_chars") <= LINE_CHAR_LIMIT * F.col("word_chars")) & (F.col("n_dup_lines") <= LINE_LIMIT * F.col("n_lines"))
    for n, most in NGRAM_LIMITS.items():
        fine &= F.col(f"dup_{n}gram_chars") <= most * F.col("word_chars")
    return m.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)
