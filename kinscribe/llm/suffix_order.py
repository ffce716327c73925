"""Suffix order of many strings by prefix-free parsing, in numpy.

A rolling hash of TRIGGER bytes marks triggers; phrases run from one trigger to the next and
overlap by it. The distinct phrases are the dictionary, the sequence of phrases is the parse.
No phrase suffix longer than a trigger is a proper prefix of another, so the order of the
dictionary's suffixes, and then the order of the parse's suffixes, give the order of all
suffixes of all strings. Repeated content is sorted once, in the dictionary.
"""

from __future__ import annotations

import numpy as np

from .common import Hasher, groups_of, ranges

TRIGGER, MODULUS = 6, 12


def doubled(symbols: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Ranks (from 1) of the suffixes of strings that end before stops, by prefix doubling.

    stops: for each place the end of its string. Equal suffixes get equal ranks."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1
    step, at = 1, np.arange(n)
    while True:
        ahead = at + step
        live = ahead < stops
        if not live.any():
            return rank
        second = np.zeros(n, np.int64)
        second[live] = rank[ahead[live]]
        order, first = groups_of(rank * (n + 2) + second)
        fresh = np.zeros(n, np.int64)
        fresh[first] = 1
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(fresh)
        if len(first) == int(rank.max()):
            return new
        rank, step = new, step * 2


def suffix_order(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of all suffixes of the strings, concatenated in data, in lexicographic order.

    A string's end sorts before any byte; equal suffixes keep the order of their places.
    Empty strings have no suffix; no strings give an empty array."""
    data, lengths = np.asarray(data, np.uint8), np.asarray(lengths, np.int64)
    if not len(data):
        return np.zeros(0, np.int64)
    lengths = lengths[lengths > 0]
    # every string gets TRIGGER end marks (0; bytes count from 1), whose window is its last trigger
    long = lengths + TRIGGER
    begin = np.concatenate(([0], np.cumsum(long)[:-1]))
    text = np.zeros(int(long.sum()), np.int64)
    places = ranges(begin, lengths)
    text[places] = data.astype(np.int64) + 1
    hasher = Hasher(text.astype(np.uint8))  # 256 folds onto 0: triggers only need to agree on equal windows
    starts = np.arange(len(text) - TRIGGER + 1)
    trigger = np.zeros(len(text), bool)
    trigger[: len(starts)] = hasher.of(starts, starts + TRIGGER) % np.uint64(MODULUS) == 0
    for k in range(TRIGGER):  # windows that touch end marks: only the last is a trigger
        trigger[begin + lengths - k] = k == 0
    trigger[ranges(begin + lengths + 1, np.full(len(begin), TRIGGER - 1))] = False
    last = begin + lengths
    head = trigger.copy()
    head[begin] = True
    head[last] = False
    first = np.flatnonzero(head)
    owner = np.searchsorted(begin, first, "right") - 1
    after = np.concatenate((first[1:], [len(text)]))
    stop = np.where(after < np.append(begin[1:], len(text))[owner], after, last[owner]) + TRIGGER
    size = stop - first

    # the dictionary: one copy of each distinct phrase
    order, lead = groups_of(hasher.of(first, stop) ^ _end_mark(text, first, stop))
    phrase = np.empty(len(first), np.int64)
    phrase[order] = np.repeat(np.arange(len(lead)), np.diff(np.append(lead, len(first))))
    own = order[lead]
    words, word_size = text[ranges(first[own], size[own])], size[own]
    word_begin = np.concatenate(([0], np.cumsum(word_size)[:-1]))
    word_rank = doubled(words, np.repeat(word_begin + word_size, word_size))

    # the parse: phrases by their order in the dictionary
    run_end = np.append(np.searchsorted(first, begin[1:]), len(first))[owner]
    parse_rank = doubled(word_rank[word_begin[phrase]], run_end)
    following = np.arange(len(first)) + 1
    ends_here = following >= run_end
    next_rank = np.where(ends_here, 0, parse_rank[np.minimum(following, len(first) - 1)])

    # a suffix belongs to the last phrase that starts at or before it
    at_phrase = np.searchsorted(first, places, "right") - 1
    key1 = word_rank[word_begin[phrase[at_phrase]] + places - first[at_phrase]]
    return np.lexsort((next_rank[at_phrase], key1))


def _end_mark(text: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Keeps a phrase that holds an end mark apart from one with byte 255 there, which hashes alike."""
    marks = np.concatenate(([0], np.cumsum(text == 0)))
    return ((marks[stop] - marks[first]).astype(np.uint64)) * np.uint64(0x9FB21C651E98DF25)
