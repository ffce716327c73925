import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kinscribe.llm.packing import OpenWindows, best_fit, pack_documents
from kinscribe.llm.quality_rules import LINE_CHAR_LIMIT, LINE_LIMIT, NGRAM_LIMITS, repetition_quality

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts(seed=4):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé#<") for _ in range(r.randrange(1, 4)))
    out = [None, "", " \n ", "a", "a\n\na\nb\n", "x " * 400, "\tüber\x0b straße\n" * 5, "\n", "x" * 5000]
    return out + ["".join(word() + r.choice("   \n\t") for _ in range(r.randrange(1, 300))) for _ in range(60)]


def quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), []
    for x in lines:
        if x in seen:
            dup.append(x)
        seen.add(x)
    chars, covered = sum(map(len, words)), {}
    for n in NGRAM_LIMITS:
        grams = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        covered[n] = {j for i in range(len(words) - n + 1) if grams[tuple(words[i : i + n])] > 1 for j in range(i, i + n)}
    failed = len(words) < 10 or 100 * len(covered[5]) > 20 * len(words)
    fine = sum(map(len, dup)) <= LINE_CHAR_LIMIT * chars and len(dup) <= LINE_LIMIT * len(lines) and all(sum(len(words[j]) for j in covered[n]) <= m * chars for n, m in NGRAM_LIMITS.items())
    return len(words), chars, len(re.findall(r"[#*$%&|<>]", text)), len(dup), len(covered[5]), failed, not failed and fine


def test_quality_against_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_words")
    got = {x.doc_id: (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed, x.kept) for x in repetition_quality(df).collect()}
    assert got == {i: quality(t) for i, t in rows}
    assert repetition_quality(df.limit(0)).count() == 0


def test_tree_finds_the_tightest():
    r, tree, held = random.Random(2), OpenWindows(64), []
    for w in range(3000):
        if r.random() < 0.5:
            room = r.randrange(1, 65)
            tree.add(room, w)
            held.append((room, w))
        else:
            n = r.randrange(1, 65)
            want = min((x for x, _ in held if x >= n), default=None)
            got = tree.tightest(n)
            assert (got and got[0]) == want
            if got:
                held.remove(got)


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_places_every_token_once(seed):
    r = random.Random(seed)
    lengths = [r.choice([1, 5, 300, 2048, 4096, 5000, r.randrange(1, 9000)]) for _ in range(r.randrange(1, 60))]
    seen = Counter()
    for window in best_fit(lengths):
        total = sum(n for _, _, n in window)
        assert total <= 2048 and (total == 2048 or total & (total - 1) == 0)
        for d, start, n in window:
            assert n > 0
            seen.update((d, x) for x in range(start, start + n))
    assert seen == Counter((d, x) for d, n in enumerate(lengths) for x in range(n))


def test_packing_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(texts(9))] + [(500, "word " * 6000), (501, "see <|endoftext|> here"), (502, "\x00   日本語 🙂   x")]
    plain = Tokenizer.from_file(PATH)
    ids = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    out = pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH).collect()
    placed = Counter()
    for x in out:
        part = ids[x.doc_id][x.start : x.start + x.length]
        assert x.ids_crc32 == zlib.crc32(b"".join(v.to_bytes(4, "little") for v in part)) and x.doc_tokens == len(ids[x.doc_id])
        placed.update((x.doc_id, k) for k in range(x.start, x.start + x.length))
    assert placed == Counter((i, k) for i, v in ids.items() for k in range(len(v)))
    by = {}
    for x in out:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for v in by.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= 2048
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
