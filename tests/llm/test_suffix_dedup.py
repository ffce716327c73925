import hashlib
import random

import numpy as np

from kinscribe.llm.suffix_dedup import suffix_dedup
from kinscribe.llm.suffix_order import suffix_order


def test_suffix_order_is_the_naive_order():
    r = random.Random(5)
    for alphabet, n in ((b"ab", 40), (b"abcdefgh", 200), (bytes(range(256)), 300)):
        for _ in range(8):
            base = bytes(r.choice(alphabet) for _ in range(n))
            strings = [base[r.randrange(n) : r.randrange(n + 1)] for _ in range(6)] + [base, base, b"", b"\xff\x00", base * 2]
            data = b"".join(strings)
            want, at = [], 0
            for s in strings:
                want += [(s[i:], at + i) for i in range(len(s))]
                at += len(s)
            got = suffix_order(np.frombuffer(data, np.uint8), np.array([len(s) for s in strings]))
            assert got.tolist() == [p for _, p in sorted(want)]


def brute(rows, k=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - k + 1):
            w = b[i : i + k]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - k + 1):
            if first[b[i : i + k]] < d:
                gone[i : i + k] = b"\1" * k
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def cases():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, long = text(30), text(3000)
    rows = [(i, text(r.randrange(1, 60))) for i in range(40)]
    rows += [(100 + i, text(5) + passage + text(5)) for i in range(20)]
    rows += [(200, long), (201, long[:500] + "X" + long[501:]), (202, long), (203, "a" * 700), (204, "a" * 300 + "b" + "a" * 60), (205, None), (206, ""), (207, passage[:49]), (208, passage[3:55])]
    return rows


def test_against_brute_force(spark):
    rows = cases()
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).selectExpr("doc_id", "text", "1 as block", "2 as shard")
    got = [(x.doc_id, x.n_bytes, sum(s.end - s.start for s in x.spans), len(x.spans), hashlib.sha256(bytes(x.kept)).hexdigest()) for x in suffix_dedup(df).collect()]
    assert sorted(got) == brute(rows)


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup(df).count() == 0
    df = spark.createDataFrame([(None, "x" * 80), (1, "x" * 80), (1, "x" * 80)], "doc_id long, text string")
    assert sorted(len(x.spans) for x in suffix_dedup(df).collect()) == [0, 0, 0]
