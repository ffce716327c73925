"""The language vote against a plain scan of the text, word by word."""

import random
import re

import pytest

from kinscribe.operators import language as V

ENGLISH = [("of", True), ("time", True), ("data", True), ("the", True), ("I'll", True), ("van", False), ("de facto standard", False), ("de jure", False), ("coup d'etat", False), ("laissez-faire", False), ("c'est", False), ("# note", True), ("a, b", True), ("123", True), (None, True)]
FOREIGN = [("de", True), ("facto", True), ("time", True), ("van", True), ("l'", True), ("coup", True), ("eau", True), ("d'etat", True), ("jure", True), ("laissez", True), ("c'est", True), ("grande eau", True)]


def decap(w):
    return w if not re.search("[a-z]", w) and re.search("[A-Z]{2}", w) else re.sub(r"\b([A-Z])(?=[^A-Z]|$)", lambda m: m[0].lower(), w)


def pieces(w, how):
    m = re.match(r"^([A-Za-z]*)(')([A-Za-z]*)$", w)
    if not m or how == V.WHOLE:
        return [w]
    return [m[1], m[2] + m[3]] if how == V.BEFORE else [m[1] + m[2], m[3]]


def entries(lines, how):
    out = {}

    def add(w, flag):
        if w:
            out[w] = out.get(w, 0) | flag

    for line, native in lines:
        if line is None or line.startswith("#") or "," in line or not re.search("[a-zA-Z]", line):
            continue
        words = re.split(r"\s+|-", decap(line))
        for k in range(1, len(words) + 1):
            if not native:
                add(" ".join(words[:k]), V.LOAN if k == len(words) else V.LOAN_PART)
        for w in words if native else []:
            for x in {w, *pieces(w, how)}:
                add(x, V.NATIVE)
    return out


def plain(text, english, foreign, how):
    f = s = e = u = total = pos = 0
    text = text or ""
    word = re.compile(r"(?<![a-zA-Z0-9'])([a-zA-Z']+)(?![a-zA-Z0-9'])")
    while m := word.search(text, pos):
        w, pos = decap(m[1]), m.end()
        flags = english.get(w, 0)
        if "'" in w and not flags & (V.LOAN | V.LOAN_PART):
            total += 2
            f += sum(foreign.get(x) == V.NATIVE for x in pieces(w, how))
            e += sum(english.get(x, 0) & V.NATIVE for x in pieces(w, V.BEFORE))
            continue
        total += 1
        if foreign.get(w) != V.NATIVE:
            e, u = e + (w in english), u + (w not in english)
            continue
        said, at, hit = w, pos, False
        while flags & V.LOAN_PART and (n := re.compile(r"[^a-zA-Z0-9']([a-zA-Z']+)(?![a-zA-Z0-9'])", re.S).match(text, at)):
            said, at = f"{said} {n[1]}", n.end()
            if english.get(said, 0) & V.LOAN:
                hit, pos = True, at
                break
            if not english.get(said, 0) & V.LOAN_PART:
                break
        if hit or flags & (V.NATIVE | V.LOAN):
            s += 1
        else:
            f += 1
    short = total <= 4 and e >= total - 1
    return total, f, s, e, u, not short and f > 0 and (3 * f >= e or s >= e)


@pytest.mark.parametrize("how,bound", [(V.BEFORE, 1 << 26), (V.AFTER, 1 << 26), (V.WHOLE, 1 << 26), (V.BEFORE, 0)])
def test_vote_by_scanning(spark, monkeypatch, how, bound):
    monkeypatch.setattr(V, "MAX_BROADCAST_BYTES", bound)
    r = random.Random(5)
    words = "de facto standard jure van time data the of eau l'eau I'll coup d'etat laissez faire c'est De DE Facto x2 2x o''o ' zzz".split()
    texts = ["".join(r.choice(words) + r.choice([" ", " ", " ", "-", ", ", "\n", "é"]) for _ in range(r.randrange(1, 14))) for _ in range(300)] + ["", None, "de facto de facto standard", "the " * 3000 + "eau " * 1000, "Coup d'etat", "de  facto standard"]
    lines = "line string, native boolean"
    english, foreign = (V.vocabulary(spark.createDataFrame(x, lines), h) for x, h in ((ENGLISH, V.BEFORE), (FOREIGN, how)))
    plain_e, plain_f = entries(ENGLISH, V.BEFORE), entries(FOREIGN, how)
    assert {x.entry: x.flags for x in english.collect()} == plain_e
    assert {x.entry: x.flags for x in foreign.collect()} == plain_f
    got = V.language_vote(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), english, foreign, how).collect()
    bad = [(texts[x.id], tuple(x)[1:], want) for x in got if tuple(x)[1:] != (want := plain(texts[x.id], plain_e, plain_f, how))]
    assert not bad and len(got) == len(texts)


def test_several_languages(spark):
    r = random.Random(9)
    words = "time eau l'eau l'art van data the I'll d'etat c'est zzz jure".split()
    texts = [" ".join(r.choices(words, k=r.randrange(12))) for _ in range(80)] + [None]
    lines = "line string, native boolean"
    loans = [x for x in ENGLISH if x[0] is None or len(re.split(r"[ -]", x[0])) < 2 or x[1]]  # no phrase: sums only
    english = V.vocabulary(spark.createDataFrame(loans, lines), V.BEFORE)
    of = {how: (V.vocabulary(spark.createDataFrame(FOREIGN, lines), how), how) for how in (V.BEFORE, V.AFTER)}
    got = V.language_votes(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), english, of).collect()
    assert len(got) == 2 * len(texts)
    for x in got:
        assert tuple(x)[2:] == plain(texts[x.id], entries(loans, V.BEFORE), entries(FOREIGN, x.language), x.language), texts[x.id]


def test_nothing(spark):
    none = spark.createDataFrame([], "line string, native boolean")
    t = spark.createDataFrame([(1, "any text"), (2, None)], "id long, text string")
    assert sorted(map(tuple, V.language_vote(t, V.vocabulary(none), V.vocabulary(none)).collect())) == [(1, 2, 0, 0, 0, 2, False), (2, 0, 0, 0, 0, 0, False)]
    assert V.language_vote(t.limit(0), V.vocabulary(none), V.vocabulary(none)).count() == 0
