import random

from kinscribe.llm.decontamination import Automaton, automata, find_contamination, remove_contamination, words_of


def brute(text, items, k=10):
    w = words_of(text)
    hit, named = set(), set()
    for name, t in items:
        v = words_of(t)
        size = min(k, len(v))
        wins = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if v else set()
        for i in range(len(w) - size + 1 if size else 0):
            if tuple(w[i : i + size]) in wins:
                hit.update(range(i, i + size))
                named.add(str(name))
    return len(w), len(hit), sorted(named)


def data():
    r = random.Random(8)
    vocab = ["the", "of", "Über", "b2", "x", "y", "naïve", "Q"]
    text = lambda n: r.choice([" ", ", ", "\n"]).join(r.choice(vocab) for _ in range(n))
    items = [(i, text(r.choice([1, 2, 3, 9, 10, 11, 25, 40]))) for i in range(3, 30)] + [(40, None), (41, ""), (42, "..."), (2, "the of x y the of x y the of x y the of"), (55, "the of x y the of x y the of x y the of"), (60, "zebra"), (61, "lion tiger")]
    docs = [(i, text(r.randrange(0, 80))) for i in range(60)]
    docs += [(100 + i, text(12) + " zz " + (t or "") + "! zz " + text(7)) for i, (_, t) in enumerate(items)] + [(300, None), (301, ""), (302, "zebra"), (303, "lion, TIGER lion")]
    return items, docs


def test_against_brute_force(spark):
    items, docs = data()
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "5 as n_words")
    got = {x.doc_id: (x.n_words, x.n_hit, x["items"]) for x in find_contamination(d, b).collect()}
    assert got == {i: brute(t, items) for i, t in docs}
    assert len(automata(b, 10, most_bytes=200)) > 3
    for x in find_contamination(d, b).collect():
        assert sum(s["words"] for s in x.spans) == x.n_hit
        raw = (dict(docs)[x.doc_id] or "").encode()
        assert sum(len(words_of(raw[s.start : s.end].decode())) for s in x.spans) == x.n_hit


def test_short_words_only_by_automaton():
    m = Automaton([("a", ["p"]), ("b", ["p", "q"]), ("c", ["q", "p", "q"])], 10)
    assert sorted((at, n) for at, n, _ in m.stream([m.word_number.tolist()[0]] * 0)) == []


def test_empty_benchmark_and_removal(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    item = " ".join(f"w{i}" for i in range(20))
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    d = spark.createDataFrame([(1, "start " + "and more words " * 12 + item + " end."), (2, item), (3, "clean text"), (4, None)], "doc_id long, text string")
    assert {x.n_hit for x in find_contamination(d, empty).collect()} == {0}
    assert find_contamination(d.limit(0), b).count() == 0
    got = {x.doc_id: x.text for x in remove_contamination(d, b).collect()}
    assert got == {1: "start " + "and more words " * 12 + " end.", 3: "clean text", 4: None}
