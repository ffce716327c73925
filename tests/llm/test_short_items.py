"""What decontamination cuts of items shorter than a window, and what the length limit spares."""

from kinscribe.llm.decontamination import remove_contamination


def test_whole_short_items_are_cut(spark):
    filler = "and more words " * 8
    long = " ".join(f"w{k}" for k in range(20))
    b = spark.createDataFrame([(1, "zebra lion TIGER crow"), (2, "yak"), (3, long)], "item_id long, text string")
    part = "w3 w4 w5 w6 w7 w8"
    docs = {
        1: filler + "Zebra, lion tiger crow! " + filler, 2: filler + "zebra lion tiger " + filler, 3: filler + part + " " + filler, 4: filler + "yak yak " + filler,
        5: filler + part + " yak " + filler, 6: filler + long + " " + filler + "zebra lion tiger crow", 7: "zebra lion tiger crow", 8: None,
    }
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    cut = lambda **k: {x.doc_id: x.text for x in remove_contamination(d, b, **k).collect()}
    want = {1: filler + "! " + filler, 2: docs[2], 3: docs[3], 4: filler + " " + filler, 5: filler + part + "  " + filler, 6: filler + " " + filler, 8: None}
    assert cut() == want
    # with a window of five the part is a hit of six words, which the limit spares and a lower one doesn't
    assert cut(window=5) == want
    assert cut(window=5, max_span_words=5) == {**want, 3: filler + " " + filler, 5: filler + " " + filler}
