from kinscribe.operators import language as V


def test_texts_in_one_piece_are_dealt_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(V, "PART_BYTES", 200)
    rows = [(k, "der Hund and the dog " * (k % 3)) for k in range(60)] + [(90, None), (91, "")]
    texts = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    dealt = V.spread(texts)
    assert dealt.rdd.getNumPartitions() == -(-sum(len(x or "") for _, x in rows) // 200)
    assert sorted((r.id, r.text or "") for r in dealt.collect()) == sorted((k, x or "") for k, x in rows)
    assert V.spread(texts.limit(1)).rdd.getNumPartitions() == 1
