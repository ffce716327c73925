import pytest
from pyspark.sql import functions as F

from kinscribe.functions.numbers import sampling_ratio
from kinscribe.operators.clustering import agglomerate
from kinscribe.operators.merging import greedy_jaccard, stage_one
from kinscribe.sources import records as R
from kinscribe.streaming.counters import keep_state, latest, running_counts, windowed_counts


def test_sampling_ratio_by_hand():
    # one draw, weights 1.5 and .5 of 2, two multisets of one draw over two outcomes
    assert sampling_ratio({"a": 1}, {"a": 1}) == pytest.approx(1.5)
    # the drawn outcome is unseen: .5 of 4, twice
    assert sampling_ratio({"a": 3}, {"b": 1}) == pytest.approx(0.25)
    assert sampling_ratio({"b": 1}, {"a": 3}) == pytest.approx(0.25)
    assert sampling_ratio({"a": 3}, {"b": 1}, floor=0.5) == 0.5
    # counts above the cap weigh as the cap
    assert sampling_ratio({"a": 9}, {"a": 1}) == pytest.approx(2 * 4.5 / 5)


def test_greedy_jaccard():
    assert greedy_jaccard([{"a", "b"}, {"c"}, {"b", "d"}], 0.3) == [0, 1, 0]
    assert greedy_jaccard([{"a"}, {"b"}], 0.3) == [0, 1]
    assert greedy_jaccard([], 0.3) == []
    # the second joins only what the first and third make together
    assert greedy_jaccard([{"a", "b"}, {"a", "c", "d"}, {"a", "b", "c", "d"}], 0.5) == [0, 0, 0]


def test_stage_one_is_by_focus_and_order(spark):
    rows = [("x", 2, ["b", "d"]), ("x", 1, ["c"]), ("x", 0, ["a", "b"]), ("y", 5, ["a", "b"]), ("y", 6, [])]
    got = stage_one(spark.createDataFrame(rows, "focus string, pub long, partners array<string>"), 0.3).collect()
    assert {(x.focus, x.pub): x.cluster for x in got} == {("x", 0): 0, ("x", 1): 1, ("x", 2): 0, ("y", 5): 0, ("y", 6): 1}


def test_agglomerate():
    score = {(0, 1): 0.9, (0, 2): 0.6, (1, 2): 0.1}
    run = lambda stop, least: agglomerate(lambda i, j: score[i, j], 3, stop, least, lambda i, j: None)
    assert run(1, 0.5) == [[0, 1, 2]]
    assert run(2, 0.5) == [[0, 1], [2]]
    assert run(1, 0.7) == [[0, 1], [2]]
    assert run(1, 0.95) == [[0], [1], [2]]


def test_records_round_trip(spark, tmp_path):
    (tmp_path / "in.txt").write_text("A study.\nAnn Bee 0001, Cy Dee\n2001. article: VLDB (2), part. key: conf/x/1\n\nNo venue\nAnn Bee\n1999\n\n")
    one = R.read_records(spark, str(tmp_path / "in.txt")).drop("file", "record").orderBy("title").collect()
    assert [tuple(x) for x in one] == [("A study.", ["ann bee", "cy dee"], 2001, 0, "VLDB", "conf/x/1"), ("No venue", ["ann bee"], 1999, None, None, None)]
    R.record_lines(R.read_records(spark, str(tmp_path / "in.txt"))).coalesce(1).write.text(str(tmp_path / "out"))
    assert R.read_records(spark, str(tmp_path / "out")).drop("file", "record").orderBy("title").collect() == one


def test_labels(spark, tmp_path):
    (tmp_path / "ann bee-labels.txt").write_text("2 clusters.\n\nCluster 1, 2 papers:\tLab (x)\nOne.\nAnn Bee\n2001. key: k/1.\nTwo.\nAnn Bee, Cy\n2002. key: k/2.\n\nCluster 2, 2 papers:\tN/A\nThree.\nAnn Bee\n2003. key: k/3.\n\n")
    got = R.read_labels(spark, str(tmp_path)).orderBy("pubkey").select("focus", "cluster_no", "size", "identity", "pubkey", "year", "complete").collect()
    assert [tuple(x) for x in got] == [("ann bee", 1, 2, "Lab [x]", "k/1", 2001, True), ("ann bee", 1, 2, "Lab [x]", "k/2", 2002, True), ("ann bee", 2, 2, None, "k/3", 2003, False)]


def test_tuples_words_triples_ragged(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    tuples = R.read_tuples(spark, put("t.dat", 'ann\n1\n\nCluster 1, 1 tuples (Lab)\nann bee, cy dee,    "Conf/X"   VLDB, 2001\nCluster 2, 1 tuples ()\nann bee,    "k"   NULL, 2002\n')).orderBy("cluster")
    assert [tuple(x)[1:] for x in tuples.collect()] == [(1, "Lab", ["ann bee", "cy dee"], "conf/x", "VLDB", 2001), (2, "", ["ann bee"], "k", None, 2002)]
    assert {x.word for x in R.read_words(spark, put("w.txt", "# note\n\nuno\t1\ndue\nuno\t2\n")).collect()} == {"uno", "due"}
    line = "<http://d/r/{}> <http://p/subject> <http://d/r/Category:{}> ."
    triples = R.read_triples(spark, put("n.nt", line.format("A", "B") + "\n" + line.format("C", "D").replace("subject", "other") + "\n"), "subject")
    assert [tuple(x) for x in triples.collect()] == [("A", "B")]
    ragged = R.read_ragged(spark, put("r.tsv", "ann\t2\t1\tcy:2\tdi:1\n"))
    assert [tuple(x) for x in ragged.orderBy("coauthor").collect()] == [("ann", "cy", 2), ("ann", "di", 1)]


def events(spark, folder):
    rows = [(k, f"2024-01-01 00:{k % 60:02d}:00", "ab"[k % 3 == 0]) for k in range(50)]
    df = spark.createDataFrame(rows, "id long, at string, kind string").withColumn("at", F.to_timestamp("at"))
    df.repartition(3).write.parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder), df


def test_streamed_counts_equal_batch(spark, tmp_path):
    stream, batch = events(spark, str(tmp_path / "in"))
    state = str(tmp_path / "state")
    keep_state(running_counts(stream, "kind"), state, str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(latest(spark, state, "kind").collect()) == sorted(running_counts(batch, "kind").collect())


def test_windows_equal_batch(spark, tmp_path):
    stream, batch = events(spark, str(tmp_path / "in"))
    state = str(tmp_path / "state")
    keep_state(windowed_counts(stream, "at", "10 minutes", "2 hours", "kind"), state, str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    got = latest(spark, state, "start", "stop", "kind")
    assert sorted(got.collect()) == sorted(windowed_counts(batch, "at", "10 minutes", "2 hours", "kind").collect())
