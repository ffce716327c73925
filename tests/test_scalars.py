from pyspark.sql import functions as F

from kinscribe.functions.collections import index_of_max
from kinscribe.functions.names import pinyin_length
from kinscribe.functions.strings import restore_entities


def test_index_of_max(spark):
    rows = [([0, 0],), ([],), ([1, 3, 3],), ([0, -2, -5],), ([None, 2],), ([None, 0],), (None,)]
    got = spark.createDataFrame(rows, "a array<int>").select(index_of_max(F.col("a")).alias("i")).collect()
    assert [x.i for x in got] == [-1, -1, 1, 1, 1, -1, -1]


def test_restore_entities(spark):
    rows = [("a &times; b",), ("x&mdash;y &micro;m",), ("&lt;i&gt; &amp;lt; &quot;q&quot;",), ("&reg;&lgr;&sgr;&nbsp;",), (None,)]
    got = spark.createDataFrame(rows, "c string").select(restore_entities(F.col("c")).alias("c")).collect()
    assert [x.c for x in got] == ["a * b", "x-y mum", '<i> &lt; "q"', "lambdasigma ", None]


def test_pinyin_length(spark):
    table = F.array(*map(F.lit, ["xiao", "ming", "ou", "yang", "wei", "wang"]))
    surnames = F.array(F.lit("ouyang"))
    rows = [("Xiaoming Ouyang",), ("wei wang",), ("Xiao-Ming Wang",), ("wei",), ("john smith",), ("wei wang wei",)]
    d = spark.createDataFrame(rows, "name string")
    got = d.select(pinyin_length(F.col("name"), table, surnames).alias("n"), pinyin_length(F.col("name"), table).alias("plain")).collect()
    assert [x.n for x in got] == [3, 2, 3, 0, 0, 0]
    assert [x.plain for x in got] == [0, 2, 3, 0, 0, 0]
