"""Publication records, label files, tuple files and dimension files.

Files are read by Spark's text reader; a record's lines are told apart by running counts of
marker lines, so files of any number are parsed in parallel, one file a window partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Publication types in the order of their numbers.
TYPES = ["article", "inproceedings", "book", "incollection", "phdthesis", "mastersthesis"]


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, line): whole small files, cut into numbered lines."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return text.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))


def parsed(title: Column, authors: Column, third: Column) -> list[Column]:
    """Columns of a record from its three lines."""
    names = F.transform(F.filter(F.split(authors, r"\s*,\s*"), lambda x: F.trim(x) != ""), lambda x: F.regexp_replace(F.lower(F.trim(x)), r" \d{4}$", ""))
    venue = F.nullif(F.trim(F.regexp_replace(F.split(F.regexp_extract(third, r"^\S*(?:\([^)]*\) )?\d{4}\. \w+: (.*?)(?:\. key: .*)?$", 1), ",")[0], r"\([^)]*\)", "")), F.lit(""))
    kind = F.regexp_extract(third, r"\d{4}\. (\w+):", 1)
    return [
        F.trim(title).alias("title"), names.alias("authors"), F.regexp_extract(third, r"\b(\d{4})\b", 1).try_cast("int").alias("year"),
        (F.nullif(F.array_position(F.array(*map(F.lit, TYPES)), kind), F.lit(0)) - 1).cast("int").alias("type"), venue.alias("venue"), F.nullif(F.regexp_extract(third, r"key: (\S+?)\.?$", 1), F.lit("")).alias("pubkey"),
    ]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of three lines and a blank one: title; authors; year, type, venue and key."""
    lines = numbered_lines(spark, path).withColumn("blank", F.trim("line") == "")
    w = Window.partitionBy("file").orderBy("n")
    lines = lines.withColumn("record", F.sum(F.col("blank").cast("int")).over(w)).where("not blank")
    rec = lines.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("n", "line"))).alias("l")).where(F.size("l") == 3)
    return rec.select("file", "record", *parsed(F.col("l")[0]["line"], F.col("l")[1]["line"], F.col("l")[2]["line"]))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labelled clusters: a heading with number, size and identity, then records. `complete` tells whether the size holds; identities that start with N/A are null."""
    head = r"^Cluster (\d+), (\d+) papers:\s*(.*)$"
    w = Window.partitionBy("file").orderBy("n")
    lines = numbered_lines(spark, path).withColumn("h", F.col("line").rlike(head)).withColumn("cluster", F.sum(F.col("h").cast("int")).over(w)).where("cluster > 0 and trim(line) != ''")
    heads = lines.where("h").select("file", "cluster", F.regexp_extract("line", head, 1).cast("int").alias("cluster_no"), F.regexp_extract("line", head, 2).cast("int").alias("size"), F.translate(F.trim(F.regexp_extract("line", head, 3)), "()", "[]").alias("identity"))
    place = F.row_number().over(Window.partitionBy("file", "cluster").orderBy("n")) - 1
    body = lines.where("not h").withColumn("i", place).groupBy("file", "cluster", F.floor(F.col("i") / 3).alias("record")).agg(F.sort_array(F.collect_list(F.struct("n", "line"))).alias("l")).where(F.size("l") == 3)
    focus = F.regexp_extract(F.url_decode(F.col("file")), r"([^/]+?)(?:-labels)?(?:-full)?\.txt$", 1)
    out = body.join(heads, ["file", "cluster"]).select(focus.alias("focus"), "cluster", "cluster_no", "size", F.when(~F.col("identity").startswith("N/A"), F.col("identity")).alias("identity"), "record", *parsed(F.col("l")[0]["line"], F.col("l")[1]["line"], F.col("l")[2]["line"]))
    return out.withColumn("complete", F.count("*").over(Window.partitionBy("focus", "cluster")) == F.col("size"))


def read_tuples(spark: SparkSession, path: str) -> DataFrame:
    """Tuple files: clusters of lines with authors, a quoted key, venue and year."""
    head = r"^Cluster (\d+), (\d+) tuples(?: \((.*)\))?"
    w = Window.partitionBy("file").orderBy("n")
    lines = numbered_lines(spark, path).withColumn("h", F.col("line").rlike(head)).withColumn("cluster", F.sum(F.col("h").cast("int")).over(w)).where("cluster > 0")
    affiliation = F.last(F.when(F.col("h"), F.regexp_extract("line", head, 3)), ignorenulls=True).over(w)
    row = r'^(.*?),?\s*"([^"]*)"\s*(.*?),\s*(\d{4})\s*$'
    return lines.withColumn("affiliation", affiliation).where(F.col("line").rlike(row)).select("file", "cluster", "affiliation", F.split(F.regexp_extract("line", row, 1), r"\s*,\s*").alias("authors"), F.lower(F.regexp_extract("line", row, 2)).alias("pubkey"), F.nullif(F.regexp_extract("line", row, 3), F.lit("NULL")).alias("venue"), F.regexp_extract("line", row, 4).cast("int").alias("year"))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Dictionaries: the first tab field of each line that is neither blank nor a comment."""
    return spark.read.text(path).select(F.trim(F.split("value", "\t")[0]).alias("word")).where("word != '' and not startswith(word, '#')").distinct()


def read_triples(spark: SparkSession, path: str, predicate: str) -> DataFrame:
    """(subject, object) of N-Triples with a predicate, by the last part of their names."""
    row = r"^<[^>]*/([^/>]+)> <([^>]+)> <[^>]*/(?:Category:)?([^/>]+)> \.$"
    return spark.read.text(path).where(F.regexp_extract("value", row, 2).endswith(predicate)).select(F.regexp_extract("value", row, 1).alias("subject"), F.regexp_extract("value", row, 3).alias("object"))


def read_xml_records(spark: SparkSession, path: str) -> DataFrame:
    """Publication elements of an XML dump, one reader for each type, without records that lack authors or year."""
    out = None
    for k, tag in enumerate(TYPES):
        schema = "_key string, author array<string>, title string, year int, booktitle string, journal string, cite array<string>"
        d = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).select(F.col("_key").alias("pubkey"), F.col("author").alias("authors"), "title", "year", F.coalesce("booktitle", "journal").alias("venue"), F.lit(k).alias("type"), "cite")
        out = d if out is None else out.unionByName(d)
    return out.where("size(authors) > 0 and year is not null")


def read_ragged(spark: SparkSession, path: str) -> DataFrame:
    """(name, coauthor, n) of lines `name TAB count TAB count TAB coauthor:n TAB ...`."""
    p = F.split("value", "\t")
    return spark.read.text(path).select(p[0].alias("name"), F.explode(F.slice(p, 4, 1_000_000)).alias("x")).select("name", F.regexp_extract("x", r"^(.*):(\d+)$", 1).alias("coauthor"), F.regexp_extract("x", r"^(.*):(\d+)$", 2).cast("long").alias("n"))


def record_lines(pubs: DataFrame) -> DataFrame:
    """The text form of records, for write.text: parsing it again gives the same records."""
    kind = F.element_at(F.array(*map(F.lit, TYPES)), F.col("type") + 1)
    third = F.concat(F.col("year").cast("string"), F.coalesce(F.concat(F.lit(". "), kind, F.lit(": "), "venue"), F.lit("")), F.coalesce(F.concat(F.lit(". key: "), "pubkey"), F.lit("")))
    return pubs.select(F.concat_ws("\n", "title", F.array_join("authors", ","), third, F.lit("")).alias("value"))
