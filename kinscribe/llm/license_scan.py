"""License scans (operator 7): ordered signature rules, with DataFrame functions only.

Texts that hold none of a few stems are passed over by one expression. The others are
normalised to lower-case words between double blanks. Each rule is gated by its keyword; gated
rules' regexes give intervals; an interval inside another one of higher priority (or of equal
priority and more length, or the same interval of an earlier rule) is suppressed. What is left
labels the document; base phrases always do.

Scale: a projection, no shuffle. Rules are a literal of fixed size.

Defined cases: null text is empty: no words, no labels, score 0; repeated rows are judged one
by one; an empty table gives an empty one; only the two named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import rules, wide

#: Base phrases and their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: Some stem of each rule and phrase stands in every text that it matches.
STEMS = r"(?i)licen[cs]e|(?:^|[^0-9a-z\x{80}-\x{10FFFF}])cc[^0-9a-z\x{80}-\x{10FFFF}]+by[^0-9a-z\x{80}-\x{10FFFF}]|permission|redistribut|copyright|public[^0-9a-z\x{80}-\x{10FFFF}]+domain|rights|origin|[^0-9a-z\x{80}-\x{10FFFF}]under[^0-9a-z\x{80}-\x{10FFFF}]|^under[^0-9a-z\x{80}-\x{10FFFF}]|spdx"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DETECTIONS = "array<struct<start:int,end:int,priority:int,rule:string,label:string>>"


def blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def places(text: Column, rule: Column) -> Column:
    """Intervals of all matches of one rule: the text between matches and the matches add up to their places."""
    found = F.regexp_extract_all(text, rule["pattern"], F.lit(0))
    between = F.split(text, rule["pattern"], -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(DETECTIONS).alias("out"))

    def add(acc: Column, pair: Column) -> Column:
        a = acc["at"] + F.length(pair["before"])
        b = a + F.length(pair["match"])
        one = F.struct(a.alias("start"), b.alias("end"), rule["priority"].alias("priority"), rule["id"].alias("rule"), rule["label"].alias("label"))
        return F.struct(b.alias("at"), F.concat(acc["out"], F.array(one)).cast(DETECTIONS).alias("out"))

    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda x, y: F.struct(x.alias("before"), y.alias("match")))
    return F.when(F.size(found) > 0, F.aggregate(pairs, start, add)["out"]).otherwise(F.array().cast(DETECTIONS))


def unsuppressed(found: Column) -> Column:
    def beats(e: Column, d: Column) -> Column:
        longer = (e["end"] - e["start"]) > (d["end"] - d["start"])
        same = (e["end"] == d["end"]) & (e["start"] == d["start"])
        return (e["start"] <= d["start"]) & (e["end"] >= d["end"]) & ((e["priority"] > d["priority"]) | ((e["priority"] == d["priority"]) & (longer | (same & (e["rule"] < d["rule"])))))

    return F.filter(found, lambda d: ~F.exists(found, lambda e: beats(e, d)))


def license_scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections) of every document."""
    table = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(label).alias("label"), F.lit(p).alias("priority"), F.lit(k).alias("keyword"), F.lit(x).alias("pattern")) for i, label, p, k, x in rules()])
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    d = docs.select(F.col(id_column).alias("doc_id"), text.alias("text"))
    d = d.select("doc_id", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"), F.when(F.col("text").rlike(STEMS), F.regexp_replace(F.lower(F.concat(F.lit(" "), "text", F.lit(" "))), BREAK, "  ")).alias("norm"))
    norm = F.col("norm")
    count, first, last = [], [], []
    for phrase, _ in BASE:
        p = wide(phrase)
        n = F.floor((F.length(norm) - F.length(F.replace(norm, F.lit(p), F.lit("")))) / len(p))
        count.append(n)
        at = F.instr(norm, p)
        back = F.length(norm) - F.instr(F.reverse(norm), p[::-1]) - len(p) + 2
        first.append(F.when(at > 0, (blanks(F.substring(norm, F.lit(1), at)) - 1) / 2))
        last.append(F.when(at > 0, (blanks(F.substring(norm, F.lit(1), back)) - 1) / 2))
    d = d.select(
        "doc_id", "n_words",
        F.when(norm.isNotNull(), F.struct(*[n.alias(f"n{i}") for i, n in enumerate(count)], F.least(*first).alias("first"), F.greatest(*last).alias("last"))).alias("base"),
        F.when(norm.isNotNull(), F.flatten(F.transform(F.filter(table, lambda r: F.contains(norm, r["keyword"])), lambda r: places(norm, r)))).alias("found"),
    )
    d = d.select("doc_id", "n_words", "base", F.when(F.size("found") > 0, unsuppressed(F.col("found"))).otherwise(F.array().cast(DETECTIONS)).alias("detections"))
    base = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"base.n{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)])))
    both = F.array_sort(F.array_distinct(F.concat(base, F.transform("detections", lambda x: x["label"]))))
    total = F.coalesce(sum((F.col(f"base.n{i}") for i in range(len(BASE))), F.lit(0)), F.lit(0))
    score = F.coalesce(F.array_max(F.transform("detections", lambda x: x["priority"])) / 100.0, F.lit(0.0))
    return d.select("doc_id", "n_words", total.cast("long").alias("n_base"), F.col("base.first").cast("long").alias("first_word"), F.col("base.last").cast("long").alias("last_word"), F.array_join(base, ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), F.greatest(score, F.when(total > 0, 0.5).otherwise(0.0)).alias("score"), "detections")
