"""Language of short texts by dictionaries: vocabularies with native words, loan words and loan phrases, and the vote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import decapitalised
from .graph import checkpointed

#: Flags of an entry; one may bear several.
NATIVE, LOAN, LOAN_PART = 1, 2, 4
#: Where a language parts a word at its apostrophe: before it (d|'art), after it (d'|art), or not at all.
BEFORE, AFTER, WHOLE = "before", "after", "whole"
COUNTS = ["words", "foreign", "shared", "english", "unknown"]
#: Vocabularies are broadcast up to this size (64 bytes an entry beside its letters) and joined by shuffles above it.
MAX_BROADCAST_BYTES = 64 << 20
#: Bytes of texts to a partition: files may come as a few large pieces, and taking texts apart is the work.
PART_BYTES = 4 << 20


def spread(texts: DataFrame, column: str = "text") -> DataFrame:
    """texts, dealt by content to as many partitions as hold about PART_BYTES each; few texts stay where they are."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]
    parts = -(-size // PART_BYTES)
    return texts.repartition(parts, F.xxhash64(*texts.columns)) if parts > 1 else texts


def parted(word: Column, apostrophe: str) -> Column:
    """The pieces of a word with one apostrophe; other words stay whole."""
    if apostrophe == WHOLE:
        return F.array(word)
    cut = r"^([A-Za-z]*)('[A-Za-z]*)$" if apostrophe == BEFORE else r"^([A-Za-z]*')([A-Za-z]*)$"
    return F.when(word.rlike(cut), F.array(F.regexp_extract(word, cut, 1), F.regexp_extract(word, cut, 2))).otherwise(F.array(word))


def vocabulary(lines: DataFrame, apostrophe: str = WHOLE) -> DataFrame:
    """(entry, flags) of lines (line, native): dictionary lines of a language's own words, or of what it has borrowed.

    Lines with a comma, without a letter, or that start with # are notes; null lines are left out. Blanks and hyphens part
    a phrase. Native phrases give their words and the words' pieces; a borrowed phrase gives itself, blanks between, and
    its beginnings as parts."""
    w = lines.where("line is not null and not startswith(line, '#') and not contains(line, ',')").where(F.col("line").rlike("[a-zA-Z]"))
    w = w.select("native", F.filter(F.split(decapitalised(F.trim("line")), r"\s+|-"), lambda x: x != "").alias("words"))
    own = w.where("native").select(F.explode("words").alias("word")).select(F.explode(F.array_union(F.array("word"), parted(F.col("word"), apostrophe))).alias("entry"), F.lit(NATIVE).alias("flags"))
    begun = w.where("not native and size(words) > 0").select(F.transform(F.sequence(F.lit(1), F.size("words")), lambda n: F.struct(F.array_join(F.slice("words", F.lit(1), n), " ").alias("entry"), F.when(n == F.size("words"), LOAN).otherwise(LOAN_PART).alias("flags"))).alias("x"))
    return own.unionByName(begun.select(F.inline("x"))).where("entry != ''").groupBy("entry").agg(F.bit_or("flags").alias("flags"))


def _items(text: Column) -> Column:
    """Runs of letters, digits and apostrophes in order, each with the one character that parts it from the next run, if it is one."""
    return F.regexp_extract_all(text, F.lit(r"(?s)[a-zA-Z0-9']+(?:[^a-zA-Z0-9'](?=[a-zA-Z0-9']))?"), F.lit(0))


def _word(item: Column) -> Column:
    """The run itself; null where it has a digit."""
    run = F.regexp_extract(item, "^[a-zA-Z0-9']+", 0)
    return F.when(~run.rlike("[0-9]"), run)


def loan_phrases(texts: DataFrame, english: DataFrame) -> DataFrame | None:
    """(id, pos, n): positions from which a borrowed phrase of n words runs, the shortest; one character between words.

    None where the vocabulary has no phrase."""
    longest = english.where(F.col("flags").bitwiseAND(LOAN) > 0).agg(F.max(F.size(F.split("entry", " ")))).first()[0] or 1
    if longest < 2:
        return None
    leads = english.where(F.col("flags").bitwiseAND(LOAN_PART) > 0).where(~F.col("entry").contains(" ")).select(F.col("entry").alias("lead"))
    runs = texts.select("id", _items(F.col("text")).alias("items")).select("id", F.posexplode(F.transform("items", lambda x, i: F.slice("items", i + 1, F.lit(longest)))).alias("pos", "run"))
    at = runs.withColumn("lead", decapitalised(_word(F.element_at("run", 1)))).join(leads, "lead", "left_semi")
    said = at.select("id", "pos", F.explode(F.filter(F.sequence(F.lit(2), F.lit(longest)), lambda n: n <= F.size("run"))).alias("n"), "lead", "run")
    linked = F.forall(F.slice("run", F.lit(1), F.col("n") - 1), lambda x: x.rlike("(?s)[^a-zA-Z0-9']$"))
    words = F.transform(F.slice("run", F.lit(2), F.col("n") - 1), _word)
    said = said.where(linked & F.forall(words, lambda x: x.isNotNull())).select("id", "pos", "n", F.concat_ws(" ", F.col("lead"), F.array_join(words, " ")).alias("entry"))
    whole = english.where(F.col("flags").bitwiseAND(LOAN) > 0).select("entry")
    return said.join(whole, "entry", "left_semi").groupBy("id", "pos").agg(F.min("n").alias("n"))


def _in_order(texts: DataFrame, phrases: DataFrame, english: DataFrame, foreign: DataFrame, apostrophe: str) -> DataFrame:
    """(id, COUNTS) of texts in which phrases run: one fold over a text's words in order."""
    tokens = texts.select("id", F.posexplode(_items(F.col("text"))).alias("pos", "item")).select("id", "pos", decapitalised(_word(F.col("item"))).alias("word")).where("word is not null")
    quoted = F.col("word").contains("'")
    piece = lambda role, how: F.transform(parted(F.col("word"), how), lambda x: F.struct(F.lit(role).alias("role"), x.alias("entry")))
    pieces = F.when(quoted, F.concat(piece(1, apostrophe), piece(2, BEFORE)))
    rows = tokens.select("id", "pos", quoted.alias("quoted"), F.inline(F.concat(F.array(F.struct(F.lit(0).alias("role"), F.col("word").alias("entry"))), F.coalesce(pieces, F.array().cast("array<struct<role:int,entry:string>>")))))
    known = rows.join(english.select("entry", F.col("flags").alias("e")), "entry", "left").join(foreign.select("entry", (F.col("flags") == NATIVE).alias("f")), "entry", "left")
    known = known.join(phrases.withColumn("role", F.lit(0)), ["id", "pos", "role"], "left")
    has = lambda flag: F.coalesce(F.col("e"), F.lit(0)).bitwiseAND(flag) > 0
    f, there = F.coalesce(F.col("f"), F.lit(False)), F.col("e").isNotNull()
    takes = f & has(LOAN_PART) & F.col("n").isNotNull()
    whole = F.when(F.col("quoted") & ~has(LOAN | LOAN_PART), "parted").when(takes, "phrase").when(f & (~there | ~has(NATIVE | LOAN)), "foreign").when(f, "shared").when(there, "english").otherwise("unknown")
    kind = F.when(F.col("role") == 0, whole).when((F.col("role") == 1) & f, "foreign").when((F.col("role") == 2) & has(NATIVE), "english")
    seq = known.select("id", F.struct("pos", "role", kind.alias("kind"), F.coalesce("n", F.lit(1)).alias("n")).alias("x")).where("x.kind is not null").groupBy("id").agg(F.sort_array(F.collect_list("x")).alias("seq"))
    zero = F.struct(F.lit(0).alias("next"), F.lit(-1).alias("open"), *(F.lit(0).cast("long").alias(c) for c in COUNTS))

    def step(s: Column, x: Column) -> Column:
        k, parts = x["kind"], x["kind"] == "parted"
        counts = (x["pos"] >= s["next"]) & ((x["role"] == 0) | (s["open"] == x["pos"]))
        add = lambda *kinds: F.when(counts & k.isin(*kinds), 1).otherwise(0).cast("long")
        words = F.when(counts & (x["role"] == 0), F.when(parts, 2).otherwise(1)).otherwise(0).cast("long")
        return F.struct(
            F.when(counts & (k == "phrase"), x["pos"] + x["n"]).otherwise(s["next"]).alias("next"), F.when(counts & parts, x["pos"]).otherwise(s["open"]).alias("open"),
            (s["words"] + words).alias("words"), (s["foreign"] + add("foreign")).alias("foreign"), (s["shared"] + add("shared", "phrase")).alias("shared"), (s["english"] + add("english")).alias("english"), (s["unknown"] + add("unknown")).alias("unknown"),
        )

    return seq.select("id", F.aggregate("seq", zero, step).alias("c")).select("id", *(F.col(f"c.{k}") for k in COUNTS))


def _added(texts: DataFrame, english: DataFrame, foreigns: dict) -> DataFrame:
    """(id, language, COUNTS) of texts in which no phrase runs: every word counts for itself, so sums will do.

    All vocabularies become one table. It is broadcast up to MAX_BROADCAST_BYTES; above, equal words of a text are counted
    first, and adaptive execution splits the words that many texts share."""
    none = lambda but: [F.lit(True if k == but else None).cast("boolean").alias(f"f{k}") for k in range(len(foreigns))]
    table = english.select("entry", F.col("flags").alias("e"), *none(None))
    for k, (v, _) in enumerate(foreigns.values()):
        table = table.unionByName(v.where(F.col("flags") == NATIVE).select("entry", F.lit(None).cast("int").alias("e"), *none(k)))
    flags = ["e", *(f"f{k}" for k in range(len(foreigns)))]
    table = checkpointed(table.groupBy("entry").agg(*(F.max(c).alias(c) for c in flags)))
    size = table.agg(F.coalesce(F.sum(F.octet_length("entry") + 64), F.lit(0))).first()[0]
    words = F.regexp_extract_all("text", F.lit("(?<![a-zA-Z0-9'])[a-zA-Z']++(?![0-9])"), F.lit(0))  # runs without digits
    table = F.broadcast(table) if size <= MAX_BROADCAST_BYTES else table

    def flagged(texts: DataFrame, words: Column) -> DataFrame:
        said = texts.select("id", F.explode(words).alias("word")).select("id", decapitalised(F.col("word")).alias("word"))
        said = said.withColumn("n", F.lit(1).cast("long")) if size <= MAX_BROADCAST_BYTES else said.groupBy("id", "word").agg(F.count("*").alias("n"))
        return said.join(table.withColumnRenamed("entry", "word"), "word", "left").withColumn("cut", F.col("word").contains("'") & ~has("e", LOAN | LOAN_PART))

    has = lambda c, flag: F.coalesce(F.col(c), F.lit(0)).bitwiseAND(flag) > 0
    known = flagged(texts, words)
    piece = lambda of, how: F.transform(parted(F.col("word"), how), lambda x: F.struct(F.lit(of).alias("of"), x.alias("entry")))
    pieces = F.concat(piece("english", BEFORE), *(piece(how, how) for how in sorted({how for _, how in foreigns.values()})))
    parts = flagged(texts.where(F.col("text").contains("'")), F.filter(words, lambda x: x.contains("'")))
    pieces = parts.where("cut").select("id", "n", F.inline(pieces)).join(table, "entry", "left")
    one = lambda where: F.sum(F.when(where, F.col("n")).otherwise(0))
    there, out = F.col("e").isNotNull(), []
    for k, (_, how) in enumerate(foreigns.values()):
        f, free = F.coalesce(F.col(f"f{k}"), F.lit(False)), ~F.col("cut")
        own = ~has("e", NATIVE | LOAN)
        sums = [F.sum(F.when(F.col("cut"), 2 * F.col("n")).otherwise(F.col("n"))), one(free & f & own), one(free & f & ~own), one(free & ~f & there), one(free & ~f & ~there)]
        cut = [F.lit(0).cast("long"), one((F.col("of") == how) & f), F.lit(0).cast("long"), one((F.col("of") == "english") & has("e", NATIVE)), F.lit(0).cast("long")]
        out.append(([x.alias(f"{c}{k}") for c, x in zip(COUNTS, sums)], [x.alias(f"{c}{k}") for c, x in zip(COUNTS, cut)]))
    both = known.groupBy("id").agg(*(x for a, _ in out for x in a)).unionByName(pieces.groupBy("id").agg(*(x for _, b in out for x in b)))
    rows = F.array(*(F.struct(F.lit(name).alias("language"), *(F.col(f"{c}{k}").alias(c) for c in COUNTS)) for k, name in enumerate(foreigns)))
    return both.select("id", F.inline(rows)).groupBy("id", "language").agg(*(F.sum(c).alias(c) for c in COUNTS))


def language_votes(texts: DataFrame, english: DataFrame, foreigns: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(id, language, n_words, n_foreign, n_shared, n_english, n_unknown, is_foreign): language_vote for each of several
    languages, name -> (vocabulary, apostrophe), with the words of a text taken once for all."""
    texts = spread(texts.select("id", "text"))
    phrases = loan_phrases(texts, english)
    if phrases is None:
        counts = _added(texts, english, foreigns)
    else:
        phrases = checkpointed(phrases)
        ids = phrases.select("id").distinct()
        counts = _added(texts.join(ids, "id", "left_anti"), english, foreigns)
        for name, (v, how) in foreigns.items():
            counts = counts.unionByName(_in_order(texts.join(ids, "id", "left_semi"), phrases, english, v, how).withColumn("language", F.lit(name)))
    every = texts.select("id", F.explode(F.array(*map(F.lit, foreigns))).alias("language"))
    c = every.join(counts, ["id", "language"], "left")
    n = {k: F.coalesce(F.col(k), F.lit(0).cast("long")) for k in COUNTS}
    short = (n["words"] <= 4) & (n["english"] >= n["words"] - 1)
    return c.select("id", "language", *(v.alias(f"n_{k}") for k, v in n.items()), (~short & (n["foreign"] > 0) & ((n["foreign"] * 3 >= n["english"]) | (n["shared"] >= n["english"]))).alias("is_foreign"))


def language_vote(texts: DataFrame, english: DataFrame, foreign: DataFrame, apostrophe: str = WHOLE) -> DataFrame:
    """(id, n_words, n_foreign, n_shared, n_english, n_unknown, is_foreign) of texts (id, text); ids are unique.

    english and foreign are vocabularies; apostrophe is the foreign language's. A word native to the foreign language counts
    as foreign where English lacks it, or knows it only as a part of borrowed phrases of which none runs here; as shared
    otherwise. A phrase that runs counts once and takes its words. Words with an apostrophe that English has not borrowed
    count as two, piece by piece. A text is foreign if it has foreign words and three times as many as English ones, less or
    equal, or as many shared ones; not if it has at most four words with at most one that isn't English.

    Texts in which no phrase runs are counted by sums; one text's words are one row only where a phrase does run. Null and
    empty texts have no words and are not foreign."""
    return language_votes(texts, english, {"": (foreign, apostrophe)}).drop("language")
