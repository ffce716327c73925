"""The language vote over whole texts, with vocabularies from the texts whose language is given."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import language as V
from ..operators.graph import checkpointed
from .queries import query, t

#: A word belongs to a language that has it in this many documents.
LEAST = 3
FOREIGN = ["de", "fr"]

_VOTE = f"""
with w as (select doc_id, lang, len(list_filter(r, lambda x: not regexp_matches(x, '[0-9]'))) as n_runs, unnest(list_filter(r, lambda x: not regexp_matches(x, '[0-9]'))) as raw from (select doc_id, lang, regexp_extract_all(text, $$[a-zA-Z0-9']+$$) as r from documents)),
d as (select doc_id, lang, case when not regexp_matches(raw, '[a-z]') and regexp_matches(raw, '[A-Z]{{2}}') then raw when regexp_matches(raw, '^[A-Z]([^A-Z]|$)') then lower(raw[1]) || raw[2:] else raw end as word from w where not contains(raw, $$'$$)),
v as (select lang, word from d group by all having count(distinct doc_id) >= {LEAST}),
k as (select doc_id, other, f.word is not null as f, e.word is not null as e from d cross join (select unnest({FOREIGN}) as other) left join v f on f.lang = other and f.word = d.word left join v e on e.lang = 'en' and e.word = d.word),
n as (select doc_id, other, count(*) as n_words, count(*) filter (where f and not e) as n_foreign, count(*) filter (where f and e) as n_shared, count(*) filter (where e and not f) as n_english, count(*) filter (where not e and not f) as n_unknown from k group by all)
select doc_id, other, coalesce(n_words, 0) as n_words, coalesce(n_foreign, 0) as n_foreign, coalesce(n_shared, 0) as n_shared, coalesce(n_english, 0) as n_english, coalesce(n_unknown, 0) as n_unknown,
  coalesce(not (n_words <= 4 and n_english >= n_words - 1) and n_foreign > 0 and (n_foreign * 3 >= n_english or n_shared >= n_english), false) as is_foreign
from (select doc_id, unnest({FOREIGN}) as other from documents) left join n using (doc_id, other)"""


def spoken(s, d) -> DataFrame:
    """(lang, word): words without apostrophe of at least LEAST documents of a language."""
    runs = F.array_distinct(F.regexp_extract_all("text", F.lit("(?<![a-zA-Z0-9'])[a-zA-Z]++(?![0-9'])"), F.lit(0)))
    w = V.spread(t(s, d, "documents").select("doc_id", "lang", "text")).select("doc_id", "lang", F.explode(runs).alias("word")).select("doc_id", "lang", V.decapitalised(F.col("word")).alias("word"))
    return w.groupBy("lang", "word").agg(F.count_distinct("doc_id").alias("n")).where(F.col("n") >= LEAST).select("lang", "word")


@query(_VOTE)
def language_votes(s, d):
    words = checkpointed(spoken(s, d))
    of = lambda lang: V.vocabulary(words.where(F.col("lang") == lang).select(F.col("word").alias("line"), F.lit(True).alias("native")))
    votes = V.language_votes(t(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), of("en"), {other: (of(other), V.WHOLE) for other in FOREIGN})
    return votes.withColumnsRenamed({"id": "doc_id", "language": "other"})
