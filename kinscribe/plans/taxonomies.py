"""Queries of taxonomies: items stand below their names and brands, names below their first and last word, last words below
kinds; a term's uses are the quantities sold of its items. Terms bear a letter of what they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import taxonomy as T
from ..operators.graph import checkpointed
from .queries import query, t

_TAG = lambda tag, c: F.concat(F.lit(tag + ":"), c)


def offered(s, d) -> DataFrame:
    """(parent, child, place) of the items' edges, at the place of the first item that has them."""
    i = t(s, d, "items").select(F.col("item_id").alias("place"), _TAG("item", F.col("item_id").cast("string")).alias("item"), _TAG("name", F.col("name")).alias("name"), _TAG("brand", F.col("brand")).alias("brand"), _TAG("kind", F.col("kind")).alias("kind"), _TAG("first", F.regexp_extract("name", "^[^ ]+", 0)).alias("head"), _TAG("last", F.regexp_extract("name", "[^ ]+$", 0)).alias("tail"))
    pair = lambda a, b: F.struct(F.col(a).alias("parent"), F.col(b).alias("child"))
    e = i.select("place", F.inline(F.array(pair("kind", "tail"), pair("head", "name"), pair("tail", "name"), pair("name", "item"), pair("brand", "item"))))
    return e.where("parent is not null and child is not null").groupBy("parent", "child").agg(F.min("place").alias("place"))


def sold(s, d) -> DataFrame:
    return t(s, d, "sale_lines").groupBy(_TAG("item", F.col("item_id").cast("string")).alias("term")).agg(F.sum("quantity").alias("n"))


_COUNTED = """
i as (select item_id, 'item:' || item_id as item, 'name:' || name as name, 'brand:' || brand as brand, 'kind:' || kind as kind, 'first:' || regexp_extract(name, '^[^ ]+') as head, 'last:' || regexp_extract(name, '[^ ]+$') as tail from items),
n as (select item, name, brand, head, tail, n::double as n, case when brand is null or name is null then 1 else 0.5 end as share from i left join (select item_id, sum(quantity) as n from sale_lines group by 1) using (item_id) where coalesce(name, brand) is not null),
kinds as (select distinct tail, kind from i where tail is not null and kind is not null),
up as (select item as term, n, item, 0 as steps from n union all select brand, n, item, 1 from n where brand is not null union all select name, n * share, item, 1 from n where name is not null
  union all select head, n * share ** 2, item, 2 from n where name is not null union all select tail, n * share ** 2, item, 2 from n where name is not null
  union all select kinds.kind, n * share ** 3, item, 3 from n join kinds using (tail) union all select '', n, item, 9 from n),
freqs as (select term, sum(n) as freq from up group by 1 having sum(n) is not null)"""


@query(f"with {_COUNTED} select term, round(freq, 4) as freq, round(case when freq > 0 then ln((select freq from freqs where term = '')) - ln(freq) else -1 end, 4) as ic from freqs")
def taxonomy_contents(s, d):
    """Counts that pass up with attenuation, and the information content of every term."""
    up = T.inheritance(T.admitted(offered(s, d)))
    c = T.contents(T.attenuated_counts(sold(s, d).where("n is not null"), up))
    return c.select("term", F.round("freq", 4).alias("freq"), F.round("ic", 4).alias("ic"))


_TOKENS = f"""with {_COUNTED},
w as (select head as term, name, substr(head, 7) as token from n where name is not null union select tail, name, substr(tail, 6) from n where name is not null),
p as (select distinct token, term from w union select 'size' || size, 'item:' || item_id from items where coalesce(name, brand) is not null and size is not null),
many as (select token, count(*) as n from (select token, 'name:' || name as term from w union select 'size' || size, 'item:' || item_id from items where coalesce(name, brand) is not null and size is not null union select token, term from w) group by 1)
select token, round(coalesce(-sum(x * log2(x)), 0) + 0, 6) as entropy, any_value(many.n) as n_terms, count(x) as n_top
from (select token, case when freq > 0 then freq / (select freq from freqs where term = '') end as x from p left join freqs using (term)) join many using (token) group by token"""


def tokens(s, d) -> DataFrame:
    """(token, term): the words of names, first and last words, and the sizes of items."""
    i = t(s, d, "items")
    head, tail = F.regexp_extract("name", "^[^ ]+", 0), F.regexp_extract("name", "[^ ]+$", 0)
    pair = lambda token, term: F.struct(token.alias("token"), term.alias("term"))
    p = i.select(F.inline(F.array(pair(head, _TAG("first", head)), pair(head, _TAG("name", F.col("name"))), pair(tail, _TAG("last", tail)), pair(tail, _TAG("name", F.col("name"))), pair(F.concat(F.lit("size"), F.col("size").cast("string")), _TAG("item", F.col("item_id").cast("string"))))))
    return p.where("token is not null and term is not null").distinct()


@query(_TOKENS)
def token_entropies(s, d):
    """How widely the sales of what bears a word or a size are spread over the taxonomy's topmost terms with it."""
    up = checkpointed(T.inheritance(T.admitted(offered(s, d))))
    freqs = checkpointed(T.attenuated_counts(sold(s, d).where("n is not null"), up))
    return T.token_entropies(tokens(s, d), up, freqs).withColumn("entropy", F.round("entropy", 6))


#: A child with this share of what all children of its term have makes the term suspect.
SUSPECT_SHARE, SUSPECT_LEAST = 0.2, 100


@query(f"""with {_COUNTED},
e as (select distinct unnest([kind, head, tail, name, brand]) as parent, unnest([tail, name, name, item, item]) as child from (select item, name, brand, kind, head, tail from i)),
m as (select parent, count(*) as n, sum(freq) as of_children, max(freq) as of_child, min(child) filter (where freq = best) as child from (select *, max(freq) over (partition by parent) as best from e left join freqs on term = child where parent is not null and child is not null) group by 1)
select term, round(freq, 4) as freq, round(of_children, 4) as of_children, child, round(of_child, 4) as of_child from m join freqs on term = parent where n > 1 and freq >= {SUSPECT_LEAST} and of_children * {SUSPECT_SHARE} <= of_child""")
def dominated_terms(s, d):
    edges = T.admitted(offered(s, d))
    c = T.dominated(T.attenuated_counts(sold(s, d).where("n is not null"), T.inheritance(edges)), edges, SUSPECT_SHARE, SUSPECT_LEAST)
    return c.select("term", F.round("freq", 4).alias("freq"), F.round("of_children", 4).alias("of_children"), "child", F.round("of_child", 4).alias("of_child"))
