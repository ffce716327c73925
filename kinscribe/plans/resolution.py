"""Queries of entity resolution proper: order votes, merging in order, likelihood ratios and expansion of maps.

Focus names are customers, papers their orders, partners the suppliers of an order; outcomes are kinds of clicks in a
client's months, each judged against the month before."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import agglomeration as A
from ..operators import alignment as X
from ..operators import likelihood as L
from ..operators import merging as M
from ..operators import name_order as O
from ..operators.graph import stored
from .queries import query, t

JACCARD = 0.2

_STAGE_ONE = f"""
with recursive papers as (select o_custkey as focus, o_orderkey as pub, coalesce(list(distinct l_suppkey) filter (where l_suppkey is not null), []) as names from orders left join lineitem on l_orderkey = o_orderkey group by all),
walk(focus, c, m, n, i) as (
  select focus, list(names order by pub), list([pub] order by pub), count(*), 1::bigint from papers group by focus
  union all select focus,
    case when j is null then c else list_transform(range(1, n + 1), lambda k: case when k = i then list_distinct(list_concat(c[i], c[j])) when k = j then [] else c[k] end) end,
    case when j is null then m else list_transform(range(1, n + 1), lambda k: case when k = i then list_concat(m[i], m[j]) when k = j then [] else m[k] end) end,
    n, case when j is null then i + 1 else i end
  from (select *, list_filter(range(1, n + 1), lambda j: j != i and len(list_intersect(c[i], c[j])) >= greatest(1, {JACCARD} * len(list_distinct(list_concat(c[i], c[j])))))[1] as j from walk where i <= n)),
ended as (select focus, unnest(m) as members from walk where i > n)
select focus, unnest(members) as pub, members[1] as cluster from ended where len(members) > 0"""


def papers(s, d):
    lines = t(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_suppkey").cast("string")).alias("partners"))
    return t(s, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_custkey").cast("string").alias("focus"), F.col("o_orderkey").alias("pub"), "partners")


@query(_STAGE_ONE)
def stage_one_clusters(s, d, p=None):
    return M.merge_in_order(papers(s, d) if p is None else p, M.JaccardRule(JACCARD)).select(F.col("focus").cast("long").alias("focus"), "pub", "cluster")


@query(None)
def evidence_clusters(s, d):
    """Merging by evidence: a supplier's ambiguity is its number of customers, a name's partners are counted over all orders."""
    p = papers(s, d)
    # customers and suppliers are numbered alike
    named = stored(p.select(F.concat(F.lit("c"), "focus").alias("focus"), "pub", F.transform("partners", lambda x: F.concat(F.lit("s"), x)).alias("partners")))
    pairs = stored(named.select("focus", F.explode("partners").alias("partner")).distinct())
    of = lambda a, b, part: pairs.groupBy(F.col(a).alias("name")).agg((F.count(b) / part).alias("n"))
    counts = of("focus", "partner", 1).unionByName(of("partner", "focus", 1))
    ambiguities = of("partner", "focus", 20).unionByName(of("focus", "partner", 10))
    return M.merge_in_order(named, M.EvidenceRule(tolerance=0.001), lambda met: M.partner_evidence(met, counts, ambiguities))


@query(None)
def seeded_clusters(s, d):
    """Orders of the first priority seed their customer's groups, one for each supplier of the most orders among them."""
    p = papers(s, d)
    urgent = t(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("pub"))
    seeds = p.join(urgent, "pub").select("focus", "pub", F.array_min(F.transform("partners", lambda x: x.cast("long"))).alias("seed")).where("seed is not null")
    return M.merge_into_seeds(p, seeds)


GIVEN, FAMILY = "el sa ma jo da ke an ol mé vi ri lu to ni".split(), "ber ley ez ko vic ni ham lo ström son tan gu or dal ren ma".split()
PAIRED, OTHER = ["elsa", "joda"], ["anma", "luni", "keda"]


def _names(extract, word):
    """SQL of a two-part name by the way a source writes it: g and f are syllables of the given and the family name."""
    g, f = (f"{extract}(lower(name), '{rule}', 1)" for rule in (f"^((?:{'|'.join(GIVEN)})(?:{'|'.join(GIVEN)})?)", f" ({'|'.join(FAMILY)})"))
    one = f"{extract}({g}, '^({'|'.join(GIVEN)})', 1)"
    rest = f"substr({g}, length({one}) + 1)"
    return f"case source when 'crm' then concat({g}, ' ', {f}) when 'web' then concat({f}, ' ', {one}, case when {rest} != '' then '-' else '' end, {rest}) when 'store' then concat({one}, ' ', {f}) else concat({f}, ' ', {one}) end {word}"


def _values(words):
    return "(values " + ", ".join(f"('{w}')" for w in words) + ")"


_COUNTED = "select p, min(n) as n from (select p, 1 as n from parts join {0} on p = s union all select p, 2 from (select p, unnest(range(1, len(p))) as i from parts) join {0} a on a.s = p[1:i] join {0} b on b.s = p[i + 1:]) group by p"
_VOTES = f"""
with syl(s) as {_values(sorted({*GIVEN, *FAMILY}))}, oth(s) as {_values(OTHER)},
named as (select city as key, source, {_names('regexp_extract', 'as name')} from clients),
seen as (select distinct name, string_split(name, ' ') as w from named where name is not null and len(string_split(name, ' ')) = 2),
split as (select name, regexp_replace(w[1], '^([^-]*)-', '\\1') as a, regexp_replace(w[2], '^([^-]*)-', '\\1') as b, contains(w[1], '-') as ha, contains(w[2], '-') as hb from seen),
parts as (select a as p from split union select b from split),
own as ({_COUNTED.format('syl')}), other as ({_COUNTED.format('oth')}),
known as (select split.*, oa.n as na, ob.n as nb, xa.n as ca, xb.n as cb, a in {tuple(PAIRED)} as pa, b in {tuple(PAIRED)} as pb
  from split join own oa on oa.p = a join own ob on ob.p = b left join other xa on xa.p = a left join other xb on xb.p = b
  where if(a in {tuple(PAIRED)}, 1, oa.n) + if(b in {tuple(PAIRED)}, 1, ob.n) between 2 and 3),
crm as (select string_split(name, ' ') as w from named where source = 'crm' and name is not null),
fam as (select w[2] as p, ln(count(*) / sum(count(*)) over ()) as log from crm where w[2] != '' group by 1),
giv as (select w[1] as p, ln(count(*) / sum(count(*)) over ()) as log from crm where w[1] != '' group by 1),
logged as (select k.*, fa.log as fa, fb.log as fb, ga.log as ga, gb.log as gb, na = 1 and nb = 1 as short from known k left join fam fa on fa.p = a left join fam fb on fb.p = b left join giv ga on ga.p = a left join giv gb on gb.p = b),
votes as (select name, (hb and not ha) or (nb = 2 and not pb and coalesce(cb, 0) != 1) or (short and (fb is null or ga is null)) as r,
  (ha and not hb) or (na = 2 and not pa and coalesce(ca, 0) != 1) or (short and (fa is null or gb is null)) as f,
  if(short and fa is not null and fb is not null and ga is not null and gb is not null, fb + ga, 0.0) as forward, if(short and fa is not null and fb is not null and ga is not null and gb is not null, fa + gb, 0.0) as back from logged),
summed as (select key, count(r) as n_known, coalesce(bool_or(r), false) as reversed_sure, coalesce(bool_or(f), false) as forward_sure, coalesce(sum(forward), 0) as x, coalesce(sum(back), 0) as y from named left join votes using (name) group by key)
select key as city, n_known, reversed_sure, forward_sure, round(x, 4) as forward_log, round(y, 4) as reverse_log,
  case when reversed_sure and forward_sure then -1 when reversed_sure then 1 when forward_sure then 0 when round(x - y, 6) < 0 then 1 else 0 end as verdict from summed"""


@query(_VOTES)
def name_order_votes(s, d):
    named = t(s, d, "clients").selectExpr("city", "source", _names("regexp_extract", "as name"))
    word = F.split("name", " ")
    crm = named.where("source = 'crm' and name is not null")
    words = lambda of: s.createDataFrame([(w,) for w in of], "word string")

    def logs(part):
        n = crm.select(part.alias("part")).where("part != ''").groupBy("part").count()
        return n.crossJoin(F.broadcast(n.agg(F.sum("count").alias("all")))).select("part", F.log(F.col("count") / F.col("all")))

    v = O.order_votes(named, "city", "name", words(sorted({*GIVEN, *FAMILY})), words(OTHER), PAIRED, logs(word[1]), logs(word[0]))
    return v.select(F.col("key").alias("city"), "n_known", "reversed_sure", "forward_sure", F.round("forward_log", 4).alias("forward_log"), F.round("reverse_log", 4).alias("reverse_log"), "verdict")


def month_pairs(s, d):
    """(client_id, month, before, now): maps of counts of a client's month and of its month before, unknown kinds as UNKNOWN."""
    c = t(s, d, "clicks").where("client_id is not null and ts is not null").groupBy("client_id", F.date_format("ts", "yyyy-MM").alias("month"), F.coalesce("kind", F.lit("UNKNOWN")).alias("kind")).count()
    m = c.groupBy("client_id", "month").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "count")))).alias("now"))
    return m.withColumn("before", F.lag("now").over(Window.partitionBy("client_id").orderBy("month"))).where("before is not null")


_MONTHS = """c as (select client_id, strftime(ts, '%Y-%m') as month, coalesce(kind, 'UNKNOWN') as k, count(*)::double as n from clicks where client_id is not null and ts is not null group by all),
lagged as (select client_id, month, lag(month) over (partition by client_id order by month) as earlier, sum(n) as s, count(*) as z from c group by client_id, month),
pairs as (select l.client_id, l.month, l.earlier, if(e.s < l.s or (e.s = l.s and e.z < l.z), l.month, l.earlier) as bm, if(e.s < l.s or (e.s = l.s and e.z < l.z), l.earlier, l.month) as sm from lagged l join lagged e on e.client_id = l.client_id and e.month = l.earlier)"""

_RATIO = f"""
with {_MONTHS},
base as (select p.client_id, p.month, k, if(k = 'UNKNOWN', n, least(n, 4)) as n from pairs p join c on c.client_id = p.client_id and c.month = p.bm),
sample as (select p.client_id, p.month, k, n from pairs p join c on c.client_id = p.client_id and c.month = p.sm),
facts as (select s.client_id, s.month, sum(s.n) as drawn, coalesce(sum(s.n) filter (where s.k != 'UNKNOWN' and b.k is null), 0) as pool, coalesce(sum(s.n) filter (where s.k = 'UNKNOWN'), 0) as u
  from sample s left join base b on b.client_id = s.client_id and b.month = s.month and b.k = s.k group by all),
about as (select f.*, b.n as bu, pool - least(floor(drawn * 0.3334), pool) as pooled, u > 0 and b.n is null and pool > 0 as shared from facts f left join base b on b.client_id = f.client_id and b.month = f.month and b.k = 'UNKNOWN'),
entries as (select b.client_id, b.month, b.n + 0.5 as w, coalesce(s.n, 0) as d from base b left join sample s on s.client_id = b.client_id and s.month = b.month and s.k = b.k where b.k != 'UNKNOWN'
  union all select client_id, month, case when shared then 0.25 when u > 0 then coalesce(bu, 0) + 0.5 else bu end, u from about where u > 0 or bu is not null
  union all select client_id, month, if(shared, 0.25, 0.5), pooled from about),
totals as (select client_id, month, sum(w) as total, sum(d) as n, count(*) as m from entries group by all)
select client_id, month, round(sum(if(d > 0, d * ln(w / total), 0) - lgamma(d + 1)) + any_value(if(n > 0, lgamma(m + n) - lgamma(m), 0)), 6) + 0.0 as log_ratio from entries join totals using (client_id, month) group by all"""


@query(_RATIO)
def categorical_ratio(s, d):
    return L.categorical_ratios(month_pairs(s, d), "before", "now").select("client_id", "month", (F.round("log_ratio", 6) + 0.0).alias("log_ratio"))


_SIMILAR = """uses as (select distinct client_id, kind as k from clicks where kind is not null and client_id is not null),
users as (select k, count(*) as n from uses group by k),
alike as (select x.k as a, y.k as b, round(count(*) / any_value(users.n), 6) as similarity from uses x join uses y on x.client_id = y.client_id and x.k != y.k join users on users.k = x.k group by x.k, y.k)"""


def similar_kinds(s, d):
    """(a, b, similarity): the share of a kind's clients who have the other kind as well; kinds are few, clients' lists are short."""
    uses = t(s, d, "clicks").where("kind is not null and client_id is not null").select("client_id", F.col("kind").alias("k")).distinct()
    both = uses.withColumnRenamed("k", "a").join(uses.withColumnRenamed("k", "b"), "client_id").where("a != b").groupBy("a", "b").count()
    return both.join(uses.groupBy(F.col("k").alias("a")).agg(F.count("*").alias("n")), "a").select("a", "b", F.round(F.col("count") / F.col("n"), 6).alias("similarity"))


_EXPANDED = f"""
with {_MONTHS}, {_SIMILAR},
own as (select p.client_id, p.month, k, n from pairs p join c on c.client_id = p.client_id and c.month = p.earlier),
theirs as (select p.client_id, p.month, k, n from pairs p join c on c.client_id = p.client_id and c.month = p.month),
found as (select o.client_id, o.month, t.k, least(max(o.n * similarity * {L.DISCOUNT}), {L.MOST}) as n, any_value(t.n) as theirs from own o join alike on a = o.k join theirs t on t.client_id = o.client_id and t.month = o.month and t.k = b
  where similarity >= {L.SAMPLE_LEAST} and not exists (select 1 from own x where x.client_id = o.client_id and x.month = o.month and x.k = b) group by all),
sums as (select client_id, month, {L.BUDGET} * sum(n) as budget, sum(n) as s from own group by all),
ranked as (select *, coalesce(sum(n) over (partition by client_id, month order by theirs desc, k rows between unbounded preceding and 1 preceding), 0) as before from found),
taken as (select client_id, month, k, least(n, budget - before) as n from ranked join sums using (client_id, month) where before < budget)
select client_id, month, any_value(s) as own, count(taken.k) as n_new, round(coalesce(sum(taken.n), 0), 4) as added, coalesce(string_agg(taken.k, ',' order by taken.k), '') as kinds from sums left join taken using (client_id, month) group by client_id, month"""


@query(_EXPANDED)
def expanded_maps(s, d):
    p = month_pairs(s, d).withColumns({c: F.col(c).cast("map<string,double>") for c in ("before", "now")})
    e = L.expanded(p.withColumn("had", F.map_keys("before")), ["client_id", "month"], "before", "now", similar_kinds(s, d), L.SAMPLE_LEAST)
    new = F.map_filter("before", lambda k, v: ~F.array_contains("had", k))
    return e.select("client_id", "month", F.round(L.total(F.col("before")) - L.total(new), 4).alias("own"), F.size(new).cast("long").alias("n_new"), F.round(L.total(new), 4).alias("added"), F.array_join(F.array_sort(F.map_keys(new)), ",").alias("kinds"))


@query(None)
def stage_two_clusters(s, d):
    """Stage one's clusters of a customer's orders, joined by the words of their parts' names, priorities and years."""
    parts = t(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.split("p_name", " ").alias("words"))
    words = t(s, d, "lineitem").select("l_orderkey", "l_partkey").join(parts, "l_partkey").select(F.col("l_orderkey").alias("pub"), F.explode("words").alias("term")).distinct()
    words = stored(words)
    terms = words.groupBy("pub").agg(F.collect_list("term").alias("terms"))
    spread = words.groupBy("term").count()
    weights = spread.crossJoin(F.broadcast(t(s, d, "orders").agg(F.count("*").alias("all")))).select("term", F.log(F.col("all") / F.col("count")).alias("weight"))
    about = t(s, d, "orders").select(F.col("o_orderkey").alias("pub"), F.col("o_orderpriority").alias("venue"), F.year("o_orderdate").alias("year"))
    own = stored(papers(s, d))
    one = stage_one_clusters(s, d, own).withColumn("focus", F.col("focus").cast("string"))
    p = own.join(one, ["focus", "pub"]).join(about, "pub").join(terms, "pub", "left")
    return A.agglomerate_papers(stored(p), weights, A.Joining(threshold=2.0, venue_threshold=0.5))


_ALIGNED = """
with a as (select item_id, quantity, sale_id as kept_sale, shipped_at as kept_at, row_number() over (partition by item_id, quantity order by shipped_at nulls first, sale_id nulls first) as ordinal from sale_lines where flag = 'kept'),
b as (select item_id, quantity, sale_id as returned_sale, shipped_at as returned_at, row_number() over (partition by item_id, quantity order by shipped_at nulls first, sale_id nulls first) as ordinal from sale_lines where flag = 'returned')
select case when a.ordinal is not null then a.item_id else b.item_id end as item_id, case when a.ordinal is not null then a.quantity else b.quantity end as quantity, coalesce(a.ordinal, b.ordinal) as ordinal,
  kept_sale, returned_sale, epoch(kept_at)::bigint as kept_at, epoch(returned_at)::bigint as returned_at, case when a.ordinal is null then 'right' when b.ordinal is null then 'left' else 'both' end as side
from a full join b on a.item_id is not distinct from b.item_id and a.quantity is not distinct from b.quantity and a.ordinal = b.ordinal"""


@query(_ALIGNED)
def aligned_returns(s, d):
    """Returned lines against kept ones of the same item and quantity, the first with the first; what has no partner stays."""
    side = lambda flag: t(s, d, "sale_lines").where(F.col("flag") == flag).select("item_id", "quantity", F.col("sale_id").alias(f"{flag}_sale"), F.col("shipped_at").cast("timestamp").cast("long").alias(f"{flag}_at"))
    return X.align(side("kept"), side("returned"), ["item_id", "quantity"], ["kept_at", "kept_sale"], ["returned_at", "returned_sale"])
