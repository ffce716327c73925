"""DuckDB SQL of the training-data queries that SQL can say on whole tables (2, 3, 5, 10 and 11).

The others have none: 1 needs a row for each byte, 4 and 6 token ids, 7 hundreds of patterns
with intervals, 8 a trained model, and 9 finds pairs by MinHash; they are tested against brute
force, exact round trips or held-out accuracy."""

from __future__ import annotations

from .oracle_change_points import OP11
from .quality_rules import LINE_CHAR_LIMIT, LINE_LIMIT, MIN_WORDS, NGRAM_LIMITS, REPEAT_PERCENT
from .url_filters import LOWER, RULES, UPPER

SPACED, PLAIN = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"


_LIMITS = " and ".join(f"coalesce(chars[{n}], 0) <= {most}::double * word_chars" for n, most in NGRAM_LIMITS.items())

OP2 = f"""
with d as (select doc_id, coalesce(text, '') as body, regexp_extract_all(coalesce(text, ''), '{SPACED}') as w from documents),
l as (select doc_id, line from (select doc_id, unnest(string_split(body, chr(10))) as line from d) where regexp_matches(line, '{SPACED}')),
per_line as (select doc_id, line, count(*) as n from l group by all),
lines as (select doc_id, sum(n) as n_lines, sum(n - 1) as again, sum((n - 1) * length(line)) as chars from per_line group by doc_id),
sizes as (select unnest([{", ".join(map(str, NGRAM_LIMITS))}]) as n),
grams as (select doc_id, n, unnest(range(1, len(w) - n + 2)) as i, w from d, sizes where len(w) >= n),
keyed as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as gram from grams),
twice as (select doc_id, n, unnest(list(i)) as i from keyed group by doc_id, n, gram having count(*) > 1),
covered as (select distinct doc_id, n, unnest(range(i, i + n)) as p from twice),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
sums as (select doc_id, n, count(*) as words, sum(length(word)) as chars from covered join words using (doc_id, p) group by doc_id, n),
found as (select doc_id, map(list(n), list(chars)) as chars, max(words) filter (where n = 5) as n_repeat_words from sums group by doc_id),
m as (select doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as word_chars, len(regexp_extract_all(body, '[#*$%&|<>]')) as n_symbols,
  coalesce(again, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines, coalesce(lines.chars, 0) as line_chars, found.chars as chars
  from d left join lines using (doc_id) left join found using (doc_id)),
b as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words as base_failed from m)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
  not base_failed and line_chars <= {LINE_CHAR_LIMIT}::double * word_chars and n_dup_lines <= {LINE_LIMIT}::double * n_lines and {_LIMITS} as kept from b"""


def _fitting(host: str, path: str) -> str:
    """A list of (size, allow, rule) of the rules that fit."""
    fits = []
    for rule, verdict in RULES:
        name, slash, rest = rule.partition("/")
        fits.append(f"case when ({host} = '{name}' or ends_with({host}, '.{name}')) and starts_with({path}, '{slash + rest}') then (1000 * {len(rule)} + {int(verdict == 'allow')}, '{rule}') end")
    return f"list_max(list_filter([{', '.join(fits)}], lambda x: x is not null))"


_HOST = rf"{lowered(r'regexp_extract({0}, $$(?s)^.*?://([^/?#]*)$$, 1)')}"
_PATH = r"coalesce(regexp_extract({0}, $$(?s)^.*?://[^/?#]*([^?#]*)$$, 1), '')"
_NODE = _HOST + r" || regexp_extract({0}, $$(?s)^.*?://[^/?#]*([^#]*)$$, 1)"

OP3 = f"""
with recursive tags as (select url, unnest(regexp_extract_all(html, $$(?is)<(?:link|meta)\\b[^>]*>$$)) as tag from pages where contains(url, '://')),
targets as (select url, regexp_extract(tag, $$(?is)\\bhref\\s*=\\s*["']?([^"'\\s>]+)$$, 1) as t from tags where regexp_matches(tag, $$(?is)^<link\\b[^>]*\\brel\\s*=\\s*["']?canonical\\b$$)
  union all select url, regexp_extract(tag, $$(?is)\\burl\\s*=\\s*["']?([^"'\\s>]+)$$, 1) from tags where regexp_matches(tag, $$(?is)^<meta\\b[^>]*http-equiv\\s*=\\s*["']?refresh\\b$$)),
links as (select url, case when starts_with(t, '//') then regexp_extract(url, $$(?s)^(.*?:)//$$, 1) || t when starts_with(t, '/') then regexp_extract(url, $$(?s)^(.*?://[^/?#]*)$$, 1) || t else replace(t, '&amp;', '&') end as target from targets where t != ''),
edges as (select {_NODE.format('url')} as a, {_NODE.format('target')} as b from links where contains(target, '://')),
two_way as (select a, b from edges where a != '' and b != '' union select b, a from edges where a != '' and b != ''),
reach(a, b) as (select a, a from two_way union select r.a, e.b from reach r join two_way e on e.a = r.b),
parts as (select b as node, min(a) as part from reach group by b),
split as (select node, part, {_HOST.format("'://' || node")} as host, {_PATH.format("'://' || node")} as path from parts),
judged as (select node, part, {_fitting('host', 'path')} as r from split),
bad as (select part from judged group by part having max(r[1] % 10) = 0),
aliases as (select node from judged where part in (select part from bad)),
own as (select page_id, {_HOST.format('url')} as host, {_PATH.format('url')} as path, coalesce({_NODE.format('url')}, '') as node from pages),
ruled as (select *, {_fitting('host', 'path')} as r from own)
select page_id, host, path, r[2] as rule, case when r is not null then case when r[1] % 10 = 1 then 'allow' else 'block' end when node in (select node from aliases) then 'block' else 'allow' end as verdict from ruled"""

OP5 = f"""
with d as (select doc_id, regexp_extract_all({lowered('text')}, '{PLAIN}') as w from documents),
i as (select item_id, regexp_extract_all({lowered('text')}, '{PLAIN}') as w from benchmark),
windows as (select distinct item_id, least(len(w), 10) as size, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') as gram from (select item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as p from i where len(w) > 0)),
sizes as (select distinct size from windows),
grams as (select doc_id, size, p, array_to_string(w[p : p + size - 1], ' ') as gram from (select doc_id, size, w, unnest(range(1, len(w) - size + 2)) as p from d, sizes where len(w) >= size)),
hits as (select doc_id, p, g.size, item_id from grams g join windows v on g.gram = v.gram and g.size = v.size),
places as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + size)) as q from (select distinct doc_id, p, size from hits)) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct doc_id, item_id::varchar as item_id from hits) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from d left join places using (doc_id) left join named using (doc_id)"""

OP10 = f"""
with recursive d as (select doc_id, regexp_extract_all({lowered('text')}, '{SPACED}') as w from documents),
sets as (select distinct doc_id, array_to_string(w[p : p + 3], ' ') as shingle from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as p from d where len(w) > 0)),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
shared as (select x.doc_id as a, y.doc_id as b, count(*) as m from sets x join sets y on x.shingle = y.shingle and x.doc_id != y.doc_id group by all),
links as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * m >= 85 * (x.n + y.n - m)),
reach(a, b) as (select a, a from links union select r.a, l.b from reach r join links l on l.a = r.b),
parts as (select b as doc_id, min(a) as component_id from reach group by b)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(component_id, d.doc_id) as component_id from d left join sizes using (doc_id) left join parts using (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": OP2, "op3_url_filters": OP3, "op5_decontamination": OP5, "op10_ngram_join": OP10, "op11_change_points": OP11}
