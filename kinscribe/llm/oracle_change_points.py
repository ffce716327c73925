"""DuckDB SQL of op11: the same dynamic programme, one day of every vendor a round."""

from .change_points import LEAST, PENALTY


def cost(s: str, t: str) -> str:
    """Of the days from s to before t, over the running sums ps and pq (lists from 0)."""
    n, a, q = f"({t} - {s})", f"(ps[{t} + 1] - ps[{s} + 1])", f"(pq[{t} + 1] - pq[{s} + 1])"
    return f"({n} * floor(1000 * ln({spread(n, a, q)}::double))::bigint)"


def spread(n: str, a: str, q: str) -> str:
    return f"(1 + ({n} * {q} - {a} * {a}) // ({n} * {n}))"


_BEST = f"list_min(list_transform(list_filter(range(0, t - {LEAST} + 2), lambda s: s = 0 or s >= {LEAST}), lambda s: {{'c': f[s + 1].c + {cost('s', '(t + 1)')} + if(s > 0, {PENALTY}, 0), 'k': f[s + 1].k + 1, 's': s}}))"

OP11 = f"""
with recursive d as (select vendor_id, datediff('day', date '1970-01-01', shipped_at::date)::bigint as day, sum(quantity)::hugeint as x from sale_lines
  where flag in ('kept', 'swapped') and quantity is not null and shipped_at is not null group by all),
span as (select vendor_id, min(day) as lo, max(day) as hi from d group by all),
grid as (select vendor_id, lo, unnest(range(lo, hi + 1)) as day from span),
filled as (select g.vendor_id, g.lo, g.day, coalesce(x, 0)::hugeint as x from grid g left join d on g.vendor_id is not distinct from d.vendor_id and g.day = d.day),
running as (select vendor_id, lo, day, sum(x) over w as s, sum(x * x) over w as q from filled window w as (partition by vendor_id order by day)),
series as (select vendor_id, lo, count(*)::bigint as n, list_prepend(0::hugeint, list(s::hugeint order by day)) as ps, list_prepend(0::hugeint, list(q::hugeint order by day)) as pq from running group by all),
steps(vendor_id, lo, n, ps, pq, t, f) as (
  select vendor_id, lo, n, ps, pq, 0::bigint, [{{'c': 0::bigint, 'k': 0::bigint, 's': 0::bigint}}] from series
  union all select vendor_id, lo, n, ps, pq, t + 1, list_append(f, case when t + 1 >= {LEAST} then {_BEST} when t + 1 = n then {{'c': {cost('0', '(t + 1)')}, 'k': 1::bigint, 's': 0::bigint}} end) from steps where t < n),
back(vendor_id, lo, n, ps, pq, f, b, a) as (
  select vendor_id, lo, n, ps, pq, f, n, f[n + 1].s from steps where t = n
  union all select vendor_id, lo, n, ps, pq, f, a, f[a + 1].s from back where a > 0)
select vendor_id, f[b + 1].k::int as segment_no, lo + a as first_day, b - a as n_days, (ps[b + 1] - ps[a + 1])::bigint as total,
  {spread('(b - a)', '(ps[b + 1] - ps[a + 1])', '(pq[b + 1] - pq[a + 1])')}::bigint as spread, {cost('a', 'b')}::bigint as cost, f[n + 1].k::bigint as n_segments, f[n + 1].c::bigint as best_cost from back"""
