"""SQL for dense matrices: eigenvalues and vectors by Jacobi rotations, and what hangs on them.

A matrix is a row a date with its size n and its entries as one list, row after
row. All texts are fragments of one WITH RECURSIVE clause.
"""

from __future__ import annotations

from panelforge.plans import views
from panelforge.plans.block_queries import HELD

#: Sweeps over all pairs of rows; they converge quadratically from the third or so.
SWEEPS = 8


def jacobi(name: str, source: str) -> str:
    """CTEs ``name``: pos, n, m (1 the largest), value, vec of the symmetric matrices in ``source`` (pos, n, a)."""
    row, col = "(x // n)", "(x % n)"
    return f"""
{name}_j(pos, n, a, v, r) using key (pos) as (
  select pos, n, a, list_transform(range(n * n), lambda x: case when {row} = {col} then 1.0::double else 0.0::double end), 0::bigint from {source}
  union
  select pos, n,
    list_transform(range(n * n), lambda x: case when {row} = p then c * b[p * n + {col} + 1] - s * b[q * n + {col} + 1] when {row} = q then s * b[p * n + {col} + 1] + c * b[q * n + {col} + 1] else b[x + 1] end),
    list_transform(range(n * n), lambda x: case when {col} = p then c * v[{row} * n + p + 1] - s * v[{row} * n + q + 1] when {col} = q then s * v[{row} * n + p + 1] + c * v[{row} * n + q + 1] else v[x + 1] end),
    r + 1
  from (select *, list_transform(range(n * n), lambda x: case when {col} = p then c * a[{row} * n + p + 1] - s * a[{row} * n + q + 1] when {col} = q then s * a[{row} * n + p + 1] + c * a[{row} * n + q + 1] else a[x + 1] end) as b
    from (select *, 1 / sqrt(1 + t * t) as c, t / sqrt(1 + t * t) as s
      from (select *, case when abs(a[p * n + q + 1]) < 1e-300 then 0.0::double else (case when tau < 0 then -1 else 1 end) / (abs(tau) + sqrt(1 + tau * tau)) end as t
        from (select *, (a[q * n + q + 1] - a[p * n + p + 1]) / (2 * case when abs(a[p * n + q + 1]) < 1e-300 then 1e-300 else a[p * n + q + 1] end) as tau
          from (select *, e - (p * (2 * n - p - 1)) // 2 + p + 1 as q
            from (select *, r % (n * (n - 1) // 2) as e, cast(floor(n - 0.5 - sqrt((n - 0.5) * (n - 0.5) - 2 * (r % (n * (n - 1) // 2))) + 1e-9) as bigint) as p from {name}_j where r < {SWEEPS} * (n * (n - 1) // 2)))))))
),
{name} as (select pos, n, row_number() over (partition by pos order by value desc) as m, value, vec from (
  select pos, n, a[g.i * n + g.i + 1] as value, list_transform(range(n), lambda x: v[x * n + g.i + 1]) as vec from {name}_j, lateral (select unnest(range(n)) as i) g))"""


#: The windows of the shared pass: pos, permno, i (from 0), n, t, x; a security that lacks more than 5 % is out, and a date with fewer than 10.
SHARED = f"""{HELD},
win as (select s.pos, s.permno, g.t, p.ret from snap s cross join range({views.WINDOW}) g(t) left join p on p.permno = s.permno and p.pos = s.pos - {views.WINDOW - 1} + g.t),
kept as (select pos, permno, row_number() over (partition by pos order by permno) - 1 as i, count(*) over (partition by pos) as n from (select pos, permno from win group by 1, 2 having count(ret) >= 0.95 * {views.WINDOW}) qualify n >= 10),
x as (select pos, i, n, t, coalesce(ret, 0) as x from win join kept using (pos, permno))"""
#: The same of all assets with a return in the window.
ALL = f"""{views.P}, marks as (select distinct pos from p where pos >= {views.WINDOW} and (pos - {views.WINDOW}) % {views.EVERY} = 0),
kept as (select pos, permno, row_number() over (partition by pos order by permno) - 1 as i, count(*) over (partition by pos) as n from (select distinct m.pos, p.permno from marks m join p on p.pos between m.pos - {views.WINDOW - 1} and m.pos and p.ret is not null)),
x as (select k.pos, i, n, t, coalesce(p.ret, 0) as x from kept k cross join range({views.WINDOW}) g(t) left join p on p.permno = k.permno and p.pos = k.pos - {views.WINDOW - 1} + g.t)"""

SAMPLE = f"""
sc as (select a.pos, any_value(a.n) as n, a.i, b.i as k, (sum(a.x * b.x) - sum(a.x) * sum(b.x) / {views.WINDOW}) / {views.WINDOW - 1} as s from x a join x b using (pos, t) group by a.pos, a.i, b.i),
sm as (select pos, any_value(n) as n, list(s order by i, k) as a from sc group by pos)"""


def correlations(name: str, source: str) -> str:
    """CTE ``name``: pos, n, a of the correlations of ``source``."""
    return f"""
{name} as (select pos, n, list_transform(range(n * n), lambda x: case when x // n = x % n then 1.0::double else greatest(-1, least(1, a[x + 1] / sqrt(a[(x // n) * n + x // n + 1]) / sqrt(a[(x % n) * n + x % n + 1]))) end) as a from {source})"""


def rebuilt(name: str, eigen: str, value: str) -> str:
    """CTE ``name``: pos, n, a of the matrices with the vectors of ``eigen`` and ``value`` of its columns."""
    return f"""
{name}_e as (select pos, n, vec, {value} as w from {eigen}),
{name} as (select pos, n, list(s order by i, k) as a from (select pos, any_value(n) as n, i.i, k.i as k, sum(w * vec[i.i + 1] * vec[k.i + 1]) as s from {name}_e, lateral (select unnest(range(n)) as i) i, lateral (select unnest(range(n)) as i) k group by pos, i.i, k.i) group by pos, n)"""


_N, _H, _ROOT5 = views.WINDOW - 1, f"power({views.WINDOW - 1}, -1.0 / 3)", "sqrt(5.0::double)"
#: Nonlinear shrinkage of the sample covariances ``sm``, fewer securities than days: eigenvalues moved by density and Hilbert transform.
SHRUNK = f"""{jacobi("se", "sm")},
dens as (select a.pos, a.m, any_value(a.value) as lam, any_value(a.n) as n, any_value(a.vec) as vec,
    avg(0.75 / {_ROOT5} * greatest(0, 1 - u * u / 5) / ({_H} * a.by)) as f,
    avg((-0.3 * u + 0.75 / {_ROOT5} * case when abs(abs(u) - {_ROOT5}) < 1e-13 then 0 else (1 - u * u / 5) * ln(abs(({_ROOT5} - u) / ({_ROOT5} + u))) end) / (pi() * {_H} * a.by)) as h
  from (select l.pos, l.n, l.m, l.value, r.value as by, l.vec, (l.value / r.value - 1) / {_H} as u from se l join se r using (pos)) a group by a.pos, a.m),
moved as (select pos, n, m, vec, lam / (power(pi() * n / {_N} * lam * f, 2) + power(1 - n::double / {_N} - pi() * n / {_N} * lam * h, 2)) as value from dens)"""
NLS = f"{SAMPLE}, {SHRUNK}, {rebuilt('nm', 'moved', 'value')}"


def bulk(name: str, eigen: str) -> str:
    """CTE ``name``: pos, n, k, variance, vals: the fixed point of bulk variance and components kept of correlation eigenvalues."""
    return f"""
{name}_l as (select pos, any_value(n) as n, list(value order by m) as vals from {eigen} group by pos),
{name}_f(pos, n, vals, variance, k, turn) as (
  select pos, n, vals, 1.0::double, -1::bigint, 0 from {name}_l
  union all
  select pos, n, vals, list_avg(vals[above + 1:]), above, turn + 1 from (select *, least(n - 1, len(list_filter(vals, lambda y: y > variance * power(1 + sqrt(n::double / {views.WINDOW}), 2)))) as above from {name}_f) where above <> k and turn < 50
),
{name} as (select pos, n, vals, arg_max(k, turn) as kept, arg_max(variance, turn) as variance, greatest(1, arg_max(k, turn)) as k from {name}_f group by pos, n, vals)"""


#: Everything of the shared pass but its tree: eigenvalues and vectors of the correlations (ce), bulk and components (bk), covariance eigenvalues (moved).
PASS = f"with recursive {SHARED}, {NLS}, {correlations('cm', 'nm')}, {jacobi('ce', 'cm')}, {bulk('bk', 'ce')}"


def agglomerated(name: str, source: str, method: str) -> str:
    """CTEs ``name``: pos, i, label of the clusters that merging nearest first leaves.

    ``source``: pos, n, d (distances row after row, infinite on the diagonal), clusters.
    """
    other = "case when x // n in (i, j) then x % n else x // n end"
    if method == "single":
        near = "least(d[i * n + o + 1], d[j * n + o + 1])"
    else:
        near = "sqrt(greatest(0, ((size[o + 1] + size[i + 1]) * d[i * n + o + 1] * d[i * n + o + 1] + (size[o + 1] + size[j + 1]) * d[j * n + o + 1] * d[j * n + o + 1] - size[o + 1] * h * h) / (size[o + 1] + size[i + 1] + size[j + 1])))"
    near = near.replace("[o + 1]", f"[{other} + 1]".replace("case", "(case").replace(" end + 1]", " end) + 1]")).replace(" + o + 1]", f" + ({other}) + 1]")
    gone = f"x // n = x % n or x // n = j or x % n = j or isinf(d[i * n + ({other}) + 1]) or isinf(d[j * n + ({other}) + 1])"
    return f"""
{name}_t(pos, n, clusters, d, size, label, step) using key (pos) as (
  select pos, n, clusters, d, list_transform(range(n), lambda x: 1.0::double), range(n), 0::bigint from {source}
  union
  select pos, n, clusters,
    list_transform(range(n * n), lambda x: case when not (x // n in (i, j) or x % n in (i, j)) then d[x + 1] when {gone} then 'infinity'::double else {near} end),
    list_transform(range(n), lambda x: case when x = i then size[i + 1] + size[j + 1] else size[x + 1] end),
    list_transform(label, lambda x: case when x = j then i else x end), step + 1
  from (select *, spot // n as i, spot % n as j from (select *, list_min(d) as h, list_position(d, list_min(d)) - 1 as spot from {name}_t where step < n - clusters))
),
{name} as (select pos, i, dense_rank() over (partition by pos order by first) as label from (select pos, g.i, label[g.i + 1] as first from {name}_t, lateral (select unnest(range(n)) as i) g))"""


#: Distances of assets in the kept components, and by correlation; at least 2 clusters, at most 20.
FEATURES = """
ft as (select c.pos, i.i, sum(case when m <= bk.k then greatest(value, 0) * vec[i.i + 1] * vec[i.i + 1] end) as own, list(case when m <= bk.k then sqrt(greatest(value, 0)) * vec[i.i + 1] else 0 end order by m) as point from ce c join bk using (pos), lateral (select unnest(range(c.n)) as i) i group by c.pos, i.i)"""
WARD = f"""{FEATURES},
wd as (select pos, n, least(20, greatest(2, k)) as clusters, d from bk join (select a.pos, list(case when a.i = b.i then 'infinity'::double else list_distance(a.point, b.point) end order by a.i, b.i) as d from ft a join ft b using (pos) group by a.pos) using (pos)),
{agglomerated("wl", "wd", "ward")}"""
SINGLE = f"""
cd as (select pos, n, least(20, greatest(2, k)) as clusters, list_transform(range(n * n), lambda x: case when x // n = x % n then 'infinity'::double else sqrt(greatest(0, 0.5 * (1 - a[x + 1]))) end) as d from cm join bk using (pos, n)),
{agglomerated("sl", "cd", "single")}"""
ABSORBED = """
fk as (select arg_min(k, pos) as fixed from bk),
ar as (select pos, sum(case when m <= least(n, greatest(1, fixed)) then value end) / sum(value) as x, any_value(n) as n from (select *, row_number() over (partition by pos order by value desc) as m from (select pos, n, value from moved)), fk group by pos)"""
TRAILING = """
lv as (select pos, x, avg(x) over (order by pos rows 4 preceding) as level from ar), df as (select *, level - lag(level) over (order by pos) as d from lv),
tr as (select *, case when count(d) over past >= 6 then stddev_samp(d) over past end as sigma from df window past as (order by pos rows between 12 preceding and 1 preceding))"""
#: The change of clusters between rebalances ``lag`` apart, on at least 10 common assets.
CHANGE = """
rb as (select pos, row_number() over (order by pos) as reb from bk), lb as (select reb, permno, label from wl join kept using (pos, i) join rb using (pos)),
joint as (select g.lag, b.reb, a.label as a, b.label as b, count(*)::double as n_ab from lb b join (values (1), (2), (4), (8)) g(lag) on true join lb a on a.reb + g.lag = b.reb and a.permno = b.permno group by all),
cells as (select *, sum(n_ab) over (partition by lag, reb, a) as n_a, sum(n_ab) over (partition by lag, reb, b) as n_b, sum(n_ab) over (partition by lag, reb) as n from joint),
vi as (select lag, reb, greatest(0, sum(-n_ab / n * ln(n_a / n)) + sum(-n_ab / n * ln(n_b / n)) - 2 * sum(n_ab / n * ln(n_ab * n / (n_a * n_b)))) as vi from cells where n >= 10 group by lag, reb)"""

I13 = f"with recursive {ALL}, {NLS} select nm.pos, a.permno as i, b.permno as k, round(nm.a[a.i * nm.n + b.i + 1], 10) as s from nm join kept a using (pos) join kept b using (pos)"
I24 = f"with recursive {ALL}, {SAMPLE}, {correlations('cm', 'sm')}, {jacobi('ce', 'cm')}, {bulk('bk', 'ce')} select pos, round(variance, 9) as variance, cast(k as integer) as k, round(variance * power(1 + sqrt(n::double / {views.WINDOW}), 2), 9) as edge from bk"
I25 = f"{PASS} select ce.pos, cast(ce.n as integer) as n, cast(bk.k as integer) as k, round(variance, 9) as variance, cast(ce.m - 1 as integer) as rank, round(ce.value, 9) as value, round(c.value, 11) as cov_value from ce join bk using (pos) join (select pos, value, row_number() over (partition by pos order by value desc) as m from moved) c on c.pos = ce.pos and c.m = ce.m"
I26 = f"{PASS}, {ABSORBED} select pos, round(x, 9) as x from ar"
I27 = f"{PASS}, {FEATURES} select pos, permno, round(own, 8) as length from ft join kept using (pos, i)"
I29 = f"{PASS}, {WARD} select pos, permno, cast(label as integer) as label from wl join kept using (pos, i)"
I30 = f"{PASS}, {SINGLE} select pos, permno, cast(label as integer) as label from sl join kept using (pos, i)"
I31 = f"{PASS}, {WARD} select pos, cast(least(20, greatest(2, bk.k)) as integer) as clusters, cast(count(distinct label) as integer) as found from wl join bk using (pos) group by pos, bk.k"
I39 = f"""{PASS}, iv as (select pos, i.i, sum(vec[i.i + 1] * total / value) as w from (select *, list_sum(vec) as total from moved), lateral (select unnest(range(n)) as i) i group by pos, i.i),
ct as (select pos, i, greatest(0, w / sum(w) over (partition by pos)) as w from iv) select pos, permno, round(w / sum(w) over (partition by pos), 8) as w from ct join kept using (pos, i)"""
I37 = f"""{PASS}, er(pos, n, a, w, turn) using key (pos) as (
  select pos, n, a, list_transform(range(n), lambda x: 1 / sqrt(a[x * n + x + 1])), 0 from nm
  union
  select pos, n, a, list_transform(range(n), lambda x: (w[x + 1] + 1 / (list_dot_product(a[x * n + 1:x * n + n], w))) / 2 / scale), turn + 1
  from (select *, sqrt(list_dot_product(w, list_transform(range(n), lambda x: list_dot_product(a[x * n + 1:x * n + n], w))) / n) as scale from er where turn < 400)
), rw as (select pos, n, g.i, w[g.i + 1] / list_sum(w) as w from er, lateral (select unnest(range(n)) as i) g)
select pos, permno, round(w, 7) as w from rw join kept using (pos, i)"""
I41 = f"{PASS}, ow as (select pos, sum(case when m <= greatest(1, k) then value end) / sum(value) as ar from (select moved.*, bk.k, row_number() over (partition by pos order by value desc) as m from (select pos, value from moved) moved join bk using (pos)) group by pos) select pos, cast(n as integer) as n, cast(k as integer) as k, round(variance, 9) as variance, round(ar, 9) as ar from bk join ow using (pos)"
I42 = f"{PASS} select cast(arg_min(k, pos) as integer) as k from bk"
I43 = f"{PASS}, {ABSORBED}, {TRAILING} select pos, round(x, 9) as x, round(d, 9) as d, round(sigma, 9) as sigma, coalesce(abs(d) > sigma, false) as fired from tr"
I87 = f"{PASS}, {WARD}, {ABSORBED}, {TRAILING}, {CHANGE} select cast(rb.reb as integer) as reb, pos, round(x, 9) as x, round(d, 9) as d, round(sigma, 9) as sigma, sigma is not null as eligible, round(vi, 9) as vi from tr join rb using (pos) left join (select * from vi where lag = 1) v using (reb)"
I92 = f"""{PASS}, {WARD}, {CHANGE} select 'vi' as what, lag as "at", round(avg(vi), 9) as value from vi group by lag
union all select 'absorption', k.k, round(avg(x), 9) from (select pos, k, sum(case when m <= least(n, k) then value end) / sum(value) as x from (select pos, n, value, row_number() over (partition by pos order by value desc) as m from (select pos, n, value from moved)), (values (1), (2), (4)) k(k) group by pos, k) k group by k.k"""
#: Every third of the diagonals of a window is taken out, then covariances are over pairwise complete rows, with a ridge and a floor.
I22 = f"""with recursive {ALL}, xm as (select pos, i, n, t, x from x where (t + 3 * i) % 11 <> 0),
pc as (select a.pos, any_value(a.n) as n, a.i, b.i as k, (sum(a.x * b.x) - sum(a.x) * sum(b.x) / count(*)) / (count(*) - 1) as s from xm a join xm b using (pos, t) group by a.pos, a.i, b.i),
rg as (select pos, any_value(n) as n, list(case when i = k then s else 0.9 * s end order by i, k) as a from pc group by pos), {jacobi("re", "rg")},
fl as (select pos, n, m, vec, greatest(value, greatest(1e-12, 1e-8 * max(value) over (partition by pos))) as value from re), {rebuilt("fm", "fl", "value")}
select fm.pos, a.permno as i, b.permno as k, round(fm.a[a.i * fm.n + b.i + 1], 10) as s from fm join kept a using (pos) join kept b using (pos)"""
SQL = {
    "i13_nonlinear": I13, "i22_pairwise": I22, "i24_bulk": I24, "i25_spectrum": I25, "i26_absorption": I26, "i27_features": I27, "i29_clusters": I29, "i30_clusters": I30, "i31_cluster_counts": I31, "i37_equal_risk": I37,
    "i39_least_variance": I39, "i41_shared": I41, "i42_frozen": I42, "i43_ar_trigger": I43, "i87_structural": I87, "i92_sweep": I92,
}
