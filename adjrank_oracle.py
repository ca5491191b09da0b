"""DuckDB SQL for every query of ``__spark_entry__``, written from the definitions.

Loops are unrolled into one CTE per step. Nothing here imports the package, so
that a mistake there cannot repeat itself here.
"""

from __future__ import annotations

BLOCK = 256
NARROW_BLOCK, WIDE_BLOCK = 8, 512
TIGHT_LINKS = 100
SPLITS = 7
TOP = 25
MOVED = 0.1
UNTIL_STEPS, UNTIL_THRESHOLD, BLOCKED_THRESHOLD = 8, 0.02, 0.05
DEGREE, RATIO, GENERATED_BLOCK, SEED = 5, 0.3, 128, 42

BASKET = """
  select distinct src, dst from (
    select l_partkey as src, lead(l_partkey) over (
      partition by l_orderkey
      order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) as dst
    from lineitem)
  where dst is not null and src <> dst"""
# Parts are the even vertices and suppliers the odd ones.
TO_SUPPLIER = "select l_partkey * 2 as src, l_suppkey * 2 + 1 as dst from lineitem"
BOTH_WAYS = f"{TO_SUPPLIER} union all select l_suppkey * 2 + 1, l_partkey * 2 from lineitem"
GAPPY = f"select src * 2 as src, dst * 2 as dst from ({BASKET}) union all {TO_SUPPLIER}"

LISTS = f"""with e as ({BASKET}),
o as (select src, dst, row_number() over (partition by src order by dst) as rn, count(*) over (partition by src) as n from e)
"""


def listed(edges: str, extra: str = "") -> str:
    """One row per source with its sorted links."""
    return f"""select src, count(*) as n_links, string_agg(dst::varchar, ' ' order by dst) as links{extra}
from ({edges}) group by src"""


def segments(edges: str, size: int) -> str:
    return f"""select src, count(*) as n_links, string_agg(dst::varchar, ' ' order by dst) as links, segment
from (select src, dst, (row_number() over (partition by src order by dst) - 1) // {size} as segment from ({edges}))
group by src, segment"""


def graph(edges: str) -> str:
    """Edges, degrees, rows, all vertices and the unit start vector."""
    return f"""with e as ({edges}),
d as (select src, count(*) as deg from e group by src),
v as (select src as id from e union select dst from e),
r0 as (select src as id, 1.0::double as r from d)"""


def naive(edges: str, steps: int) -> str:
    sql = graph(edges)
    for step in range(1, steps + 1):
        sql += f""",
r{step} as (select v.id, coalesce(sum(p.r / d.deg), 0) as r from v
  left join e on e.dst = v.id left join r{step - 1} p on p.id = e.src left join d on d.src = e.src
  group by v.id)"""
    return sql


def blocks_of_step(step: int, by: str, size: int) -> str:
    """Vertices that have a row before a step, with their block."""
    ids = "select src as id from d" if step == 1 else "select id from v"
    if by == "range":
        return f"select id, id // {size} as block from ({ids})"
    return f"select id, (row_number() over (order by id) - 1) // {size} as block from ({ids})"


def blocked(edges: str, steps: int, size: int, inner: int, by: str = "range") -> str:
    sql = graph(edges)
    for step in range(1, steps + 1):
        sql += f""",
b{step} as ({blocks_of_step(step, by, size)}),
x{step} as (select e.src, e.dst, p.r / d.deg as share, d.deg, p.r, coalesce(s.block = t.block, false) as near
  from e join d on d.src = e.src join r{step - 1} p on p.id = e.src
  join b{step} s on s.id = e.src left join b{step} t on t.id = e.dst),
l{step} as (select dst as id, {inner} * sum(share) as lr from x{step} where near group by dst),
o{step} as (select x.dst as id, sum(coalesce(l.lr, x.r) / x.deg) as c
  from x{step} x left join l{step} l on l.id = x.src where not x.near group by x.dst),
r{step} as (select v.id, coalesce(o.c, 0) as r from v left join o{step} o on o.id = v.id)"""
    return sql


def vector(sql: str, step: int) -> str:
    return f"{sql}\nselect id, round(r, 9) as rank from r{step}"


def placed(sql: str, step: int) -> str:
    return f"""{sql},
k as (select id, round(r, 9) as rank from r{step}),
z as (select id, rank, row_number() over (order by rank desc, id) - 1 as pos from k)"""


def pairs(sql: str, step: int) -> str:
    return f"""{placed(sql, step)}
select pos // 2 as pair_id, min_by(id, pos) as a, max_by(id, pos) as b from z group by pos // 2"""


# The generator's fixed values.
PRIME = 2147483647
ROUNDS = ((1, 48271, 11), (65536, 69621, 7), (32768, 40692, 3))
STRIDE = 7919


def mixed(source: str, value: str, name: str) -> str:
    """A subquery adding the scrambled ``value`` as ``name``."""
    inner = f"select *, ({value}) % {PRIME} as m0 from {source}"
    for number, (fold, factor, offset) in enumerate(ROUNDS, 1):
        before = f"m{number - 1}"
        folded = before if fold == 1 else f"({before} + {before} // {fold})"
        inner = f"select * exclude ({before}), ({folded} * {factor} + {offset}) % {PRIME} as m{number} from ({inner})"
    return f"(select * rename (m3 as {name}) from ({inner}))"


def picked(name: str, begin: str, wanted: str, choices: str) -> str:
    """CTEs for ``wanted`` distinct draws of ``[0, choices)`` per vertex."""
    some = f"(select src, {begin} as begin, least({wanted}, {choices}) as m, {choices} as c from k)"
    each = f"(select *, unnest(range(0, m)) as i from {some} where m > 0)"
    return f"""
{name}_draws as (select src, i, m, c - m + i as last, 
    (h * {PRIME} + (h * {ROUNDS[0][1]} + src % {PRIME} * {ROUNDS[1][1]} + begin) % {PRIME}) % (c - m + i + 1) as value
  from {mixed(each, f"begin + (i + 1) * {STRIDE}", "h")}),
{name}_picks as (
  select src, m, 0 as i, []::bigint[] as picks from {some} where m > 0
  union all
  select p.src, p.m, p.i + 1,
    list_append(p.picks, case when list_contains(p.picks, d.value) then d.last else d.value end)
  from {name}_picks p join {name}_draws d on d.src = p.src and d.i = p.i),
{name} as (select src, unnest(picks) as pick from {name}_picks where i = m)"""


def generated() -> str:
    size = max(GENERATED_BLOCK, 2 * DEGREE)
    seeded = mixed("b", f"src + {SEED % PRIME}", "seeded")
    streams = seeded
    for number, name in enumerate(("s0", "s1", "s2")):
        streams = mixed(streams, f"seeded + src // {PRIME} + {number * STRIDE}", name)
    degree = mixed(streams, "s0", "h0")
    return f"""with recursive n as (select count(*) as n from orders),
b as (select src, n, src - src % {size} as start, least(n - (src - src % {size}), {size}) as members
  from (select n, unnest(range(0, n)) as src from n)),
k as (select src, n, start, members, s1, s2, h0 % {2 * DEGREE} as k,
  floor({RATIO}::float * (h0 % {2 * DEGREE})::float)::bigint as border from {degree}),
{picked("near", "s1", "k - border", "members - 1")},
{picked("far", "s2", "border", "n - members")},
t as (
  select src, case when start + pick < src then start + pick else start + pick + 1 end as dst from near join k using (src)
  union all
  select src, case when pick < start then pick else pick + members end from far join k using (src)),
a as (select src, count(*) as n_links, string_agg(dst::varchar, ' ' order by dst) as links from t group by src)
select b.src, coalesce(n_links, 0) as n_links, coalesce(links, '') as links, 1.0::double as rank
from b left join a using (src)"""


def ranges(n: str, splits: str) -> str:
    """Vertices with the range ntile puts them in."""
    return f"select id, ntile({splits}) over (order by id) - 1 as split from (select unnest(range(0, ({n}))) as id)"


def until(sql: str, threshold: float) -> str:
    """The first step where no rank moves by more than the threshold."""
    moves = " union all ".join(
        f"select {s} as step, count(*) filter (abs(n.r - o.r) > {threshold}) as moving "
        f"from r{s} n join r{s - 1} o on o.id = n.id"
        for s in range(1, UNTIL_STEPS + 1)
    )
    steps = " union all ".join(f"select {s} as step, id, r from r{s}" for s in range(1, UNTIL_STEPS + 1))
    return f"""{sql},
settled as (select min(step) filter (moving = 0) as step from ({moves}))
select id, round(r, 9) as rank from ({steps}) where step = (select step from settled)"""


def two_vectors() -> str:
    """Differences of ranks on two graphs; suppliers are in the second only."""
    return f"""with a as (select id * 2 as id, rank from ({vector(naive(BASKET, 1), 1).replace("round(r, 9)", "r")})),
b as ({vector(naive(BOTH_WAYS, 2), 2).replace("round(r, 9)", "r")}),
delta as (select id, coalesce(abs(a.rank - b.rank), a.rank, b.rank) as delta from a full outer join b using (id))"""


def statements() -> dict[str, str]:
    basket_1 = naive(BASKET, 1)
    rank = "n / 4.0::double"
    classified = "select e.src, e.dst, coalesce(s.block_id = t.block_id, false) as is_local from e"
    return {
        "read_ranked_adjacency": f"""{LISTS}
select src,
  case src % 8 when 3 then n - 1 when 4 then 1 when 7 then 0 else n end as n_links,
  coalesce(string_agg(dst::varchar, ' ' order by rn) filter (
    case src % 8 when 3 then rn < n when 4 then rn = 1 when 7 then false else true end), '') as links,
  {rank} as rank
from o where src % 8 not in (5, 6) group by src, n""",
        "read_adjacency": f"""{LISTS}
select src, case src % 4 when 1 then n - 1 else n end as n_links,
  string_agg(dst::varchar, ' ' order by rn) filter (src % 4 <> 1 or rn < n) as links
from o where src % 4 <> 3 group by src, n""",
        "read_rank_vector": f"select src as id, count(*) / 4.0::double as rank from ({BASKET}) where src % 5 <> 3 group by src",
        "graph_roundtrip": listed(BASKET, ", 0::bigint as segment, count(*) / 4.0::double as rank"),
        "read_range": f"""with n as (select 2 * count(*) as n from part),
r as (select 3 * (n // {SPLITS}) + least(3, n % {SPLITS}) as first, n // {SPLITS} + (3 < n % {SPLITS})::int as size from n)
select a.* from ({listed(BOTH_WAYS, ", 0::bigint as segment, 1.0::double as rank")}) a, r where src >= first and src < first + size""",
        "graph_roundtrip_segments": vector(naive(BOTH_WAYS, 1), 1),
        "text_roundtrip_segments": vector(naive(BOTH_WAYS, 1), 1),
        "split_rows": segments(BOTH_WAYS, TIGHT_LINKS),
        "format_ranked_adjacency": f"""select concat_ws(' ', src, n_links, links, rank) as line
from ({listed(BASKET, ", count(*) / 4.0::double as rank")})""",
        "format_adjacency": f"select concat_ws(' ', src, n_links, links) as line from ({listed(BASKET)})",
        "write_edges": f"select src || chr(9) || dst as line from ({TO_SUPPLIER})",
        "write_rank_vector": vector(basket_1, 1),
        "write_pairs": f"select a || chr(9) || b as line from ({pairs(basket_1, 1)})",
        "generate_blocked_graph": generated(),
        "ranked_from_decoded": f"""with e as ({TO_SUPPLIER}),
a as ({listed("select * from e")}),
i as ({ranges("select 2 * count(*) from part", str(SPLITS))})
select id as src, coalesce(n_links, 0) as n_links, coalesce(links, '') as links,
  0::bigint as segment, 1.0::double as rank, split
from i left join a on a.src = i.id""",
        "attach_rank": listed(TO_SUPPLIER, ", 2.5::double as rank"),
        "adjacency_to_edges": TO_SUPPLIER,
        "edges_to_adjacency": listed(TO_SUPPLIER, ", 0::bigint as segment"),
        "transpose": listed(f"select dst as src, src as dst from ({BASKET})", ", 0::bigint as segment"),
        "transpose_segments": segments(f"select dst as src, src as dst from ({TO_SUPPLIER})", TIGHT_LINKS),
        "out_degree": f"select src, count(*) as degree from ({BOTH_WAYS}) group by src",
        "rank_vector": f"select src as id, count(*) / 4.0::double as rank from ({BASKET}) group by src",
        "vertex_ranges": f"""select split, min(id) as first, max(id) as last, sum(coalesce(n, 0))::bigint as lines
from ({ranges("select count(*) from part", "(select count(*)::int from supplier)")})
left join (select l_partkey as id, count(*) as n from lineitem group by 1) using (id) group by split""",
        "range_of": f"""select coalesce(split, -1) as split, count(*) as lines
from lineitem left join ({ranges("select count(*) // 2 from part", str(SPLITS))}) on id = l_partkey
group by coalesce(split, -1)""",
        "assign_blocks": f"select distinct src, src // {BLOCK} as block_id from ({GAPPY})",
        "assign_blocks_position": f"""select src, (row_number() over (order by src) - 1) // {BLOCK} as block_id
from (select distinct src from ({GAPPY}))""",
        "classify_edges": f"""with e as ({GAPPY}), b as (select distinct src, src // {BLOCK} as block_id from e)
{classified} join b s on s.src = e.src left join b t on t.src = e.dst""",
        "classify_edges_heavy": f"""with e as ({BOTH_WAYS}), b as (select distinct src, src // {WIDE_BLOCK} as block_id from e)
{classified} join b s on s.src = e.src left join b t on t.src = e.dst""",
        "matvec_rows": f"""{naive(TO_SUPPLIER, 1)},
a as ({listed("select * from e")})
select id as src, coalesce(n_links, 0) as n_links, coalesce(links, '') as links, round(r, 9) as rank
from r1 left join a on a.src = r1.id""",
        "matvec_resumed": vector(naive(BASKET, 3), 3),
        "matvec_bucketed": vector(naive(BASKET, 3), 3),
        "matvec_dangling": vector(naive(f"select distinct * from ({TO_SUPPLIER})", 1), 1),
        "matvec_multilink": vector(naive(BOTH_WAYS, 2), 2),
        "matvec_heavy": vector(naive(BOTH_WAYS, 2), 2),
        "matvec_until": until(naive(BASKET, UNTIL_STEPS), UNTIL_THRESHOLD),
        "unconverged_count": f"""{basket_1}
select count(*) filter (abs(n.r - coalesce(o.r, 0)) > {MOVED}) as unconverged
from r1 n left join r0 o on o.id = n.id""",
        "partitioned_matvec_dangling": vector(blocked(TO_SUPPLIER, 1, WIDE_BLOCK, 2), 1),
        "partitioned_matvec_position": vector(blocked(GAPPY, 2, BLOCK, 2, "position"), 2),
        "partitioned_matvec_gappy": vector(blocked(GAPPY, 2, BLOCK, 2), 2),
        "partitioned_matvec_position_shuffled": vector(blocked(GAPPY, 2, BLOCK, 2, "position"), 2),
        "partitioned_matvec_co_located": vector(blocked(BASKET, 2, NARROW_BLOCK, 2), 2),
        "partitioned_matvec_co_located_heavy": vector(blocked(BOTH_WAYS, 2, NARROW_BLOCK, 2), 2),
        "partitioned_matvec_until": until(blocked(BASKET, UNTIL_STEPS, BLOCK, 1), BLOCKED_THRESHOLD),
        "rank_deltas": f"{two_vectors()} select id, round(delta, 9) as delta from delta",
        "max_rank_difference": f"{two_vectors()} select round(max(delta), 9) as max_delta from delta",
        "sort_by_rank": f"{placed(basket_1, 1)} select id, rank, pos from z",
        "top_k_by_rank": f"{placed(basket_1, 1)} select id, rank, pos from z where pos < {TOP}",
        "rank_position": f"{placed(basket_1, 1)} select id, rank, pos from z",
        "pair_adjacent": pairs(basket_1, 1),
        "pair_adjacent_stored": pairs(basket_1, 1),
        "naive_nsd": f"{placed(naive(BASKET, 3), 3)} select id, rank, pos from z",
        "partitioned_nsd": f"{placed(blocked(BASKET, 2, BLOCK, 1), 2)} select id, rank, pos from z",
        "inner_outer_nsd": f"{placed(blocked(BASKET, 2, BLOCK, 2), 2)} select id, rank, pos from z",
        "self_match": pairs(naive(BASKET, 3), 3),
        "self_match_blocked": pairs(blocked(BASKET, 2, BLOCK, 2), 2),
        "matvec_1": vector(basket_1, 1),
        "matvec_3": vector(naive(BASKET, 3), 3),
        "matvec_3_shuffled": vector(naive(BASKET, 3), 3),
        "partitioned_matvec_1": vector(blocked(BASKET, 1, BLOCK, 1), 1),
        "partitioned_matvec_inner2": vector(blocked(BASKET, 1, BLOCK, 2), 1),
        "partitioned_matvec_iter": vector(blocked(BASKET, 3, BLOCK, 2), 3),
        "partitioned_matvec_shuffled": vector(blocked(BASKET, 2, BLOCK, 2), 2),
    }
