"""DuckDB SQL that must give the rows of the registered queries."""

from __future__ import annotations

from .queries import BM25_QUERY, FUSED_QUERY

_TRADE = "trade as (select 'customer/' || o_custkey as src, 'part/' || l_partkey as dst, count(*)::double as weight from lineitem join orders on l_orderkey = o_orderkey group by all)"
_SALES = """sales as (select b.n_name as buyer, s.n_name as seller, l_partkey from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
  join nation b on c_nationkey = b.n_nationkey join supplier on l_suppkey = s_suppkey join nation s on s_nationkey = s.n_nationkey)"""
_NATIONS = _SALES + ", nations as (select buyer as src, seller as dst, count(*)::double as weight from sales group by all)"
_BRANDS = _SALES + ", brands as (select distinct buyer as src, seller as dst, p_brand as name from sales join part on l_partkey = p_partkey), named as (select src, dst, string_agg(name, ',' order by name) as names, greatest(count(*), 1)::double as weight from brands group by src, dst)"
_NAMES = "unnest([p_name, replace(p_name, ' ', '_') || '_' || p_size])"
_EXPORTS = f"exports as (select distinct p_brand || '/' || p_type as path, {_NAMES} as name, p_type as kind from part)"
_REFS = _SALES + f""", bought as (select buyer, l_partkey, count(*) as n from sales group by all),
refs as (select 'nation/' || buyer as path, name, sum(n)::bigint as n from (select p_partkey, {_NAMES} as name from part) p join bought on p_partkey = l_partkey group by all)"""
_RANKS = """file_ranks as (select p_brand || '/' || p_type as path, round(count(*)::double / (select count(*) from lineitem), 6) as rank from lineitem join part on l_partkey = p_partkey group by all)"""
_PAGES = r"""pages_ as (select 'app/' || regexp_replace(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1), '/+$', '') || '/page.tsx' as path, min(html) as text from pages group by all),
files as (select path, text, case when len(string_split(path, '/')) > 2 and not regexp_matches(string_split(path, '/')[2], '^[(\[@]') then string_split(path, '/')[2] end as feature from pages_)"""
_LINKS = """links as (select distinct path as src, unnest(regexp_extract_all(text, 'href="([^"]*)"', 1)) as spec from files),
exact as (select src, spec, f.path as dst from links join files f on spec = '/' || regexp_extract(f.path, '^app/(.*)/page', 1)),
hits as (select * from exact union select l.src, l.spec, s.dst from links l join (select '/' || feature as spec, min(path) as dst from files where feature is not null group by feature) s on l.spec = s.spec
  where not exists (select 1 from exact e where e.src = l.src and e.spec = l.spec))"""
_ROUTE_FILES = r"""parts_ as (select distinct regexp_extract(url, '^(https?)://', 1) as grp, regexp_extract(url, '^https?://[^/]+/([^/?#]*)', 1) as section, regexp_extract(url, '^https?://[^/]*\.([a-z]+)/', 1) as top from pages),
route_files as (select distinct unnest(['app/(' || grp || ')/' || section || '/[id]/page.tsx', 'app/(' || grp || ')/' || section || '/layout.tsx', 'app/api/' || top || '/[...rest]/route.ts', 'app/layout.tsx', 'app/page.tsx']) as path from parts_)"""
_ROUTES = (
    _ROUTE_FILES
    + r""", routes as (select path, case when path like '%/page.tsx' then 'page' else 'route' end as kind,
  case when path = 'app/page.tsx' then '/' when path like '%/page.tsx' then '/' || string_split(path, '/')[3] || '/:id' else '/api/' || string_split(path, '/')[3] || '/*rest' end as url,
  case when path like '%/route.ts' then 'GET,POST' else '' end as methods,
  case when path like '%/route.ts' then '' when path = 'app/page.tsx' then 'app/layout.tsx' else 'app/layout.tsx,' || string_split(path, '/')[1] || '/' || string_split(path, '/')[2] || '/' || string_split(path, '/')[3] || '/layout.tsx' end as layouts,
  case when path like '%/page.tsx' then 'client' else '' end as boundary from route_files where path not like '%/layout.tsx')"""
)
_STEPS = """steps as (select 'user/' || (user_id % 40) as caller_file, event_id::int as caller_line, event_type as caller_name, length(event_type) as caller_decl_line, 'user/' || ((user_id + 1) % 40) as callee_file,
  callee as callee_name, length(callee) as callee_line, 'FunctionDeclaration' as callee_kind from (select *, lead(event_type) over (partition by user_id order by ts, event_id) as callee from events) where callee is not null),
step_ranks as (select caller_file as path, count(*)::double as rank from steps group by all)"""
_SUPPLY = _TRADE + """, supply as (select src, dst from trade union select distinct 'part/' || l_partkey, 'supplier/' || l_suppkey from lineitem
  union select 'supplier/' || s_suppkey, 'nation/' || s_nationkey from supplier union select 'nation/' || n_nationkey, 'region/' || n_regionkey from nation),
back(path, hop) as (select 'nation/3', 0 union select src, hop + 1 from back join supply on dst = path where hop < 6),
reached as (select path, min(hop)::int as hop from back group by path having min(hop) > 0)"""


def _tokens(c: str) -> str:
    """The subtokens of a text, as a list."""
    apart = rf"regexp_replace({c}, '([A-Z][a-z])', ' \1', 'g')"
    return f"list_transform(regexp_extract_all({apart}, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(x))"


def _pagerank(edges: str, nodes: str = "", seeds: str = "") -> str:
    """CTEs ending in pr(node, rank); edges(src, dst, weight), nodes(node) and seeds(node, value) are tables."""
    nodes = nodes or f"(select src as node from {edges} union select dst from {edges})"
    p = f"case when node in (select node from {seeds}) then (select sum(value) from {seeds} s where s.node = n.node) / (select sum(value) from {seeds}) else 0 end" if seeds else "1.0::double / count(*) over ()"
    return f"""
pr_n as materialized (select node, {p} as p from (select distinct node from {nodes}) n),
pr_e as materialized (select src, dst, sum(case when weight > 0 then weight else 1 end) as w from {edges} where src <> dst and src in (select node from pr_n) and dst in (select node from pr_n) group by src, dst),
pr_w as materialized (select src, sum(w) as tw from pr_e group by src),
pr_s as materialized (select e.src, e.dst, e.w / tw as share from pr_e e join pr_w on pr_w.src = e.src),
pr_r(i, node, r, diff) as (
  select 0, node, p::double, 1e9::double from pr_n
  union all
  select i + 1, node, r2, sum(abs(r2 - r0)) over () from (
    select r.i, r.node, r.r as r0, 0.15 * n.p + 0.85 * lost.s * n.p + 0.85 * coalesce(c.s, 0) as r2
    from pr_r r join pr_n n on n.node = r.node
    left join (select s.dst, sum(q.r * s.share) as s from pr_r q join pr_s s on s.src = q.node group by s.dst) c on c.dst = r.node,
    (select coalesce(sum(q.r), 0) as s from pr_r q where q.node not in (select src from pr_w)) lost
    where r.i < 100 and r.diff >= 1e-6)),
pr as materialized (select node, r as rank from pr_r where i = (select max(i) from pr_r))"""


def _multiplier(mentioned: str = "") -> str:
    first = f"case when name in (select name from {mentioned}) then 10.0 else 1.0 end * " if mentioned else ""
    joined = "((contains(name, '_') or contains(name, '-')) and regexp_matches(name, '[a-zA-Z]'))"
    return f"""(select name, definers, {first}case when ({joined} or (regexp_matches(name, '[a-z]') and regexp_matches(name, '[A-Z]'))) and length(name) >= 8 then 10.0 else 1.0 end
      * case when starts_with(name, '_') then 0.1 else 1.0 end * case when definers > 5 then 0.1 else 1.0 end::double as multiplier from (select name, count(distinct path) as definers from exports group by name))"""


def _symbol_rank(limit: int, focus: tuple[str, ...] = (), top: str = "") -> str:
    listed = ", ".join(f"'{x}'" for x in focus)
    boost = f"case when r.path in ({listed}) then 50.0 else 1.0 end" if focus else "1.0"
    mentioned = f"""mentioned as (select name from exports where path in ({listed}) union select regexp_replace(string_split(unnest([{listed}]), '/')[-1], '\\.[^.]+$', '')),""" if focus else ""
    seeds = f"""unit as (select 100.0::double / count(*) as u from nodes_),
      seeds as (select node, u as value from nodes_, unit where node in ({listed}) union all
        select node, u from nodes_, unit where list_has_any(list_append(string_split(node, '/'), regexp_replace(string_split(node, '/')[-1], '\\.[^.]+$', '')), (select list(name) from mentioned))),""" if focus else ""
    return f"""with recursive {_EXPORTS}, {_REFS}, {mentioned}
nodes_ as (select path as node from exports union select path from refs), {seeds}
mult as {_multiplier("mentioned" if focus else "")},
es as materialized (select r.path as src, e.path as dst, r.name, mult.multiplier * sqrt(r.n::double) * {boost} as weight from refs r join mult on mult.name = r.name join (select distinct path, name from exports) e on e.name = r.name where r.path <> e.path),
{_pagerank("es", "nodes_", "seeds" if focus else "")},
scored as (select dst as path, name, sum(pr.rank * weight / total) as share from es join pr on pr.node = es.src join (select src as s, sum(weight) as total from es group by src) t on t.s = es.src group by dst, name),
every as (select e.path, e.name, e.kind, share from (select path, name, min(kind) as kind from exports group by all) e left join scored s on s.path = e.path and s.name = e.name {f"where e.path not in ({listed})" if focus else ""}),
low as (select coalesce(min(round(share, 6)), 0) as least from every),
ranked as (select path, name, kind, coalesce(round(share, 6), round(case when least - 1e-6 > 0 then least - 1e-6 else 1e-6 end, 6)) as rank,
  row_number() over (order by share is null, round(share, 12) desc, case when share is not null then path || '|' || name end, path, name)::int as pos from every, low)
{top or f"select * from ranked where pos <= {limit}"}"""


_DIGEST = """, best as (select * from ranked where pos <= 80),
own as (select *, row_number() over (partition by path order by pos) as i from best),
blocks as (select path, min(pos) as first, list(struct_pack(i := i, name := name, kind := kind) order by i) as symbols from own where i <= 8 group by path),
numbered as (select *, row_number() over (order by first) as k from blocks),
cost as (select k, path, n, symbols, ceil((length(path) + 2 + list_sum(list_transform(symbols[1:n], lambda s: length(s.name) + length(s.kind) + 6))) / 4.0)::bigint as cost from (select *, unnest(range(1, len(symbols) + 1)) as n from numbered)),
fold(k, used, path, n, c) as (
  select 0::bigint, 0::bigint, null::varchar, 0::bigint, 0::bigint
  union all
  select f.k + 1, f.used + coalesce(x.cost, 0), x.path, coalesce(x.n, 0), coalesce(x.cost, 0) from fold f
    left join lateral (select path, n, cost from cost where cost.k = f.k + 1 and f.used + cost <= 300 and (f.k = 0 or n = len(symbols)) order by n desc limit 1) x on true
  where f.k < (select max(k) from numbered))
select f.path, row_number() over (order by f.k)::int as at, array_to_string(list_transform(b.symbols[1:f.n], lambda s: s.name), ',') as names, f.c as cost from fold f join blocks b on b.path = f.path where f.n > 0"""


def _find(q: str, kind: str = "") -> str:
    more = f" and contains(lower(kind), '{kind}')" if kind else ""
    return f"""with {_EXPORTS}, {_RANKS}, hit as (select e.path, e.name, e.kind, coalesce(rank, 0) as rank from exports e left join file_ranks f on f.path = e.path where contains(lower(name), '{q}'){more})
select path, name, kind, pos, total, total > 50 as truncated from (select path, name, kind, row_number() over (order by rank desc, path, name)::int as pos, count(*) over () as total from hit) where pos <= 50"""


def _bm25(tokens: list[str], key: str, fused: bool = False, order: str = "") -> str:
    from ..operators.lexical import query_tokens

    asked = ", ".join(f"('{t}')" for t in query_tokens(" ".join(tokens)))
    rank = " * (1 + 0.5 * coalesce((select rank from file_ranks f where f.path = s.path), 0) / (select max(rank) from file_ranks))" if fused else ""
    on = " and ".join(f"d.{k} = p.{k}" for k in key.split(", "))
    return f"""asked(token) as (values {asked}), docs as (select {key}, tokens, len(tokens) as len from corpus), posts as (select {key}, token, count(*) as tf from (select {key}, unnest(tokens) as token from corpus) group by all),
dfs as (select token, count(*) as n from posts group by token), stats as (select count(*) as nd, round(avg(len), 4) as avgdl from docs),
s as (select {", ".join("d." + k for k in key.split(", "))}, sum(ln(1 + (nd - n + 0.5) / (n + 0.5)) * (tf * 2.2) / (tf + 1.2 * (1 - 0.75 + 0.75 * (len / avgdl)))) as s
  from asked join posts p on p.token = asked.token join dfs on dfs.token = p.token join docs d on {on}, stats group by all),
scored as (select {key}, round(s{rank}, 6) as score from s where s > 0),
placed as (select *, count(*) over () as total, row_number() over (order by score desc, {key})::int as pos from scored)"""


_LEX = "corpus as (select path, name, kind, list_concat(" + _tokens("name") + ", " + _tokens("path") + ", [lower(kind)]) as tokens from exports)"
_PROSE = "corpus as (select 'doc/' || doc_id as path, " + _tokens("coalesce(text, '')") + " as tokens from documents)"
_LINES = """lines as (select 'doc/' || doc_id as path, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1))::int as line_no from documents),
found as (select path, line_no, regexp_replace(line, '[\\x00-\\x08\\x0B-\\x1F\\x7F]', '�', 'g') as line, count(*) over () as total from lines where contains(lower(line), '{q}'))"""
_DRAWN = f"""{_NATIONS}, two as (select * from nations where weight >= 2), {_pagerank("two")},
ranks as (select node as path, round(rank, 6) as rank from pr),
near as (select distinct unnest([src, dst]) as path from two where src = 'NATION_3' or dst = 'NATION_3'),
dn as (select path, rank, case when rank / (select max(rank) from ranks) >= 0.5 then 'hub' when rank / (select max(rank) from ranks) >= 0.15 then 'mid' else 'leaf' end as tier from ranks where path in (select path from near) order by rank desc, path limit 12),
ends as (select distinct src, dst from two where src <> dst and src in (select path from dn) and dst in (select path from dn))"""
_SNAP = """o as (select 'order/' || o_orderkey as path, o_orderstatus || ':' || floor(o_totalprice)::bigint as token, o_orderkey, o_orderpriority from orders),
old as (select path, token, o_orderpriority from o where o_orderkey % 10 <> 3), new as (select path, case when o_orderkey % 10 = 5 then token || '+' else token end as token from o where o_orderkey % 10 <> 7)"""


def _census(key: str, ok: str, share: float) -> str:
    return f"""with g as (select {key} as top, {ok} as ok, count(*) as n from documents group by all)
select top, n, (select coalesce(sum(n), 0)::bigint from g where ok) as supported, (select sum(n)::bigint from g) as total, round(n::double / (select sum(n) from g), 6) as share from g
where not ok and round(n::double / (select sum(n) from g), 6) >= {share} order by n desc, top limit 1"""


_TREE = """nn as (select n_nationkey as k, n_regionkey as r, (n_regionkey + 1) % 5 as j, 'src/nations/n' || n_nationkey || '.ts' as path from nation),
rr as (select r_regionkey as k, 'src/regions/r' || r_regionkey || '.ts' as path from region), ss as (select s_suppkey as k, s_nationkey as n, 'src/suppliers/s' || s_suppkey || '.tsx' as path from supplier),
tt as (select k, 'src/nations/__tests__/n' || k || '.test.ts' as path from nn)"""
_SITES = _TREE + """, sites as (select path, '../regions/r' || r || '.js' as spec, 'static' as form, false as type_only, 'REGION' || r || ',default' as names, 'src/regions/r' || r || '.ts' as target from nn
  union all select path, '@/regions/r' || j, 'static', true, 'Shape' || j, 'src/regions/r' || j || '.ts' from nn union all select path, './setup', 'side_effect', false, '*', null from nn
  union all select path, '../n' || k, 'static', false, 'nation' || k, 'src/nations/n' || k || '.ts' from tt union all select path, '@/nations', 'static', false, 'nation' || n, 'src/nations/index.ts' from ss
  union all select path, '@acme/nations/n' || n, 'static', false, 'Nation' || n, 'src/nations/n' || n || '.ts' from ss union all select path, '../nations/n' || n, 'dynamic', false, '*', 'src/nations/n' || n || '.ts' from ss
  union all select 'src/nations/index.ts', './n' || k, 'reexport', false, '', path from nn union all select 'src/Card.vue', './regions/r0', 'static', false, 'REGION0', 'src/regions/r0.ts'
  union all select 'src/index.ts', './nations', 'reexport', false, 'Nation0', 'src/nations/index.ts' union all select 'src/index.ts', './nations', 'reexport', false, '', 'src/nations/index.ts')"""
_REACH = _TREE + """, near as (select * from nn where r = 0 or j = 0), reach as (select path, 1 as hop from near union all select 'src/Card.vue', 1 union all select 'src/nations/index.ts', 2 union all select 'src/index.ts', 3
  union all select path, 2 from tt where k in (select k from near) union all select path, case when n in (select k from near) then 2 else 3 end from ss)"""
_CALLS = _TREE + """, calls as (select path as caller_file, 8 as caller_line, 'nation' || k as caller_name, 8 as caller_decl_line, 'src/regions/r' || r || '.ts' as callee_file, 'region' || r as callee_name, 3 as callee_line, 'FunctionDeclaration' as callee_kind, 'call' as kind from nn
  union all select path, 8, 'nation' || k, 8, path, 'helper' || k, 9, 'FunctionDeclaration', 'call' from nn union all select path, 9, 'helper' || k, 9, path, 'Nation' || k, 7, 'ClassDeclaration', 'call' from nn
  union all select path, 2, '<module>', 2, 'src/nations/n' || k || '.ts', 'nation' || k, 8, 'FunctionDeclaration', 'call' from tt
  union all select path, 4, 'Supplier' || k, 4, 'src/nations/n' || n || '.ts', 'nation' || n, 8, 'FunctionDeclaration', 'call' from ss union all select path, 4, 'Supplier' || k, 4, path, 'Card' || k, 6, 'VariableDeclaration', 'jsx' from ss)"""
_PASSED = "select k, path, 'Nation' || k as name, 'ClassDeclaration' as kind from nn union all select k, path, 'nation' || k, 'FunctionDeclaration' from nn"


def _callers(file: str, name: str) -> str:
    """Three hops of callers, at most 500 sites; a site's parent is what it calls, by its own line from the second hop on."""
    return f"""h1 as materialized (select distinct caller_file as f, caller_name as n, caller_line as l, null::varchar as via from steps where callee_file = '{file}' and callee_name = '{name}'),
      s1 as materialized (select distinct f, n from h1 where not (f = '{file}' and n = '{name}')),
      h2 as materialized (select distinct caller_file as f, caller_name as n, caller_line as l, callee_file || ':' || callee_name || ':' || callee_line as via from steps join s1 on callee_file = f and callee_name = n where (caller_file, caller_line) not in (select (f, l) from h1)),
      s2 as materialized (select distinct f, n from h2 where (f, n) not in (select (f, n) from s1) and not (f = '{file}' and n = '{name}')),
      h3 as materialized (select distinct caller_file as f, caller_name as n, caller_line as l, callee_file || ':' || callee_name || ':' || callee_line as via from steps join s2 on callee_file = f and callee_name = n where (caller_file, caller_line) not in (select (f, l) from h1) and (caller_file, caller_line) not in (select (f, l) from h2)),
      every as (select *, 1 as depth from h1 union all select *, 2 from (select * from h2 where (select count(*) from h1) < 500) union all select *, 3 from (select * from h3 where (select count(*) from h1) + (select count(*) from h2) < 500)),
      placed as (select *, row_number() over (order by depth, coalesce(rank, 0) desc, f, l, n) as r, count(*) over () as total from every left join step_ranks on path = f)
      select f as file, n as name, l as line, depth, via, total >= 500 as truncated from placed where r <= 500"""


def _router_symbol(q: str) -> str:
    return _find(q).replace("select path, name, kind, pos, total, total > 50 as truncated", "select 'symbol' as answer, path, name, kind as detail, pos, total")


ORACLE_SQL: dict[str, str] = {
    "hubs_customer_part": f"with recursive {_TRADE}, {_pagerank('trade')} select node as path, round(rank, 6) as pagerank, (select count(distinct src) from trade where dst = node) as in_degree from pr order by round(rank, 12) desc, node limit 15",
    "pagerank_customer_part": f"with recursive {_TRADE}, {_pagerank('trade')} select node as path, round(rank, 6) as pagerank from pr",
    "pagerank_nation_trade": f"with recursive {_NATIONS}, {_pagerank('nations')} select node as path, round(rank, 6) as pagerank from pr",
    "pagerank_personalized": f"with recursive {_NATIONS}, seeds as (select src as node, sum(weight) as value from nations where src like '%1' group by src), {_pagerank('nations', seeds='seeds')} select node as path, round(rank, 6) as pagerank from pr",
    "pagerank_named_edges": f"with recursive {_BRANDS}, {_pagerank('named')} select node as path, round(rank, 6) as pagerank from pr",
    "related_nations": f"""with recursive {_NATIONS}, pairs as (select distinct src, dst from nations where weight >= 2), both_ways as (select src, dst, 1.0 as weight from pairs union all select dst, src, 1.0 from pairs), seeds as (select 'NATION_3' as node, 1.0 as value),
      {_pagerank('both_ways', seeds='seeds')} select node as path, round(rank, 6) as score from pr where node <> 'NATION_3' order by round(rank, 12) desc, node limit 10""",
    "in_degree": f"with {_TRADE} select dst as path, count(distinct src) as in_degree from trade group by dst",
    "edge_weight_by_names": f"with {_BRANDS} select * from named",
    "rank_tiers": f"with recursive {_TRADE}, {_pagerank('trade')}, q as (select round(rank, 6) / (select round(max(rank), 6) from pr) as s from pr) select case when s >= 0.5 then 'hub' when s >= 0.15 then 'mid' else 'leaf' end as tier, count(*) as n from q group by all",
    "dependents": f"with {_TRADE}, g as (select dst as path, list(distinct src) as l from trade group by dst) select path, len(l)::bigint as n, array_to_string(list_sort(l)[1:5], ',') as first_five from g",
    "type_only_disjoint": f"with {_TRADE} select src, dst from trade where weight < 2",
    "ident_multiplier": f"with {_EXPORTS}, m as (select name from exports where path = 'Brand#1/ECONOMY') select * from {_multiplier('m')}",
    "symbol_rank": _symbol_rank(80),
    "symbol_rank_focus": _symbol_rank(30, ("Brand#1/ECONOMY", "nation/NATION_3")),
    "symbol_tail": f"with {_EXPORTS}, {_REFS} select path, name, min(kind) as kind from exports e where name not in (select name from refs) group by path, name",
    "token_digest": _symbol_rank(80, top="X").replace("\nX", _DIGEST),
    "find_symbol": _find("widget"),
    "find_symbol_kind": _find("_bolt_", "econ"),
    "owner_lookup": f"with {_EXPORTS} select distinct path, kind, false as local from exports where name = 'red widget' and contains(path, 'Brand#1')",
    "resolve_path": rf"""with {_PAGES}, q as (select distinct unnest([path, regexp_extract(path, '([0-9]+)/page', 1), upper(path), 'page.tsx', 'nothing']) as query from files),
      r as (select query, 1 as rung, path from q join files on query = path union all select query, 2, path from q join files on lower(query) = lower(string_split(path, '/')[-1]) union all select query, 3, path from q join files on contains(lower(path), lower(query))),
      g as (select query, rung, count(*) as n, min(path) as path from r group by all),
      b as (select * from g qualify row_number() over (partition by query order by n <> 1, case when n = 1 then rung else -rung end) = 1)
      select q.query, case when n = 1 then path end as path, coalesce(n, 0) as candidates from q left join b on b.query = q.query""",
    "suffix_match": f"with {_PAGES} select distinct path from files where path = 'page.tsx' or path like '%/page.tsx'",
    "tokenize_identifiers": f"select p_partkey, array_to_string({_tokens("p_name || 'X' || p_brand || 'X' || p_type")}, ' ') as tokens from part",
    "tokenize_urls": f"select page_id, array_to_string({_tokens('url')}, ' ') as tokens from pages",
    "lexical_df": f"with {_PROSE} select token, count(*) as n from (select path, unnest(list_distinct(tokens)) as token from corpus) group by token",
    "lexical_symbol_documents": f"with {_EXPORTS}, {_LEX} select path, name, kind, array_to_string(tokens, ' ') as tokens from corpus",
    "bm25_documents": f"with {_PROSE}, {_bm25([BM25_QUERY], 'path')} select * from placed where pos <= 50",
    "bm25_parts": f"with {_EXPORTS}, {_LEX}, {_bm25([FUSED_QUERY], 'path, name, kind')} select * from placed where pos <= 50",
    "bm25_rank_fusion": f"with {_EXPORTS}, {_RANKS}, {_LEX}, {_bm25([FUSED_QUERY], 'path, name, kind', True)} select * from placed where pos <= 50",
    "bm25_kind_after_cap": f"with {_EXPORTS}, {_RANKS}, {_LEX}, {_bm25([FUSED_QUERY], 'path, name, kind', True)} select path, name, kind, score, count(*) over () as total, pos from placed where pos <= 50 and contains(lower(kind), 'econ')",
    "content_search": f"with {_LINES.replace('{q}', 'licens')} select * from found order by path, line_no limit 40",
    "features": f"with {_PAGES} select feature, count(*) as n_files from files where feature is not null group by feature",
    "feature_members": f"with {_PAGES}, m as (select feature from files where feature is not null and contains(lower(feature), 'e') group by feature order by lower(feature) <> 'e', feature limit 1) select feature, path from files where feature in (select feature from m)",
    "page_links": f"with {_PAGES}, {_LINKS} select src, spec, dst from hits",
    "feature_external_dependents": f"with {_PAGES}, {_LINKS} select distinct src as path from hits where dst in (select path from files where feature = 'en') and src not in (select path from files where feature = 'en')",
    "edge_coverage": f"""with {_PAGES}, {_LINKS}, s as (select l.*, exists (select 1 from hits h where h.src = l.src and h.spec = l.spec) as ok from links l where spec like '/%')
      select count(*) as local_sites, count(*) filter (ok) as resolved_sites, round(count(*) filter (ok) / count(*), 4) as edge_coverage, (select count(*) from files) > 10 and round(count(*) filter (ok) / count(*), 4) < 0.15 as degraded from s""",
    "map_doctor": f"""with {_PAGES}, {_LINKS}, s as (select l.*, exists (select 1 from hits h where h.src = l.src and h.spec = l.spec) as ok from links l where spec like '/%'), c as (select round(count(*) filter (ok) / count(*), 4) as edge_coverage from s)
      select (select count(*) from files) as file_count, 0::bigint as skipped_count, edge_coverage, case when (select count(*) from files) > 10 and edge_coverage < 0.15 then 'degraded' else 'ok' end as status from c""",
    "census": _census("lang", "lang = 'en'", 0.1),
    "census_below_share": _census("source", "source = 'src0'", 0.9),
    "script_blocks": "select page_id::varchar as path, 'js' as lang, false as setup, trim(regexp_extract(html, '<script>(.*?)</script>', 1)) as script from pages where trim(regexp_extract(html, '<script>(.*?)</script>', 1)) <> ''",
    "transitive_dependents": f"with recursive {_SUPPLY} select path, hop from reached",
    "affected": f"with recursive {_SUPPLY} select path, hop from reached where path like 'supplier/%'",
    "callers_depth1": f"""with {_STEPS}, c as (select caller_file, caller_line, min(caller_name) as caller_name, min(caller_decl_line) as caller_decl_line from steps where callee_file = 'user/8' and callee_name = 'error' group by all)
      select caller_file, caller_line, caller_name, caller_decl_line, count(*) over () as total from c left join step_ranks on path = caller_file order by coalesce(rank, 0) desc, caller_file, caller_line limit 50""",
    "calls_depth1": f"""with {_STEPS}, c as (select callee_file, callee_name, callee_line, min(callee_kind) as callee_kind from steps where caller_file = 'user/8' and caller_name = 'error' and not (callee_file = 'user/8' and callee_name = 'error') group by all)
      select callee_file, callee_name, callee_line, callee_kind, count(*) over () as total from c left join step_ranks on path = callee_file order by coalesce(rank, 0) desc, callee_file, callee_name limit 50""",
    "callers_closure": f"""with {_STEPS}, {_callers("user/8", "signup")}""",
    "calls_closure": f"""with recursive {_STEPS}, e as materialized (select distinct caller_file, caller_name, callee_file, callee_name, callee_line from steps),
      r(f, n, l, d) as (select 'user/8', 'signup', 0, 0 union select callee_file, callee_name, callee_line, d + 1 from r join e on caller_file = f and caller_name = n where d < 4)
      select f as file, n as name, l::int as line, min(d)::int as depth from r where not (f = 'user/8' and n = 'signup') group by f, n, l""",
    "route_table": f"with {_ROUTES} select url, kind, path, methods, layouts, boundary from routes",
    "route_match": rf"""with {_ROUTES}, asked as (select regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) as query from pages union select unnest(['/api/com/x/y', '//en//7/', 'page.tsx', '/none/of/these/parts'])),
      q as (select query, regexp_replace('/' || regexp_replace(query, '^/+|/+$', '', 'g'), '/+', '/', 'g') as norm from asked),
      p as (select *, list_filter(string_split(norm, '/'), lambda x: x <> '') as parts from q), r as (select distinct url, path, list_filter(string_split(url, '/'), lambda x: x <> '') as own from routes),
      m as (select query, url, path, (url = norm or path = query or ends_with(path, '/' || query)) as direct, own, parts from p, r),
      f as (select * from m where direct or ((len(list_filter(own, lambda s: starts_with(s, '*'))) > 0 or len(own) = len(parts))
        and len(list_filter(list_filter(own, lambda s: not starts_with(s, '*')), lambda s, i: not (starts_with(s, ':') or coalesce(s = parts[i], false)))) = 0))
      select query, url, path from f where direct or not (select bool_or(direct) from f f2 where f2.query = f.query)""",
    "neighborhood_export": f"with recursive {_DRAWN} select src, dst from ends",
    "export_dot": f"""with recursive {_DRAWN}, l as (select 0 as part, '' as sort, 'digraph map {{' as line union all select 1, '', '  rankdir=LR;' union all select 2, path, '  "' || path || '" [class="' || tier || '"];' from dn
      union all select 3, src || chr(1) || dst, '  "' || src || '" -> "' || dst || '";' from ends union all select 9, '', '}}') select row_number() over (order by part, sort, line)::int as line_no, line from l""",
    "export_mermaid": f"""with recursive {_DRAWN}, ids as (select *, row_number() over (order by rank desc, path) - 1 as i from dn), l as (select 0 as part, 0 as x, 0 as y, 'flowchart LR' as line union all select 1, i, 0, '  n' || i || '["' || path || '"]:::' || tier from ids
      union all select 2, a.i, b.i, '  n' || a.i || ' --> n' || b.i from ends join ids a on a.path = src join ids b on b.path = dst) select row_number() over (order by part, x, y)::int as line_no, line from l""",
    "snapshot_diff": f"with {_SNAP} select coalesce(old.path, new.path) as path, case when old.path is null then 'added' when new.path is null then 'removed' else 'modified' end as change from old full join new on old.path = new.path where old.path is null or new.path is null or old.token <> new.token",
    "fingerprint": f"""with {_SNAP}, h as (select o_orderpriority, sha1(path || ':' || coalesce(token, '')) as h from o), p as (select o_orderpriority, substr(h, 1, 3) as p, sha1(string_agg(h, chr(10) order by h)) as h from h group by all)
      select o_orderpriority, sha1(string_agg(h, chr(10) order by p)) as fingerprint from p group by all""",
    "path_functions": rf"""with {_ROUTE_FILES}, s as (select path, string_split(path, '/') as p from route_files), g as (select *, list_filter(p[2:len(p) - 1], lambda x: not regexp_matches(x, '^[(\[@]')) as f from s)
      select path, p[-1] as base, regexp_replace(p[-1], '\.[^.]+$', '') as stem, lower(string_split(path, '.')[-1]) as ext, coalesce(f[1], '') as feature, len(p)::int - 1 as depth, ceil(length(path) / 4.0)::bigint as tokens, '/' || path as url,
      case when regexp_matches(p[-2], '^\(.+\)$') then '' when starts_with(p[-2], '[...') then '*' || p[-2][5:length(p[-2]) - 1] when starts_with(p[-2], '[') then ':' || p[-2][2:length(p[-2]) - 1] else p[-2] end as segment from g""",
    "eval_precision_recall": f"""with {_STEPS}, c as (select distinct callee_name as q, caller_file || '/' || caller_name as p from steps), x as (select q, count(*) filter (contains(p, 'error') and contains(p, 'user/1')) as hit, count(*) filter (contains(p, 'error')) as f, count(*) filter (contains(p, 'user/1')) as t from c where contains(p, 'error') or contains(p, 'user/1') group by q),
      y as (select case when f > 0 then hit / f when t = 0 then 1.0 else 0.0 end as p, case when t > 0 then hit / t else 1.0 end as r from x), z as (select count(*) as queries, avg(p) as p, avg(r) as r from y)
      select queries, round(p, 6) as "precision", round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f1 from z""",
    "any_router_file": f"with {_PAGES} select 'file' as answer, min(path) as path, null::varchar as name, null::varchar as detail, 1 as pos, 1::bigint as total from files",
    "any_router_symbol": _router_symbol("red widg"),
    "any_router_lexical": f"with {_EXPORTS}, page_ranks as (select 1), {_RANKS}, {_LEX}, {_bm25(['widget economy'], 'path, name, kind', True)} select 'lexical' as answer, path, name, score::varchar as detail, pos, total from placed where pos <= 50",
    "any_router_content": f"with {_LINES.replace('{q}', 'of the')} select 'content' as answer, path, line_no::varchar as name, line as detail, 1 as pos, total from found order by path, found.line_no limit 40",
    "incremental_equals_full": "with f as (select strftime(ts, '%Y-%m-%d') || '/' || user_id as path, event_type as name, count(*) as n from events where user_id % 5 <> 0 and (user_id % 5 <> 1 or event_type = 'view') group by all) select name, count(distinct path) as files, sum(n)::bigint as n from f group by name",
    "source_listing": f"with {_TREE}, p as (select path from nn union all select path from rr union all select path from ss union all select path from tt union all select unnest(['src/nations/index.ts', 'src/index.ts', 'src/Card.vue', 'types/globals.d.ts'])) select path, path <> 'types/globals.d.ts' as is_node from p",
    "source_symbols": f"""with {_TREE}, passed as ({_PASSED}) select path, 'REGION' || k as name, 'VariableDeclaration' as kind, true as is_export, null::varchar as defined_in, false as is_default from rr
      union all select path, 'Shape' || k, 'InterfaceDeclaration', true, null, false from rr union all select path, 'region' || k, 'FunctionDeclaration', true, null, true from rr
      union all select path, name, kind, true, null, false from passed union all select path, 'local' || k, 'VariableDeclaration', false, null, false from nn union all select path, 'helper' || k, 'FunctionDeclaration', false, null, false from nn
      union all select path, unnest(['Supplier' || k, 'Alias' || k]), 'VariableDeclaration', true, null, false from ss union all select path, unnest(['lazy', 'Card' || k]), 'VariableDeclaration', false, null, false from ss
      union all select unnest(['src/nations/index.ts', 'src/index.ts']), name, kind, true, path, false from passed union all select 'src/index.ts', 'First', 'ClassDeclaration', true, 'src/nations/n0.ts', false
      union all select 'src/Card.vue', 'shown', 'VariableDeclaration', false, null, false""",
    "source_imports": f"with {_SITES} select * from sites",
    "source_edges": f"""with {_SITES}, e as (select path as src, target as dst, unnest(string_split(names, ',')) as name, target from sites where not type_only and target is not null),
      d as (select distinct src, dst, case when name = 'default' then 'region' || regexp_extract(dst, '([0-9]+)', 1) else name end as name from e)
      select src, dst, coalesce(string_agg(name, ',' order by name) filter (name <> ''), '') as names, greatest(count(*) filter (name <> ''), 1)::double as weight from d group by src, dst""",
    "source_type_edges": f"with {_SITES} select distinct path as src, target as dst from sites where type_only",
    "source_directives": f"with {_TREE} select path, 'client' as rsc from nn where k % 2 = 1",
    "source_calls": f"with {_CALLS} select * from calls",
    "source_callers": f"""with {_TREE}, zero as (select * from nn where r = 0) select path as file, 'nation' || k as name, 8 as line, 1 as depth, null::varchar as via, false as truncated from zero
      union all select t.path, '<module>', 2, 2, z.path || ':nation' || z.k || ':8', false from tt t join zero z on z.k = t.k union all select s.path, 'Supplier' || s.k, 4, 2, z.path || ':nation' || z.k || ':8', false from ss s join zero z on z.k = s.n""",
    "source_health": f"""with {_SITES}, l as (select target from sites where form in ('static', 'side_effect') and not type_only and (spec like '.%' or spec like '@/%')), c as (select round(count(target) / count(*), 4) as edge_coverage from l),
      f as (select (select count(*) from nn) * 2 + (select count(*) from rr) + (select count(*) from ss) + 3 as n) select n::bigint as file_count, 0::bigint as skipped_count, edge_coverage, edge_coverage < 0.15 as degraded from c, f""",
    "source_affected": f"with {_REACH} select path, hop, path like '%/__tests__/%' as is_test from reach",
    "source_covered": f"with {_REACH} select 'src/regions/r0.ts' as file, count(*) as dependents, count(*) filter (path like '%/__tests__/%') as tests, count(*) filter (path like '%/__tests__/%') > 0 as covered from reach",
    "source_owner": "select 'src/nations/n3.ts' as path, 'FunctionDeclaration' as kind, unnest([false, true]) as local",
    "source_stored": f"""with {_SITES}, {_CALLS.replace(_TREE + ", ", "")}, f as (select (select count(*) from nn) * 2 + (select count(*) from rr) + (select count(*) from ss) + 3 as n)
      select unnest(['files', 'ranks']) as name, n::bigint as n from f union all select 'edges', count(distinct (path, target)) from sites where not type_only and target is not null union all select 'type_edges', count(distinct (path, target)) from sites where type_only
      union all select 'calls', count(*) from calls union all select 'meta', 1""",
    "source_path_rules": """with f as (select 'n' || n_nationkey as top from nation) select top || '/k' as folder, unnest(['./a/../b', '../x/./y', '@/q', 'react', '#z']) as spec,
      unnest([top || '/k/b', top || '/x/y', top || '/k/@/q', top || '/k/react', top || '/k/#z']) as path, unnest([true, true, true, false, true]) as local from f""",
    "eval_hit_rate": f"""with {_STEPS}, c as (select callee_name as query, caller_file || '/' || caller_name as path, count(*) as n from steps group by all), r as (select *, row_number() over (partition by query order by n desc, path) as pos from c),
      b as (select query, min(pos) filter (path not like '%/view') as pos from r where pos % 3 = 1 group by query) select count(*) as queries, round(avg(case when pos <= 1 then 1.0 else 0.0 end), 6) as top1, round(avg(case when pos <= 3 then 1.0 else 0.0 end), 6) as top3 from b""",
    "eval_token_ratio": "with t as (select ceil(length(text) / 4.0) as b, ceil(length(string_split(text, chr(10))[1]) / 4.0) as a from documents where text is not null) select count(*) as cases, round(median(b / a), 6) as median_ratio from t where a > 0",
}
