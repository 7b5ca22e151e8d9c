"""Registered queries of the graph of words and passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.operators import graph
from corpuslens.operators import tokens as tk
from corpuslens.plans.registry import TOK, chat_tokens, query, rounded

_STOPS = ", ".join(f"'{w}'" for w in tk.STOP[:5])
_WEIGHT = "round(1 / log2(greatest({}, 1) + 2), 6)"
_ONE = f"""{TOK}, k as (select distinct key, pid, grp, ord from t where key not in ({_STOPS})), d as (select key, count(*) as df from k group by 1),
own as (select key, df from k join d using (key) where pid = '0:0'), ex as (select i, key from (values (0, 'with'), (1, 'from'), (2, 'for')) v(i, key) join own using (key)),
sh as (select pid, count(*) as shared from k where key in (select key from own) and pid <> '0:0' group by 1),
re as (select *, row_number() over (partition by key order by shared desc, grp, ord) as rank from k join ex using (key) join sh using (pid)),
ke as (select *, row_number() over (partition by pid order by i) as first from re join d using (key) where rank <= 10),
mo as (select key, count(*) as n from re group by 1 having count(*) > 10)"""


@query("gr01_graph_nodes", f"""{_ONE} select '0:0' as id, 'passage' as kind, null::varchar as parent, 0 as level, 0::bigint as df
union all select key, 'word', '0:0', 1, df from own union all select pid, 'passage', key, 2, shared from ke where first = 1 union all select 'more:' || key, 'more', key, 2, n - 10 from mo""")
def gr01(spark, folder):
    return graph.expand(chat_tokens(spark, folder), "0:0", ["with", "from", "for"], stops=tk.STOP[:5])[0].fillna(0, "df")


@query("gr01_graph_links", f"""{_ONE} select '0:0' as source, key as target, 'tree' as kind, {_WEIGHT.format('df')} as weight from own
union all select key, pid, case when first = 1 then 'tree' else 'loop' end, {_WEIGHT.format('df')} from ke""")
def gr01_links(spark, folder):
    return rounded(graph.expand(chat_tokens(spark, folder), "0:0", ["with", "from", "for"], stops=tk.STOP[:5])[1], "weight", digits=6)


def _levels_sql(levels: int, branch: int) -> str:
    """Level by level: p{i} has passages and w{i} words, both with their place (o) in the order of the level."""
    out = [f"""{TOK}, k as (select pid, grp, ord, key, min(pos) as idx from t group by 1, 2, 3, 4), d as (select key, count(*) as df from k group by 1),
sh as (select pid, count(*) as shared from k where key in (select key from k where pid = '0:0') group by 1),
p0 as (select '0:0' as pid, 1 as o, null::varchar as parent, null::bigint as shared)"""]
    for level in range(1, levels + 1):
        if level % 2:
            out.append(f"w{level} as (select key || '@' || pid as id, key, pid, df, row_number() over (order by p.o, idx) as o from p{level - 1} p join k using (pid) join d using (key) where key not in ({_STOPS}))")
            continue
        seen = " union all ".join(f"select pid from p{i}" for i in range(0, level, 2))
        out.append(f"""x{level} as (select id, df, w.o, k.pid as target, coalesce(sh.shared, 0) as shared, row_number() over (partition by id order by coalesce(sh.shared, 0) desc, grp, ord) as rank from w{level - 1} w join k using (key) left join sh on sh.pid = k.pid where k.pid <> w.pid),
y{level} as (select *, row_number() over (partition by target order by o) = 1 and target not in ({seen}) as first from x{level} where rank <= {branch}),
p{level} as (select target as pid, row_number() over (order by o, rank) as o, id as parent, shared from y{level} where first)""")
    nodes = ["select pid as id, 'passage' as kind, parent, 0 as level, 0::bigint as n from p0"]
    links = []
    for level in range(1, levels + 1):
        if level % 2:
            nodes.append(f"select id, 'word', pid, {level}, df from w{level}")
            links.append(f"select pid as source, id as target, 'tree' as kind, {_WEIGHT.format('df')} as weight from w{level}")
        else:
            nodes += [f"select pid, 'passage', parent, {level}, shared from p{level}", f"select 'more:' || id, 'more', id, {level}, df - 1 - {branch} from w{level - 1} where df - 1 > {branch}"]
            links += [f"select id, target, case when first then 'tree' else 'loop' end, {_WEIGHT.format('df')} from y{level}", f"select id, 'more:' || id, 'tree', {_WEIGHT.format('df')} from w{level - 1} where df - 1 > {branch}"]
    return ", ".join(out), " union all ".join(nodes), " union all ".join(links)


_WITH, _NODES, _LINKS = _levels_sql(4, 3)


def _grown(spark, folder):
    return graph.grow(chat_tokens(spark, folder), "0:0", 4, branch=3, stops=tk.STOP[:5], budget=1_000_000)


@query("gr01_grown_nodes", f"{_WITH} {_NODES}")
def gr01_grown(spark, folder):
    """Words, passages, their words and their passages around the first turn."""
    return _grown(spark, folder).nodes.fillna(0, "n")


@query("gr01_grown_links", f"{_WITH} {_LINKS}")
def gr01_grown_links(spark, folder):
    return rounded(_grown(spark, folder).links.select("source", "target", "kind", F.col("weight")), "weight", digits=6)

