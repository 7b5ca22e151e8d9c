"""Registered queries of passages that are nearly the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.operators import association as assoc
from corpuslens.operators import similarity
from corpuslens.operators import tokens as tk
from corpuslens.plans.registry import KEYNESS, WORDS, chat_tokens, document_words, query, rounded
from corpuslens.sources import sinks
from corpuslens.sources.stored import materialise

#: Pairs of different texts whose words differ by two at most: what is between their common beginning and end is short, or
#: becomes equal when each end of it loses one word.
_TWINS = f"""
d as (select doc_id::varchar as pid, {WORDS.format('text')} as ws from documents),
u as (select min(pid) as pid, ws, len(ws) as n from d where len(ws) >= 4 group by ws),
p0 as (select x.pid as a, y.pid as b, x.ws as wa, y.ws as wb, x.n as na, y.n as nb, least(x.n, y.n) as k from u x join u y on x.pid < y.pid and abs(x.n - y.n) <= 2),
p1 as (select *, coalesce(list_position(list_transform(range(1, k + 1), lambda i: wa[i] = wb[i]), false) - 1, k) as pre from p0),
p2 as (select *, coalesce(list_position(list_transform(range(0, k - pre), lambda i: wa[na - i] = wb[nb - i]), false) - 1, k - pre) as suf from p1),
p3 as (select *, wa[pre + 1 : na - suf] as am, wb[pre + 1 : nb - suf] as bm, na - suf - pre as x, nb - suf - pre as y from p2),
p4 as (select *, case when x + y <= 2 then 0 when x >= 1 and y >= 1 and am[2 : x] = bm[1 : y - 1] then 1 when x >= 2 and am[2 : x - 1] = bm then 2
    when x >= 1 and y >= 1 and bm[2 : y] = am[1 : x - 1] then 3 when y >= 2 and bm[2 : y - 1] = am then 4 end as kind from p3),
tw as (select *, (case when kind = 0 then x + y else 2 end)::int as changed from p4 where kind is not null
  and len(list_intersect(list_transform(range(1, na - 2), lambda i: array_to_string(wa[i : i + 3], ' ')), list_transform(range(1, nb - 2), lambda i: array_to_string(wb[i : i + 3], ' ')))) > 0)"""


@query("sm08_near_twins", f"with {_TWINS.strip()} select a, b, ((na + nb - changed) // 2)::int as same, changed from tw where (na + nb - changed) // 2 >= 3")
def sm08(spark, folder):
    return similarity.near_twins(document_words(spark, folder), classes=True)


@query("sm09_twin_scripts", f"""with {_TWINS.strip()} select a, b, ((na + nb - changed) // 2)::int as same, changed, round((na + nb - changed) / (na + nb), 6) as ratio,
  array_to_string(case kind when 0 then am when 1 then am[1:1] when 2 then list_concat(am[1:1], am[x:x]) when 3 then am[x:x] else [] end, ' ') as removed,
  array_to_string(case kind when 0 then bm when 1 then bm[y:y] when 2 then [] when 3 then bm[1:1] else list_concat(bm[1:1], bm[y:y]) end, ' ') as added
from tw where (na + nb - changed) // 2 >= 3""")
def sm09(spark, folder):
    """What has to go from one and to come from the other of each two near twins, along the steps between them."""
    t = document_words(spark, folder)
    pairs = materialise(similarity.near_twins(t, classes=True).select("a", "b"), "twins", True)
    wanted = pairs.select(F.col("a").alias("pid")).union(pairs.select("b")).distinct()
    words = similarity.word_rows(t).join(F.broadcast(wanted) if pairs.count() <= similarity.MOST_SENT else wanted, "pid", "left_semi")
    side = lambda c: words.select(F.col("pid").alias(c), F.col("ws").alias(f"w{c}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", similarity.word_diff(F.col("wa"), F.col("wb")).alias("d"), similarity.diff_operations(F.col("wa"), F.col("wb")).alias("ops"))
    of = lambda op: F.transform(F.filter("ops", lambda x: x["op"] == op), lambda x: x["word"])
    return sinks.flat(rounded(rows.select("a", "b", "d.same", "d.changed", "d.ratio", of("del").alias("removed"), of("ins").alias("added")), "ratio", digits=6))


@query("sm19_seams", f"""{KEYNESS}, tp as (select grp, key from (select *, row_number() over (partition by grp order by round(ll, 9) desc, key) as rank from kn) where rank <= 25),
gr as (select grp, row_number() over (order by grp) as i from (select distinct grp from t)), pr as (select x.grp as a, y.grp as b from gr x join gr y on y.i = x.i + 1),
ps as (select *, row_number() over (partition by grp order by ord) as s, row_number() over (partition by grp order by ord desc) as e from (select distinct grp, pid, ord from t)),
rt as (select distinct pid, root as key from t where root is not null),
se as (select a, b, array_to_string(list_sort(list(distinct key)), ' ') as seam from pr join (select distinct grp as a, key from ps join rt using (pid) where e <= 3) using (a) join (select distinct grp as b, key from ps join rt using (pid) where s <= 3) using (b, key) group by 1, 2),
sk as (select a, b, array_to_string(list_sort(list(distinct key)), ' ') as shared_keys from pr join (select grp as a, key from tp) using (a) join (select grp as b, key from tp) using (b, key) group by 1, 2)
select a, b, coalesce(shared_keys, '') as shared_keys, coalesce(seam, '') as seam from pr left join sk using (a, b) left join se using (a, b) where shared_keys is not null or seam is not null""")
def sm19(spark, folder):
    t = chat_tokens(spark, folder)
    return similarity.seams(t, assoc.top_keys(assoc.keyness(t, stops=tk.STOP)))
