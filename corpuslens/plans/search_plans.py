"""Registered queries that search for a whole table of terms, texts or quotations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.operators import inverted, lookup, quotes, search
from corpuslens.operators import tokens as tk
from corpuslens.operators.tokens import words_of
from corpuslens.plans.registry import KEY_DF, TOK, WORDS, chat_tokens, query
from corpuslens.sources import sinks
from corpuslens.sources.stored import shared_path
from corpuslens.sources.tables import chat, documents, table

#: Words of the longest query below.
_MOST = 5


def _full_text_sql(asked: str, tokens: str, limit: int | None, rare: int = 60) -> str:
    """Rows of full-text search: ``asked`` gives (qid, ws), ``tokens`` (pid, grp, ord, key, pos)."""
    chain = "s0 as (select qid, pid, min(pos) as at from h where i = 0 group by 1, 2)"
    for k in range(1, _MOST):
        chain += f", s{k} as (select s.qid, s.pid, min(h.pos) as at from s{k - 1} s join h on h.qid = s.qid and h.pid = s.pid and h.i = {k} and h.pos > s.at group by 1, 2)"
    ordered = " union all ".join(f"select qid, pid, {k + 1} as n from s{k}" for k in range(_MOST))
    return f"""
aq as ({asked}), tk as ({tokens}),
w as (select qid, len(ws) as n, unnest(ws) as key, unnest(range(len(ws))) as i from aq where len(ws) >= 2),
h as (select w.qid, w.n, w.i, tk.pid, tk.pos from w join tk using (key)),
pl as (select distinct pid, grp, ord from tk),
pa as (select qid, n, pid, count(distinct i) as matched from h group by 1, 2, 3),
po as (select qid, pid, array_to_string(list_sort(list(distinct pos)), ' ') as positions from h group by 1, 2),
be as (select qid, max(matched) as best from pa group by 1),
df as (select qid, i, count(distinct pid) as df from h where n = 2 group by 1, 2),
ra as (select qid, i from (select *, row_number() over (partition by qid order by df, i) as r from df) where r = 1 and df <= {rare}),
ch as (select pa.* from pa join be using (qid) where matched = n or (best < n and n >= 3 and matched = n - 1)
  union all select pa.* from pa join be using (qid) join ra using (qid) where n = 2 and best < 2 and exists (select 1 from h where h.qid = pa.qid and h.pid = pa.pid and h.i = ra.i)),
st as (select distinct qid, pid, pos - i as start, i from h),
rn as (select qid, pid, start, count(*) as run from (select *, row_number() over (partition by qid, pid, start order by i) - 1 as k from st) where k = i group by 1, 2, 3),
ru as (select qid, pid, max(run) as run from rn group by 1, 2),
{chain}, od as ({ordered}),
sc as (select ch.qid, ch.pid, matched::int as matched, coalesce(ru.run, 0)::int as run, od.n is not null as ordered, positions,
    (coalesce(ru.run, 0) * 10000 + case when od.n is not null then 1000 else 0 end + matched * 10)::int as score, grp, ord
  from ch join pl using (pid) join po on po.qid = ch.qid and po.pid = ch.pid left join ru on ru.qid = ch.qid and ru.pid = ch.pid left join od on od.qid = ch.qid and od.pid = ch.pid and od.n = ch.n),
fr as (select *, row_number() over (partition by qid order by score desc, grp, ord) as rank from sc){'' if limit is None else f', fl as (select * from fr where rank <= {limit})'}
select qid, pid, matched, run, ordered, score, positions, rank::int as rank from {'fr' if limit is None else 'fl'}"""


_DOC_TOKENS = f"select pid, grp, ord, unnest(ws) as key, unnest(range(len(ws)))::int as pos from (select doc_id::varchar as pid, source as grp, doc_id as ord, {WORDS.format('text')} as ws from documents)"


@query("sr07_stored_lists", f"q as ({_DOC_TOKENS}) select key as term, count(distinct pid) as passages, count(*) as places from q group by 1")
def sr07(spark, folder):
    """What a stored index holds of each term."""
    path = shared_path(spark, "index")
    inverted.write_index(documents(spark, folder), path)
    return inverted.stored_lists(spark, path).groupBy("term").agg(F.sum("n_passages").alias("passages"), F.sum(F.size("hits")).cast("long").alias("places"))


_ASKED = f"select concat(conv_id, ':', turn) as qid, list_slice({WORDS.format('text')}, 2, 3 + (conv_id % 4)) as ws from conversations where turn = 0"


@query("sr08_full_text_of_many", "with " + _full_text_sql(_ASKED, _DOC_TOKENS, 200))
def sr08_many(spark, folder):
    """Two to five words of what each conversation opens with, looked up in all documents at once."""
    path = shared_path(spark, "index")
    inverted.write_index(documents(spark, folder), path)
    words = F.slice("ws", F.lit(2), (F.col("grp") % 4 + 2).cast("int"))
    asked = chat(spark, folder).where("ord = 0").select(F.col("pid").alias("qid"), "grp", words_of(F.col("text")).alias("ws")).select("qid", F.transform(words, lambda w: F.array(w)).alias("words"))
    return sinks.flat(inverted.search(spark, path, asked))


@query("sr08_full_text", "with " + TOK.strip() + ", " + _full_text_sql("select '' as qid, ['of', 'the', 'that'] as ws", "select pid, grp, ord, key, pos from t", 200).replace("select qid, pid, matched, run, ordered, score, positions, rank::int as rank", "select pid, grp, ord, matched, run, ordered, positions, score"))
def sr08(spark, folder):
    return sinks.flat(search.full_text(search.content_index(chat_tokens(spark, folder), False), [["of"], ["the"], ["that"]]))


# --- forgiving lookup ------------------------------------------------------------------------------------------------------

#: DuckDB's edit distance counts bytes: letters of two bytes are changed for capitals, which no word has.
_EDITS = "levenshtein(translate(key, 'äöüßéèêàâçñáíóúîôûëï', 'ABCDEFGHIJKLMNOPQRST'), translate(qid, 'äöüßéèêàâçñáíóúîôûëï', 'ABCDEFGHIJKLMNOPQRST'))"
_ITEM_WORDS = f"qs as (select distinct unnest({WORDS.format('text')}) as qid from benchmark)"


def _item_words(spark, folder):
    return table(spark, folder, "benchmark").select(F.explode(words_of(F.col("text"))).alias("qid")).distinct()


@query("sr05_resolve_many", f"""{TOK}, {KEY_DF}, {_ITEM_WORDS},
m as (select qid, key, case when key = qid then 3 when starts_with(key, qid) then 2 else 1 end as tier, 0 as dist, df from qs join df on starts_with(key, qid) or length(qid) >= 3 and contains(key, qid)),
z as (select qid, key, 0 as tier, {_EDITS} as dist, df from qs join df on abs(length(key) - length(qid)) <= 2 where qid not in (select qid from m)),
u as (select * from m union all select * from z where dist <= case when length(qid) <= 4 then 1 else 2 end)
select qid, key, tier, dist::int as dist, df, rank::int as rank from (select *, row_number() over (partition by qid order by tier desc, dist, df desc, key) as rank from u) where rank <= 12""")
def sr05_many(spark, folder):
    """Every word of the benchmark among the words of the conversations."""
    path = shared_path(spark, "forms")
    known = tk.document_frequency(chat_tokens(spark, folder))
    lookup.write_forms(known.select(F.col("key").alias("alias"), "key"), path)
    return lookup.resolve_terms(spark, path, _item_words(spark, folder).select("qid", F.array("qid").alias("variants")), known)


@query("sf26_name_hints", f"""{TOK}, {_ITEM_WORDS}, na as (select distinct key from t),
m as (select qid, key, case when contains(key, qid) or starts_with(qid, key) then 0 else {_EDITS} end as dist from qs join na on contains(key, qid) or starts_with(qid, key) or abs(length(key) - length(qid)) <= 2)
select qid, key, dist::int as dist, rank::int as rank from (select *, row_number() over (partition by qid order by dist, key) as rank from m where dist <= 2) where rank <= 5""")
def sf26_hints(spark, folder):
    """The words of the conversations that are nearest to each word of the benchmark, taken as names."""
    path = shared_path(spark, "names")
    names = chat_tokens(spark, folder).select("key").distinct()
    lookup.write_forms(names.select(F.col("key").alias("alias"), "key"), path)
    return lookup.near_names(spark, path, _item_words(spark, folder).select("qid", F.col("qid").alias("name")))


# --- quotations ------------------------------------------------------------------------------------------------------------


def _items_in_documents(spark, folder, joined: bool):
    """Places of the benchmark's items in the documents, a source being one text."""
    alone = lambda w: F.array(w)
    text = quotes.running_text(documents(spark, folder), F.transform(words_of(F.col("text")), alone))
    asked = quotes.quotations(table(spark, folder, "benchmark").withColumnRenamed("item_id", "qid"), words_of(F.col("text")), alone)
    if not joined:
        asked = asked.withColumn("joined", F.transform("words", lambda w: F.array().cast("array<string>")))
    return quotes.locate_quotations(text, asked)


@query("sr12_quotations", f"""with recursive q as (select item_id as qid, {WORDS.format('text')} as ws from benchmark),
t as (select source as grp, doc_id as ord, key, pos, n, row_number() over (partition by source order by doc_id, pos) - 1 as wno from (select *, unnest(ws) as key, unnest(range(len(ws))) as pos, len(ws) as n from (select *, {WORDS.format('text')} as ws from documents))),
m(qid, grp, place, wno, j) as (
  select qid, grp, wno, wno, case when key = ws[1] then 1 else 2 end from t join q on key = ws[1] or key = ws[1] || ws[2]
  union all
  select m.qid, m.grp, m.place, t.wno, case when t.key = q.ws[m.j + 1] then m.j + 1 else m.j + 2 end
  from m join q using (qid) join t on t.grp is not distinct from m.grp and t.wno = m.wno + 1 where m.j < len(q.ws) and (t.key = q.ws[m.j + 1] or t.key = q.ws[m.j + 1] || q.ws[m.j + 2])),
f as (select m.* from m join q using (qid) where m.j = len(q.ws))
select f.qid, t.grp, t.ord, t.ord::varchar as pid, array_to_string(list_sort(list(distinct t.pos)), ' ') as positions, count(distinct t.pos) = any_value(t.n) as whole
from f join t on t.grp is not distinct from f.grp and t.wno between f.place and f.wno group by 1, 2, 3""")
def sr12_quotations(spark, folder):
    """What each benchmark item touches of the documents, over their borders too."""
    return sinks.flat(quotes.quoted_passages(_items_in_documents(spark, folder, True)))


@query("sr12_locate", f"""
q as (select item_id as qid, {WORDS.format('text')} as ws from benchmark),
d as (select doc_id::varchar as pid, source as grp, doc_id as ord, {WORDS.format('text')} as ws from documents),
s as (select *, unnest(range(len(ws)))::int as start from d),
m as (select q.qid, s.pid, s.grp, s.ord, s.start, q.ws as q, s.ws as w from s join q on s.ws[s.start + 1] = q.ws[1] and coalesce(s.ws[s.start + 2], '') = coalesce(q.ws[2], ''))
select qid, pid, grp, ord, start, len(w) = len(q) as whole from m where w[start + 1 : start + len(q)] = q""")
def sr12(spark, folder):
    """Those that lie within one document, word for word."""
    places = _items_in_documents(spark, folder, False).withColumn("parts", F.count("*").over(Window.partitionBy("qid", "grp", "place")))
    return places.where("parts = 1").select("qid", "pid", "grp", "ord", F.col("at").cast("int").alias("start"), (F.col("count") == F.col("words")).alias("whole"))
