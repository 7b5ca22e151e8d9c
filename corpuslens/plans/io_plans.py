"""Registered queries that write files from tables, read them back, or shape rows for output."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.operators import shaping
from corpuslens.plans.registry import query
from corpuslens.sources import files, sinks
from corpuslens.sources.stored import shared_path
from corpuslens.sources.tables import table


@query("sc02_lines_in_splits", "select doc_id, unnest(ls) as value, unnest(range(1, len(ls) + 1)) as nth from (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null)")
def sc02(spark, folder):
    """Documents written to text files, a line that begins each, and read back in splits: every line with its document and place."""
    path = shared_path(spark, "lines")
    docs = table(spark, folder, "documents").where("text is not null")
    docs.select(F.concat(F.lit("#DOC# "), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text")).alias("value")).write.text(path)
    head = F.regexp_extract("value", r"^#DOC# (\d+)$", 1)
    lines = files.open_entries(files.read_lines(spark, path), head != "")
    heads = lines.where("line = entry").select("file", "entry", head.cast("long").alias("doc_id"))
    return lines.where("line > entry").join(heads, ["file", "entry"]).select("doc_id", "value", (F.col("line") - F.col("entry")).alias("nth"))


@query("sc06_shard_lookup", "select distinct l.* from labels l join documents d using (doc_id) where d.lang = 'de'")
def sc06(spark, folder):
    """The labels of the documents of a language, from a table in folders by the hash of their id."""
    path = shared_path(spark, "shards")
    sinks.write_shards(table(spark, folder, "labels").withColumn("id", F.col("doc_id").cast("string")), path, "id")
    wanted = table(spark, folder, "documents").where("lang = 'de'").select(F.col("doc_id").cast("string").alias("id"))
    return sinks.look_up(spark, path, "id", wanted).drop("id").distinct()


@query("sk02_ragged_cells", "select event_id, json_extract_string(props, '$.k') as k from events")
def sk02(spark, folder):
    """A cell for each key that the properties of any event have."""
    return sinks.spread(table(spark, folder, "events").select("event_id", "props"), "props", [F.col("event_id")])


_MOST = 2000


def _clip(text: str, most: int) -> str:
    return f"case when length({text}) > {most} then {text}[1:{most}] || '… [clipped: ' || (length({text}) - {most}) || ' more characters]' else {text} end"


_JSON = "to_json({{'conv_id': conv_id, 'turns': {}}})::varchar"
_TURN = "{{'turn': x.turn, 'role': x.role, 'text': {}}}"


@query("pr04_shaped_conversations", f"""with c as (select conv_id, list({{'turn': turn, 'role': role, 'text': text}} order by turn) as turns from conversations group by 1),
a as (select *, length({_JSON.format('turns')}) > {_MOST} as truncated, list_transform(turns, lambda x: {_TURN.format(_clip('x.text', shaping.LONG))}) as t1 from c),
b as (select *, length({_JSON.format('t1')}) > {_MOST - shaping.RESERVE} as halve, greatest(1, len(t1) >> coalesce(list_position(list_transform(range(0, 12), lambda k: length({_JSON.format('t1[1 : greatest(1, len(t1) >> k)]')}) <= {_MOST - shaping.RESERVE} or (len(t1) >> k) <= 1), true) - 1, 0)) as n from a),
d as (select *, case when truncated and halve then t1[1 : n] when truncated then t1 else turns end as t2 from b),
e as (select *, truncated and length({_JSON.format('t2')}) > {_MOST - shaping.RESERVE} as last from d)
select conv_id, case when last then {_JSON.format(f"list_transform(t2, lambda x: {_TURN.format(_clip('x.text', shaping.SHORT))})")} else {_JSON.format('t2')} end as text, truncated from e""")
def pr04(spark, folder):
    """Each conversation as JSON of a few thousand characters at most."""
    turn = F.struct("turn", "role", "text")
    gathered = table(spark, folder, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    shaped = shaping.fit_to_budget(gathered, _MOST)
    return shaped.select(F.get_json_object("text", "$.conv_id").cast("long").alias("conv_id"), "text", "truncated")
