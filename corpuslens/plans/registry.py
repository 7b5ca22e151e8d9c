"""What the modules of registered queries share: the registry, the token table, and that table in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.operators import tokens as tk
from corpuslens.sources.tables import chat, documents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: The words of a text in SQL.
WORDS = f"list_filter(regexp_split_to_array(lower({{}}), '{tk.NO_WORD}'), lambda w: length(w) >= 2)"
STOP = ", ".join(f"'{w}'" for w in tk.STOP)
#: The token table of the conversations in SQL, and of what most queries need besides.
TOK = f"""
p as (select conv_id as grp, turn as ord, concat(conv_id, ':', turn) as pid, list_filter(regexp_split_to_array(lower(text), '{tk.NO_WORD}'), lambda w: length(w) >= 2) as ws from conversations),
t0 as (select grp, ord, pid, unnest(ws) as key, unnest(range(len(ws))) as pos from p),
t as (select grp, ord, pid, key, pos,
  case when length(regexp_replace(key, '(ing|ed|er|es|s|e)$', '')) >= 2 then regexp_replace(key, '(ing|ed|er|es|s|e)$', '') else key end as lemma,
  nullif(substr(regexp_replace(key, '[aeiouyäöüéèêàâáíóúîôûëï]', '', 'g'), 1, 3), '') as root from t0)"""
KEY_DF = "post as (select distinct key, pid, grp, ord from t), df as (select key, count(*) as df from post group by 1)"
ROOTS = """
rp as (select distinct root as key, pid, grp, ord from t where root is not null),
n as (select count(distinct pid) as n from t),
w as (select rp.*, ln(n.n / d.df) as w from rp join (select key, count(*) as df from rp group by 1) d using (key) cross join n)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = "with " + sql.strip() if sql.lstrip().startswith(("p as", "q as")) else sql.strip()
        return f

    return add


def chat_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return tk.tokens(chat(spark, folder))


def document_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return tk.tokens(documents(spark, folder))


def document_words(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their words in order (ws): a row for each, where the token table has one for each word."""
    return documents(spark, folder).select("pid", "grp", "ord", tk.words_of(F.col("text")).alias("ws"))


def chat_words(spark: SparkSession, folder: str) -> DataFrame:
    return chat(spark, folder).select("pid", "grp", "ord", tk.words_of(F.col("text")).alias("ws"))


def rounded(df: DataFrame, *columns: str, digits: int = 5) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def g2(k: str, a: str, b: str, n: str) -> str:
    cell = lambda o, e: f"(case when {o} > 0 and {e} > 0 then ({o}) * ln(({o}) / ({e})) else 0 end)"
    k, a, b, n = (f"{x}::double" for x in (k, a, b, n))
    e = f"({a} * {b} / {n})"
    sum_ = " + ".join((cell(k, e), cell(f"({a} - {k})", f"({a} * ({n} - {b}) / {n})"), cell(f"({b} - {k})", f"(({n} - {a}) * {b} / {n})"), cell(f"({n} - {a} - {b} + {k})", f"(({n} - {a}) * ({n} - {b}) / {n})")))
    return f"((case when {k} < {e} then -1 else 1 end) * greatest(0, 2 * ({sum_})))"


#: Keyness of roots in groups in SQL.
KEYNESS = f"{TOK}, r as (select distinct root as key, pid, grp from t where root is not null and key not in ({STOP})), d as (select key, count(*) as df from r group by 1), z as (select grp, count(distinct pid) as size from t group by 1), o as (select grp, key, count(*) as count from r group by 1, 2 having count(*) >= 2), x as (select o.grp, o.key, o.count as k, z.size as a, d.df as b, (select count(distinct pid) from t) as n from o join d using (key) join z using (grp)), kn as (select grp, key, k as count, b as df, {g2('k', 'a', 'b', 'n')} as ll from x where {g2('k', 'a', 'b', 'n')} > 0)"
