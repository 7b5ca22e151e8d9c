"""The registered queries of this subpackage: thin uses of its operators over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import alignment, decontaminate, importance, langid, mixing, near_dup, pseudonyms, quality, token_counts, token_planes, top_k, toxicity, url_filter
from .shared import shared_path

#: host, path and verdict of the rules of op6.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: op8's key; a real one comes from a secret store.
PSEUDONYM_KEY = "corpuslens-example-key"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "ids")
    token_planes.write_ids(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_planes.digests(spark, path)


def op2_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), toxicity.categories(_table(spark, sf_dir, "labels")))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "segments")


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op7_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(_table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return top_k.top_k(documents, documents.where("doc_id % 20 = 0"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_token_planes, op2_spaced_seeds, op3_toxicity_chain, op4_language, op5_source_mix, op6_url_rules, op7_dart_minhash, op8_pseudonyms, op9_quality, op10_bm25, op11_token_counts, op12_alignment, op13_importance, pipeline)}

_OP6 = """
with u as (
  select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path
  from pages)
select page_id, host, path, rule,
       case when rule is null or rule in ('com/', 'www.example.com/en/') then 'allow' else 'block' end as verdict
from (select *, case
         when (host = 'www.example.com' or host like '%.www.example.com') and path like '/en/%' then 'www.example.com/en/'
         when (host = 'example.com' or host like '%.example.com') and path like '/en/%' then 'example.com/en/'
         when (host = 'net' or host like '%.net') and path like '/es/%' then 'net/es/'
         when (host = 'net' or host like '%.net') and path like '/fr/%' then 'net/fr/'
         when (host = 'com' or host like '%.com') and path like '/%' then 'com/'
       end as rule from u)
"""

#: The unsigned crc32 of a word, bit by bit: DuckDB has no function for it.
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(hex(encode(w))) + 1, 2), lambda i: ('0x' || substr(hex(encode(w)), i::bigint, 2))::bigint)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP13 = f"""
with d as (select doc_id, {_WORDS} as ws from documents),
dw as (select doc_id, unnest(ws) as w from d),
bw as (select unnest({_WORDS}) as w from benchmark),
h as (select w, ({_CRC}) % 10000 as b from (select w from dw union select w from bw)),
s as (select b, count(*) as s from dw join h using (w) group by 1),
t as (select b, count(*) as t from bw join h using (w) group by 1),
g as (select b, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select count(*) from dw) + 10000) / ((coalesce(s, 0) + 1)::double * ((select count(*) from bw) + 10000)))) as gain from (select distinct b from h) left join s using (b) left join t using (b)),
x as (select doc_id, sum(gain)::bigint as weight from dw join h using (w) join g using (b) group by 1),
y as (select doc_id, len(ws)::bigint as n_features, coalesce(weight, 0) as weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
      from d left join x using (doc_id)),
z as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as place, count(*) over (partition by n_features >= 20) as n from y)
select doc_id, n_features, weight, score, case when n_features >= 20 and place <= floor(10 * n / 100) then place end as rank from z
"""

ORACLE = {"op6_url_rules": _OP6, "op13_importance": _OP13}
