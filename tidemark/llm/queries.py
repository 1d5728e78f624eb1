"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, embeddings, jaccard, langid, licences, lines, media, mixing, pii, toxicity
from tidemark.llm.common import table

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.labelled(docs, table(spark, sf_dir, "labels")))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_dedup(table(spark, sf_dir, "embeddings"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(table(spark, sf_dir, "documents")))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.store(table(spark, sf_dir, "documents")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.sample(docs))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(lines.line_dedup(table(spark, sf_dir, "documents")))


def queries():
    return {f.__name__: f for f in (op1_toxicity, op2_embedding_near_dedup, op3_byte_bpe, op4_pii, op5_media, op6_language_id, op7_mix, op8_licences, op9_ngram_jaccard, op10_line_dedup)}


EMBEDDING_SQL = """
with v as (select vec_id, embedding::double[] as e from embeddings),
g as (select vec_id, e from v where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_dot_product(e, e) > 0),
p as (select a.vec_id as a, b.vec_id as b from g a join g b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.95),
r as (with recursive r(a, b) as (select a, b from p union select r.a, p.b from r join p on r.b = p.a) select * from r)
select v.vec_id, (select count(*) from p where p.a = v.vec_id) as n_links, least(v.vec_id, coalesce((select min(b) from r where r.a = v.vec_id), v.vec_id)) as component_id,
  v.vec_id <= coalesce((select min(b) from r where r.a = v.vec_id), v.vec_id) as kept from v
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_embedding_near_dedup": EMBEDDING_SQL, "op7_mix": mixing.ORACLE.format(docs="documents"), "op9_ngram_jaccard": jaccard.ORACLE.replace("{docs}", "documents"), "op10_line_dedup": lines.ORACLE.format(docs="documents")}
