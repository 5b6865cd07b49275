"""Queries of this subpackage and the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karwan.llm import ann, brands, looks, mixing, mixture, packing, sentences, tokens
from karwan.runtime import cut, table


def _names(spark: SparkSession, d: str) -> DataFrame:
    product, category = table(spark, d, "product"), table(spark, d, "category")
    return looks.unpivot([("product.name_ar", product, "id", "name_ar"), ("product.brand_raw_ar", product, "id", "brand_raw_ar"), ("category.name_ar", category, "id", "name_ar")])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return looks.changed(_names(spark, d)).select("field_name", "record_id").distinct()


def p3_plain(spark: SparkSession, d: str) -> DataFrame:
    return looks.changed(_names(spark, d)).select("field_name", "record_id", F.col("value").alias("typed"), "plain").distinct()


def _brands(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    brand, alias = table(spark, d, "canonical_brand"), table(spark, d, "brand_alias")
    known = [(brand, "display_name", "id"), (brand, "slug", "id"), (alias, "raw_value", "canonical_brand_id"), (alias, "normalized_value", "canonical_brand_id")]
    names = None
    for t, name, key in known:
        part = t.select(F.col(name).alias("name"), F.col(key).alias("id"))
        names = part if names is None else names.unionByName(part)
    return brands.assign(table(spark, d, "product"), ["brand_raw_en", "brand_raw_ar", "brand_normalized"], names)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _brands(spark, d)[0].select(F.col("record_id").alias("product_id"), F.col("canonical_id").alias("canonical_brand_id"))


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return _brands(spark, d)[1]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "product_embeddings").select(F.col("product_id").alias("id"), F.col("embedding").alias("vector"))
    near = ann.neighbours(vectors, k=5, least=0.92, size=64)
    return near.select(F.least("id", "other_id").alias("product_id_a"), F.greatest("id", "other_id").alias("product_id_b")).distinct()


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    return mixture.members(table(spark, d, "product_embeddings").select(F.col("product_id").alias("id"), F.col("embedding").alias("vector")), size=64)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d).select("cluster_id", F.col("id").alias("product_id"))


def p4_described(spark: SparkSession, d: str) -> DataFrame:
    return mixture.described(_clusters(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "documents").select("doc_id", "text")).distinct()


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    # a table of settings: one row for each kind of container
    kinds = [(r.container_kind, r.capacity_tokens) for r in table(spark, d, "container_size").collect()]
    items = cut(tokens.count_tokens(table(spark, d, "documents").select("doc_id", "text")))
    return packing.pack(items, kinds)


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.report(p7_packed(spark, d))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    # a table of settings: one row for each source that is asked for
    targets = [(r.source, r.target_share, r.max_repeats) for r in table(spark, d, "mix_target").collect()]
    docs = table(spark, d, "documents").select("doc_id", "source", F.md5("text").alias("text_key"), "text")
    return mixing.mix(cut(tokens.count_tokens(docs)), targets)


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p8_mixture(spark, d), table(spark, d, "mix_target"))


QUERIES = {"p1_found": p1_found, "p1_unmatched": p1_unmatched, "p2_found": p2_found, "p3_found": p3_found, "p3_plain": p3_plain, "p4_found": p4_found, "p4_described": p4_described, "p7_packed": p7_packed, "p7_report": p7_report, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p9_found": p9_found}

SQL: dict[str, str] = {}
