"""Registered queries of the training-data operators, with their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofspark.llm.context_tree import context_tree_scores
from asofspark.llm.conversation_trie import conversation_trie
from asofspark.llm.decontaminate import contaminated
from asofspark.llm.language_id import language_id
from asofspark.llm.mixing import mixed
from asofspark.llm.pii import pii_spans
from asofspark.llm.quality_classifier import quality_scores
from asofspark.llm.quality_rules import quality_rules
from asofspark.llm.simhash import simhash_groups
from asofspark.llm.storage import stored
from asofspark.llm.token_counts import token_counts
from asofspark.llm.toxicity import toxicity_scores
from asofspark.llm.url_rules import ORACLE_SQL as URL_RULES_SQL
from asofspark.llm.url_rules import judge_urls, rule_table
from asofspark.llm.vector_clusters import vector_clusters, with_inertia


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op2_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree_scores(_table(spark, sf_dir, "documents"))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), rule_table(spark))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", F.col("predicted").cast("int"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_spans(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    number = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [number(kind) for kind in ("email", "ip", "card", "phone")]
    listed = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op11_vector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids = vector_clusters(_table(spark, sf_dir, "embeddings"))
    return with_inertia(stored(assigned), centroids)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(_table(spark, sf_dir, "conversations")).drop("node", "parent")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_context_tree": op2_context_tree,
        "op3_url_rules": op3_url_rules,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_token_counts": op5_token_counts,
        "op6_simhash": op6_simhash,
        "op7_mixing": op7_mixing,
        "op8_decontamination": op8_decontamination,
        "op9_language_id": op9_language_id,
        "op10_pii": op10_pii,
        "op11_vector_clusters": op11_vector_clusters,
        "op12_toxicity": op12_toxicity,
        "op13_conversation_trie": op13_conversation_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_url_rules": URL_RULES_SQL}
