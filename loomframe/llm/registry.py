"""The queries over the driver's tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .common import fold, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge_quality

    return judge_quality(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


def op3_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .context_tree import score_texts

    docs = table(spark, sf_dir, "documents")
    held = fold() == 1
    scored = score_texts(docs.select(F.struct("doc_id", held.alias("held_out")).alias("row"), "text", held.alias("held_out")), ~F.col("held_out"), "row")
    return scored.select("row.doc_id", "row.held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_coded", "bits_per_byte")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=2)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_passages

    done = remove_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .attention_mil import score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), fold() != 0)
    scored = score(docs, model)
    return scored.select("doc_id", (fold() == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.3).cast("int").alias("predicted"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op10_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op2_decontamination, op3_context_tree_weighting, op4_suffix_dedup, op5_url_filter, op6_minhash_near_dedup, op7_substring_dedup, op8_attention_mil, op9_license_scan, op10_sum_of_squares_packing)
}

#: DuckDB SQL for the queries that SQL can express, and fast enough on whole tables.
ORACLE_SQL: dict[str, str] = {"op5_url_filter": oracles.URL_FILTER, "op6_minhash_near_dedup": oracles.NEAR_DEDUP, "op7_substring_dedup": oracles.SUBSTRING_DEDUP}
