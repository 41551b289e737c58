"""Registered queries of this package: one for each operator, over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.common import documents
from tidemark.llm.decontaminate import CONTAMINATED, contamination, contamination_sql
from tidemark.llm.jaccard import jaccard_components
from tidemark.llm.kneser_ney import language_model_scores
from tidemark.llm.licenses import licences, licences_sql
from tidemark.llm.outliers import outliers, outliers_sql
from tidemark.llm.packing import pack
from tidemark.llm.pii import KINDS, personal_data, spans_text
from tidemark.llm.resampling import importance_scores, importance_sql
from tidemark.llm.revisit import resolved_pages, resolved_pages_sql
from tidemark.llm.substrings import drop_repeated_windows, repeated_windows_sql
from tidemark.llm.templates import drop_recurring_lines
from tidemark.llm.toxicity import toxicity
from tidemark.llm.tries import prefix_trie, prefix_trie_sql

Build = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Build] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(build: Build) -> Build:
        QUERIES[name] = build
        if oracle:
            ORACLES[name] = oracle
        return build

    return add


@query("op1_curve_packing")
def curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir)).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query("op2_mcd_outliers", outliers_sql())
def mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers(documents(spark, sf_dir))


@query("op3_toxic_segments")
def toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), documents(spark, sf_dir, "labels")).withColumn("n_passages", F.size("passages")).drop("passages")


@query("op4_kneser_ney")
def kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_model_scores(documents(spark, sf_dir))
    return out.withColumn("perplexity", F.expr("power(10, -score / n_tokens)"))


@query("op5_revisits", resolved_pages_sql())
def revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved_pages(spark, documents(spark, sf_dir, "pages"))


@query("op6_boosted_spans")
def boosted_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal_data(documents(spark, sf_dir))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {i})) AS long)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(F.expr(spans_text("base")), 256).alias("base_sha256"), F.expr(spans_text("concat(base, added)")).alias("spans"))


@query("op7_prefix_decontamination", contamination_sql())
def prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    out = out.withColumn("n_items", F.size("item_ids").cast("long")).withColumn("items_sha256", F.sha2(F.array_join("item_ids", ","), 256))
    return out.withColumn("contaminated", F.expr(CONTAMINATED)).drop("item_ids")


@query("op8_ngram_jaccard_join")
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


@query("op9_sentence_licences", licences_sql())
def sentence_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licences(documents(spark, sf_dir)).withColumn("n_matches", F.size("matches").cast("long"))
    return out.withColumn("licences", F.array_join("licences", ",")).drop("matches")


@query("op10_line_templates")
def line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_recurring_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


@query("op11_prefix_crc_resampling", importance_sql())
def prefix_crc_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_scores(documents(spark, sf_dir).select("doc_id", "text"), documents(spark, sf_dir, "benchmark"))


@query("op12_ternary_trie", prefix_trie_sql())
def ternary_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(documents(spark, sf_dir, "conversations"))


@query("op13_cover_anchors", repeated_windows_sql())
def cover_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_windows(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
