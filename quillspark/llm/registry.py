"""Queries of the training-data operators, with their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, hard_negatives, language_id, license_scan, mixing, packing, quality_classifier, quality_rules, simhash, suffix_dedup, token_counts, toxicity
from .common import bucket_of, documents, prepare, saved
from .sql import HARD_NEGATIVES_SQL, LICENSE_SQL, MIXING_SQL, QUALITY_RULES_SQL

#: Production parameters of the mixture: target weights by level, share of the tokens, epochs and seed.
MIX_WEIGHTS = {"domain": {"web": 4.0, "books": 3.0, "forum": 2.0, "code": 1.0}, "lang": {"en": 5.0, "fr": 2.0, "de": 2.0, "es": 1.0}}
MIX = {"share": 0.8, "max_epochs": 2, "seed": 7}


def domain():
    """The domain of a source, by the number in its name."""
    number = F.coalesce(F.expr("try_cast(regexp_extract(source, '([0-9]+)', 1) as bigint)"), F.lit(0)) % 4
    return F.element_at(F.array(*map(F.lit, ("web", "books", "forum", "code"))), (number + 1).cast("int"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "__rules.n_words", "__rules.word_chars", "__rules.n_symbols", "__rules.n_dup_lines", "__rules.n_repeat_words", "__rules.base_failed", "__rules.kept")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.pmod("id", F.lit(20)) == 0)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_classifier.fit(docs, labels, bucket_of("doc_id", 5) != 0)
    out = quality_classifier.score(docs, model).withColumn("score", F.col("__quality.score"))
    return out.select("doc_id", (bucket_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= quality_classifier.THRESHOLD).cast("int").alias("predicted"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = language_id.fit(docs, learn=bucket_of("doc_id", 4) != 2)
    out = language_id.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (bucket_of("doc_id", 4) == 2).alias("held_out"), "__lang.lang_pred", "__lang.score")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Texts are read once: what is drawn is told by the counts. A null id needs its text, which stays with it.
    text = F.when(F.col("doc_id").isNull(), F.col("text")).alias("text")
    docs = saved(documents(spark, sf_dir).select("doc_id", "lang", "source", mixing.n_tokens().alias("__tokens"), text))
    out = mixing.mix(docs, domain(), MIX_WEIGHTS, **MIX, counted="__tokens")
    return out.select("doc_id", "__mix.domain", "__mix.lang", "__mix.source", "__mix.epoch", "__mix.n_tokens", "__mix.take_tokens")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "__dedup.n_bytes", "__dedup.n_removed", "__dedup.n_spans", "__dedup.kept_sha256")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, bucket_of("doc_id", 3) != 1)
    out = toxicity.score(docs, model).withColumn("score", F.col("__toxicity.score"))
    return out.select("doc_id", (bucket_of("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "__license.*")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.pmod("id", F.lit(50)) == 0, label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1,
    "op2_packing": op2,
    "op3_ann_search": op3,
    "op4_quality_classifier": op4,
    "op5_language_id": op5,
    "op6_mixing": op6,
    "op7_suffix_dedup": op7,
    "op8_token_counts": op8,
    "op9_toxicity": op9,
    "op10_simhash": op10,
    "op11_license_scan": op11,
    "op12_hard_negatives": op12,
}
SQL: dict[str, str] = {"op1_quality_rules": QUALITY_RULES_SQL, "op6_mixing": MIXING_SQL, "op11_license_scan": LICENSE_SQL, "op12_hard_negatives": HARD_NEGATIVES_SQL}
