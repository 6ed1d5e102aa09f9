"""The corpus pipeline: language ID, near-duplicates, repeated passages, mixture, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import language_id, mixing, packing, registry, simhash, suffix_dedup
from quillspark.llm.common import bucket_of, discard, prepare, saved, written

#: A prediction with a lower score is a rejection (four languages: chance is 0.25).
LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null texts too) or without a likely language go; a missing lang is filled in.
    Rows are judged one by one, so repeated rows and null ids need no rule; if nothing can be learned, all go."""
    cols = docs.columns
    model = language_id.fit(docs, learn=bucket_of("doc_id", 4) != 2)
    seen = language_id.predict(docs, model).where((F.col("__lang.lang_pred") != language_id.UNKNOWN) & (F.col("__lang.score") >= LEAST_SCORE))
    return seen.withColumn("lang", F.coalesce("lang", "__lang.lang_pred")).select(*cols)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one of the least id, null ids last, then of the least MD5 of its text.
    Rows equal in id and text are one document. Texts without a word are one group."""
    return simhash.keep_one(docs).select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur earlier are cut out of the texts; n_chars follows. Texts that nothing is left of go, but
    empty and null texts, of which nothing was cut, stay. Rows without an id come last in the order."""
    cols = docs.columns
    out = suffix_dedup.dedup(docs, with_text=True)
    changed = F.col("__dedup.n_removed") > 0
    text = F.when(changed, F.col("__dedup.kept_text")).otherwise(F.col("text"))
    out = out.withColumn("text", text)
    if "n_chars" in cols:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.where(~changed | (F.length("text") > 0)).select(*cols)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights draw them. The one in which a leaf's budget ends is cut there, so
    that the tokens that go on are those that the budget grants; n_chars follows. Nulls, ties and repeated rows: see
    ``mixing.mix``."""
    out = mixing.mix(docs, registry.domain(), registry.MIX_WEIGHTS, **registry.MIX)
    cut = F.col("__mix.take_tokens") < F.col("__mix.n_tokens")
    out = out.withColumn("text", F.when(cut, mixing.first_tokens(F.col("text"), F.col("__mix.take_tokens"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of tokens; each row is a document of its own, a null text one that holds the end id only."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language identification and fingerprints have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = written()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = saved(docs)
            discard(spark, before, -1)  # what the stage read and what it wrote on its way
    return docs
