"""Measures how well configurations of the retrieval answer the benchmark's questions.

    python -m jobs.retrieval_report --documents D --questions Q --labels L --output OUT [--config FILE]

Builds the lexical index of D below OUT/index, searches every question of Q once (OUT/hits), and for each configuration
picks the first files, reranks them if it says so, looks their labels up in L and writes OUT/metrics (a row for each
question) and OUT/summary (their means), both partitioned by configuration. Every table is overwritten, tables by
configuration only where the config file names it; so a run that is repeated, or begun again after a failure, leaves the
same rows, and configurations that are no longer asked for keep their last ones.

Scaling. Documents are tokenized once; only postings of the questions' terms are read; the rows of a configuration are
at most ``list`` for each question.
"""

from __future__ import annotations

import argparse
import json
import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import evaluate, fusion, lexical, query
from quillspark.session import discarding

log = logging.getLogger("jobs.retrieval_report")


@dataclass
class Configuration:
    """depth: files that are picked, in order of their best document; rerank: whether they are put in another order."""

    name: str
    depth: int = 5
    rerank: bool = False


@dataclass
class Config:
    """list: documents found for a question; keep: files whose labels count; max_length: of what a reranker reads, in
    words of four characters; judged_queries: a label of document d judges it for question d modulo this."""

    list: int = 20
    keep: int = 5
    max_length: int = 512
    judged_queries: int = 50
    configurations: list[Configuration] = field(default_factory=lambda: [Configuration("bm25"), Configuration("bm25_rerank", 15, True)])


def load(path: str | None) -> Config:
    if path is None:
        return Config()
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    return Config(**{**data, "configurations": [Configuration(**c) for c in data["configurations"]]})


def judgments(labels: DataFrame, docs: DataFrame, queries: int) -> DataFrame:
    """(query_idx, source_file, doc_idx, label): toxic documents are irrelevant, good ones relevant, others partial."""
    label = F.when(F.col("toxic") == 1, "irrelevant").when(F.col("quality") == 1, "relevant").otherwise("partial")
    named = docs.select("doc_id", F.col("source").alias("source_file"))
    return labels.where("doc_id is not null").join(named, "doc_id").select(F.pmod("doc_id", F.lit(queries)).alias("query_idx"), "source_file", F.col("doc_id").alias("doc_idx"), label.alias("label"))


def picked(hits: DataFrame, one: Configuration, config: Config) -> DataFrame:
    """(query_idx, rank from 1, source_file) of a configuration. hits: query_id, question, rank, source_file, text."""
    rows = fusion.first_by_file(hits, one.depth)
    if one.rerank:
        logit = query.overlap_logit(F.col("question"), query.clipped(F.col("text"), config.max_length))
        rows = query.rerank(rows, logit, config.keep, config.max_length)
    return rows.where(F.col("rank") < config.keep).select(F.col("query_id").alias("query_idx"), (F.col("rank") + 1).alias("rank"), "source_file")


def run(spark: SparkSession, documents: str, questions: str, labels: str, output: str, config: Config | None = None) -> DataFrame:
    """Writes the report and returns the metrics of all configurations in it, a row for each of them and question.
    Questions without a hit count with empty lists; null texts have no token."""
    config, output = config or Config(), output.rstrip("/")
    with discarding(spark):
        _report(spark, documents, questions, labels, output, config)
    return spark.read.parquet(f"{output}/metrics")


def _report(spark: SparkSession, documents: str, questions: str, labels: str, output: str, config: Config) -> None:
    docs = spark.read.parquet(documents)
    asked = spark.read.parquet(questions).select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    log.info("read %s documents, %s questions", docs.count(), asked.count())
    index = lexical.build(docs.select("doc_id", "text")).saved(f"{output}/index")
    found = lexical.search(index, asked, config.list, text="question")
    # the text of the few documents that were found; of rows with one id the least counts
    named = found.join(docs.select(F.col("doc_id").alias("doc"), F.col("source").alias("source_file"), "text"), "doc")
    one = named.groupBy("query_id", "doc").agg(F.min(F.struct("rank", "score", "source_file", "text")).alias("r")).select("query_id", "doc", "r.*")
    rows = one.join(asked, "query_id")
    rows.write.mode("overwrite").parquet(f"{output}/hits")
    hits = spark.read.parquet(f"{output}/hits")
    log.info("wrote %s hits", hits.count())
    truth, ids = judgments(spark.read.parquet(labels), docs, config.judged_queries), asked.select(F.col("query_id").alias("query_idx"))
    for one in config.configurations:
        graded = evaluate.padded(evaluate.labelled(picked(hits, one, config), truth), ids, config.keep)
        metrics = evaluate.query_metrics(graded).withColumn("config", F.lit(one.name))
        _replace(metrics, f"{output}/metrics")
        done = spark.read.parquet(f"{output}/metrics").where(F.col("config") == one.name)
        _replace(evaluate.summary(done, ("config",)), f"{output}/summary")
        log.info("configuration %s: %s questions", one.name, done.count())


def _replace(rows: DataFrame, path: str) -> None:
    """Replaces the configurations that rows hold."""
    rows.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("config").parquet(path)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("documents", "questions", "labels", "output"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", help="JSON, as retrieval_report.json")
    a = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    from quillspark.session import session

    spark = session("retrieval_report")
    try:
        run(spark, a.documents, a.questions, a.labels, a.output, load(a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
