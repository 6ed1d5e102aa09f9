"""Keeps a cleaned corpus up to date as document files arrive.

    python -m jobs.corpus_refresh --documents IN --output OUT [--checkpoint DIR] [--config FILE]

Each run takes the files of IN that no earlier run has taken (a file stream with a checkpoint), drops documents with stop
patterns and those that are too short, keeps the first document of each text over all runs, and adds the rest to
OUT/corpus, partitioned by batch and language. OUT/counts and OUT/frequencies, by batch too, are the lexical index of
what was added (OUT/postings holds that of batches of older versions): ``index`` puts all batches together, and is searched like one that was built at once. OUT/batches holds
what each batch has read and kept.

A batch owns its partitions: one that is run again, because a run broke after it had written and before it was committed,
replaces what it wrote, and looks only at batches before it. So a run that is repeated, or goes on after a failure, gives
the same corpus. Of a batch's documents with one text the one of the least doc_id (then source, lang) is kept; a document
of an earlier batch always comes first.

Scaling. Texts are shuffled once, by their key, within a batch. Of the corpus only the keys are read, and of these only
the ones that the batch also has go on to the second join (a semi-join first, which Spark may prune with a Bloom filter).
Words of a document are counted once, when it comes, and kept as one row, so that no row for each word of each document is
made, sorted or written; terms' weights are sums of a row for each batch and term.
"""

from __future__ import annotations

import argparse
import json
import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import corpus, lexical

log = logging.getLogger("jobs.corpus_refresh")

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
CORPUS = "doc_id long, chunk_id string, source_file string, lang string, text string, text_key string, char_count long, n_tokens int, batch int, folder string"
BATCHES = "n_read long, n_kept long, batch int"
COUNTS, FREQUENCIES = "doc string, dl int, words string, tfs array<int>, batch int", "term string, df long, batch int"
#: What batches of older versions have instead of counts.
POSTINGS = "term string, doc string, tf long, dl int, batch int"
TABLES = {"corpus": (CORPUS, ["batch", "folder"]), "counts": (COUNTS, ["batch"]), "postings": (POSTINGS, ["batch"]), "frequencies": (FREQUENCIES, ["batch"]), "batches": (BATCHES, ["batch"])}
#: How much older than the newest file one may be that is still taken.
MAX_FILE_AGE = "36500d"
#: Folder of documents without a language.
NO_LANGUAGE = "und"


@dataclass
class Config:
    """stop: texts that mark documents of no value; least_chars: of a document that is kept; files_per_batch: none is all
    new files in one batch."""

    stop: list[str] = field(default_factory=list)
    least_chars: int = 1
    files_per_batch: int | None = None


def load(path: str | None) -> Config:
    if path is None:
        return Config()
    with open(path, encoding="utf-8") as f:
        return Config(**json.load(f))


def read(spark: SparkSession, output: str) -> DataFrame:
    """The corpus as it stands."""
    return spark.read.schema(CORPUS).parquet(f"{output}/corpus").drop("folder")


def batches(spark: SparkSession, output: str) -> DataFrame:
    """(batch, n_read, n_kept) of every batch so far."""
    return spark.read.schema(BATCHES).parquet(f"{output}/batches")


def index(spark: SparkSession, output: str) -> lexical.Index:
    """The lexical index of the whole corpus; documents are named by chunk_id."""
    totals = read(spark, output).agg(F.count("*").alias("n_docs"), F.avg("n_tokens").alias("avgdl"))
    df = spark.read.schema(FREQUENCIES).parquet(f"{output}/frequencies").groupBy("term").agg(F.sum("df").alias("df"))
    counts = spark.read.schema(COUNTS).parquet(f"{output}/counts")
    old = spark.read.schema(POSTINGS).parquet(f"{output}/postings").join(counts.select("batch").distinct(), "batch", "left_anti")
    columns = ["term", "doc", "tf", "dl"]
    return lexical.Index(lexical.unpacked(counts).select(*columns).unionByName(old.select(*columns)), lexical.weighted(df, totals), totals)


def cleaned(docs: DataFrame, config: Config) -> DataFrame:
    """Documents worth keeping, one for each text (column text_key); null texts are not."""
    fine = corpus.without(docs.where(F.length("text") >= max(1, config.least_chars)), config.stop)
    row = F.struct("doc_id", "source", "lang", "text")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.col("source").isNull(), "source", F.col("lang").isNull(), "lang")
    return fine.groupBy(F.md5("text").alias("text_key")).agg(F.min_by(row, order).alias("r")).select("text_key", "r.*")


def projected(docs: DataFrame, number: int) -> DataFrame:
    """Rows of the corpus. The chunk id is made of source, doc_id and the text's beginning, so that it stays as it is."""
    return docs.select(
        "doc_id", X.chunk_id(F.col("source"), F.col("doc_id"), F.col("text")).alias("chunk_id"), F.col("source").alias("source_file"), "lang", "text", "text_key",
        F.length("text").cast("long").alias("char_count"), F.size(X.tokens(F.col("text"))).alias("n_tokens"),
        F.lit(number).alias("batch"), F.coalesce(F.nullif(F.col("lang"), F.lit("")), F.lit(NO_LANGUAGE)).alias("folder"),
    )


def add_batch(docs: DataFrame, number: int, output: str, config: Config) -> tuple[int, int]:
    """Adds what is new in docs as batch ``number``; (rows read, rows kept). The same batch again replaces itself."""
    spark = docs.sparkSession
    last = batches(spark, output).agg(F.max("batch")).first()[0]
    if last is not None and last > number:
        raise ValueError(f"{output} holds batch {last}, which the checkpoint of batch {number} does not know")
    keys = read(spark, output).where(F.col("batch") < number).select("text_key")
    fresh = cleaned(docs, config)
    known = keys.join(fresh.select("text_key"), "text_key", "left_semi")
    new = projected(fresh.join(known, "text_key", "left_anti"), number)
    # one or a few files for each language, however many rows it has
    _replace(new.hint("rebalance", "folder"), "corpus", output)
    added = read(spark, output).where(F.col("batch") == number)
    _replace(lexical.packed(added, "chunk_id").where("dl > 0").withColumn("batch", F.lit(number)), "counts", output)
    counts = spark.read.schema(COUNTS).parquet(f"{output}/counts").where(F.col("batch") == number)
    _replace(lexical.frequencies(counts).withColumn("batch", F.lit(number)), "frequencies", output)
    n_read, n_kept = docs.count(), added.count()
    row = spark.range(1).select(F.lit(n_read).cast("long").alias("n_read"), F.lit(n_kept).cast("long").alias("n_kept"), F.lit(number).alias("batch"))
    _replace(row, "batches", output)
    log.info("batch %s: read %s documents, kept %s", number, n_read, n_kept)
    return n_read, n_kept


def _replace(rows: DataFrame, table: str, output: str) -> None:
    """Writes a batch's rows in place of what it wrote before, if it did."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*TABLES[table][1]).parquet(f"{output}/{table}")


def pattern(path: str) -> str:
    """The path as a pattern that only it fits: a file stream then takes a single file as well as a folder."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, documents: str, output: str, checkpoint: str | None = None, config: Config | None = None) -> DataFrame:
    """Takes the new files of ``documents`` (a folder, a pattern or one file) and returns the corpus. The checkpoint lies below the output unless another
    folder is named; it belongs to the output as long as that exists. No new files: nothing is written."""
    config = config or Config()
    output = output.rstrip("/")
    for name, (schema, by) in TABLES.items():
        # an empty table, if there is none yet
        spark.createDataFrame([], schema).write.mode("append").partitionBy(*by).parquet(f"{output}/{name}")
    # a file that is older than those of earlier runs, but comes later, is new all the same
    stream = spark.readStream.schema(DOCUMENTS).option("maxFileAge", MAX_FILE_AGE)
    if config.files_per_batch:
        stream = stream.option("maxFilesPerTrigger", config.files_per_batch)
    log.info("reading new files of %s", documents)
    query = (
        stream.parquet(pattern(documents)).writeStream.foreachBatch(lambda docs, number: add_batch(docs, number, output, config) and None)
        .option("checkpointLocation", checkpoint or f"{output}/_checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    out = read(spark, output)
    log.info("%s holds %s documents", output, out.count())
    return out


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("documents", "output"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--checkpoint")
    parser.add_argument("--config", help="JSON, as corpus_refresh.json")
    a = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    from quillspark.session import session

    spark = session("corpus_refresh")
    try:
        run(spark, a.documents, a.output, a.checkpoint, load(a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
