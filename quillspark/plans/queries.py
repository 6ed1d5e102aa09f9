"""Registered queries over the driver's tables, with the SQL that their results are held against.

``documents`` stand for chunks (source is the file, doc_id the order), ``benchmark`` for questions, ``labels``
for judgments, ``embeddings`` for the vector store, ``pages`` for help pages.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import sources
from ..config import Chunking
from ..functions import text as X
from ..operators import answers, blockmax, chunking, corpus, evaluate, fusion, ivf, lexical, models, query, store, vector
from ..operators.html import Options
from ..session import work_dir
from ..streaming import state
from . import Retriever, ablate, with_judged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The pages table has articles instead of help-topic bodies.
ARTICLES = Options(root=("article", None, None))
STOP = ["worthless", "Apache License"]
K = 10


def register(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunk_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks without a position."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("source_file"), "text", F.length("text").alias("char_count"), "lang")


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks: the position within a source is the chunk index."""
    return corpus.numbered(chunk_facts(spark, sf_dir), "source_file", "doc_id")


TOKENS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+'), lambda x: length(x) >= 3)"
INDEX = f"""
toks AS MATERIALIZED (SELECT doc_id AS doc, {TOKENS} AS ts FROM documents),
totals AS MATERIALIZED (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM toks),
post AS MATERIALIZED (SELECT term, doc, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc, len(ts) AS dl, unnest(ts) AS term FROM toks) GROUP BY term, doc),
counted AS MATERIALIZED (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM counted, totals),
middle AS MATERIALIZED (SELECT avg(r) AS mean FROM raw),
terms AS MATERIALIZED (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * mean ELSE r END AS idf FROM raw, middle)"""


def bm25_sql(queries: str, k: int) -> str:
    """CTEs up to ``ranked`` (query_id, rank, doc, score); queries: rows (query_id, text)."""
    return f"""{INDEX},
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({TOKENS}) AS term FROM ({queries})) GROUP BY ALL),
scored AS (SELECT query_id, doc, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM asked JOIN terms USING (term) JOIN post USING (term), totals GROUP BY query_id, doc HAVING score > 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) - 1 AS rank, doc, score FROM scored QUALIFY rank < {k})"""


QUESTIONS = "SELECT item_id AS query_id, text FROM benchmark"


def questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@register("tokenize_terms", f"SELECT doc_id, len(ts)::INTEGER AS n_tokens, len(list_distinct(ts))::INTEGER AS n_terms FROM (SELECT doc_id, {TOKENS} AS ts FROM documents)")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", X.tokens(F.col("text")).alias("ts"))
    return d.select("doc_id", F.size("ts").alias("n_tokens"), F.size(F.array_distinct("ts")).alias("n_terms"))


@register("bm25_idf", f"WITH {INDEX} SELECT term, df::BIGINT AS df, round(idf, 9) AS idf FROM terms")
def _(spark, sf_dir):
    return lexical.build(table(spark, sf_dir, "documents")).terms.select("term", "df", F.round("idf", 9).alias("idf"))


_indexes: dict[tuple, lexical.Index] = {}


def index(spark, sf_dir):
    """The BM25 index of documents, built once a session for the files as they are, and read from the shared folder by all
    queries."""
    files = table(spark, sf_dir, "documents").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    key = (spark.sparkContext.applicationId, sf_dir, files.agg(F.sum(F.xxhash64("*") % (1 << 40))).first()[0])
    if key not in _indexes:
        _indexes[key] = lexical.build(table(spark, sf_dir, "documents")).saved(f"{work_dir(spark)}/bm25-{uuid.uuid4().hex}")
    return _indexes[key]


def bm25(spark, sf_dir, k=K):
    return lexical.search(index(spark, sf_dir), questions(spark, sf_dir), k)


@register("bm25_topk", f"WITH {bm25_sql(QUESTIONS, K)} SELECT query_id, rank::INTEGER AS rank, doc, score FROM ranked")
def _(spark, sf_dir):
    return bm25(spark, sf_dir)


@register("bm25_topk_pruned", f"WITH {bm25_sql(QUESTIONS, K)} SELECT query_id, rank::INTEGER AS rank, doc, score FROM ranked")
def _(spark, sf_dir):
    path = f"{work_dir(spark)}/blocks-{uuid.uuid4().hex}"
    blockmax.save(table(spark, sf_dir, "documents"), path)
    return blockmax.search(blockmax.load(spark, path), questions(spark, sf_dir), K).found


@register(
    "bm25_topk_by_source",
    f"""WITH {bm25_sql(QUESTIONS, 20)},
firsts AS (SELECT query_id, rank, doc, source FROM ranked JOIN documents ON doc = doc_id QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY rank) = 1)
SELECT query_id, doc, source, (row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1)::INTEGER AS rank FROM firsts QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 5""",
)
def bm25_topk_by_source(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "source")
    return fusion.first_by_file(bm25(spark, sf_dir, 20).join(d, "doc"), 5, "source").select("query_id", "doc", "source", "rank")


@register("dedup_exact_alt_sources", "SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, coalesce(string_agg(source, ';' ORDER BY doc_id) FILTER (WHERE rn > 1), '') AS alt_sources FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) GROUP BY text")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return corpus.deduplicate(d, source="source", order="doc_id").select("doc_id", "source", "alt_sources")


@register(
    "alternative_sources",
    f"""WITH n AS (SELECT md5(text) AS key, coalesce(source, '') AS s, row_number() OVER (PARTITION BY text ORDER BY doc_id) - 1 AS n FROM documents WHERE text IS NOT NULL),
f AS (SELECT key, min(n) AS first FROM n WHERE n > 0 AND s <> '' GROUP BY key)
SELECT key, ((n - first) // {corpus.SEGMENT})::INTEGER AS segment, string_agg(s, ';' ORDER BY n) AS names FROM n JOIN f USING (key) WHERE n > 0 AND n >= first GROUP BY ALL""",
)
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", "source")
    return corpus.alternative_sources(d, source="source", order="doc_id").withColumn("names", F.array_join("names", ";"))


@register(
    "document_keys",
    """WITH k AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'c' || doc_id // 6 ELSE source || '_' || doc_id // 7 END AS doc, doc_id % 10 AS query_id, doc_id // 10 % 3 AS list_idx, doc_id // 30 AS rank FROM documents)
SELECT query_id, doc, round(sum(1 / (60.0::DOUBLE + rank + 1)), 9) AS score FROM k GROUP BY query_id, doc""",
)
def _(spark, sf_dir):
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(F.when(i % 3 == 0, F.concat(F.lit("c"), F.expr("doc_id div 6"))).otherwise(F.when(i % 3 == 1, "")).alias("chunk_id"), F.col("source").alias("source_file"), F.expr("doc_id div 7").alias("chunk_index"), (i % 10).alias("query_id"), F.expr("doc_id div 10 % 3").alias("list_idx"), F.expr("doc_id div 30").alias("rank"))
    return fusion.fuse(fusion.keyed(d)).select("query_id", "doc", "score")


@register("stop_filter", "SELECT doc_id FROM documents WHERE NOT (contains(text, 'worthless') OR contains(text, 'Apache License'))")
def _(spark, sf_dir):
    return corpus.without(table(spark, sf_dir, "documents"), STOP).select("doc_id")


@register("junk_chunk_filter", r"SELECT doc_id FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE length(regexp_replace(text, '[*#\-|_\s]', '', 'g')) >= 10 AND NOT (len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) = 1 AND starts_with(trim(text), '#')) AND NOT (length(text) < 200 AND n <> 1)")
def _(spark, sf_dir):
    d = chunk_facts(spark, sf_dir).withColumns({"has_table": F.lit(False), "has_procedure": F.lit(False)})
    return corpus.without_junk(d).select("doc_id")


@register("chunk_ids", "SELECT doc_id, substr(md5(source || '::' || (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) || '::' || substr(text, 1, 200)), 1, 12) AS chunk_id, (length(text) // 4)::BIGINT AS token_count_approx FROM documents")
def _(spark, sf_dir):
    d = chunk_facts(spark, sf_dir).withColumn("text", F.substring("text", 1, 200))  # what the id is made of
    return corpus.numbered(d, "source_file", "doc_id").select("doc_id", X.chunk_id(F.col("source_file"), F.col("chunk_index"), F.col("text")).alias("chunk_id"), F.expr("char_count div 4").alias("token_count_approx"))


@register("embedding_text", "SELECT doc_id, md5(concat_ws(chr(10), nullif(lang, ''), nullif(source, ''), text)) AS digest FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.embedding_text(F.col("lang"), F.col("source"), F.col("text"))).alias("digest"))


@register("doc_projection", "SELECT substr(md5(coalesce(source, '') || '::0::' || substr(coalesce(text, ''), 1, 200)), 1, 12) AS chunk_id, coalesce(source, '') AS source_file, length(text)::INTEGER AS char_count, lang || ',' || source AS block_types FROM documents")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    none = {c: F.lit(None).cast("string") for c in ("id", "page_title", "breadcrumbs", "section_title", "section_path", "alt_sources")}
    c = d.select("text", F.col("source").alias("source_file"), F.length("text").alias("char_count"), F.array("lang", "source").alias("block_types"), F.lit(None).cast("int").alias("chunk_index"), F.lit(None).cast("boolean").alias("has_table"), F.lit(None).cast("boolean").alias("has_procedure"))
    return corpus.to_documents(c.withColumns(none)).select("chunk_id", "source_file", "char_count", "block_types")


@register("corpus_stats", "SELECT count(*) AS chunks, count(DISTINCT source) AS pages, count(*) / count(DISTINCT source) AS chunks_per_page, min(length(text))::INTEGER AS min_size, max(length(text))::INTEGER AS max_size, avg(length(text)) AS mean_size, sum(length(text))::BIGINT AS total_size, (list_sort(list(length(text))))[count(*) // 2 + 1]::INTEGER AS upper_median FROM documents")
def _(spark, sf_dir):
    return corpus.statistics(chunk_facts(spark, sf_dir))


@register("size_histogram", "SELECT b.bucket::INTEGER AS bucket, label, (SELECT count(*) FROM documents WHERE length(text) >= low AND (high IS NULL OR length(text) < high)) AS n FROM (VALUES (0, 0, 200, '<200'), (1, 200, 500, '200-500'), (2, 500, 1000, '500-1000'), (3, 1000, 1500, '1000-1500'), (4, 1500, 3000, '1500-3000'), (5, 3000, NULL, '>3000')) b(bucket, low, high, label)")
def _(spark, sf_dir):
    return corpus.size_histogram(chunk_facts(spark, sf_dir))


@register("type_histogram", 'SELECT "type", count(*) AS n FROM (SELECT unnest([lang, source]) AS "type" FROM documents) GROUP BY "type"')
def _(spark, sf_dir):
    return corpus.type_histogram(table(spark, sf_dir, "documents").select(F.array("lang", "source").alias("block_types")))


NEAR = """near AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 9) AS score
  FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)"""


def near(spark, sf_dir, k, threshold=None):
    e = table(spark, sf_dir, "embeddings")
    return vector.topk(e, e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), k, threshold=threshold)


@register("vector_topk", f"WITH {NEAR} SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1)::INTEGER AS rank, vec_id, round(score, 6) AS score FROM near QUALIFY rank < {K}")
def _(spark, sf_dir):
    return near(spark, sf_dir, K).withColumn("score", F.round("score", 6))


@register("vector_topk_indexed")
def vector_topk_indexed(spark, sf_dir):
    """An index of all vectors is built and searched; what it finds of ``vector_topk`` is a matter of its recall."""
    e = table(spark, sf_dir, "embeddings")
    made = ivf.build(e, f"{work_dir(spark)}/ivf-{uuid.uuid4().hex}")
    return made.search(e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), K).withColumn("score", F.round("score", 6))


def ingested(spark, sf_dir) -> store.Collection:
    """A new collection of the documents that have a vector: first the even ones, then all, of which it takes the rest."""
    made = store.Collection(spark, f"{work_dir(spark)}/collection-{uuid.uuid4().hex}")
    d = table(spark, sf_dir, "documents").where("doc_id is not null").select(F.col("doc_id").cast("string").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("page_content"), F.col("source").alias("source_file"))
    rows = d.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding"), "chunk_id")
    made.add(rows.where("cast(chunk_id as long) % 2 = 0"), None)
    made.add(rows, None)
    return made


@register(
    "collection_search",
    f"""WITH near AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, source, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 9) AS score
  FROM embeddings q, embeddings v JOIN documents ON doc_id = vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id % 2, vec_id::VARCHAR) - 1)::INTEGER AS rank, vec_id::VARCHAR AS chunk_id, source AS source_file, round(score, 6) AS score FROM near QUALIFY rank < {K}""",
)
def _(spark, sf_dir):
    found = ingested(spark, sf_dir).search(table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), K)
    return found.select("query_id", "rank", "chunk_id", "source_file", F.round("score", 6).alias("score"))


@register("vector_threshold", f"WITH {NEAR}, r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank FROM near QUALIFY rank < 15) SELECT query_id, rank::INTEGER AS rank, vec_id FROM r WHERE score >= 0.3")
def _(spark, sf_dir):
    return near(spark, sf_dir, 15, 0.3).drop("score")


# Two rankings of one question set: BM25 over whole questions, and over their first halves.
_BOTH = "SELECT item_id * 2 AS query_id, text FROM benchmark UNION ALL SELECT item_id * 2 + 1, substr(text, 1, length(text) // 2) FROM benchmark"
FUSED = f"""{bm25_sql(_BOTH, 30)},
lists AS (SELECT query_id // 2 AS query_id, query_id % 2 AS list_idx, rank, doc FROM ranked),
summed AS (SELECT query_id, doc, round(sum(1 / (60.0::DOUBLE + rank + 1)), 9) AS score, min({{'l': list_idx, 'r': rank}}) AS seen FROM lists GROUP BY query_id, doc),
fused AS (SELECT query_id, doc, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, doc) - 1 AS rank FROM summed)"""


def lists(spark, sf_dir):
    q = questions(spark, sf_dir)
    half = F.expr("substring(text, 1, cast(length(text) div 2 as int))")
    both = q.select((F.col("query_id") * 2).alias("query_id"), "text").unionByName(q.select((F.col("query_id") * 2 + 1).alias("query_id"), half.alias("text")))
    ranked = lexical.search(index(spark, sf_dir), both, 30)
    return ranked.select(F.expr("query_id div 2").alias("query_id"), (F.col("query_id") % 2).alias("list_idx"), "rank", "doc")


@register("rrf_fusion", f"WITH {FUSED} SELECT query_id, doc, score, rank::INTEGER AS rank FROM fused")
def _(spark, sf_dir):
    return fusion.fuse(lists(spark, sf_dir))


CHUNK_ROWS = "chunks AS (SELECT doc_id, source AS source_file, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS chunk_index, text, lang FROM documents)"
FILES = f"""{FUSED}, {CHUNK_ROWS},
led AS (SELECT f.*, source_file, chunk_index, text, min(rank) OVER (PARTITION BY query_id, source_file) AS lead FROM fused f JOIN chunks ON doc = doc_id),
files AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY lead) AS file_rank FROM led QUALIFY file_rank <= 5)"""


def files(spark, sf_dir):
    c = chunk_rows(spark, sf_dir).select(F.col("doc_id").alias("doc"), "source_file", "chunk_index", "text")
    return fusion.unique_files(fusion.fuse(lists(spark, sf_dir)).join(c, "doc"), 5)


@register("hybrid_unique_files", f"WITH {FILES} SELECT query_id, doc, source_file, file_rank::INTEGER AS file_rank, rank::INTEGER AS rank FROM files")
def _(spark, sf_dir):
    return files(spark, sf_dir).select("query_id", "doc", "source_file", "file_rank", "rank")


@register(
    "merge_page_chunks",
    f"""WITH {FILES}, best AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY query_id, source_file ORDER BY rank) <= 2)
SELECT query_id, source_file, md5(string_agg(text, chr(10) || chr(10) ORDER BY chunk_index, rank)) AS digest, min(rank)::INTEGER AS rank, arg_min(doc, rank) AS doc, round(arg_min(score, rank), 4) AS fusion_score, CASE WHEN count(*) > 1 THEN count(*) END AS merged_chunks FROM best GROUP BY query_id, source_file""",
)
def _(spark, sf_dir):
    return fusion.merged(files(spark, sf_dir)).select("query_id", "source_file", F.md5("text").alias("digest"), "rank", "doc", "fusion_score", "merged_chunks")


@register(
    "multi_query_fusion",
    f"""WITH {FILES}, firsts AS (SELECT query_id, doc, source_file, rank FROM files QUALIFY row_number() OVER (PARTITION BY query_id, source_file ORDER BY rank) = 1)
SELECT query_id, doc, source_file, (row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1)::INTEGER AS rank FROM firsts""",
)
def _(spark, sf_dir):
    return fusion.first_by_file(files(spark, sf_dir), 5).select("query_id", "doc", "source_file", "rank")


LABEL = "CASE WHEN toxic = 1 THEN 'irrelevant' WHEN quality = 1 THEN 'relevant' ELSE 'partial' END"
LABELLED = f"labelled AS (SELECT doc_id % 50 AS query_idx, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id) AS rank, {LABEL} AS label FROM labels)"


def labelled(spark, sf_dir):
    """Judged result lists: labels dealt to fifty queries, ranked by id."""
    label = F.when(F.col("toxic") == 1, "irrelevant").when(F.col("quality") == 1, "relevant").otherwise("partial")
    q = (F.col("doc_id") % 50).alias("query_idx")
    return table(spark, sf_dir, "labels").select(q, F.row_number().over(Window.partitionBy(F.col("doc_id") % 50).orderBy("doc_id")).alias("rank"), label.alias("label"))


def _metric_sql() -> str:
    aggs = []
    for name, hit in (("strict", "label = 'relevant'"), ("lenient", "label IN ('relevant', 'partial')")):
        for k in (3, 5):
            aggs.append(f"(count(*) FILTER (WHERE {hit} AND rank <= {k})) / {k}.0::DOUBLE AS p{k}_{name}")
        for k in (3, 5):
            aggs.append(f"CASE WHEN count(*) FILTER (WHERE {hit}) > 0 THEN (count(*) FILTER (WHERE {hit} AND rank <= {k}))::DOUBLE / (count(*) FILTER (WHERE {hit})) ELSE 0 END AS recall{k}_{name}")
        aggs.append(f"coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE {hit}), 0) AS mrr_{name}")
    for k in (3, 5):
        aggs.append(f"coalesce(round(sum(g / log2(rank + 1)) FILTER (WHERE rank <= {k}) / nullif(sum(g / log2(i + 1)) FILTER (WHERE i <= {k}), 0), 9), 0) AS ndcg{k}")
    return ", ".join(aggs)


METRICS = f"""{LABELLED}, graded AS (SELECT *, CASE label WHEN 'relevant' THEN 2.0 WHEN 'partial' THEN 1.0 ELSE 0.0 END::DOUBLE AS g FROM labelled),
ordered AS (SELECT *, row_number() OVER (PARTITION BY query_idx ORDER BY g DESC, rank) AS i FROM graded),
metrics AS (SELECT query_idx, {_metric_sql()} FROM ordered GROUP BY query_idx)"""
SUMMARISED = ["p3_strict", "p5_strict", "recall5_strict", "mrr_strict", "p3_lenient", "p5_lenient", "recall5_lenient", "mrr_lenient", "ndcg3", "ndcg5"]


@register("retrieval_metrics", f"WITH {METRICS} SELECT * FROM metrics")
def _(spark, sf_dir):
    return evaluate.query_metrics(labelled(spark, sf_dir))


@register("metric_summary", f"WITH {METRICS} SELECT {', '.join(f'round(avg({c})::DECIMAL(18, 9), 4)::DOUBLE AS {c}' for c in SUMMARISED)}, count(*) AS n_queries FROM metrics")
def _(spark, sf_dir):
    return evaluate.summary(evaluate.query_metrics(labelled(spark, sf_dir)))


@register("ablation_metrics", f"WITH {METRICS} SELECT CASE WHEN query_idx % 2 = 0 THEN 'even' ELSE 'odd' END AS config, round(avg(p3_strict)::DECIMAL(18, 9), 4)::DOUBLE AS p3, round(avg(p5_strict)::DECIMAL(18, 9), 4)::DOUBLE AS p5, round(avg(ndcg5)::DECIMAL(18, 9), 4)::DOUBLE AS ndcg5, round(avg(mrr_strict)::DECIMAL(18, 9), 4)::DOUBLE AS mrr FROM metrics GROUP BY 1")
def _(spark, sf_dir):
    m = evaluate.query_metrics(labelled(spark, sf_dir)).withColumn("config", F.when(F.col("query_idx") % 2 == 0, "even").otherwise("odd"))
    return evaluate.summary(m, ("config",)).select("config", F.col("p3_strict").alias("p3"), F.col("p5_strict").alias("p5"), "ndcg5", F.col("mrr_strict").alias("mrr"))


SCORE = "CASE WHEN toxic = 1 THEN 'no' WHEN quality = 1 THEN 'yes' WHEN doc_id % 7 = 0 THEN 'error' ELSE 'partial' END"


def judged(spark, sf_dir):
    score = F.when(F.col("toxic") == 1, "no").when(F.col("quality") == 1, "yes").when(F.col("doc_id") % 7 == 0, "error").otherwise("partial")
    criterion = F.element_at(F.array(*map(F.lit, evaluate.CRITERIA)), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("idx"), criterion.alias("criterion"), score.alias("score"))


GENERATION = f"""SELECT criterion, count(*) FILTER (WHERE s = 'yes') AS yes, count(*) FILTER (WHERE s = 'partial') AS partial, count(*) FILTER (WHERE s = 'no') AS "no", count(*) FILTER (WHERE s = 'error') AS error,
round(coalesce(avg(CASE s WHEN 'yes' THEN 1.0 WHEN 'partial' THEN 0.5 WHEN 'no' THEN 0.0 END::DOUBLE), 0), 3) AS avg_score, count(*) FILTER (WHERE s <> 'error') AS n
FROM (SELECT ['faithfulness', 'completeness', 'relevance', 'helpfulness'][doc_id % 4 + 1] AS criterion, {SCORE} AS s FROM labels) GROUP BY criterion"""


@register("generation_metrics", GENERATION)
def _(spark, sf_dir):
    return evaluate.generation_metrics(judged(spark, sf_dir))


@register("generation_overall", f"SELECT round(avg(avg_score), 3) AS overall FROM ({GENERATION})")
def _(spark, sf_dir):
    return evaluate.overall(evaluate.generation_metrics(judged(spark, sf_dir)))


@register("annotation_stats", f"WITH {LABELLED} SELECT count(*) AS total, count(*) FILTER (WHERE label = 'relevant') AS relevant, count(*) FILTER (WHERE label = 'partial') AS partial, count(*) FILTER (WHERE label = 'irrelevant') AS irrelevant, round(100.0::DOUBLE * count(*) FILTER (WHERE label = 'relevant') / count(*), 1) AS relevant_pct, count(DISTINCT query_idx) AS queries FROM labelled")
def _(spark, sf_dir):
    return evaluate.annotation_stats(labelled(spark, sf_dir))


LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"


@register(
    "section_split",
    f"""WITH {LINES}, marked AS (SELECT *, length(line) < 60 AND length(line) > 0 AS starts FROM lines)
SELECT doc_id, pos::INTEGER AS pos, (sum(starts::INTEGER) OVER w)::BIGINT AS section_id, coalesce(last_value(CASE WHEN starts THEN line END IGNORE NULLS) OVER w, '') AS section_title FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)""",
)
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    d = d.withColumn("starts", (F.length("line") < 60) & (F.length("line") > 0))
    return chunking.section_ids(d, "doc_id", "pos", "starts", "line").select("doc_id", "pos", "section_id", "section_title")


@register(
    "greedy_pack_chunks",
    f"""WITH RECURSIVE {LINES}, n AS (SELECT doc_id, pos, length(line) AS n FROM lines),
walk AS (SELECT doc_id, pos, n AS size, 0 AS part FROM n WHERE pos = 0
  UNION ALL SELECT n.doc_id, n.pos, CASE WHEN w.size + n.n > 1500 THEN n.n ELSE w.size + n.n END, CASE WHEN w.size + n.n > 1500 THEN w.part + 1 ELSE w.part END FROM walk w JOIN n ON n.doc_id = w.doc_id AND n.pos = w.pos + 1)
SELECT doc_id, part::INTEGER AS part, md5(string_agg(line, chr(10) ORDER BY pos)) AS digest FROM walk JOIN lines USING (doc_id, pos) GROUP BY doc_id, part""",
)
def _(spark, sf_dir):
    d = chunking.pack_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.posexplode("parts").alias("part", "t")).select("doc_id", "part", F.md5("t").alias("digest"))


BLANK = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
MERGED = (rf"\*\*([^*]+)\*\*[{BLANK}]*\*\*([^*]+)\*\*", r"**\1 \2**")
ENDS = [(r" +([.,:;!?)])", r"\1"), *[(rf"([^{BLANK}]) {{2,}}([^{BLANK}])", r"\1 \2")] * 2, (r"[ \t]+\n", r"\n"), (r"[ \t]+$", "")]
TRIM = (rf"^[{BLANK}]+|[{BLANK}]+$", "")
CHUNK_SQL = [(r"\*\*\*\*", "★"), (r"([\p{L}\p{N}_])★([\p{L}\p{N}_])", r"\1** **\2"), ("★", "**"), *[MERGED] * 5, (rf"\*\*[{BLANK}]*\*\*", " "), (r"\*{3,}", "**"), *ENDS, (r"\n{3,}", r"\n\n"), TRIM]
PAGE_SQL = [
    (r"\n{3,}", r"\n\n"), *[MERGED] * 3, (rf"\*{{2,}}[{BLANK}]*\*{{2,}}", ""), (r"\*{4,}", "**"), (r"\*{3}([^*]+)\*{3}", r"**\1**"),
    (rf"([^{BLANK}])[{BLANK}]+\*\*", r"\1**"), (rf"\*\*[{BLANK}]+([^{BLANK}])", r"**\1"),
    (r"([а-яА-ЯёЁa-zA-Z0-9,.])\*\*([а-яА-ЯёЁa-zA-Z0-9])", r"\1 **\2"), (r"([а-яА-ЯёЁa-zA-Z0-9])\*\*([а-яА-ЯёЁa-zA-Z(])", r"\1** \2"), *ENDS, TRIM,
]


def replaced(expr: str, rules: list[tuple[str, str]]) -> str:
    """SQL for rules, one after the other; line feeds of replacements are spelt out."""
    for pattern, to in rules:
        expr = "regexp_replace({}, '{}', {}, 'g')".format(expr, pattern, "'" + to.replace(r"\n", "' || chr(10) || '") + "'")
    return expr


#: Documents with bold marks between words of theirs, so that every rule has work.
MARKED = r"regexp_replace(regexp_replace(coalesce(text, ''), ' ([a-z]+) ', ' **\1** ', 'g'), '([e-k])\. ', '\1**** .  ', 'g')"


def marked(text):
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), " ([a-z]+) ", " **$1** "), r"([e-k])\. ", "$1**** .  ")


@register("markdown_normalize", f"SELECT doc_id, {replaced(MARKED, CHUNK_SQL)} AS markdown FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.markdown_normalised(marked(F.col("text"))).alias("markdown"))


@register("page_normalize", f"SELECT doc_id, {replaced(MARKED, PAGE_SQL)} AS markdown FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.page_normalised(marked(F.col("text"))).alias("markdown"))


# A help page for each document: its lines in turn as headings, paragraphs, steps, list items, notes and tables.
LINE_KINDS = ["SECTION_HEADING", "PARAGRAPH", "NUMBERED_STEP", "BULLET_ITEM_L2", "NOTE", "TABLE"]


def document_pages(spark, sf_dir):
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    forms = ['<p class="p_Head4">{}</p>', '<p class="p_bodytext"><span style="font-weight: bold;">B</span>{}</p>', '<p class="p_Numbered"><span style="display:inline-block;margin-left:-1rem">1.</span>{}</p>', '<p class="p_bulleted2">{}<a class="hmanchor"></a></p>', '<table><tr><td><img src="img/Warning.png"></td><td>{}</td></tr></table>', '<table><tr><td>K</td><td colspan="2">V</td></tr><tr><td>{}</td></tr></table>']

    def line(x, i):
        out = F.lit("")
        for k, form in enumerate(forms):
            before, after = form.split("{}")
            out = F.when(i % len(forms) == k, F.concat(F.lit(before), safe(x), F.lit(after))).otherwise(out)
        return out

    head = F.concat(F.lit('<p class="topictitle"> Doc '), "doc_id", F.lit('&nbsp;</p><p id="ptopic_breadcrumbs"><a>gone</a><a href="s">'), safe(F.coalesce("source", F.lit(""))), F.lit('</a><a href="l">'), F.coalesce("lang", F.lit("")), F.lit('</a></p><div id="hmpagebody_scroller">bare text'))
    lines = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line), "\n")
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id", F.lit(".html")).alias("source_file"), F.concat(head, lines, F.lit('<div class="topicfooter">(c)</div></div>')).alias("html"))


_CELL = replaced("line", [MERGED, MERGED, MERGED, (r"\*{4,}", "**"), (rf"\*{{2,}}[{BLANK}]*\*{{2,}}", "")])
DOC_LINES = f"""ls AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents),
inl AS (SELECT doc_id, i, trim(raw, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS bare, regexp_replace(raw, '[ \t]+', ' ', 'g') AS line FROM ls),
made AS (SELECT doc_id, i, ['SECTION_HEADING', 'PARAGRAPH', 'NUMBERED_STEP', 'BULLET_ITEM_L2', 'NOTE', 'TABLE'][i % 6 + 1] AS block_type,
  CASE i % 6 WHEN 0 THEN '#### ' || trim(line) WHEN 1 THEN trim('**B**' || line) WHEN 2 THEN '1. ' || trim(line) WHEN 3 THEN '  - ' || trim(line)
    WHEN 4 THEN '> ⚠️ **Примечание**' || chr(10) || '> ' || bare
    ELSE '| K | V |   |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || CASE c WHEN '' THEN ' ' ELSE c END || ' |   |   |' END AS markdown,
  CASE WHEN i % 6 = 0 THEN trim(line) ELSE '' END AS heading_text, bare
  FROM (SELECT *, trim(regexp_replace(replace({_CELL.replace("regexp_replace(line", "regexp_replace(bare", 1)}, '|', chr(92) || '|'), '[{BLANK}]+', ' ', 'g')) AS c FROM inl))"""


@register(
    "html_document_blocks",
    f"""WITH {DOC_LINES}, kept AS (SELECT * FROM made WHERE bare <> '' OR i % 6 IN (1, 5))
SELECT 'd' || doc_id || '.html' AS source_file, 'Doc ' || doc_id AS page_title, block_type, md5(markdown) AS digest, heading_text, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS at FROM kept""",
)
def _(spark, sf_dir):
    b = chunking.blocks(document_pages(spark, sf_dir)).where(~F.col("block_type").isin("ANCHOR", "FOOTER"))
    at = F.row_number().over(Window.partitionBy("source_file").orderBy("pos")) - 1
    return b.select("source_file", "page_title", "block_type", F.md5("markdown").alias("digest"), "heading_text", at.alias("at"))


@register("html_tables", f"WITH {DOC_LINES} SELECT 'd' || doc_id || '.html' AS source_file, count(*) AS n, md5(string_agg(markdown, chr(10) ORDER BY i)) AS digest FROM made WHERE block_type = 'TABLE' GROUP BY doc_id")
def _(spark, sf_dir):
    b = chunking.blocks(document_pages(spark, sf_dir)).where("block_type = 'TABLE'")
    texts = F.transform(F.sort_array(F.collect_list(F.struct("pos", "markdown"))), lambda x: x["markdown"])
    return b.groupBy("source_file").agg(F.count("*").alias("n"), F.md5(F.array_join(texts, "\n")).alias("digest"))


@register("page_metadata", "SELECT 'd' || doc_id || '.html' AS source_file, 'Doc ' || doc_id AS page_title, concat_ws(' → ', nullif(trim(coalesce(source, '')), ''), nullif(coalesce(lang, ''), '')) AS page_breadcrumbs FROM documents")
def _(spark, sf_dir):
    return chunking.blocks(document_pages(spark, sf_dir)).select("source_file", "page_title", "page_breadcrumbs").distinct()


@register("page_counters", "SELECT count(*) AS total, count(*) FILTER (WHERE page_id % 5 <> 0) AS converted, count(*) FILTER (WHERE page_id % 5 = 0) AS skipped, 0::BIGINT AS errors FROM pages")
def _(spark, sf_dir):
    p = pages(spark, sf_dir).withColumn("html", F.when(F.col("page_id") % 5 != 0, F.col("html")))
    return chunking.markdown_counters(chunking.markdown(p, ARTICLES))


@register(
    "split_table",
    f"""WITH RECURSIVE {LINES}, o AS (SELECT doc_id, pos + 1 AS i, '| ' || pos || ' | ' || line || ' |' AS row FROM lines), s AS (SELECT *, length(row) + 1 AS size FROM o),
walk AS (SELECT doc_id, i, size + 26 AS size, 0 AS part FROM s WHERE i = 1
  UNION ALL SELECT s.doc_id, s.i, CASE WHEN w.size + s.size > 1500 THEN 26 + s.size ELSE w.size + s.size END, CASE WHEN w.size + s.size > 1500 THEN w.part + 1 ELSE w.part END FROM walk w JOIN s ON s.doc_id = w.doc_id AND s.i = w.i + 1)
SELECT doc_id, part::INTEGER AS part, md5('| N | Line |' || chr(10) || '| --- | --- |' || chr(10) || string_agg(row, chr(10) ORDER BY i)) AS digest FROM walk JOIN s USING (doc_id, i) GROUP BY doc_id, part""",
)
def _(spark, sf_dir):
    rows = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("| "), i.cast("string"), F.lit(" | "), x, F.lit(" |")))
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("| N | Line |\n| --- | --- |\n"), F.array_join(rows, "\n")).alias("markdown"))
    return chunking.split_tables(d).select("doc_id", F.posexplode("parts").alias("part", "t")).select("doc_id", "part", F.md5("t").alias("digest"))


def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("url").alias("source_file"), "html", "page_id")


@register("html_blocks")
def _(spark, sf_dir):
    return chunking.blocks(pages(spark, sf_dir), ARTICLES)


@register("html_chunks")
def _(spark, sf_dir):
    return chunking.chunks(pages(spark, sf_dir), ARTICLES, Chunking(least=50))


@register("html_markdown")
def _(spark, sf_dir):
    return chunking.markdown(pages(spark, sf_dir), ARTICLES)


@register("toc_enrich", "SELECT p.url AS source_file, p.page_id, CASE WHEN page_id % 3 = 0 THEN coalesce(t.title, '') ELSE 'Own ' || page_id END AS page_title, CASE WHEN page_id % 3 = 1 THEN coalesce(t.breadcrumbs, '') ELSE 'Here' END AS page_breadcrumbs FROM pages p LEFT JOIN (SELECT url, 'Page ' || max(page_id) AS title, 'Help → Page ' || max(page_id) AS breadcrumbs FROM pages WHERE page_id % 2 = 0 GROUP BY url) t ON p.url = t.url")
def _(spark, sf_dir):
    p = pages(spark, sf_dir)
    toc = p.where("page_id % 2 = 0").select("source_file", "page_id", F.concat(F.lit("Page "), "page_id").alias("title"), F.concat(F.lit("Help → Page "), "page_id").alias("breadcrumbs"))
    own = {"page_title": F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("Own "), "page_id")), "page_breadcrumbs": F.when(F.col("page_id") % 3 == 1, "").otherwise("Here")}
    return chunking.filled(chunking.with_toc(p.withColumns(own), toc, "page_id")).select("source_file", "page_id", "page_title", "page_breadcrumbs")


@register(
    "toc_tree",
    """WITH RECURSIVE n AS (SELECT coalesce(source, '') AS toc, doc_id AS node, CASE WHEN doc_id >= 40 THEN doc_id // 3 // 10 * 10 + doc_id % 10 END AS parent, doc_id AS position, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'T' || doc_id END AS title, 'f' || doc_id % 97 || '.html' AS source_file FROM documents),
k AS (SELECT * REPLACE ('all' AS toc) FROM n),
walk AS (SELECT node, [position] AS path, CASE WHEN title <> '' THEN [title] ELSE []::VARCHAR[] END AS names FROM k WHERE parent IS NULL
  UNION ALL SELECT k.node, list_append(path, position), CASE WHEN title <> '' THEN list_append(names, title) ELSE names END FROM walk w JOIN k ON k.parent = w.node)
SELECT source_file, arg_max(title, path) AS title, arg_max(array_to_string(names, ' → '), path) AS breadcrumbs, arg_max(EXISTS (SELECT 1 FROM k c WHERE c.parent = walk.node), path) AS has_children FROM walk JOIN k USING (node) GROUP BY source_file""",
)
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("doc_id is not null")
    parent = F.when(F.col("doc_id") >= 40, F.expr("doc_id div 3 div 10 * 10 + doc_id % 10"))
    nodes = d.select(F.lit("all").alias("toc"), F.col("doc_id").alias("node"), parent.alias("parent"), F.col("doc_id").alias("position"), F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit("T"), "doc_id")).alias("title"), F.concat(F.lit("f"), F.col("doc_id") % 97, F.lit(".html")).alias("source_file"), F.lit(None).cast("int").alias("level"), F.lit("").alias("topic_type"))
    return sources.walk_toc(nodes).select("source_file", "title", "breadcrumbs", "has_children")


@register("conversation_sessions_stream", "SELECT conv_id, count(*) AS turns, arg_min(text, turn) AS title, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def _(spark, sf_dir):
    path = f"{work_dir(spark)}/sessions-{uuid.uuid4().hex}"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns.repartition(4, F.rand(1)).write.parquet(f"{path}/in")  # turns of a conversation come in different files
    stream = spark.readStream.schema(turns.schema).parquet(f"{path}/in")
    state.kept(state.sessions(stream), f"{path}/out", f"{path}/checkpoint")
    return state.current(spark, f"{path}/out", "conv_id", state.SESSIONS)


# A stand-in for a model's reply: two proposals, a short one, noise and the question itself.
@register(
    "query_rewrite_expand",
    """WITH v AS (SELECT item_id AS query_id, list_slice(list_concat([text], list_filter(list_slice(list_filter([trim(substr(text, 1, 20)), 'abc', text, trim('Is ' || substr(text, 1, 12))], lambda x: length(x) > 5), 1, 3), lambda x: lower(x) <> lower(text))), 1, 4) AS q FROM (SELECT item_id, trim(replace(text, chr(10), ' ')) AS text FROM benchmark))
SELECT query_id, unnest(range(len(q)))::INTEGER AS list_idx, unnest(q) AS text FROM v""",
)
def _(spark, sf_dir):
    q = questions(spark, sf_dir).withColumn("text", F.trim(F.regexp_replace("text", "\n", " ")))
    lines = [F.concat(F.lit("- "), F.substring("text", 1, 20)), F.lit("- abc"), F.lit("noise"), F.concat(F.lit("-  "), "text"), F.concat(F.lit("- Is "), F.substring("text", 1, 12))]
    return query.variants(q.withColumn("reply", F.concat_ws("\n", *lines)))


def placed(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text", F.col("source").alias("source_file"), F.concat(F.lit("Doc "), "doc_id").alias("page_title"), F.lit("").alias("section_path"), "lang")
    return bm25(spark, sf_dir, 3).join(d, "doc").withColumn("breadcrumbs", F.when(F.col("doc") % 2 == 0, F.col("page_title")).otherwise(F.col("lang")))


CONTEXT = f"""{bm25_sql(QUESTIONS, 3)}, placed AS (SELECT r.*, text, source, lang FROM ranked r JOIN documents ON doc = doc_id)"""


@register("context_blocks", f"WITH {CONTEXT} SELECT query_id, md5(string_agg('[Источник ' || (rank + 1) || '] Doc ' || doc || CASE WHEN doc % 2 = 0 THEN '' ELSE chr(10) || '  Раздел: ' || lang END || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS digest, count(*)::INTEGER AS n_refs FROM placed GROUP BY query_id")
def _(spark, sf_dir):
    return query.contexts(placed(spark, sf_dir)).select("query_id", F.md5("context").alias("digest"), F.size("refs").alias("n_refs"))


# How a model may end its answer: each form of a list of sources, and none.
TAIL = ["\n\n---\n **Источник** [2], [7]", "\n## источники\n- [2]", "\n**Источники**: [1]", "\nИсточник: [2]", "\nSources: none"]
_TAIL_SQL = "[" + ", ".join("'" + t.replace("\n", "' || chr(10) || '") + "'" for t in TAIL) + "][query_id % 5 + 1]"


@register(
    "citations",
    f"""WITH {CONTEXT},
refs AS (SELECT query_id, count(*) AS n, list({{'t': '[Doc ' || doc || '](https://help.example/' || source || ')', 'u': '(https://help.example/' || source || ')'}} ORDER BY rank) AS r FROM placed GROUP BY query_id),
body AS (SELECT query_id, n, r, 'See [[1]]' || r[1].u || ' and ' || CASE WHEN n >= 3 THEN '[[3]]' || r[3].u ELSE '[03]' END || ', not [9] or [[2]].' || CASE WHEN query_id % 5 = 4 THEN chr(10) || 'Sources: none' ELSE '' END AS b,
  list_filter([1, CASE WHEN query_id % 5 IN (0, 1, 3) AND n >= 2 THEN 2 END, CASE WHEN n >= 3 THEN 3 END], lambda x: x IS NOT NULL) AS used FROM refs)
SELECT query_id, b || chr(10) || chr(10) || '**Источники:**' || chr(10) || array_to_string(list_transform(used, lambda x: '- [' || x || '] ' || r[x].t), chr(10)) AS cited FROM body""",
)
def _(spark, sf_dir):
    c = query.contexts(placed(spark, sf_dir), "https://help.example")
    tail = F.element_at(F.array(*map(F.lit, TAIL)), (F.col("query_id") % len(TAIL) + 1).cast("int"))
    return query.cited(c.withColumn("answer", F.concat(F.lit("See [1] and [03], not [9] or [[2]]."), tail))).select("query_id", "cited")


@register(
    "judge_parse",
    """WITH r AS (SELECT *, '{"faithfulness":{"score":"yes","reason":"' || role || '"}}' AS j FROM conversations)
SELECT conv_id, turn, CASE WHEN turn % 5 IN (2, 3) THEN 'error' ELSE 'yes' END AS score, CASE turn % 5 WHEN 2 THEN 'Here:' || chr(10) || '```json' || chr(10) || j || chr(10) || '```' WHEN 3 THEN j || ' done' ELSE role END AS reason, turn % 5 = 4 AS further FROM r""",
)
def _(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    bare = F.to_json(F.struct(F.struct(F.lit("yes").alias("score"), F.col("role").alias("reason")).alias("faithfulness")))
    fenced = F.concat(F.lit("```json\n"), bare, F.lit("\n```"))
    further = F.concat(F.lit('{"overall": 3, '), F.substring(bare, 2, 1 << 30))
    kind = F.col("turn") % 5
    reply = F.when(kind == 0, F.concat(F.lit(" "), fenced, F.lit("\n"))).when(kind == 1, bare).when(kind == 2, F.concat(F.lit("Here:\n"), fenced)).when(kind == 3, F.concat(bare, F.lit(" done"))).otherwise(further)
    judged_ = c.withColumn("j", evaluate.judgment(reply))
    j = F.element_at("j", F.lit("faithfulness"))
    return judged_.select("conv_id", "turn", j["score"].alias("score"), j["reason"].alias("reason"), F.map_contains_key("j", F.lit("overall")).alias("further"))


@register(
    "rerank_topk",
    f"""WITH {bm25_sql(QUESTIONS, 20)},
pairs AS (SELECT r.query_id, r.rank, r.doc, (SELECT list_distinct({TOKENS.replace("text", "b.text")})) AS asked, {TOKENS.replace("text", "substr(d.text, 1, 2048)")} AS has FROM ranked r JOIN benchmark b ON b.item_id = r.query_id JOIN documents d ON d.doc_id = r.doc),
rescored AS (SELECT query_id, rank AS old, doc, 1 / (1 + exp(-(6.0::DOUBLE * len(list_intersect(asked, has)) / greatest(len(asked), 1) - 2.0))) AS s FROM pairs)
SELECT query_id, doc, round(s, 4) AS reranker_score, (row_number() OVER (PARTITION BY query_id ORDER BY s DESC, old) - 1)::INTEGER AS rank FROM rescored QUALIFY rank < 5""",
)
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    rows = bm25(spark, sf_dir, 20).drop("score").join(d, "doc").join(questions(spark, sf_dir).withColumnRenamed("text", "question"), "query_id")
    pairs = query.scored(rows, "overlap", models.overlap_scorer)
    return query.rerank(pairs, F.col("logit"), 5).select("query_id", "doc", "reranker_score", "rank")


@register("conversation_sessions", "SELECT conv_id, count(*) AS turns, arg_min(text, turn) AS title, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def _(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.min_by("text", "turn").alias("title"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",").alias("roles"))


@register("doc_length_stats", f"WITH {INDEX} SELECT n AS n_docs, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM terms) AS n_terms FROM totals")
def _(spark, sf_dir):
    index = lexical.build(table(spark, sf_dir, "documents"))
    return index.totals.join(index.terms.agg(F.count("*").alias("n_terms"))).select("n_docs", F.round("avgdl", 6).alias("avgdl"), "n_terms")


@register(
    "split_large_block",
    f"""WITH RECURSIVE {LINES}, n AS (SELECT doc_id, pos, length(line) AS n FROM lines WHERE doc_id IN (SELECT doc_id FROM documents WHERE length(text) > 3000)),
walk AS (SELECT doc_id, pos, n AS size, 0 AS part FROM n WHERE pos = 0
  UNION ALL SELECT n.doc_id, n.pos, CASE WHEN w.size + n.n > 1500 THEN n.n ELSE w.size + n.n END, CASE WHEN w.size + n.n > 1500 THEN w.part + 1 ELSE w.part END FROM walk w JOIN n ON n.doc_id = w.doc_id AND n.pos = w.pos + 1)
SELECT doc_id, part::INTEGER AS part, sum(length(line) + 1)::BIGINT - 1 AS size FROM walk JOIN lines USING (doc_id, pos) GROUP BY doc_id, part""",
)
def _(spark, sf_dir):
    d = chunking.pack_lines(table(spark, sf_dir, "documents").where(F.length("text") > Chunking().most).select("doc_id", "text"))
    return d.select("doc_id", F.posexplode("parts").alias("part", "t")).select("doc_id", "part", F.length("t").cast("long").alias("size"))


@register("csv_export_view", "SELECT doc_id::VARCHAR AS chunk_id, source AS source_file, 'T' || doc_id AS page_title, lang AS section_title, '' AS breadcrumbs, lang || ';' || source AS block_types, length(text)::INTEGER AS char_count, (length(text) // 4)::INTEGER AS token_count_approx, doc_id % 2 = 0 AS has_table, doc_id % 3 = 0 AS has_procedure, doc_id % 5 = 0 AS has_image, (doc_id % 7)::INTEGER AS chunk_index, replace(substr(text, 1, 150), chr(10), ' ') AS text_preview FROM documents")
def _(spark, sf_dir):
    i = F.col("doc_id")
    more = {"page_title": F.concat(F.lit("T"), i), "section_title": F.col("lang"), "breadcrumbs": F.lit(""), "token_count_approx": F.expr("char_count div 4").cast("int"), "has_table": i % 2 == 0, "has_procedure": i % 3 == 0, "has_image": i % 5 == 0, "chunk_index": (i % 7).cast("int")}
    return sources.csv_view(chunk_facts(spark, sf_dir).withColumns({"id": i.cast("string"), "block_types": F.array("lang", "source_file"), **more}))


@register("query_texts", "SELECT item_id AS query_id, 'Instruct: Find the passage' || chr(10) || 'Query: ' || text AS text FROM benchmark")
def _(spark, sf_dir):
    return questions(spark, sf_dir).withColumn("text", X.instruct_query("Find the passage", F.col("text")))


@register("paths_and_urls", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE source || ' > ' || lang END AS section_path, 'https://help.example/' || source AS url FROM documents")
def _(spark, sf_dir):
    section = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", X.section_path(F.col("source"), section).alias("section_path"), X.source_url("https://help.example/", F.col("source")).alias("url"))


@register("cleaning_counters", "SELECT count(*) AS chunks, count(*) FILTER (WHERE s) AS stopped, count(*) FILTER (WHERE NOT s) - count(DISTINCT text) FILTER (WHERE NOT s) AS duplicates, count(DISTINCT text) FILTER (WHERE NOT s) AS documents FROM (SELECT text, contains(text, 'worthless') OR contains(text, 'Apache License') AS s FROM documents)")
def _(spark, sf_dir):
    return corpus.counters(table(spark, sf_dir, "documents"), STOP)


@register("weak_queries", f"WITH {METRICS} SELECT query_idx, p5_strict FROM metrics WHERE p5_strict < 0.7")
def _(spark, sf_dir):
    return evaluate.weak(evaluate.query_metrics(labelled(spark, sf_dir)), 0.7).select("query_idx", "p5_strict")


@register("best_config", f"WITH {METRICS} SELECT arg_max(config, {{'m': m, 'o': -ord}}) AS best FROM (SELECT 'config' || query_idx % 5 AS config, query_idx % 5 AS ord, round(avg(mrr_strict)::DECIMAL(18, 9), 4)::DOUBLE AS m FROM metrics GROUP BY 1, 2)")
def _(spark, sf_dir):
    m = evaluate.query_metrics(labelled(spark, sf_dir)).withColumn("ord", F.col("query_idx") % 5)
    means = evaluate.summary(m, ("ord",)).select(F.concat(F.lit("config"), "ord").alias("config"), F.col("ord").cast("int").alias("ord"), F.col("mrr_strict").alias("MRR"))
    return sources.best_config(means, "MRR")


@register(
    "label_lookup",
    f"""WITH {bm25_sql(QUESTIONS, 5)}, truth AS (SELECT doc_id % 50 AS query_idx, source, arg_max({LABEL}, doc_id) AS label FROM labels JOIN documents USING (doc_id) GROUP BY ALL)
SELECT r.query_id AS query_idx, r.doc, coalesce(t.label, 'irrelevant') AS label FROM ranked r JOIN documents d ON d.doc_id = r.doc LEFT JOIN truth t ON t.query_idx = r.query_id AND t.source = d.source""",
)
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("source_file"))
    found = bm25(spark, sf_dir, 5).join(d.withColumnRenamed("doc_id", "doc"), "doc").withColumnRenamed("query_id", "query_idx")
    return evaluate.labelled(found, truth(spark, sf_dir)).select("query_idx", "doc", "label")


def truth(spark, sf_dir):
    """Judgments by query and file, in the order of doc_idx."""
    label = F.when(F.col("toxic") == 1, "irrelevant").when(F.col("quality") == 1, "relevant").otherwise("partial")
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("source_file"))
    return table(spark, sf_dir, "labels").join(d, "doc_id").select((F.col("doc_id") % 50).alias("query_idx"), "source_file", F.col("doc_id").alias("doc_idx"), label.alias("label"))


@register("metrics_report", f"WITH {METRICS} SELECT count(*)::INTEGER AS n_queries, count(*)::INTEGER AS n_rows, round(avg(p5_strict)::DECIMAL(18, 9), 4)::DOUBLE AS p5_strict, round(avg(ndcg5)::DECIMAL(18, 9), 4)::DOUBLE AS ndcg5, round(avg(mrr_lenient)::DECIMAL(18, 9), 4)::DOUBLE AS mrr_lenient, (SELECT round(recall5_strict, 9) FROM metrics ORDER BY query_idx LIMIT 1) AS first_recall5 FROM metrics")
def _(spark, sf_dir):
    r = evaluate.report(evaluate.query_metrics(labelled(spark, sf_dir)))
    read = lambda path, kind="double": F.get_json_object("report", path).cast(kind)
    rows = F.size(F.from_json(F.get_json_object("report", "$.per_query"), "array<struct<query_idx long>>"))
    return r.select(read("$.n_queries", "int").alias("n_queries"), rows.alias("n_rows"), *[read(f"$.summary.{c}").alias(c) for c in ("p5_strict", "ndcg5", "mrr_lenient")], F.round(read("$.per_query[0].recall5_strict"), 9).alias("first_recall5"))


@register("query_names", f"WITH {METRICS} SELECT query_idx, coalesce(b.text, 'q' || query_idx) AS query, p5_strict FROM metrics LEFT JOIN (SELECT * FROM benchmark WHERE item_id % 2 = 0) b ON b.item_id = query_idx")
def _(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").where("item_id % 2 = 0").select(F.col("item_id").alias("query_idx"), F.col("text").alias("query"))
    return evaluate.named(evaluate.query_metrics(labelled(spark, sf_dir)), q).select("query_idx", "query", "p5_strict")


@register("config_timings", "SELECT role AS config, avg(length(text) / 1000.0::DOUBLE) AS avg_time, sum(turn + 1)::BIGINT AS rows, round(sum(turn + 1) / sum(length(text) / 1000.0::DOUBLE), 6) AS rows_per_second FROM conversations GROUP BY role")
def _(spark, sf_dir):
    log = table(spark, sf_dir, "conversations").select(F.col("role").alias("config"), (F.length("text") / 1000.0).alias("seconds"), (F.col("turn") + 1).cast("long").alias("rows"))
    return evaluate.timings(log).withColumn("rows_per_second", F.round("rows_per_second", 6))


def stub(reply):
    """A stand-in for a model: a function of its last message."""
    return lambda: lambda messages: reply(messages[-1]["content"])


@register(
    "judged_labels",
    f"""WITH {bm25_sql(QUESTIONS, 5)}, truth AS (SELECT doc_id % 50 AS query_idx, source AS source_file, max(doc_id) AS doc_idx, arg_max({LABEL}, doc_id) AS label FROM labels JOIN documents USING (doc_id) GROUP BY ALL),
top AS (SELECT DISTINCT ON (query_id, source) query_id AS query_idx, source AS source_file FROM ranked JOIN documents ON doc = doc_id),
new AS (SELECT top.* FROM top ANTI JOIN truth USING (query_idx, source_file)),
seen AS (SELECT query_idx, max(doc_idx) AS last FROM truth GROUP BY query_idx)
SELECT query_idx, source_file, doc_idx, label FROM truth UNION ALL
SELECT n.query_idx, source_file, coalesce(last, -1) + row_number() OVER (PARTITION BY n.query_idx ORDER BY source_file), CASE WHEN ascii(right(source_file, 1)) % 2 = 0 THEN 'partial' ELSE 'irrelevant' END FROM new n LEFT JOIN seen USING (query_idx)""",
)
def _(spark, sf_dir):
    seen: dict[str, int] = {}

    def reply(asked):
        file = asked.split("Файл: ")[1].split("\n")[0]
        if ord(file[-1]) % 2:
            return "nonsense"
        seen.setdefault(asked, 0)
        seen[asked] += 1  # nonsense first, then a label
        return '```json\n{"label": "partial", "reason": "r"}\n```' if seen[asked] > 1 else "Let me think"

    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("source_file"), "text")
    rows = bm25(spark, sf_dir, 5).join(d, "doc").join(questions(spark, sf_dir).withColumnRenamed("text", "question"), "query_id").withColumnRenamed("query_id", "query_idx")
    one = truth(spark, sf_dir).groupBy("query_idx", "source_file").agg(F.max("doc_idx").alias("doc_idx"), F.max_by("label", "doc_idx").alias("label"))
    return with_judged(rows.select("query_idx", "question", "source_file", "rank", "text"), one, stub(reply), attempts=2, wait=0.0)


@register(
    "answer_flow",
    f"""WITH {CONTEXT}, b AS (SELECT item_id AS query_id, text FROM benchmark UNION ALL SELECT -1, 'of no')
SELECT b.query_id, CASE WHEN count(p.doc) = 0 THEN 'К сожалению, я не нашёл информации по этому вопросу в документации продукта. Попробуйте переформулировать вопрос или уточнить тему.'
  ELSE 'Ответ на ' || md5(any_value(b.text)) || ' [[1]](https://help.example/' || arg_min(source, rank) || ')' || chr(10) || chr(10) || '**Источники:**' || chr(10) || '- [1] [Doc ' || arg_min(doc, rank) || '](https://help.example/' || arg_min(source, rank) || ')' END AS answer,
  count(p.doc)::INTEGER AS n_sources FROM b LEFT JOIN placed p ON p.query_id = b.query_id GROUP BY b.query_id""",
)
def _(spark, sf_dir):
    def reply(asked):
        import hashlib

        question = asked.rsplit("Вопрос: ", 1)[1].rsplit("\n\nОтвет (", 1)[0]
        return f"Ответ на {hashlib.md5(question.encode()).hexdigest()} [1]\n\n**Источники:**"

    got = answers.ask(asked_of(spark, sf_dir), placed(spark, sf_dir), stub(reply), "https://help.example", "продукта")
    return got.select("query_id", "answer", F.size("sources").alias("n_sources"))


def asked_of(spark, sf_dir):
    """The questions, and one that finds nothing."""
    q = questions(spark, sf_dir)
    return q.unionByName(spark.range(1).select(F.lit(-1).cast(q.schema["query_id"].dataType).alias("query_id"), F.lit("of no").alias("text")))


@register(
    "generation_eval",
    f"""WITH {CONTEXT}, b AS (SELECT item_id AS query_id FROM benchmark UNION ALL SELECT -1),
said AS (SELECT b.query_id, count(p.doc) AS n_docs, coalesce(sum(length(source) + length('Doc ' || doc) + length(substr(text, 1, 1500)) + length('' || (rank + 1)) + 36), 0) AS chars FROM b LEFT JOIN placed p ON p.query_id = b.query_id GROUP BY b.query_id),
judged AS (SELECT *, CASE WHEN query_id % 4 = 3 THEN 'error' WHEN n_docs = 0 THEN 'no' ELSE 'yes' END AS s FROM said)
SELECT c AS criterion, count(*) FILTER (WHERE s = 'yes' AND c <> 'helpfulness') AS yes, count(*) FILTER (WHERE s = 'no' AND c <> 'helpfulness') AS "no", count(*) FILTER (WHERE s = 'error' OR c = 'helpfulness') AS error, sum(n_docs)::BIGINT AS n_docs, sum(CASE WHEN s = 'error' THEN 0 ELSE least(chars, 6000) END)::BIGINT AS chars
FROM judged, (SELECT unnest(['faithfulness', 'completeness', 'relevance', 'helpfulness']) AS c) GROUP BY c""",
)
def _(spark, sf_dir):
    def reply(asked):
        import json

        seen = asked.split("## Найденные фрагменты документации\n", 1)[1].split("\n\n## Ответ системы\n", 1)[0]
        score = "no" if "Не найдено информации." in asked else "yes"
        if "\nfail " in asked:
            raise ValueError("judge")
        return json.dumps({c: {"score": score, "reason": str(len(seen))} for c in evaluate.CRITERIA[:3]})

    q = asked_of(spark, sf_dir).select("query_id", F.when(F.pmod("query_id", F.lit(4)) == 3, F.concat(F.lit("fail "), "text")).otherwise(F.lit("x")).alias("question"), F.lit("said").alias("answer"))
    q = q.withColumn("question", F.when(F.col("query_id") < 0, "x").otherwise(F.col("question")))
    judged_ = answers.judge(q, placed(spark, sf_dir), stub(reply))
    chars = F.coalesce(F.try_element_at("judgment", F.lit("faithfulness"))["reason"].try_cast("long"), F.lit(0))
    facts = judged_.agg(F.sum("n_docs").alias("n_docs"), F.sum(chars).alias("chars"))
    return answers.evaluated(judged_).select("criterion", "yes", "no", "error").join(facts)  # one row on the right


@register("answers", f"WITH {CONTEXT} SELECT b.item_id AS query_id, CASE WHEN count(p.doc) = 0 THEN 'К сожалению, я не нашёл информации по этому вопросу в документации продукта. Попробуйте переформулировать вопрос или уточнить тему.' END AS answer, count(p.doc)::INTEGER AS n_refs FROM (SELECT item_id FROM benchmark UNION ALL SELECT -1) b LEFT JOIN placed p ON p.query_id = b.item_id GROUP BY b.item_id")
def _(spark, sf_dir):
    return query.answered(asked_of(spark, sf_dir), placed(spark, sf_dir), product="продукта").select("query_id", "answer", F.when(F.col("refs").isNull(), 0).otherwise(F.size("refs")).alias("n_refs"))


def retriever(spark, sf_dir):
    """documents, their BM25 index, and the vectors that have a document's id."""
    c = chunk_rows(spark, sf_dir).select(F.col("doc_id").alias("doc"), "source_file", "chunk_index", "text")
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), "embedding")
    return Retriever(c, index(spark, sf_dir), v.join(c.select("doc"), "doc", "left_semi"))


def embedded(spark, sf_dir, rows):
    """Variants with the vector of their question's id."""
    return rows.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")


HYBRID = f"""{bm25_sql("SELECT item_id AS query_id, text FROM benchmark WHERE item_id IN (SELECT vec_id FROM embeddings)", 30)}, {CHUNK_ROWS},
close AS (SELECT q.vec_id AS query_id, v.vec_id AS doc, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 9) AS score
  FROM embeddings q, embeddings v WHERE q.vec_id IN (SELECT item_id FROM benchmark) AND v.vec_id IN (SELECT doc_id FROM documents)),
lists AS (SELECT query_id, 1 AS list_idx, rank, doc FROM ranked UNION ALL SELECT query_id, 0, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) - 1 AS rank, doc FROM close QUALIFY rank < 30),
summed AS (SELECT query_id, doc, round(sum(1 / (60.0::DOUBLE + rank + 1)), 9) AS score, min({{'l': list_idx, 'r': rank}}) AS seen FROM lists GROUP BY query_id, doc),
fused AS (SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, doc) - 1 AS rank FROM summed),
led AS (SELECT f.*, source_file, chunk_index, text, min(rank) OVER (PARTITION BY query_id, source_file) AS lead FROM fused f JOIN chunks ON doc = doc_id),
files AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY lead) AS file_rank FROM led QUALIFY file_rank <= 5),
best AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY query_id, source_file ORDER BY rank) <= 2)"""


MERGED_PAGES = "SELECT query_id, source_file, md5(string_agg(text, chr(10) || chr(10) ORDER BY chunk_index, rank)) AS digest, (row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) - 1)::INTEGER AS rank FROM best GROUP BY query_id, source_file"


def retrieved(spark, sf_dir, top_k=0):
    asked = embedded(spark, sf_dir, questions(spark, sf_dir).withColumn("list_idx", F.lit(0)))
    return retriever(spark, sf_dir).retrieve(asked, top_k=top_k).select("query_id", "source_file", F.md5("text").alias("digest"), "rank")


@register("hybrid_retrieve", f"WITH {HYBRID} {MERGED_PAGES}")
def _(spark, sf_dir):
    return retrieved(spark, sf_dir)


@register("hybrid_retrieve_top2", f"WITH {HYBRID.replace('file_rank <= 5', 'file_rank <= 2')} {MERGED_PAGES}")
def _(spark, sf_dir):
    return retrieved(spark, sf_dir, 2)


_VARIANTS = "SELECT item_id * 2 AS query_id, text FROM benchmark WHERE item_id IN (SELECT vec_id FROM embeddings) UNION ALL SELECT item_id * 2 + 1, substr(text, 1, length(text) // 2) FROM benchmark WHERE item_id IN (SELECT vec_id FROM embeddings)"
ABLATION = f"""WITH {bm25_sql(_VARIANTS, 20)},
close AS (SELECT q.vec_id AS query_id, v.vec_id AS doc, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 9) AS near
  FROM embeddings q, embeddings v WHERE q.vec_id IN (SELECT item_id FROM benchmark) AND v.vec_id IN (SELECT doc_id FROM documents)),
lists AS (SELECT query_id // 2 AS query_id, query_id % 2 * 2 + 1 AS list_idx, rank, doc FROM ranked UNION ALL
  SELECT query_id, unnest([0, 2]), rank, doc FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY near DESC, doc) - 1 AS rank, doc FROM close QUALIFY rank < 20)),
configs AS (SELECT m.m * 4 + w.w * 2 + r.r AS ord, ['bm25', 'vector', 'hybrid'][m.m + 1] || CASE w.w WHEN 1 THEN '+rewrite' ELSE '' END || CASE r.r WHEN 1 THEN '+rerank' ELSE '' END AS config, m.m AS mode, w.w AS more, r.r AS again
  FROM range(3) m(m), range(2) w(w), range(2) r(r)),
picked AS (SELECT ord, again, l.* FROM configs, lists l WHERE (mode = 2 OR mode = (list_idx + 1) % 2) AND (more = 1 OR list_idx < 2)),
summed AS (SELECT ord, again, query_id, doc, round(sum(1 / (60.0::DOUBLE + rank + 1)), 9) AS score, min({{'l': list_idx, 'r': rank}}) AS seen FROM picked GROUP BY ALL),
fused AS (SELECT *, row_number() OVER (PARTITION BY ord, query_id ORDER BY score DESC, seen, doc) - 1 AS rank FROM summed),
firsts AS (SELECT f.*, source, text FROM fused f JOIN documents ON doc = doc_id QUALIFY row_number() OVER (PARTITION BY ord, query_id, source ORDER BY rank) = 1),
depth AS (SELECT *, row_number() OVER (PARTITION BY ord, query_id ORDER BY rank) - 1 AS place FROM firsts QUALIFY place < 5 + 10 * again),
pairs AS (SELECT d.*, (SELECT list_distinct({TOKENS.replace("text", "b.text")})) AS q, {TOKENS.replace("text", "substr(d.text, 1, 2048)")} AS has FROM depth d JOIN benchmark b ON b.item_id = d.query_id),
final AS (SELECT ord, query_id, source, pos AS rank FROM (SELECT ord, query_id, source, row_number() OVER (PARTITION BY ord, query_id ORDER BY CASE again WHEN 1 THEN round(1 / (1 + exp(-(6.0::DOUBLE * len(list_intersect(q, has)) / greatest(len(q), 1) - 2.0))), 9) END DESC, place) AS pos FROM pairs) WHERE pos <= 5),
truth AS (SELECT doc_id % 50 AS query_id, source, arg_max({LABEL}, doc_id) AS label FROM labels JOIN documents USING (doc_id) GROUP BY ALL),
every AS (SELECT ord, config, item_id AS query_id, p AS rank FROM configs, (SELECT item_id FROM benchmark WHERE item_id IN (SELECT vec_id FROM embeddings)), range(1, 6) t(p)),
graded AS (SELECT ord, config, query_id, rank, coalesce(label, 'irrelevant') AS label, CASE label WHEN 'relevant' THEN 2.0 WHEN 'partial' THEN 1.0 ELSE 0.0 END::DOUBLE AS g FROM every LEFT JOIN final USING (ord, query_id, rank) LEFT JOIN truth USING (query_id, source)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY ord, query_id ORDER BY g DESC, rank) AS i FROM graded),
each AS (SELECT ord, config, query_id, count(*) FILTER (WHERE label = 'relevant' AND rank <= 3) / 3.0::DOUBLE AS p3, count(*) FILTER (WHERE label = 'relevant') / 5.0::DOUBLE AS p5,
  coalesce(round(sum(g / log2(rank + 1)) / nullif(sum(g / log2(i + 1)), 0), 9), 0) AS n5, coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE label = 'relevant'), 0) AS rr FROM ordered GROUP BY ALL)
SELECT config, ord::INTEGER AS ord, round(avg(p3)::DECIMAL(18, 9), 4)::DOUBLE AS "P@3", round(avg(p5)::DECIMAL(18, 9), 4)::DOUBLE AS "P@5", round(avg(n5)::DECIMAL(18, 9), 4)::DOUBLE AS "NDCG@5", round(avg(rr)::DECIMAL(18, 9), 4)::DOUBLE AS "MRR" FROM each GROUP BY config, ord"""


@register("ablation_run", ABLATION)
def _(spark, sf_dir):
    q = questions(spark, sf_dir)
    asked = embedded(spark, sf_dir, q.withColumn("list_idx", F.lit(0)))
    half = F.expr("substring(text, 1, cast(length(text) div 2 as int))")
    more = asked.unionByName(embedded(spark, sf_dir, q.select("query_id", half.alias("text"), F.lit(1).alias("list_idx"))))
    return ablate(retriever(spark, sf_dir), asked, more, truth(spark, sf_dir), query.overlap_logit(F.col("question"), query.clipped(F.col("text"))))
