"""The jobs as queries: each runs its function twice into one new folder and returns what then stands there."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.plans.queries import LABEL, QUESTIONS, TOKENS, bm25_sql
from quillspark.plans.queries import _metric_sql as metric_sql
from quillspark.session import work_dir

from . import corpus_refresh, retrieval_report

HERE = os.path.dirname(os.path.abspath(__file__))


def folder(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1(spark: SparkSession, sf_dir: str) -> DataFrame:
    output, config = folder(spark, "corpus_refresh"), corpus_refresh.load(f"{HERE}/corpus_refresh.json")
    for _ in range(2):
        out = corpus_refresh.run(spark, f"{sf_dir}/documents.parquet", output, None, config)
    return out.drop("text")


def job2(spark: SparkSession, sf_dir: str) -> DataFrame:
    output, config = folder(spark, "retrieval_report"), retrieval_report.load(f"{HERE}/retrieval_report.json")
    for _ in range(2):
        out = retrieval_report.run(spark, *(f"{sf_dir}/{t}.parquet" for t in ("documents", "benchmark", "labels")), output, config)
    return out


CORPUS_SQL = f"""
SELECT doc_id, substr(md5(concat_ws('::', source, doc_id::VARCHAR, substr(text, 1, 200))), 1, 12) AS chunk_id, source AS source_file, lang, md5(text) AS text_key,
  length(text)::BIGINT AS char_count, len({TOKENS})::INTEGER AS n_tokens, 0 AS batch
FROM documents WHERE length(text) >= 1 AND NOT contains(text, 'worthless') AND NOT contains(text, 'Apache License')
QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id NULLS LAST, source NULLS LAST, lang NULLS LAST) = 1"""

REPORT_SQL = f"""
WITH {bm25_sql(QUESTIONS, 20)},
configs AS (SELECT * FROM (VALUES ('bm25', 5, false), ('bm25_rerank', 15, true)) v(config, depth, again)),
firsts AS (SELECT r.*, d.source, d.text FROM ranked r JOIN documents d ON doc = doc_id QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY rank) = 1),
places AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS place FROM firsts),
picked AS (SELECT config, again, p.*, (SELECT list_distinct({TOKENS.replace("text", "b.text")})) AS q, {TOKENS.replace("text", "substr(p.text, 1, 2048)")} AS has
  FROM configs JOIN places p ON place < depth JOIN benchmark b ON b.item_id = p.query_id),
final AS (SELECT config, query_id, source, pos AS rank FROM (
  SELECT config, query_id, source, row_number() OVER (PARTITION BY config, query_id ORDER BY CASE WHEN again THEN 1 / (1 + exp(-(6.0::DOUBLE * len(list_intersect(q, has)) / greatest(len(q), 1) - 2.0))) END DESC, place) AS pos FROM picked) WHERE pos <= 5),
truth AS (SELECT doc_id % 50 AS query_id, source, arg_max({LABEL}, doc_id) AS label FROM labels JOIN documents USING (doc_id) GROUP BY ALL),
every AS (SELECT config, item_id AS query_id, p AS rank FROM configs, benchmark, range(1, 6) t(p)),
graded AS (SELECT config, query_id AS query_idx, rank, coalesce(label, 'irrelevant') AS label, CASE label WHEN 'relevant' THEN 2.0 WHEN 'partial' THEN 1.0 ELSE 0.0 END::DOUBLE AS g
  FROM every LEFT JOIN final USING (config, query_id, rank) LEFT JOIN truth USING (query_id, source)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY config, query_idx ORDER BY g DESC, rank) AS i FROM graded)
SELECT config, query_idx, {metric_sql()} FROM ordered GROUP BY config, query_idx"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_corpus_refresh": job1, "job2_retrieval_report": job2}
SQL: dict[str, str] = {"job1_corpus_refresh": CORPUS_SQL, "job2_retrieval_report": REPORT_SQL}
