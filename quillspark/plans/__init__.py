"""Whole dataflows: corpus, index, retrieval, ablation."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import sources
from ..config import Engine
from ..functions import text as X
from ..operators import answers, blockmax, chunking, corpus, evaluate, fusion, lexical, models, query, store, vector
from ..operators.html import Options
from ..session import discarding, saved


def build_corpus(pages: DataFrame, toc: DataFrame | None = None, options: Options = Options(), engine: Engine = Engine()) -> DataFrame:
    """Chunks of pages, titles and breadcrumbs filled from a table of contents where pages lack them."""
    if toc is not None:
        pages = chunking.with_toc(pages, toc)
    return chunking.chunks(pages, options, engine.chunking, toc=toc is not None)


def build_results(pages: DataFrame, toc: DataFrame | None = None, options: Options = Options(), engine: Engine = Engine()) -> DataFrame:
    """``build_corpus`` page by page, with status and error; ``chunking.page_counters`` sums them up."""
    if toc is not None:
        pages = chunking.with_toc(pages, toc)
    return chunking.page_results(pages, options, engine.chunking, toc=toc is not None)


def clean_corpus(chunks: DataFrame, stop: list[str] = (), order: str = "ord") -> DataFrame:
    """Documents to index: stop patterns first, then exact deduplication, then projection."""
    return corpus.to_documents(corpus.deduplicate(corpus.without(chunks, list(stop)), order=order))


@dataclass
class Retriever:
    """Hybrid retrieval for tables of queries."""

    docs: DataFrame  # doc, source_file, chunk_index, text and further columns
    lexical: lexical.Index | None = None
    vectors: DataFrame | None = None  # doc, embedding
    engine: Engine = field(default_factory=Engine)
    pruned: blockmax.Blocks | None = None  # the same documents, searched instead of ``lexical`` where no filter is in the way

    def ranked(self, variants: DataFrame, mode: str, k: int, filtered: Column | None = None, filter_lexical: bool = False) -> DataFrame:
        """(query_id, list_idx, rank, doc) of each variant (query_id, list_idx, text, embedding). ``filtered`` holds
        for the vector side; for the lexical one only with filter_lexical."""
        if mode not in ("bm25", "vector", "hybrid"):
            raise ValueError(f"unknown mode {mode}")
        width = (variants.agg(F.max("list_idx")).first()[0] or 0) + 1
        keyed = variants.withColumn("v", F.col("query_id").cast("long") * width + F.col("list_idx"))
        fine = self.docs.where(filtered).select("doc") if filtered is not None else None
        lists = []
        if mode in ("vector", "hybrid") and self.vectors is not None:
            space = self.vectors if fine is None else self.vectors.join(fine, "doc", "left_semi")
            near = vector.topk(space, keyed, k, "doc", "v").select("query_id", "rank", F.col("vec_id").alias("doc"))
            lists.append(near.withColumn("side", F.lit(0)))
        if mode in ("bm25", "hybrid") and self.lexical is not None:
            index = self.lexical
            if fine is not None and filter_lexical:
                # before the k best are taken; the weights of terms stay those of all documents
                index = lexical.Index(index.postings.join(fine, "doc", "left_semi"), index.terms, index.totals)
            asked, plain = keyed.select("v", "text"), self.pruned is None or (fine is not None and filter_lexical)
            hits = lexical.search(index, asked, k, "v") if plain else blockmax.search(self.pruned, asked, k, "v").found
            lists.append(hits.select("query_id", "rank", "doc").withColumn("side", F.lit(1)))
        out = lists[0] if len(lists) == 1 else lists[0].unionByName(lists[1])
        place = F.pmod(F.col("query_id"), F.lit(width))
        return out.select(((F.col("query_id") - place) / width).cast("long").alias("query_id"), (place * 2 + F.col("side")).cast("int").alias("list_idx"), "rank", "doc")

    def retrieve(self, variants: DataFrame, mode: str = "hybrid", top_k: int = 0, logit: Column | Callable[[], models.PairScorer] | None = None, questions: DataFrame | None = None, filtered: Column | None = None) -> DataFrame:
        """Merged pages of each query (query_id, rank from 0, ...): the first ``top_k`` files (0: the setting) in fused
        order; with a logit (over question and text) or what makes a model of pairs, the best of the reranked candidates.
        Each list holds twice the setting top_k, whatever is wanted in the end."""
        r, engine = self.engine.retrieval, self.engine
        k = top_k or r.top_k_final
        fused = fusion.fuse(self.ranked(variants, mode, 2 * r.top_k, filtered), k=r.rrf_k).join(self.docs, "doc")
        reranked = logit is not None and engine.rerank.enabled
        pages = fusion.merged(fusion.unique_files(fused, engine.rerank.candidates if reranked else k), r.chunks_per_file)
        pages = pages.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")) - 1)
        if not reranked:
            return pages
        asked = pages.join(questions.select("query_id", F.col("text").alias("question")), "query_id")
        if not isinstance(logit, Column):
            asked = query.scored(asked, engine.rerank.model, logit, engine.rerank.batch, engine.rerank.max_length)
            return query.rerank(asked, F.col("logit"), k).drop("logit")
        return query.rerank(asked, logit, k, engine.rerank.max_length)

    def scored(self, queries: DataFrame, top_k: int = 0) -> DataFrame:
        """(query_id, rank, vec_id, score): the vector side alone, above the threshold, for debugging."""
        r = self.engine.retrieval
        return vector.topk(self.vectors, queries, top_k or r.top_k, "doc", threshold=r.score_threshold)


class NotReady(RuntimeError):
    """A store or an index that questions cannot be answered from."""


def ingest(chunks: DataFrame, engine: Engine, embed=None, stop: list[str] = corpus.STOP_PATTERNS, reset: bool = False, lexical_only: bool = False, batch: int = 100, order: str = "ord", approximate: bool = False) -> DataFrame:
    """Cleans chunks and adds them to the collection with its indexes, or writes the lexical index of them alone with
    ``lexical_only``; returns the cleaned documents.

    A collection that exists is added to, or begun anew with ``reset``; documents and indexes count from one moment on, so
    an ingest that breaks off leaves what was there. No chunks: an error."""
    spark = chunks.sparkSession
    if chunks.isEmpty():
        raise NotReady("no chunks to ingest")
    docs = saved(clean_corpus(chunks, stop, order))
    if lexical_only:
        lexical.build(docs.withColumn("doc", F.xxhash64("chunk_id")), "doc", "page_content").save(engine.retrieval.index_path)
        return docs
    text = X.embedding_text(F.col("breadcrumbs"), F.col("page_title"), F.col("page_content"))
    made = embed or models.embedder(engine.embedding)
    store.open_collection(spark, engine.store).add(docs.withColumn("embedding_text", text), made, batch=batch, reset=reset, approximate=approximate)
    return docs


@dataclass
class Pipeline:
    """All that answering takes."""

    engine: Engine
    collection: store.Collection
    retriever: Retriever
    embed: object
    make_chat: object
    logit: Column | Callable[[], models.PairScorer] | None = None

    def variants(self, questions: DataFrame) -> DataFrame:
        """Rewritten questions (query_id, text), embedded; a model that fails leaves the question alone."""
        rewrite = self.engine.rewrite
        asked = questions.withColumn("reply", F.lit(None).cast("string"))
        if rewrite.enabled:
            product = self.engine.product
            asked = models.replies(questions, lambda r: query.rewrite_prompt(r["text"], product), self.make_chat)
        rows = query.variants(asked, most=rewrite.max_queries)
        return vector.embed(rows, "text", self.embed)

    def retrieve(self, questions: DataFrame, top_k: int = 0) -> DataFrame:
        return self.retriever.retrieve(saved(self.variants(questions)), "hybrid", top_k, self.logit, questions)

    def ask(self, questions: DataFrame, style: str = "markdown") -> DataFrame:
        """Answers with sources to questions (query_id, text)."""
        e = self.engine
        return answers.ask(questions, saved(self.retrieve(questions)), self.make_chat, e.docs_url, e.product, style, e.debug)

    def judge(self, questions: DataFrame, make_judge, attempts: int = 1) -> DataFrame:
        """Judged answers; candidates are not reranked."""
        rows = saved(self.retriever.retrieve(saved(self.variants(questions)), "hybrid"))
        e = self.engine
        return answers.judge(answers.ask(questions, rows, self.make_chat, e.docs_url, e.product), rows, make_judge, e.product, attempts)


def assemble(spark: SparkSession, engine: Engine, make_chat=None, embed=None, logit: Column | Callable[[], models.PairScorer] | None = None) -> Pipeline:
    """Opens what ``ingest`` wrote. Candidates are reranked by ``logit``, by default the model of pairs that the settings
    name. An empty collection, an index that is missing, of another version or over another
    number of documents raises ``NotReady``; an unknown backend is an error of its own."""
    collection = store.open_collection(spark, engine.store)
    state = collection.state()
    if state is None or not state.n_all:
        raise NotReady(f"no documents in {collection.path}: ingest chunks first")
    try:
        blocks = blockmax.load(spark, collection.lexical(state), state.n_all)
    except Exception as e:
        raise NotReady(f"no usable index in {collection.lexical(state)}: {e}") from e
    docs = collection.scan(state)
    known = [c for c in docs.columns if c not in ("page_content", "embedding")]
    retriever = Retriever(docs.select(*known, F.col("page_content").alias("text")), blocks.index, docs.select("doc", "embedding"), engine, blocks)
    ask = make_chat or (lambda: models.chat(engine.language))
    reranked = models.scorer(engine.rerank) if logit is None else logit
    return Pipeline(engine, collection, retriever, embed or models.embedder(engine.embedding, query=True), ask, reranked if engine.rerank.enabled else None)


def ablation_grid() -> list[tuple[str, str, bool, bool, int]]:
    """(name, mode, rewrite, rerank, depth) of the twelve configurations."""
    return [(f"{m}{'+rewrite' * w}{'+rerank' * r}", m, w, r, 15 if r else 5) for m in ("bm25", "vector", "hybrid") for w in (False, True) for r in (False, True)]


def ablate(retriever: Retriever, questions: DataFrame, rewritten: DataFrame, truth: DataFrame, logit: Column, k: int = 20, final: int = 5, only: list[str] | None = None, took: dict[str, float] | None = None) -> DataFrame:
    """P@3, P@5, NDCG@5 and MRR of the twelve configurations, or of those named in ``only``.

    questions: (query_id, list_idx 0, text, embedding); rewritten: those and further variants; truth: (query_idx,
    source_file, doc_idx, label); the logit is over question and text. Lists are padded with irrelevant places. The
    two sides are searched once each, over all variants, and saved; a configuration only selects from that. ``took`` is
    given the seconds of each side's search.
    """
    docs, configs = retriever.docs, []
    asked = questions.select("query_id", F.col("text").alias("question"))
    ids = questions.select(F.col("query_id").alias("query_idx"))
    grid = [g for g in ablation_grid() if only is None or g[0] in only]
    places = {g[0]: i for i, g in enumerate(ablation_grid())}
    found = {}
    for side in ("vector", "bm25"):
        if any(mode in (side, "hybrid") for _, mode, *_ in grid):
            start = time.perf_counter()
            found[side] = saved(retriever.ranked(rewritten, side, k))  # list_idx: twice the variant, and the side
            if took is not None:
                took[side] = time.perf_counter() - start
    if len(found) == 2:
        found["hybrid"] = found["vector"].unionByName(found["bm25"])
    for name, mode, rewrite, rerank, depth in grid:
        lists = found[mode] if rewrite else found[mode].where("list_idx < 2")
        rows = fusion.first_by_file(fusion.fuse(lists, k=retriever.engine.retrieval.rrf_k).join(docs, "doc"), depth)
        if rerank:
            rows = query.rerank(rows.join(asked, "query_id"), logit, final, retriever.engine.rerank.max_length)
        rows = rows.select(F.col("query_id").alias("query_idx"), "source_file", (F.col("rank") + 1).alias("rank"))
        metrics = evaluate.query_metrics(evaluate.padded(evaluate.labelled(rows, truth), ids, final))
        means = evaluate.summary(metrics)
        configs.append(means.select(F.lit(name).alias("config"), F.lit(places[name]).alias("ord"), F.col("p3_strict").alias("P@3"), F.col("p5_strict").alias("P@5"), F.col("ndcg5").alias("NDCG@5"), F.col("mrr_strict").alias("MRR")))
    out = configs[0]
    for c in configs[1:]:
        out = out.unionByName(c)
    return out


def ablate_saved(path: str, retriever: Retriever, questions: DataFrame, *args, **kw) -> DataFrame:
    """``ablate`` with the metrics of each configuration written below ``path`` as soon as they are there.

    What an earlier run has finished is read before anything is searched, and only the rest is computed; a folder that a
    broken write left behind holds no finished rows and is written again. avg_time: seconds a question, of the searches
    that a configuration takes its lists from (for all variants) and of its own selection.
    """
    spark, root = questions.sparkSession, path.rstrip("/")
    with discarding(spark):
        return _ablate_saved(spark, root, retriever, questions, *args, **kw)


def _ablate_saved(spark: SparkSession, root: str, retriever: Retriever, questions: DataFrame, *args, **kw) -> DataFrame:
    def finished(name: str) -> DataFrame | None:
        try:
            rows = spark.read.schema(ABLATED).parquet(f"{root}/{name}")
            return None if rows.isEmpty() else rows
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    names = [name for name, *_ in ablation_grid()]
    missing = [name for name in names if finished(name) is None]
    if missing:
        took: dict[str, float] = {}
        metrics, n = ablate(retriever, questions, *args, only=missing, took=took, **kw), max(1, questions.count())
        for name, mode, *_ in ablation_grid():
            if name in missing:
                start = time.perf_counter()
                row = metrics.where(F.col("config") == name).collect()  # one row
                spent = time.perf_counter() - start + sum(s for side, s in took.items() if mode in (side, "hybrid"))
                one = spark.createDataFrame(row, metrics.schema).withColumn("avg_time", F.lit(spent / n))
                one.coalesce(1).write.mode("overwrite").parquet(f"{root}/{name}")
    return reduce(DataFrame.unionByName, [finished(name) for name in names])


#: A row of ``ablate_saved``.
ABLATED = "config string, ord int, `P@3` double, `P@5` double, `NDCG@5` double, MRR double, avg_time double"


def with_judged(rows: DataFrame, truth: DataFrame, make_judge, product: str = "", attempts: int = 5, wait: float = 5.0) -> DataFrame:
    """truth (query_idx, source_file, doc_idx, label) with labels of a judge for the pairs of rows (query_idx, question,
    source_file, rank, text) that it lacks, at the next doc_idx; of a file's rows the judge sees the best ranked. A judge is
    asked ``attempts`` times, after growing waits, until its reply is JSON; one that never is means irrelevant."""
    lacking = rows.join(truth.select("query_idx", "source_file").distinct(), ["query_idx", "source_file"], "left_anti")
    shown = F.min_by(F.struct("question", "text"), F.struct("rank", "text"))
    open_ = lacking.groupBy("query_idx", "source_file").agg(shown.alias("r")).select("query_idx", "source_file", "r.*")
    got = models.replies(open_, lambda r: answers.label_prompt(r["question"], r["source_file"], r["text"], product), make_judge, attempts=attempts, wait=wait, readable=answers.read_json)
    label = F.coalesce(F.get_json_object(X.unfenced(F.col("reply")), "$.label"), F.lit("irrelevant"))
    last = truth.groupBy("query_idx").agg(F.max("doc_idx").alias("__last"))
    order = Window.partitionBy("query_idx").orderBy("source_file")
    new = got.join(last, "query_idx", "left").withColumn("doc_idx", F.coalesce(F.col("__last"), F.lit(-1)) + F.row_number().over(order))
    return truth.select("query_idx", "source_file", "doc_idx", "label").unionByName(new.select("query_idx", "source_file", F.col("doc_idx").cast(truth.schema["doc_idx"].dataType), label.alias("label")))


__all__ = ["NotReady", "Pipeline", "Retriever", "ablate", "ablate_saved", "ablation_grid", "assemble", "build_corpus", "build_results", "clean_corpus", "ingest", "sources", "with_judged"]
