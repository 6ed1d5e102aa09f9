"""Retrieval and generation metrics from label tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Gains of the labels; any other label gains nothing.
STRICT, LENIENT, GRADED = {"relevant": 1.0}, {"relevant": 1.0, "partial": 1.0}, {"relevant": 2.0, "partial": 1.0}
CRITERIA = ("faithfulness", "completeness", "relevance", "helpfulness")
DIGITS = 9


def gain(label: Column, gains: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for name, g in gains.items():
        out = F.when(label == name, F.lit(g)).otherwise(out)
    return out


def query_metrics(labels: DataFrame, by: tuple[str, ...] = ("query_idx",)) -> DataFrame:
    """Precision, recall, reciprocal rank and NDCG for each query from (query_idx, rank from 1, label).

    The ideal order sorts the labels that were retrieved; recall counts against the relevant ones among them.
    """
    place = Window.partitionBy(*by).orderBy("rank")
    g = labels.select(*by, F.row_number().over(place).alias("r"), gain(F.col("label"), STRICT).alias("s"), gain(F.col("label"), LENIENT).alias("l"), gain(F.col("label"), GRADED).alias("g"))
    g = g.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("g"), "r")))
    aggs: list[Column] = []
    for name, c in (("strict", "s"), ("lenient", "l")):
        hit = F.when(F.col(c) > 0, 1.0).otherwise(0.0)
        for k in (3, 5):
            aggs.append((F.sum(F.when(F.col("r") <= k, hit).otherwise(0.0)) / k).alias(f"p{k}_{name}"))
        total = F.sum(hit)
        for k in (3, 5):
            aggs.append(F.when(total > 0, F.sum(F.when(F.col("r") <= k, hit).otherwise(0.0)) / total).otherwise(0.0).alias(f"recall{k}_{name}"))
        aggs.append(F.coalesce(1 / F.min(F.when(F.col(c) > 0, F.col("r"))), F.lit(0.0)).alias(f"mrr_{name}"))
    for k in (3, 5):
        dcg = F.sum(F.when(F.col("r") <= k, F.col("g") / F.log2(F.col("r") + 1.0)).otherwise(0.0))
        ideal = F.sum(F.when(F.col("i") <= k, F.col("g") / F.log2(F.col("i") + 1.0)).otherwise(0.0))
        aggs.append(F.when(ideal > 0, F.round(dcg / ideal, DIGITS)).otherwise(0.0).alias(f"ndcg{k}"))
    return g.groupBy(*by).agg(*aggs)


def summary(metrics: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Means of all metrics but recall at 3, rounded to four digits, and the number of queries. They are rounded to
    ``DIGITS`` first: the order of a sum must not turn a half up or down."""
    skip = {"query_idx", "recall3_strict", "recall3_lenient", *by}
    cols = [c for c in metrics.columns if c not in skip]
    return metrics.groupBy(*by).agg(*[F.round(F.round(F.avg(c), DIGITS), 4).alias(c) for c in cols], F.count("*").alias("n_queries"))


def generation_metrics(judged: DataFrame) -> DataFrame:
    """Counts and mean score for each criterion from (idx, criterion, score); errors do not enter the mean."""
    value = F.when(F.col("score") == "yes", 1.0).when(F.col("score") == "partial", 0.5).when(F.col("score") == "no", 0.0)
    known = F.when(F.col("score").isin("yes", "partial", "no"), F.col("score")).otherwise("error")
    rows = judged.withColumns({"v": value, "known": known})
    counts = [F.count_if(F.col("known") == x).alias(x) for x in ("yes", "partial", "no", "error")]
    return rows.groupBy("criterion").agg(*counts, F.round(F.coalesce(F.avg("v"), F.lit(0.0)), 3).alias("avg_score"), F.count("v").alias("n"))


def overall(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.round(F.avg("avg_score"), 3).alias("overall"))


def annotation_stats(annotations: DataFrame) -> DataFrame:
    """One row: annotations, their labels, share of relevant ones in percent, queries annotated."""
    total = F.count("*")
    counts = [F.count_if(F.col("label") == x).alias(x) for x in ("relevant", "partial", "irrelevant")]
    return annotations.agg(total.alias("total"), *counts, F.round(F.when(total > 0, 100.0 * F.count_if(F.col("label") == "relevant") / total).otherwise(0.0), 1).alias("relevant_pct"), F.countDistinct("query_idx").alias("queries"))


def judgment(reply: Column) -> Column:
    """A judge's JSON reply as map<criterion, struct<score, reason>>. A reply that begins with a code fence loses its
    first line and what follows its last fence; what is no JSON object then, or goes on behind one, is an error of every
    criterion, with the first 200 characters of what was left as its reason. Further keys are kept; a value that is no
    object has neither score nor reason."""
    body = X.unfenced(F.coalesce(reply, F.lit("")))
    # the object must end where the reply does: else what is put around it does not read, or has other keys
    whole = F.from_json(F.concat(F.lit('{"reply":'), body, F.lit(',"end":1}')), "map<string, string>")
    ends = F.array_sort(F.map_keys(whole)) == F.array(F.lit("end"), F.lit("reply"))
    object_ = F.when(F.coalesce(ends, F.lit(False)), F.from_json(body, "map<string, string>"))
    read = F.transform_values(object_, lambda _, v: F.coalesce(F.from_json(v, "score string, reason string"), F.struct(F.lit(None).cast("string").alias("score"), F.lit(None).cast("string").alias("reason"))))
    failed = F.map_from_arrays(F.array(*map(F.lit, CRITERIA)), F.array_repeat(F.struct(F.lit("error").alias("score"), F.substring(body, 1, 200).alias("reason")), len(CRITERIA)))
    return F.when(read.isNull() | ~X.trimmed(body).startswith("{"), failed).otherwise(read)


def criteria(evaluations: DataFrame, judgment: str = "judgment") -> DataFrame:
    """(idx, criterion, score): each criterion of each judgment, an error where it is missing."""
    each = evaluations.select("idx", judgment, F.explode(F.array(*map(F.lit, CRITERIA))).alias("criterion"))
    return each.select("idx", "criterion", F.coalesce(F.try_element_at(F.col(judgment), F.col("criterion"))["score"], F.lit("error")).alias("score"))


def labelled(retrieved: DataFrame, truth: DataFrame, order: str = "doc_idx", judged: DataFrame | None = None) -> DataFrame:
    """retrieved (query_idx, source_file, ...) with ``label`` by query and file: the last of repeated truths, else a
    judge's (judged: query_idx, source_file, label), else irrelevant."""
    known = truth.groupBy("query_idx", "source_file").agg(F.max_by("label", order).alias("__known"))
    out, label = retrieved.join(known, ["query_idx", "source_file"], "left"), F.col("__known")
    if judged is not None:
        out = out.join(judged.select("query_idx", "source_file", F.col("label").alias("__judged")), ["query_idx", "source_file"], "left")
        label = F.coalesce(label, "__judged")
    return out.withColumn("label", F.coalesce(label, F.lit("irrelevant"))).drop("__known", "__judged")


def named(metrics: DataFrame, queries: DataFrame) -> DataFrame:
    """metrics with ``query``: the text by query_idx from queries (query_idx, query), ``q`` and the number without one."""
    joined = metrics.join(queries.select("query_idx", "query"), "query_idx", "left")
    return joined.withColumn("query", F.coalesce("query", F.concat(F.lit("q"), F.col("query_idx").cast("string"))))


def timings(log: DataFrame, by: str = "config") -> DataFrame:
    """Mean seconds (avg_time), rows and rows a second of each configuration from (by, seconds, rows)."""
    seconds = F.sum("seconds")
    return log.groupBy(by).agg(F.avg("seconds").alias("avg_time"), F.sum("rows").alias("rows"), F.when(seconds > 0, F.sum("rows") / seconds).alias("rows_per_second"))


def generation_report(evaluations: DataFrame, stats: DataFrame, model: str, created: str, single: bool = False) -> DataFrame:
    """Rows of JSON lines that make one report: a head with created, model_judge, n_queries and stats, then one line
    for each evaluation in order; with ``single`` one object that holds the evaluations too, for as many as a judge has
    been asked about by hand. ``evaluations``: idx, question, answer, n_docs, rag_time, judgment."""
    each = F.map_from_entries(F.collect_list(F.struct("criterion", F.struct(F.col("avg_score").alias("avg"), "yes", "partial", "no", "error", "n")))).alias("criteria")
    facts = stats.agg(each, F.round(F.avg("avg_score"), 3).alias("overall")).join(evaluations.agg(F.count("*").alias("n_queries")))  # one row each
    head = facts.select(F.lit(-1).cast("long").alias("idx"), F.to_json(F.struct(F.lit(created).alias("created"), F.lit(model).alias("model_judge"), "n_queries", F.struct("criteria", "overall").alias("stats"))).alias("report"))
    one = F.struct("idx", "question", "answer", "n_docs", "rag_time", "judgment")
    if single:
        every = evaluations.agg(F.sort_array(F.collect_list(F.struct("idx", F.to_json(one).alias("e")))).alias("__all"))
        texts = F.array_join(F.transform("__all", lambda x: x["e"]), ",")
        begun = F.regexp_replace("report", r"\}$", "")
        return head.join(every).select("idx", F.concat(begun, F.lit(',"evaluations":['), texts, F.lit("]}")).alias("report"))  # one row each
    lines = evaluations.select(F.col("idx").cast("long").alias("idx"), F.to_json(one).alias("report"))
    return head.unionByName(lines)


def padded(labels: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_idx, rank, label) with ranks 1 to k for every query, the missing ones irrelevant."""
    every = queries.select("query_idx", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    return every.join(labels.select("query_idx", "rank", "label"), ["query_idx", "rank"], "left").select("query_idx", "rank", F.coalesce("label", F.lit("irrelevant")).alias("label"))


def weak(metrics: DataFrame, below: float = 0.2) -> DataFrame:
    """Queries whose strict precision at five is below a limit."""
    return metrics.where(F.col("p5_strict") < below)


def report(metrics: DataFrame) -> DataFrame:
    """One row with ``report``: JSON of a summary, the metrics of each query in order, and their number."""
    each = F.sort_array(F.collect_list(F.struct("query_idx", *[c for c in metrics.columns if c != "query_idx"]))).alias("per_query")
    means = summary(metrics)
    facts = F.struct(*[c for c in means.columns if c != "n_queries"]).alias("summary")
    return means.join(metrics.agg(each)).select(F.to_json(F.struct(facts, "per_query", "n_queries")).alias("report"))  # one row each
