"""Readers and writers."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import saved

#: Parts of the names of service pages.
SERVICE_PAGES = ["hmcontent", "hmftsearch", "hmkwindex", "hmcontextids", "zoomimage", "open.html"]
#: How a page's place begins, from the table of contents and of its own.
PLACE, OWN_PLACE = "> **Раздел:** ", "> **Путь:**"
CHUNK_SCHEMA = "id string, text string, metadata struct<source_file: string, page_title: string, breadcrumbs: string, section_title: string, section_path: string, block_types: array<string>, has_table: boolean, has_image: boolean, has_procedure: boolean, chunk_index: int, char_count: int, token_count_approx: int>"
TOC_SCHEMA = "source_file string, title string, breadcrumbs string, level int, topic_type string, has_children boolean"
REQUIRED_METRICS = ("P@3", "P@5", "NDCG@5", "MRR")


def read_html(spark: SparkSession, path: str, max_files: int = 0, service: list[str] | None = None) -> DataFrame:
    """(path, source_file, html) of all .html files below a folder, without service pages; the first max_files by
    path, folder by folder. A file that is not UTF-8 has a null html (and is counted as skipped further on); line ends
    are line feeds."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    html = F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), "\r\n?", "\n")
    rows = rows.select("path", name.alias("source_file"), html.alias("html"))
    for part in SERVICE_PAGES if service is None else service:
        rows = rows.where(~F.lower("source_file").contains(part))
    return rows.orderBy(F.split("path", "/")).limit(max_files) if max_files > 0 else rows


def read_page(spark: SparkSession, path: str) -> DataFrame:
    """One page, whatever its name; an error if there is no such file."""
    rows = read_html_file(spark, path)
    if rows.isEmpty():
        raise FileNotFoundError(path)
    return rows


def read_html_file(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.format("binaryFile").load(path)
    html = F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), "\r\n?", "\n")
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("source_file"), html.alias("html"))


def toc_rows(text: str) -> list[tuple]:
    """Rows of a table-of-contents script; what cannot be read gives none; of a repeated file the last row stays."""
    try:
        body = text[text.index("{") : text.rindex("}") + 1]
        body = re.sub(r"(?m)^(\s*)(\w+)\s*:", r'\1"\2":', body)
        tree = json.loads(re.sub(r",(\s*[}\]])", r"\1", body))
    except ValueError:
        return []

    def level(value) -> int:
        try:
            return int(value or 0)
        except (TypeError, ValueError):
            return 0

    found: dict[str, tuple] = {}
    stack = [(tree.get("items") or [], ())] if isinstance(tree, dict) else []
    while stack:
        items, above = stack.pop()
        for at, item in enumerate(items):
            if not isinstance(item, dict):
                continue
            title = str(item.get("cp") or "").strip()
            names = (*above, title) if title else above
            file = str(item.get("hf") or "").strip()
            if file:
                found[file] = (file, title, " → ".join(names), level(item.get("lv")), str(item.get("tp") or ""), bool(item.get("items")))
            if item.get("items"):
                stack.append((items[at + 1 :], above))
                stack.append((item["items"], names))
                break
    return list(found.values())


#: The walk over parent links, with the nodes on the way down as guard against cycles.
WALK = """
WITH RECURSIVE walk(toc, node, path, names, seen) AS (
  SELECT toc, node, array(position), CASE WHEN title <> '' THEN array(title) ELSE cast(array() AS array<string>) END, array(node) FROM {nodes} WHERE parent IS NULL
  UNION ALL
  SELECT /*+ MERGE(w, n) */ n.toc, n.node, concat(w.path, array(n.position)), CASE WHEN n.title <> '' THEN concat(w.names, array(n.title)) ELSE w.names END, concat(w.seen, array(n.node))
  FROM walk w JOIN {nodes} n ON n.toc = w.toc AND n.parent = w.node WHERE NOT array_contains(w.seen, n.node))
SELECT * FROM walk"""


def walk_toc(nodes: DataFrame, depth: int = 100) -> DataFrame:
    """(toc, source_file, title, breadcrumbs, level, topic_type, has_children) of all nodes with a file that hang on a root.

    nodes: toc, node, parent (null: a root), position among its siblings, title, source_file, level, topic_type. All
    tables of contents are walked at once, a level a round, at most ``depth``: deeper ones raise. A node that is its own
    ancestor ends the walk there. Of a file that a table of contents names twice the later one stays, in reading order.
    Null titles are empty, a null level is 0.
    """
    spark = nodes.sparkSession
    empty = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c)
    known = saved(nodes.select("toc", "node", "parent", "position", empty("title"), empty("source_file"), F.coalesce("level", F.lit(0)).alias("level"), empty("topic_type")))
    limits = {"spark.sql.cteRecursionLevelLimit": str(depth), "spark.sql.cteRecursionRowLimit": "-1"}
    before = {k: spark.conf.get(k, None) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        walked = saved(spark.sql(WALK, nodes=known).select("toc", "node", "path", "names"))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    parents = known.where("parent is not null").select("toc", F.col("parent").alias("node"), F.lit(True).alias("has_children")).distinct()
    # all of these grow with the tables of contents: none is collected for a broadcast
    rows = walked.hint("merge").join(known, ["toc", "node"]).join(parents.hint("merge"), ["toc", "node"], "left").where("source_file <> ''")
    fields = F.struct("title", F.array_join("names", " → ").alias("breadcrumbs"), "level", "topic_type", F.coalesce("has_children", F.lit(False)).alias("has_children"))
    return rows.groupBy("toc", "source_file").agg(F.max_by(fields, "path").alias("r")).select("toc", "source_file", "r.*")


def read_toc(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True).select("value")

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = [r for t in batch["value"] for r in toc_rows(t)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TOC_SCHEMA.split(", ")])

    return text.mapInPandas(run, TOC_SCHEMA)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk records, flat; blank lines are skipped, a bad one fails."""
    rows = spark.read.schema(CHUNK_SCHEMA).option("mode", "FAILFAST").json(path)
    return rows.select("id", "text", "metadata.*")


def write_chunks(chunks: DataFrame, path: str) -> None:
    meta = [c for c in ("source_file", "page_title", "breadcrumbs", "section_title", "section_path", "block_types", "has_table", "has_image", "has_procedure", "chunk_index", "char_count", "token_count_approx") if c in chunks.columns]
    chunks.select("id", "text", F.struct(*meta).alias("metadata")).write.mode("overwrite").json(path)


def csv_view(chunks: DataFrame) -> DataFrame:
    preview = F.regexp_replace(F.substring("text", 1, 150), "\n", " ").alias("text_preview")
    cols = ["source_file", "page_title", "section_title", "breadcrumbs"]
    return chunks.select(F.col("id").alias("chunk_id"), *cols, F.array_join("block_types", ";").alias("block_types"), "char_count", "token_count_approx", "has_table", "has_procedure", "has_image", "chunk_index", preview)


def write_csv(chunks: DataFrame, path: str) -> None:
    csv_view(chunks).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def preview(chunks: DataFrame, n: int = 10, most: int = 500) -> DataFrame:
    """The first n chunks by file and place, their texts cut at ``most`` characters, with what is left out told."""
    text = F.when(F.length("text") > most, F.concat(F.substring("text", 1, most), F.lit("\n... ("), (F.length("text") - most).cast("string"), F.lit(" more chars)"))).otherwise(F.col("text"))
    cols = ["id", "source_file", "page_title", "section_title", "breadcrumbs", F.array_join("block_types", ", ").alias("block_types"), "char_count", "token_count_approx", "has_table", "has_procedure"]
    return chunks.orderBy("source_file", "chunk_index").limit(n).select(*cols, text.alias("text"))


def write_outputs(chunks: DataFrame, jsonl: str | None = None, csv: str | None = None, show: bool = False, stats: bool = False, single: bool = False, n: int = 10) -> dict[str, DataFrame]:
    """Writes what is asked for and returns what is to be shown: a preview if asked for, or for a single page without
    an output; statistics and histograms if asked for, or without an output."""
    from ..operators import corpus

    shown: dict[str, DataFrame] = {}
    if show or (single and not jsonl):
        shown["preview"] = preview(chunks, n)
    if stats or not jsonl:
        shown |= {"statistics": corpus.statistics(chunks), "types": corpus.type_histogram(chunks), "sizes": corpus.size_histogram(chunks)}
    if jsonl:
        write_chunks(chunks, jsonl)
    if csv:
        write_csv(chunks, csv)
    return shown


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_idx, query): non-blank lines of one text file, stripped, in order."""
    lines = spark.read.text(path, wholetext=True).select(F.filter(F.transform(F.split("value", "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+$", ""))), lambda x: x != "").alias("q"))
    return lines.select(F.posexplode("q").alias("query_idx", "query"))


ANNOTATION = "struct<query_idx: int, query: string, doc_idx: int, source_file: string, page_title: string, label: string, comment: string, timestamp: string>"
ANNOTATIONS = f"queries array<string>, annotations map<string, {ANNOTATION}>"


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(query_idx, rank from 1, label, source_file) of an annotation file, by document index; its questions are what
    ``read_annotated_queries`` gives."""
    from pyspark.sql import Window

    rows = spark.read.option("multiLine", True).schema(ANNOTATIONS).json(path)
    flat = rows.select(F.explode("annotations").alias("key", "a")).select("a.*")
    return flat.withColumn("rank", F.row_number().over(Window.partitionBy("query_idx").orderBy("doc_idx"))).select("query_idx", "rank", "label", "source_file")


def read_annotated_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_idx, query) of an annotation file."""
    return spark.read.option("multiLine", True).schema(ANNOTATIONS).json(path).select(F.posexplode("queries").alias("query_idx", "query"))


def write_annotations(annotations: DataFrame, queries: DataFrame, path: str, created: str) -> None:
    """One JSON document: created, queries in order, annotations by key, stats. Annotations (key, query_idx, doc_idx,
    source_file, label and, if there, comment and timestamp) are a person's or a judge's, so they fit one document."""
    from ..operators import evaluate

    known = annotations.schema.names
    entry = F.struct(*[c for c in ("query_idx", "doc_idx", "source_file", "label", "comment", "timestamp") if c in known])
    marks = annotations.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", entry)))).alias("annotations"))
    asked = queries.agg(F.transform(F.sort_array(F.collect_list(F.struct("query_idx", "query"))), lambda x: x["query"]).alias("queries"))
    stats = evaluate.annotation_stats(annotations).select(F.struct("*").alias("stats"))
    whole = asked.join(marks).join(stats).select(F.lit(created).alias("created"), "queries", "annotations", "stats")  # one row each
    whole.coalesce(1).write.mode("overwrite").json(path)


def read_ablation(spark: SparkSession, path: str) -> DataFrame:
    """(config, ord, metrics, avg_time) of a result file, bare or under ``metrics``; a missing metric raises."""
    text = spark.read.text(path, wholetext=True).select("value").first()["value"]
    data = json.loads(text)
    data = data.get("metrics", data)
    rows = []
    for i, (name, m) in enumerate(data.items()):
        missing = [k for k in REQUIRED_METRICS if k not in m]
        if missing:
            raise ValueError(f"{name}: no {', '.join(missing)}")
        rows.append((name, i, *(float(m[k]) for k in REQUIRED_METRICS), float(m["avg_time"]) if m.get("avg_time") is not None else None))
    return spark.createDataFrame(rows, "config string, ord int, `P@3` double, `P@5` double, `NDCG@5` double, `MRR` double, avg_time double")


def best_config(results: DataFrame, metric: str) -> DataFrame:
    """The first configuration with the largest metric."""
    return results.agg(F.max_by("config", F.struct(F.col(f"`{metric}`"), -F.col("ord"))).alias("best"))


def located(pages: DataFrame, toc: DataFrame | None = None) -> DataFrame:
    """pages (source_file, markdown) with their place in the table of contents on top, unless the text begins with one."""
    if toc is None:
        return pages
    place = F.concat(F.lit(PLACE), F.col("breadcrumbs"), F.lit("\n\n"))
    fits = (F.coalesce("breadcrumbs", F.lit("")) != "") & ~F.col("markdown").startswith(OWN_PLACE)
    joined = pages.join(toc.groupBy("source_file").agg(F.max("breadcrumbs").alias("breadcrumbs")), "source_file", "left")
    return joined.withColumn("markdown", F.when(fits, F.concat(place, "markdown")).otherwise(F.col("markdown"))).drop("breadcrumbs")


def write_report(report: DataFrame, path: str) -> None:
    """A table of one JSON text (column report)."""
    report.select("report").coalesce(1).write.mode("overwrite").text(path)


def write_markdown(pages: DataFrame, path: str) -> None:
    """Markdown of pages (source_file, markdown) as a table of text rows; ``write_markdown_files`` makes files."""
    pages.where("markdown is not null").write.mode("overwrite").parquet(path)


def write_markdown_files(pages: DataFrame, root: str, target: str) -> DataFrame:
    """One .md file for each page (path, markdown) at its place below ``root``, written by the tasks to a folder that
    all of them reach; (path, written) of each. A page without Markdown has no file."""

    def run(batches):
        import os

        for batch in batches:
            done = []
            for path, text in zip(batch["path"], batch["markdown"]):
                if text is not None:
                    inside = path.split(root.rstrip("/") + "/", 1)[-1]
                    place = os.path.join(target, os.path.splitext(inside)[0] + ".md")
                    os.makedirs(os.path.dirname(place), exist_ok=True)
                    with open(place, "w", encoding="utf-8") as f:
                        f.write(text)
                done.append(text is not None)
            yield batch[["path"]].assign(written=done)

    return pages.select("path", "markdown").mapInPandas(run, "path string, written boolean")
