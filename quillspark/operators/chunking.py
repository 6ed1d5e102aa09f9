"""Blocks to sections to chunks of a controlled size.

Packing carries its state along a page, so a page is packed in one piece of Python; pages are independent and
are parsed and packed in one pass without a shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..config import Chunking
from . import html as H

DROPPED = {"FOOTER", "ANCHOR", "LOCAL_TOC"}
#: Pages or texts whose results are handed on together: they are several times as large as what comes in, and Spark sends
#: thousands of rows at once.
SLICE = 128
_rule = re.compile(r"\|[\s\-:|]+\|").fullmatch

CHUNKS = "id string, text string, char_count int, token_count_approx int, source_file string, page_title string, breadcrumbs string, section_title string, section_path string, block_types array<string>, has_table boolean, has_image boolean, has_procedure boolean, chunk_index int"
BLOCKS = "source_file string, page_title string, page_breadcrumbs string, pos int, block_type string, markdown string, heading_text string, source_classes array<string>, char_count int, error string"


def greedy(sizes: list[int], target: int) -> list[int]:
    """Group number of each item: a new group starts where an item would take a group that is not empty beyond
    the target. Joiners do not count."""
    out, group, size, items = [], 0, 0, 0
    for n in sizes:
        if items and size + n > target:
            group, size, items = group + 1, 0, 0
        out.append(group)
        size, items = size + n, items + 1
    return out


def split_text(text: str, target: int, joiner: str = "\n\n") -> list[str]:
    """Paragraphs packed up to the target; a longer one stays whole."""
    parts = text.split(joiner)
    groups = greedy([len(p) for p in parts], target)
    return [joiner.join(p for p, g in zip(parts, groups) if g == i) for i in range(groups[-1] + 1)]


def split_table(table: str, target: int) -> list[str]:
    """Rows packed up to the target, under the header each time; blank rows go. The header's own lines and the line
    feeds between them count once, each row with one line feed."""
    lines = table.split("\n")
    head = next((i + 1 for i, x in enumerate(lines) if _rule(x.strip())), len(lines))
    header, rows = lines[:head], [x for x in lines[head:] if x.strip()]
    if not rows:
        return [table]
    groups = greedy([len(r) + 1 for r in rows], target - len("\n".join(header)))
    return ["\n".join(header + [r for r, g in zip(rows, groups) if g == i]) for i in range(groups[-1] + 1)]


def sections(blocks: list[tuple[str, str, str]]) -> list[tuple[str, list[tuple[str, str, str]]]]:
    """(title, blocks): one starts at each starter block with a heading text, which is its first block."""
    out: list[tuple[str, list]] = []
    for b in blocks:
        if b[0] in H.STARTERS and b[2]:
            out.append((b[2], []))
        elif not out:
            out.append(("", []))
        out[-1][1].append(b)
    return out


def packed(blocks: list[tuple[str, str, str]], size: Chunking) -> Iterator[tuple[str, set[str]]]:
    """(text, block types) of a section's chunks."""
    held: list[tuple[str, str]] = []

    def flush():
        if held:
            yield "\n\n".join(md for _, md in held), {k for k, _ in held}
            held.clear()

    for kind, md, _ in blocks:
        md = md.strip()
        if not md:
            continue
        if len(md) > size.most:
            yield from flush()
            for part in split_table(md, size.target) if kind == "TABLE" else split_text(md, size.target):
                yield part, {kind}
            continue
        if held and sum(len(x) for _, x in held) + len(md) > size.target:
            yield from flush()
        held.append((kind, md))
    yield from flush()


def is_junk(text: str, flags: dict, alone: bool, least: int) -> bool:
    if len(re.sub(r"[*#\-|_\s]", "", text)) < 10:
        return True
    lines = [x for x in text.strip().split("\n") if x.strip()]
    if len(lines) == 1 and lines[0].startswith("#"):
        return True
    return len(text) < least and not flags["has_table"] and not flags["has_procedure"] and not alone


def chunk_page(source_file: str, title: str, crumbs: str, blocks: list[tuple[str, str, str]], size: Chunking = Chunking()) -> list[dict]:
    """Chunks of a page, numbered after small and empty ones were dropped."""
    gone = DROPPED | ({"SEE_ALSO"} if not size.see_also else set()) | ({"COMMAND_INVOCATION"} if not size.command_invocation else set()) | ({"IMAGE", "IMAGE_CAPTION"} if not size.images else set())
    made = []
    for name, members in sections([b for b in blocks if b[0] not in gone and b[1].strip()]):
        for i, (text, kinds) in enumerate(packed(members, size)):
            if i and name and name != title:
                text = f"## {name}\n\n{text}"
            flags = {"has_table": "TABLE" in kinds, "has_image": "IMAGE" in kinds, "has_procedure": bool(kinds & {"NUMBERED_STEP", "PROCEDURE_HEADING"})}
            made.append((name, H.normalised(text), sorted(kinds), flags))
    kept = [m for m in made if not is_junk(m[1], m[3], len(made) == 1, size.least)]
    out = []
    for i, (name, text, kinds, flags) in enumerate(kept):
        key = f"{source_file}::{i}::{text[:200]}"
        out.append({"id": hashlib.md5(key.encode()).hexdigest()[:12], "text": text, "char_count": len(text), "token_count_approx": len(text) // 4, "source_file": source_file, "page_title": title, "breadcrumbs": crumbs, "section_title": name, "section_path": f"{title} > {name}" if name else title, "block_types": kinds, **flags, "chunk_index": i})
    return out


def blocks(pages: DataFrame, options: H.Options = H.Options(), file: str = "source_file", html: str = "html") -> DataFrame:
    """Typed blocks of pages with their position; a page that cannot be converted is one row with its error."""

    arrow = to_arrow_schema(T._parse_datatype_string(BLOCKS))
    cols = arrow.names

    def run(batches):
        for batch in _slices(batches):
            rows = []
            for name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    title, crumbs, found = H.page_blocks(page, options)
                    rows += [(name, title, crumbs, i, k, md, h, c, len(md), None) for i, (k, md, h, c) in enumerate(found)]
                except Exception as e:  # one bad page must not end the job
                    rows.append((name, "", "", -1, "", "", "", [], 0, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_pylist([dict(zip(cols, r)) for r in rows], arrow)

    return pages.select(file, html).mapInArrow(run, BLOCKS)


def page_results(pages: DataFrame, options: H.Options = H.Options(), size: Chunking = Chunking(), file: str = "source_file", html: str = "html", toc: bool = False) -> DataFrame:
    """One row a page: source_file, status (processed, skipped, error), error, chunks.

    A page without chunks, or that could not be read (null), is skipped; one whose conversion fails is an error and
    leaves the others alone. With ``toc``, the columns toc_title and toc_breadcrumbs fill what a page lacks.
    """
    extra = ["toc_title", "toc_breadcrumbs"] if toc else []
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("source_file", "status", "error")] + [T.StructField("chunks", T.ArrayType(T._parse_datatype_string(CHUNKS)))])
    arrow = to_arrow_schema(schema)

    def result(name, page, title="", crumbs=""):
        try:
            own_title, own_crumbs, found = H.page_blocks(page, options)
            made = chunk_page(name or "", own_title or title or "", own_crumbs or crumbs or "", [b[:3] for b in found], size)
            return {"source_file": name, "status": "processed" if made else "skipped", "error": None, "chunks": made}
        except Exception as e:  # one bad page must not end the job
            return {"source_file": name, "status": "error", "error": f"{type(e).__name__}: {e}", "chunks": []}

    def run(batches):
        for batch in _slices(batches):
            rows = [result(*r) for r in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return pages.select(file, html, *extra).mapInArrow(run, schema)


def chunks_of(results: DataFrame) -> DataFrame:
    """The chunks of ``page_results``."""
    return results.select(F.inline("chunks"))


def chunks(pages: DataFrame, options: H.Options = H.Options(), size: Chunking = Chunking(), file: str = "source_file", html: str = "html", toc: bool = False) -> DataFrame:
    """Chunks of pages in one pass; see ``page_results`` for pages without any and the table of contents."""
    return chunks_of(page_results(pages, options, size, file, html, toc))


def page_counters(results: DataFrame) -> DataFrame:
    """One row: total, processed, skipped, errors, chunks of ``page_results``."""
    counts = [F.count_if(F.col("status") == s).alias(n) for s, n in (("processed", "processed"), ("skipped", "skipped"), ("error", "errors"))]
    return results.agg(F.count("*").alias("total"), *counts, F.coalesce(F.sum(F.size("chunks")), F.lit(0)).alias("chunks"))


MARKDOWN = "source_file string, markdown string, error string"


def markdown(pages: DataFrame, options: H.Options = H.Options(), file: str = "source_file", html: str = "html") -> DataFrame:
    """(source_file, markdown, error): whole pages; those that are null or without a content root have no Markdown."""

    arrow = to_arrow_schema(T._parse_datatype_string(MARKDOWN))

    def run(batches):
        make = H.Converter(options)
        for batch in _slices(batches):
            rows = []
            for name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows.append((name, make.page(page) if page else None, None))
                except Exception as e:  # one bad page must not end the job
                    rows.append((name, None, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in rows], arrow)

    return pages.select(file, html).mapInArrow(run, MARKDOWN)


def markdown_counters(converted: DataFrame) -> DataFrame:
    """One row: total, converted, skipped, errors of ``markdown``."""
    failed = F.col("error").isNotNull()
    return converted.agg(
        F.count("*").alias("total"), F.count("markdown").alias("converted"), F.count_if(F.col("markdown").isNull() & ~failed).alias("skipped"), F.count_if(failed).alias("errors")
    )


def with_toc(pages: DataFrame, toc: DataFrame, order: str | None = None) -> DataFrame:
    """pages with toc_title and toc_breadcrumbs by source_file. A file that is named several times has its last place
    by the column ``order``, else the greatest as text, so that no page multiplies."""
    place = F.struct(F.col("title").alias("toc_title"), F.col("breadcrumbs").alias("toc_breadcrumbs"))
    one = toc.groupBy("source_file").agg(F.max_by(place, F.struct(order, place) if order else place).alias("t"))
    return pages.join(one.select("source_file", "t.*"), "source_file", "left")


def filled(pages: DataFrame) -> DataFrame:
    """Columns page_title and page_breadcrumbs, where empty or null, from toc_title and toc_breadcrumbs."""
    fill = lambda own, toc: F.coalesce(F.nullif(F.col(own), F.lit("")), F.col(toc), F.lit(""))
    return pages.withColumns({"page_title": fill("page_title", "toc_title"), "page_breadcrumbs": fill("page_breadcrumbs", "toc_breadcrumbs")})


def section_ids(lines: DataFrame, page: str, pos: str, starts: str, title: str) -> DataFrame:
    """lines with section_id (0 before the first start) and section_title, by a running count in each page."""
    order = Window.partitionBy(page).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = lines.withColumn("section_id", F.sum(F.col(starts).cast("int")).over(order))
    return out.withColumn("section_title", F.coalesce(F.last(F.when(F.col(starts), F.col(title)), ignorenulls=True).over(order), F.lit("")))


def split_tables(tables: DataFrame, markdown: str = "markdown", target: int = 1500) -> DataFrame:
    """tables with ``parts``: rows packed greedily up to the target, under the header each time."""
    return _with_parts(tables, markdown, lambda x: split_table(x, target))


def pack_lines(docs: DataFrame, text: str = "text", target: int = 1500) -> DataFrame:
    """docs with ``parts``: lines packed greedily up to the target."""
    return _with_parts(docs, text, lambda x: split_text(x, target, "\n"))


def _with_parts(rows: DataFrame, column: str, split: Callable[[str], list[str]]) -> DataFrame:
    def run(batches):
        for batch in _slices(batches):
            parts = [split(x or "") for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.list_(pa.string()))], [*batch.schema.names, "parts"])

    return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField("parts", T.ArrayType(T.StringType()))]))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)
