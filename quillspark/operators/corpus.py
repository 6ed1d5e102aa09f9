"""Corpus cleaning and statistics: exact deduplication, filters, projection, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import saved

#: Bits of ``monotonically_increasing_id`` that count within a partition.
WITHIN = 33


def positioned(rows: DataFrame, order: list[Column], out: str) -> DataFrame:
    """rows with ``out``, their place from 0 in the order given, written to the shared folder.

    Rows are sorted by ranges; a row's place is its place in its range, and the rows in the ranges before it, of which
    the driver adds up one number for each range. No task holds more than a range; only rows that tie in all of ``order``
    share one.
    """
    spark = rows.sparkSession
    inside = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    counts = inside.groupBy(F.shiftright("__at", WITHIN).alias("__range")).count().orderBy("__range").collect()
    starts, at = [], 0
    for r in counts:
        starts.append((r["__range"], at))
        at += r["count"]
    ranges = spark.createDataFrame(starts, "__range long, __start long")  # a row for each range
    placed = inside.withColumn("__range", F.shiftright("__at", WITHIN)).join(F.broadcast(ranges), "__range")
    return placed.withColumn(out, F.col("__start") + F.col("__at").bitwiseAND((1 << WITHIN) - 1)).drop("__at", "__range", "__start")


def numbered(rows: DataFrame, group: str, order: str, out: str = "chunk_index") -> DataFrame:
    """rows with ``out``, the place from 0 within their group by ``order`` (nulls first, one group if null).

    Rows are placed in one order of group and place, so a group with a third of all rows is many ranges; a group begins
    at its first place. Rows that tie are numbered in no defined order.
    """
    tie = F.xxhash64(*[F.col(f.name) for f in rows.schema if f.dataType.typeName() != "map"])
    placed = positioned(rows, [F.col(group).asc_nulls_first(), F.col(order).asc_nulls_first(), tie], "__place")
    first = placed.groupBy(F.col(group).alias("__group")).agg(F.min("__place").alias("__first"))
    joined = placed.join(first, F.col(group).eqNullSafe(F.col("__group")))
    return joined.withColumn(out, (F.col("__place") - F.col("__first")).cast("int")).drop("__place", "__group", "__first")


def deduplicate(chunks: DataFrame, text: str = "text", source: str = "source_file", order: str = "ord") -> DataFrame:
    """First row of each text in ``order``, with ``alt_sources``: the later rows' sources in order, joined by ``;``.

    As long as alt_sources is empty, a new source replaces it; so leading empty sources leave no mark. Copies of
    one text are folded map-side; only their (order, source) pairs meet. A column alt_sources that chunks have is replaced.
    """
    chunks = chunks.drop("alt_sources")
    rest = [c for c in chunks.columns if c not in (text,)]
    grouped = chunks.groupBy(F.md5(text).alias("__key")).agg(
        F.min_by(F.struct(text, *rest), F.col(order)).alias("first"), F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(source), F.lit("")).alias("s")))).alias("all")
    )
    names = F.transform(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), lambda x: x["s"])
    # The list begins at the first source that is not empty; it is joined once, not grown source by source.
    named = grouped.select("first", names.alias("names")).withColumn("at", F.array_position(F.transform("names", lambda s: s != ""), True).cast("int"))
    joined = F.when(F.col("at") > 0, F.array_join(F.slice("names", F.greatest("at", F.lit(1)), F.greatest(F.size("names"), F.lit(1))), ";")).otherwise("")
    return named.select("first.*", joined.alias("alt_sources"))


#: Sources that a segment names at most.
SEGMENT = 1000


def alternative_sources(chunks: DataFrame, text: str = "text", source: str = "source_file", order: str = "ord", most: int = SEGMENT) -> DataFrame:
    """(key, segment from 0, names): what ``alt_sources`` of ``deduplicate`` joins, in rows of at most ``most`` sources.

    key is the MD5 of the text. The sources of a text that has millions of copies are many rows, and no cell grows with
    them; in order of segments, joined by ``;``, they are its alt_sources. Texts without later sources have no row.
    """
    named = chunks.select(F.md5(text).alias("key"), F.col(order).alias("o"), F.coalesce(F.col(source), F.lit("")).alias("s"))
    placed = numbered(named, "key", "o", "n").where("n > 0")
    first = placed.where("s <> ''").groupBy("key").agg(F.min("n").alias("first"))  # the list begins at the first that is named
    cut = placed.join(first, "key").where("n >= first").withColumn("segment", F.expr(f"cast((n - first) div {most} as int)"))
    return cut.groupBy("key", "segment").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "s"))), lambda x: x["s"]).alias("names"))


#: Texts that mark chunks of little value.
STOP_PATTERNS = ["Информация в Интернете"]


def without(chunks: DataFrame, patterns: list[str] = STOP_PATTERNS, text: str = "text") -> DataFrame:
    """Rows whose text contains none of the literal patterns."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.coalesce(F.col(text).contains(p), F.lit(False))
    return chunks.where(~hit)


def junk(chunks: DataFrame, least: int = 200, page: str = "source_file") -> Column:
    """Whether a chunk is junk: nearly no content, a lone heading, or small; a small chunk stays if it has a table
    or a procedure, or is the only one of its page. Needs text, char_count, has_table, has_procedure, page_chunks."""
    bare = F.length(F.regexp_replace("text", r"[*#\-|_\s]", "")) < 10
    lines = F.filter(F.split("text", "\n"), lambda x: X.stripped(x) != "")
    heading = (F.size(lines) == 1) & F.coalesce(X.stripped(F.get(lines, 0)).startswith("#"), F.lit(False))
    small = (F.col("char_count") < least) & ~F.col("has_table") & ~F.col("has_procedure") & (F.col("page_chunks") != 1)
    return bare | heading | small


def without_junk(chunks: DataFrame, least: int = 200, page: str = "source_file") -> DataFrame:
    """chunks without junk. Pages are counted map-side and joined, so that a page of many chunks is no single task."""
    pages = chunks.groupBy(F.col(page).alias("__page")).agg(F.count("*").alias("page_chunks"))
    counted = chunks.join(pages, F.col(page).eqNullSafe(F.col("__page")))
    return counted.where(~junk(counted, least, page)).drop("page_chunks", "__page")


def to_documents(chunks: DataFrame) -> DataFrame:
    """Chunk records as indexed documents: defaults for what is missing, lists as comma-separated text."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    made = X.chunk_id(empty("source_file"), F.coalesce("chunk_index", F.lit(0)), empty("text"))
    return chunks.select(
        empty("text").alias("page_content"),
        F.coalesce(F.nullif(F.col("id"), F.lit("")), made).alias("chunk_id"),
        *[empty(c).alias(c) for c in ("source_file", "page_title", "breadcrumbs", "section_title", "section_path")],
        F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"),
        F.coalesce("char_count", F.lit(0)).alias("char_count"),
        F.coalesce("has_table", F.lit(False)).alias("has_table"),
        F.coalesce("has_procedure", F.lit(False)).alias("has_procedure"),
        F.array_join(F.coalesce("block_types", F.array().cast("array<string>")), ",").alias("block_types"),
        empty("alt_sources").alias("alt_sources"),
    )


#: Bins of a histogram that the driver looks at.
BINS = 1024


def upper_median(counts: DataFrame, value: str) -> DataFrame:
    """The element n div 2 of the sorted whole numbers (column upper_median); nulls do not count, none: null.

    The range is cut into bins, and the bin that holds the element is cut again until it is one number: the driver sees
    ``BINS`` counts a round, and a round is a sum in the tasks.
    """
    spark, kind = counts.sparkSession, counts.schema[value].dataType
    by_value = saved(counts.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("long").alias("v")).agg(F.count("*").alias("n")))
    low, high, n = by_value.agg(F.min("v"), F.max("v"), F.sum("n")).first()
    place = None if n is None else n // 2
    while place is not None and low < high:
        width = -(-(high - low + 1) // BINS)
        bins = by_value.where(F.col("v").between(low, high)).groupBy(F.expr(f"(v - {low}L) div {width}L").alias("bin")).agg(F.sum("n").alias("n"))
        for r in bins.orderBy("bin").collect():
            if place < r["n"]:
                low, high = low + r["bin"] * width, min(high, low + (r["bin"] + 1) * width - 1)
                break
            place -= r["n"]
    return spark.createDataFrame([(low,)], "upper_median long").select(F.col("upper_median").cast(kind))


def statistics(chunks: DataFrame, size: str = "char_count", page: str = "source_file") -> DataFrame:
    """One row: chunks, pages, chunks a page, least, most, mean, upper median and sum of sizes."""
    facts = chunks.agg(
        F.count("*").alias("chunks"),
        F.countDistinct(page).alias("pages"),
        (F.count("*") / F.countDistinct(page)).alias("chunks_per_page"),
        F.min(size).alias("min_size"),
        F.max(size).alias("max_size"),
        F.avg(size).alias("mean_size"),
        F.sum(size).alias("total_size"),
    )
    return facts.join(upper_median(chunks, size))  # one row each


SIZES = [(0, 200, "<200"), (200, 500, "200-500"), (500, 1000, "500-1000"), (1000, 1500, "1000-1500"), (1500, 3000, "1500-3000"), (3000, None, ">3000")]


def size_histogram(chunks: DataFrame, size: str = "char_count") -> DataFrame:
    """Chunks of each size class, empty classes included."""
    label = F.lit(None).cast("string")
    for low, high, name in reversed(SIZES):
        label = F.when((F.col(size) >= low) & (F.lit(True) if high is None else F.col(size) < high), F.lit(name)).otherwise(label)
    names = chunks.sparkSession.createDataFrame([(i, n) for i, (_, _, n) in enumerate(SIZES)], "bucket int, label string")
    counts = chunks.groupBy(label.alias("label")).agg(F.count("*").alias("n"))
    return names.join(counts, "label", "left").select("bucket", "label", F.coalesce("n", F.lit(0)).alias("n"))


def counters(chunks: DataFrame, patterns: list[str], text: str = "text") -> DataFrame:
    """One row: chunks, those that stop patterns remove, copies removed of the rest, and those left."""
    rest = without(chunks, patterns, text)
    left = rest.agg(F.count("*").alias("__rest"), F.countDistinct(F.coalesce(F.md5(text), F.lit(""))).alias("documents"))
    both = chunks.agg(F.count("*").alias("chunks")).join(left)  # one row each
    return both.select("chunks", (F.col("chunks") - F.col("__rest")).alias("stopped"), (F.col("__rest") - F.col("documents")).alias("duplicates"), "documents")


def type_histogram(chunks: DataFrame, types: str = "block_types") -> DataFrame:
    return chunks.select(F.explode(types).alias("type")).groupBy("type").agg(F.count("*").alias("n"))
