"""Query expansion, reranking and answer contexts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from . import models
from .models import PairScorer


def rewrites(question: Column, reply: Column, most: int = 3) -> Column:
    """The question and what a model's reply adds: lines that start with ``- ``, stripped, longer than five
    characters, ``most`` of them, none that equals the question but for case."""
    lines = F.transform(F.split(F.coalesce(reply, F.lit("")), "\n"), lambda x: X.stripped(x))
    listed = F.transform(F.filter(lines, lambda x: x.startswith("- ")), lambda x: X.stripped(F.substring(x, 3, 1 << 30)))
    fine = F.slice(F.filter(listed, lambda x: F.length(x) > 5), 1, most)
    other = F.filter(fine, lambda x: F.lower(x) != F.lower(question))
    return F.slice(F.concat(F.array(question), other), 1, most + 1)


def variants(queries: DataFrame, question: str = "text", reply: str = "reply", most: int = 3) -> DataFrame:
    """One row for each variant, with list_idx from 0."""
    return queries.select("query_id", F.posexplode(rewrites(F.col(question), F.col(reply), most)).alias("list_idx", "text"))


#: Fixed value: the prompt for rewrites; ``{product}`` is a setting.
REWRITE = (
    "Ты помощник по поиску в документации {product}.\n"
    "\n"
    "Пользователь задал вопрос разговорным языком. Сформулируй 2-3 поисковых\n"
    "запроса, которые помогут найти ответ в технической документации.\n"
    "\n"
    "Правила:\n"
    '1. Каждый запрос должен быть на отдельной строке и начинаться с "- ".\n'
    "2. Используй техническую терминологию {product}.\n"
    "3. Запросы должны покрывать разные аспекты вопроса.\n"
    "4. Не добавляй пояснений, только запросы.\n"
    "5. Если вопрос уже точный и технический, верни его как есть.\n"
    "\n"
    "Примеры:\n"
    "\n"
    'Вопрос: "лагает компьютер в {product}"\n'
    "- системные требования {product} аппаратное обеспечение\n"
    "- оптимизация производительности настройки отображения\n"
    "- работа с большими сборками снижение нагрузки\n"
    "\n"
    'Вопрос: "как нарисовать дырку в детали"\n'
    "- создание отверстия в детали\n"
    "- вырезать выдавливанием эскиз отверстия\n"
    "- отверстие в листовом теле\n"
    "\n"
    'Вопрос: "файл не открывается"\n'
    "- открытие документа {product} ошибка\n"
    "- форматы файлов совместимость импорт\n"
    "- восстановление поврежденного файла\n"
    "\n"
    'Вопрос: "{question}"\n'
)


def rewrite_prompt(question: str, product: str = "") -> list[dict]:
    return [{"role": "user", "content": REWRITE.format(product=product, question=question)}]


def overlap_logit(query: Column, text: Column) -> Column:
    """An offline stand-in for a cross-encoder: how far more than a third of the query's words occur."""
    asked = F.array_distinct(X.tokens(query))
    hit = F.size(F.array_intersect(asked, X.tokens(text)))
    return 6.0 * hit / F.greatest(F.size(asked), F.lit(1)) - 2.0


def rerank(candidates: DataFrame, logit: Column, k: int, max_length: int = 512) -> DataFrame:
    """The k best of each query by sigmoid(logit), ties in candidate order; ``reranker_score`` shows four digits of it.
    Scorers see the first ``4 * max_length`` characters: use ``clipped``, or ``scored``, which does. A null logit comes last."""
    sigmoid = candidates.withColumn("__score", 1 / (1 + F.exp(-logit)))
    best = Window.partitionBy("query_id").orderBy(F.desc("__score"), "rank")
    numbered = sigmoid.withColumn("__n", F.row_number().over(best)).where(F.col("__n") <= k)
    return numbered.withColumns({"rank": F.col("__n") - 1, "reranker_score": F.round("__score", 4)}).drop("__n", "__score")


def scored(candidates: DataFrame, name: str, make: Callable[[], PairScorer], batch: int = 16, max_length: int = 512, question: str = "question", text: str = "text", out: str = "logit") -> DataFrame:
    """candidates with the logit that a model gives to each pair of question and text.

    Pairs are dealt to tasks at random and sorted by length there, so that a batch holds pairs of like length and needs
    little padding; a model sees at most ``batch`` pairs at once. ``make`` makes the model, once for each worker process
    and ``name``, however many tasks it runs. Null questions and texts are empty ones.
    """
    schema = candidates.select("*").withColumn(out, F.lit(0.0)).schema
    clip = 4 * max_length

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = models.held(name, make)
        for part in parts:
            pairs = [(q or "", (t or "")[:clip]) for q, t in zip(part[question], part[text])]
            order = sorted(range(len(pairs)), key=lambda i: len(pairs[i][0]) + len(pairs[i][1]))
            logits = np.zeros(len(pairs))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                logits[some] = np.asarray(model([pairs[i] for i in some]), np.float64).reshape(-1)
            yield part.assign(**{out: logits})

    return candidates.mapInPandas(run, schema)


def clipped(text: Column, max_length: int = 512) -> Column:
    return F.substring(text, 1, 4 * max_length)


#: Labels of contexts and answers; ``{product}`` is the documented product's name, a setting.
SOURCE, SECTION, HEADING = "Источник", "Раздел", "Источники:"
NOTHING_FOUND = "К сожалению, я не нашёл информации по этому вопросу в документации {product}. Попробуйте переформулировать вопрос или уточнить тему."


def contexts(rows: DataFrame, base_url: str = "") -> DataFrame:
    """(query_id, context, refs) from ranked rows: numbered blocks with their place, and their references. A row
    without a section path has its title as path, in the reference too."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    number = F.col("rank") + 1
    path = F.when(empty("section_path") == "", empty("page_title")).otherwise(F.col("section_path"))
    head = F.concat(F.lit(f"[{SOURCE} "), number.cast("string"), F.lit("] "), path)
    crumbs = F.when((empty("breadcrumbs") != "") & (empty("breadcrumbs") != path), F.concat(F.lit(f"\n  {SECTION}: "), F.col("breadcrumbs"))).otherwise("")
    block = F.concat(head, crumbs, F.lit("\n"), F.col("text"))
    url = X.source_url(base_url, F.col("source_file"))
    ref = F.struct(number.alias("number"), "source_file", "page_title", path.alias("section_path"), "breadcrumbs", url.alias("url"))
    ordered = F.sort_array(F.collect_list(F.struct(number.alias("n"), block.alias("block"), ref.alias("ref"))))
    out = rows.groupBy("query_id").agg(ordered.alias("all"))
    return out.select("query_id", F.array_join(F.transform("all", lambda x: x["block"]), "\n\n---\n\n").alias("context"), F.transform("all", lambda x: x["ref"]).alias("refs"))


#: How a list of sources that a model adds to its answer begins, whatever the case.
TAILS = [
    r"\n---\s*\n\s*\*{0,2}Источники?\*{0,2}",
    r"\n#{1,4}\s*Источники?",
    r"\n\*{2}Источники?\*{0,2}\s*:",
    r"\nИсточники?\s*:",
]
#: Fixed value: a mark of a source, not one that is a link already.
MARK = r"(?<!\[)\[(\d{1,2})\](?!\]|\()"
_tails = [re.compile(p, re.IGNORECASE) for p in TAILS]
_mark = re.compile(MARK)


def cite(answer: str, refs: list[dict], style: str = "markdown") -> str:
    """The answer with its marks ``[n]`` as links (or, in another style, with titles) and one list of the sources
    used. A list that the answer brings along goes, but its numbers count as used; unknown numbers stay as they are."""
    cut = min([m.start() for p in _tails if (m := p.search(answer))], default=len(answer))
    known = {r["number"]: r for r in refs}
    used = {int(n) for n in re.findall(r"\[(\d{1,2})\]", answer[cut:])}
    used |= {int(m[1]) for m in _mark.finditer(answer[:cut]) if int(m[1]) in known}

    def link(m: re.Match) -> str:
        ref = known.get(int(m[1]))
        if ref is None:
            return m[0]
        return f"[[{ref['number']}]]({ref['url']})" if style == "markdown" and ref["url"] else f"[{ref['number']}: {ref['page_title']}]"

    body = _mark.sub(link, answer[:cut])
    if not used:
        return body.strip()
    lines = []
    for ref in (known[n] for n in sorted(used) if n in known):
        title = ref["section_path"] or ref["page_title"]
        lines.append(f"- [{ref['number']}] " + (f"[{title}]({ref['url']})" if ref["url"] else title))
    return "\n".join([f"{body.rstrip()}\n\n**{HEADING}**", *lines]).strip()


REFS = T.ArrayType(T.StructType([T.StructField("number", T.IntegerType())] + [T.StructField(c, T.StringType()) for c in ("source_file", "page_title", "section_path", "breadcrumbs", "url")]))


def answered(queries: DataFrame, rows: DataFrame, base_url: str = "", product: str = "") -> DataFrame:
    """queries (query_id, text) with context, refs and ``answer``: null where a model has to write it, the fixed
    apology where nothing was found."""
    out = queries.join(contexts(rows, base_url), "query_id", "left")
    return out.withColumn("answer", F.when(F.col("context").isNull(), F.lit(NOTHING_FOUND.format(product=product))))


def cited(answers: DataFrame, style: str = "markdown", answer: str = "answer") -> DataFrame:
    """answers (answer, refs) with ``cited``; what links insert is never matched again, so this runs in Arrow batches."""

    @F.pandas_udf("string")
    def run(answer, refs):
        return answer.combine(refs, lambda a, r: cite(a or "", [x if isinstance(x, dict) else x.asDict() for x in (r if r is not None else [])], style))

    return answers.withColumn("cited", run(answer, F.col("refs").cast(REFS)))
