"""Questions to answers, and answers to judgments: prompts, model calls, citations, reports."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import evaluate, query
from .models import Chat, replies

#: The prompts; ``{product}`` is a setting.
SYSTEM = (
    "Ты — эксперт-помощник по {product}. Отвечай на вопросы пользователей строго на основе предоставленных фрагментов документации.\n"
    "\n"
    "Правила:\n"
    "1. Используй ТОЛЬКО информацию из предоставленного контекста.\n"
    "2. Если контекст не содержит ответа — честно скажи об этом.\n"
    "3. Отвечай на русском языке, структурированно и понятно.\n"
    "4. При описании процедур сохраняй нумерацию шагов.\n"
    "5. Упоминай названия команд, кнопок и параметров жирным шрифтом.\n"
    "6. Если информация из нескольких фрагментов — объедини логично.\n"
    "7. ОБЯЗАТЕЛЬНО ссылайся на источники в формате [1], [2] и т.д. Ставь ссылку рядом с утверждением, которое из этого источника взято.\n"
    '8. НЕ добавляй раздел "Источники" в конце — он будет добавлен автоматически.'
)
USER = (
    "Контекст из документации {product}:\n"
    "\n"
    "{context}\n"
    "\n"
    "---\n"
    "\n"
    "Вопрос: {question}\n"
    "\n"
    'Ответ (ссылайся на источники как [1], [2] и т.д., НЕ добавляй раздел "Источники" в конце):'
)
JUDGE_SYSTEM = (
    "Ты эксперт по оценке качества ответов справочной RAG-системы по {product}.\n"
    "\n"
    "Тебе будут даны:\n"
    "1. вопрос пользователя;\n"
    "2. найденные системой фрагменты документации;\n"
    "3. ответ системы.\n"
    "\n"
    "Оцени ответ по четырем критериям: faithfulness, completeness, relevance, helpfulness.\n"
    'Для каждого критерия поставь "yes", "partial" или "no" и дай краткое обоснование.\n'
)
JUDGE_USER = (
    "## Вопрос пользователя\n"
    "{question}\n"
    "\n"
    "## Найденные фрагменты документации\n"
    "{context}\n"
    "\n"
    "## Ответ системы\n"
    "{answer}\n"
    "\n"
    "---\n"
    "\n"
    "Критерии:\n"
    "\n"
    "1. faithfulness: ответ основан только на предоставленных фрагментах?\n"
    "2. completeness: ответ достаточно полно покрывает вопрос с учетом контекста?\n"
    "3. relevance: ответ по делу, без лишней нерелевантной информации?\n"
    "4. helpfulness: поможет ли ответ пользователю {product} решить задачу?\n"
    "\n"
    "Ответь строго JSON без markdown:\n"
    "{{\n"
    '  "faithfulness": {{"score": "yes|partial|no", "reason": "..."}},\n'
    '  "completeness": {{"score": "yes|partial|no", "reason": "..."}},\n'
    '  "relevance": {{"score": "yes|partial|no", "reason": "..."}},\n'
    '  "helpfulness": {{"score": "yes|partial|no", "reason": "..."}}\n'
    "}}\n"
)
#: How much of a fragment, of all of them and of an answer a judge reads; its labels and empty answer.
FRAGMENT_CHARS, CONTEXT_CHARS, ANSWER_CHARS = 1500, 6000, 4000
FRAGMENT, FILE, PAGE, NO_ANSWER = "Фрагмент", "Файл", "Раздел", "Не найдено информации."


def prompt(context: str, question: str, product: str = "") -> list[dict]:
    return [{"role": "system", "content": SYSTEM.format(product=product)}, {"role": "user", "content": USER.format(product=product, context=context, question=question)}]


def judge_prompt(question: str, context: str, answer: str, product: str = "") -> list[dict]:
    asked = JUDGE_USER.format(product=product, question=question, context=context[:CONTEXT_CHARS], answer=answer[:ANSWER_CHARS])
    return [{"role": "system", "content": JUDGE_SYSTEM.format(product=product)}, {"role": "user", "content": asked}]


def ask(questions: DataFrame, rows: DataFrame, make: Callable[[], Chat], base_url: str = "", product: str = "", style: str = "markdown", debug: bool = False) -> DataFrame:
    """(query_id, question, answer, answer_raw, sources, context, error, rag_time) for questions (query_id, text) from their
    ranked rows: the fixed apology where nothing was found, else the model's reply with its marks as links. Contexts
    are returned for debugging only. rag_time: seconds that the reply took; what is found is looked up for all questions
    together."""
    wanted = query.answered(questions, rows, base_url, product).withColumnRenamed("text", "question").select("query_id", "question", "context", "refs", "answer")
    got = replies(wanted, lambda r: prompt(r["context"], r["question"], product) if r["context"] is not None else [], make, "answer_raw", seconds="rag_time")
    linked = query.cited(got, style, "answer_raw")
    none = F.col("context").isNull()
    return linked.select(
        "query_id",
        "question",
        F.when(none, F.col("answer")).when(F.col("answer_raw").isNotNull(), F.col("cited")).alias("answer"),
        F.coalesce("answer_raw", F.lit("")).alias("answer_raw"),
        F.coalesce(F.col("refs").cast(query.REFS), F.array().cast(query.REFS)).alias("sources"),
        (F.coalesce("context", F.lit("")) if debug else F.lit("")).alias("context"),
        "error",
        "rag_time",
    )


def fragments(rows: DataFrame) -> DataFrame:
    """(query_id, context, n_docs): what a judge reads of the ranked rows."""
    place = lambda c: F.coalesce(F.col(c), F.lit("?"))
    one = F.concat(F.lit(f"\n--- {FRAGMENT} "), (F.col("rank") + 1).cast("string"), F.lit(f" ---\n{FILE}: "), place("source_file"), F.lit(f"\n{PAGE}: "), place("page_title"), F.lit("\n"), F.substring("text", 1, FRAGMENT_CHARS), F.lit("\n"))
    ordered = F.sort_array(F.collect_list(F.struct("rank", one.alias("t"))))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "").alias("context"), F.count("*").alias("n_docs"))


def judge(answers: DataFrame, rows: DataFrame, make: Callable[[], Chat], product: str = "", attempts: int = 1) -> DataFrame:
    """(idx, question, answer, n_docs, rag_time, judgment) of answers (query_id, question, answer and, where they were
    timed, rag_time). A judge that fails is an
    error of every criterion, with the failure as its reason; the other questions go on."""
    said = F.when(F.col("n_docs").isNull(), F.lit(NO_ANSWER)).otherwise(F.coalesce("answer", F.lit("")))
    took = F.col("rag_time") if "rag_time" in answers.columns else F.lit(None).cast("double")
    wanted = answers.select("query_id", "question", "answer", took.alias("rag_time")).join(fragments(rows), "query_id", "left").select("query_id", "question", "rag_time", said.alias("answer"), F.coalesce("context", F.lit("")).alias("context"), F.coalesce("n_docs", F.lit(0)).cast("long").alias("n_docs"))
    got = replies(wanted, lambda r: judge_prompt(r["question"], r["context"], r["answer"], product), make, attempts=attempts)
    failed = F.map_from_arrays(F.array(*map(F.lit, evaluate.CRITERIA)), F.array_repeat(F.struct(F.lit("error").alias("score"), F.col("error").alias("reason")), len(evaluate.CRITERIA)))
    return got.select(F.col("query_id").alias("idx"), "question", "answer", "n_docs", "rag_time", F.when(F.col("error").isNotNull(), failed).otherwise(evaluate.judgment(F.col("reply"))).alias("judgment"))


#: The question for one fragment's relevance, and how much of the fragment is shown.
LABEL_CHARS = 3000
LABEL_USER = (
    "Ты — эксперт-оценщик релевантности для системы поиска по документации {product}.\n"
    "\n"
    "## Вопрос пользователя\n"
    "{question}\n"
    "\n"
    "## Фрагмент документации\n"
    "Файл: {source_file}\n"
    "\n"
    "{content}\n"
    "\n"
    "---\n"
    "\n"
    '"relevant" — фрагмент ПОЛЕЗЕН для ответа: описывает нужную функцию/команду/операцию, содержит инструкцию или параметры.\n'
    '"partial" — фрагмент КОСВЕННО связан: упоминает тему, но без конкретной полезной информации.\n'
    '"irrelevant" — фрагмент НЕ ПОЛЕЗЕН: другая тема.\n'
    "\n"
    "Ответь СТРОГО в формате JSON (без markdown):\n"
    '{{"label": "relevant|partial|irrelevant", "reason": "краткое обоснование"}}\n'
)


def label_prompt(question: str, source_file: str, content: str, product: str = "") -> list[dict]:
    return [{"role": "user", "content": LABEL_USER.format(product=product, question=question, source_file=source_file, content=(content or "")[:LABEL_CHARS])}]


def read_json(reply: str) -> object:
    """The JSON of a reply, which may begin with a code fence; raises if there is none."""
    raw = reply.strip()
    if raw.startswith("```"):
        raw = raw.split("\n", 1)[1].rsplit("```", 1)[0]
    return json.loads(raw)


def evaluated(evaluations: DataFrame) -> DataFrame:
    """Metrics of judged answers by criterion."""
    return evaluate.generation_metrics(evaluate.criteria(evaluations))
