"""External models behind plain functions: texts to vectors, messages to replies.

Models run in Arrow batches inside ``mapInPandas``, one client a task. Whatever is not installed or not reachable is
replaced by registering another function; the offline stand-ins are deterministic.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..config import Embedding, Language, Rerank
from .vector import hashing_embedder

Embedder = Callable[[list[str]], np.ndarray]
Chat = Callable[[list[dict]], str]
#: (question, text) pairs to one logit each.
PairScorer = Callable[[list[tuple[str, str]]], np.ndarray]
_embedders: dict[str, Callable[[Embedding], Embedder]] = {"hashing": lambda config: hashing_embedder()}


def register_embedder(name: str, make: Callable[[Embedding], Embedder]) -> None:
    _embedders[name] = make


def instructed(model: str) -> bool:
    """Whether a model wants its queries with an instruction."""
    return "e5" in model.lower() and "instruct" in model.lower()


_held: dict[str, object] = {}


def held(name: str, make: Callable[[], object]):
    """What ``make`` makes, kept in this worker process by name: a model outlives the task that loaded it."""
    if name not in _held:
        _held[name] = make()
    return _held[name]


def overlap_scorer() -> PairScorer:
    """An offline stand-in for a cross-encoder, as ``query.overlap_logit``: how far more than a third of the question's
    words occur in the text."""
    import regex

    split = regex.compile(r"[^\p{L}\p{N}_]+").split
    words = lambda text: {w for w in split(text.lower()) if len(w) >= 3}

    def score(pairs: list[tuple[str, str]]) -> np.ndarray:
        sets = [(words(q), words(t)) for q, t in pairs]
        return np.array([6.0 * len(q & t) / max(1, len(q)) - 2.0 for q, t in sets])

    return score


def _cross_encoder(config: Rerank) -> PairScorer:
    from sentence_transformers import CrossEncoder

    model = CrossEncoder(config.model, max_length=config.max_length)
    return lambda pairs: model.predict(pairs, batch_size=config.batch, activation_fn=lambda x: x)


_scorers: dict[str, Callable[[Rerank], PairScorer]] = {"overlap": lambda config: overlap_scorer()}


def register_scorer(name: str, make: Callable[[Rerank], PairScorer]) -> None:
    _scorers[name] = make


def scorer(config: Rerank) -> Callable[[], PairScorer]:
    """How to make the registered scorer of that name, else a cross-encoder."""
    make = _scorers.get(config.model, _cross_encoder)
    return lambda: make(config)


def _sentence_transformer(config: Embedding) -> Embedder:
    """Models that want instructions run as they are, others at half precision."""
    from sentence_transformers import SentenceTransformer

    half = {} if instructed(config.model) else {"model_kwargs": {"torch_dtype": "float16"}}
    model = SentenceTransformer(config.model, device=config.device or None, **half)
    return lambda texts: model.encode(texts, batch_size=config.batch, normalize_embeddings=True)


def embedder(config: Embedding, query: bool = False) -> Embedder:
    """The registered embedder of that name, else a sentence transformer. Queries of instructed models are led by
    their task."""
    make = _embedders.get(config.model, _sentence_transformer)
    model = make(config)
    if query and instructed(config.model):
        return lambda texts: model([f"Instruct: {config.task}\nQuery: {t}" for t in texts])
    return model


def chat_request(config: Language, messages: list[dict]) -> dict:
    """Body of a request: top_p only where it is set; thinking is switched off through the chat template."""
    body = {"model": config.model, "messages": messages, "temperature": config.temperature, "max_tokens": config.max_tokens}
    if config.top_p is not None:
        body["top_p"] = config.top_p
    if config.disable_thinking:
        body["chat_template_kwargs"] = {"enable_thinking": False}
    return body


def chat(config: Language, timeout: float = 120.0) -> Chat:
    """A client of the endpoint: the reply's text."""

    def ask(messages: list[dict]) -> str:
        data = json.dumps(chat_request(config, messages)).encode()
        head = {"Content-Type": "application/json", "Authorization": f"Bearer {config.api_key}"}
        request = urllib.request.Request(config.url.rstrip("/") + "/chat/completions", data, head)
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return json.load(reply)["choices"][0]["message"]["content"]

    return ask


#: Requests of a task that are under way at a time.
IN_FLIGHT = 4


def retried(ask: Callable[[], object], attempts: int = 5, wait: float = 5.0):
    """The first result of ``ask`` that does not raise, after waits that grow by ``wait``; the last error otherwise."""
    for n in range(1, attempts + 1):
        try:
            return ask()
        except Exception:
            if n == attempts:
                raise
            time.sleep(wait * n)


def replies(
    rows: DataFrame, messages: Callable[[dict], list[dict]], make: Callable[[], Chat], out: str = "reply", error: str = "error", attempts: int = 1, wait: float = 5.0,
    readable: Callable[[str], object] | None = None, seconds: str | None = None, in_flight: int = IN_FLIGHT,
) -> DataFrame:
    """rows with a model's reply to each, and the error where it gave none after all attempts (then reply is null).

    ``messages`` makes a row's messages, or none for a row that no model is asked about. ``readable`` raises on a reply that
    is as good as none. ``seconds`` names a column for the time that a row's reply took. One client a task, which asks for
    at most ``in_flight`` rows at a time.
    """
    timed = [f"`{seconds}` double"] if seconds else []
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"`{out}` string", f"`{error}` string", *timed])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()

        def once(asked: list[dict]) -> str:
            reply = client(asked)
            if readable is not None:
                readable(reply)
            return reply

        def one(row: dict) -> tuple[str | None, str | None, float]:
            asked, start = messages(row), time.perf_counter()
            try:
                text, problem = retried(lambda: once(asked), attempts, wait) if asked else None, None
            except Exception as e:  # one question must not end the job
                text, problem = None, str(e) or type(e).__name__
            return text, problem, time.perf_counter() - start if asked else 0.0

        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                text, problem, took = zip(*pool.map(one, batch.to_dict("records"))) if len(batch) else ((), (), ())
                yield batch.assign(**{out: list(text), error: list(problem)} | ({seconds: list(took)} if seconds else {}))

    return rows.mapInPandas(run, schema)
