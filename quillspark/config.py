"""Engine settings: defaults, then a YAML file, then environment variables."""

from __future__ import annotations

import dataclasses
import os
import types
import typing
from dataclasses import dataclass, field


@dataclass
class Chunking:
    target: int = 1500
    least: int = 200
    most: int = 3000
    see_also: bool = True
    command_invocation: bool = True
    images: bool = True


@dataclass
class Embedding:
    #: A registered embedder (``operators.models``) or a model that one knows how to load.
    model: str = "intfloat/multilingual-e5-large-instruct"
    device: str = ""
    task: str = "Дан вопрос, необходимо найти абзац текста с ответом"
    batch: int = 64


@dataclass
class Store:
    backend: str = "parquet"
    path: str = "/storage/vectors"
    collection: str = "docs"


@dataclass
class Retrieval:
    top_k: int = 15
    top_k_final: int = 5
    index_path: str = "data/indexes/bm25"
    score_threshold: float = 0.3
    rrf_k: int = 60
    chunks_per_file: int = 2


@dataclass
class Rerank:
    enabled: bool = True
    model: str = "BAAI/bge-reranker-v2-m3"
    candidates: int = 20
    max_length: int = 512
    batch: int = 16


@dataclass
class Rewrite:
    enabled: bool = True
    max_queries: int = 3


@dataclass
class Language:
    """An endpoint with the usual chat protocol."""

    url: str = "http://localhost:8000/v1"
    model: str = "llm"
    api_key: str = "not-needed"
    temperature: float = 0.3
    max_tokens: int = 16000
    top_p: float | None = None
    disable_thinking: bool = True


@dataclass
class Engine:
    chunking: Chunking = field(default_factory=Chunking)
    embedding: Embedding = field(default_factory=Embedding)
    store: Store = field(default_factory=Store)
    retrieval: Retrieval = field(default_factory=Retrieval)
    rerank: Rerank = field(default_factory=Rerank)
    rewrite: Rewrite = field(default_factory=Rewrite)
    language: Language = field(default_factory=Language)
    #: Where the documented pages are, and what they document.
    docs_url: str = ""
    product: str = "продукта"
    debug: bool = False


TRUE = {"1", "true", "yes", "on", "y"}
PREFIX = "QUILL_"
#: Name of an environment variable, after its prefix -> section (None: the engine itself) and field.
ENVIRONMENT = {
    "PERSIST_DIR": ("store", "path"),
    "COLLECTION": ("store", "collection"),
    "BACKEND": ("store", "backend"),
    "EMBEDDING_MODEL": ("embedding", "model"),
    "EMBEDDING_DEVICE": ("embedding", "device"),
    "LLM_URL": ("language", "url"),
    "LLM_MODEL": ("language", "model"),
    "LLM_API_KEY": ("language", "api_key"),
    "DOCS_URL": (None, "docs_url"),
    "TOP_K": ("retrieval", "top_k"),
    "TOP_K_FINAL": ("retrieval", "top_k_final"),
    "BM25_INDEX_PATH": ("retrieval", "index_path"),
    "RERANK": ("rerank", "enabled"),
    "REWRITE": ("rewrite", "enabled"),
}


def _cast(kind, value):
    if isinstance(kind, types.UnionType):
        if value is None:
            return None
        kind = next(k for k in typing.get_args(kind) if k is not type(None))
    if kind is bool and isinstance(value, str):
        return value.strip().lower() in TRUE
    return kind(value)


def _update(target, values: dict) -> None:
    kinds = typing.get_type_hints(type(target))
    for f in dataclasses.fields(target):
        if f.name not in values:
            continue
        current, value = getattr(target, f.name), values[f.name]
        if dataclasses.is_dataclass(current):
            _update(current, value or {})
        else:
            setattr(target, f.name, _cast(kinds[f.name], value))


def load(path: str | None = None, env: dict[str, str] | None = None, prefix: str = PREFIX) -> Engine:
    """Settings; unknown YAML keys are ignored, a file that is not there is an empty one; variables have ``prefix``."""
    engine = Engine()
    if path and os.path.exists(path):
        import yaml

        with open(path, encoding="utf-8") as f:
            _update(engine, yaml.safe_load(f) or {})
    env = os.environ if env is None else env
    for name, (section, key) in ENVIRONMENT.items():
        if prefix + name in env:
            _update(engine, {section: {key: env[prefix + name]}} if section else {key: env[prefix + name]})
    return engine
