"""Typed configuration with defaults, read on the driver from YAML files.

A folder of files comes from an argument, else from SILTLOOM_CONFIG_DIR; without one, defaults hold.
Connection settings come from the environment and are never logged.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields
from functools import lru_cache
from pathlib import Path
from typing import Any

from .functions.chunk import CHUNK_OVERLAP, CHUNK_SIZE, SEPARATORS


@lru_cache(maxsize=None)
def load_yaml(path: str) -> dict[str, Any]:
    """A YAML file as a dict; an error if it is missing."""
    import yaml

    file = Path(path)
    if not file.exists():
        raise FileNotFoundError(path)
    return yaml.safe_load(file.read_text(encoding="utf-8")) or {}


@dataclass(frozen=True)
class Crawl:
    base_url: str = ""
    hash_algorithm: str = "md5"
    hash_length: int = 16
    max_pages_total: int = 0
    max_depth: int = 1000
    download_attachments: bool = True
    request_timeout: int = 20
    max_attempts: int = 3
    backoff_seconds: float = 2.0
    politeness_delay: float = 0.5
    extraction_timeout: int = 60


@dataclass(frozen=True)
class Chunking:
    chunk_size: int = CHUNK_SIZE
    chunk_overlap: int = CHUNK_OVERLAP
    separators: tuple[str, ...] = SEPARATORS


@dataclass(frozen=True)
class Embedding:
    dim: int = 1024
    batch_size: int = 16


@dataclass(frozen=True)
class Retrieval:
    vector_top_k: int = 25
    score_threshold: float = 0.25
    bm25_top_k: int = 15
    vector_weight: float = 0.65
    bm25_weight: float = 0.35
    final_top_k: int = 10
    distance: str = "cosine"


@dataclass(frozen=True)
class Rerank:
    enabled: bool = True
    candidate_count: int = 20
    top_k: int = 6


@dataclass(frozen=True)
class Config:
    crawl: Crawl = field(default_factory=Crawl)
    chunking: Chunking = field(default_factory=Chunking)
    embedding: Embedding = field(default_factory=Embedding)
    retrieval: Retrieval = field(default_factory=Retrieval)
    reranker: Rerank = field(default_factory=Rerank)


def _section(kind: type, raw: dict[str, Any]):
    """A section from a mapping: values take the type of their default; unknown keys are left out."""
    got = {}
    for f in fields(kind):
        if f.name in raw:
            default = f.default
            value = raw[f.name]
            got[f.name] = tuple(value) if isinstance(default, tuple) else type(default)(value) if default is not None else value
    return kind(**got)


def _flat(raw: dict[str, Any], **nested: dict[str, str]) -> dict[str, Any]:
    """Nested keys brought up under the names that sections use."""
    out = dict(raw)
    for parent, names in nested.items():
        for old, new in names.items():
            if old in (raw.get(parent) or {}):
                out[new] = raw[parent][old]
    return out


def load(folder: str | None = None) -> Config:
    """The configuration of a folder with crawl, chunking, embedding, retrieval and reranker files, each optional."""
    folder = folder or os.environ.get("SILTLOOM_CONFIG_DIR")
    if not folder:
        return Config()

    def read(name: str) -> dict[str, Any]:
        path = Path(folder) / f"{name}.yaml"
        return load_yaml(str(path)) if path.exists() else {}

    crawl = _flat(read("crawl"), retry={"max_attempts": "max_attempts", "backoff_seconds": "backoff_seconds"}, extraction={"timeout": "extraction_timeout"}, crawler={k: k for k in ("hash_algorithm", "hash_length", "politeness_delay", "max_pages_total")})
    retrieval = _flat(read("retrieval"), vector={"top_k": "vector_top_k", "score_threshold": "score_threshold"}, bm25={"top_k": "bm25_top_k"}, fusion={"vector_weight": "vector_weight", "bm25_weight": "bm25_weight"})
    return Config(_section(Crawl, crawl), _section(Chunking, read("chunking")), _section(Embedding, read("embedding")), _section(Retrieval, retrieval), _section(Rerank, read("reranker")))


def database_url() -> str | None:
    """A JDBC URL from the environment, or None."""
    host = os.environ.get("DB_HOST")
    return f"jdbc:postgresql://{host}:{os.environ.get('DB_PORT', '5432')}/{os.environ.get('DB_NAME', 'rag')}" if host else None
