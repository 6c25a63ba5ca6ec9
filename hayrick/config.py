"""Settings, from the session's configuration under `hayrick.` or the environment under `HAYRICK_`."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from pathlib import Path
from typing import get_type_hints

from pyspark.sql import SparkSession

from hayrick.errors import HayrickError

# What a setting may be.
CHOICES = {"embed_input_format": ("instruct-text", "qwen3"), "rerank_protocol": ("openai", "llama-completion"), "rerank_query_format": ("instruct", "raw")}
LEAST = {"embed_dim": 1, "candidate_limit": 1, "watch_interval": 0, "watch_debounce": 0, "watch_content_interval": 0}


@dataclass(frozen=True)
class Settings:
    """Endpoints and keys of one kind of model, where unset, are those of all."""

    index_dir: str = str(Path.home() / ".hayrick")
    base_url: str | None = None
    api_key: str | None = None
    llm_base_url: str | None = None
    llm_api_key: str | None = None
    llm_model: str = ""
    embed_base_url: str | None = None
    embed_api_key: str | None = None
    embed_model: str = ""
    embed_dim: int = 1024
    embed_input_format: str = "instruct-text"
    rerank_base_url: str | None = None
    rerank_api_key: str | None = None
    rerank_model: str = ""
    rerank_protocol: str = "openai"
    rerank_query_format: str = "instruct"
    candidate_limit: int = 50
    pool_expansion: bool = True
    search_deadline_seconds: float | None = None
    watch_interval: float = 2.0
    watch_debounce: float = 0.5
    watch_content_interval: float = 30.0

    def __post_init__(self) -> None:
        wrong = [{"field": k, "input": getattr(self, k), "accepted": list(v)} for k, v in CHOICES.items() if getattr(self, k) not in v]
        wrong += [{"field": k, "input": getattr(self, k), "accepted": [f">= {v}"]} for k, v in LEAST.items() if getattr(self, k) < v]
        if wrong:
            raise HayrickError("INVALID_ARGUMENT", "settings out of range", violations=wrong)

    @classmethod
    def of(cls, spark: SparkSession, **given: object) -> "Settings":
        """Given values first, then the session's, then the environment's, then the defaults."""
        kinds, found = get_type_hints(cls), {}
        for f in fields(cls):
            text = spark.conf.get(f"hayrick.{f.name}", None) or os.environ.get(f"HAYRICK_{f.name.upper()}")
            if f.name in given:
                found[f.name] = given[f.name]
            elif text is not None:
                found[f.name] = _value(f.name, text, kinds[f.name])
        return cls(**found)

    def endpoint(self, kind: str) -> tuple[str | None, str | None]:
        """URL and key of llm, embed or rerank."""
        return getattr(self, f"{kind}_base_url") or self.base_url, getattr(self, f"{kind}_api_key") or self.api_key


def _value(name: str, text: str, kind: object) -> object:
    try:
        if kind is bool:
            return {"true": True, "1": True, "false": False, "0": False}[text.lower()]
        if kind is int:
            return int(text)
        if kind in (float, float | None):
            return float(text)
        return text
    except (KeyError, ValueError):
        raise HayrickError("INVALID_ARGUMENT", f"setting {name} can't be {text!r}") from None
