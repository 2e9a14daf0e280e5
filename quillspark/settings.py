"""Settings of a service from its environment: a value that does not parse becomes the default."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields

# Names of variables and defaults.
NAMES = {
    "api_key": "GEMINI_API_KEY",
    "model": "GEMINI_MODEL",
    "per_minute": "GEN_RPM_LIMIT",
    "timeout_ms": "GEN_TIMEOUT_MS",
    "attempts": "GEN_MAX_RETRIES",
    "embed_model": "EMBED_MODEL",
    "top_k": "TOP_K",
    "min_score": "RETRIEVAL_MIN_SCORE",
    "strategy": "STRATEGY",
    "index_kind": "INDEX_KIND",
    "mode": "RETRIEVAL_MODE",
    "rrf_k": "RRF_K",
    "origins": "ALLOWED_ORIGINS",
    "port": "PORT",
    "log_level": "LOG_LEVEL",
}
# End of fixed values.


def parsed(raw: str | None, default, kind: Callable):
    """The value, or the default where there is none or it does not parse."""
    try:
        return kind(raw) if raw else default
    except ValueError:
        return default


def origins(raw: str) -> list[str]:
    """Origins of a comma-separated list; a lone star stands for all."""
    return [x for x in (part.strip() for part in raw.split(",")) if x]


@dataclass(frozen=True)
class Settings:
    api_key: str = ""
    model: str = "gemini-2.5-flash-lite"
    per_minute: int = 30
    timeout_ms: int = 8000
    attempts: int = 3
    embed_model: str = "BAAI/bge-small-en"
    top_k: int = 5
    min_score: float = 0.8167
    strategy: str = "parent_child"
    index_kind: str = "flat"
    mode: str = "hybrid"
    rrf_k: int = 60
    origins: str = "*"
    port: int = 7860
    log_level: str = "info"

    @classmethod
    def read(cls, environment: Mapping[str, str] = os.environ) -> Settings:
        found = {f.name: parsed(environment.get(NAMES[f.name]), f.default, type(f.default)) for f in fields(cls)}
        found["api_key"], found["mode"] = found["api_key"].strip(), found["mode"].lower()
        return cls(**found)

    @property
    def allowed_origins(self) -> list[str]:
        return origins(self.origins)

    @property
    def can_generate(self) -> bool:
        return bool(self.api_key)

    @property
    def index_path(self) -> str:
        return "/".join((self.embed_model.replace("/", "__"), self.index_kind, self.strategy))

    def redacted(self) -> dict:
        """What may be shown: everything but the key, of which only whether there is one."""
        shown = {f.name: getattr(self, f.name) for f in fields(self) if f.name not in ("api_key", "origins")}
        return {**shown, "generation_enabled": self.can_generate, "allowed_origins": self.allowed_origins}


def health(n_vectors: int | None, settings: Settings) -> dict:
    """What a health check answers: loading until an index is there."""
    return {"status": "loading" if n_vectors is None else "ok", "vectors": n_vectors or 0, "generation_enabled": settings.can_generate, "accepts_user_key": True}
