"""Settings from the environment, over a file of NAME=value lines that never overrides it."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    job_cache_hours: int = 6
    embedding_dimensions: int = 1024
    embedding_batch_workers: int = 2
    cache_dir: str = "data/cache"
    min_match_score: float = 0.0
    top_k: int = 100
    max_pages: int = 100
    max_resume_mb: int = 5


def load_settings(env_file: str | None = None, env: dict[str, str] | None = None) -> Settings:
    """Defaults, then the file, then the environment (which wins); names are the fields' in upper case."""
    told: dict[str, str] = {}
    if env_file and Path(env_file).is_file():
        for line in Path(env_file).read_text().splitlines():
            name, eq, value = line.partition("=")
            if eq and not name.lstrip().startswith("#"):
                told[name.strip()] = value.strip().strip("'\"")
    told |= os.environ if env is None else env
    kinds = {"int": int, "float": float, "str": str}
    return Settings(**{f.name: kinds[f.type](told[f.name.upper()]) for f in fields(Settings) if f.name.upper() in told})
