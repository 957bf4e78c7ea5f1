"""Settings of a run: a YAML file where a YAML reader is installed, secrets from the environment only."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Settings:
    """Options of a run; the defaults are the reference's."""

    methods: tuple[str, ...] = ("bookmarks", "font_size", "pattern", "page_split")
    page_split_size: int = 20
    chunk_size: int = 1000
    backend: str = "api"
    voice: str = "default"
    expand_abbreviations: bool = True
    convert_numbers: bool = True
    inject_pauses: bool = True
    keep_blank_lines: bool = False
    extra: dict[str, Any] = field(default_factory=dict)


def load(path: str) -> Settings:
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML settings needs a YAML package") from e
    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f) or {}
    known = Settings.__dataclass_fields__
    flat = {k: tuple(v) if isinstance(v, list) else v for part in raw.values() if isinstance(part, dict) for k, v in part.items()}
    return Settings(**{k: v for k, v in flat.items() if k in known and k != "extra"}, extra={k: v for k, v in flat.items() if k not in known})


def secret(name: str) -> str:
    """An environment variable's value; never put into plans or Spark's configuration."""
    value = os.environ.get(name)
    if not value:
        raise KeyError(f"environment variable {name} is not set")
    return value
