"""Settings of an application, kept as a JSON file."""

from __future__ import annotations

import json
import os
import tempfile
from dataclasses import asdict, dataclass, fields
from pathlib import Path


@dataclass
class Settings:
    documents: str = "documents"
    cache: str = ".corvane_cache"
    preset: str = "Balanced"
    k: int | None = None
    neighbours: int = 2
    flexible: bool = False
    ocr: bool = False
    ocr_language: str = "eng"
    theme: str = "light"
    embedding_model: str = ""


def load_settings(path: str | Path) -> Settings:
    """Defaults where the file is missing, broken or no object; unknown keys are ignored."""
    try:
        told = json.loads(Path(path).read_text("utf-8"))
    except (OSError, ValueError):
        return Settings()
    if not isinstance(told, dict):
        return Settings()
    return Settings(**{f.name: told[f.name] for f in fields(Settings) if f.name in told})


def save_settings(path: str | Path, settings: Settings) -> None:
    """Replaces the file in one step."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=path.parent, prefix=".settings-")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(asdict(settings), f, indent=2)
    os.replace(temporary, path)
