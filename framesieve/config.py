"""Run configuration from a YAML file, with defaults."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path
from typing import Any


@dataclass
class Config:
    """Sections experiment, models and pipeline of a run. Missing sections are empty; an empty model revision is an error."""

    experiment: dict[str, Any] = field(default_factory=dict)
    models: dict[str, Any] = field(default_factory=dict)
    pipeline: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str | Path) -> Config:
        import yaml

        path = Path(path)
        if not path.exists():
            raise FileNotFoundError(f"no configuration at {path}")
        raw = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
        return cls(**{k: raw.get(k) or {} for k in ("experiment", "models", "pipeline")})

    @property
    def caption_model(self) -> str:
        return (self.models.get("vlm") or {}).get("name") or "caption-model"

    @property
    def caption_revision(self) -> str:
        revision = (self.models.get("vlm") or {}).get("revision", "unversioned")
        if not revision:
            raise RuntimeError("models.vlm.revision is empty; kept captions could not be told from new ones")
        return revision

    @property
    def samplers(self) -> list[str]:
        return list(self.pipeline.get("samplers") or [])

    @property
    def aggregators(self) -> list[str]:
        return list(self.pipeline.get("aggregators") or [])

    @property
    def caption_modes(self) -> list[str]:
        return list(self.pipeline.get("caption_modes") or [])
