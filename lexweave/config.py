"""Settings from YAML with access by attribute, key and default."""

from __future__ import annotations

from pathlib import Path
from typing import Any


class Config:
    def __init__(self, values: dict[str, Any]):
        self._values = values

    def __getattr__(self, name: str) -> Any:
        try:
            return self[name]
        except KeyError:
            raise AttributeError(name) from None

    def __getitem__(self, name: str) -> Any:
        value = self._values[name]
        return Config(value) if isinstance(value, dict) else value

    def get(self, name: str, default: Any = None) -> Any:
        return self[name] if name in self._values else default


def load_config(path: str | Path) -> Config:
    """Read a YAML mapping; a missing file or another kind of document raises."""
    import yaml

    with open(path, encoding="utf-8") as f:
        values = yaml.safe_load(f) or {}
    if not isinstance(values, dict):
        raise ValueError(f"{path} does not hold a mapping")
    return Config(values)
