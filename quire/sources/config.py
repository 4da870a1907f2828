"""Settings from a TOML file: dotted names, found by environment, working folder, then a given root."""

from __future__ import annotations

import os
import tomllib
from pathlib import Path


class Config:
    def __init__(self, values: dict, required: tuple[str, ...] = ()):
        lacking = [s for s in required if s not in values]
        if lacking:
            raise ValueError(f"missing sections: {', '.join(lacking)}")
        self.values = values

    @classmethod
    def find(cls, env: str = "QUIRE_CONFIG", root: str | None = None, name: str = "config.toml", required: tuple[str, ...] = ()) -> "Config":
        for p in (os.environ.get(env), Path.cwd() / name, Path(root) / name if root else None):
            if p and Path(p).is_file():
                return cls(tomllib.loads(Path(p).read_text("utf-8")), required)
        raise FileNotFoundError(name)

    def get(self, dotted: str, default=None):
        at = self.values
        for part in dotted.split("."):
            if not isinstance(at, dict) or part not in at:
                return default
            at = at[part]
        return at
