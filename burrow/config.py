"""Configuration of an index, from ``burrow.toml`` at the root of the tree."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from burrow.operators.discovery import Rule

NAME = "burrow.toml"
# Manifests and directories that are looked for or left out unless configured.
MANIFESTS = ("package.json", "go.mod", "go.work", "Cargo.toml", "pyproject.toml", "pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts", "cpanfile", "Gemfile")
EXCLUDED = ("node_modules", "vendor", "dist", ".build", "target", "third_party", ".burrow", ".gradle", "build")


@dataclass
class Config:
    db_path: str | None = None
    manifests: tuple[str, ...] = MANIFESTS
    exclude: tuple[str, ...] = EXCLUDED
    rules: list[Rule] = field(default_factory=list)
    overrides: list[tuple[str, str | None]] = field(default_factory=list)
    exclude_extensions: tuple[str, ...] = ()
    debounce_ms: int = 2000


def load(root: str) -> Config:
    """The configuration of a tree, or defaults; a file that can't be parsed is an error."""
    path = Path(root, NAME)
    return parse(path.read_text(encoding="utf-8")) if path.exists() else Config()


def parse(text: str) -> Config:
    data = tomllib.loads(text)
    found = data.get("discovery", {})
    rules = [Rule(r["name"], r["kind"], tuple(r["requires"]), tuple(r.get("paths", ())), tuple(r.get("exclude", ())), r.get("max_depth"), r.get("name_prefix"), tuple(r.get("extensions", ()))) for r in found.get("custom", ())]
    return Config(
        data.get("db_path"), tuple(found.get("manifests", MANIFESTS)), tuple(found.get("exclude", EXCLUDED)), rules,
        [(p["name"], p.get("description")) for p in data.get("packages", ())], tuple(data.get("symbols", {}).get("exclude_extensions", ())),
        data.get("watch", {}).get("debounce_ms", 2000),
    )
