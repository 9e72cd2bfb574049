"""Settings of a scan from a small subset of YAML: top-level scalars, lists of scalars, maps of one level."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from typing import Any

from .rules import LEVELS

FILE_NAME = ".vigilspark.yml"
SCAN_TYPES = ("secrets", "llm", "devsecops", "all")
_KEY = re.compile(r"([A-Za-z_]\w*)\s*:\s*(.*)", re.A)
_ITEM = re.compile(r"\s+-\s+(.+)")
_PAIR = re.compile(r"\s+([A-Za-z_]\w*|\"[^\"]*\"|'[^']*')\s*:\s*(.*)", re.A)
_WORDS = {"null": None, "Null": None, "NULL": None, "~": None, "": None} | dict.fromkeys(("true", "True", "yes", "Yes"), True) | dict.fromkeys(("false", "False", "no", "No"), False)


@dataclass
class Entropy:
    enabled: bool = False
    threshold: float = 4.5
    min_length: int = 20


@dataclass
class Config:
    version: int = 1
    exclude_paths: list[str] = field(default_factory=list)
    exclude_patterns: list[str] = field(default_factory=list)
    severity_threshold: str | None = None
    scan_types: list[str] = field(default_factory=lambda: ["secrets"])
    custom_patterns: dict[str, str] = field(default_factory=dict)
    entropy: Entropy = field(default_factory=Entropy)


def _unquoted(text: str) -> str:
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'" else text


def scalar(text: str) -> Any:
    if text in _WORDS:
        return _WORDS[text]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return _unquoted(text)


def parse(text: str) -> dict[str, Any]:
    """Lines that fit nowhere are passed over. A key with no value takes the lines below it: a list, else a map, else null."""
    out: dict[str, Any] = {}
    under: str | None = None
    items: list = []
    pairs: dict = {}

    def close() -> None:
        if under is not None:
            out[under] = items or pairs or None

    for raw in text.splitlines():
        line = raw.rstrip()
        if under is not None:
            if not line:
                continue
            if m := _ITEM.match(line):
                items.append(scalar(m[1].strip()))
                continue
            if m := _PAIR.match(line):
                pairs[_unquoted(m[1])] = scalar(m[2].strip())
                continue
            close()
            under = None
        if (m := _KEY.match(line)) and m[2].strip():
            out[m[1]] = scalar(m[2].strip())
        elif m:
            under, items, pairs = m[1], [], {}
    close()
    return out


def normalized(raw: Any) -> Config:
    """A Config with what is valid in raw, and defaults for the rest."""
    config = Config()
    if not isinstance(raw, dict):
        return config
    for key in ("exclude_paths", "exclude_patterns"):
        if isinstance(raw.get(key), list):
            setattr(config, key, [str(x) for x in raw[key]])
    if isinstance(level := raw.get("severity_threshold"), str) and level.upper() in LEVELS:
        config.severity_threshold = level.upper()
    if isinstance(kinds := raw.get("scan_types"), list):
        config.scan_types = [str(k) for k in kinds if str(k) in SCAN_TYPES] or config.scan_types
    if isinstance(custom := raw.get("custom_patterns"), dict):
        config.custom_patterns = {str(k): str(v) for k, v in custom.items()}
    if isinstance(own := raw.get("entropy"), dict):
        if isinstance(own.get("enabled"), bool):
            config.entropy.enabled = own["enabled"]
        if isinstance(own.get("threshold"), (int, float)):
            config.entropy.threshold = float(own["threshold"])
        if isinstance(own.get("min_length"), int):
            config.entropy.min_length = own["min_length"]
    return config


def find(root: str | None = None) -> str | None:
    """In the folder that is scanned, else in the current one."""
    return next((p for d in (root, os.getcwd()) if d and os.path.isfile(p := os.path.join(d, FILE_NAME))), None)


def load(path: str | None = None, root: str | None = None) -> Config:
    """Defaults where there is no file, or none that can be read."""
    path = path or find(root)
    if path is None:
        return Config()
    try:
        with open(path, encoding="utf-8") as f:
            return normalized(parse(f.read()))
    except (OSError, ValueError):
        return Config()
