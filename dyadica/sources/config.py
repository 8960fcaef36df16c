"""Run configurations: YAML or JSON files read strictly, on the driver."""

from __future__ import annotations

import json
from dataclasses import MISSING, fields
from pathlib import Path


def deep_get(config: dict, path: str, default=None):
    """The value at a dotted path, or the default where a part is missing."""
    for part in path.split("."):
        if not isinstance(config, dict) or part not in config:
            return default
        config = config[part]
    return config


def reject_unknown(config: dict, allowed: set[str], where: str = "configuration") -> dict:
    """The configuration itself, or an error that names the keys that nobody reads."""
    if unknown := sorted(set(config) - allowed):
        raise ValueError(f"unknown keys in {where}: {unknown}")
    return config


def read_config(path: str) -> dict:
    """A mapping from a YAML or JSON file."""
    text = Path(path).read_text()
    if path.endswith(".json"):
        value = json.loads(text)
    else:
        import yaml

        value = yaml.safe_load(text)
    if not isinstance(value, dict):
        raise ValueError(f"{path} holds no mapping")
    return value


def load_as(cls, config: dict, where: str = "configuration"):
    """A dataclass from a mapping: unknown and missing keys are errors."""
    names = {f.name for f in fields(cls)}
    reject_unknown(config, names, where)
    needed = {f.name for f in fields(cls) if f.default is MISSING and f.default_factory is MISSING}
    if missing := sorted(needed - set(config)):
        raise ValueError(f"missing keys in {where}: {missing}")
    return cls(**config)


def apply_design(arguments: dict, lock: dict) -> dict:
    """Run arguments with the factors of a frozen design; an argument that contradicts it is an error."""
    out = dict(arguments)
    for key, value in lock["factors"].items():
        if out.get(key) not in (None, value):
            raise ValueError(f"{key} contradicts the frozen design")
        out[key] = value
    return out | {"design_id": lock["design_id"]}
