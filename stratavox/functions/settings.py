"""Layered settings: defaults, then a TOML file, then environment variables, then the session's own."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from typing import Any

from pyspark.sql import SparkSession


def _typed(name: str, text: str, default: Any) -> Any:
    if isinstance(default, bool):
        if text.lower() not in ("true", "false", "1", "0"):
            raise ValueError(f"{name} is no boolean: {text}")
        return text.lower() in ("true", "1")
    return type(default)(text)


def load(defaults: Mapping[str, Any], toml: str = "", env: Mapping[str, str] = os.environ, prefix: str = "STRATAVOX_", spark: SparkSession | None = None) -> dict[str, Any]:
    """Settings of the names and types of `defaults`; a name that isn't among them, or a value of another type, is an error."""
    out = dict(defaults)
    for name, value in tomllib.loads(toml).items():
        if name not in defaults:
            raise ValueError(f"unknown setting {name}")
        if type(value) is not type(defaults[name]):
            raise ValueError(f"{name} must be {type(defaults[name]).__name__}")
        out[name] = value
    for name, default in defaults.items():
        if (text := env.get(prefix + name.upper())) is not None:
            out[name] = _typed(name, text, default)
        if spark is not None and (text := spark.conf.get(f"stratavox.{name}", None)) is not None:
            out[name] = _typed(name, text, default)
    return out


def credentials(text: str) -> dict[str, str]:
    """Key ids and secrets of "id:secret,id:secret"; a secret may hold colons."""
    pairs = [p.strip().partition(":") for p in text.split(",") if p.strip()]
    if bad := [p[0] for p in pairs if not p[0] or not p[2]]:
        raise ValueError(f"no secret or id: {bad[0]}")
    return {p[0]: p[2] for p in pairs}
