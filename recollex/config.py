"""Settings of models: explicit values, then the environment, then defaults."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


def resolved(value: str | None, environment: Mapping[str, str] = os.environ) -> str | None:
    """A secret as given, or the variable that env:NAME names; None if that is unset or empty."""
    if value is None or not value.startswith("env:"):
        return value
    return environment.get(value.removeprefix("env:")) or None


@dataclass(frozen=True)
class Settings:
    embedding_base: str | None = None
    embedding_model: str | None = None
    embedding_dim: int = 384
    embedding_key: str | None = None
    judge_provider: str | None = None
    judge_model: str | None = None
    judge_base: str | None = None
    judge_temperature: float = 0.0

    @classmethod
    def load(cls, explicit: Mapping[str, object] | None = None, environment: Mapping[str, str] = os.environ, prefix: str = "RECOLLEX_") -> Settings:
        """Values by precedence; unknown names and values of a wrong type raise ValueError."""
        given = dict(explicit or {})
        known = {f.name: f for f in fields(cls)}
        if unknown := set(given) - set(known):
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        values = {}
        for name, f in known.items():
            value = given.get(name, environment.get(prefix + name.upper()))
            if value is None:
                continue
            kind = {"embedding_dim": int, "judge_temperature": float}.get(name, str)
            try:
                values[name] = kind(value)
            except (TypeError, ValueError):
                raise ValueError(f"{name} must be of type {kind.__name__}") from None
            if name == "embedding_key":
                values[name] = resolved(values[name], environment)
        made = cls(**values)
        if made.embedding_dim < 1 or not 0 <= made.judge_temperature <= 2:
            raise ValueError("embedding_dim must be positive, judge_temperature from 0 to 2")
        return made
