"""Settings from the environment: prefix ``COLLOQUY_``, ``__`` between nested names."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, is_dataclass
from functools import lru_cache


@dataclass(frozen=True)
class Limits:
    window_seconds: int = 60
    register: int = 5
    token: int = 10
    chat: int = 30
    stream: int = 15


@dataclass(frozen=True)
class Quotas:
    window_seconds: int = 3600
    chat: int = 100
    stream: int = 50


@dataclass(frozen=True)
class Provider:
    name: str = "mock"
    base_url: str = ""


@dataclass(frozen=True)
class Settings:
    environment: str = "development"
    log_level: str = "INFO"
    max_body_bytes: int = 16_384
    max_retries: int = 1
    timeout_seconds: float = 10.0
    limits: Limits = field(default_factory=Limits)
    quotas: Quotas = field(default_factory=Quotas)
    provider: Provider = field(default_factory=Provider)
    token_secret: str = ""


def _filled(kind: type, values: dict[str, str], prefix: str):
    made = {}
    for f in fields(kind):
        default = f.default_factory() if callable(f.default_factory) else f.default
        name = f"{prefix}{f.name}".upper()
        if is_dataclass(default):
            made[f.name] = _filled(type(default), values, f"{name}__")
        elif name in values:
            made[f.name] = type(default)(values[name].strip())
        else:
            made[f.name] = default
        if isinstance(made[f.name], (int, float)) and (made[f.name] < 0 or made[f.name] == 0 and f.name != "max_retries"):
            raise ValueError(f"{name} must be positive")
    return kind(**made)


def settings_from(values: dict[str, str]) -> Settings:
    """Unknown keys are ignored; numbers must be positive; environment is lowered, log level raised."""
    upper = {k.upper(): v for k, v in values.items()}
    got = _filled(Settings, upper, "COLLOQUY_")
    got = Settings(**{f.name: getattr(got, f.name) for f in fields(got)} | {"environment": got.environment.lower(), "log_level": got.log_level.upper()})
    if got.environment not in {"development", "test", "staging", "production"}:
        raise ValueError("unknown environment")
    if got.log_level not in {"DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"}:
        raise ValueError("unknown log level")
    if got.environment == "production":
        for broken, why in ((not got.token_secret, "a token secret is needed"), (bool(got.provider.base_url) and got.provider.name != "mock" and not got.provider.base_url.startswith("https://"), "the provider's URL must be https")):
            if broken:
                raise ValueError(f"production: {why}")
    return got


@lru_cache
def settings() -> Settings:
    return settings_from(dict(os.environ))
