"""Engine settings; wrong numbers fall back to defaults, wrong choices are errors."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from datetime import datetime, timezone


def number(value: str | None, default: float) -> float:
    try:
        out = float(value) if value not in (None, "") else default
    except ValueError:
        return default
    return out if out == out and abs(out) != float("inf") else default


def flag(value: str | None, default: bool) -> bool:
    return default if value is None else value in ("true", "1")


def choice(value: str | None, allowed: tuple[str, ...], default: str) -> str:
    if value in (None, ""):
        return default
    if value not in allowed:
        raise ValueError(f"{value!r} is none of {', '.join(allowed)}")
    return value


@dataclass(frozen=True)
class EngineConfig:
    """What operators take as parameters. current_year is set, not read from the clock inside a query."""

    worker_concurrency: int = 4
    browser_pool_size: int = 4
    max_pages_per_domain: int = 6
    per_host_delay_ms: int = 1500
    request_timeout_ms: int = 20_000
    browser_timeout_ms: int = 30_000
    max_body_bytes: int = 5 * 1024 * 1024
    tier1_alarm_ratio: float = 0.25
    tier1_min_samples: int = 40
    tier1_window_ms: int = 300_000
    breaker_threshold: int = 4
    breaker_cooldown_ms: int = 300_000
    allow_personal_emails: bool = False
    user_agent: str = "leadspark"
    plan_model: str = "stub"
    current_year: int = datetime.now(timezone.utc).year

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> EngineConfig:
        """Each setting from the variable of its name in capitals."""
        env = os.environ if env is None else env
        out = {}
        for f in fields(cls):
            raw, default = env.get(f.name.upper()), f.default
            if isinstance(default, bool):
                out[f.name] = flag(raw, default)
            elif isinstance(default, (int, float)):
                out[f.name] = type(default)(number(raw, default))
            else:
                out[f.name] = raw or default
        return cls(**out)
