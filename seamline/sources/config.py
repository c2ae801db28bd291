"""Settings: defaults, then files, then the environment, each checked and kept in range."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, replace

from seamline.functions.scoring import BUDGETS


@dataclass(frozen=True)
class Settings:
    limit: int = 10
    ref: str = "live"
    max_file_bytes: int = 1 << 20
    semantic_mode: str = "off"
    semantic_ratio: float = 0.3
    confidence_threshold: float = 0.5
    policy_mode: str = "balanced"
    chunk_lines: int = 40
    chunk_overlap: int = 10
    budgets: dict = field(default_factory=lambda: dict(BUDGETS))


RANGES = {"limit": (1, 1000), "max_file_bytes": (1, 1 << 30), "semantic_ratio": (0.0, 1.0), "confidence_threshold": (0.0, 1.0), "chunk_lines": (1, 10_000), "chunk_overlap": (0, 10_000)}
CHOICES = {"semantic_mode": ("off", "hybrid", "rerank_only"), "policy_mode": ("off", "audit_only", "balanced", "strict")}


def normal_budget(value: tuple[float, float, float], standard: tuple[float, float, float], name: str) -> tuple[tuple[float, float, float], str | None]:
    """A budget's (least, most, default), and what was wrong with it: bounds that are no numbers or turned round give way to the standard ones."""
    low, high, default = value
    if not (math.isfinite(low) and math.isfinite(high)) or low > high:
        low, high, problem = standard[0], standard[1], f"{name}: invalid range"
    else:
        problem = None
    if not math.isfinite(default):
        default, problem = standard[2], problem or f"{name}: default isn't a number"
    fixed = min(max(default, low), high)
    return (low, high, fixed), problem or (f"{name}: default out of range" if fixed != default else None)


def load(*layers: dict, environment: dict[str, str] | None = None, prefix: str = "SEAMLINE_") -> tuple[Settings, list[str]]:
    """Settings of all layers, the last wins, and warnings. Environment names are prefix + NAME; values are JSON or plain text."""
    merged, warnings = {}, []
    for layer in layers:
        merged |= layer
    for key, value in (environment or {}).items():
        if key.startswith(prefix):
            try:
                merged[key[len(prefix) :].lower()] = json.loads(value)
            except ValueError:
                merged[key[len(prefix) :].lower()] = value
    settings = Settings()
    for key, value in merged.items():
        if key == "budgets":
            budgets = dict(BUDGETS)
            for name, budget in value.items():
                if name in budgets:
                    budgets[name], problem = normal_budget(tuple(budget), BUDGETS[name], name)
                    warnings += [problem] if problem else []
            settings = replace(settings, budgets=budgets)
        elif not hasattr(settings, key):
            warnings.append(f"unknown setting {key}")
        elif key in CHOICES and value not in CHOICES[key]:
            warnings.append(f"{key}: {value} is none of {', '.join(CHOICES[key])}")
        else:
            if key in RANGES:
                low, high = RANGES[key]
                if not isinstance(value, int | float) or isinstance(value, bool) or not math.isfinite(value):
                    warnings.append(f"{key}: {value} isn't a number")
                    continue
                kept = type(getattr(settings, key))(min(max(value, low), high))
                warnings += [f"{key}: {value} is out of range"] if kept != value else []
                value = kept
            settings = replace(settings, **{key: value})
    return settings, warnings
