"""Settings of search, frozen on the driver: executors never read the environment."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

# Hybrid weights (vector, lexical) by content mode, and score factors by chunk type and content mode.
WEIGHTS = {"code": (0.65, 0.35), "docs": (0.7, 0.3), "all": (0.5, 0.5)}
EXPLICIT_CODE_WEIGHTS = (0.35, 0.65)
TYPE_BOOSTS = {
    "code": {
        "function": 1.3,
        "method": 1.3,
        "class": 1.3,
        "decorated_definition": 1.3,
        "let": 1.3,
        "binding": 1.3,
        "option": 1.3,
        "service_config": 1.3,
        "imports": 1.1,
        "section": 0.7,
        "document": 0.7,
        "module": 0.9,
    },
    "docs": {
        "function": 0.8,
        "method": 0.8,
        "class": 0.8,
        "decorated_definition": 0.8,
        "section": 1.3,
        "document": 1.3,
        "module": 0.9,
    },
    "all": {},
}


def parse_int(value: str | None, default: int, low: int | None = None, high: int | None = None) -> int:
    """value as an integer within [low, high], else default."""
    try:
        n = int((value or "").strip())
    except ValueError:
        return default
    return n if (low is None or n >= low) and (high is None or n <= high) else default


def parse_float(value: str | None, default: float | None, low: float | None = None, high: float | None = None) -> float | None:
    """value as a finite number within [low, high], else default."""
    try:
        x = float((value or "").strip())
    except ValueError:
        return default
    return x if x == x and abs(x) != float("inf") and (low is None or x >= low) and (high is None or x <= high) else default


def parse_bool(value: str | None, default: bool) -> bool:
    word = (value or "").strip().lower()
    return True if word in ("1", "true", "yes", "on") else False if word in ("0", "false", "no", "off") else default


def parse_choice(value: str | None, default: str, choices: tuple[str, ...]) -> str:
    word = (value or "").strip().lower()
    return word if word in choices else default


def parse_boosts(value: str | None) -> dict[str, float]:
    """A JSON object of chunk types and factors; entries before one that is no number count, anything else gives none."""
    out: dict[str, float] = {}
    try:
        for kind, factor in dict(json.loads(value or "{}")).items():
            out[str(kind)] = float(factor)
    except (ValueError, TypeError):
        pass
    return out


@dataclass(frozen=True)
class SearchConfig:
    content_mode: str = "code"
    rrf_k: int = 20
    vector_weight: float = 0.0
    lexical_weight: float = 0.0
    name_weight: float = 5.0
    over_fetch: int = 3
    rerank_mode: str = "off"
    rerank_pool: int = 15
    confident: float | None = None
    ppr_alpha: float = 0.0
    stale_advisory: float = 0.25
    stale_compact: float = 0.5
    max_age_minutes: float = 5.0
    #: Whether hybrid search reads what a query names outright (identifiers, paths), or takes every query by all its words.
    signals: bool = True
    type_boosts: Mapping[str, float] = field(default_factory=dict)

    def weights(self, explicit: bool = False) -> tuple[float, float]:
        """(vector, lexical): a weight above 0 overrides, and the other is then 0.5 where it is not set; else the mode's own, which
        explicit code queries turn round."""
        if self.vector_weight > 0 or self.lexical_weight > 0:
            return (self.vector_weight or 0.5, self.lexical_weight or 0.5)
        return EXPLICIT_CODE_WEIGHTS if explicit and self.content_mode == "code" else WEIGHTS.get(self.content_mode, (0.5, 0.5))

    def boosts(self) -> dict[str, float]:
        return dict(TYPE_BOOSTS.get(self.content_mode, {})) | dict(self.type_boosts)


def from_env(get: Callable[[str], str | None] = os.environ.get, prefix: str = "RANKLOOM_") -> SearchConfig:
    """Settings from variables; unusable values fall back to the defaults."""
    d = SearchConfig()
    return SearchConfig(
        parse_choice(get(prefix + "CONTENT_MODE"), d.content_mode, tuple(WEIGHTS)), parse_int(get(prefix + "RRF_K"), d.rrf_k, 1, 1000), parse_float(get(prefix + "VECTOR_WEIGHT"), 0.0, 0), parse_float(get(prefix + "LEXICAL_WEIGHT"), 0.0, 0),
        parse_float(get(prefix + "NAME_WEIGHT"), d.name_weight, 0), parse_int(get(prefix + "OVER_FETCH"), d.over_fetch, 1, 100), parse_choice(get(prefix + "RERANK"), d.rerank_mode, ("off", "pointwise", "listwise", "cross_encoder")), parse_int(get(prefix + "RERANK_POOL"), d.rerank_pool, 1, 100), parse_float(get(prefix + "CONFIDENT"), None, 0), parse_float(get(prefix + "PPR_ALPHA"), d.ppr_alpha, 0), type_boosts=parse_boosts(get(prefix + "TYPE_BOOSTS")),
    )
