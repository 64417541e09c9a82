"""Configuration: typed settings from text, model tiers and the map of steps to tiers."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, fields

#: Steps with their tiers, and tiers with their answer sizes. Fixed values.
DEFAULT_TIERS = {
    "landscapeScan": "cheap", "riskMap": "base", "reviewLogic": "frontier", "reviewRisk": "frontier",
    "reviewConsistency": "base", "consensus": "frontier", "coveVerify": "base", "report": "base",
}
MAX_TOKENS = {"cheap": 2048, "base": 4096, "frontier": 8192, "embedding": 8192}
TIERS = ("cheap", "base", "frontier", "embedding")


@dataclass(frozen=True)
class Settings:
    """S8. Numbers have to be positive; text of a boolean is read as such."""

    max_llm_calls: int = 25
    max_cost_usd: float = 0.5
    max_verified: int = 5
    embedding_dim: int = 1536
    port: int = 3000
    log_level: str = "info"
    enable_cove: bool = True
    enable_triple_review: bool = True

    @classmethod
    def of(cls, env: Mapping[str, str]) -> Settings:
        found: dict = {}
        for f in fields(cls):
            raw = env.get(f.name.upper())
            if raw is None or raw == "":
                continue
            kind = type(f.default)
            if kind is bool:
                if raw.strip().lower() not in ("true", "false", "1", "0", "yes", "no"):
                    raise ValueError(f"{f.name.upper()}: no boolean: {raw!r}")
                found[f.name] = raw.strip().lower() in ("true", "1", "yes")
            else:
                found[f.name] = kind(raw)
                if kind in (int, float) and not found[f.name] > 0:
                    raise ValueError(f"{f.name.upper()} has to be positive")
        if found.get("log_level", "info") not in ("debug", "info", "warn", "error"):
            raise ValueError("LOG_LEVEL: unknown level")
        return cls(**found)


def parse_model_map(text: str | None) -> dict[str, str]:
    """K9: steps to tiers; unknown steps and tiers go, what is missing or unreadable is the default."""
    try:
        given = json.loads(text) if text else {}
    except ValueError:
        given = {}
    if not isinstance(given, dict):
        given = {}
    return DEFAULT_TIERS | {k: v for k, v in given.items() if k in DEFAULT_TIERS and v in TIERS}


def max_tokens(tier: str) -> int:
    """K10."""
    return MAX_TOKENS[tier]


def model_name(tier: str, names: Mapping[str, str]) -> str:
    """The configured model of a tier, else that of the base tier."""
    return names.get(tier) or names["base"]
