"""Settings with their bounds."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from math import floor, isfinite

# Bounds and choices of settings.
BOUNDS = {"sync_budget": (128, 8192), "default_budget": (256, 16000), "search_budget": (256, 8192), "steer_threshold": (0.02, 8.0)}
CHOICES = {"sync_mode": ("enabled", "hidden", "disabled"), "sync_scope": ("session", "repository"), "search_mode": ("off", "replace", "augment")}


@dataclass(frozen=True)
class Config:
    sync_mode: str = "enabled"
    sync_scope: str = "session"
    sync_budget: int = 512
    ack_clean: bool = False
    steer_threshold: float = 0.15
    push_focus: bool = True
    default_budget: int = 512
    search_mode: str = "augment"
    search_budget: int = 512


_KEYS = {
    ("sync", "mode"): "sync_mode", ("sync", "scope"): "sync_scope", ("sync", "budget"): "sync_budget", ("sync", "ackClean"): "ack_clean", ("sync", "steerThreshold"): "steer_threshold", ("sync", "pushFocus"): "push_focus",
    ("tools", "defaultBudget"): "default_budget", ("tools", "grepMode"): "search_mode", ("tools", "grepAugmentBudget"): "search_budget",
}


def _value(name: str, given, old):
    if name in CHOICES:
        return given if given in CHOICES[name] else old
    if isinstance(old, bool):
        return given if isinstance(given, bool) else old
    if isinstance(given, bool) or not isinstance(given, int | float) or not isfinite(given):
        return old
    low, high = BOUNDS[name]
    return min(high, max(low, given if name == "steer_threshold" else floor(given + 0.5)))


def applied(base: Config, document: str | dict | None) -> Config:
    """base with what a document sets; what isn't valid leaves the old value, numbers are clamped to their bounds."""
    try:
        doc = json.loads(document) if isinstance(document, str) else document
    except ValueError:
        return base
    if not isinstance(doc, dict):
        return base
    part = lambda k: doc[k] if isinstance(doc.get(k), dict) else {}
    new = {name: _value(name, part(a)[b], getattr(base, name)) for (a, b), name in _KEYS.items() if b in part(a)}
    if "mode" not in part("sync") and isinstance(part("sync").get("enabled"), bool):  # an older form
        new["sync_mode"] = "enabled" if part("sync")["enabled"] else "disabled"
    return replace(base, **new)
