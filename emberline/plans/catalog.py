"""The engine's queries, by name."""

from __future__ import annotations

from emberline.plans import corpus, files_and_names, graphs, history
from emberline.plans.registry import ORACLES, QUERIES

MODULES = (files_and_names, graphs, history, corpus)


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)
