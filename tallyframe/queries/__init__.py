"""All registered queries by topic."""

from __future__ import annotations

import importlib

TOPICS = ["classify", "rank", "places", "chat", "clips", "speech", "scoring", "scored", "lines", "upkeep", "recipes"]


def load():
    """(name to Spark function, name to SQL)"""
    for topic in TOPICS:
        importlib.import_module(f"tallyframe.queries.{topic}")
    from tallyframe.queries.base import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
