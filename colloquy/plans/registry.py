"""All registered queries over the reference's own operators, and their oracle SQL."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, query, oracle: str | None = None) -> None:
    """Add one query; ``oracle`` is DuckDB SQL for the same rows where SQL can express them."""
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = query
    if oracle is not None:
        ORACLES[name] = oracle


from . import assembly, bindings, evaluation, lifecycle, live, meetings, recognition, scoring, search, texts, timelines, voiceprints, whole_files  # noqa: E402,F401
