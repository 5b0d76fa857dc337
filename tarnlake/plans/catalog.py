"""All queries of the engine proper with their SQL."""

from __future__ import annotations

from tarnlake.plans import dialogues, listings, readings, retrieval, streams, texts, upkeep

ENTRIES = {k: v for m in (readings, retrieval, listings, texts, dialogues, upkeep, streams) for k, v in m.ENTRIES.items()}


def queries() -> dict:
    return {name: fn for name, (fn, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ENTRIES.items() if sql}
