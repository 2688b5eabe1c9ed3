"""All registered queries and their SQL twins."""

from importlib import import_module

_GROUPS = ["message", "conversation", "scoring", "learning"]


def _merge(kind: str, attribute: str) -> dict:
    merged = {}
    for group in _GROUPS:
        part = getattr(import_module(f"riskloom.plans.{group}_{kind}"), attribute)
        clash = merged.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        merged.update(part)
    return merged


def queries() -> dict:
    return _merge("queries", "QUERIES")


def oracle_sql() -> dict:
    return _merge("sql", "SQL")
