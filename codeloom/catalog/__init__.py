"""Registered queries, grouped by subject."""

from codeloom.catalog import registry


def _load() -> None:
    from codeloom.catalog import code, dependencies, files, graphs, texts, vectors  # noqa: F401


def queries():
    _load()
    return dict(registry.QUERIES)


def oracle_sql():
    _load()
    return dict(registry.ORACLES)
