"""All registered queries of the library, by name, with the SQL that checks them."""

from __future__ import annotations

FLAGSHIP = "worst_of_verdict"
_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its own name."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    from tidemark.plans import areas, briefs, checks, matches, pages, scalars, services, waters  # noqa: F401

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
