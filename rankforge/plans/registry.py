"""All registered queries of the library proper, by name, with their SQL twins."""

from __future__ import annotations

from rankforge.plans import audits, base, extras, io, metrics, tables, vectors  # noqa: F401

FLAGSHIP = "flagship_context_auprc"


def queries() -> dict[str, base.Query]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
