"""Import every query module so that the catalog is complete, then hand it out."""

from __future__ import annotations

from . import catalog
from . import q_discover, q_job, q_outputs, q_query, q_transform, q_validate  # noqa: F401  (register queries)


def queries():
    return dict(catalog.QUERIES)


def oracle_sql():
    return dict(catalog.ORACLE)
