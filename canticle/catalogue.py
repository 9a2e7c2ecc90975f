"""The registered queries and their SQL twins."""

from __future__ import annotations

from canticle.plans import REGISTRY, SQL
from canticle.plans import alignment, files, formats, jobs, kernels, library, lyrics, matching, resolve, scalars, signal, streams, words  # noqa: F401  registers their queries


def queries() -> dict:
    return dict(REGISTRY)


def oracle_sql() -> dict:
    return dict(SQL)
