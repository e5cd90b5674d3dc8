"""All queries of the library with their oracle SQL."""

from __future__ import annotations

from actlens.plans import features, models, runs, texts


def queries() -> dict:
    return {**features.QUERIES, **models.QUERIES, **runs.QUERIES, **texts.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**features.SQL, **models.SQL, **runs.SQL, **texts.SQL}
