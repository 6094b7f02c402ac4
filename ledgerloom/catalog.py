"""All queries of the library with the SQL that an independent engine checks them by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.plans import cells, closing, decisions, decks, enrichment, evidence, gates, harvest, ordered, readings, reconcile, records, registry, reviews, scalars, sheets, spatial, trackers  # noqa: F401  (they register their queries)

FLAGSHIP = "precedence_merge"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLE)
