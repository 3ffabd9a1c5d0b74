"""All registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caregap.plans import (  # noqa: F401
    catalog_batch,
    catalog_clean,
    catalog_core,
    catalog_ml,
    catalog_review,
    catalog_sinks,
    catalog_validation,
)
from caregap.plans.registry import CATALOG, runner, with_tables


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: runner(entry) for name, entry in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_tables(entry.sql) for name, entry in CATALOG.items() if entry.sql}
