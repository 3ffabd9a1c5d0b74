"""Catalog of named queries with their SQL checks."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from caregap.plans.fixtures import Fixtures
from caregap.plans.oracle_tables import TABLES
from caregap.session import apply_defaults


@dataclass(frozen=True)
class Entry:
    build: Callable[[Fixtures], DataFrame]
    sql: str | None


CATALOG: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Fixtures], DataFrame]):
        if name in CATALOG:
            raise ValueError(f"query {name} is registered twice")
        CATALOG[name] = Entry(build, sql)
        return build

    return register


def runner(entry: Entry) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: entry.build(Fixtures(apply_defaults(spark), sf_dir))


def with_tables(sql: str) -> str:
    """Prefix a check with the fixture tables it uses, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"\b\w+\b", text)):
            if word in TABLES and word not in needed:
                visit_name(word)

    def visit_name(name: str) -> None:
        needed.append(name)
        visit(TABLES[name])

    visit(sql)
    ordered = [n for n in TABLES if n in needed]
    if not ordered:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({TABLES[n]})" for n in ordered) + "\n" + sql
