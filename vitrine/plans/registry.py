"""Registered queries over the driver's tables, their SQL twins, and the stand-in views that both engines read."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TABLES = frozenset("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())

#: Stand-in tables: statements over the given tables and over each other, in words that both engines understand.
VIEWS: dict[str, str] = {}
#: The same rows in a form that Spark shuffles less for.
LEAN: dict[str, str] = {}


def _read_by(text: str) -> list[str]:
    """The tables and views that a statement reads."""
    return [n for n in dict.fromkeys(re.findall(r"\b(?:from|join) (\w+)", text)) if n in TABLES or n in VIEWS]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in table. Its statement runs over the readers of what it reads, so nothing is registered in the session."""
    text = LEAN.get(name, VIEWS[name])
    plain = text.replace("{", "{{").replace("}", "}}")
    read = {n: view(spark, sf_dir, n) if n in VIEWS else table(spark, sf_dir, n) for n in _read_by(text)}
    return spark.sql(re.sub(r"\b(from|join) (\w+)", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in read else m[0], plain), **read)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _closure(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for n in names:
        out += [m for m in (*_closure(tuple(v for v in _read_by(VIEWS[n]) if v in VIEWS)), n) if m not in out]
    return out


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Registers a query and, if there is one, its DuckDB twin: ``sql`` (a select, or CTEs and a select; ``recursive`` in
    front if one is) behind the views that it reads."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            body = sql.strip()
            recursive = body.startswith("recursive ")
            body = body.removeprefix("recursive ")
            ctes = ", ".join(f"{v} as ({VIEWS[v]})" for v in _closure(views))
            parts = [ctes] if ctes else []
            if not body.startswith("select"):
                parts.append(body)
            head = ("with recursive " if recursive else "with ") + ", ".join(parts) if parts else ""
            ORACLE_SQL[name] = head + (" " if head else "") + (body if body.startswith("select") else "")
        return f

    return add
