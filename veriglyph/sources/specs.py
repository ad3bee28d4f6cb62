"""Sources of taken identifiers: any DataFrame, table or JDBC query, seen as (value, id)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAFE = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


def safe_name(name: str, kind: str) -> str:
    """Table and column names must be plain identifiers."""
    for part in name.split("."):
        if not SAFE.match(part):
            raise ValueError(f"Unsafe {kind}: {name!r}")
    return name


@dataclass(frozen=True)
class Source:
    """``column`` of a frame holds taken values; a row belongs to who has its ``id_column``'s value in the scope's ``scope_key``.

    ``case_insensitive``: None takes the guard's setting. ``collation`` UTF8_LCASE compares without case but with accents.
    """

    name: str
    frame: DataFrame
    column: str
    id_column: str = "id"
    scope_key: str | None = None
    case_insensitive: bool | None = None
    collation: str | None = None

    def __post_init__(self):
        if self.collation not in (None, "UTF8_BINARY", "UTF8_LCASE"):
            raise ValueError(f"Unknown collation: {self.collation}")
        for c in (self.column, *([self.id_column] if self.scope_key else [])):
            if c not in self.frame.columns:
                raise ValueError(f"Source {self.name!r} has no column {c!r}")

    def key(self, value: Column, insensitive: bool) -> Column:
        if self.collation == "UTF8_LCASE":
            return F.lower(value)
        return F.lower(value) if (insensitive if self.case_insensitive is None else self.case_insensitive) else value

    def taken(self, insensitive: bool) -> DataFrame:
        """(key, owner): of several rows of a value, the one of smallest id."""
        owner = F.col(self.id_column).cast("string") if self.id_column in self.frame.columns else F.lit(None).cast("string")
        rows = self.frame.select(self.key(F.col(self.column).cast("string"), insensitive).alias("key"), owner.alias("owner")).filter("key is not null")
        return rows.groupBy("key").agg(F.min("owner").alias("owner"))


def table_source(spark: SparkSession, table: str, column: str, **more) -> Source:
    """A catalog table, under the same rule for names as raw SQL."""
    safe_name(table, "table name"), safe_name(column, "column name")
    return Source(more.pop("name", table), spark.table(table), column, **more)


def jdbc_source(spark: SparkSession, url: str, table: str, column: str, properties: dict | None = None, **more) -> Source:
    """A database's table. Its two columns are pushed down, its rows are read whole, in one task unless ``properties`` part them."""
    safe_name(table, "table name"), safe_name(column, "column name")
    return Source(more.pop("name", table), spark.read.jdbc(url, table, properties=properties or {}), column, **more)


def document_source(frame: DataFrame, name: str, column: str, **more) -> Source:
    """Document stores' default id, compared without case but with accents."""
    more = {"id_column": "_id" if "_id" in frame.columns else "id", "case_insensitive": True} | more
    return Source(name, frame, column, **more)


def registry(frames: dict[str, DataFrame], specs: list[dict]) -> list[Source]:
    """Sources by name out of registered frames; a missing one is an error, as with the object mappers."""
    out = []
    for spec in specs:
        if spec["name"] not in frames:
            raise ValueError(f"No table is registered for source {spec['name']!r}")
        out.append(Source(spec["name"], frames[spec["name"]], spec["column"], **{k: v for k, v in spec.items() if k not in ("name", "column")}))
    return out
