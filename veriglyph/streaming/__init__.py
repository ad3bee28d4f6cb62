"""Streams of texts and identifiers: the same column functions over unbounded frames.

The library that inspired these operators has no streams; this is an extension.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.guard import NameGuard
from ..operators.preprocess import ScanOptions, canonicalise, scan


def clean_stream(texts: DataFrame, column: str = "text", options: ScanOptions | None = None) -> DataFrame:
    """Each text with its canonical form and risk level; stateless."""
    return texts.withColumn("canonical", canonicalise(column, options)).withColumn("risk_level", scan(column, options)["risk_level"])


def open_names(ids: DataFrame, guard: NameGuard, column: str = "identifier") -> DataFrame:
    """Well-formed identifiers that are neither reserved nor in the sources as they are read: stream-static anti joins."""
    rows = ids.withColumn("normalized", guard.normalize(column)).filter(guard.format_message(F.col("normalized")).isNull())
    rows = rows.join(guard._reserved(), F.col("normalized") == F.col("name"), "left_anti")
    held = guard.taken().select(F.col("key").alias("key_"))
    return rows.join(held, F.col("normalized") == F.col("key_"), "left_anti")


def first_claims(ids: DataFrame, guard: NameGuard, column: str = "identifier", time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The first claimant of each free name; the state of a name is dropped ``late`` after its time."""
    return open_names(ids, guard, column).withWatermark(time, late).dropDuplicatesWithinWatermark(["normalized"])
