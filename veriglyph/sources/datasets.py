"""JSON and Parquet datasets, configuration files and sinks."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields whose values may be text, number, boolean or list are read as text.
CALIBRATION = "identifier string, label string, malicious string, attack string, target string, protect string, weight string"
DRIFT = "identifier string, target string, protect string"


class DatasetError(ValueError):
    """A dataset that can't be used, with a message for people."""


def read_rows(spark: SparkSession, path: str, schema: str | None = None, what: str = "Dataset") -> DataFrame:
    """A JSON array's or a Parquet table's rows; an empty one is an error."""
    if path.endswith(".parquet"):
        rows = spark.read.parquet(path)
    else:
        text = spark.read.text(path).select(F.regexp_extract("value", r"^\s*(\S)", 1).alias("c")).filter("c <> ''").first()
        if text is None or text[0] != "[":
            raise DatasetError(f"{what} must be a JSON array.")
        reader = spark.read.option("multiLine", True).option("mode", "FAILFAST").option("prefersDecimal", False)
        rows = (reader.schema(schema) if schema else reader).json(path)
    if rows.isEmpty():
        raise DatasetError(f"{what} is empty.")
    return rows


def load_config(path: str | None, default: str = "veriglyph.config.json") -> dict:
    """Reserved names, pattern and sources; a missing explicit file is an error."""
    p = Path(path or default)
    if not p.exists():
        if path:
            raise DatasetError(f"Config file not found: {path}")
        return {}
    try:
        return json.loads(p.read_text())
    except json.JSONDecodeError as e:
        raise DatasetError(f"Failed to parse config file: {p}") from e


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    """Parquet or JSON files."""
    df.write.mode(mode).format(kind).save(path)


def write_tables(spark: SparkSession, folder: str, kind: str = "parquet") -> None:
    """The lookup tables as files."""
    from ..functions import tables

    for name, df in (("full_map", tables.map_frame(spark)), ("filtered_map", tables.map_frame(spark, tables.filtered(tables.full_map()))), ("weights", tables.weights(spark)), ("lookalikes", tables.lookalikes(spark)), ("vectors", tables.composability_vectors(spark))):
        write(df.coalesce(1), f"{folder}/{name}", kind, "overwrite")
