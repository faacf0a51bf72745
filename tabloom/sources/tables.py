"""Table sources and sinks: CSV with many null tokens, Parquet, and columns without values."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text that stands for no value unless told otherwise.
NULL_TOKENS = ("", "NA", "N/A", "NaN", "nan", "NULL", "null", "None", "n/a", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>")


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that all executors share; a local one only where none is named and Spark is local."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{shared or tempfile.mkdtemp()}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """The rows, computed once and written in the shared folder, so that lost executors do not take them along."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_csv(spark: SparkSession, path: str, null_values: tuple[str, ...] = (), encoding: str = "UTF-8", schema: T.StructType | None = None) -> DataFrame:
    """Read a CSV with a header, leading blanks cut off and all null tokens made null.

    Read once as text; with ``schema`` the columns are cast to it, else each column becomes bigint or
    double where all its values are such numbers, found by one aggregation. ``encoding`` is stated,
    not tried out (ISO-8859-1 for old files).
    """
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("encoding", encoding).csv(path)
    tokens = [*NULL_TOKENS, *null_values]
    text = raw.select(*[F.when(F.col(f"`{c}`").isin(tokens), None).otherwise(F.col(f"`{c}`")).alias(c) for c in raw.columns])
    if schema is not None:
        return text.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema])
    checks = []
    for k, c in enumerate(text.columns):
        x = F.col(f"`{c}`")
        checks += [F.count(x).alias(f"n{k}"), F.count(x.try_cast("bigint")).alias(f"i{k}"), F.count(x.try_cast("double")).alias(f"d{k}")]
    found = text.agg(*checks).first()
    kinds = ["bigint" if n and found[f"i{k}"] == n else "double" if n and found[f"d{k}"] == n else "string" for k in range(len(text.columns)) for n in [found[f"n{k}"]]]
    return text.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c, kind in zip(text.columns, kinds, strict=True)])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def empty_columns(df: DataFrame) -> list[str]:
    """Columns without a value, by one aggregation."""
    found = df.agg(*[F.count(F.col(f"`{c}`")).alias(str(k)) for k, c in enumerate(df.columns)]).first()
    return [c for k, c in enumerate(df.columns) if not found[str(k)]]


def drop_empty_columns(df: DataFrame) -> DataFrame:
    return df.drop(*empty_columns(df))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_domains(path: str) -> dict[str, list]:
    """Declared categories by column, from a JSON file."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def preview(df: DataFrame, key: str, rows: int = 100) -> DataFrame:
    """The first rows by a key, as JSON text."""
    return df.orderBy(key).limit(rows).select(key, F.to_json(F.struct(*df.columns)).alias("record"))
