"""Synthetic rows as a stream, and codes of a stream of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators import generate
from tabloom.operators.encode import encode
from tabloom.plans.model import TableModel


def row_numbers(spark: SparkSession, rows_per_second: int = 1000) -> DataFrame:
    """A stream of row numbers in ``id``."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().select(F.col("value").alias("id"))


def sample_stream(numbers: DataFrame, model: TableModel, n: int, mode: str = "independent", seed: object = 0) -> DataFrame:
    """Rows of a model for a stream of row numbers; the k-th row is that of the table with the same seed."""
    made = {"random": generate.random_mode, "independent": generate.independent_mode, "correlated": generate.correlated_mode}[mode]
    return made(numbers, n, model, seed)


def encode_stream(rows: DataFrame, model: TableModel) -> DataFrame:
    return encode(rows, model)
