"""Categories of a column that has too many for a plan: a table of typed values, which never comes to the driver.

Values keep their type, so they are found by an equality of numbers, times or texts and not of
their print. Weights are whole numbers and their running sums exact: a draw is a position below the
sum of all weights, so each position belongs to exactly one value. Positions are cut into as many
slots as there are values; a value stands in each slot that it touches, at most twice as many rows,
and a draw finds it by an equality of slots, which also spreads a value with most of the weight.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.types import FLOAT, STRING
from tabloom.operators.ordered import running
from tabloom.sources.tables import kept

#: What probabilities are multiplied by to become weights.
WEIGHT = 1 << 52


def kind_of(logical: str) -> str:
    """The type that a logical type's categories have."""
    return "string" if logical == STRING else "double" if logical == FLOAT else "bigint"


@dataclass
class Dictionary:
    """``table`` has (code, value, p, weight, upto) in the order of values; ``total`` is the sum of weights."""

    table: DataFrame
    size: int
    total: int

    def probabilities(self) -> DataFrame:
        return self.table.select(F.col("code").alias("bin_idx"), "value", "p")


def built(counts: DataFrame) -> Dictionary:
    """A dictionary of (value, n); values with n = 0 are part of it. If nothing was counted all are equal."""
    counts = kept(counts)
    size, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not total:
        counts, total = counts.withColumn("n", F.lit(1).cast("bigint")), size
    placed = running(counts.withColumn("one", F.lit(1)), ["value"], {"place": "one", "upto": "n"}, rows=size)
    p = F.col("n") / F.lit(float(total or 1))
    return Dictionary(kept(placed.select((F.col("place") - 1).cast("bigint").alias("code"), "value", p.alias("p"), F.col("n").cast("bigint").alias("weight"), F.col("upto").cast("bigint").alias("upto"))), size, int(total))


def reweighted(known: Dictionary, p: Column) -> Dictionary:
    """The same values with other probabilities, which need not be normal: negative ones count as 0, and if all do they are equal."""
    raw = kept(known.table.select("code", "value", F.greatest(p, F.lit(0.0)).alias("p")))
    total = raw.agg(F.sum("p")).first()[0]
    p = F.col("p") / F.lit(total) if total else F.lit(1.0 / max(known.size, 1))
    weighted = raw.select("code", "value", p.alias("p"), F.floor(p * float(WEIGHT)).cast("bigint").alias("weight"))
    table = kept(running(weighted, ["code"], {"upto": "weight"}, rows=known.size).select("code", "value", "p", "weight", F.col("upto").cast("bigint").alias("upto")))
    return Dictionary(table, known.size, int(table.agg(F.max("upto")).first()[0] or 0))


def listed(spark: SparkSession, values: list, logical: str) -> DataFrame:
    """(code, value) of categories that the driver has as a list."""
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"code bigint, value {kind_of(logical)}")


def slots(table: DataFrame, total: int, size: int, by: list[str] | None = None) -> tuple[DataFrame, int]:
    """((slot, low, high, ...), width of a slot): where each value stands among the positions below ``total``."""
    width = max(1, -(-total // max(size, 1)))
    names = [c for c in table.columns if c not in ("weight", "upto", "p")]
    there = table.where("weight > 0").select(*names, (F.col("upto") - F.col("weight")).alias("low"), F.col("upto").alias("high"))
    return there.select("*", F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"(high - 1) div {width}"))).alias("slot")), width


def position(u: Column, total: int) -> Column:
    """The position that a uniform number between 0 and 1 falls on."""
    return F.least(F.floor(u * float(total)), F.lit(total - 1)).cast("bigint")


def drawn(rows: DataFrame, known: Dictionary, name: str) -> DataFrame:
    """Column ``name``, uniform numbers, replaced by the values that they draw."""
    there, width = slots(known.table, known.total, known.size)
    asked = rows.withColumn("__at", position(F.col(name), known.total)).withColumn("__slot", F.expr(f"__at div {width}"))
    on = (F.col("__slot") == F.col("slot")) & (F.col("__at") >= F.col("low")) & (F.col("__at") < F.col("high"))
    return asked.join(there.select("slot", "low", "high", "value"), on).select(*[F.col("value").alias(c) if c == name else F.col(c) for c in rows.columns])


def named(rows: DataFrame, known: Dictionary, name: str) -> DataFrame:
    """Column ``name``, codes, replaced by their values; codes beyond the last become null."""
    table = known.table.select(F.col("code").alias("__code"), "value")
    return rows.join(table, F.col(name) == F.col("__code"), "left").select(*[F.col("value").alias(c) if c == name else F.col(c) for c in rows.columns])
