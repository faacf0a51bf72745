"""Sampling of tables: random, independent and correlated, with keys.

Rows are a range of numbers; each value is an expression of the row number and the seed. Random and
independent tables are one projection, and a join for each column whose categories are a dictionary.
A correlated one adds a join with a table of probabilities for each child of the network. Results do
not depend on partitioning.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.functions.order import NESTED, below
from tabloom.functions.rng import letters, shuffled, uniform, uniform_here
from tabloom.functions.types import DATETIME, FLOAT, INTEGER, SSN, STRING, ssn_text
from tabloom.operators import dictionary
from tabloom.operators.cpt import given
from tabloom.operators.ordered import running
from tabloom.plans.model import ColumnModel, TableModel

#: Numbers in a conditional table that may be sent to every task.
SENT = 2_000_000


def cumulative(p: list[float]) -> list[float]:
    return list(accumulate(p))


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row: as a lambda's argument it is never repeated."""
    return F.get(F.transform(F.array(x), body), 0)


def draw(cum: Column, u: Column) -> Column:
    """The code of a uniform number, by cumulative probabilities."""
    return let(u, lambda x: F.least(F.size(F.filter(cum, lambda c: c <= x)), F.size(cum) - 1))


#: Slots of the guide of a draw for each code.
GUIDE = 4


def guide(cum: list[float]) -> list[int]:
    """How many cumulative probabilities are at or below each slot's start, and below the end of the last.

    Slots are equal parts of [0, 1); their number is a power of two, so a float's slot is exact.
    """
    slots = 1 << max(len(cum) * GUIDE - 1, 0).bit_length()
    return [*(bisect_right(cum, k / slots) for k in range(slots)), len(cum)]


def draw_of(cum: list[float], u: Column) -> Column:
    """The same with plain probabilities, by a guide: only those within the slot of the number are compared.

    As all slots are equally likely, that is 1 / GUIDE of a comparison in expectation, whatever the
    number of codes and their probabilities.
    """
    if not cum:
        return F.lit(-1)
    ordered = sorted(cum)
    starts = guide(ordered)
    bounds, first, slots = numbers(ordered), whole_numbers(starts), len(starts) - 1

    def look(x: Column, slot: Column) -> Column:
        start, end = F.get(first, slot), F.get(first, slot + 1)
        inside = F.size(F.filter(F.slice(bounds, start + 1, end - start), lambda c: c <= x))
        return F.least(F.when(start == end, start).otherwise(start + inside), F.lit(len(cum) - 1))

    return let(u, lambda x: let(F.floor(x * float(slots)).cast("int"), lambda slot: look(x, slot)))


def numbers(values: list) -> Column:
    """A constant array, handed to Spark as one text, which it reads once for a plan."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>") if values else F.array().cast("array<double>")


def whole_numbers(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def sampled_code(c: ColumnModel, seed: object, row: Column) -> Column:
    return draw_of(cumulative(c.distribution_probabilities), uniform(seed, f"gen:{c.name}", row))


def decoded(c: ColumnModel, code: Column, seed: object, row: Column, timestamps: bool = False) -> Column:
    """The value of a code: null for the missing code, a category, or a number drawn within the bin."""
    n = len(c.distribution_bins)
    if not n:
        return F.lit(None).cast("string")
    if c.is_categorical:
        v = F.get(F.array(*[F.lit(v) for v in c.distribution_bins]), code)  # null beyond the last
        if c.data_type == SSN:
            v = ssn_text(v.cast("bigint"))
        return F.timestamp_seconds(v) if c.data_type == DATETIME and timestamps else v
    low = numbers(c.distribution_bins)
    high = numbers([*c.distribution_bins[1:], c.max + (0.5 if c.min == c.max else 0)])
    x = let(code, lambda k: let(F.get(low, k), lambda lo: lo + uniform(seed, f"val:{c.name}", row) * (F.get(high, k) - lo)))
    return let(x, lambda v: as_value(c, v, seed, row, timestamps))


def drawn_steps(c: ColumnModel, seed: object, row: Column, timestamps: bool) -> tuple[Callable[[Column], Column], ...]:
    """From a uniform number to a code and on to its value, for a column of few codes; null stays null."""
    ordered = sorted(cumulative(c.distribution_probabilities))

    def code(u: Column) -> Column:
        return F.when(u.isNotNull(), F.least(below(ordered, u), F.lit(len(ordered) - 1)))

    if c.is_categorical:
        return code, lambda k: decoded(c, k, seed, row, timestamps)
    low = numbers(c.distribution_bins)
    high = numbers([*c.distribution_bins[1:], c.max + (0.5 if c.min == c.max else 0)])
    return code, lambda k: F.get(low, k) + uniform(seed, f"val:{c.name}", row) * (F.get(high, k) - F.get(low, k)), lambda x: as_value(c, x, seed, row, timestamps)


def as_value(c: ColumnModel, x: Column, seed: object, row: Column, timestamps: bool = False) -> Column:
    """A drawn number as a value of the column's type."""
    if c.data_type == INTEGER:
        return F.bround(x, 0).cast("bigint")
    if c.data_type == DATETIME:
        whole = F.signum(x).cast("bigint") * F.floor(F.abs(x))
        return F.timestamp_seconds(whole) if timestamps else whole
    if c.data_type == STRING:
        return letters(seed, f"text:{c.name}", row, x.cast("int"))
    if c.data_type == SSN:
        return ssn_text(F.floor(x))
    return x


def key_values(c: ColumnModel, n: int, seed: object, row: Column, timestamps: bool = False) -> Column:
    """Distinct values for rows 0 to n - 1."""
    lo, hi = float(c.min or 0), float(c.max or 0)
    if c.data_type == INTEGER:
        return row.cast("bigint")
    if c.data_type == FLOAT:
        return F.lit(lo) + row * F.lit((hi - lo) / max(n, 1))
    if c.data_type == DATETIME:
        x = F.floor(F.lit(lo) + row * F.lit((hi - lo) / max(n, 1)))
        return F.timestamp_seconds(x) if timestamps else x
    if c.data_type == SSN:
        if n >= 10**9:
            raise ValueError("there are fewer social security numbers than rows")
        place = shuffled(row, n, seed, f"key:{c.name}")
        return ssn_text(F.floor(place * F.lit((10**9 - 1) / max(n - 1, 1))))
    length = int(lo + uniform_here(seed, f"key:{c.name}", 0) * (hi - lo + 1)) if hi > lo else int(lo)
    prefix = "".join(chr(97 + int(uniform_here(seed, f"prefix:{c.name}", i) * 26)) for i in range(length))
    return F.concat(F.lit(prefix), row.cast("string"))


def uniform_values(c: ColumnModel, minimum: float, maximum: float, seed: object, row: Column, use_domain: bool, timestamps: bool = False) -> Column:
    """Random mode's values of a column that is no key."""
    u = uniform(seed, f"gen:{c.name}", row)
    if c.is_categorical and c.distribution_bins:
        known = F.array(*[F.lit(v) for v in c.distribution_bins])
        v = F.get(known, F.floor(u * len(c.distribution_bins)).cast("int"))
        return ssn_text(v.cast("bigint")) if c.data_type == SSN else F.timestamp_seconds(v) if c.data_type == DATETIME and timestamps else v
    lo, hi = (c.min or 0, c.max or 0) if use_domain or c.data_type == STRING else (minimum, maximum)
    if c.data_type == STRING:
        length = int(lo + uniform_here(seed, f"len:{c.name}", 0) * (hi - lo + 1))
        return letters(seed, f"text:{c.name}", row, F.lit(length))
    if c.data_type == FLOAT:
        return F.lit(float(lo)) + u * F.lit(float(hi) - float(lo))
    whole = F.lit(int(lo)) + F.floor(u * F.lit(int(hi) - int(lo) + 1))
    return ssn_text(whole) if c.data_type == SSN else F.timestamp_seconds(whole) if c.data_type == DATETIME and timestamps else whole.cast("bigint")


def rows_of(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n)


class Made(NamedTuple):
    """A column in the making: an expression and, where its dictionary is joined, how: a draw by a uniform number, or a value by its code."""

    column: ColumnModel
    value: Column
    how: str | None = None
    after: Callable[[Column], Column] = lambda v: v
    #: What is made of the value in turn, each from a column of a table, so that none is computed twice.
    steps: tuple[Callable[[Column], Column], ...] = ()


def shown(c: ColumnModel, timestamps: bool) -> Callable[[Column], Column]:
    """How a dictionary's value is put out."""
    if c.data_type == SSN:
        return lambda v: ssn_text(v)
    return (lambda v: F.timestamp_seconds(v)) if c.data_type == DATETIME and timestamps else (lambda v: v)


def filled(rows: DataFrame, parts: list[Made]) -> DataFrame:
    """The table of some columns, from rows with ``id`` and what the expressions read."""
    out = rows.select("id", *[m.value.alias(f"c{k}") for k, m in enumerate(parts)])
    for k, m in enumerate(parts):  # a step at a time, as compiled code has a method for each
        for step in m.steps:
            out = out.withColumn(f"c{k}", step(F.col(f"c{k}")))
    for k, m in enumerate(parts):
        if m.how:
            out = (dictionary.drawn if m.how == "draw" else dictionary.named)(out, m.column.dictionary, f"c{k}")
    return out.select(*[m.after(F.col(f"c{k}")).alias(m.column.name) for k, m in enumerate(parts)])


def random_value(c: ColumnModel, n: int, minimum: float, maximum: float, seed: object, row: Column, use_domain: bool, timestamps: bool) -> Made:
    if c.is_candidate_key:
        return Made(c, key_values(c, n, seed, row, timestamps))
    if c.dictionary:
        return Made(c, F.floor(uniform(seed, f"gen:{c.name}", row) * c.size).cast("bigint"), "code", shown(c, timestamps))
    return Made(c, uniform_values(c, minimum, maximum, seed, row, use_domain, timestamps))


def random_mode(rows: DataFrame, n: int, model: TableModel, seed: object = 0, minimum: float = 0, maximum: float = 100, use_domain: bool = False, timestamps: bool = False) -> DataFrame:
    """Types and domains alone; ``rows`` has the row numbers in ``id``, as a table or a stream."""
    return filled(rows, [random_value(c, n, minimum, maximum, seed, F.col("id"), use_domain, timestamps) for c in model.columns.values()])


def independent_value(c: ColumnModel, n: int, seed: object, row: Column, emit_missing: bool, timestamps: bool) -> Made:
    if c.is_candidate_key:
        return Made(c, key_values(c, n, seed, row, timestamps))
    stays = uniform(seed, f"missing:{c.name}", row) >= c.missing_rate if emit_missing and c.missing_rate else None
    if c.dictionary:
        show = shown(c, timestamps)
        return Made(c, uniform(seed, f"gen:{c.name}", row), "draw", show if stays is None else lambda v: F.when(stays, show(v)))
    if 0 < len(c.distribution_bins) <= NESTED and len(c.distribution_probabilities) == len(c.distribution_bins):
        u = uniform(seed, f"gen:{c.name}", row)
        return Made(c, u if stays is None else F.when(stays, u), steps=drawn_steps(c, seed, row, timestamps))
    v = decoded(c, sampled_code(c, seed, row), seed, row, timestamps)
    return Made(c, v if stays is None else F.when(stays, v))


def independent_mode(rows: DataFrame, n: int, model: TableModel, seed: object = 0, emit_missing: bool = False, timestamps: bool = False) -> DataFrame:
    """Each column from its own distribution; with ``emit_missing`` also as often missing as in the original."""
    return filled(rows, [independent_value(c, n, seed, F.col("id"), emit_missing, timestamps) for c in model.columns.values()])


#: Positions among which a code is drawn from a table of probabilities.
POSITIONS = 1 << 40


def from_table(rows: DataFrame, table: DataFrame, cards: list[int], card: int, parents: list[str], name: str, u: Column) -> DataFrame:
    """Add column ``name``: codes drawn by u from (given, code, p), as rows of the parents' codes have it.

    The table is joined by its parents' number and the slot of the draw, so that rows of one instance
    of the parents are spread over slots. An instance that the table lacks draws any code.
    """
    weighted = table.where(f"code < {card}").select("given", "code", F.floor(F.col("p") * float(POSITIONS)).cast("bigint").alias("weight"))
    if parents:
        within = Window.partitionBy("given").orderBy("code")  # as many rows as the column has codes
        placed = weighted.withColumn("upto", F.sum("weight").over(within))
    else:
        placed = running(weighted, ["code"], {"upto": "weight"}, rows=card)
    # What rounding leaves over goes to the last code.
    placed = placed.withColumn("weight", F.col("weight") + F.when(F.col("code") == card - 1, POSITIONS - F.col("upto")).otherwise(0)).withColumn("upto", F.when(F.col("code") == card - 1, POSITIONS).otherwise(F.col("upto")))
    there, width = dictionary.slots(placed, POSITIONS, card)
    there = there.select(F.col("given").alias("__there"), "slot", "low", "high", F.col("code").alias("__code"))
    asked = rows.withColumn("__u", u).withColumn("__at", dictionary.position(F.col("__u"), POSITIONS))
    asked = asked.withColumn("__given", given([F.col(p) for p in parents], cards)).withColumn("__slot", F.expr(f"__at div {width}"))
    on = (F.col("__given") == F.col("__there")) & (F.col("__slot") == F.col("slot")) & (F.col("__at") >= F.col("low")) & (F.col("__at") < F.col("high"))
    code = F.coalesce("__code", F.floor(F.col("__u") * card)).cast("int").alias(name)
    return asked.join(there, on, "left").select(*rows.columns, code)


def sampled_codes(rows: DataFrame, model: TableModel, seed: object = 0) -> DataFrame:
    """Codes of the network's columns as ``n0``, ``n1``, ... in the order of sampling, parents before children.

    The table of a child is joined on its parents' codes; where it has no such row, the child's own
    distribution is drawn from. Lists are sent to all tasks only if they are small; tables are left to Spark.
    """
    spark, row = rows.sparkSession, F.col("id")
    order = model.sampling_order
    out = rows.select("id")
    for place, (child, parents) in enumerate([(order[0], []), *model.network]):
        u, given_by, name = uniform(seed, f"gen:{child}", row), [f"n{order.index(p)}" for p in parents], f"n{place}"
        if model.tables is not None:
            own = model.tables.where(F.col("place") == place).select("given", "code", "p")
            out = from_table(out, own, [model.codes_of(p) for p in parents], model.codes_of(child), given_by, name, u)
            continue
        if not parents:
            out = out.select("id", draw_of(cumulative(model.conditional[child][0][1]), u).cast("int").alias(name))
            continue
        table = [(*codes, cumulative(p)) for codes, p in model.conditional[child]]
        schema = ", ".join([*[f"__p{k} int" for k in range(len(parents))], "__cum array<double>"])
        known = spark.createDataFrame(table, schema)
        if sum(len(r[-1]) for r in table) <= SENT:
            known = F.broadcast(known)
        on = [F.col(p) == F.col(f"__p{k}") for k, p in enumerate(given_by)]
        probabilities = model.columns[child].distribution_probabilities
        rest = numbers(cumulative(probabilities)) if probabilities else F.array(F.lit(1.0))
        out = out.join(known, on, "left").select(*out.columns, draw(F.coalesce("__cum", rest), u).cast("int").alias(name))
    return out


def correlated_mode(rows: DataFrame, n: int, model: TableModel, seed: object = 0, timestamps: bool = False) -> DataFrame:
    """Network columns from sampled codes, keys made, the rest independent."""
    row, order = F.col("id"), model.sampling_order

    def value(c: ColumnModel) -> Made:
        if c.name not in order:
            return independent_value(c, n, seed, row, False, timestamps)
        code = F.col(f"n{order.index(c.name)}")
        return Made(c, code, "code", shown(c, timestamps)) if c.dictionary else Made(c, decoded(c, code, seed, row, timestamps))

    return filled(sampled_codes(rows, model, seed), [value(c) for c in model.columns.values()])
