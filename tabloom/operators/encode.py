"""Encoding: each value becomes the index of its bin, a missing one the index after the last bin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.types import STRING, as_number
from tabloom.operators.dictionary import listed
from tabloom.operators.distribution import bin_of, category
from tabloom.operators.profile import value
from tabloom.plans.model import IN_PLAN, ColumnModel, TableModel


def code_of(df: DataFrame, c: ColumnModel) -> Column:
    """The code of a column's value; values beyond a range go to the first or last bin, unseen categories are missing."""
    last = F.lit(c.size)
    if c.is_categorical:
        x = category(df, c.name, c.data_type)
        known = F.array(*[F.lit(v) for v in c.distribution_bins])
        if c.data_type != STRING:
            known, x = F.transform(known, lambda v: v.cast("double")), x.cast("double")
        place = F.array_position(known, x) - 1
        return F.when(x.isNull() | (place < 0), last).otherwise(place).cast("int")
    x = as_number(value(df, c.name), df.schema[c.name].dataType, c.data_type)
    return F.coalesce(F.greatest(bin_of(x, c.distribution_bins), F.lit(0)), last).cast("int") if c.distribution_bins else last.cast("int")


def encode(df: DataFrame, model: TableModel, attributes: list[str] | None = None) -> DataFrame:
    """The codes of the network's columns (or those named), in one projection and a join for each column of very many categories.

    Such a join is by the value with its own type; Spark sends the dictionary to all tasks if it is small and splits hot values if not.
    """
    names = attributes if attributes is not None else model.network_attributes
    models = [model.columns[n] for n in names]
    large = [k for k, c in enumerate(models) if c.is_categorical and c.size > IN_PLAN]
    out = df.select(*[(category(df, c.name, c.data_type) if k in large else code_of(df, c)).alias(f"c{k}") for k, c in enumerate(models)])
    for k in large:
        c = models[k]
        known = c.dictionary.table if c.dictionary else listed(df.sparkSession, c.distribution_bins, c.data_type)
        found = known.select(F.col("value").alias("known"), F.col("code").cast("int").alias("code"))
        coded = F.coalesce("code", F.lit(c.size)).alias(f"c{k}")
        out = out.join(found, F.col(f"c{k}") == F.col("known"), "left").select(*[coded if i == k else F.col(f"c{i}") for i in range(len(models))])
    return out.select(*[F.col(f"c{k}").alias(n) for k, n in enumerate(names)])
