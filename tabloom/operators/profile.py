"""Profiling: logical types, keys, categorical columns, missing rates and domains.

Two aggregations read the whole table; none expands rows by column. Distinct counts are approximate
first, and exact where a decision hangs on them: small ones by a set for each column (map-side
combined, and bounded, as the count is small), possible keys by one search for repeated values of all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.types import DATETIME, FLOAT, INTEGER, SSN, STRING, as_number, is_datetime, is_numeric, is_ssn, is_time, reject_nested
from tabloom.plans.model import ColumnModel, TableModel
from tabloom.sources.tables import kept

THRESHOLD = 20


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def value(df: DataFrame, name: str) -> Column:
    """A column's value: NaN counts as missing."""
    kind = df.schema[name].dataType
    return F.when(~F.isnan(col(name)), col(name)) if isinstance(kind, (T.FloatType, T.DoubleType)) else col(name)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def infer_types(df: DataFrame, declared: dict[str, str] | None = None) -> dict[str, str]:
    """The logical type of each column, over all rows: schema first, then predicates on values."""
    reject_nested(df.schema)
    declared, out, checks = declared or {}, {}, {}
    for f in df.schema:
        x = value(df, f.name)
        if f.name in declared:
            out[f.name] = declared[f.name]
        elif isinstance(f.dataType, T.IntegralType):
            out[f.name] = INTEGER
        elif is_numeric(f.dataType):
            checks[f.name] = [F.bool_and(x == F.floor(x))]
        elif is_time(f.dataType):
            out[f.name] = DATETIME
        elif isinstance(f.dataType, T.StringType):
            checks[f.name] = [F.bool_and(is_datetime(x)), F.bool_and(F.when(x.isNotNull(), is_ssn(x)))]  # nulls do not count
        else:
            out[f.name] = STRING
    if checks:
        names = [(n, k) for n, c in checks.items() for k in range(len(c))]
        found = df.agg(*[checks[n][k].alias(f"c{i}") for i, (n, k) in enumerate(names)]).first()
        results = {n: [found[f"c{i}"] for i, (m, _) in enumerate(names) if m == n] for n in checks}
        for n, r in results.items():
            if is_numeric(df.schema[n].dataType):
                out[n] = INTEGER if r[0] or r[0] is None else FLOAT
            else:
                out[n] = DATETIME if r[0] else SSN if r[1] else STRING
    return {c: out[c] for c in df.columns}


def exact_distinct(df: DataFrame, name: str) -> int:
    return df.select(value(df, name).alias("x")).where("x is not null").distinct().count()


#: One value in so many, by its hash, is looked at first when keys are sought.
FIRST = 64


def with_repeats(df: DataFrame, names: list[str]) -> set[str]:
    """Those columns of whole numbers or text that have a value twice, of all named ones together.

    A part of the values, picked by their hash, shows nearly all such columns at once. For the rest, one
    shuffle of a hash for each value proves that hashes differ, and so values; equal hashes are compared
    by value, for the columns that have any. Nulls do not count.
    """

    def values(asked: list[str], keep: Callable[[Column], Column], *more: Callable[[Column], Column]) -> DataFrame:
        each = [F.when(x.isNotNull() & keep(F.xxhash64(x)), F.struct(F.lit(names.index(c)).alias("k"), F.xxhash64(x).alias("h"), *[m(x) for m in more])) for c in asked for x in [value(df, c)]]
        return df.select(F.explode(F.array_compact(F.array(*each))).alias("v")).select("v.*")

    def repeated(found: DataFrame, by: list[str]) -> set[str]:
        return {names[r["k"]] for r in found.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").select("k").distinct().collect()}

    def text(x: Column) -> Column:
        return x.cast("string").alias("x")

    if not names:
        return set()
    out = repeated(values(names, lambda h: F.pmod(h, F.lit(FIRST)) == 0, text), ["k", "x"])
    rest = [c for c in names if c not in out]
    if not rest:
        return out
    same = kept(values(rest, lambda h: F.lit(True)).groupBy("k", "h").agg(F.count("*").alias("n")).where("n > 1").select("k", "h"))
    unsure = sorted(names[r["k"]] for r in same.select("k").distinct().collect())
    if not unsure:
        return out
    return out | repeated(values(unsure, lambda h: F.lit(True), text).join(same, ["k", "h"], "left_semi"), ["k", "x"])


def profile(df: DataFrame, threshold: int = THRESHOLD, types: dict[str, str] | None = None, categorical: dict[str, bool] | None = None, keys: dict[str, bool] | None = None, ranges: dict[str, tuple] | None = None) -> TableModel:
    """Flags and domains of all columns; distributions are left empty.

    ``types``, ``categorical``, ``keys`` and ``ranges`` override what is found. Missing values are no
    part of a domain; one of them leaves a key a key, two do not.
    """
    kinds = infer_types(df, types)
    categorical, keys, ranges = categorical or {}, keys or {}, ranges or {}
    aggs = [F.count("*").alias("n")]
    for k, c in enumerate(df.columns):
        x = value(df, c)
        number = as_number(x, df.schema[c].dataType, kinds[c])
        aggs += [F.count(x).alias(f"v{k}"), F.approx_count_distinct(x).alias(f"d{k}"), F.min(number).alias(f"lo{k}"), F.max(number).alias(f"hi{k}")]
    found = df.agg(*aggs).first()
    near = [k for k in range(len(df.columns)) if found[f"d{k}"] <= 3 * threshold + 50]
    exact = df.agg(*[F.size(F.collect_set(value(df, df.columns[k]))).alias(f"d{k}") for k in near]).first() if near else {}
    open_ = [c for k, c in enumerate(df.columns) if c not in keys and k not in near and kinds[c] not in (FLOAT, DATETIME) and found[f"v{k}"] and found["n"] - found[f"v{k}"] <= 1 and found[f"d{k}"] >= 0.7 * found[f"v{k}"]]
    repeats = with_repeats(df, open_)
    columns = {}
    for k, c in enumerate(df.columns):
        present, distinct = found[f"v{k}"], exact[f"d{k}"] if k in near else found[f"d{k}"]
        if c in keys:
            key = keys[c]
        elif kinds[c] in (FLOAT, DATETIME) or not present or found["n"] - present > 1:
            key = False
        elif k in near:
            key = distinct == present
        else:
            key = c in open_ and c not in repeats
        distinct = present if key and c not in keys else distinct
        lo, hi = ranges.get(c, (found[f"lo{k}"], found[f"hi{k}"])) if kinds[c] != STRING else (found[f"lo{k}"], found[f"hi{k}"])
        columns[c] = ColumnModel(c, kinds[c], categorical.get(c, distinct <= threshold), key, int(distinct), int(present), (found["n"] - present) / (found["n"] or 1), lo, hi)
    return TableModel(found["n"], columns)


def profile_frame(df: DataFrame, model: TableModel) -> DataFrame:
    """The profile as rows."""
    rows = [(c.name, c.data_type, c.is_categorical, c.is_candidate_key, c.non_null, float(c.missing_rate), None if c.min is None else float(c.min), None if c.max is None else float(c.max)) for c in model.columns.values()]
    return df.sparkSession.createDataFrame(rows, "attr string, data_type string, is_categorical boolean, is_candidate_key boolean, n_values long, missing_rate double, min double, max double")


def meta_frame(df: DataFrame, model: TableModel) -> DataFrame:
    m = model.meta()
    row = (m["num_tuples"], m["num_attributes"], m["num_attributes_in_BN"], ",".join(m["candidate_keys"]), ",".join(m["non_categorical_string_attributes"]), ",".join(m["attributes_in_BN"]))
    return df.sparkSession.createDataFrame([row], "num_tuples long, num_attributes long, num_attributes_in_bn long, candidate_keys string, non_categorical_strings string, bn_attributes string")


def missing_rates(df: DataFrame) -> DataFrame:
    """(attr, missing_rate) of all columns, by one aggregation turned to rows."""
    one = df.agg(F.count("*").alias("n"), *[F.count(value(df, c)).alias(f"v{k}") for k, c in enumerate(df.columns)])
    pairs = [F.struct(F.lit(c).alias("attr"), (F.col("n") - F.col(f"v{k}")).cast("double").alias("missing")) for k, c in enumerate(df.columns)]
    return one.select("n", F.explode(F.array(*pairs)).alias("x")).select("x.attr", F.coalesce(F.try_divide("x.missing", "n"), F.lit(0.0)).alias("missing_rate"))


def categorical_columns(model: TableModel, threshold: int = THRESHOLD) -> list[str]:
    """Columns with few values or without numbers, as charts want them."""
    return [c.name for c in model.columns.values() if c.n_distinct <= threshold or c.data_type not in (INTEGER, FLOAT)]


def binary_columns(model: TableModel) -> list[str]:
    return [c.name for c in model.columns.values() if c.n_distinct == 2]
