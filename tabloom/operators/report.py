"""Reports: chart data of one table and comparisons of an original with a synthetic table.

Whole reports (``inspect``, ``charts``, ``before_after``) read each table twice, for the ranges of its
numbers and for one long table of counts of all columns; all charts are cut from that.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from statistics import median

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.types import DATETIME, STRING, as_number
from tabloom.operators.distribution import BINS, bin_of, edges, histogram
from tabloom.operators.information import aligned_counts, nmi_matrix
from tabloom.operators.ordered import quantiles_of, running
from tabloom.operators.profile import categorical_columns, numeric_columns, value
from tabloom.plans.model import TableModel
from tabloom.sources.tables import kept


def bars(df: DataFrame, name: str, by_value: bool = True) -> DataFrame:
    """(value, n, place) of a column's values, placed by value or by falling frequency."""
    counts = df.select(F.col(f"`{name}`").cast("string").alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    counts = kept(counts)
    placed = running(counts.withColumn("one", F.lit(1)), ["value"] if by_value else ["n", "value"], {"place": "one"}, () if by_value else ("n",), counts.count())
    return placed.select("value", "n", F.col("place").cast("long").alias("place"))


def top(df: DataFrame, name: str, k: int = 20) -> DataFrame:
    """The k most frequent values; of equal frequency the smaller value."""
    counts = df.select(F.col(f"`{name}`").cast("string").alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(k)


def histogram_bars(df: DataFrame, name: str, bins: int = BINS) -> DataFrame:
    """(bin_lo, n) of a numerical column over its own range."""
    x = value(df, name).cast("double")
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin_lo double, n long")
    return histogram(df, x, lo, hi, bins).select("bin_lo", "n")


def heatmap(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(x_idx, y_idx, x, y, nmi) with three digits, columns in the order of their names."""
    return nmi_matrix(df, names).withColumn("nmi", F.round("nmi", 3))


def compare_matrices(original: DataFrame, synthetic: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(x, y, original, synthetic): both tables' matrices."""
    a = nmi_matrix(original, names).select("x", "y", F.col("nmi").alias("original"))
    return a.join(nmi_matrix(synthetic, names).select("x", "y", F.col("nmi").alias("synthetic")), ["x", "y"], "full_outer")


def compare_bars(original: DataFrame, synthetic: DataFrame, name: str) -> DataFrame:
    """(value, original, synthetic): shares of a categorical column, 0 where one has none."""
    both = aligned_counts(original, synthetic, name)
    na, nb = both.agg(F.sum("n_a"), F.sum("n_b")).first()
    return both.select("value", (F.col("n_a") / float(na or 1)).alias("original"), (F.col("n_b") / float(nb or 1)).alias("synthetic"))


def compare_densities(original: DataFrame, synthetic: DataFrame, name: str, logical: str, bins: int = 15) -> DataFrame:
    """(side, bin_idx, bin_lo, density) of a numerical column, each table over its own range."""
    out = None
    for side, df in (("original", original), ("synthetic", synthetic)):
        x = as_number(value(df, name), df.schema[name].dataType, logical).cast("double")
        lo, hi = df.agg(F.min(x), F.max(x)).first()
        if lo is None:
            continue
        width = ((hi - lo) or 1.0) / bins
        part = histogram(df, x, lo, hi, bins).select(F.lit(side).alias("side"), "bin_idx", "bin_lo", (F.col("p") / width).alias("density"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else original.sparkSession.createDataFrame([], "side string, bin_idx long, bin_lo double, density double")


@dataclass
class ChartCounts:
    """Counts of values and bins of some columns of one or more tables (sides).

    ``table`` has (side, attr, value, bin, n), attr being the place in ``names``; ``ranges`` the least and
    largest number of a column, ``sizes`` its values or bins that occur and their rows.
    """

    table: DataFrame
    names: list[str]
    bins: int
    ranges: dict[tuple[str, str], tuple[float | None, float | None]]
    sizes: dict[tuple[str, str], tuple[int, int]]

    def of(self, name: str, side: str | None = None) -> DataFrame:
        there = self.table.where(F.col("attr") == self.names.index(name))
        return there if side is None else there.where(F.col("side") == side)

    def rows(self, name: str, side: str) -> int:
        return self.sizes.get((side, name), (0, 0))[1]

    def histogram(self, name: str, side: str) -> DataFrame:
        """(bin_idx, bin_lo, n, p) of a number's own range; no rows for a column without values."""
        lo, hi = self.ranges[side, name]
        left = [] if lo is None else edges(lo, hi, self.bins)
        frame = self.table.sparkSession.createDataFrame(list(enumerate(left)), "bin_idx int, bin_lo double")
        both = frame.join(self.of(name, side).select(F.col("bin").alias("bin_idx"), "n"), "bin_idx", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
        return both.select(F.col("bin_idx").cast("bigint").alias("bin_idx"), "bin_lo", "n", (F.col("n") / float(self.rows(name, side) or 1)).alias("p"))

    def places(self, by_value: bool) -> DataFrame:
        """(side, attr, value, n, place): all values in order within their column and side, all placed in one go."""
        order = ["side", "attr", "value"] if by_value else ["side", "attr", "n", "value"]
        values = self.table.where("value is not null")
        placed = running(values.withColumn("one", F.lit(1)), order, {"upto": "one"}, () if by_value else ("n",), sum(k for k, _ in self.sizes.values()))
        starts, ahead = [], 0
        for side in sorted({x for x, _ in self.sizes}):
            for k, name in enumerate(self.names):
                if (side, name) in self.sizes and (side, name) not in self.ranges:
                    starts.append((side, k, ahead))
                    ahead += self.sizes[side, name][0]
        known = self.table.sparkSession.createDataFrame(starts, "side string, attr int, ahead bigint")  # a row for each column and side
        return placed.join(F.broadcast(known), ["side", "attr"]).select("side", "attr", "value", "n", (F.col("upto") - F.col("ahead")).cast("bigint").alias("place"))

    def bars(self, placed: DataFrame, name: str, side: str) -> DataFrame:
        """(value, n, place) of a column, from ``places``."""
        return placed.where((F.col("side") == side) & (F.col("attr") == self.names.index(name))).select("value", "n", "place")

    def shares(self, name: str, a: str, b: str) -> DataFrame:
        """(value, a, b): shares of a column's values on two sides, 0 where one has none."""
        sums = [(F.sum(F.when(F.col("side") == side, F.col("n")).otherwise(0)) / float(self.rows(name, side) or 1)).alias(side) for side in (a, b)]
        return self.of(name).groupBy("value").agg(*sums)


def count_charts(sides: dict[str, DataFrame], texts: list[str], numbers: dict[str, Callable[[DataFrame], Column]], bins: int) -> ChartCounts:
    """Counts of the values of ``texts`` and of the bins of ``numbers``, each table over its own ranges."""
    names, ranges = [*texts, *numbers], {}
    parts = None
    for side, df in sides.items():
        xs = {n: x(df).cast("double") for n, x in numbers.items()}
        if xs:
            found = df.agg(*[e for k, x in enumerate(xs.values()) for e in (F.min(x).alias(f"lo{k}"), F.max(x).alias(f"hi{k}"))]).first()
            ranges |= {(side, n): (found[f"lo{k}"], found[f"hi{k}"]) for k, n in enumerate(xs)}
        none = {"value": F.lit(None).cast("string"), "bin": F.lit(None).cast("int")}
        made = [(n, F.col(f"`{n}`"), {"value": F.col(f"`{n}`").cast("string")}) for n in texts]
        made += [(n, x, {"bin": bin_of(x, edges(*ranges[side, n], bins))}) for n, x in xs.items() if ranges[side, n][0] is not None]
        each = [F.when(x.isNotNull(), F.struct(F.lit(names.index(n)).alias("attr"), *[v.alias(c) for c, v in (none | own).items()])) for n, x, own in made]
        if each:
            counts = df.select(F.explode(F.array_compact(F.array(*each))).alias("v")).groupBy("v.attr", "v.value", "v.bin").agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "attr", "value", "bin", "n")
            parts = counts if parts is None else parts.unionByName(counts)
    spark = next(iter(sides.values())).sparkSession
    table = kept(parts) if parts is not None else spark.createDataFrame([], "side string, attr int, value string, bin int, n bigint")
    sizes = {(r["side"], names[r["attr"]]): (r["k"], r["n"]) for r in table.groupBy("side", "attr").agg(F.count("*").alias("k"), F.sum("n").alias("n")).collect()}
    return ChartCounts(table, names, bins, ranges, sizes)


def comparable(model: TableModel) -> list[str]:
    """Columns whose distributions are compared: no keys, no dates, no free text."""
    return [c.name for c in model.columns.values() if not c.is_candidate_key and c.data_type != DATETIME and (c.is_categorical or c.data_type != STRING)]


def of_few_values(model: TableModel) -> list[str]:
    """Columns of a matrix: keys and free text have about as many values as rows, so their counts would be no smaller than the table."""
    return [c.name for c in model.columns.values() if not c.is_candidate_key and (c.is_categorical or c.data_type != STRING)]


def inspect(original: DataFrame, synthetic: DataFrame, model: TableModel) -> dict[str, DataFrame]:
    """All comparisons: one frame for each comparable column and ``nmi`` for the matrices, without keys and free text."""
    names, kinds = comparable(model), model.columns
    texts = [n for n in names if kinds[n].is_categorical]
    numbers = {n: lambda df, n=n: as_number(value(df, n), df.schema[n].dataType, kinds[n].data_type) for n in names if n not in texts}
    sides = {"original": original, "synthetic": synthetic}
    counts = count_charts(sides, texts, numbers, 15)

    def densities(name: str) -> DataFrame:
        out = None
        for side in sides:
            lo, hi = counts.ranges[side, name]
            width = ((hi - lo) or 1.0) / counts.bins if lo is not None else 1.0
            part = counts.histogram(name, side).select(F.lit(side).alias("side"), "bin_idx", "bin_lo", (F.col("p") / width).alias("density"))
            out = part if out is None else out.unionByName(part)
        return out

    frames = {n: counts.shares(n, "original", "synthetic") if n in texts else densities(n) for n in names}
    return frames | {"nmi": compare_matrices(original, synthetic, of_few_values(model))}


def charts(df: DataFrame, model: TableModel, few: int = 20) -> dict[str, DataFrame]:
    """A chart of each column: bars by frequency if it has few values, a histogram if numerical, else its top values."""
    numeric, columns = set(numeric_columns(df)), model.columns.values()
    short = [c.name for c in columns if c.n_distinct <= few]
    numbers = {c.name: lambda df, n=c.name: value(df, n) for c in columns if c.name not in short and c.name in numeric}
    counts = count_charts({"all": df}, [c.name for c in columns if c.name not in numbers], numbers, BINS)
    placed = counts.places(by_value=False)
    out = {}
    for c in columns:
        if c.name in short:
            out[c.name] = counts.bars(placed, c.name, "all")
        else:
            out[c.name] = counts.histogram(c.name, "all").select("bin_lo", "n") if c.name in numbers else counts.of(c.name).select("value", "n").orderBy(F.desc("n"), "value").limit(20)
    return out


def before_after(original: DataFrame, synthetic: DataFrame, model: TableModel) -> dict[str, dict[str, DataFrame]]:
    """Bars of categorical columns, histograms of the others, and heat maps, of both tables."""
    names = sorted(set(categorical_columns(model)))
    numbers = {n: lambda df, n=n: value(df, n) for n in numeric_columns(original) if n not in names}
    both = {"before": original, "after": synthetic}
    counts = count_charts(both, names, numbers, BINS)
    placed = counts.places(by_value=True)
    return {
        "barchart": {f"{side}:{n}": counts.bars(placed, n, side) for side in both for n in names},
        "histogram": {f"{side}:{n}": counts.histogram(n, side).select("bin_lo", "n") for side in both for n in numbers},
        "heatmap": {side: heatmap(df, of_few_values(model)) for side, df in both.items()},
    }


def rank_points(df: DataFrame, order: str, score: str) -> DataFrame:
    """(position, score) along an order column; rows with equal keys take positions one after the other."""
    dealt = df.select(F.col(order).alias("o"), F.col(score).alias("score")).where("o is not null")
    counts = dealt.groupBy("o").agg(F.count("*").alias("n"))
    starts = running(counts, ["o"], {"upto": "n"}).select("o", (F.col("upto") - F.col("n")).alias("ahead"))
    within = Window.partitionBy("o").orderBy("score")
    return dealt.join(starts, "o").select((F.row_number().over(within) + F.col("ahead")).alias("position"), "score")


def rank_summary(df: DataFrame, order: str, columns: list[str], first: int = 10) -> DataFrame:
    """(attr, top_max, top_median, top_min, all_max, all_median, all_min): the first rows against all."""
    head = df.select(F.col(f"`{order}`"), *[F.col(f"`{c}`").cast("double").alias(f"x{k}") for k, c in enumerate(columns)]).orderBy(F.col(f"`{order}`")).limit(first).collect()
    xs = {c: F.col(f"`{c}`").cast("double") for c in columns}
    middle, ends = quantiles_of(df, xs, [0.5], {(c, k): f(x) for c, x in xs.items() for k, f in (("max", F.max), ("min", F.min))})
    rows = []
    for k, c in enumerate(columns):
        some = [r[f"x{k}"] for r in head if r[f"x{k}"] is not None]
        rows.append((c, max(some, default=None), median(some) if some else None, min(some, default=None), ends[c, "max"], middle[c][0], ends[c, "min"]))
    names = [f"{side}_{k} double" for side in ("top", "all") for k in ("max", "median", "min")]
    return df.sparkSession.createDataFrame(rows, ", ".join(["attr string", *names]))
