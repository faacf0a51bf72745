"""One-dimensional distributions: categories, histograms, automatic bin counts, noise.

All categorical columns are counted in one job and all histograms in another; their results have a
row for each column and bin, so only as much comes to the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.order import NESTED, below
from tabloom.functions.rng import laplace, uniform
from tabloom.functions.types import DATETIME, FLOAT, INTEGER, SSN, STRING, as_number
from tabloom.operators.dictionary import built, kind_of, reweighted
from tabloom.operators.ordered import quantiles_of, running
from tabloom.operators.profile import value
from tabloom.plans.model import IN_PLAN, ColumnModel, TableModel
from tabloom.sources.tables import kept

BINS = 20


def edges(lo: float, hi: float, bins: int) -> list[float]:
    """Left edges of equal bins; a domain of one value is widened by a half to both sides."""
    lo, hi = (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)
    step = (hi - lo) / bins
    return [i * step + lo for i in range(bins)]


def bin_of(x: Column, left: list[float]) -> Column:
    """The bin of a number: the last left edge that is not above it (-1 below all)."""
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in left]), lambda e: e <= x.cast("double"))) - 1


def category(df: DataFrame, name: str, logical: str) -> Column:
    """What a column's categories are: numbers for numerical types, else text."""
    x = value(df, name)
    return x.cast("string") if logical == STRING else as_number(x, df.schema[name].dataType, logical)


def categorical_distribution(df: DataFrame, name: str, logical: str = STRING, domain: list | None = None) -> DataFrame:
    """(bin_idx, value, n, p) of a column's values and of the declared ones, in order; nulls do not count."""
    counts = df.select(category(df, name, logical).alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    if domain is not None:
        declared = df.sparkSession.createDataFrame([(v,) for v in domain], counts.select("value").schema)
        counts = counts.join(declared, "value", "full_outer").select("value", F.coalesce("n", F.lit(0)).alias("n"))
    counts = kept(counts)
    total, size = counts.agg(F.sum("n"), F.count("*")).first()
    placed = running(counts.withColumn("one", F.lit(1)), ["value"], {"place": "one"}, rows=size)
    return placed.select((F.col("place") - 1).cast("long").alias("bin_idx"), "value", F.col("n").cast("long").alias("n"), (F.col("n") / float(total or 1)).alias("p"))


def histogram(df: DataFrame, x: Column, lo: float, hi: float, bins: int = BINS) -> DataFrame:
    """(bin_idx, bin_lo, n, p) of equal bins over [lo, hi]; values outside are left out, hi is in the last bin."""
    left = edges(float(lo), float(hi), bins)
    top = float(hi) + (0.5 if lo == hi else 0)
    codes = df.select(x.cast("double").alias("x")).where(F.col("x").between(left[0], top)).groupBy(bin_of(F.col("x"), left).alias("bin_idx")).agg(F.count("*").alias("n"))
    frame = df.sparkSession.createDataFrame(list(enumerate(left)), "bin_idx int, bin_lo double")
    both = frame.join(codes, "bin_idx", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy())
    return both.select(F.col("bin_idx").cast("long").alias("bin_idx"), "bin_lo", F.col("n").cast("long").alias("n"), F.coalesce(F.try_divide("n", total), F.lit(0.0)).alias("p"))


def bin_count(rule: str, n: int, lo: float, hi: float, q1: float, q3: float, std: float, skew: float, whole: bool) -> int:
    """Bins by a named rule from a column's statistics; numbers that are whole get a width of 1 at least."""
    span = hi - lo
    if not n or span <= 0:
        return 1
    sturges = span / (math.log2(n) + 1)
    fd = 2 * (q3 - q1) / n ** (1 / 3)
    if rule == "auto":
        width = min(fd, sturges) if fd else sturges
    elif rule == "fd":
        width = fd
    elif rule == "sturges":
        width = sturges
    elif rule == "sqrt":
        width = span / math.sqrt(n)
    elif rule == "rice":
        width = span / (2 * n ** (1 / 3))
    elif rule == "scott":
        width = (24 * math.sqrt(math.pi) / n) ** (1 / 3) * std
    elif rule == "doane":
        sg = math.sqrt(6 * (n - 2) / ((n + 1) * (n + 3))) if n > 2 else 0.0
        width = span / (1 + math.log2(n) + math.log2(1 + abs(skew) / sg)) if sg and std else 0.0
    else:
        raise ValueError(f"no such rule: {rule}")
    if not width:
        return 1
    return max(1, math.ceil(span / (max(width, 1) if whole else width)))


def statistics_of(df: DataFrame, columns: dict[str, Column]) -> dict[str, dict]:
    """What the rules need of each column, all in three scans."""
    xs = {n: x.cast("double") for n, x in columns.items()}
    more = {}
    for n, x in xs.items():
        more |= {(n, "n"): F.count(x), (n, "lo"): F.min(x), (n, "hi"): F.max(x), (n, "std"): F.stddev_pop(x), (n, "skew"): F.skewness(x), (n, "whole"): F.bool_and(x == F.floor(x))}
    q, r = quantiles_of(df, xs, [0.25, 0.75], more)
    return {n: {"n": r[n, "n"], "lo": r[n, "lo"], "hi": r[n, "hi"], "q1": q[n][0] or 0.0, "q3": q[n][1] or 0.0, "std": r[n, "std"] or 0.0, "skew": r[n, "skew"] or 0.0, "whole": bool(r[n, "whole"])} for n in xs}


def statistics(df: DataFrame, x: Column) -> dict:
    return statistics_of(df, {"x": x})["x"]


def stone_bins(df: DataFrame, x: Column, stats: dict, most: int | None = None) -> int:
    """Stone's rule: the bin count with the least estimated risk, of 1 to max(100, sqrt(n)) or ``most``.

    The table is read once, into its distinct values with their counts. The inner edges of all bin
    counts, about n / 2 with the default, are merged with them in one order: the running count at an
    edge is what lies below it, and a bin holds the difference of its edges.
    """
    n, span = stats["n"], (stats["hi"] or 0) - (stats["lo"] or 0)
    if n <= 1 or span <= 0:
        return 1
    most = most or max(100, int(math.sqrt(n)))
    lo = F.lit(float(stats["lo"]))
    none = F.lit(0)
    values = df.select(x.cast("double").alias("x")).where("x is not null").groupBy("x").agg(F.count("*").alias("c"))
    edges_ = df.sparkSession.range(2, most + 1).select(F.col("id").cast("int").alias("k")).select("k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("j"))
    placed = edges_.select((F.col("j") * (F.lit(float(span)) / F.col("k")) + lo).alias("x"), none.alias("kind"), "k", "j", none.cast("bigint").alias("c"))  # before equal values, which lie in the bin that starts here
    both = kept(values.select("x", F.lit(1).alias("kind"), none.alias("k"), none.alias("j"), "c").unionByName(placed))
    below = running(both, ["x", "kind", "k", "j"], {"upto": "c"}).where("kind = 0").select("k", "j", "upto")
    along = Window.partitionBy("k").orderBy("j")  # fewer rows than there are bin counts
    inner = below.select("k", "upto", (F.col("upto") - F.lag("upto", 1, 0).over(along)).cast("double").alias("held"))
    squares = inner.groupBy("k").agg((F.sum(F.col("held") / n * F.col("held") / n) + F.pow((n - F.max("upto")) / F.lit(float(n)), 2)).alias("s"))
    squares = squares.unionByName(df.sparkSession.createDataFrame([(1, 1.0)], "k int, s double"))
    risk = (2 - (n + 1) * F.col("s")) / (F.lit(float(span)) / F.col("k"))
    return squares.select("k", risk.alias("risk")).orderBy("risk", "k").first()["k"]


def auto_bins_of(df: DataFrame, columns: dict[str, Column], rule: str = "auto") -> dict[str, int]:
    """The bin count of each column by a named rule."""
    stats = statistics_of(df, columns)
    return {n: stone_bins(df, x, stats[n]) if rule == "stone" else bin_count(rule, **stats[n]) for n, x in columns.items()}


def auto_bins(df: DataFrame, x: Column, rule: str = "auto") -> int:
    return auto_bins_of(df, {"x": x}, rule)["x"]


def normalized(p: Column, over: Window) -> Column:
    """Negative entries become 0 and the rest sums to 1; all zero becomes uniform."""
    p = F.greatest(p, F.lit(0.0))
    total = F.sum(p).over(over)
    return F.when(total > 0, F.try_divide(p, total)).otherwise(F.lit(1.0) / F.count("*").over(over))


def noise_scale(epsilon: float, n: int, parts: int) -> float:
    """The Laplace scale of a column's probabilities if the budget is shared by ``parts`` columns."""
    return 2 / n * max(parts, 1) / epsilon


def noisy(dist: DataFrame, epsilon: float, n: int, parts: int, seed: object, stream: str) -> DataFrame:
    """Laplace noise on ``p`` of (bin_idx, p, ...), cut at 0 and normalised; none if epsilon is not above 0."""
    if epsilon <= 0 or n <= 0:
        return dist
    raw = F.col("p") + laplace(uniform(seed, stream, F.col("bin_idx")), noise_scale(epsilon, n, parts))
    return dist.withColumn("p", normalized(raw, Window.partitionBy()))


def fit(df: DataFrame, model: TableModel, bins: int | str = BINS, domains: dict[str, list] | None = None) -> TableModel:
    """Fill in the bins and probabilities of all columns."""
    domains = domains or {}
    groups = [c for c in model.columns.values() if c.is_categorical]
    numbers = [c for c in model.columns.values() if not c.is_categorical and c.min is not None]
    if groups:
        pairs = [F.struct(F.lit(c.name).alias("attr"), category(df, c.name, c.data_type).cast("string").alias("value")) for c in groups]
        counts = df.select(F.explode(F.array(*pairs)).alias("x")).where("x.value is not null").groupBy("x.attr", "x.value").agg(F.count("*").alias("n")).persist()
        try:
            sizes = {r["attr"]: r["count"] for r in counts.groupBy("attr").count().collect()}
            wide = [c for c in groups if max(sizes.get(c.name, 0), len(domains.get(c.name, []))) > IN_PLAN]
            for c in wide:
                _tabulate(c, counts.where(F.col("attr") == c.name), domains.get(c.name))
            few = [c for c in groups if c not in wide]
            found: dict[str, dict] = {c.name: {v: 0 for v in domains.get(c.name, [])} for c in few}
            for r in counts.where(F.col("attr").isin(*found)).collect() if few else []:
                found[r["attr"]][_typed(r["value"], model.columns[r["attr"]].data_type)] = r["n"]
            for c in few:
                _fill(c, sorted(found[c.name].items()))
        finally:
            counts.unpersist()
    if numbers:
        xs = {c.name: as_number(value(df, c.name), df.schema[c.name].dataType, c.data_type) for c in numbers}
        counts = auto_bins_of(df, xs, bins) if isinstance(bins, str) else dict.fromkeys(xs, bins)
        lefts = {}
        for c in numbers:
            lefts[c.name] = edges(float(c.min), float(c.max), counts[c.name])
        pairs, read = [], df.select(*[xs[c.name].cast("double").alias(f"x{k}") for k, c in enumerate(numbers)])
        for k, c in enumerate(numbers):
            x, left = F.col(f"x{k}"), lefts[c.name]
            top = float(c.max) + (0.5 if c.min == c.max else 0)
            place = below(left, x) - 1 if len(left) <= NESTED else bin_of(x, left)
            read = read.withColumn(f"b{k}", F.when(x.between(left[0], top), place))
            pairs.append(F.struct(F.lit(c.name).alias("attr"), F.col(f"b{k}").alias("bin")))
        counts = read.select(F.explode(F.array(*pairs)).alias("x")).where("x.bin is not null").groupBy("x.attr", "x.bin").count().collect()
        seen = {(r["attr"], r["bin"]): r["count"] for r in counts}
        for c in numbers:
            _fill(c, [(left, seen.get((c.name, k), 0)) for k, left in enumerate(lefts[c.name])])
    return model


def uniform_domain(model: TableModel, df: DataFrame, domains: dict[str, list] | None = None) -> TableModel:
    """Random mode's model: categories and ranges without their frequencies."""
    fit(df, model, 1, domains)
    for c in model.columns.values():
        n = len(c.distribution_bins)
        c.distribution_probabilities = [1 / n] * n if n else []
        if c.dictionary:
            c.dictionary = reweighted(c.dictionary, F.lit(1.0))
    return model


def add_noise(model: TableModel, df: DataFrame, epsilon: float, seed: object) -> TableModel:
    """Noise on the distributions of all columns, the budget shared by the columns a network may hold."""
    rows = [(c.name, k, float(p)) for c in model.columns.values() for k, p in enumerate(c.distribution_probabilities)]
    if epsilon <= 0 or not model.num_tuples:
        return model
    scale = noise_scale(epsilon, model.num_tuples, len(model.network_attributes))
    for c in model.columns.values():
        if c.dictionary:
            c.dictionary = reweighted(c.dictionary, F.col("p") + laplace(uniform(seed, "dist", F.lit(c.name), F.col("code")), scale))
    if not rows:
        return model
    frame = df.sparkSession.createDataFrame(rows, "attr string, bin_idx int, p double")
    raw = F.col("p") + laplace(uniform(seed, "dist", F.col("attr"), F.col("bin_idx")), scale)
    for r in frame.withColumn("p", normalized(raw, Window.partitionBy("attr"))).collect():
        model.columns[r["attr"]].distribution_probabilities[r["bin_idx"]] = r["p"]
    return model


def _tabulate(c: ColumnModel, counts: DataFrame, domain: list | None) -> None:
    """A dictionary of a column's counted values (value as text, n) and of the declared ones."""
    kind = kind_of(c.data_type)
    typed = counts.select(F.col("value").cast(kind).alias("value"), "n")
    if domain:
        declared = counts.sparkSession.createDataFrame([(v, 0) for v in domain], f"value {kind}, n bigint")
        typed = typed.unionByName(declared).groupBy("value").agg(F.sum("n").alias("n"))
    c.dictionary = built(typed)


def _fill(c: ColumnModel, counts: list[tuple]) -> None:
    total = sum(n for _, n in counts)
    c.distribution_bins = [v for v, _ in counts]
    c.distribution_probabilities = [n / total if total else 1 / len(counts) for _, n in counts]


def _typed(text: str, logical: str) -> object:
    return text if logical == STRING else float(text) if logical == FLOAT else int(float(text)) if logical in (INTEGER, SSN, DATETIME) else text
