"""Running sums and quantiles along an order, by ranges of the order, so that no task has all rows.

Spark deals the rows to ranges of the order and they are written with the number of their range, so
each range is summed once, the sums of the ranges before it are sent to it, and nothing of the
keys comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.sources.tables import kept


#: Rows that one task may order.
ONE_TASK = 10_000


def running(df: DataFrame, order: list[str], sums: dict[str, str], falling: tuple[str, ...] = (), rows: int | None = None) -> DataFrame:
    """Add ``sums`` (new name: column): sums up to and with each row along ``order``, whose keys are distinct and not null.

    Columns in ``falling`` count down. A caller that knows the number of rows gives it: few need no ranges.
    """
    keys = [F.desc(c) if c in falling else F.asc(c) for c in order]
    if rows is not None and rows <= ONE_TASK:
        over = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
        return df.select(*df.columns, *[F.sum(c).over(over).alias(n) for n, c in sums.items()])
    dealt = kept(df.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()))  # ranges rise with their number
    parts = dealt.groupBy("__part").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])  # a row for each range
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = parts.select("__part", *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums])
    within = Window.partitionBy("__part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    added = [(F.sum(c).over(within) + F.col(f"__{n}")).alias(n) for n, c in sums.items()]
    return dealt.join(F.broadcast(ahead), "__part").select(*df.columns, *added)


#: Ranks in a sketch of a column's order, and rows up to which all values are counted in place of a bracket.
RANKS, FEW = 10_000, 100_000
#: Of a column and share, the values between which the rank that is sought lies.
Bracket = tuple[float, float]
ALL: Bracket = (float("-inf"), float("inf"))


def _selected(df: DataFrame, xs: dict[tuple[str, float], Column], brackets: dict[tuple[str, float], Bracket], ranks: dict[tuple[str, float], int]) -> dict[tuple[str, float], list[float | None] | None]:
    """The values at each rank and the next, from those within a bracket; None where the bracket misses one of them."""
    asked = list(xs)
    narrow = [k for k in asked if brackets[k] != ALL]
    below = df.agg(*[F.count(F.when(xs[k] < brackets[k][0], 1)).alias(str(i)) for i, k in enumerate(narrow)]).first() if narrow else []
    under = dict.fromkeys(asked, 0) | dict(zip(narrow, below, strict=True))
    within = [F.when(xs[k].between(*brackets[k]), F.struct(F.lit(i).alias("i"), xs[k].alias("x"))) for i, k in enumerate(asked)]
    counts = kept(df.select(F.explode(F.array_compact(F.array(*within))).alias("v")).groupBy("v.i", "v.x").agg(F.count("*").alias("n")))
    sizes = counts.groupBy("i").agg(F.count("*").alias("k"), F.sum("n").alias("n")).collect()  # a row for each column and share
    held = {r["i"]: r["n"] for r in sizes}
    ahead, start = {}, 0
    for i in range(len(asked)):
        ahead[i], start = start, start + held.get(i, 0)
    places = [(i, k, r) for i, k in enumerate(asked) for r in (0, 1)]
    found = running(counts, ["i", "x"], {"upto": "n"}, rows=sum(r[1] for r in sizes)).agg(*[F.min(F.when((F.col("i") == i) & (F.col("upto") > ahead[i] + ranks[k] - under[k] + r), F.col("x"))).alias(f"v{i}_{r}") for i, k, r in places]).first()
    out = {}
    for i, k in enumerate(asked):
        low, high = found[f"v{i}_0"], found[f"v{i}_1"]
        # The next value may be missing only if the bracket has no end.
        out[k] = None if under[k] > ranks[k] or low is None or (high is None and brackets[k][1] != ALL[1]) else [low, low if high is None else high]
    return out


def quantiles_of(df: DataFrame, columns: dict[str, Column], shares: list[float], more: dict[str, Column] | None = None) -> tuple[dict[str, list[float | None]], dict]:
    """Exact quantiles of all columns, with linear interpolation between neighbours, and ``more`` aggregates; nulls and NaN do not count.

    Three scans for any number of columns: a sketch of each order gives a bracket around each rank,
    one counts what is below, and one counts the values inside, which alone are sorted: some
    thousandths of the rows. A bracket that misses its rank is replaced by all values.
    """
    xs = {n: F.when(~F.isnan(x.cast("double")), x.cast("double")) for n, x in columns.items()}
    ends = [min(1.0, max(0.0, s + d)) for s in shares for d in (-3 / RANKS, 3 / RANKS)]
    aggs = [e.alias(f"m{i}") for i, e in enumerate((more or {}).values())]
    for i, x in enumerate(xs.values()):
        aggs += [F.count(x).alias(f"n{i}"), F.percentile_approx(x, ends, RANKS).alias(f"q{i}")]
    first = df.agg(*aggs).first()
    extra = {name: first[f"m{i}"] for i, name in enumerate(more or {})}
    brackets, at, ranks = {}, {}, {}
    for i, name in enumerate(xs):
        n = first[f"n{i}"]
        for j, s in enumerate(shares if n else []):
            at[name, s] = s * (n - 1)
            ranks[name, s] = int(at[name, s])
            q = first[f"q{i}"][2 * j : 2 * j + 2]
            brackets[name, s] = ALL if n <= FEW else (ALL[0] if ends[2 * j] == 0 else q[0], ALL[1] if ends[2 * j + 1] == 1 else q[1])
    values: dict[tuple[str, float], list | None] = {}
    while missing := [k for k in ranks if values.get(k) is None]:
        brackets |= {k: ALL for k in missing if k in values}
        values |= _selected(df, {k: xs[k[0]] for k in missing}, brackets, ranks)

    def between(k: tuple[str, float]) -> float:
        low, high = values[k]
        return low + (high - low) * (at[k] - ranks[k])

    return {name: [between((name, s)) if (name, s) in values else None for s in shares] for name in xs}, extra


def quantiles(df: DataFrame, x: Column, shares: list[float]) -> list[float | None]:
    """Exact quantiles of one column."""
    return quantiles_of(df, {"x": x}, shares)[0]["x"]
