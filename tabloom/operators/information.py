"""Information measures: entropy, mutual information, its normalised matrix, KL and KS.

Each reads the table once into joint counts with map-side combining; all later steps are over
those counts. Missing values are a category of their own in the matrix.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.operators.ordered import running
from tabloom.sources.tables import kept

MISSING = "nan"


def _n_ln_n(n: str = "n") -> Column:
    return F.sum(F.col(n) * F.ln(F.col(n).cast("double")))


def entropy(df: DataFrame, name: str) -> DataFrame:
    """One row: the entropy of a column in nats, ln N - sum(n ln n) / N; no count needs the total beside it."""
    counts = df.groupBy(F.col(f"`{name}`").alias("x")).agg(F.count("*").alias("n"))
    total = F.sum("n")
    return counts.agg(F.greatest(F.coalesce(F.ln(total.cast("double")) - _n_ln_n() / total, F.lit(0.0)), F.lit(0.0)).alias("entropy"))


def mutual_information(df: DataFrame, child: str, parents: list[str]) -> DataFrame:
    """One row: the mutual information of a column with several others taken together, in nats, not below 0."""
    child_col, given = F.col(f"`{child}`").alias("x"), [F.col(f"`{p}`").alias(f"y{k}") for k, p in enumerate(parents)]
    joint = df.groupBy(child_col, *given).agg(F.count("*").alias("n"))
    sides = [joint] + [joint.groupBy(*names).agg(F.sum("n").alias("n")) for names in (["x"], [f"y{k}" for k in range(len(parents))])]
    sums = [side.agg(F.lit(k).alias("k"), F.sum("n").alias("t"), _n_ln_n().alias("s")) for k, side in enumerate(sides)]
    all_ = sums[0].unionByName(sums[1]).unionByName(sums[2])
    mi = F.ln(F.max("t").cast("double")) + F.sum(F.when(F.col("k") == 0, F.col("s")).otherwise(-F.col("s"))) / F.max("t")
    return all_.agg(F.greatest(F.coalesce(mi, F.lit(0.0)), F.lit(0.0)).alias("mi"))


def nmi_matrix(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(x, y, nmi) for all ordered pairs of columns; 1 on the diagonal and where both are constant.

    One job: rows are first collapsed to distinct tuples, those give pair counts, and a pair's entropy
    is one sum over its counts. A column paired with itself has its own entropy, and the information
    of two is H(x) + H(y) - H(x, y).
    """
    names = sorted(names or df.columns)
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(MISSING)).alias(f"c{k}") for k, c in enumerate(names)]
    tuples = df.groupBy(*cells).agg(F.count("*").alias("n"))
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{a}").alias("x"), F.col(f"c{b}").alias("y")) for a, b in combinations_with_replacement(range(len(names)), 2)]
    joint = tuples.select(F.explode(F.array(*pairs)).alias("p"), "n").groupBy("p.a", "p.b", "p.x", "p.y").agg(F.sum("n").alias("n"))
    total = F.sum("n")
    both = joint.groupBy("a", "b").agg((F.ln(total.cast("double")) - _n_ln_n() / total).alias("h"))
    own = both.where("a = b").select(F.col("a").alias("k"), F.col("h").alias("own"))  # a row for each column
    sides = both.join(own.select(F.col("k").alias("a"), F.col("own").alias("ha")), "a").join(own.select(F.col("k").alias("b"), F.col("own").alias("hb")), "b")
    mi = sides.withColumn("mi", F.col("ha") + F.col("hb") - F.col("h"))
    low = F.lit(1e-15)
    nmi = F.when((F.col("a") == F.col("b")) | ((F.col("ha") < low) & (F.col("hb") < low)), 1.0).otherwise(F.greatest(F.coalesce(F.try_divide(2 * F.col("mi"), F.col("ha") + F.col("hb")), F.lit(0.0)), F.lit(0.0)))
    upper = mi.select("a", "b", nmi.alias("nmi"))
    full = upper.unionByName(upper.where("a != b").select(F.col("b").alias("a"), F.col("a").alias("b"), "nmi"))
    known = F.array(*[F.lit(n) for n in names])
    return full.select(F.get(known, F.col("a")).alias("x"), F.get(known, F.col("b")).alias("y"), F.col("a").cast("long").alias("x_idx"), F.col("b").cast("long").alias("y_idx"), "nmi")


def nmi_difference(a: DataFrame, b: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row: the sum of absolute differences of two tables' matrices."""
    other = nmi_matrix(b, names).select("x", "y", F.col("nmi").alias("other"))
    return nmi_matrix(a, names).join(other, ["x", "y"]).agg(F.sum(F.abs(F.col("nmi") - F.col("other"))).alias("nmi_difference"))


def aligned_counts(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """(value, n_a, n_b) of a column in two tables, 0 where one has none; nulls do not count."""

    def counts(df: DataFrame, out: str) -> DataFrame:
        return df.select(F.col(f"`{name}`").cast("string").alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias(out))

    both = counts(a, "n_a").join(counts(b, "n_b"), "value", "full_outer")
    return both.select("value", F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))


def kl_divergence(original: DataFrame, synthetic: DataFrame, name: str) -> DataFrame:
    """One row: KL(synthetic || original) in nats; infinite if a synthetic value is not in the original."""
    both, ratio = aligned_counts(original, synthetic, name), F.col("n_b").cast("double") / F.col("n_a")
    term = F.when(F.col("n_b") > 0, F.when(F.col("n_a") > 0, F.col("n_b") * F.ln(ratio)).otherwise(F.lit(float("inf"))))
    na, nb = F.sum("n_a").cast("double"), F.sum("n_b").cast("double")
    return both.agg(F.when(nb > 0, F.coalesce(F.try_divide(F.sum(term), nb) + F.ln(F.try_divide(na, nb)), F.lit(float("inf")))).alias("kl"))


def ks_statistic(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """One row: the two-sample Kolmogorov-Smirnov statistic of a numerical column, nulls left out.

    Values are counted first, so the ordered pass is over distinct values, by ranges of them.
    """
    x = F.col(f"`{name}`").cast("double")
    counts = a.select(x.alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(x.alias("x"), F.lit(0).alias("a"), F.lit(1).alias("b"))).where("x is not null")
    counts = kept(counts.groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    na, nb, size = counts.agg(F.sum("a"), F.sum("b"), F.count("*")).first()
    far = F.abs(F.col("upto_a") / float(na or 1) - F.col("upto_b") / float(nb or 1))
    return running(counts, ["x"], {"upto_a": "a", "upto_b": "b"}, rows=size).agg(F.max(far).alias("ks"))


def rounded(column: Column, digits: int = 9) -> Column:
    return F.round(column, digits)
