"""Contingency tables over full code spaces and conditional probability tables, exact or noisy.

A code space is a range of numbers whose mixed-radix digits are the codes, so it is made in
parallel without a product of tables; its size is checked first. Counts come from distinct tuples.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.rng import laplace, uniform
from tabloom.operators.distribution import normalized

#: Cells of a network's tables that a model holds as lists; more stay a table.
LISTED = 200_000
#: Cells that one task joins and sums, about.
IN_TASK = 250_000
#: Cells are numbered by 64 bits.
MOST_CELLS = 1 << 62


def code_space(df: DataFrame, cards: dict[str, int]) -> DataFrame:
    """All combinations of codes of some columns, made in parallel from their numbers."""
    cells = math.prod(cards.values())
    if cells > MOST_CELLS:
        raise ValueError(f"{cells} cells in the space of {', '.join(cards)} cannot be numbered")
    out, stride = [], cells
    for name, card in cards.items():
        stride //= card
        out.append((F.expr(f"id div {stride}") % card).cast("int").alias(name))
    return df.sparkSession.range(cells).select(*out)


def noise_of_counts(attributes: int, parents: int, epsilon: float) -> float:
    """The Laplace scale of the counts of a table of one child and its parents."""
    return (attributes - parents) / epsilon


def joint_counts(tuples: DataFrame, cards: dict[str, int], epsilon: float = 0.0, attributes: int = 0, seed: object = 0, stream: str = "cpt") -> DataFrame:
    """(codes, count) over the full space; 0 where nothing was seen, noisy and cut at 0 with epsilon."""
    names = list(cards)
    seen = tuples.groupBy(*[F.col(f"`{c}`").cast("int").alias(c) for c in names]).agg(F.sum("n").cast("double").alias("count"))
    space, parts = code_space(tuples, cards), math.prod(cards.values()) // IN_TASK
    if parts:  # a task has so many cells at any size
        space, seen = [x.repartition(parts + 1, *names) for x in (space, seen)]
    full = space.join(seen, names, "left").withColumn("count", F.coalesce("count", F.lit(0.0)))
    if not epsilon:
        return full
    noise = laplace(uniform(seed, stream, *[F.col(f"`{c}`") for c in names]), noise_of_counts(attributes, len(names) - 1, epsilon))
    return full.withColumn("count", F.greatest(F.col("count") + noise, F.lit(0.0)))


def marginal(joint: DataFrame, names: list[str], cells: int = 0) -> DataFrame:
    """Counts over some of a joint table's columns; ``cells`` is how many these have, if that may be many."""
    if parts := cells // IN_TASK:  # as full spaces are even, so are these; sums before the shuffle would hold as many
        joint = joint.repartition(parts + 1, *[F.col(f"`{c}`") for c in names])
    return joint.groupBy(*[F.col(f"`{c}`") for c in names]).agg(F.sum("count").alias("count"))


def conditional(joint: DataFrame, child: str, parents: list[str]) -> DataFrame:
    """(child, parent_codes, code, p) from counts over parents and child; an instance never seen is uniform."""
    given = F.array(*[F.col(f"`{p}`").cast("int") for p in parents]) if parents else F.expr("cast(array() as array<int>)")
    rows = joint.select(F.lit(child).alias("child"), given.alias("parent_codes"), F.col(f"`{child}`").alias("code"), F.col("count"))
    if parents:
        return rows.withColumn("p", normalized(F.col("count"), Window.partitionBy("parent_codes"))).select("child", "parent_codes", "code", "p")
    # All rows are of one instance: their sum comes from an aggregation, as a window would put them all in one task.
    count = F.greatest("count", F.lit(0.0))
    whole = F.broadcast(joint.agg(F.sum(count).alias("total"), F.count("*").alias("codes")))
    p = F.when(F.col("total") > 0, F.try_divide(count, F.col("total"))).otherwise(F.lit(1.0) / F.col("codes"))
    return rows.crossJoin(whole).select("child", "parent_codes", "code", p.alias("p"))


def tables(tuples: DataFrame, network: list[tuple[str, list[str]]], cards: dict[str, int], epsilon: float = 0.0, seed: object = 0, shared: DataFrame | None = None) -> DataFrame:
    """The conditional tables of a whole network; the root's has no parents.

    The root and the first k children, k being the largest number of parents, share one noisy joint
    table, which is part of the privacy budget; each later child has one of its own.
    """
    root, k = network[0][1][0], len(network[-1][1])
    d = len(cards)
    shared_names = [root, *[c for c, _ in network[:k]]]
    shared = joint_counts(tuples, {c: cards[c] for c in shared_names}, epsilon, d, seed, f"cpt:{root}") if shared is None else shared
    parts = [conditional(marginal(shared, [root], cards[root]), root, [])]
    for i, (child, parents) in enumerate(network):
        names = [*parents, child]
        own = marginal(shared, names, math.prod(cards[c] for c in names)) if i < k else joint_counts(tuples, {c: cards[c] for c in names}, epsilon, d, seed, f"cpt:{child}")
        parts.append(conditional(own, child, parents))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fitted(tuples: DataFrame, network: list[tuple[str, list[str]]], cards: dict[str, int], epsilon: float = 0.0, seed: object = 0) -> dict[str, list[tuple[list[int], list[float]]]]:
    """The tables as plain data; the shared joint table is kept while they are made, and only then."""
    root, k = network[0][1][0], len(network[-1][1])
    names = [root, *[c for c, _ in network[:k]]]
    shared = joint_counts(tuples, {c: cards[c] for c in names}, epsilon, len(cards), seed, f"cpt:{root}").persist()
    try:
        return collected(tables(tuples, network, cards, epsilon, seed, shared))
    finally:
        shared.unpersist()


def collected(cpt: DataFrame) -> dict[str, list[tuple[list[int], list[float]]]]:
    """The tables as plain data for a model."""
    rows = cpt.groupBy("child", "parent_codes").agg(F.array_sort(F.collect_list(F.struct("code", "p"))).alias("x")).orderBy("child", "parent_codes").collect()
    out: dict[str, list] = {}
    for r in rows:
        out.setdefault(r["child"], []).append((list(r["parent_codes"]), [x["p"] for x in r["x"]]))
    return out


def cells(network: list[tuple[str, list[str]]], cards: dict[str, int]) -> int:
    """Cells of all tables of a network, and of the joint table that the first ones share."""
    k = len(network[-1][1])
    shared = [network[0][1][0], *[c for c, _ in network[:k]]]
    return max(math.prod(cards[c] for c in shared), cards[shared[0]] + sum(math.prod(cards[c] for c in (child, *ps)) for child, ps in network))


def given(codes: list[Column], cards: list[int]) -> Column:
    """The number whose digits are some parents' codes."""
    out = F.lit(0).cast("bigint")
    for code, card in zip(codes, cards, strict=True):
        out = out * card + code
    return out


def numbered(cpt: DataFrame, network: list[tuple[str, list[str]]], cards: dict[str, int]) -> DataFrame:
    """(place, given, code, p): the tables with columns as places in the order of sampling and parents' codes as one number."""
    place, number = F.lit(0), F.lit(0).cast("bigint")
    for k, (child, parents) in enumerate(network):
        own = F.col("child") == child
        place = F.when(own, k + 1).otherwise(place)
        number = F.when(own, given([F.get("parent_codes", i) for i in range(len(parents))], [cards[p] for p in parents])).otherwise(number)
    return cpt.select(place.cast("int").alias("place"), number.alias("given"), F.col("code").cast("int").alias("code"), "p")


def spelled(tables: DataFrame, network: list[tuple[str, list[str]]], cards: dict[str, int]) -> DataFrame:
    """(child, parent_codes, code, p): the same with names and codes again."""
    order = [network[0][1][0], *[c for c, _ in network]]
    codes = F.expr("cast(array() as array<int>)")
    for k, (_, parents) in enumerate(network):
        digits, stride = [], math.prod(cards[p] for p in parents)
        for p in parents:
            stride //= cards[p]
            digits.append((F.expr(f"given div {stride}") % cards[p]).cast("int"))
        codes = F.when(F.col("place") == k + 1, F.array(*digits)).otherwise(codes)
    return tables.select(F.get(F.array(*[F.lit(n) for n in order]), F.col("place")).alias("child"), codes.alias("parent_codes"), "code", "p")
