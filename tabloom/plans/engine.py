"""End to end: describe a table, generate from its model, inspect the result."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tabloom.operators import bayesnet, cpt, distribution, generate, report
from tabloom.operators.encode import encode
from tabloom.operators.profile import THRESHOLD, profile
from tabloom.plans.model import TableModel
from tabloom.sources.tables import drop_empty_columns, kept

MODES = ("random", "independent", "correlated")


@dataclass
class Config:
    """What a job needs beside the table; the defaults are those of the stated operators."""

    mode: str = "correlated"
    rows: int | None = None
    bins: int | str = distribution.BINS
    threshold: int = THRESHOLD
    epsilon: float = 0.1
    degree: int | None = None
    root: str | None = None
    seed: object = 0
    #: "whole": distributions with epsilon, structure and tables with half of it each. "shared": all within epsilon.
    budget: str = "whole"
    types: dict[str, str] = field(default_factory=dict)
    categorical: dict[str, bool] = field(default_factory=dict)
    keys: dict[str, bool] = field(default_factory=dict)
    ranges: dict[str, tuple] = field(default_factory=dict)
    domains: dict[str, list] = field(default_factory=dict)


def describe(df: DataFrame, config: Config | None = None, **options: object) -> TableModel:
    """A model of a table in one of the three modes. Columns without values are left out.

    ``epsilon_spent`` tells what each part spent on noise. Row count, domains, missing rates and
    flags are published as they are, so the sum is no guarantee for the whole model.
    """
    c = config or Config(**options)
    if c.mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    df = drop_empty_columns(df)
    categorical = {**{n: True for n in c.domains}, **c.categorical}
    model = profile(df, c.threshold, c.types, categorical, c.keys, c.ranges)
    if c.mode == "random":
        return distribution.uniform_domain(model, df, c.domains)
    distribution.fit(df, model, c.bins, c.domains)
    if c.mode == "independent":
        model.epsilon_spent = {"distributions": c.epsilon} if c.epsilon > 0 else {}
        return distribution.add_noise(model, df, c.epsilon, c.seed)
    part = c.epsilon / 3 if c.budget == "shared" else c.epsilon / 2
    one = c.epsilon / 3 if c.budget == "shared" else c.epsilon
    if len(model.network_attributes) < 2:
        raise ValueError("correlated mode needs two columns that are neither keys nor free text")
    coded = encode(df, model)
    tuples = bayesnet.collapsed(coded).persist()
    try:
        cards = {n: model.codes_of(n) for n in model.network_attributes}
        model.network = bayesnet.learn(coded, c.degree, part, c.seed, c.root, tuples)
        if cpt.cells(model.network, cards) <= cpt.LISTED:
            model.conditional = cpt.fitted(tuples, model.network, cards, part, c.seed)
        else:
            model.tables = kept(cpt.numbered(cpt.tables(tuples, model.network, cards, part, c.seed), model.network, cards))
    finally:
        tuples.unpersist()
    distribution.add_noise(model, df, one, c.seed)
    if c.epsilon > 0:
        model.epsilon_spent = {"distributions": one, "structure": part, "tables": part}
    return model


def sample(spark: SparkSession, model: TableModel, n: int | None = None, mode: str | None = None, seed: object = 0, **options: object) -> DataFrame:
    """A table of n rows (as many as the original by default) from a model."""
    n = model.num_tuples if n is None else n
    mode = mode or ("correlated" if model.network else "independent")
    rows = generate.rows_of(spark, n)
    made = {"random": generate.random_mode, "independent": generate.independent_mode, "correlated": generate.correlated_mode}[mode]
    return made(rows, n, model, seed, **options)


def run(df: DataFrame, config: Config) -> tuple[TableModel, DataFrame, dict[str, DataFrame]]:
    """Model, synthetic table and comparisons of one job."""
    model = describe(df, config)
    made = sample(df.sparkSession, model, config.rows, config.mode, config.seed)
    return model, made, report.inspect(df, made, model)
