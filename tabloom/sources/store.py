"""Models in a folder of any file system that Spark knows: JSON for what is small, Parquet tables for what grows.

``model`` has the JSON as text; ``conditional`` the conditional probabilities of a network, a file
set for each of its columns, so that a child's table is read alone; ``dictionary`` the categories of
each column that has very many. Reading opens the tables and reads none of their rows: they are joined
from where they lie.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from tabloom.operators import cpt
from tabloom.operators.dictionary import Dictionary, kind_of
from tabloom.plans.model import TableModel


def conditional_frame(spark: SparkSession, model: TableModel) -> DataFrame:
    """(place, given, code, p) of a model's network, whether it has tables or lists."""
    if model.tables is not None:
        return model.tables
    rows = [(child, codes, k, float(p)) for child in model.sampling_order for codes, ps in model.conditional[child] for k, p in enumerate(ps)]
    listed = spark.createDataFrame(rows, "child string, parent_codes array<int>, code int, p double")
    return cpt.numbered(listed, model.network, {n: model.codes_of(n) for n in model.sampling_order})


def write_model(spark: SparkSession, model: TableModel, folder: str) -> None:
    """Write a model; the folder must not have one."""
    large = {c.name: c.dictionary for c in model.columns.values() if c.dictionary}
    text = model.to_json()
    text.pop("conditional_probabilities", None)
    text["dictionaries"] = {n: {"place": k, "size": d.size, "total": d.total} for k, (n, d) in enumerate(large.items())}
    for k, d in enumerate(large.values()):
        d.table.write.parquet(f"{folder}/dictionary/{k}")
    if model.network:
        tables = conditional_frame(spark, model)  # the root's rows are all of one ``given``
        tables.repartition("place", "given", "code").write.partitionBy("place").parquet(f"{folder}/conditional")
    spark.createDataFrame([(json.dumps(text, default=str),)], "value string").coalesce(1).write.text(f"{folder}/model")


def read_model(spark: SparkSession, folder: str) -> TableModel:
    """A model that was written by ``write_model``."""
    text = json.loads("\n".join(r.value for r in spark.read.text(f"{folder}/model").collect()))
    model = TableModel.from_json(text)
    for name, d in text["dictionaries"].items():
        kind = kind_of(model.columns[name].data_type)
        table = spark.read.schema(f"code bigint, value {kind}, p double, weight bigint, upto bigint").parquet(f"{folder}/dictionary/{d['place']}")
        model.columns[name].dictionary = Dictionary(table, d["size"], d["total"])
    if model.network:
        model.tables = spark.read.schema("given bigint, code int, p double, place int").parquet(f"{folder}/conditional").select("place", "given", "code", "p")
    return model
