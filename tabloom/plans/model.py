"""The model of a table: plain data on the driver, stored as JSON. Its size follows columns and bins, not rows.

What would be large stays a table: the dictionary of a column with very many categories, and the
conditional probabilities of a network with very many cells. ``sources.store`` writes both as Parquet
beside the JSON.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from pyspark.sql import DataFrame

    from tabloom.operators.dictionary import Dictionary

#: Categories that a column has as a list; with more it has a dictionary.
IN_PLAN = 1000


@dataclass
class ColumnModel:
    """One column: its flags, domain and one-dimensional distribution."""

    name: str
    data_type: str
    is_categorical: bool
    is_candidate_key: bool
    n_distinct: int = 0
    non_null: int = 0
    missing_rate: float = 0.0
    min: float | int | None = None
    max: float | int | None = None
    distribution_bins: list = field(default_factory=list)
    distribution_probabilities: list = field(default_factory=list)
    dictionary: Dictionary | None = field(default=None, repr=False, compare=False)

    @property
    def size(self) -> int:
        """Its categories or bins."""
        return self.dictionary.size if self.dictionary else len(self.distribution_bins)

    def to_json(self) -> dict:
        names = ("name", "data_type", "is_categorical", "is_candidate_key", "min", "max", "missing_rate", "distribution_bins", "distribution_probabilities")
        return {k: getattr(self, k) for k in names}

    @classmethod
    def from_json(cls, x: dict) -> ColumnModel:
        return cls(**x)


@dataclass
class TableModel:
    """A table: its columns, and in correlated mode the network and its conditional probabilities.

    ``network`` lists (child, parents) in the order of sampling; the root is parents[0] of the first.
    ``conditional`` has for each attribute rows of (codes of its parents, probabilities by code), or
    ``tables`` has them all as rows (place in the order of sampling, given, code, p), where ``given`` is
    the number whose digits are the parents' codes.
    """

    num_tuples: int
    columns: dict[str, ColumnModel]
    network: list[tuple[str, list[str]]] = field(default_factory=list)
    conditional: dict[str, list[tuple[list[int], list[float]]]] = field(default_factory=dict)
    epsilon_spent: dict[str, float] = field(default_factory=dict)
    tables: DataFrame | None = field(default=None, repr=False, compare=False)

    def codes_of(self, name: str) -> int:
        """The codes of a column of the network: its bins, and one for missing values if there are any."""
        c = self.columns[name]
        return c.size + (c.missing_rate > 0)

    @property
    def sampling_order(self) -> list[str]:
        """The root of the network and its children."""
        return [self.network[0][1][0], *[c for c, _ in self.network]] if self.network else []

    @property
    def network_attributes(self) -> list[str]:
        """Columns that a network may hold, in the order of the table."""
        return [c.name for c in self.columns.values() if not c.is_candidate_key and (c.is_categorical or c.data_type != "String")]

    def meta(self) -> dict:
        names = list(self.columns)
        return {
            "num_tuples": self.num_tuples,
            "num_attributes": len(names),
            "num_attributes_in_BN": len(self.network_attributes),
            "all_attributes": names,
            "candidate_keys": [n for n in names if self.columns[n].is_candidate_key],
            "non_categorical_string_attributes": [n for n in names if self.columns[n].data_type == "String" and not self.columns[n].is_categorical],
            "attributes_in_BN": self.network_attributes,
        }

    def to_json(self) -> dict:
        out = {"meta": self.meta(), "attribute_description": {n: c.to_json() for n, c in self.columns.items()}}
        if self.network:
            out["bayesian_network"] = [[child, parents] for child, parents in self.network]
        if self.conditional:
            out["conditional_probabilities"] = {a: [[codes, p] for codes, p in rows] for a, rows in self.conditional.items()}
        return out | {"epsilon_spent": self.epsilon_spent} if self.epsilon_spent else out

    @classmethod
    def from_json(cls, x: dict) -> TableModel:
        columns = {n: ColumnModel.from_json(c) for n, c in x["attribute_description"].items()}
        conditional = {a: [(list(codes), list(p)) for codes, p in rows] for a, rows in x.get("conditional_probabilities", {}).items()}
        return cls(x["meta"]["num_tuples"], columns, [(c, list(p)) for c, p in x.get("bayesian_network", [])], conditional, x.get("epsilon_spent", {}))

    def save(self, path: str) -> None:
        if self.tables is not None or any(c.dictionary for c in self.columns.values()):
            raise ValueError("this model has tables; write it with sources.store.write_model")
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.to_json(), f, indent=4, default=str)

    @classmethod
    def load(cls, path: str) -> TableModel:
        with open(path, encoding="utf-8") as f:
            return cls.from_json(json.load(f))

    def show(self) -> None:
        print(json.dumps(self.to_json(), indent=4, default=str))

    def show_network(self) -> None:
        width = max((len(c) for c, _ in self.network), default=0)
        for child, parents in self.network:
            print(f"{child:<{width}} <- {', '.join(parents)}")
