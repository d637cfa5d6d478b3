"""Inference placement: filters that don't need a model's output run first, equal calls share one column, the rest run after."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from ..models import runtime


@dataclass(frozen=True)
class Call:
    """A model call in a query: the model, and its input columns by name or SQL expression."""

    model: runtime.Model
    inputs: tuple[str, ...]
    volatile: bool = False

    @property
    def column(self) -> str:
        said = repr((self.model.fingerprint, self.inputs))
        return "__fw_inf_" + hashlib.sha256(said.encode()).hexdigest()[:16]


def infer(df: DataFrame, calls: list[Call], before: list[Column] = (), after: list[Column] = (), strict: bool = False) -> tuple[DataFrame, list[str]]:
    """df with a column for each distinct call, and the column of every call in order.

    before: conditions that read no model output, applied below the models; after: those that do. A volatile call
    or model never shares its column.
    """
    from pyspark.sql import functions as F

    for condition in before:
        df = df.where(condition)
    names, made = [], {}
    for k, c in enumerate(calls):
        name = f"{c.column}_{k}" if c.volatile or c.model.volatile else c.column
        if name not in made:
            made[name] = runtime.call(c.model, strict)(*[F.expr(i) for i in c.inputs])
        names.append(name)
    if made:
        df = df.withColumns(made)
    for condition in after:
        df = df.where(condition)
    return df, names
