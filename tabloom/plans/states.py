"""Written states of recipes, found again by what they were made of.

The address of a state is the table a recipe starts from and the steps that led to it, merged recipes
included, so two recipes share the states of their common beginning: a fork starts at the longest
prefix that has been written. States live as long as their store; the files go when the driver ends.
A store must not outlive a change of the tables it was filled from.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, types as T

from tabloom.functions.scratch import written


@dataclass
class States:
    """States by the digest of their steps; equal steps are told apart by the plans of their sources."""

    _kept: dict[str, list[tuple[DataFrame, DataFrame, tuple]]] = field(default_factory=dict)
    written: int = 0

    def find(self, source: DataFrame, address: str) -> tuple[DataFrame, tuple] | None:
        """The state and the fitted steps behind an address."""
        for known, state, fitted in self._kept.get(address, ()):
            if known.sameSemantics(source):
                return state, fitted
        return None

    def write(self, source: DataFrame, address: str, df: DataFrame, fitted: tuple) -> DataFrame:
        state = written(df, "recipe-state")
        self.written += 1
        self._kept.setdefault(address, []).append((source, state, fitted))
        return state


def storable(df: DataFrame) -> bool:
    """Whether parquet has a form for every column's type."""
    return not any(isinstance(f.dataType, (T.NullType, T.CalendarIntervalType)) for f in df.schema.fields)


def addresses(steps: list[Any]) -> list[str]:
    """The address of each prefix: entry i is that of the first i steps, each chained to the one before.
    A step is anything JSON can say."""
    out = [hashlib.sha256(b"").hexdigest()]
    for step in steps:
        out.append(hashlib.sha256((out[-1] + json.dumps(step, sort_keys=True, default=str)).encode()).hexdigest())
    return out
