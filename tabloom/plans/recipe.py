"""Recipes: an ordered list of steps replayed over a table as one lazy plan.

A step that depends on the data (mean fill, scaling, encoding, outliers) is fit
first: its statistics become literals, never a joined-in sub-plan, so a long
recipe stays one chain of projections and filters. Neighbouring steps that look
at different columns are fit together in one pass. Where several fits lie behind a
filter or a join, the state before them is written once, so that fits do not run the
steps before them again; recipes of one library share the states of a common prefix.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from tabloom.functions.stats import Need, fit
from tabloom.operators import encode, prepare, project
from tabloom.operators.merge import UNSPLIT, HotKeys, find_hot_keys, merge
from tabloom.plans.states import States, addresses, storable


@dataclass(frozen=True)
class Step:
    operation_type: str
    parameters: dict[str, Any]

    @classmethod
    def from_json(cls, operation_type: str, parameters: str) -> Step:
        return cls(operation_type, json.loads(parameters))


@dataclass
class Library:
    """Where merges find other tables: ``datasets`` by id, and the dataset and
    steps of each version by version id; and the states its recipes have written."""

    datasets: dict[Any, DataFrame | Callable[[], DataFrame]] = field(default_factory=dict)
    versions: dict[Any, tuple[Any, list[Step]]] = field(default_factory=dict)
    states: States = field(default_factory=States)

    def dataset(self, dataset_id: Any) -> DataFrame:
        if dataset_id not in self.datasets:
            raise KeyError(f"unknown dataset {dataset_id!r}")
        found = self.datasets[dataset_id]
        return found() if callable(found) else found

    def steps(self, dataset_id: Any, version_id: Any) -> list[Step]:
        if version_id not in self.versions or self.versions[version_id][0] != dataset_id:
            raise KeyError(f"dataset {dataset_id!r} has no version {version_id!r}")
        return self.versions[version_id][1]


@dataclass(frozen=True)
class Context:
    library: Library
    open_merges: tuple[tuple[Any, Any], ...] = ()


Learn = Callable[[DataFrame, dict[str, Any], Context], Any]
Apply = Callable[[DataFrame, dict[str, Any], Any], DataFrame]


@dataclass(frozen=True)
class Operation:
    """How one operation type works.

    ``needs`` lists statistics of the input table; ``learn`` covers knowledge
    that is not a statistic. ``apply`` gets either result. ``writes`` names the
    columns the step changes if that is all it does; None ends a batch of fits.
    """

    apply: Apply
    needs: Callable[[dict[str, Any]], list[Need]] | None = None
    learn: Learn | None = None
    writes: Callable[[dict[str, Any]], list[str]] | None = None


def _fill_apply(df: DataFrame, p: dict[str, Any], fitted: Any) -> DataFrame:
    if p["method"] == "Specific Value":
        return prepare.fill_value(df, p["column"], p["value"])
    return prepare.apply_fill(df, [p["column"]], p["method"], fitted)


def _fill_needs(p: dict[str, Any]) -> list[Need]:
    return [] if p["method"] == "Specific Value" else prepare.fill_needs([p["column"]], p["method"])


_OUTLIER_OPTIONS = ("interpolation", "ddof", "one_sided")


def _outlier_needs(p: dict[str, Any]) -> list[Need]:
    options = {k: p[k] for k in ("interpolation", "ddof") if k in p}
    return prepare.outlier_needs(p["column"], p["method"], **options)


def _outlier_apply(df: DataFrame, p: dict[str, Any], fitted: Any) -> DataFrame:
    options = {k: p[k] for k in _OUTLIER_OPTIONS if k in p}
    return prepare.apply_outliers(df, p["column"], p["method"], fitted, **options)


ONE_HOT = "OneHotEncoding"


def _encode_learn(df: DataFrame, p: dict[str, Any], context: Context) -> Any:
    if p["type"] == ONE_HOT:
        return encode.one_hot_categories(df, p["columns"], p.get("max_categories"))
    return {c: encode.label_codes(df, c) for c in p["columns"]}


def _encode_apply(df: DataFrame, p: dict[str, Any], learned: Any) -> DataFrame:
    if p["type"] == ONE_HOT:
        return encode.apply_one_hot(df, learned)
    for column, codes in learned.items():
        df = encode.apply_label_codes(df, column, codes)
    return df


def _merge_learn(df: DataFrame, p: dict[str, Any], context: Context) -> tuple[DataFrame, HotKeys]:
    target = (p["merge_with"], p["merge_version"])
    if target in context.open_merges:
        raise ValueError(f"merge cycle through dataset {target[0]!r}, version {target[1]!r}")
    inner = Context(context.library, (*context.open_merges, target))
    other = _run(context.library.dataset(target[0]), context.library.steps(*target), inner)[0]
    return other, find_hot_keys(df, other, p["join_column"], UNSPLIT.get(p["join_type"], ()))


def _merge_apply(df: DataFrame, p: dict[str, Any], learned: tuple[DataFrame, HotKeys]) -> DataFrame:
    other, hot = learned
    return merge(df, other, p["join_column"], p["join_type"], hot_keys=hot)


# The 14 operation types, by the names stored in operation logs
OPERATIONS: dict[str, Operation] = {
    "Rename Column": Operation(lambda df, p, _: project.rename_column(df, p["old_name"], p["new_name"])),
    "Change Data Type": Operation(
        lambda df, p, _: project.change_type(df, p["column"], p["new_type"]), writes=lambda p: [p["column"]]
    ),
    "Delete Column": Operation(lambda df, p, _: project.delete_columns(df, p["columns"])),
    "Filter Rows": Operation(lambda df, p, _: project.filter_rows(df, p["condition"])),
    "Add Calculated Column": Operation(
        lambda df, p, _: project.add_calculated_column(df, p["new_column"], p["formula"]),
        writes=lambda p: [p["new_column"]],
    ),
    "Fill Missing Values": Operation(_fill_apply, needs=_fill_needs, writes=lambda p: [p["column"]]),
    "Duplicate Column": Operation(
        lambda df, p, _: project.duplicate_column(df, p["column"]), writes=lambda p: [f"{p['column']}_duplicate"]
    ),
    "Reorder Columns": Operation(lambda df, p, _: project.reorder_columns(df, p["new_order"])),
    "Replace Values": Operation(
        lambda df, p, _: project.replace_values(df, p["column"], p["to_replace"], p["replace_with"]),
        writes=lambda p: [p["column"]],
    ),
    "Scale Data": Operation(
        lambda df, p, fitted: prepare.apply_scale(df, p["columns"], p["method"], fitted),
        needs=lambda p: prepare.scale_needs(p["columns"], p["method"]),
        writes=lambda p: p["columns"],
    ),
    "Encode Data": Operation(_encode_apply, learn=_encode_learn),
    "Impute Missing Values": Operation(
        lambda df, p, fitted: prepare.apply_fill(df, p["columns"], p["method"], fitted),
        needs=lambda p: prepare.fill_needs(p["columns"], p["method"]),
        writes=lambda p: p["columns"],
    ),
    "Remove Outliers": Operation(_outlier_apply, needs=_outlier_needs),
    "Merge Datasets": Operation(_merge_apply, learn=_merge_learn),
}
OPERATIONS["Encode Categorical Variables"] = OPERATIONS["Encode Data"]  # the name its form shows


#: Steps that drop rows
FILTERS = ("Filter Rows", "Remove Outliers")


def operation(step: Step) -> Operation:
    if step.operation_type not in OPERATIONS:
        raise ValueError(f"unknown operation '{step.operation_type}'; choose one of {sorted(OPERATIONS)}")
    return OPERATIONS[step.operation_type]


@dataclass(frozen=True)
class FittedStep:
    step: Step
    learned: Any

    def apply(self, df: DataFrame) -> DataFrame:
        return operation(self.step).apply(df, self.step.parameters, self.learned)


@dataclass(frozen=True)
class FittedRecipe:
    """A recipe with its statistics bound: applies to new rows without looking at them."""

    steps: tuple[FittedStep, ...]

    def apply(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step.apply(df)
        return df


def _batch(steps: list[Step], start: int) -> int:
    """End of the run of steps whose statistics can all be taken before the first of them."""
    written: set[str] = set()
    for i in range(start, len(steps)):
        op, p = operation(steps[i]), steps[i].parameters
        if op.learn or any(need[1] in written for need in (op.needs(p) if op.needs else [])):
            return i
        if op.writes is None:
            return i + 1 if op.needs else i
        written.update(op.writes(p))
    return len(steps)


def _fits(steps: list[Step], start: int) -> int:
    """Times the steps from ``start`` on look at the table they get."""
    count, ready_until = 0, start
    for i in range(start, len(steps)):
        op, p = operation(steps[i]), steps[i].parameters
        if op.apply is _merge_apply:
            count += bool(UNSPLIT.get(p["join_type"]))
        elif op.learn:
            count += len(p["columns"])
        elif op.needs and op.needs(p) and i >= ready_until:
            ready_until = _batch(steps, i)
            count += 1
    return count


def _described(steps: list[Step], library: Library, open_merges: tuple = ()) -> list[Any]:
    """Steps as JSON, a merge with the steps of the other side."""
    out = []
    for step in steps:
        p = step.parameters
        inner: Any = None
        if operation(step).apply is _merge_apply:
            target = (p["merge_with"], p["merge_version"])
            known = library.versions.get(target[1])
            if known and known[0] == target[0] and target not in open_merges:
                inner = _described(known[1], library, (*open_merges, target))
        out.append([step.operation_type, p, inner])
    return out


def _run(df: DataFrame, steps: list[Step], context: Context) -> tuple[DataFrame, FittedRecipe]:
    for step in steps:
        operation(step)  # unknown names fail before anything runs
    source, states = df, context.library.states
    address = addresses(_described(steps, context.library, context.open_merges))
    done: list[FittedStep] = []
    first, saved = 0, False
    for n in range(len(steps), 0, -1):
        found = states.find(source, address[n])
        if found:
            df, done, first, saved = found[0], list(found[1]), n, True
            break
    filtered = joined = False
    ready_until, statistics = 0, {}
    for i, step in enumerate(steps[first:], first):
        op, p = operation(step), step.parameters
        learned: Any = None
        fits_here = bool(op.learn and op.apply is not _merge_apply) or bool(op.needs and op.needs(p) and i >= ready_until)
        if fits_here and (joined or (filtered and not saved)) and _fits(steps, i) > 1 and storable(df):
            df = states.write(source, address[i], df, tuple(done))
            filtered, joined, saved = False, False, True
        if op.learn:
            learned = op.learn(df, p, context)
        elif op.needs and op.needs(p):
            if i >= ready_until:
                ready_until = _batch(steps, i)
                batch = [(operation(s), s.parameters) for s in steps[i:ready_until]]
                statistics = fit(df, [n for o, q in batch if o.needs for n in o.needs(q)])
            learned = {n: statistics[n] for n in op.needs(p)}
        fitted = FittedStep(step, learned)
        df = fitted.apply(df)
        done.append(fitted)
        joined = joined or op.apply is _merge_apply
        filtered = filtered or step.operation_type in FILTERS
    return df, FittedRecipe(tuple(done))


def replay(df: DataFrame, steps: Iterable[Step], library: Library | None = None) -> DataFrame:
    """Run the steps over ``df``; unknown operations and missing columns raise."""
    return _run(df, list(steps), Context(library or Library()))[0]


def fit_recipe(df: DataFrame, steps: Iterable[Step], library: Library | None = None) -> FittedRecipe:
    """Learn what the steps need from ``df``, for use on other rows."""
    return _run(df, list(steps), Context(library or Library()))[1]


def replay_version(library: Library, dataset_id: Any, version_id: Any) -> DataFrame:
    """A stored version of a stored dataset."""
    context = Context(library, ((dataset_id, version_id),))
    return _run(library.dataset(dataset_id), library.steps(dataset_id, version_id), context)[0]
