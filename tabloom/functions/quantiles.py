"""Exact order statistics without sorting a table or holding a column in one task.

Spark's exact ``percentile`` keeps every distinct value of a group in one
buffer. Here a sketch of a row sample first brackets the wanted ranks, a count
over all rows settles where each rank lies, and only a bracket of at most
``SMALL`` rows reaches the exact aggregate. The sample decides how fast a rank
is found, never which value is returned: a rank outside its bracket is looked
for in the stretch that holds it.

Each pass is an aggregate combined on the map side, so the shuffle carries a
few buffers per task whatever the row count or skew; a hot value ends its search
at once because a bracket edge that holds the rank is the answer.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from tabloom.functions.columns import measure

SMALL = 100_000  # rows an exact aggregate buffer may hold
ACCURACY = 10_000  # rank error of a sketch is rows / ACCURACY
SAMPLED = 50_000  # rows a sketch should see ...
LEAST_FRACTION = 0.01  # ... or this share of them, if that is more
COLUMNS_PER_PASS = 8  # keeps the generated code of a pass small enough to compile
EDGES_PER_AGGREGATE = 12  # likewise for counts that are one aggregate each


def _sql(value: float) -> str:
    return f"{value!r}D" if math.isfinite(value) else f"double('{value!r}')"


@dataclass(frozen=True)
class Bracket:
    """Ranks sought among the ``rows`` values strictly between two edges.

    ``start`` is the rank, in the whole column, of the first value inside.
    """

    column: str
    ranks: tuple[int, ...]
    start: int
    rows: int
    above: float | None = None
    below: float | None = None

    def values(self) -> str:
        """SQL for the column's values inside the bracket."""
        tests = []
        if self.above is not None:
            tests.append(f"{self.column} > {_sql(self.above)}")
        if self.below is not None:
            tests.append(f"{self.column} < {_sql(self.below)}")
        return f"CASE WHEN {' AND '.join(tests)} THEN {self.column} END" if tests else self.column

    def fractions(self, slack: float) -> list[float]:
        low, high = (min(self.ranks) - self.start), (max(self.ranks) - self.start + 1)
        return [max(0.0, low / self.rows - slack), min(1.0, high / self.rows + slack)]


def exact_quantiles(
    df: DataFrame,
    wanted: dict[str, list[float]],
    interpolation: str = "linear",
    small: int = SMALL,
) -> dict[tuple[str, float], float | None]:
    """Exact quantiles of numeric columns, nulls and NaN left out.

    ``linear`` interpolates between neighbours, ``nearest`` takes the element
    whose rank is closest. A column without values gives ``None``.
    """
    if interpolation not in ("linear", "nearest"):
        raise ValueError(f"unknown interpolation '{interpolation}'")
    wanted = {c: sorted(set(qs)) for c, qs in wanted.items() if qs}
    found: dict[tuple[str, float], float | None] = {}
    columns = list(wanted)
    for start in range(0, len(columns), COLUMNS_PER_PASS):
        block = {c: wanted[c] for c in columns[start : start + COLUMNS_PER_PASS]}
        found.update(_quantiles(df, block, interpolation, small))
    return found


def _quantiles(
    df: DataFrame, wanted: dict[str, list[float]], interpolation: str, small: int
) -> dict[tuple[str, float], float | None]:
    names = {c: f"m{i}" for i, c in enumerate(wanted)}
    # The passes below share these few doubles, so what lies upstream (a join,
    # say) runs once. Lost blocks are recomputed from lineage.
    narrow = df.select(*[measure(df, c).alias(m) for c, m in names.items()])
    narrow = narrow.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        counts = narrow.agg(*[F.count(m).alias(m) for m in names.values()]).first()
        ranks = {
            (c, q): _ranks(q, counts[m], interpolation)
            for c, m in names.items()
            if counts[m]
            for q in wanted[c]
        }
        brackets = [Bracket(names[c], sought, 0, counts[names[c]]) for (c, _), (sought, _) in ranks.items()]
        found = _select(narrow, brackets, small)
    finally:
        narrow.unpersist()

    result: dict[tuple[str, float], float | None] = {}
    for c, qs in wanted.items():
        for q in qs:
            if (c, q) not in ranks:
                result[c, q] = None
                continue
            sought, weight = ranks[c, q]
            low, high = found[names[c], sought[0]], found[names[c], sought[-1]]
            result[c, q] = low if low == high else low + (high - low) * weight
    return result


def _ranks(q: float, rows: int, interpolation: str) -> tuple[tuple[int, ...], float]:
    position = q * (rows - 1)
    if interpolation == "nearest":
        return (math.floor(position + 0.5),), 0.0
    low = math.floor(position)
    high = min(low + 1, rows - 1)
    return ((low,) if low == high else (low, high)), position - low


def _select(df: DataFrame, brackets: list[Bracket], small: int) -> dict[tuple[str, int], float]:
    """Value at each sought rank, keyed by (column, rank)."""
    found: dict[tuple[str, int], float] = {}
    ready: list[Bracket] = []
    while brackets:
        ready += [b for b in brackets if b.rows <= small]
        wide = [b for b in brackets if b.rows > small]
        if not wide:
            break
        brackets = _narrow(df, wide, _edges(df, wide), found)
    # brackets over the same values share a buffer
    shared: dict[tuple, list[Bracket]] = {}
    for b in ready:
        shared.setdefault((b.column, b.above, b.below), []).append(b)
    if shared:
        groups = list(shared.values())
        row = (
            df.selectExpr(*[f"{g[0].values()} AS v{i}" for i, g in enumerate(groups)])
            .agg(*[_at_ranks(f"v{i}", g).alias(f"x{i}") for i, g in enumerate(groups)])
            .first()
        )
        for i, g in enumerate(groups):
            spots = [(b.column, rank) for b in g for rank in b.ranks]
            found.update(dict(zip(spots, row[i])))
    return found


def _edges(df: DataFrame, wide: list[Bracket]) -> list[tuple[float, float]]:
    """Two values of each bracket that should enclose its ranks.

    Brackets over the same values share a sketch.
    """
    share = max(LEAST_FRACTION, min(1.0, SAMPLED / min(b.rows for b in wide)))
    for fraction in (share, 1.0):
        asked: dict[tuple, list[float]] = {}
        for b in wide:
            slack = 2 / ACCURACY + (2 / math.sqrt(b.rows * fraction) if fraction < 1 else 0)
            asked.setdefault((b.column, b.above, b.below), []).extend(b.fractions(slack))
        values = {(b.column, b.above, b.below): b.values() for b in wide}
        rows = df.sample(fraction, seed=11) if fraction < 1 else df
        row = rows.agg(
            *[
                F.expr(f"percentile_approx({values[k]}, array({', '.join(map(_sql, f))}), {ACCURACY})").alias(f"e{i}")
                for i, (k, f) in enumerate(asked.items())
            ]
        ).first()
        if all(row[i] for i in range(len(asked))):  # a sample may miss a bracket
            break
    answers = {k: iter(row[i]) for i, k in enumerate(asked)}
    return [
        (next(answers[b.column, b.above, b.below]), next(answers[b.column, b.above, b.below])) for b in wide
    ]


def _at_ranks(values: str, brackets: list[Bracket]) -> Column:
    # the discrete percentile at the middle of a rank's share is that element
    middles = [(r - b.start + 0.5) / b.rows for b in brackets for r in b.ranks]
    fractions = ", ".join(map(_sql, middles))
    return F.expr(f"percentile_disc(array({fractions})) WITHIN GROUP (ORDER BY {values})")


def _around(column: str, edges: list[float], base: int) -> str:
    """Place of a value, from ``base``: 2i below edge i and above the one before, 2i + 1 on edge i."""
    places = " ".join(
        f"WHEN {column} < {_sql(e)} THEN {base + 2 * i} WHEN {column} = {_sql(e)} THEN {base + 2 * i + 1}"
        for i, e in enumerate(edges)
    )
    return f"CASE WHEN {column} IS NULL THEN NULL {places} ELSE {base + 2 * len(edges)} END"


def _count_around(df: DataFrame, probes: dict[str, list[float]]) -> tuple[dict, dict]:
    """Rows below, and up to, each (column, edge)."""
    flat = [(m, edge) for m, edges in probes.items() for edge in edges]
    if len(flat) <= EDGES_PER_AGGREGATE:
        row = df.agg(
            *[F.expr(f"count_if({m} < {_sql(e)}) AS lt{i}") for i, (m, e) in enumerate(flat)],
            *[F.expr(f"count_if({m} <= {_sql(e)}) AS le{i}") for i, (m, e) in enumerate(flat)],
        ).first()
        return {p: row[f"lt{i}"] for i, p in enumerate(flat)}, {p: row[f"le{i}"] for i, p in enumerate(flat)}

    bases, base = {}, 0
    for m, edges in probes.items():
        bases[m], base = base, base + 2 * len(edges) + 1
    places = ", ".join(_around(m, edges, bases[m]) for m, edges in probes.items())
    sizes = dict(tuple(r) for r in df.selectExpr(f"explode(array({places})) AS place").groupBy("place").count().collect())
    before, upto = {}, {}
    for m, edges in probes.items():
        total = 0
        for i, edge in enumerate(edges):
            total += sizes.get(bases[m] + 2 * i, 0)
            before[m, edge] = total
            total += sizes.get(bases[m] + 2 * i + 1, 0)
            upto[m, edge] = total
    return before, upto


def _narrow(
    df: DataFrame, wide: list[Bracket], edges: list[tuple[float, float]], found: dict[tuple[str, int], float]
) -> list[Bracket]:
    """Count around the edges; keep the stretches that hold a sought rank."""
    probes: dict[str, set[float]] = {}
    for b, pair in zip(wide, edges):
        probes.setdefault(b.column, set()).update(pair)
    before, upto = _count_around(df, {m: sorted(values) for m, values in probes.items()})

    narrower: list[Bracket] = []
    for b, (low, high) in zip(wide, edges):
        at_low, at_high = (b.column, low), (b.column, high)
        open_stretches = [
            (b.start, before[at_low], b.above, low),
            (upto[at_low], before[at_high], low, high),
            (upto[at_high], b.start + b.rows, high, b.below),
        ]
        for edge in {at_low, at_high}:
            found.update(
                {(b.column, r): edge[1] for r in b.ranks if before[edge] <= r < upto[edge]}
            )
        for start, end, above, below in open_stretches:
            inside = tuple(r for r in b.ranks if start <= r < end)
            if inside:
                narrower.append(Bracket(b.column, inside, start, end - start, above, below))
    return narrower
