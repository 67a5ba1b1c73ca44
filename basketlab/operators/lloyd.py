"""K-means that any engine can repeat: whole numbers throughout, starts by hash.

Rows are counted per distinct point on a grid of 1 / GRID, so a pass costs one row per point. The
start is k-means++ by exponential races: the next centre is the point with the least
-ln(u) / (weight * squared distance to the nearest centre), u from a hash of the least id at the
point, which draws points as k-means++ does. One pass draws the next centre of all restarts, and
models of every k share the draws. Lloyd steps then move the centres of all models in one pass each,
until no centre moves. Sums are whole numbers and means are rounded to the grid, so the order of the
rows does not matter. Only centres come to the driver.

Fewer distinct points than k give as many segments as there are points; an empty table gives none.
A centre that no point is nearest to stays where it is. Ties go to the lower number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlab.functions.columns import HASH_MODULUS, HASH_MULTIPLIER, HASH_SEED_MULTIPLIER
from basketlab.session import cut

GRID = 1_000_000
MAX_STEPS = 300

# (restart, k) -> centres, one row each.
Models = dict[tuple[int, int], np.ndarray]


def on_grid(column: str) -> Column:
    return F.round(F.col(column) * F.lit(GRID)).cast("long")


def points(rows: DataFrame, columns: list[str], id_col: str) -> DataFrame:
    """(id, w, p): distinct points on the grid with the number of rows and the least id there."""
    p = F.array(*map(on_grid, columns)).alias("p")
    return rows.select(F.col(id_col).cast("long").alias("id"), p).groupBy("p").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w"))


def _coordinates(part: pd.DataFrame) -> np.ndarray:
    return np.stack(part["p"].to_numpy()).astype(np.int64)


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, one column per centre."""
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)


def _shift(restart: int, step: int, seed: int) -> int:
    return (seed + 1000 * restart + step) * HASH_SEED_MULTIPLIER


def draw(table: DataFrame, most: int, restarts: int, seed: int) -> list[list[list[int]]]:
    """Starting centres of each restart, at most ``most``, in the order drawn."""
    chosen: list[list[list[int]]] = [[] for _ in range(restarts)]

    def race(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if part.empty:
                continue
            x, ids, w = _coordinates(part), part["id"].to_numpy(), part["w"].to_numpy()
            out = []
            for r, centres in enumerate(chosen):
                far = _squares(x, np.array(centres)).min(axis=1) if centres else np.ones(len(x), np.int64)
                h = ((ids % 2147483648) * HASH_MULTIPLIER + _shift(r, len(centres), seed)) % HASH_MODULUS
                with np.errstate(divide="ignore"):
                    key = np.where(far > 0, -np.log((h + 0.5) / HASH_MODULUS) / (w * far.astype(float)), np.inf)
                best = np.lexsort((ids, key))[0]
                if far[best] > 0:
                    out.append((r, key[best], ids[best], x[best].tolist()))
            yield pd.DataFrame(out, columns=["r", "key", "id", "p"])

    for _ in range(most):
        found = table.mapInPandas(race, "r int, key double, id long, p array<long>")
        winners = found.groupBy("r").agg(F.min(F.struct("key", "id", "p")).alias("best")).collect()
        for row in winners:
            chosen[row["r"]].append(list(row["best"]["p"]))
        if not winners:
            break
    return chosen


def _totals(table: DataFrame, models: Models) -> list:
    """Per model and centre: weight, coordinate sums and cost of its points."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if part.empty:
                continue
            x, w = _coordinates(part), part["w"].to_numpy()
            out = []
            for (r, k), centres in models.items():
                far = _squares(x, centres)
                nearest = far.argmin(axis=1)
                cost = w * far[np.arange(len(x)), nearest].astype(float)
                for c in np.unique(nearest):
                    mine = nearest == c
                    sums = (x[mine] * w[mine, None]).sum(axis=0).tolist()
                    out.append((r, k, int(c), int(w[mine].sum()), sums, float(cost[mine].sum())))
            yield pd.DataFrame(out, columns=["r", "k", "c", "w", "sums", "cost"])

    parts = table.mapInPandas(assign, "r int, k int, c int, w long, sums array<long>, cost double")
    width = len(next(iter(models.values()))[0])
    return (
        parts.groupBy("r", "k", "c")
        .agg(F.sum("w").alias("w"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"), F.sum("cost").alias("cost"))
        .collect()
    )


def fit_all(rows: DataFrame, columns: list[str], id_col: str, ks: range, restarts: int, seed: int) -> dict[int, tuple[float, np.ndarray]]:
    """k -> (cost, centres on the grid) of the restart of least cost (ties: the first)."""
    table = cut(points(rows, columns, id_col))
    starts = draw(table, max(ks), restarts, seed)
    models: Models = {(r, k): np.array(s[:k], np.int64) for r, s in enumerate(starts) for k in ks if s}
    active = dict(models)
    for _ in range(MAX_STEPS):
        if not active:
            break
        moved = {key: centres.copy() for key, centres in active.items()}
        for t in _totals(table, active):
            moved[t["r"], t["k"]][t["c"]] = np.floor(np.array(t["sums"]) / t["w"] + 0.5)
        active = {key: centres for key, centres in moved.items() if (centres != active[key]).any()}
        models |= active
    costs: dict[tuple[int, int], float] = dict.fromkeys(models, 0.0)
    for t in _totals(table, models) if models else []:
        costs[t["r"], t["k"]] += t["cost"] / GRID**2
    best: dict[int, tuple[float, np.ndarray]] = {}
    for (r, k), cost in sorted(costs.items()):
        # Costs are sums of floats, so equal ones may differ in their last digits.
        if k not in best or round(cost, 6) < round(best[k][0], 6):
            best[k] = (cost, models[r, k])
    return best


def nearest(columns: list[str], centres: np.ndarray) -> Column:
    """Number of the nearest centre of a row, ties to the lower one."""
    choices = []
    for c, centre in enumerate(centres.tolist()):
        gaps = [on_grid(name) - F.lit(x) for name, x in zip(columns, centre)]
        choices.append(F.struct(sum(g * g for g in gaps).alias("d"), F.lit(c).alias("c")))
    return F.array_min(F.array(*choices))["c"]
