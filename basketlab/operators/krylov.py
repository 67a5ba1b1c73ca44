"""Leading eigenvectors of X'X by block Lanczos, for item sets too large for one dense matrix.

X (users x items, sparse) stays in packed blocks of users, vectors over the items in blocks of
items. A round multiplies the newest block of vectors by X'X where the users are, sums the parts per
block of items, and makes the sum orthogonal to all vectors so far (twice, against rounding) and in
itself: the products of all blocks of items with it are summed to small matrices, whose root gives the
new block (a QR decomposition across tasks). The small projected matrix gives values, vectors and the norm of
their residuals, which ends a group. A group that fills its basis starts again from its best vectors.
No matrix of items x items exists anywhere; a task holds items x (components + EXTRA) numbers of one
group, or a block of items x MAX_BLOCKS such blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlab.session import cut

# Vectors beside the asked ones, blocks of a basis, items of a block, users multiplied at once.
EXTRA, MAX_BLOCKS, ITEM_BLOCK, USERS = 10, 20, 1024, 2048
# A residual this small against the largest value ends a group; so do so many rounds.
TOLERANCE, MAX_ROUNDS = 1e-8, 300
# New directions this small (squared) against the largest new one wait for a later round; those this
# small against the largest value are rounding.
NARROW, NOISE = 1e-8, 1e-10


def _pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a, dtype=np.float64).tobytes()


def _open(b: bytes, width: int) -> np.ndarray:
    return np.frombuffer(b).reshape(-1, width) if width else np.empty((0, 0))


def pack_users(vectors: DataFrame, g: str, block: str) -> DataFrame:
    """One row per block of users: where each user's entries begin, their items and values."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        lens = part["idxs"].map(len).to_numpy()
        return pd.DataFrame(
            {
                g: [part[g].iloc[0]],
                block: [part[block].iloc[0]],
                "starts": [(np.cumsum(lens) - lens).astype(np.int64).tobytes()],
                "idxs": [np.concatenate(part["idxs"].to_numpy()).astype(np.int64).tobytes()],
                "vals": [_pack(np.concatenate(part["vals"].to_numpy()))],
            }
        )

    schema = f"{g} long, {block} int, starts binary, idxs binary, vals binary"
    return vectors.groupBy(g, block).applyInPandas(run, schema)


def _times(out: np.ndarray, q: np.ndarray, starts: np.ndarray, idx: np.ndarray, val: np.ndarray) -> None:
    """Add X'X q of one block of users to ``out``."""
    ends = np.append(starts[1:], len(idx))
    for k in range(0, len(starts), USERS):
        first, last = starts[k], ends[min(k + USERS, len(starts)) - 1]
        items, values = idx[first:last], val[first:last, None]
        own = starts[k : k + USERS] - first
        y = np.add.reduceat(values * q[items], own, axis=0)
        spread = values * np.repeat(y, np.diff(np.append(own, last - first)), axis=0)
        order = np.argsort(items, kind="stable")
        items = items[order]
        heads = np.flatnonzero(np.concatenate([[True], items[1:] != items[:-1]]))
        out[items[heads]] += np.add.reduceat(spread[order], heads, axis=0)


def _product(packed: DataFrame, basis: DataFrame, g: str, block: str, rows_of: int) -> DataFrame:
    """(group, part, w): rows of X'X times the newest vectors, a partial sum per task."""

    def newest(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            q = [_pack(_open(b, m)[:, m - w :]) for b, m, w in zip(pdf["basis"], pdf["m"], pdf["width"])]
            yield pd.DataFrame({g: pdf[g], "part": pdf["part"], "width": pdf["width"], "q": q})

    q = basis.mapInPandas(newest, f"{g} long, part int, width int, q binary")
    whole = q.groupBy(g, "width").agg(F.sort_array(F.collect_list(F.struct("part", "q"))).alias("q"))
    # The vectors of a group are sent to each of its blocks of users.
    sent = packed.select(g, block).join(whole, g).select(g, block, "width", F.col("q.q").alias("q"))

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in rows:
            for r in pdf.to_dict("records"):
                q = np.concatenate([_open(b, r["width"]) for b in r["q"]])
                out = sums.setdefault(r[g], np.zeros_like(q))
                starts, idx = np.frombuffer(r["starts"], np.int64), np.frombuffer(r["idxs"], np.int64)
                _times(out, q, starts, idx, np.frombuffer(r["vals"]))
        for key, out in sums.items():
            for part, k in enumerate(range(0, len(out), rows_of)):
                yield pd.DataFrame({g: [key], "part": [part], "w": [_pack(out[k : k + rows_of])]})

    joined = packed.join(sent, [g, block])
    return joined.mapInPandas(run, f"{g} long, part int, w binary")


def _shares(product: DataFrame, basis: DataFrame, g: str) -> DataFrame:
    """Summed product per block of items, with its share of the products with the basis."""

    def run(parts: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        r = own.iloc[0]
        b = _open(r["basis"], r["m"])
        w = np.zeros((len(b), r["width"]))
        for x in parts["w"]:
            w += _open(x, r["width"])
        return pd.DataFrame(
            {
                g: [r[g]], "part": [r["part"]], "m": [r["m"]], "width": [r["width"]],
                "w": [_pack(w)], "c": [_pack(b.T @ w)],
            }
        )

    schema = f"{g} long, part int, m int, width int, w binary, c binary"
    return product.groupBy(g, "part").cogroup(basis.groupBy(g, "part")).applyInPandas(run, schema)


def _projected(shares: DataFrame, basis: DataFrame, g: str) -> DataFrame:
    """``w`` without its part in the basis (``first``), and the shares of what is left."""

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        c = sum(np.frombuffer(x) for x in parts["c"])
        return pd.DataFrame({g: [parts[g].iloc[0]], "first": [_pack(c)]})

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            out = []
            for r in pdf.to_dict("records"):
                b = _open(r["basis"], r["m"])
                w = _open(r["w"], r["width"]) - b @ _open(r["first"], r["width"])
                out.append((r[g], r["part"], r["m"], r["width"], r["first"], _pack(w), _pack(b.T @ w), _pack(w.T @ w)))
            yield pd.DataFrame(out, columns=names)

    schema = f"{g} long, part int, m int, width int, first binary, w binary, c binary, n binary"
    names = [c.split()[0] for c in schema.split(", ")]
    sums = shares.select(g, "c").groupBy(g).applyInPandas(add, f"{g} long, first binary")
    joined = shares.drop("c").join(basis.select(g, "part", "basis"), [g, "part"]).join(sums, g)
    return joined.mapInPandas(run, schema)


def _decide(k: int, g: str, blocks: int):
    """Next move of a group: go on with a new block, start again from its best vectors, or end."""

    def run(shares: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        m, w = int(shares["m"].iloc[0]), int(shares["width"].iloc[0])
        c = sum(_open(x, w) for x in shares["c"])
        n = sum(_open(x, w) for x in shares["n"])
        t = np.zeros((m, m))
        if len(before):
            old = m - w
            t[:old, :old] = _open(before["t"].iloc[0], old)
        whole = _open(shares["first"].iloc[0], w) + c
        t[:, m - w :], t[m - w :, :] = whole, whole.T
        values, y = np.linalg.eigh((t + t.T) / 2)
        values, y = values[::-1], y[:, ::-1]
        rest = n - c.T @ c
        size, side = np.linalg.eigh((rest + rest.T) / 2)
        size = np.maximum(size, 0.0)
        residual = np.sqrt((size[:, None] * (side.T @ y[m - w :, :k]) ** 2).sum(axis=0))
        kept = size > max(NARROW * size.max(initial=0), (NOISE * max(values[0], 0.0)) ** 2)
        root, side = np.sqrt(size[kept]), side[:, kept]
        floor = max(values[0], 0.0) * TOLERANCE
        # Values that are nothing but noise need no exact vectors.
        worst = float(residual[: max(1, int((values[:k] > floor).sum()))].max(initial=0.0))
        if not kept.any() or worst <= floor and m >= k:
            move = "end"
        elif m + kept.sum() > blocks * (k + EXTRA):
            move = "again"
        else:
            move = "on"
        y = y[:, : min(m, k if move == "end" else k + EXTRA)]
        return pd.DataFrame(
            {
                g: [shares[g].iloc[0]], "move": [move], "t": [_pack(t)], "c": [_pack(c)],
                "turn": [_pack(side / root) if kept.any() else b""], "wide": [int(kept.sum())],
                "y": [_pack(y)], "n_y": [y.shape[1]], "values": [list(values[: y.shape[1]])], "worst": [worst],
            }
        )

    return run


_DECIDED = "move string, t binary, c binary, turn binary, wide int, y binary, n_y int, values array<double>, worst double"


def _advance(basis: DataFrame, shares: DataFrame, decided: DataFrame, g: str) -> DataFrame:
    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            out = []
            for r in pdf.to_dict("records"):
                b = _open(r["basis"], r["m"])
                if r["move"] == "on":
                    w = _open(r["w"], r["width"]) - b @ _open(r["c"], r["width"])
                    b, wide = np.hstack([b, w @ _open(r["turn"], r["wide"])]), r["wide"]
                else:
                    b = b @ _open(r["y"], r["n_y"])
                    wide = b.shape[1]
                out.append((r[g], r["part"], b.shape[1], wide, _pack(b), r["move"]))
            yield pd.DataFrame(out, columns=[g, "part", "m", "width", "basis", "move"])

    known = decided.select(g, "move", "c", "turn", "wide", "y", "n_y")
    joined = basis.join(shares.select(g, "part", "w"), [g, "part"]).join(known, g)
    return joined.mapInPandas(run, f"{g} long, part int, m int, width int, basis binary, move string")


def leading(vectors: DataFrame, sizes: DataFrame, k: int, g: str, block: str = "block") -> DataFrame:
    """(group, idx, v): rows of the ``k`` leading eigenvectors, with the ``values``, largest first.

    ``vectors``: group, block of users, idxs and vals of each user. ``sizes``: group and its number
    of items ``n``, which number their items from 0. Vectors of values that are noise are left out.
    """
    packed = cut(pack_users(vectors, g, block))
    rows_of, blocks = ITEM_BLOCK, MAX_BLOCKS  # as the driver knows them

    def begin(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for r in pdf.to_dict("records"):
                rows_here = min(rows_of, r["n"] - r["part"] * rows_of)
                rng = np.random.default_rng([7, r["part"]])
                start = rng.standard_normal((rows_here, k + EXTRA)) / np.sqrt(r["n"])
                yield pd.DataFrame({g: [r[g]], "part": [r["part"]], "m": [k + EXTRA], "width": [k + EXTRA], "basis": [_pack(start)]})

    state = "part int, m int, width int, basis binary"
    parts = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / rows_of).cast("int"))).alias("part")
    basis = cut(_orthonormal(sizes.select(g, "n", parts).mapInPandas(begin, f"{g} long, {state}"), g))
    found, decided = None, None
    for _ in range(MAX_ROUNDS):
        shares = cut(_shares(_product(packed, basis, g, block, rows_of), basis, g))
        shares = cut(_projected(shares, basis, g))
        before = shares.limit(0).select(g, F.lit(None).cast("binary").alias("t")) if decided is None else decided
        decided = cut(shares.groupBy(g).cogroup(before.groupBy(g)).applyInPandas(_decide(k, g, blocks), f"{g} long, {_DECIDED}"))
        moved = cut(_advance(basis, shares, decided, g))
        moves = {r.move for r in decided.select("move").distinct().collect()}
        if "end" in moves:
            done = moved.where("move = 'end'").join(decided.select(g, "values"), g)
            found = done if found is None else found.unionAll(done)
        if moves <= {"end"}:
            return _rows(found, g, rows_of)
        basis = moved.where("move <> 'end'").drop("move")
        # A group that starts again has its vectors, but no products with them yet.
        decided = decided.where("move = 'on'")
    raise RuntimeError(f"no convergence within {MAX_ROUNDS} rounds")


def _orthonormal(basis: DataFrame, g: str) -> DataFrame:
    """The columns of a first basis made orthonormal over all blocks of items."""

    def share(pdf: pd.DataFrame) -> pd.DataFrame:
        n = sum(_open(b, m).T @ _open(b, m) for b, m in zip(pdf["basis"], pdf["m"]))
        size, side = np.linalg.eigh(n)
        kept = size > NARROW * size.max()
        return pd.DataFrame({g: [pdf[g].iloc[0]], "turn": [_pack(side[:, kept] / np.sqrt(size[kept]))], "wide": [int(kept.sum())]})

    def gram(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            n = [_pack(np.linalg.cholesky(_open(b, m).T @ _open(b, m) + 1e-300 * np.eye(m)).T) if len(_open(b, m)) >= m else b for b, m in zip(pdf["basis"], pdf["m"])]
            yield pd.DataFrame({g: pdf[g], "m": pdf["m"], "basis": n})

    # Only a triangle of each block of items meets the others, as in any tall and thin QR.
    small = basis.mapInPandas(gram, f"{g} long, m int, basis binary").groupBy(g).applyInPandas(share, f"{g} long, turn binary, wide int")

    def turn(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            b = [_pack(_open(b, m) @ _open(t, w)) for b, m, t, w in zip(pdf["basis"], pdf["m"], pdf["turn"], pdf["wide"])]
            yield pd.DataFrame({g: pdf[g], "part": pdf["part"], "m": pdf["wide"], "width": pdf["wide"], "basis": b})

    return basis.join(small, g).mapInPandas(turn, f"{g} long, part int, m int, width int, basis binary")


def _rows(found: DataFrame, g: str, rows_of: int) -> DataFrame:
    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for r in pdf.to_dict("records"):
                v = _open(r["basis"], r["m"])
                at = r["part"] * rows_of + np.arange(len(v))
                yield pd.DataFrame({g: r[g], "idx": at.astype("int32"), "v": list(v), "values": [r["values"]] * len(v)})

    return found.mapInPandas(run, f"{g} long, idx int, v array<double>, values array<double>")
