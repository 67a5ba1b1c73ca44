"""Truncated SVD recommenders, overall or per segment.

Interactions are long rows (user_id, item, value [, group]). Groups of at most DENSE_ITEMS items
sum their item x item Gram matrix over blocks of users and decompose it in one task of known size;
larger ones find their leading vectors by block Lanczos over blocks of users and of items
(:mod:`krylov`), without any such matrix. Users are dealt to blocks of their group; the group's
factors meet each block in a co-grouped task, so no factor passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlab.functions.columns import is_train
from basketlab.functions.position import global_position, number_in_group
from basketlab.functions.topk import top_per_group
from basketlab.operators import krylov, ranking
from basketlab.operators.rules_eval import classification
from basketlab.session import cut, free_shuffles

_ALL = "_all"
# Users of a group that one task holds (sparse rows), and of these at once as a dense block.
USERS_PER_TASK = 16_384
USERS_PER_BLOCK = 1024
# Items of a group whose Gram matrix one task decomposes (128 MB). Below it that is several times
# as fast as block Lanczos, which needs many rounds where the singular values lie close together.
DENSE_ITEMS = 4096
# Neighbours: USERS_PER_TASK asked and train users of a tile, and the train users scored at once.
ASKED_TIMES, TRAIN_TIMES = 2, 4
# Blocks of asked users whose tiles are shuffled at once: every one takes a copy of the train users.
ASKED_BLOCKS = 4
TRAIN_PER_STEP = 2048
THRESHOLD = 0.5
# Scores are compared after rounding, so float noise cannot reorder equal items.
TIE_DIGITS = 9


@dataclass(frozen=True)
class SvdModel:
    """``factors``: group, item, idx, v (array of k), sigma (array of k), energy (sum x^2)."""

    factors: DataFrame
    interactions: DataFrame
    group_col: str | None
    test_size: float
    seed: int

    @property
    def group(self) -> str:
        return self.group_col or _ALL

    @property
    def train_mask(self) -> Column:
        return is_train("user_id", self.test_size, self.seed)


def interaction_counts(user_lines: DataFrame, item_col: str, *group: str) -> DataFrame:
    """(user_id, item, value): number of lines per user and item."""
    return user_lines.groupBy(*group, "user_id", F.col(item_col).alias("item")).agg(
        F.count(F.lit(1)).alias("value")
    )


def cluster_ratings(
    user_lines: DataFrame, user_clusters: DataFrame, item_col: str = "product_id", top_n: int = 4000
) -> DataFrame:
    """(cluster, user_id, item, value = 1) for the ``top_n`` items by lines of each segment."""
    counts = interaction_counts(
        user_lines.join(user_clusters.select("user_id", "cluster"), "user_id"), item_col, "cluster"
    )
    totals = counts.groupBy("cluster", "item").agg(F.sum("value").alias("n"))
    top = top_per_group(totals, ["cluster"], [F.desc("n"), F.asc("item")], top_n)
    return counts.join(top.select("cluster", "item"), ["cluster", "item"], "left_semi").select(
        "cluster", "user_id", "item", F.lit(1.0).alias("value")
    )


def _with_group(df: DataFrame, group_col: str | None) -> DataFrame:
    # A stored column joins by key; a literal one would make it a nested-loop join.
    if group_col is None and _ALL in df.columns:
        return df
    g = F.lit(0) if group_col is None else F.col(group_col)
    return df.withColumn(group_col or _ALL, g.cast("long"))


def item_index(interactions: DataFrame, g: str) -> DataFrame:
    """Dense 0-based position of each item in its group; very many items are numbered by ranges."""
    items = interactions.select(g, "item").distinct()
    return number_in_group(items, g, "item", "item").select(g, "item", (F.col("number") - 1).alias("idx"))


def user_vectors(interactions: DataFrame, index: DataFrame, g: str) -> DataFrame:
    """One sparse row per user: idxs and vals, at most one entry per item of the group."""
    return (
        interactions.join(index, [g, "item"])
        .groupBy(g, "user_id")
        .agg(F.collect_list(F.struct("idx", F.col("value").cast("double").alias("val"))).alias("c"))
        .select(g, "user_id", F.col("c.idx").alias("idxs"), F.col("c.val").alias("vals"))
    )


def _flat(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lens = pdf["idxs"].map(len).to_numpy()
    return lens, np.concatenate(pdf["idxs"].to_numpy()), np.concatenate(pdf["vals"].to_numpy())


def _blocks(pdf: pd.DataFrame, n: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Dense blocks of at most USERS_PER_BLOCK users."""
    for start in range(0, len(pdf), USERS_PER_BLOCK):
        part = slice(start, start + USERS_PER_BLOCK)
        lens, idx, val = _flat(pdf.iloc[part])
        block = np.zeros((len(lens), n))
        block[np.repeat(np.arange(len(lens)), lens), idx] = val
        yield part, block


def _add_gram(gram: np.ndarray, pdf: pd.DataFrame) -> None:
    """Add the upper half of X'X of the users in ``pdf``: by products of non-zeros when rows are
    sparse, else by BLAS."""
    n = len(gram)
    for start in range(0, len(pdf), USERS_PER_BLOCK):
        rows = pdf.iloc[start : start + USERS_PER_BLOCK]
        lens, idx, val = _flat(rows)
        products = int((lens.astype(np.int64) ** 2).sum())
        if products * 20 > n * n * len(lens):
            for _, block in _blocks(rows, n):
                gram += block.T @ block
            continue
        per_entry = np.repeat(lens, lens)
        left = np.repeat(np.arange(len(idx)), per_entry)
        row_start = np.repeat(np.cumsum(lens) - lens, lens)
        within = np.arange(products) - np.repeat(np.cumsum(per_entry) - per_entry, per_entry)
        right = np.repeat(row_start, per_entry) + within
        upper = idx[left] <= idx[right]
        left, right = left[upper], right[upper]
        cells = idx[left].astype(np.int64) * n + idx[right]
        keys, where = np.unique(cells, return_inverse=True)
        gram.ravel()[keys] += np.bincount(where, val[left] * val[right])


def _in_blocks(vectors: DataFrame, g: str, times: int = 1) -> DataFrame:
    """``vectors`` with ``block``: parts of a group of about ``times`` USERS_PER_TASK users."""
    blocks = F.ceil(F.count(F.lit(1)) / (USERS_PER_TASK * times))
    sizes = vectors.groupBy(g).agg(blocks.alias("blocks"))
    block = F.pmod(F.xxhash64("user_id"), F.col("blocks")).cast("int")
    return vectors.join(sizes, g).withColumn("block", block)


def item_gram(vectors: DataFrame, sizes: DataFrame, g: str) -> DataFrame:
    """(group, i, j, dot) with i <= j: non-zero cells of the Gram matrix of each group.

    Each block of users gives one partial matrix; only its non-zero upper half is shuffled and
    summed.
    """
    rows = _in_blocks(vectors, g).join(sizes.select(g, "n"), g)

    def partial(part: pd.DataFrame) -> pd.DataFrame:
        gram = np.zeros((int(part["n"].iloc[0]),) * 2)
        _add_gram(gram, part)
        half = np.triu(gram)
        used = np.flatnonzero(half.any(axis=1))
        js = [np.flatnonzero(half[i]).astype("int32") for i in used]
        dots = [half[i, j] for i, j in zip(used, js)]
        key = part[g].iloc[0]
        return pd.DataFrame({g: key, "i": used.astype("int32"), "js": js, "dots": dots})

    parts = rows.groupBy(g, "block").applyInPandas(
        partial, f"{g} long, i int, js array<int>, dots array<double>"
    )
    cells = parts.select(g, "i", F.explode(F.arrays_zip("js", "dots")).alias("c"))
    return cells.groupBy(g, "i", F.col("c.js").alias("j")).agg(F.sum("c.dots").alias("dot"))


def _decompose(n_components: int, g: str):
    def run(index: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        index = index.sort_values("idx")
        n = len(index)
        gram = np.zeros((n, n))
        gram[cells["i"], cells["j"]] = cells["dot"]
        gram[cells["j"], cells["i"]] = cells["dot"]
        values, vectors = np.linalg.eigh(gram)
        values, vectors = values[::-1], vectors[:, ::-1]
        floor = max(values[0], 0.0) * n * np.finfo(float).eps
        k = min(n_components, int((values > floor).sum()))
        v = vectors[:, :k]
        peak = np.abs(v).argmax(axis=0)
        v = v * np.sign(v[peak, np.arange(k)])
        return pd.DataFrame(
            {
                g: index[g].to_numpy(),
                "item": index["item"].to_numpy(),
                "idx": index["idx"].to_numpy(),
                "v": list(v),
                "sigma": [np.sqrt(values[:k])] * n,
                "energy": float(np.trace(gram)),
            }
        )

    return run


def _dense_factors(train: DataFrame, index: DataFrame, sizes: DataFrame, k: int, g: str) -> DataFrame:
    index = index.join(sizes.select(g), g, "left_semi")
    gram = item_gram(user_vectors(train, index, g), sizes, g)
    item_type = dict(index.dtypes)["item"]
    return index.groupBy(g).cogroup(gram.groupBy(g)).applyInPandas(
        _decompose(k, g),
        f"{g} long, item {item_type}, idx int, v array<double>, sigma array<double>, energy double",
    )


def _krylov_factors(train: DataFrame, index: DataFrame, sizes: DataFrame, k: int, g: str) -> DataFrame:
    index = index.join(sizes.select(g), g, "left_semi")
    vectors = cut(_in_blocks(user_vectors(train, index, g), g))
    energy = vectors.groupBy(g).agg(
        F.sum(F.aggregate("vals", F.lit(0.0), lambda a, x: a + x * x)).alias("energy")
    )
    found = krylov.leading(vectors, sizes.join(energy.select(g), g, "left_semi"), k, g)
    # As in the dense case: values over the noise of the arithmetic, the largest entry positive.
    eps = F.lit(float(np.finfo(float).eps))
    rank = F.size(F.filter("values", lambda x: x > F.greatest(F.element_at("values", 1), F.lit(0.0)) * F.col("n") * eps))
    kept = (
        found.join(sizes, g)
        .withColumn("rank", F.least(rank, F.lit(k)))
        .select(g, "idx", F.slice("v", F.lit(1), F.col("rank")).alias("v"), F.slice("values", F.lit(1), F.col("rank")).alias("power"))
    )
    kept = cut(kept)
    sides = (
        kept.select(g, F.posexplode("v").alias("pos", "x"))
        .groupBy(g, "pos")
        .agg(F.signum(F.max_by("x", F.abs("x"))).alias("side"))
        .groupBy(g)
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "side"))), lambda c: c["side"]).alias("sides"))
    )
    empty = F.array().cast("array<double>")
    return (
        index.join(kept.join(sides, g), [g, "idx"], "left")
        .join(energy, g, "left")
        .select(
            g,
            "item",
            F.col("idx").cast("int").alias("idx"),
            F.coalesce(F.zip_with("v", "sides", lambda x, s: x * s), empty).alias("v"),
            F.coalesce(F.transform("power", lambda x: F.sqrt(x)), empty).alias("sigma"),
            F.coalesce("energy", F.lit(0.0)).alias("energy"),
        )
    )


def fit_svd(
    interactions: DataFrame,
    n_components: int = 50,
    group_col: str | None = None,
    test_size: float = 0.2,
    seed: int = 42,
) -> SvdModel:
    """Factors of the uncentred train matrix; k = min(n_components, rank).

    ``test_size=0`` trains on every user. Items seen only by held-out users keep zero factors.
    """
    g = group_col or _ALL
    rows = cut(_with_group(interactions, group_col))
    index = cut(item_index(rows, g))
    sizes = cut(index.groupBy(g).agg(F.count(F.lit(1)).cast("int").alias("n")))
    train = rows.where(is_train("user_id", test_size, seed)) if test_size > 0 else rows
    large = sizes.where(F.col("n") > DENSE_ITEMS)
    parts = []
    if large.limit(1).count() < sizes.count():
        parts.append(_dense_factors(train, index, sizes.where(F.col("n") <= DENSE_ITEMS), n_components, g))
    if large.limit(1).count():
        parts.append(_krylov_factors(train, index, large, n_components, g))
    factors = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return SvdModel(cut(factors), rows, group_col, test_size, seed)


def gram_cells(interactions: DataFrame, group_col: str | None = None) -> DataFrame:
    """Non-zero Gram cells as (group, item_i, item_j, dot)."""
    g = group_col or _ALL
    rows = cut(_with_group(interactions, group_col))
    index = item_index(rows, g)
    sizes = index.groupBy(g).agg(F.count(F.lit(1)).cast("int").alias("n"))
    gram = item_gram(user_vectors(rows, index, g), sizes, g)
    flipped = gram.where("i < j").select(
        g, F.col("j").alias("i"), F.col("i").alias("j"), "dot"
    )
    cells = gram.unionByName(flipped).where(F.col("dot") != 0)
    left = index.select(g, F.col("idx").alias("i"), F.col("item").alias("item_i"))
    right = index.select(g, F.col("idx").alias("j"), F.col("item").alias("item_j"))
    return (
        cells.join(left, [g, "i"]).join(right, [g, "j"]).select(g, "item_i", "item_j", "dot").drop(_ALL)
    )


def explained_variance(model: SvdModel) -> DataFrame:
    """Per component: sigma, share and cumulative share over the kept components, the share
    over all components, and whether 95 % needs at most this many components."""
    g = model.group
    sigma = (
        model.factors.where(F.col("idx") == 0)
        .select(g, "energy", F.posexplode("sigma").alias("pos", "sigma"))
        .withColumn("power", F.col("sigma") * F.col("sigma"))
    )
    whole = Window.partitionBy(g)
    upto = whole.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    share = F.col("power") / F.sum("power").over(whole)
    out = (
        sigma.withColumn("component", F.col("pos") + 1)
        .withColumn("share", share)
        .withColumn("cumulative_share", F.sum("share").over(upto))
        .withColumn("share_of_total", F.col("power") / F.col("energy"))
    )
    enough = F.min(F.when(F.col("cumulative_share") >= 0.95, F.col("component"))).over(whole)
    return out.select(
        g, "component", "sigma", "share", "cumulative_share", "share_of_total",
        enough.alias("components_for_95"),
    ).drop(_ALL)


def _per_block(
    model: SvdModel, interactions: DataFrame, fn: Callable[..., dict], schema: str
) -> DataFrame:
    """Rows of ``fn(items, V, users, X)`` for dense blocks X of the users in ``interactions``.

    A group's factors are sent to each of its blocks of users, which is what the shuffle carries;
    neither side is collected.
    """
    g = model.group
    index = model.factors.select(g, "item", "idx")
    users = _in_blocks(user_vectors(interactions, index, g), g)
    users = cut(users.select(g, "block", "user_id", "idxs", "vals"))
    blocks = users.select(F.col(g).alias("_g"), F.col("block").alias("_block")).distinct()
    factors = model.factors.select(g, "item", "idx", "v").join(blocks, F.col(g) == F.col("_g"))

    def run(part: pd.DataFrame, factor: pd.DataFrame) -> pd.DataFrame:
        factor = factor.sort_values("idx")
        items, v = factor["item"].to_numpy(), np.stack(factor["v"].to_numpy())
        out = []
        for where, block in _blocks(part, len(v)):
            rows = fn(items, v, part["user_id"].to_numpy()[where], block)
            out.append(pd.DataFrame({g: part[g].iloc[0], **rows}))
        return pd.concat(out, ignore_index=True)

    return (
        users.groupBy(g, "block")
        .cogroup(factors.groupBy("_g", "_block"))
        .applyInPandas(run, f"{g} long, {schema}")
    )


def user_factors(model: SvdModel, interactions: DataFrame | None = None) -> DataFrame:
    """(group, user_id, factor, norm): rows of X V scaled to length 1 (a zero row stays zero)."""
    rows = model.interactions if interactions is None else _with_group(interactions, model.group_col)

    def project(items: np.ndarray, v: np.ndarray, users: np.ndarray, x: np.ndarray) -> dict:
        f = x @ v
        norm = np.sqrt((f * f).sum(axis=1))
        return {"user_id": users, "factor": list(f / np.where(norm > 0, norm, 1.0)[:, None])}

    return _per_block(model, rows, project, "user_id long, factor array<double>").drop(_ALL)


def recommend(
    model: SvdModel, n: int, users: DataFrame | None = None, interactions: DataFrame | None = None
) -> DataFrame:
    """(group, user_id, item, score, rank): the ``n`` best items of x V V' per user.

    Every user with an interaction is served unless ``users`` (user_id) narrows the run.
    """
    g = model.group
    rows = model.interactions if interactions is None else _with_group(interactions, model.group_col)
    if users is not None:
        rows = rows.join(users.select("user_id").distinct(), "user_id", "left_semi")
    item_type = dict(model.factors.dtypes)["item"]

    def lists_of(items: np.ndarray, v: np.ndarray, users: np.ndarray, x: np.ndarray) -> dict:
        best, scores = _best((x @ v) @ v.T, n)
        return {"user_id": users, "items": list(items[best]), "scores": list(scores)}

    lists = _per_block(
        model, rows, lists_of, f"user_id long, items array<{item_type}>, scores array<double>"
    )
    pairs = F.posexplode(F.arrays_zip("items", "scores")).alias("pos", "p")
    return lists.select(g, "user_id", pairs).select(
        g, "user_id", F.col("p.items").alias("item"), F.col("p.scores").alias("score"),
        (F.col("pos") + 1).alias("rank"),
    ).drop(_ALL)


def _best(scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and rounded scores of the n best columns per row, ties to the lower position."""
    scores = np.round(scores, TIE_DIGITS) + 0.0
    if n >= scores.shape[1]:
        best = np.argsort(-scores, axis=1, kind="stable")
        return best, np.take_along_axis(scores, best, axis=1)
    # All columns above the n-th score, then the first of those that tie with it.
    edge = -np.partition(-scores, n - 1, axis=1)[:, n - 1 : n]
    above = scores > edge
    tied = scores == edge
    room = n - above.sum(axis=1, keepdims=True)
    chosen = above | (tied & (np.cumsum(tied, axis=1) <= room))
    best = np.nonzero(chosen)[1].reshape(len(scores), n)
    found = np.take_along_axis(scores, best, axis=1)
    order = np.argsort(-found, axis=1, kind="stable")
    return np.take_along_axis(best, order, axis=1), np.take_along_axis(found, order, axis=1)


def holdout_rows(model: SvdModel, k: int = 5, train: bool = False) -> DataFrame:
    """One row per held-out user (or train user): cell counts, error sums and top-k hits of the
    reconstruction.

    The users x items cells never leave the task that computes them.
    """
    mask = model.train_mask if train else ~model.train_mask
    test = model.interactions.where(mask)

    def cells_of(items: np.ndarray, v: np.ndarray, users: np.ndarray, x: np.ndarray) -> dict:
        r = (x @ v) @ v.T
        truth, guess = x > 0, r >= THRESHOLD
        best, _ = _best(r, k)
        return {
            "user_id": users,
            "cells": np.full(len(x), x.shape[1], dtype="int64"),
            "squared": ((x - r) ** 2).sum(axis=1),
            "absolute": np.abs(x - r).sum(axis=1),
            "tp": (truth & guess).sum(axis=1),
            "fp": (~truth & guess).sum(axis=1),
            "fn": (truth & ~guess).sum(axis=1),
            "tn": (~truth & ~guess).sum(axis=1),
            "hits": list(np.take_along_axis(truth, best, axis=1).astype("int32")),
            "n_true": truth.sum(axis=1),
        }

    return _per_block(
        model,
        test,
        cells_of,
        "user_id long, cells long, squared double, absolute double, tp long, fp long, fn long, "
        "tn long, hits array<int>, n_true long",
    )


def evaluate(model: SvdModel, k: int = 5, order: str = ranking.BEST_FIRST) -> DataFrame:
    """Per group: mse, rmse, mae, confusion cells at 0.5 with their ratios, ranking metrics."""
    g = model.group
    rows = cut(holdout_rows(model, k))
    cells = F.sum("cells")
    errors = rows.groupBy(g).agg(
        (F.sum("squared") / cells).alias("mse"),
        F.sqrt(F.sum("squared") / cells).alias("rmse"),
        (F.sum("absolute") / cells).alias("mae"),
        F.sum("tp").alias("true_positives"),
        F.sum("fp").alias("false_positives"),
        F.sum("fn").alias("false_negatives"),
        F.sum("tn").alias("true_negatives"),
    )
    tp, fp, fn, tn = (
        F.col(c)
        for c in ("true_positives", "false_positives", "false_negatives", "true_negatives")
    )
    errors = errors.select("*", *classification(tp, fp, fn, tn))
    ranks = ranking.from_hits(rows, k, order, g)
    # A group without held-out users has no figures, but it is listed.
    groups = model.factors.select(g).distinct()
    return groups.join(errors, g, "left").join(ranks, g, "left").drop(_ALL)


def _nearest(asked: np.ndarray, train: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``_best(asked @ train, n)``. Only scores over the n-th best so far are rounded and merged."""
    step = max(n, TRAIN_PER_STEP)
    best, found = _best(asked @ train[:, :step], n)
    width = found.shape[1]
    for start in range(step, train.shape[1], step):
        scores = asked @ train[:, start : start + step]
        rows, columns = np.nonzero(scores > found[:, -1:])
        if not len(rows):
            continue
        touched, rows_at = np.unique(rows, return_inverse=True)
        own = np.repeat(np.arange(len(touched)), width)
        row = np.concatenate([own, rows_at])
        at = np.concatenate([best[touched].ravel(), columns + start])
        score = np.concatenate([found[touched].ravel(), np.round(scores[rows, columns], TIE_DIGITS) + 0.0])
        order = np.lexsort((at, -score, row))
        counts = np.bincount(row)
        place = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
        order = order[place < width]
        best[touched] = at[order].reshape(-1, width)
        found[touched] = score[order].reshape(-1, width)
    return best, found


def similar_users(model: SvdModel, requests: DataFrame | None, k: int) -> DataFrame:
    """(group, user_id, neighbour, similarity, rank): cosine of user factors, the requested users
    (all without ``requests``) against every train user of their group (themselves included, as
    neighbours of rank 1).

    Users with the same row are compared as one point. A point's k nearest points by (similarity,
    smallest train user) hold its k nearest users, so k train users of each point are enough.
    """
    g = model.group
    # Equal rows are found by a digest, so that rows are not shuffled again to be compared.
    cells = F.sort_array(F.collect_list(F.struct("item", "value")))
    digest = F.unhex(F.sha2(F.to_json(F.transform(cells, lambda c: F.struct(c["item"], c["value"]))), 256))
    rows = cut(model.interactions.groupBy(g, "user_id").agg(digest.alias("row")))
    points = rows.groupBy(g, "row").agg(F.min("user_id").alias("point"))
    users = cut(rows.join(points, [g, "row"]).select(g, "user_id", "point"))
    first = users.where("user_id = point").select(g, "user_id")
    factors = user_factors(model, model.interactions.join(first, [g, "user_id"], "left_semi"))
    factors = cut(_with_group(factors, model.group_col).withColumnRenamed("user_id", "point"))

    homes = users.where(model.train_mask).withColumnRenamed("user_id", "neighbour")
    homes = cut(top_per_group(homes, [g, "point"], [F.asc("neighbour")], k, "place"))
    least = homes.where("place = 1").select(g, "point", F.col("neighbour").alias("least"))
    train = _dealt(factors.join(least, [g, "point"]), g, TRAIN_TIMES, "block")
    if requests is not None:
        users = users.join(requests.select("user_id").distinct(), "user_id", "left_semi")
    asked = factors.join(users.select(g, "point"), [g, "point"], "left_semi")
    asked = _dealt(asked, g, ASKED_TIMES, "asking")
    def tile(part: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if part.empty or wanted.empty:
            return pd.DataFrame({c: [] for c in (g, "asked", "point", "least", "similarity")})
        part = part.sort_values("least")
        f = np.ascontiguousarray(np.stack(part["factor"].to_numpy()).T)
        out = []
        for start in range(0, len(wanted), USERS_PER_BLOCK):
            some = wanted.iloc[start : start + USERS_PER_BLOCK]
            near, scores = _nearest(np.stack(some["asked_factor"].to_numpy()), f, k)
            out.append(
                pd.DataFrame(
                    {
                        g: part[g].iloc[0],
                        "asked": np.repeat(some["asked_point"].to_numpy(), near.shape[1]),
                        "point": part["point"].to_numpy()[near].ravel(),
                        "least": part["least"].to_numpy()[near].ravel(),
                        "similarity": scores.ravel(),
                    }
                )
            )
        return pd.concat(out, ignore_index=True)

    def nearest(asked: DataFrame) -> DataFrame:
        """Every block of requests meets every block of train points of its group, a tile per task."""
        left = train.join(asked.select(g, "asking").distinct(), g)
        right = asked.join(train.select(g, "block").distinct(), g)
        right = right.select(*[F.col(c).alias(f"asked_{c}") for c in right.columns])
        found = (
            left.groupBy(g, "block", "asking")
            .cogroup(right.groupBy(*[f"asked_{c}" for c in (g, "block", "asking")]))
            .applyInPandas(tile, f"{g} long, asked long, point long, least long, similarity double")
        )
        return top_per_group(found, [g, "asked"], [F.desc("similarity"), F.asc("least")], k)

    # Few blocks at a time, so the copies of the train points grow with their number, not its square.
    last = asked.agg(F.max("asking")).first()[0] or 0
    parts = []
    for start in range(0, last + 1, ASKED_BLOCKS):
        if last < ASKED_BLOCKS:
            parts.append(nearest(asked))
            break
        parts.append(cut(nearest(asked.where(F.col("asking").between(start, start + ASKED_BLOCKS - 1)))))
        free_shuffles(asked.sparkSession)
    near = reduce(DataFrame.unionByName, parts)
    near = near.drop("least", "rank").join(homes.drop("place"), [g, "point"]).drop("point")
    order = [F.desc("similarity"), F.asc("neighbour")]
    lists = top_per_group(near, [g, "asked"], order, k).withColumnRenamed("asked", "point")
    lists = lists.select(g, "point", "neighbour", "similarity", "rank")
    return users.join(lists, [g, "point"]).drop("point", _ALL)


def _dealt(points: DataFrame, g: str, times: int, name: str) -> DataFrame:
    """``points`` with the number of their block, written since both sides of the tiles read it."""
    blocks = _in_blocks(points.withColumnRenamed("point", "user_id"), g, times).drop("blocks")
    return cut(blocks.withColumnsRenamed({"user_id": "point", "block": name}))


def items_by_neighbour_index(model: SvdModel, similar: DataFrame) -> DataFrame:
    """Compatibility form of a neighbour-based list: the neighbour's position among the sorted
    train users, modulo the number of items, is read as an item position."""
    if model.group_col is not None:
        raise ValueError("defined for a model without groups")
    train = model.interactions.where(model.train_mask).select("user_id").distinct()
    places = global_position(train, "user_id", "_place").withColumnRenamed("user_id", "neighbour")
    items = model.factors.select("item", "idx")
    size = items.agg(F.count(F.lit(1))).scalar()
    return (
        similar.join(places, "neighbour")
        .withColumn("idx", F.pmod(F.col("_place"), size).cast("int"))
        .join(items, "idx")
        .select("user_id", "item", F.col("similarity").alias("score"), "rank")
    )
