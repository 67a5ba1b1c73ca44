"""Factor models restricted to each user's own recommended items.

A user's list of items and segment name a small matrix: the counts of all users of the segment on
these items. Users with the same segment and list share it. Its Gram matrix is a part of the
segment's, so the cells of all lists are looked up by one join, and the small matrices (at most
LIST_LENGTH wide) are decomposed in batches; neither the counts nor the users are read per list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlab.operators import factor
from basketlab.session import cut

LIST_LENGTH = 10
# Gram cells that are sent to the lists; more are met through a shuffle.
SENT_CELLS = 100_000


def _projections(n_components: int):
    """V V' of the leading right singular vectors of each list's matrix, from its Gram cells."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            lens = part["items"].map(len).to_numpy()
            width = int(lens.max(initial=0))
            gram = np.zeros((len(part), width, width))
            for k, cells in enumerate(part["cells"]):
                for c in cells:
                    gram[k, c["i"], c["j"]] = gram[k, c["j"], c["i"]] = c["dot"]
            values, vectors = np.linalg.eigh(gram)
            # Ascending order: the last ones lead. Values within the noise of the arithmetic go.
            floor = values[:, -1:].clip(0) * width * np.finfo(float).eps
            keep = (values > floor) & (np.arange(width) >= width - n_components)
            vectors = vectors * keep[:, None, :]
            whole = vectors @ vectors.transpose(0, 2, 1)
            yield pd.DataFrame(
                {
                    "cluster": part["cluster"],
                    "items": part["items"],
                    "projection": [list(map(list, p[:n, :n])) for p, n in zip(whole, lens)],
                }
            )

    return run


def recommend(
    lists: DataFrame, people: DataFrame, counts: DataFrame, n: int = 5, n_components: int = 50
) -> DataFrame:
    """(user_id, item, score, rank): the ``n`` best items of x V V' in the model of the user's list.

    ``lists`` (user_id, item) holds at most LIST_LENGTH items per user, ``people`` (user_id,
    cluster), ``counts`` (user_id, item, value). The matrix of a list has a row for each user of the
    segment with a count on it; a user without one gets no row here, so the base list stands in.
    """
    held = (
        lists.select("user_id", "item")
        .join(people.select("user_id", "cluster"), "user_id")
        .join(counts.select("user_id", "item", "value"), ["user_id", "item"], "left")
    )
    entry = F.struct("item", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("x"))
    users = (
        held.groupBy("user_id", "cluster")
        .agg(F.sort_array(F.collect_list(entry)).alias("c"), F.count("value").alias("n_known"))
        .where("n_known > 0")
        .select("user_id", "cluster", F.col("c.item").alias("items"), F.col("c.x").alias("x"))
    )
    users = cut(users)
    sets = users.select("cluster", "items").distinct()
    left = sets.select("cluster", "items", F.posexplode("items").alias("i", "item_i"))
    pairs = left.select("*", F.posexplode("items").alias("j", "item_j")).where("i <= j")
    grouped = counts.select("user_id", "item", "value").join(people.select("user_id", "cluster"), "user_id")
    # The planner does not see that a list becomes 55 pairs, so it may take few lists for the smaller
    # side and broadcast their pairs; the side to send is chosen by the number of cells instead.
    gram = cut(factor.gram_cells(grouped, "cluster"))
    gram = F.broadcast(gram) if gram.count() <= SENT_CELLS else gram.hint("merge")
    cells = (
        pairs.join(gram, ["cluster", "item_i", "item_j"])
        .groupBy("cluster", "items")
        .agg(F.collect_list(F.struct("i", "j", "dot")).alias("cells"))
    )
    item_type = dict(sets.dtypes)["items"]
    cluster_type = dict(sets.dtypes)["cluster"]
    models = cells.mapInPandas(
        _projections(n_components), f"cluster {cluster_type}, items {item_type}, projection array<array<double>>"
    )

    def dot(row):
        return F.aggregate(F.zip_with(row, "x", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)

    # Both sides may be many times as large as the planner thinks (files are compressed, a list grows
    # to a matrix), so neither is broadcast.
    scored = users.hint("merge").join(models, ["cluster", "items"]).select(
        "user_id", F.arrays_zip("items", F.transform("projection", dot).alias("scores")).alias("p")
    )
    # Best first, ties to the lower item, scores compared after rounding.
    order = F.transform(
        "p", lambda p: F.struct((-F.round(p["scores"], factor.TIE_DIGITS)).alias("key"), p["items"].alias("item"))
    )
    best = F.slice(F.sort_array(order), 1, n)
    return scored.select("user_id", F.posexplode(best).alias("pos", "b")).select(
        "user_id", F.col("b.item").alias("item"), (F.lit(0.0) - F.col("b.key")).alias("score"), (F.col("pos") + 1).alias("rank")
    )
