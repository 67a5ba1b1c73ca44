"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the holdout hash: a multiplier, a seed multiplier and the modulus 2^32.
HASH_MULTIPLIER = 2654435761
HASH_SEED_MULTIPLIER = 40503
HASH_MODULUS = 4294967296


def is_train(id_col: str, test_size: float = 0.2, seed: int = 42) -> Column:
    """Holdout mask from an integer id: same answer on every run, cluster and partitioning."""
    spread = F.pmod(F.col(id_col).cast("long"), F.lit(2147483648)) * F.lit(HASH_MULTIPLIER)
    bucket = (spread + F.lit(seed * HASH_SEED_MULTIPLIER)) % F.lit(HASH_MODULUS)
    return bucket >= F.lit(int(test_size * HASH_MODULUS))


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``, 0 where the bottom is 0 or missing."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def ids_text(items: str | Column) -> Column:
    """A sorted array as comma-separated text (comparable across engines)."""
    col = F.col(items) if isinstance(items, str) else items
    return F.array_join(F.sort_array(col).cast("array<string>"), ",")


def contains_all(items: Column, wanted: Column) -> Column:
    return F.size(F.array_except(wanted, items)) == 0


def rounded(*names: str, digits: int = 6) -> list[Column]:
    return [F.round(F.col(n), digits).alias(n) for n in names]
