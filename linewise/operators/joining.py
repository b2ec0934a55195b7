"""Join helpers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from linewise.session import cut_lineage

BROADCAST_CELLS = 1_000_000  # numbers or short texts: about 30 MB


def match_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join on ``keys`` where null equals null; ``left`` keeps its key columns."""
    if not keys:
        return left.crossJoin(right)  # without keys the right side is one global row
    renamed = right.select(
        *[F.col(key).alias(f"__{key}") for key in keys],
        *[name for name in right.columns if name not in keys],
    )
    condition = reduce(
        lambda a, b: a & b, [left[key].eqNullSafe(renamed[f"__{key}"]) for key in keys]
    )
    joined = left.join(renamed, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__{key}" for key in keys])


def lookup_join(
    big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner", limit: int = BROADCAST_CELLS
) -> DataFrame:
    """``match_join`` for a derived side that is usually tiny.

    The small side is stored, and its cells (columns of every row, and every array element)
    are counted while it is written: up to ``limit`` cells it is broadcast, so the big side
    keeps its partitions and is not shuffled; above that the join is an ordinary
    shuffle join. A stage that is run again may count rows twice, which only turns a broadcast into a shuffle.
    """
    arrays = [name for name, kind in small.dtypes if kind.startswith(("array", "map"))]
    cells = reduce(lambda a, b: a + b, [F.greatest(F.lit(0), F.coalesce(F.size(name), F.lit(0))) for name in arrays], F.lit(len(small.columns)))
    written = Observation()
    stored = cut_lineage(small.observe(written, F.sum(cells.cast("long")).alias("cells")))
    fits = (written.get["cells"] or 0) <= limit
    return match_join(big, F.broadcast(stored) if fits else stored, keys, how)
