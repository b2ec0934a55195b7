"""Join sides of checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 500_000  # rows of at most about 40 bytes: 20 MB


def near_side(small: DataFrame, measured: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``small`` with a broadcast hint while the stored ``measured`` has few rows; beyond, the join shuffles.

    ``measured`` has one short row for every element that ``small`` holds, so arrays count in full.
    """
    return F.broadcast(small) if measured.limit(rows + 1).count() <= rows else small
