"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most ids (8 bytes each) that are sent to every executor; beyond it both sides are shuffled.
BROADCAST_IDS = 2_000_000


def only_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` occurs in the stored table ``ids``, without shuffling the wide rows while the ids are few."""
    wanted = ids.select(key).distinct()
    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(wanted) if few else wanted, key, "left_semi")
