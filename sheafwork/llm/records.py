"""Reading the label dataset: one state per record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_state(rows: DataFrame, *columns: str, key: str = "requirement_uid", time: str = "built_at") -> DataFrame:
    """The row of each key with the greatest time (a NULL time is oldest; ties: the greatest values, so that any order of rows gives the same).

    A hash-free sort aggregate is avoided: ``max`` over a struct of the needed columns only, combined map-side. Rows without a key are dropped.
    """
    if not {key, *columns} - {key}:
        return rows.where(F.col(key).isNotNull()).select(key).distinct()
    state = F.max(F.struct(F.col(time).alias("_t"), *columns)).alias("_s")
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(state).select(key, *[F.col(f"_s.{c}").alias(c) for c in columns])


def record_texts(rows: DataFrame, text: str, key: str = "requirement_uid") -> DataFrame:
    """(record, text) for every row with a key; all rows of a record agree on the text, so repeats are removed later, on digests."""
    return rows.where(F.col(key).isNotNull()).select(F.col(key).alias("record"), F.col(text).alias("text"))
