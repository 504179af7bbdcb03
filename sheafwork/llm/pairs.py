"""Exact check of candidate pairs on word sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_overlap(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds ``overlap`` (distinct words in both / in either) to pairs (a, b); ``sets`` has (id, words), one row per id."""
    a = sets.select(F.col("id").alias("a"), F.col("words").alias("wa"))
    b = sets.select(F.col("id").alias("b"), F.col("words").alias("wb"))
    both = F.size(F.array_intersect("wa", "wb"))
    return pairs.join(a, "a").join(b, "b").withColumn("_n", both).withColumn("overlap", F.col("_n") / (F.size("wa") + F.size("wb") - F.col("_n"))).drop("wa", "wb", "_n")
