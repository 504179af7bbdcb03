"""Results that arrive as files: appended once per key, with the engine's batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sheafwork.sources.writers import append_new


def append_results(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, key: str = "requirement_uid") -> StreamingQuery:
    """Each new file's successful rows are appended once per key; a restarted query goes on where it stopped and adds nothing twice."""
    stream = spark.readStream.schema(schema).json(source).where("status = 'ok'")
    return stream.writeStream.foreachBatch(lambda rows, _: append_new(rows.dropDuplicates([key]), target, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(stream: DataFrame, time: str, width: str, late: str, *by: str) -> DataFrame:
    """Rows per time window and group; rows later than ``late`` are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"))
