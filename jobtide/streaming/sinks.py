"""Where streams put their rows: the rows that a trigger made or changed, in a folder of that trigger. What a stream remembers lies in its checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from jobtide.sources.shared import exists


def write_triggers(stream: DataFrame, path: str, checkpoint: str, mode: str) -> StreamingQuery:
    """Write each trigger's rows to ``path/batch=n`` until the files present are worked off; a repeated trigger replaces its own folder."""

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rows_written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all triggers, with the number of the trigger as ``batch``; none before the first one."""
    layout = f"{schema}, batch bigint"
    return spark.read.schema(layout).parquet(path) if exists(spark, path) else spark.createDataFrame([], layout)


def latest_rows(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """Each key's row as the last trigger that changed it left it, for streams in update mode."""
    rows = rows_written(spark, path, schema)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
    return last.select(*[c if c in keys else F.col(f"last.{c}").alias(c) for c in rows.columns if c != "batch"])
