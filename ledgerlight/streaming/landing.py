"""Landing folders: files that have come since the last run become rows of a table, once.

A run takes every file that no earlier run has taken and ends. What was taken is in the checkpoint, what
was stored is in the table's own log, and a batch of files enters that log whole: a run that was killed
between the two is finished by the next one, without a lost or repeated row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.operators.merge import keep_first

KEPT_BATCHES = "spark.sql.streaming.numRecentProgressUpdates"


def arriving_csv(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 10_000) -> DataFrame:
    """CSV files with a header as a stream, with `landed_from` (file) and `landed_at` (its time).

    A file whose header isn't that of `schema` stops the run with an error instead of shifting columns.
    `folder` may hold wildcards; files whose names begin with `_` or `.` are skipped.
    """
    rows = (
        spark.readStream.schema(schema).option("header", True).option("enforceSchema", False).option("escape", '"')
        .option("maxFilesPerTrigger", files_per_batch).csv(folder)
    )
    return rows.withColumns({"landed_from": F.col("_metadata.file_path"), "landed_at": F.col("_metadata.file_modification_time")})


def land(arriving: DataFrame, table: str, checkpoint: str) -> int:
    """Store the rows of all new files below `table`; their number, 0 if no file is new."""
    conf = arriving.sparkSession.conf
    usual = conf.get(KEPT_BATCHES)
    conf.set(KEPT_BATCHES, "1000000")  # the number of rows is summed over all batches of the run
    try:
        run = (
            arriving.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start()
        )
    finally:
        conf.set(KEPT_BATCHES, usual)
    run.awaitTermination()
    return sum(batch["numInputRows"] for batch in run.recentProgress)


def landed(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """The stored rows: those of files in the table's log, whatever else a killed run has left there."""
    return spark.read.schema(f"{schema}, landed_from string, landed_at timestamp").parquet(table)


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, from the file that came last; equal times by file name, equal files by the row's values."""
    values = [F.desc(c) for c in rows.columns if c not in [*keys, "landed_at", "landed_from"]]
    return keep_first(rows, keys, [F.desc("landed_at"), F.desc("landed_from"), *values]).drop("landed_at", "landed_from")
