"""A leaderboard that follows a folder of result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.board import leaderboard
from ..sources.runs import run_schema, unified


def run_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The runs of a folder's result files as a stream; each file is read once, when it first appears."""
    raw = spark.readStream.schema(run_schema()).option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("pathGlobFilter", "*.json").json(folder)
    return unified(raw.withColumn("file", F.col("_metadata.file_name")).where("file <> 'leaderboard.json'"))


def follow(spark: SparkSession, folder: str, runs_folder: str, board_folder: str, checkpoint: str, exclude_failed: bool = False) -> StreamingQuery:
    """Land new runs as Parquet and write the board anew after each batch; ends when what is there is done.

    A later file can replace an earlier run, so the small board is made again from all landed runs. A batch
    that is repeated after a failure overwrites its own folder, so no run is landed twice.
    """

    def land(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{runs_folder}/batch={number}")
        landed = batch.sparkSession.read.parquet(runs_folder)
        # of a file that came again the last reading counts
        newest = landed.groupBy("file").agg(F.max("batch").alias("batch"))
        leaderboard(landed.join(newest, ["file", "batch"], "left_semi").drop("batch"), exclude_failed).write.mode("overwrite").parquet(board_folder)

    return run_stream(spark, folder).writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
