"""Tables that are written once in the folder that driver and executors share, and read from there on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset the warehouse, or in local mode a temporary folder."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place and not spark.sparkContext.master.startswith("local"):
        place = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scorewright-tables"
    if not place:
        place = "file://" + tempfile.mkdtemp(prefix="scorewright-")
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table read back: its plan ends here, so that no use repeats its work and a lost executor costs a read."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
