"""What the operators of this package share: input columns, shared tables, hashing and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multipliers of the mixing steps (fixed values).
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the Parquet tables in ``sf_dir``, by any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset the warehouse, or in local mode a temporary one."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place and not spark.sparkContext.master.startswith("local"):
        place = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scorewright-tables"
    if not place:
        place = "file://" + tempfile.mkdtemp(prefix="scorewright-")
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table", rows_a_file: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from the written table.

    Cuts the lineage, so that a costly step isn't repeated for each use and a lost executor
    costs only a read. ``rows_a_file``, if not 0, keeps files of large rows small enough to be read one by one.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", rows_a_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(df: DataFrame) -> DataFrame:
    """doc_id and text of a documents table, whatever else it has; a null text counts as empty."""
    return df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_A
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_B
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values of whole numbers in ascending order, by a sort."""
    x = np.sort(x)
    fresh = np.ones(len(x), bool)
    fresh[1:] = x[1:] != x[:-1]
    return x[fresh]


class WordHashes(dict):
    """64-bit hashes by word; forgets all when it has ``most`` of them, to bound a worker's memory."""

    def __init__(self, most: int = 250_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A string column as a list, nulls as empty strings."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, which bounds what a worker holds of long texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
