"""A leaderboard that follows a folder with state: each run's facts, by name and dataset, and none of its samples."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import board
from .board_stream import run_stream

#: A run's facts as they are kept.
FACT = "model string, language string, num_samples bigint, primary_reference string, results map<string,struct<wer:double,cer:double,substitutions:bigint,deletions:bigint,insertions:bigint,num_samples:bigint>>, speed map<string,double>"


def facts(runs: DataFrame) -> DataFrame:
    """(name, dataset, file, fact) of runs: what a board needs of each, as JSON, without samples."""
    named = board.named(runs)
    return named.select("name", "dataset", "file", F.to_json(F.struct("model", "language", "num_samples", "primary_reference", "results", "speed")).alias("fact"))


def remembered(stream: DataFrame) -> DataFrame:
    """The facts of all runs of each name and dataset that a batch has changed, from state that holds them by file.

    A file that comes again replaces what it said. State grows with the number of runs, a few hundred bytes
    each, and a batch touches just the names and datasets of its new files.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        files, texts = (list(x) for x in (state.get if state.exists else ([], [])))
        held = dict(zip(files, texts, strict=True))
        for frame in frames:
            held |= dict(zip(frame["file"], frame["fact"], strict=True))
        state.update(([*held], [*held.values()]))
        yield pd.DataFrame({"name": key[0], "dataset": key[1], "file": [*held], "fact": [*held.values()]})

    return facts(stream).groupBy("name", "dataset").applyInPandasWithState(update, "name string, dataset string, file string, fact string", "files array<string>, facts array<string>", "update", GroupStateTimeout.NoTimeout)


def runs_of(facts_: DataFrame) -> DataFrame:
    """Rows of facts as runs again, as a board takes them."""
    return facts_.select("file", "dataset", F.from_json("fact", FACT).alias("f")).select("file", "dataset", "f.*")


def follow_with_state(spark: SparkSession, folder: str, facts_folder: str, board_folder: str, checkpoint: str, exclude_failed: bool = False) -> StreamingQuery:
    """Keeps the board of a growing folder; ends when what is there is done.

    A batch reads its new files, takes the facts of what they change out of state, puts them over those of the
    last board, and writes that board anew; samples of earlier batches aren't read again. The facts are written
    under the batch's number, so a batch that is repeated after a failure gives the same.
    """

    def put(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        before = f"{facts_folder}/{number - 1}"
        changed = batch.select("name", "dataset", "file", "fact")
        if number > 0:
            keys = changed.select("name", "dataset").distinct()
            changed = changed.unionByName(session.read.parquet(before).join(keys, ["name", "dataset"], "left_anti"))
        changed.write.mode("overwrite").parquet(f"{facts_folder}/{number}")
        board.leaderboard(runs_of(session.read.parquet(f"{facts_folder}/{number}")), exclude_failed).write.mode("overwrite").parquet(board_folder)

    stream = remembered(run_stream(spark, folder))
    return stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
