"""Greedy grouping of segments that are rows: as many of a speaker's segments as fit go together, for any number of them.

A group begins with the first segment that doesn't fit in the one before, so each segment has a successor:
the first after it whose end is too far from its start. The segments are sorted into ranges by speaker and
start. A speaker within one range is grouped there. For one who spans ranges, each range finds by a sorted
search and pointer doubling the last group start that a chain from each of its segments comes to; then
the chain goes from range to range, again by pointer doubling where they are many, over those last starts alone. At last each
range, told where the chain enters it, makes its groups, and a group that goes over a bound is put together.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from .order import in_ranges
from .tables import written


#: Edges between ranges that go through the driver; more of them are followed as tables.
MOST_COLLECTED = 200_000
#: Pieces of a range on average: more of them make more ranges, so that a task's memory doesn't grow with the table.
A_RANGE = 500_000


def cut(segments: DataFrame, most: int) -> DataFrame:
    """Each segment (start, end) as pieces of at most ``most``; others stay."""
    start, end = F.col("start").cast("long"), F.col("end").cast("long")
    starts = F.when(end - start > most, F.sequence(start, end - 1, F.lit(most).cast("long"))).otherwise(F.array(start))
    each = segments.select("*", F.explode(starts).alias("_start"))
    return each.withColumns({"end": F.when(end - start > most, F.least(F.col("_start") + most, end)).otherwise(end), "start": F.col("_start")}).drop("_start")


def successors(start: np.ndarray, end: np.ndarray, most: int) -> np.ndarray:
    """For each of the pieces, sorted by start, the first after it that ends beyond ``most`` from its start; their number if none does.

    No piece is longer than ``most``, so none before it ends so late, and the greatest end so far can be searched.
    """
    return np.searchsorted(np.maximum.accumulate(end), start + most, side="right")


def last_starts(successor: np.ndarray) -> np.ndarray:
    """The last piece that the chain of successors from each piece comes to, by pointer doubling."""
    n = len(successor)
    at = np.where(successor < n, successor, np.arange(n))
    while True:
        further = at[at]
        if (further == at).all():
            return at
        at = further


def successors_by_run(start: np.ndarray, end: np.ndarray, runs: list[tuple[int, int]], most: int) -> np.ndarray:
    """The successors of the pieces of many speakers, a run each; where none ends beyond, the first place after the run.

    Each run is moved behind all that the one before can reach, so that one search serves as many as there are numbers for.
    """
    out = np.empty(len(start), np.int64)
    low = min(int(start.min()), int(end.min()))
    step = max(int(start.max()), int(end.max())) - low + most + 1
    some = max(1, 2**62 // step)
    for k in range(0, len(runs), some):
        own = np.array(runs[k : k + some], np.int64)
        a, b = own[0, 0], own[-1, 1]
        moved = np.repeat(np.arange(len(own)) * step, own[:, 1] - own[:, 0]) - low
        out[a:b] = successors(start[a:b] + moved, end[a:b] + moved, most) + a
    return out


def firsts(successor: np.ndarray, entry: int, stop: int) -> np.ndarray:
    """The first piece of each group from ``entry`` on."""
    out = array("q")
    while entry < stop:
        out.append(entry)
        entry = int(successor[entry])
    return np.array(out, np.int64)


def _runs(column: pa.Array) -> list[tuple[int, int]]:
    """(from, to) of each run of equal values."""
    if not len(column):
        return []
    ends = pc.run_end_encode(column).run_ends.to_pylist()
    return [*zip([0, *ends[:-1]], ends, strict=True)]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Each range's number and rows, which come one range after the other; no more than one is held."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = batch.column(batch.schema.get_field_index("part")).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.nonzero(parts[1:] != parts[:-1])[0] + 1).tolist(), len(parts)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and parts[a] != now:
                yield now, pa.Table.from_batches(held).combine_chunks()
                held = []
            now = int(parts[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held).combine_chunks()


def greedy_groups(segments: DataFrame, by: str, most: int, ranges: int | None = None) -> DataFrame:
    """(by, k, start, end): the segments (by, start, end) of each ``by`` put together as long as a group spans at most ``most``.

    Segments are taken by start, then end, and longer ones are cut first; a group ends where its last piece
    does; ``k`` counts a speaker's groups from 0. Segments that repeat count once, which makes no difference;
    those with a null are left out, and so are groups without extent, though they have a number. ``ranges`` is
    the number of ranges, which should each fit in a task's memory; by default one for A_RANGE pieces each, and
    at least the shuffle partitions' number.
    """
    kind = segments.schema[by].dataType
    pieces = cut(segments.where(F.col(by).isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull()).select(F.col(by).alias("by"), "start", "end"), most).distinct()
    if ranges is None:
        pieces = written(pieces, "group-segments")
        ranges = max(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(pieces.count() / A_RANGE))
    placed = in_ranges(pieces, "by", "start", "end", ranges=ranges)

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups of speakers that surely lie in one range; the pieces of those at its ends, each with its chain's last start."""
        for part, own in _parts(batches):
            names, start, end = own["by"].combine_chunks(), own["start"].to_numpy(), own["end"].to_numpy()
            runs = _runs(names)

            def rows(at: np.ndarray, k: np.ndarray | None, to: np.ndarray, exits: np.ndarray | None) -> pa.RecordBatch:
                none = pa.nulls(len(at), pa.int64())
                numbers = (np.full(len(at), part), at, k, start[at], to, exits, None if exits is None else start[exits])
                return pa.record_batch([names.take(pa.array(at)), *(none if c is None else pa.array(c, pa.int64()) for c in numbers)], names=shape.names)

            if inner_runs := runs[1:-1]:
                a, b = inner_runs[0][0], inner_runs[-1][1]
                begun = firsts(successors_by_run(start[a:b], end[a:b], [(x - a, y - a) for x, y in inner_runs], most), 0, b - a) + a
                heads = np.array([x for x, _ in inner_runs])
                of = np.searchsorted(heads, begun, side="right") - 1
                yield rows(begun, np.arange(len(begun)) - np.searchsorted(begun, heads)[of], end[np.append(begun[1:], b) - 1], None)
            for a, b in {runs[0], runs[-1]}:
                yield rows(np.arange(a, b), None, end[a:b], last_starts(successors(start[a:b], end[a:b], most)) + a)

    long = LongType()
    shape = StructType([StructField("by", kind), *(StructField(c, long) for c in ("part", "at", "k", "start", "end", "exit", "exit_start"))])
    once = written(placed.mapInArrow(first_pass, shape), "group-pieces")
    inner = once.where("k is not null").select("by", "k", "start", "end")
    outer = _over_ranges(once.where("k is null").drop("k"), most, shape)
    out = inner.unionByName(outer).where(F.col("end") > F.col("start"))
    return out.select(F.col("by").alias(by), F.col("k").cast("int").alias("k"), "start", "end")


def _over_ranges(pieces: DataFrame, most: int, shape: StructType) -> DataFrame:
    """(by, k, start, end) of the groups of speakers at the ends of ranges, at most two for each range."""
    spark = pieces.sparkSession
    tops: dict[object, list[tuple[int, int]]] = {}
    for r in pieces.groupBy("by", "part").agg(F.max("end").alias("top")).orderBy("part").collect():
        tops.setdefault(r["by"], []).append((r["part"], r["top"]))
    first_part = {by: own[0][0] for by, own in tops.items()}
    entries, carried = {}, {}
    if any(len(own) > 1 for own in tops.values()):
        entries, carried = _entries(pieces, most, tops)
    given = spark.sparkContext.broadcast((first_part, entries, carried))

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups by where the chain enters; the pieces before that go on with a group of an earlier range, without a number."""
        first_part, entries, carried = given.value
        for part, own in _parts(batches):
            names, at = own["by"].combine_chunks(), own["at"].to_numpy()
            start, end = own["start"].to_numpy(), own["end"].to_numpy()
            for a, b in _runs(names):
                by = names[a].as_py()
                entry = 0 if first_part[by] == part else entries.get((by, part))
                entry = b - a if entry is None else entry if first_part[by] == part else int(np.searchsorted(at[a:b], entry))
                begun = firsts(successors(start[a:b], end[a:b], most), entry, b - a) + a
                last = np.append(begun[1:], b)[: len(begun)] - 1
                k, began = pa.array(np.arange(len(begun)), pa.int64()), pa.array(start[begun], pa.int64())
                if entry:
                    last = np.insert(last, 0, a + entry - 1)
                    k, began = pa.concat_arrays([pa.nulls(1, pa.int64()), k]), pa.concat_arrays([pa.array([carried[by, part]], pa.int64()), began])
                columns = [names.take(pa.array(np.full(len(last), a))), pa.array(np.full(len(last), part)), pa.array(at[last]), k, began, pa.array(end[last])]
                yield pa.record_batch(columns, names=shape.names[:6])

    made = written(pieces.select("by", "part", "at", "start", "end").repartition("part").sortWithinPartitions("part", "at").mapInArrow(second_pass, StructType(shape.fields[:6])), "groups")
    counts: dict[object, list[tuple[int, int]]] = {}
    for r in made.groupBy("by", "part").agg(F.count("k").alias("n")).orderBy("part").collect():
        counts.setdefault(r["by"], []).append((r["part"], r["n"]))
    ahead = [(by, part, n) for by, own in counts.items() for (part, _), n in zip(own, accumulate((n for _, n in own), initial=0), strict=False)]
    kind = StructType([StructField("by", shape["by"].dataType), StructField("part", LongType()), StructField("ahead", LongType())])
    whole = made.join(F.broadcast(spark.createDataFrame(ahead, kind)), ["by", "part"])
    return whole.groupBy("by", "start").agg(F.max(F.col("k") + F.col("ahead")).alias("k"), F.max_by("end", F.struct("part", "at")).alias("end")).select("by", "k", "start", "end")


def _entries(pieces: DataFrame, most: int, tops: dict[object, list[tuple[int, int]]]) -> tuple[dict, dict]:
    """By speaker and range: the place of the piece where the chain enters, and the start of the group that is open before that."""
    spark = pieces.sparkSession
    reach = {by: ([p for p, _ in own], [*accumulate((t for _, t in own), max)]) for by, own in tops.items() if len(own) > 1}
    given = spark.sparkContext.broadcast(reach)
    nodes = pieces.where(F.col("at") == F.col("exit"))

    def targets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for by, start in zip(frame["by"].tolist(), frame["start"], strict=True):
                parts, top = given.value.get(by, ((), ()))
                k = int(np.searchsorted(top, start + most, side="right"))
                found.append(parts[k] if k < len(parts) else None)
            yield frame.assign(target=pd.array(found, "Int64"))

    shape = StructType([*(pieces.schema[c] for c in ("by", "part", "at", "start")), StructField("target", LongType())])
    sought = nodes.select("by", "part", "at", "start").mapInPandas(targets, shape).where("target is not null")
    # the first piece of the target that ends beyond: the least place among those that come before a node by descending end
    nothing = F.lit(None).cast("long")
    points = pieces.select("by", "part", F.col("end").alias("value"), F.lit(1).alias("kind"), "at", nothing.alias("node_part"), nothing.alias("node"))
    asks = sought.select("by", F.col("target").alias("part"), (F.col("start") + most).alias("value"), F.lit(0).alias("kind"), nothing.alias("at"), F.col("part").alias("node_part"), F.col("at").alias("node"))
    later = Window.partitionBy("by", "part").orderBy(F.desc("value"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    met = points.unionByName(asks).withColumn("entry", F.min("at").over(later)).where("kind = 0")
    edges = met.join(pieces.select("part", F.col("at").alias("entry"), "exit", "exit_start"), ["part", "entry"])
    edges = written(edges.select("by", "node_part", "node", "part", "entry", "exit", "exit_start"), "group-edges")
    firsts = spark.createDataFrame([(by, own[0]) for by, (own, _) in reach.items()], StructType([pieces.schema["by"], StructField("part", LongType())]))
    seeds = pieces.join(F.broadcast(firsts), ["by", "part"]).groupBy("by", "part").agg(F.min_by(F.struct("exit", "exit_start"), "at").alias("s"))
    seeds = written(seeds.select("by", "part", "s.exit", "s.exit_start"), "group-seeds")
    taken = (_chained if edges.count() <= MOST_COLLECTED else _reached)(edges, seeds)
    entries = {(r["by"], r["part"]): r["entry"] for r in taken}
    last: dict[object, dict[int, int]] = {}
    for r in [*seeds.collect(), *taken]:
        last.setdefault(r["by"], {})[r["part"]] = r["exit_start"]
    carried = {}
    for by, (parts, _) in reach.items():
        open_ = None
        for part in parts:
            carried[by, part] = open_
            open_ = last[by].get(part, open_)
    return entries, carried


def _chained(edges: DataFrame, seeds: DataFrame) -> list[Row]:
    """The edges that chains from the seeds take, gone along one by one."""
    onward, out = {(r["node_part"], r["node"]): r for r in edges.collect()}, []
    for r in seeds.collect():
        while (r := onward.get((r["part"], r["exit"]))) is not None:
            out.append(r)
    return out


def _reached(edges: DataFrame, seeds: DataFrame) -> list[Row]:
    """The edges that chains from the seeds take, at most one for each speaker and range, by pointer doubling over tables."""
    jumps = edges.select(F.col("node_part").alias("p"), F.col("node").alias("a"), F.col("part").alias("q"), F.col("exit").alias("b"))
    reached = seeds.select(F.col("part").alias("p"), F.col("exit").alias("a"))
    while jumps.limit(1).count():
        reached = written(reached.unionByName(reached.join(jumps, ["p", "a"]).select(F.col("q").alias("p"), F.col("b").alias("a"))).distinct(), "group-reached")
        twice = jumps.select("p", "a", F.col("q").alias("_p"), F.col("b").alias("_a"))
        onward = jumps.select(F.col("p").alias("_p"), F.col("a").alias("_a"), "q", "b")
        jumps = written(twice.join(onward, ["_p", "_a"]).select("p", "a", "q", "b"), "group-jumps")
    return edges.join(reached.select(F.col("p").alias("node_part"), F.col("a").alias("node")), ["node_part", "node"]).collect()
