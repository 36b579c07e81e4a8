"""Cutting audio into pieces, as arrays of (start, end); positions are samples or any other unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECES = "array<struct<start:bigint,end:bigint>>"


def _piece(start: Column, end: Column) -> Column:
    return F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"))


def fixed_pieces(length: Column, size: int, least: int, longest: int) -> Column:
    """Pieces of ``size``, a last one shorter than ``least`` joined to the one before; a length up to ``longest`` stays whole."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(length - 1, F.lit(0)).cast("long"), F.lit(size).cast("long"))
    tail = length - F.element_at(starts, -1)
    short = (F.size(starts) > 1) & (tail < least)
    kept = F.when(short, F.slice(starts, F.lit(1), F.size(starts) - 1)).otherwise(starts)
    pieces = F.transform(kept, lambda s, k: _piece(s, F.when(k == F.size(kept) - 1, length).otherwise(s + size)))
    return F.when(length <= longest, F.array(_piece(F.lit(0), length))).otherwise(pieces)


def grouped_pieces(segments: Column, length: Column, most: int) -> Column:
    """Speech segments put together as long as a group spans at most ``most``; longer segments are cut.

    Without segments, windows of ``most`` over the whole length; pieces without extent are left out.
    """

    def cut(s: Column) -> Column:
        return F.when(
            s["end"] - s["start"] > most,
            F.transform(F.sequence(s["start"], F.greatest(s["end"] - 1, s["start"]), F.lit(most).cast("long")), lambda a: _piece(a, F.least(a + most, s["end"]))),
        ).otherwise(F.array(_piece(s["start"], s["end"])))

    windows = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(length - 1, F.lit(0)).cast("long"), F.lit(most).cast("long")), lambda a: _piece(a, F.least(a + most, length)))
    short = F.flatten(F.transform(segments, cut))

    def put(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        fits = F.coalesce(s["end"] - last["start"] <= most, F.lit(False))
        return F.when(fits, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(_piece(last["start"], s["end"])))).otherwise(F.concat(done, F.array(s)))

    grouped = F.aggregate(short, F.array().cast(PIECES), put)
    return F.filter(F.when(F.size(segments) > 0, grouped).otherwise(windows), lambda p: p["end"] > p["start"])


def feed_pieces(length: Column, first_frames: int, hop: int, window: int, size: int, stride: int) -> Column:
    """Overlapping pieces of a stream after its first one: of ``size``, a stride of frames apart, as long as they end before the length."""
    start, step = first_frames * hop - window // 2, stride * hop
    last = length - size - 1
    starts = F.when(last >= start, F.sequence(F.lit(start).cast("long"), F.greatest(last, F.lit(start)).cast("long"), F.lit(step).cast("long")))
    return F.coalesce(F.transform(starts, lambda s: _piece(s, s + size)), F.array().cast(PIECES))


def joined(pieces: DataFrame, keys: tuple[str, ...], keep_empty: bool = False) -> DataFrame:
    """(keys, text): the texts of pieces (keys, ordinal, text) in their order, blanks between them."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    return pieces.groupBy(*keys).agg(F.array_join(texts if keep_empty else F.filter(texts, lambda t: t != ""), " ").alias("text"))


def token_budget(seconds: Column) -> Column:
    """Tokens to allow for an answer: eight for a second, between 256 and 1024."""
    return F.least(F.lit(1024), F.greatest(F.lit(256), F.floor(8 * seconds))).cast("int")
