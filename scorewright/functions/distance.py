"""Edit distances of words and characters, and error rates of a hypothesis against a reference."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import normalize, words

#: Code points that stand for words: planes 1 to 16, all of them characters to UTF-8.
FIRST_SYMBOL, SYMBOLS = 0x10000, 1 << 20
#: Cells of a table of distances up to which the built-in distance fills it.
CELLS = 1 << 17
#: The narrowest band of a long distance, and how much wider each next one is.
NARROWEST, WIDER = 64, 4
#: Numbers in an antidiagonal of a block of pairs that are split together, and how many cells they may have for each of their own.
TOGETHER, PADDED = 1 << 15, 1.6


def _code(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(SYMBOLS))


def clashes(alphabet: Column) -> Column:
    """Whether two of these different words have one code."""
    return F.size(F.array_distinct(F.transform(alphabet, _code))) < F.size(alphabet)


def _written(points: Column) -> Column:
    """The string of an array of code points, given from FIRST_SYMBOL on."""
    return F.decode(F.unhex(F.array_join(F.transform(points, lambda p: F.lpad(F.hex(p + FIRST_SYMBOL), 8, "0")), "")), "UTF-32")


def hashed(of: Column) -> Column:
    """Words as a string of one code point each, by their hash."""
    return _written(F.transform(of, _code))


def symbols(of: Column, by_hash: Column, alphabet: Column, clash: Column) -> Column:
    """Words as a string of one code point each: ``by_hash`` or, where ``clash``, by their positions in ``alphabet``.

    Above SYMBOLS different words in a pair that clashes it raises, since its words would run out of symbols.
    """
    by_place = _written(F.transform(of, lambda word: F.array_position(alphabet, word) - 1))
    return F.when(clash & (F.size(alphabet) > SYMBOLS), F.raise_error(F.lit("a pair has more different words than symbols")).cast("string")).when(clash, by_place).otherwise(by_hash)


def banded(pattern: str, text: str, band: int) -> int:
    """An upper bound of the edit distance of two strings, and the distance itself where it is at most ``band``.

    The columns of the table of distances are vectors of bits, a step up and a step down for each row. The
    text is taken in strips, and a strip's columns have just the rows within ``band`` of its diagonal: rows
    that come in begin with steps up, and what goes out above counts as a step up for each column. Both
    never make a distance too small. ``band`` is at least the difference of the lengths.
    """
    strip = max(band, NARROWEST)
    top = bottom = above = up = down = 0
    for start in range(0, len(text), strip):
        new_top, new_bottom = max(0, start - band), min(len(pattern), start + strip + band)
        gone = (1 << (new_top - top)) - 1
        above += (up & gone).bit_count() - (down & gone).bit_count()
        up, down = up >> (new_top - top), down >> (new_top - top)
        up |= ((1 << (new_bottom - bottom)) - 1) << (bottom - new_top)
        top, bottom = new_top, new_bottom
        rows, where = (1 << (bottom - top)) - 1, places(pattern[top:bottom])
        part = text[start : start + strip]
        for c in part:
            same = where.get(c, 0)
            level = ((same & up) + up ^ up) | same
            right_up, right_down = down | rows & ~(level | up), up & level
            right_up, right_down = (right_up << 1 | 1) & rows, right_down << 1 & rows
            same |= down
            up, down = right_down | rows & ~(same | right_up), right_up & same
        above += len(part)
    return above + up.bit_count() - down.bit_count()


def places(text: str) -> dict[str, int]:
    """For each character of a text the places that have it, as bits."""
    at: dict[str, list[int]] = {}
    for k, c in enumerate(text):
        at.setdefault(c, []).append(k)
    out, flags = {}, np.zeros(len(text), np.uint8)
    for c, own in at.items():
        if len(own) < 8:
            out[c] = sum(1 << k for k in own)
        else:
            flags[own] = 1
            out[c] = int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")
            flags[own] = 0
    return out


def long_distance(a: str, b: str) -> int:
    """Edit distance of two strings of any length: within a narrow band, then within wider ones until it fits."""
    least = min(len(a), len(b))
    at = next((k for k in range(least) if a[k] != b[k]), least)
    a, b = a[at:], b[at:]
    least = min(len(a), len(b))
    at = next((k for k in range(least) if a[-1 - k] != b[-1 - k]), least)
    a, b = a[: len(a) - at], b[: len(b) - at]
    if not a or not b:
        return max(len(a), len(b))
    band = max(NARROWEST, abs(len(a) - len(b)))
    while True:
        found = banded(a, b, band)
        if found <= band:
            return found
        # what was found is an upper bound, so no wider band is needed
        band = found if found < band * WIDER**2 else band * WIDER


def beyond_cells(a: Column, b: Column) -> Column:
    """Edit distance of two strings whose table has more than CELLS cells, null for others, which the built-in distance takes."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else long_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")

    beyond = F.length(a).cast("long") * F.length(b) > CELLS
    return F.pandas_udf(run, "int")(F.when(beyond, a), F.when(beyond, b))


def split_costs(h: np.ndarray, r: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edits, substitutions) of the cheapest alignments that substitute most, of a block of pairs: a column each, with ``n`` and ``m`` words.

    A substitution costs a little less than a deletion or insertion, so one distance holds both numbers; the
    lengths give the rest. An antidiagonal of all tables is filled at once from the two before it. Below a
    pair's own words stands what is in no pair; it changes nothing in the cells of its own.
    """
    rows, columns = len(h), len(r)
    unit = rows + columns + 2
    kind = np.int32 if unit * (max(rows, columns) + 2) < 2**31 else np.int64
    before, last, now = (np.zeros((rows + 1, h.shape[1]), kind) for _ in range(3))
    backward, out = r[::-1], np.zeros(h.shape[1], np.int64)
    ending: dict[int, list[int]] = {}
    for k, d in enumerate((n + m).tolist()):
        ending.setdefault(d, []).append(k)
    for d in range(max(ending, default=-1) + 1):
        a, b = max(0, d - columns), min(rows, d)
        low, high = max(a, 1), min(b, d - 1)
        if low <= high:
            cell = now[low : high + 1]
            np.minimum(last[low - 1 : high], last[low : high + 1], out=cell)
            cell += unit
            swapped = (h[low - 1 : high] != backward[columns - d + low : columns - d + high + 1]) * kind(unit - 1)
            swapped += before[low - 1 : high]
            np.minimum(cell, swapped, out=cell)
        if a == 0:
            now[0] = d * unit
        if b == d:
            now[d] = d * unit
        if (own := ending.get(d)) is not None:
            out[own] = now[n[own], own]
        before, last, now = last, now, before
    edits = -(-out // unit)
    return edits, edits * unit - out


def blocks(n: np.ndarray, m: np.ndarray) -> list[np.ndarray]:
    """Places of pairs with ``n`` and ``m`` words, in blocks of nearly the same lengths."""
    out, own, cells, rows, columns = [], [], 0, 0, 0
    for k in np.lexsort((n, m // 8)).tolist():
        x, y = int(n[k]), int(m[k])
        most, wide, cells = max(rows, x), max(columns, y), cells + (x + 1) * (y + 1)
        if own and ((len(own) + 1) * (most + 1) > TOGETHER or (len(own) + 1) * (most + 1) * (wide + 1) > PADDED * cells):
            out.append(np.array(own))
            own, cells, most, wide = [], (x + 1) * (y + 1), x, y
        own.append(k)
        rows, columns = most, wide
    return [*out, np.array(own)] if own else out


def _padded(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, other: int) -> np.ndarray:
    """The words of some pairs as columns, with ``other`` below them."""
    at = np.arange(lengths.max(initial=0))[:, None]
    inside = at < lengths
    return np.where(inside, codes[np.where(inside, starts + at, 0)] if len(codes) else other, other).astype(np.int32)


def split_words(h: pa.ListArray, r: pa.ListArray) -> pa.StructArray:
    """struct(edits, subs, dels, ins) of the pairs of two arrays of words; null arrays count as empty."""
    sides = []
    for side in (h, r):
        n = pc.fill_null(pc.list_value_length(side), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        sides.append((side.flatten(), n, np.cumsum(n) - n))
    (h_words, n, h_at), (r_words, m, r_at) = sides
    codes = pa.chunked_array([h_words, r_words]).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    h_codes, r_codes = codes[: len(h_words)], codes[len(h_words) :]
    edits, subs = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    for own in blocks(n, m):
        edits[own], subs[own] = split_costs(_padded(h_codes, h_at[own], n[own], -1), _padded(r_codes, r_at[own], m[own], -2), n[own], m[own])
    ins = (edits - subs - (m - n)) // 2
    return pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (edits, subs, edits - subs - ins, ins)], names=["edits", "subs", "dels", "ins"])


def split_counts(h: list[str], r: list[str]) -> tuple[int, int, int, int]:
    """(edits, substitutions, deletions, insertions) of the cheapest alignment of two lists of words that substitutes most."""
    kind = pa.list_(pa.string())
    return tuple(split_words(pa.array([h], kind), pa.array([r], kind))[0].as_py().values())


def edit_split(h: Column, r: Column) -> Column:
    """struct(edits, subs, dels, ins) of two arrays of words by ``split_words``."""

    def run(h: pa.Array, r: pa.Array) -> pa.Array:
        return split_words(h, r)

    return F.arrow_udf(run, "edits int, subs int, dels int, ins int")(h, r)


def spread(pairs: DataFrame, *keys: str) -> DataFrame:
    """``pairs`` dealt out by ``keys`` over all shuffle partitions, however few bytes they are: their work is in the distances."""
    return pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def prepared(texts: DataFrame, text: str, name: str) -> DataFrame:
    """``texts`` with the normal form of a text as ``name``_norm."""
    return texts.withColumn(f"{name}_norm", normalize(F.col(text)))


def with_error_rates(pairs: DataFrame, hypothesis: str = "hypothesis", reference: str = "reference", split: bool = False, rates: tuple[str, ...] = ("wer", "cer"), ready: bool = False) -> DataFrame:
    """``pairs`` with hyp_norm, ref_norm, empty_reference, and for wer: word_edits, word_n, wer; for cer: char_edits, char_n, cer.

    A null or empty side before normalising makes both rates 1. A reference that normalises to nothing has
    no rate, and is marked; its counts are 0 so that sums leave it out. With ``split`` also subs, dels, ins.

    The counts come out of a generator of one row, which a filter on a rate stays above: pushed below, it
    would have the normal forms and distances evaluated again, and the words' alphabet for each word. Ask
    only for the rates that are needed, since a generator's columns aren't pruned. Short strings' distances
    are the built-in one; of long ones the time grows with their length times their distance. Words'
    distances are those of ``split_words``, of long texts those of their symbols. ``ready`` says that both
    sides are ``prepared``, for texts that are in several pairs.
    """
    out = pairs if ready else prepared(prepared(pairs, hypothesis, "hyp"), reference, "ref")
    out = out.withColumns({"empty_reference": F.col("ref_norm") == "", "_h": words(F.col("hyp_norm")), "_r": words(F.col("ref_norm"))})
    some, counts = ~F.col("empty_reference"), {}
    if split:
        out = out.withColumn("_split", edit_split(F.col("_h"), F.when(some, F.col("_r")))).withColumn("_split", F.when(some, F.col("_split")))
        counts |= {"word_edits": F.coalesce("_split.edits", F.lit(0)), **{k: F.coalesce(f"_split.{k}", F.lit(0)) for k in ("subs", "dels", "ins")}}
    elif "wer" in rates:
        out = out.withColumn("_words", F.array_distinct(F.concat("_h", "_r")))
        long = (F.size("_h").cast("long") * F.size("_r") > CELLS) | (F.size("_words") > SYMBOLS)
        out = out.withColumn("_long", long).withColumn("_clash", F.when(F.col("_long"), clashes(F.col("_words"))))
        out = out.withColumns({f"{c}s": F.when(F.col("_long"), symbols(F.col(c), hashed(F.col(c)), F.col("_words"), F.col("_clash"))) for c in ("_h", "_r")})
        out = out.withColumn("_long_words", beyond_cells(F.col("_hs"), F.when(some, F.col("_rs"))))
        out = out.withColumn("_split", edit_split(*(F.when(some & ~F.col("_long"), F.col(c)) for c in ("_h", "_r"))))
        counts |= {"word_edits": F.when(some, F.coalesce("_long_words", "_split.edits")).otherwise(0)}
    if split or "wer" in rates:
        counts |= {"word_n": F.size("_r")}
    if "cer" in rates:
        out = out.withColumn("_long_chars", beyond_cells(F.col("hyp_norm"), F.when(some, F.col("ref_norm"))))
        counts |= {"char_n": F.length("ref_norm"), "char_edits": F.when(some, F.coalesce("_long_chars", F.levenshtein("hyp_norm", "ref_norm"))).otherwise(0)}
    counted = F.inline(F.array(F.struct(*(v.alias(k) for k, v in counts.items()))))
    out = out.select("*", counted).drop("_h", "_r", "_long", "_hs", "_rs", "_words", "_clash", "_split", "_long_words", "_long_chars")
    missing = (F.coalesce(F.col(hypothesis), F.lit("")) == "") | (F.coalesce(F.col(reference), F.lit("")) == "")
    of = {"wer": "word", "cer": "char"}
    return out.withColumns({name: F.when(missing, 1.0).otherwise(F.try_divide(f"{of[name]}_edits", f"{of[name]}_n")) for name in rates})
