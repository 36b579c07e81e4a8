"""Benchmark passages in documents, within an error budget, by pigeonhole filtering.

Texts are compared as their words in lower case, with one blank between them and at both ends, so that
a match begins and ends with words unless it spends edits on that. An item may differ from a
passage by as many edits as a share of its length allows. Cut into one piece more than that, it keeps
at least one piece unharmed wherever it occurs, so an automaton over all pieces finds each place that
can hold it. Only these places are verified, by Myers' bit-parallel distance of the whole item to
the best-fitting stretch there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, small_batches, texts_of

#: Edits allowed for each character of an item.
ERRORS = 0.08
#: Characters of items that are broadcast at once; a larger benchmark is taken in blocks.
BLOCK_CHARS = 8_000_000
WORD = re.compile(r"\w+")


def normalised(text: str) -> str:
    """A text's words in lower case, as many as it has; of all letters only the replaced one would grow by a mark."""
    return " ".join(WORD.findall(text.replace("\u0130", "I").lower()))


def pieces(item: str, budget: int) -> Iterator[tuple[int, str]]:
    """(place, piece) of an item cut into budget + 1 nearly equal pieces."""
    n = budget + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return ((a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True))


def best_fit(item: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the stretch of ``text`` nearest to ``item``, the first of equals; None beyond ``most`` edits.

    The columns of the distance table are bit vectors as long as the item, one step for each character.
    """
    m = len(item)
    at: dict[str, int] = {}
    for k, c in enumerate(item):
        at[c] = at.get(c, 0) | 1 << k
    ones, high = (1 << m) - 1, 1 << (m - 1)
    up, down, distance, best = ones, 0, m, None
    for end, c in enumerate(text, 1):
        equal = at.get(c, 0)
        vertical = equal | down
        diagonal = (((equal & up) + up) ^ up) | equal
        plus, minus = down | (ones & ~(diagonal | up)), up & diagonal
        if plus & high:
            distance += 1
        elif minus & high:
            distance -= 1
        plus, minus = (plus << 1) & ones, (minus << 1) & ones  # a stretch may begin anywhere, so no edit comes in
        up, down = minus | (ones & ~(vertical | plus)), plus & vertical
        if distance <= most and (best is None or distance < best[0]):
            best = distance, end
    return best


def begin_of(item: str, text: str, end: int, distance: int) -> int:
    """Where the stretch that ends at ``end`` and is ``distance`` edits from ``item`` begins: the fit of the reversed texts."""
    low = max(0, end - len(item) - distance)
    fit = best_fit(item[::-1], text[low:end][::-1], distance)
    return end - fit[1] if fit else low


class Matcher:
    """Finds benchmark items in normalised texts."""

    def __init__(self, items: list[tuple[int, str]], errors: float) -> None:
        self.items = [(i, f" {t} ", int(errors * len(t))) for i, t in items if t]
        self.automaton = ahocorasick.Automaton()
        of: dict[str, list[tuple[int, int]]] = {}
        for n, (_, item, budget) in enumerate(self.items):
            for place, piece in pieces(item, budget):
                of.setdefault(piece, []).append((n, place))
        for piece, uses in of.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if of:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) in a normalised text: each item's best fit, the first of equals."""
        if not len(self.automaton):
            return []
        text = f" {text} "
        places: dict[int, set[int]] = {}
        for last, (size, uses) in self.automaton.iter(text):
            for n, place in uses:
                places.setdefault(n, set()).add(last + 1 - size - place)
        out = []
        for n, starts in places.items():
            item_id, item, budget = self.items[n]
            best = None
            low = high = None
            for start in [*sorted(starts), None]:
                if low is not None and (start is None or start > high + 2 * budget + len(item)):
                    a, b = max(0, low - budget), min(len(text), high + len(item) + budget)
                    fit = best_fit(item, text[a:b], budget)
                    if fit and (best is None or fit[0] < best[0]):
                        best = fit[0], a + fit[1]
                    low = None
                if start is not None:
                    low, high = (start if low is None else low), start
            if best:
                start, end = begin_of(item, text, best[1], best[0]), best[1]
                start += text[start : start + 1] == " "
                end -= end > start and text[end - 1] == " "
                out.append((item_id, best[0], start - 1, end - 1))
        return sorted(out)


def leaks(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS) -> DataFrame:
    """(doc_id, item_id, distance, start, end) for each item of ``benchmark`` (item_id, text) in a row of ``docs`` (doc_id, text).

    start and end are code points of the text from its first to its last matching word. Rows repeat
    where ``docs`` has a row twice. Items or texts that are null, empty or without words match nothing;
    an item without id is left out; items that repeat an id are items of their own. An item too short
    for an edit must occur as it is. Extra columns are left out.
    """
    found = None
    for given in _blocks(benchmark):
        part = documents(docs).mapInArrow(_finder(given, errors), "doc_id long, item_id long, distance int, start long, end long")
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], "doc_id long, item_id long, distance int, start long, end long")


def _blocks(benchmark: DataFrame) -> Iterator:
    """The items, normalised, as broadcasts of bounded size."""
    items = benchmark.where("item_id is not null and text is not null").select("item_id", "text")
    n_blocks = -(-(items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0) // BLOCK_CHARS)
    for n in range(n_blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == n).collect()
        yield benchmark.sparkSession.sparkContext.broadcast(sorted((r["item_id"], normalised(r["text"])) for r in own))


def _finder(given, errors: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(given.value, errors)
        for batch in small_batches(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                plain = normalised(text)
                for item_id, distance, start, end in matcher.find(plain):
                    a, b = _in_text(text, plain, start, end)
                    rows.append((doc_id, item_id, distance, a, b))
            columns = [*zip(*rows, strict=True)] or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "distance", "start", "end"])

    return run


def _in_text(text: str, plain: str, start: int, end: int) -> tuple[int, int]:
    """Code points of ``text`` of the words that ``start`` to ``end`` of its normalised form touch."""
    first, last = plain.count(" ", 0, start), plain.count(" ", 0, max(start, end - 1))
    if plain[start : start + 1] == " ":
        first += 1
    a = b = 0
    at = 0
    # a normalised text has the words of the text, in their order
    for n, m in enumerate(WORD.finditer(text)):
        if n == first:
            a = m.start()
        if n == last:
            b = m.end()
            break
        at = m.end()
    return a, max(b, a if b else at)


def clean_documents(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no item of ``benchmark``; null and empty texts stay."""
    for given in _blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(given.value, errors)
            for batch in small_batches(batches):
                yield batch.filter(pa.array([not matcher.find(normalised(t)) for t in texts_of(batch)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
