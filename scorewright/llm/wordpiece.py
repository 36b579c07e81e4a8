"""Lengths of greedy word-piece encodings by a linear longest-match automaton.

The vocabulary's word-initial and continuing pieces are two tries. A failure link leads from a node
to where matching goes on once the longest pieces on its path are taken; how many pieces are taken
then is counted beforehand. A word's length is thus found in one pass over its characters, without
going back and without building a piece.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, small_batches, texts_of

#: Words: runs of letters, digits and underscores, or one other character that isn't white space.
WORD = re.compile(r"\w+|[^\w\s]")
START, INSIDE, NOWHERE = 0, 1, -1


class Automaton:
    """Counts of word pieces for a vocabulary of word-initial and continuing pieces."""

    def __init__(self, initial: Iterable[str], continuing: Iterable[str]) -> None:
        self.next: list[dict[str, int]] = [{}, {}]
        piece = [False, False]
        for root, pieces in ((START, initial), (INSIDE, continuing)):
            for p in filter(None, pieces):
                at = root
                for c in p:
                    to = self.next[at].get(c)
                    if to is None:
                        to = self.next[at][c] = len(self.next)
                        self.next.append({})
                        piece.append(False)
                    at = to
                piece[at] = True
        self.fail, self.popped = [NOWHERE] * len(self.next), [0] * len(self.next)
        queue = deque([START, INSIDE])
        while queue:
            at = queue.popleft()
            for c, to in self.next[at].items():
                if piece[to]:
                    self.fail[to], self.popped[to] = INSIDE, 1
                else:
                    back, n = self.fail[at], self.popped[at]
                    while back != NOWHERE and c not in self.next[back]:
                        n += self.popped[back]
                        back = self.fail[back]
                    if back != NOWHERE:
                        self.fail[to], self.popped[to] = self.next[back][c], n
                queue.append(to)

    def length(self, word: str) -> int:
        """Pieces of a word; 0 if the vocabulary can't build it."""
        at, n = START, 0
        steps, fail, popped = self.next, self.fail, self.popped
        for c in word:
            while c not in steps[at]:
                n += popped[at]
                at = fail[at]
                if at == NOWHERE:
                    return 0
            at = steps[at][c]
        while at > INSIDE:
            n += popped[at]
            at = fail[at]
        return n if at == INSIDE else 0


class Lengths(dict):
    """Lengths by word, remembered up to a bound; a word that can't be built counts as one unknown token."""

    def __init__(self, automaton: Automaton, most: int = 500_000) -> None:
        super().__init__()
        self.automaton, self.most = automaton, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        out = self[word] = self.automaton.length(word)
        return out


def sentencepiece_pieces(path: str) -> tuple[list[str], list[str]]:
    """Word-initial and continuing pieces of a sentencepiece model: those with its blank mark, and the others."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]
    return [p[1:] for p in plain if p[0] == "▁"], [p for p in plain if p[0] != "▁"]


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) for each row of ``docs`` (doc_id, text).

    ``vocabulary`` is the path of a sentencepiece model whose pieces serve as word pieces. A word that
    they can't build is one token and one unknown. A null or empty text has none of all; null or
    repeated doc_ids stay; extra columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(Automaton(*sentencepiece_pieces(vocabulary)))
        for batch in small_batches(batches):
            words, tokens, unknown = [], [], []
            for text in texts_of(batch):
                each = [*map(lengths.__getitem__, WORD.findall(text))]
                words.append(len(each))
                unknown.append(each.count(0))
                tokens.append(sum(each) + unknown[-1])
            yield pa.record_batch([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, tokens, unknown))], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return documents(docs).mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
