"""Token counts of greedy longest-match word pieces, without building the pieces."""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose counts a task remembers at most; then it begins anew.
MEMORY = 500_000


class Automaton:
    """Trie of a vocabulary whose nodes know where to go on when no child fits, and how many pieces that ends.

    ``first`` holds pieces that begin a word, ``later`` those that go on. A node's failure link leads to the node
    of what is left once the longest pieces of the node's string are taken off; ``popped`` counts these
    pieces. So a word is read once, and each byte costs constant time on average.
    """

    def __init__(self, first: Iterable[bytes], later: Iterable[bytes]):
        self.next: list[dict[int, int]] = [{}, {}]
        piece = [False, False]
        for root, pieces in ((0, first), (1, later)):
            for text in pieces:
                at = root
                for byte in text:
                    at = self.next[at].get(byte) or self._grow(at, byte, piece)
                piece[at] = piece[at] or bool(text)
        self.link, self.popped = [-1] * len(piece), [0] * len(piece)
        queue = deque([0, 1])
        while queue:
            up = queue.popleft()
            for byte, at in self.next[up].items():
                queue.append(at)
                if piece[at]:
                    self.link[at], self.popped[at] = 1, 1
                    continue
                back, n = self.link[up], self.popped[up]
                while back >= 0 and byte not in self.next[back]:
                    n += self.popped[back]
                    back = self.link[back]
                if back >= 0:
                    self.link[at], self.popped[at] = self.next[back][byte], n

    def _grow(self, at: int, byte: int, piece: list[bool]) -> int:
        self.next[at][byte] = len(self.next)
        self.next.append({})
        piece.append(False)
        return len(self.next) - 1

    def count(self, word: bytes, unknown: int = 1) -> int:
        """Pieces of a word; ``unknown`` if some part of it cannot be made from the vocabulary."""
        nodes, link, popped = self.next, self.link, self.popped
        at = n = 0
        for byte in word:
            while byte not in nodes[at]:
                if link[at] < 0:
                    return unknown
                n += popped[at]
                at = link[at]
            at = nodes[at][byte]
        while at > 1:
            if link[at] < 0:
                return unknown
            n += popped[at]
            at = link[at]
        return n


class _Memory(dict):
    def __init__(self, automaton: Automaton, mark: bytes, unknown: int):
        self.automaton, self.mark, self.unknown = automaton, mark, unknown

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        n = self[word] = self.automaton.count(self.mark + word, self.unknown)
        return n


def with_counts(docs: DataFrame, first: list[bytes], later: list[bytes], text: str = "text", name: str = "n_tokens",
                mark: bytes = b"", unknown: int = 1) -> DataFrame:
    """``docs`` with the number of word pieces of each whole text.

    Words are what white space (ASCII) separates, in the case they have, with ``mark`` before them. ``first``
    and ``later`` are the pieces in UTF-8 that may begin a word and go on in it; a word that they cannot make
    counts ``unknown``. Null and empty texts have 0. Every row and column stays; a column called ``name`` is
    replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast((first, later))
    own = uuid.uuid4().hex

    @F.arrow_udf("long")
    def counts(texts: pa.Array) -> pa.Array:
        if own not in _READY:
            _READY.clear()
            _READY[own] = _Memory(Automaton(*sent.value), mark, unknown)
        count = _READY[own].__getitem__
        return pa.array([sum(map(count, t.split())) if t else 0 for t in texts.to_pylist()], pa.int64())

    return docs.withColumn(name, counts(F.col(text).cast("binary")))


#: The automaton a Python worker has built, by the call that it serves.
_READY: dict[str, _Memory] = {}
