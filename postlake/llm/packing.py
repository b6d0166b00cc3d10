"""Packing of token sequences into windows of a fixed length, with a bounded number of open windows."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.llm.shared import stored

#: The split into words that belongs to the vocabulary; a fixed value.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: A long run of white space before a word, from its beginning; the engine of the pattern fails at a million.
SPACES = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LONG_RUN = 100_000
_RUN = re.compile(rf"(?<!{SPACES}){SPACES}{{{LONG_RUN},}}+(?!\Z)")
MERGED = 1 << 62
#: Finished windows that leave together: 2 MB of ids at 1024 a window.
SENT = 500


@lru_cache(maxsize=2)
def encoder(ranks: str):
    import base64

    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("bytes", pat_str=WORDS, mergeable_ranks=table, special_tokens={})


def added_tokens(vocabulary: str) -> dict[str, int]:
    """The tokens that the JSON of a vocabulary adds to its merges, with their ids."""
    with open(vocabulary, encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in tokens):
        raise ValueError("added tokens that depend on what stands beside them are not supported")
    return {t["content"]: t["id"] for t in tokens}


def encode(text: str, ranks: str, added: dict[str, int] | None = None) -> np.ndarray:
    """The ids of a text. A token of ``added`` has its id wherever it stands; what lies between is encoded by itself."""
    if not any(token in text for token in added or ()):
        return _plain(text, ranks)
    wanted = "|".join(map(re.escape, sorted(added, key=len, reverse=True)))
    return np.concatenate([np.array([added[part]], np.uint32) if at % 2 else _plain(part, ranks)
                           for at, part in enumerate(re.split(f"({wanted})", text))])


def _plain(text: str, ranks: str) -> np.ndarray:
    """Ids of a text without added tokens. Long runs of white space are cut out where the pattern cuts as well: at their
    beginning and before their last character."""
    ids = encoder(ranks).encode_to_numpy
    if len(text) <= LONG_RUN:
        return ids(text, disallowed_special=())
    edges = [0, *(at for run in _RUN.finditer(text) for at in (run.start(), run.end() - 1)), len(text)]
    return np.concatenate([ids(text[a:b], disallowed_special=()) for a, b in zip(edges, edges[1:], strict=False)])


class Packer:
    """``open_windows`` windows of ``size`` tokens; a piece goes where it leaves the least room.

    Where no window has room, the fullest is filled up with the head of the piece and leaves. ``sent``
    collects finished windows as lists of pieces (document, start, ids, document's tokens).
    """

    def __init__(self, size: int, open_windows: int):
        self.size, self.sent = size, []
        self.room, self.held = [size] * open_windows, [[] for _ in range(open_windows)]

    def _leave(self, at: int):
        self.sent.append(self.held[at])
        self.room[at], self.held[at] = self.size, []

    def put(self, doc, start: int, ids: np.ndarray, total: int):
        while len(ids) >= self.size:
            self.sent.append([(doc, start, ids[:self.size], total)])
            start, ids = start + self.size, ids[self.size:]
        while len(ids):
            fits = [r for r in self.room if r >= len(ids)]
            at = self.room.index(min(fits) if fits else min(self.room))
            cut = min(self.room[at], len(ids))
            self.held[at].append((doc, start, ids[:cut], total))
            self.room[at] -= cut
            start, ids = start + cut, ids[cut:]
            if not self.room[at]:
                self._leave(at)

    def rest(self) -> list:
        return [held for held in self.held if held]

    def close(self):
        """Join what is still open: all windows but the last leave full."""
        pieces = [piece for held in self.rest() for piece in held]
        window, room = [], self.size
        for doc, start, ids, total in pieces:
            while len(ids):
                cut = min(room, len(ids))
                window.append((doc, start, ids[:cut], total))
                start, ids, room = start + cut, ids[cut:], room - cut
                if not room:
                    self.sent.append(window)
                    window, room = [], self.size
        if window:
            self.sent.append(window)


def _rows(windows: list, first: int) -> dict[str, list]:
    out = {"doc": [], "start": [], "ids": [], "doc_tokens": [], "sequence_id": [], "offset": []}
    for number, window in enumerate(windows, first):
        offset = 0
        for doc, start, ids, total in window:
            for name, value in zip(out, (doc, start, ids.tobytes(), total, number, offset), strict=True):
                out[name].append(value)
            offset += len(ids)
    return out


def pack(docs: DataFrame, ranks: str, key: str = "doc_id", text: str = "text", size: int = 1024,
         open_windows: int = 16, end_id: int = 0, merge: int = 4, added: dict[str, int] | None = None) -> DataFrame:
    """Token sequences of at most ``size`` ids that hold every id of every document exactly once.

    Each partition of the input is packed where it is read; what stays open of ``merge`` neighbouring
    partitions is packed together at the end, so there is padding in one sequence of each such group at
    most. Texts are encoded whole, tokens of ``added`` by their ids, and end with ``end_id``; a null or empty text has that id alone, and
    repeated rows are packed one by one. Rows with a null key are packed as well. Columns of ``docs``
    other than ``key`` and ``text`` are not read. No row gives no row.

    Returns a row per piece: ``doc`` (the key), ``start``, ``ids`` (little-endian unsigned 32 bit),
    ``doc_tokens``, ``sequence_id``, ``offset`` (place in the sequence, without gaps).
    """
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("doc", kind), T.StructField("start", T.LongType()),
                           T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()),
                           T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    held = T.StructType([*schema, T.StructField("bin", T.LongType())])

    def arrays(windows: list, first: int, shape: pa.DataType) -> list[pa.Array]:
        kinds = (shape, pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return [pa.array(values, of) for values, of in zip(_rows(windows, first).values(), kinds, strict=True)]

    def pack_partition(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer, number = Packer(size, open_windows), part << 40
        shape = None

        def batch(windows, bin_id):
            nonlocal number
            made = arrays(windows, number, shape)
            number += len(windows)
            return pa.RecordBatch.from_arrays([*made, pa.array([bin_id] * len(made[0]), pa.int64())], names=held.names)

        for got in rows:
            shape = got.column("doc").type
            for doc, words in zip(got.column("doc").to_pylist(), got.column("text").to_pylist(), strict=True):
                ids = np.append(encode(words or "", ranks, added), np.uint32(end_id)).astype("<u4")
                packer.put(doc, 0, ids, len(ids))
                if len(packer.sent) >= SENT:
                    yield batch(packer.sent, None)
                    packer.sent = []
        if shape is not None:
            yield batch(packer.sent, None)
            yield batch(packer.rest(), part // merge)

    def pack_rest(bin_id: tuple, rows: pa.Table) -> pa.Table:
        packer, shape = Packer(size, open_windows), rows.schema.field("doc").type
        rows = rows.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        for doc, start, ids, total in zip(*(rows.column(c).to_pylist() for c in ("doc", "start", "ids", "doc_tokens")), strict=True):
            packer.put(doc, start, np.frombuffer(ids, "<u4"), total)
        packer.close()
        return pa.table(arrays(packer.sent, MERGED | bin_id[0].as_py() << 24, shape), schema.names)

    packed = stored(docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).mapInArrow(pack_partition, held),
                    "packed")
    rest = packed.where("bin is not null").groupBy("bin").applyInArrow(pack_rest, schema)
    return packed.where("bin is null").drop("bin").unionByName(rest)
