"""Benchmark decontamination by winnowed fingerprints whose hits are extended word by word."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.llm.shared import batches, stored
from postlake.llm.words import BASE, U, Words, grams, mix, window_minima, words

#: Bytes in a MB of a block.
BLOCK = 1 << 20
#: Pairs of equal fingerprints that are extended at once.
PAIRS = 1 << 20


class Index:
    """Fingerprints of benchmark items: k-grams that are the least of some window of neighbouring k-grams.

    Two texts that share ``window`` words in a row share a fingerprint within them, as both choose the same
    one there. Items of fewer words have no such window and are kept as one hash of all their words.
    """

    def __init__(self, ids: list[str], texts: list[bytes], window: int, gram: int):
        self.window, self.gram, self.ids = window, gram, ids
        w = words(texts)
        self.words, self.owner, sizes = w.hashes, w.owner, np.diff(w.first)
        keys, valid = grams(w, gram)
        at = np.flatnonzero(window_minima(keys, valid, window - gram + 1))
        # Places of an item with the same words around them, as far as a match is extended, match the same: one serves for all.
        around = np.zeros(len(at), U)
        for step in range(gram - window, window):
            near = np.clip(at + step, 0, max(len(w.hashes) - 1, 0))
            inside = (at + step == near) & (w.owner[near] == w.owner[at])
            around = mix(around * U(BASE) + np.where(inside, w.hashes[near] | U(1), U(0)))
        at = at[np.unique(np.stack([w.owner[at].astype(U), around], 1), axis=0, return_index=True)[1]]
        order = np.argsort(keys[at], kind="stable")
        self.at, self.keys = at[order], keys[at][order]
        self.short = {}
        for n in np.unique(sizes[(sizes > 0) & (sizes < window)]).tolist():
            items = np.flatnonzero(sizes == n)
            whole = grams(w, n)[0][w.first[items]]
            order = np.argsort(whole, kind="stable")
            self.short[n] = items[order], whole[order]

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, end word and item of each stretch of ``w`` that holds only words of windows found."""
        keys, valid = grams(w, self.gram)
        here = np.flatnonzero(window_minima(keys, valid, self.window - self.gram + 1))
        found = [(np.zeros(0, np.int64),) * 3]
        for part in _runs(keys[here], self.keys):
            own = here[part]
            row, there = _equal(keys[own], self.keys)
            own, there = own[row], self.at[there]
            left, right = (self._reach(w, own, there, step, most)
                           for step, most in ((-1, self.window - self.gram), (1, self.window)))
            long = left + right >= self.window
            spans = np.stack([(own - left)[long], (own + right)[long], self.owner[there[long]]])
            found.append(tuple(np.unique(spans, axis=1)))
        for n, (items, whole) in self.short.items():
            keys, valid = grams(w, n)
            at = np.flatnonzero(valid)
            row, which = _equal(keys[at], whole)
            found.append((at[row], at[row] + n, items[which]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _reach(self, w: Words, here, there, step: int, most: int) -> np.ndarray:
        """How many words agree before (-1) or from (1) the places on, ``most`` at most: the next fingerprint
        of a longer match carries on from there."""
        reach, live = np.zeros(len(here), np.int64), np.arange(len(here))
        for n in range(most):
            a, b = (here[live] + n, there[live] + n) if step > 0 else (here[live] - 1 - n, there[live] - 1 - n)
            inside = (a >= 0) & (b >= 0) & (a < len(w.hashes)) & (b < len(self.words))
            live, a, b = live[inside], a[inside], b[inside]
            same = ((w.hashes[a] == self.words[b]) & (w.owner[a] == w.owner[here[live]])
                    & (self.owner[b] == self.owner[there[live]]))
            live = live[same]
            reach[live] += 1
        return reach


def _runs(left: np.ndarray, right: np.ndarray) -> Iterator[slice]:
    """Stretches of ``left`` that have about PAIRS places of ``right`` with equal values at most; ``right`` is sorted."""
    ends = np.cumsum(np.searchsorted(right, left, "right") - np.searchsorted(right, left, "left"))
    start = 0
    while start < len(left):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
        yield slice(start, stop)
        start = stop


def _equal(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places with equal values; ``right`` is sorted."""
    start, end = np.searchsorted(right, left, "left"), np.searchsorted(right, left, "right")
    n = end - start
    row = np.repeat(np.arange(len(left)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + start[row]


def _merged(spans: np.ndarray) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in spans[np.lexsort(spans.T[::-1])].tolist():
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _blocks(items: DataFrame, key: str, text: str, window: int, gram: int, block_mb: int) -> list:
    """The items' indexes, each of about ``block_mb`` MB of text at most, sent to all tasks."""
    spark = items.sparkSession
    size = items.select(F.sum(F.octet_length(text))).first()[0] or 0
    n = -(-size // (block_mb * BLOCK)) or 1
    named = items.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = []
    for block in range(n):
        rows = named.where(F.pmod(F.xxhash64("item"), F.lit(n)) == block).collect()
        found.append(spark.sparkContext.broadcast(Index([r.item for r in rows], [r.text.encode() for r in rows], window, gram)))
    return found


def without_items(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = 10,
                  gram: int = 5, block_mb: int = 16) -> DataFrame:
    """The rows of ``docs`` of which no word lies in ``window`` words in a row of an item; all columns stay.

    Words, short items, nulls and repeated rows count as in ``find_items``. Documents are not shuffled; with several
    blocks, what one leaves is written down before the next.
    """
    for n, index in enumerate(_blocks(items, item_key, item_text, window, gram, block_mb)):
        docs = (stored(docs, "decontaminated") if n else docs).where(~_hit(index)(F.col(text).cast("binary")))
    return docs


def _hit(index):
    @F.arrow_udf("boolean")
    def hit(texts: pa.Array) -> pa.Array:
        found = []
        for _, run in batches(pa.RecordBatch.from_arrays([texts], names=["text"]), "text"):
            w = words(run)
            found.append(np.bincount(w.owner[index.value.hits(w)[0]], minlength=len(run)) > 0)
        return pa.array(np.concatenate(found) if found else np.zeros(0, bool))

    return hit


def find_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
               item_text: str = "text", window: int = 10, gram: int = 5, block_mb: int = 16) -> DataFrame:
    """Which words of each document lie in ``window`` words in a row of a benchmark item.

    Words are runs of letters, digits and non-ASCII characters; A-Z count as a-z. An item of fewer words is
    looked for as a whole. The benchmark is the query set: it goes to all tasks in blocks of about
    ``block_mb`` MB of text, each block against all documents; the documents are not shuffled while one
    block holds all items. Null and empty texts have no words; an item without a key is named ``null``, rows
    that repeat an item's key are its further texts. Repeated documents give repeated rows. Columns but
    those named are not read.

    Returns ``doc`` (the key), ``n_words``, ``spans`` (word ranges that are hit, apart from each other),
    ``items`` (keys of the items found, as sorted strings).
    """
    blocks = _blocks(items, item_key, item_text, window, gram, block_mb)
    wanted = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    span = T.ArrayType(T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())]))
    schema = T.StructType([wanted.schema["doc"], T.StructField("digest", T.BinaryType()),
                           T.StructField("n_words", T.LongType()), T.StructField("spans", span),
                           T.StructField("items", T.ArrayType(T.StringType()))])
    many = len(blocks) > 1
    shape = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))

    def against(index) -> DataFrame:
        def scan(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import xxhash

            for rows in got:
                for start, texts in batches(rows, "text"):
                    w = words(texts)
                    a, b, item = index.value.hits(w)
                    spans: list[list] = [[] for _ in texts]
                    names: list[list] = [[] for _ in texts]
                    if len(a):
                        owner = w.owner[a]
                        for doc in np.unique(owner).tolist():
                            own = owner == doc
                            near = np.unique(np.stack([a[own], b[own]], 1) - w.first[doc], axis=0)
                            spans[doc] = [{"from": x, "to": y} for x, y in _merged(near)]
                            names[doc] = sorted({index.value.ids[i] for i in np.unique(item[own])})
                    digests = [xxhash.xxh128_digest(t) if many else b"" for t in texts]
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("doc").slice(start, len(texts)), pa.array(digests, pa.binary()),
                         pa.array(np.diff(w.first), pa.int64()), pa.array(spans, shape),
                         pa.array(names, pa.list_(pa.string()))], names=schema.names)

        return wanted.mapInArrow(scan, schema)

    found = reduce(DataFrame.unionAll, map(against, blocks))
    if not many:
        return found.drop("digest")
    # Rows of one document meet again by key and digest; as many as went in come out.
    met = found.groupBy("doc", "digest").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        (F.count("*") / len(blocks)).cast("int").alias("n"))
    joined = F.aggregate("spans", F.expr("cast(array() as array<struct<from: bigint, to: bigint>>)"), lambda done, s: (
        F.when((F.size(done) > 0) & (s["from"] <= F.element_at(done, -1)["to"]), F.concat(
            F.slice(done, F.lit(1), F.size(done) - 1),
            F.array(F.named_struct(F.lit("from"), F.element_at(done, -1)["from"],
                                   F.lit("to"), F.greatest(F.element_at(done, -1)["to"], s["to"])))))
        .otherwise(F.concat(done, F.array(s)))))
    return met.select("doc", "n_words", joined.alias("spans"), "items",
                      F.explode(F.array_repeat(F.lit(0), F.col("n"))).alias("_")).drop("_")
