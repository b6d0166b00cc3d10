"""Passages that repeat across documents, by a sparse suffix array: suffixes kept at minimisers, sorted, neighbours compared."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.llm.shared import batches, discard, parts, stored
from postlake.llm.words import Words, grams, long_grams, window_least, window_minima, words
from postlake.operators.steps import once

#: Words by which suffixes are sorted first; one is kept where they are the least of all within a window.
GRAM = 10


def _suffixes(texts: DataFrame, least_words: int) -> DataFrame:
    """Kept suffixes: ``key`` (their first words), ``digest`` (their text), ``at`` (their first word's number)."""
    width = least_words - GRAM + 1

    def cut(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in got:
            for start, run in batches(rows, "text"):
                w = words(run)
                keys, valid = grams(w, GRAM)
                at = np.flatnonzero(window_minima(keys, valid, width))
                owner = w.owner[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[at].view(np.int64)), rows.column("digest").slice(start, len(run)).take(pa.array(owner)),
                     pa.array((at - w.first[owner]).astype(np.int32))], names=["key", "digest", "at"])

    return texts.select("text", "digest").mapInArrow(cut, "key long, digest binary, at int")


def _beside(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Rows, each once, that have a neighbour with the same ``key`` when all are sorted by it and then by the other columns: ``after``
    says whether that is the one before.

    Rows are sorted into ranges, which split a key that many rows share. A task sees its range in order and holds one row; the first
    and last rows of ranges, two a range, are compared with each other afterwards.
    """
    rest = [c for c in rows.columns if c != key]
    schema = T.StructType([*rows.schema.fields, T.StructField("after", T.BooleanType()), T.StructField("before", T.BooleanType()),
                           T.StructField("range", T.IntegerType()), T.StructField("end", T.IntegerType())])

    def compare(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        held, after, first = None, False, True  # the last row that differs from those before it

        def out(table: pa.Table, after: np.ndarray, before: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
            keep = after | before | (end >= 0)
            if keep.any():
                kept = table.filter(pa.array(keep))
                for name_, values in (("after", pa.array(after[keep])), ("before", pa.array(before[keep])), ("range", pa.array(np.full(keep.sum(), number, np.int32))),
                                      ("end", pa.array(end[keep].astype(np.int32)))):
                    kept = kept.append_column(name_, values)
                yield from kept.combine_chunks().to_batches()

        for batch in got:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            table = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
            same = _as_before(table, [key])
            new = ~(same & _as_before(table, rest))
            table, same = table.filter(pa.array(new)), same[new]
            # The last row waits for the one after it.
            flags = np.concatenate([[after], same[1:]])
            end = np.full(len(table), -1)
            if len(table) > 1:
                end[0] = 0 if first else -1
                yield from out(table.slice(0, len(table) - 1), flags[:-1], same[1:], end[:-1])
                first = False
            held, after = table.slice(len(table) - 1), bool(flags[-1])
        if held is not None:  # 2: the only row of a range is its first and last
            yield from out(held, np.array([after]), np.array([False]), np.array([2 if first else 1]))

    dealt = rows.repartitionByRange(parts(rows), key, *rest).sortWithinPartitions(key, *rest)
    found = stored(dealt.mapInArrow(compare, schema), name)
    order = Window.orderBy("range", "end")
    ends = found.where("end >= 0")
    other = {n: F.struct(*[step(c).over(order).alias(c) for c in (key, *rest)]) for n, step in (("last", F.lag), ("next", F.lead))}
    ends = ends.withColumns(other)
    own = F.struct(*rest)

    def meets(n):
        return F.coalesce((F.col(f"{n}.{key}") == F.col(key)) & ~F.struct(*[F.col(f"{n}.{c}").alias(c) for c in rest]).eqNullSafe(own), F.lit(False))

    ends = ends.withColumns({"after": F.col("after") | F.col("end").isin(0, 2) & meets("last"), "before": F.col("before") | F.col("end").isin(1, 2) & meets("next")})
    return found.where("end < 0").unionByName(ends.drop("last", "next")).where("after or before").select(key, *rest, "after")


def _as_before(table: pa.Table, columns: list[str]) -> np.ndarray:
    """Which rows equal the one before them in these columns."""
    same = np.ones(len(table), bool)
    same[0] = False
    for name in columns:
        column = table[name].combine_chunks()
        if pa.types.is_integer(column.type) and not column.null_count:
            values = column.to_numpy()
            same[1:] &= values[1:] == values[:-1]
        else:
            values = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
            same[1:] &= values[1:] == values[:-1]
    return same


def _extended(w: Words, doc: int, suffixes: np.ndarray, least_words: int, keys, least, whole, runs) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``least_words`` words around suffixes of a text, as hashes by their first words: each
    goes as far left as the suffix is still the one kept for the stretch, and right to its end."""
    at = suffixes + w.first[doc]
    starts = []
    for left in range(least_words - GRAM + 1):
        near = at - left
        inside = (near >= w.first[doc]) & (near < len(least))
        near, kept = near[inside], keys[at[inside]]
        starts.append(near[whole[near] & (least[near] == kept)])
    starts = np.unique(np.concatenate(starts))
    return runs[starts], starts - w.first[doc]


def _stretches(rows: DataFrame, least_words: int) -> DataFrame:
    """``run`` (the words of a stretch), ``number`` (its text), ``start``."""

    def extend(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in got:
            for first, run in batches(rows, "text"):
                part = rows.slice(first, len(run))
                w = words(run)
                keys, valid = grams(w, GRAM)
                least, whole = window_least(keys, valid, least_words - GRAM + 1)
                runs = long_grams(w, least_words)
                suffixes, found = part.column("suffixes"), []
                for doc in range(len(run)):
                    found.append(_extended(w, doc, suffixes[doc].values.to_numpy(), least_words, keys, least, whole, runs))
                take = pa.array(np.repeat(np.arange(len(run)), [len(s) for _, s in found]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([r for r, _ in found]).view(np.int64)), part.column("number").take(take),
                     pa.array(np.concatenate([s for _, s in found]).astype(np.int32))], names=["run", "number", "start"])

    return rows.select("text", "suffixes", "number").mapInArrow(extend, "run long, number long, start int")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = 50) -> DataFrame:
    """``docs`` with ``_text``, ``_words`` and ``_cut``: each text without the passages that stand elsewhere already.

    Words are runs of letters, digits and non-ASCII characters; A-Z count as a-z. Of every ``least_words`` words
    in a row that occur more than once, in one document or in several, the first occurrence stays, by key and then
    place in the text; the words of all others go, with what stands between them. A text that equals
    that of a smaller key goes as a whole if it has so many words.

    Suffixes are kept where their first ten words are the least within a window, so that two equal
    passages keep the same ones. Sorted by these words, neighbours with equal ones in different texts or places are the candidates.
    These are extended left and right to all stretches of ``least_words`` words of which they are the kept suffix, and the stretches
    are sorted in turn: what equals its neighbour before it, an earlier place, goes. Words are sorted by their hashes, as any fixed order brings
    equal ones together. Each time one exchange deals narrow rows into ranges that split what a third of all documents share. Equal
    texts count once in all of this.

    Null and empty texts are kept as they are, with no words. Rows that repeat key and text are one
    document. Null keys come first. All columns stay; the three named are replaced.
    """
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("_text", "_words", "_cut")]
    based = docs.select(F.struct(*own).alias("row"), F.col(key).alias("doc"), F.col(text).alias("text"), F.unhex(F.md5(text)).alias("digest"))
    # 128 bits name a document: its key and its text.
    based = based.withColumn("id", F.unhex(F.md5(F.concat_ws(":", F.col("doc").isNull().cast("string"), F.col("doc").cast("string"), F.hex("digest")))))

    # Equal texts: the row with the smallest key stands for them.
    full = based.where("text is not null").select("digest", "doc", "id")
    copies = _beside(full, "digest", "texts").where("after").select("id")
    suffixes = stored(_suffixes(based, least_words), "suffixes")
    wanted = _beside(suffixes, "key", "shared-suffixes").groupBy("digest").agg(F.collect_set("at").alias("suffixes"))
    heads = full.groupBy("digest").agg(F.min(F.struct("doc", "id")).alias("first")).select("digest", "first.doc", "first.id")
    marked = wanted.join(heads, "digest").select("doc", "id", "suffixes")
    # Numbers of texts in the order of their keys.
    marked = stored(marked.repartitionByRange(parts(docs), "doc", "id").sortWithinPartitions("doc", "id").select(
        F.monotonically_increasing_id().alias("number"), "id", "suffixes"), "marked")
    discard(suffixes)

    stretches = stored(_stretches(based.select("id", "text").join(marked, "id"), least_words), "stretches")
    later = _beside(stretches, "run", "repeats").where("after")
    cuts = later.groupBy("number").agg(F.collect_set("start").alias("starts")).join(marked.select("number", "id"), "number").select("id", "starts")
    decisions = stored(cuts.unionByName(copies.select("id", F.array(F.lit(-1)).alias("starts")))
                       .groupBy("id").agg(F.flatten(F.collect_list("starts")).alias("starts")), "cuts")
    discard(stretches)
    discard(marked)

    @F.arrow_udf("struct<_text: string, _words: long, _cut: long>")
    def without(texts: pa.Array, starts: pa.Array) -> pa.Array:
        kept, total, gone = [], [], []
        for first, run in batches(pa.RecordBatch.from_arrays([texts], names=["text"]), "text"):
            w = words(run)
            total += np.diff(w.first).tolist()
            for doc, text in enumerate(run):
                n, at = int(w.first[doc + 1] - w.first[doc]), starts[first + doc]
                cover = np.zeros(n + 1, np.int64)
                if at.is_valid:
                    places = at.values.to_numpy()
                    if (places < 0).any() and n >= least_words:
                        kept.append("")
                        gone.append(n)
                        continue
                    places = places[places >= 0]
                    np.add.at(cover, places, 1)
                    np.add.at(cover, places + least_words, -1)
                hit = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
                gone.append(int(hit.sum()))
                if not gone[-1]:
                    kept.append(text.decode())
                    continue
                edges = np.flatnonzero(hit[1:] != hit[:-1]) + w.first[doc]
                a, b = w.starts[edges[0::2]] - w.at[doc], w.ends[edges[1::2] - 1] - w.at[doc]
                keep = zip([0, *b.tolist()], [*a.tolist(), len(text)], strict=True)
                kept.append(b"".join(text[i:j] for i, j in keep).decode())
        return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())],
                                          names=["_text", "_words", "_cut"])

    # Made one time: a condition on the result would otherwise run all texts through Python again, in a second worker beside the first.
    found = based.join(decisions, "id", "left").select("row", F.col("text").cast("binary").alias("text"), "starts")
    done = once(found, {"_done": without("text", "starts")}).select("row.*", F.when(F.col("text").isNotNull(), F.lit(True)).alias("_known"), "_done")
    names = [F.col(f"`{c}`") for c in docs.columns if c not in ("_text", "_words", "_cut")]
    return done.select(*names, F.when(F.col("_known"), F.col("_done._text")).alias("_text"), "_done._words", "_done._cut")
