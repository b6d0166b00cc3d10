"""Hard negatives of anchors by exact integer products, several candidates in one multiplication."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.llm.shared import parts, stored

#: Bits up to which a double holds every whole number: the wide integer that BLAS multiplies.
EXACT = 53
#: Candidates in one Python integer, where components are too large for doubles.
FIELDS = 16
#: Bytes of candidates that meet anchors in one place, least rows there, and rows of either side multiplied at once.
BLOCK_BYTES, BLOCK_ROWS, TILE, CHUNK = 96 << 20, 1024, 8192, 128
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
#: Components from which 256 times a double is no double any more; larger ones count as these.
_HUGE = 2.0 ** 1000


def products(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers (as doubles), each with each; beyond a long its nearest end, the
    least long excepted.

    Components are biased so that none is negative. Several candidates' components then lie in separate fields of one
    integer, wide enough for the whole sum, so one multiplication for each component of an anchor serves all of them
    and no field carries over into the next.
    """
    dims, n = anchors.shape[1], len(candidates)
    if not dims or not n or not len(anchors):
        return np.zeros((len(anchors), n), np.int64)
    low_a, low_c = min(0, int(anchors.min())), min(0, int(candidates.min()))
    bits = max(1, (dims * (int(anchors.max()) - low_a) * (int(candidates.max()) - low_c)).bit_length())
    # Doubles serve if a field fits and so do the biased numbers that are added up afterwards.
    if bits > EXACT or max(-low_a, -low_c).bit_length() + bits > 60:
        return _wide_products(anchors, candidates, low_a, low_c, bits)
    a, c = anchors - low_a, candidates - low_c
    fields = EXACT // bits
    packed = np.zeros((-(-n // fields), dims))
    for k in range(fields):
        part = c[k::fields]
        packed[:len(part)] += part * 2.0 ** (bits * k)
    total = (a @ packed.T).astype(np.int64)
    out = np.empty((*total.shape, fields), np.int64)
    for k in range(fields):
        out[:, :, k] = (total >> (bits * k)) & ((1 << bits) - 1)
    bias = low_c * a.sum(1).astype(np.int64)[:, None] + low_a * c.sum(1).astype(np.int64) + dims * low_a * low_c
    return out.reshape(len(a), -1)[:, :n] + bias


def _wide_products(anchors, candidates, low_a: int, low_c: int, bits: int) -> np.ndarray:
    """The same with integers of any width."""
    a = [[int(x) - low_a for x in row] for row in anchors]
    c = [[int(x) - low_c for x in row] for row in candidates]
    sums, mask, dims = [sum(row) for row in c], (1 << bits) - 1, len(a[0])
    out = np.empty((len(a), len(c)), np.int64)
    for start in range(0, len(c), FIELDS):
        part = c[start:start + FIELDS]
        packed = [sum(row[d] << (bits * k) for k, row in enumerate(part)) for d in range(dims)]
        for i, row in enumerate(a):
            total = sum(x * y for x, y in zip(row, packed, strict=True))
            bias = low_c * sum(row) + dims * low_a * low_c
            for k in range(len(part)):
                score = ((total >> (bits * k)) & mask) + bias + low_a * sums[start + k]
                out[i, start + k] = min(max(score, _LEAST + 1), _MOST)
    return out


def _numbers(rows: DataFrame) -> DataFrame:
    """Usable rows with their own number ``row`` and ``ints``, floor(256 * x) as short or, if ``wide``, as double."""
    schema = T.StructType([rows.schema["vec"], rows.schema["label"], rows.schema["anchor"], T.StructField("row", T.LongType()),
                           T.StructField("dims", T.IntegerType()), T.StructField("wide", T.BooleanType()), T.StructField("ints", T.BinaryType())])

    def convert(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in got:
            vectors = batch.column("vector")
            ends = np.cumsum(pc.fill_null(pc.list_value_length(vectors), 0).to_numpy())
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            usable = vectors.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[starts]) & batch.column("label").is_valid().to_numpy(zero_copy_only=False)
            whole = np.floor(256 * np.clip(np.nan_to_num(x), -_HUGE, _HUGE))
            large = np.concatenate([[0], np.cumsum(np.abs(whole) >= 1 << 15)])
            wide, short = large[ends] != large[starts], np.clip(whole, -(1 << 15), (1 << 15) - 1).astype(np.int16)
            chosen = np.flatnonzero(usable)
            ints = [(whole if wide[i] else short)[starts[i]:ends[i]].tobytes() for i in chosen]
            take = pa.array(chosen)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(take) for c in ("vec", "label", "anchor")] + [
                    pa.array(row + chosen), pa.array((ends - starts)[chosen].astype(np.int32)), pa.array(wide[chosen]), pa.array(ints, pa.binary())],
                names=schema.names)
            row += len(batch)

    return stored(rows.mapInArrow(convert, schema), "numbers")


class _Rows:
    """Rows that came sorted by length, width and label: stretches of equal length and width, and their labels."""

    def __init__(self, table: pa.Table):
        self.table = table.combine_chunks()
        self.row = self.table["row"].to_numpy()
        kind = np.stack([self.table["dims"].to_numpy(), self.table["wide"].to_numpy().astype(np.int32)], 1)
        edges = np.flatnonzero((kind[1:] != kind[:-1]).any(1)) + 1
        cuts = [0, *edges.tolist(), len(kind)]
        self.stretches = [(int(kind[a, 0]), bool(kind[a, 1]), a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
        self.matrices = [np.frombuffer(b"".join(self.table["ints"].slice(a, b - a).to_pylist()), np.float64 if wide else np.int16).reshape(b - a, dims)
                         for dims, wide, a, b in self.stretches]
        coded = self.table["label"].combine_chunks().dictionary_encode()
        self.codes, self.labels = coded.indices.to_numpy(), coded.dictionary.to_pylist()

    def place(self) -> np.ndarray:
        """The number of each row in the order of keys, null last, and then of rows."""
        order = pc.sort_indices(self.table, [("vec", "ascending"), ("row", "ascending")]).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return place


def _first(group, score, place, k: int) -> np.ndarray:
    """Positions of the first ``k`` of each group: higher scores first, ties by place."""
    order = np.lexsort((place, -score, group))
    g = group[order]
    start = np.searchsorted(g, g, "left")
    return order[np.arange(len(g)) - start < k]


def _scored(anchors: _Rows, candidates: _Rows, same_label: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Scores of anchors (their places) with a run of candidates (theirs), of the same label or of others."""
    codes = {label: k for k, label in enumerate(candidates.labels)}
    own_code = np.array([codes.get(label, -1) for label in anchors.labels], np.int64)[anchors.codes]
    for (dims, _, first, end), x in zip(anchors.stretches, anchors.matrices, strict=True):
        for (other_dims, _, start, stop), y in zip(candidates.stretches, candidates.matrices, strict=True):
            if dims != other_dims:
                continue
            code = own_code[first:end]
            cuts = [(np.arange(end - first), start, stop)]
            if same_label:  # candidates of a label are neighbours
                known = candidates.codes[start:stop]
                changes = np.flatnonzero(np.diff(known)) + 1
                cuts = [(np.flatnonzero(code == known[a]), start + a, start + b)
                        for a, b in zip([0, *changes.tolist()], [*changes.tolist(), stop - start], strict=True)]
            for own, low, high in cuts:
                for a in range(0, len(own), CHUNK):
                    chosen = own[a:a + CHUNK]
                    for b in range(low, high, TILE):
                        run = np.arange(b, min(b + TILE, high))
                        s = products(x[chosen].astype(np.float64), y[run - start].astype(np.float64))
                        if not same_label:
                            s[code[chosen][:, None] == candidates.codes[run]] = _LEAST
                        yield first + chosen, run, s


def _meet(dealt: DataFrame, schema: T.StructType, use) -> DataFrame:
    """``use(anchors, candidates)`` for every block of candidates and the anchors sent there, a few at a time."""

    def stream(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, ready = None, [], None
        for batch in got:
            keys = np.stack([batch.column("block").to_numpy(), batch.column("kind").to_numpy()], 1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for start, end in zip(edges, edges[1:], strict=False):
                if start == end:
                    continue
                if keys[start, 0] != block:
                    block, held, ready = keys[start, 0], [], None
                run = pa.Table.from_batches([batch.slice(start, end - start)])
                if keys[start, 1] == 0:
                    held.append(run)
                elif held:
                    ready = ready or _Rows(pa.concat_tables(held))
                    yield from use(_Rows(run), ready)

    ordered = dealt.sortWithinPartitions("block", "kind", "dims", "wide", "label", "row")
    return ordered.mapInArrow(stream, schema)


def mine(vectors: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label",
         positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """For every row where ``anchor`` holds and each of its positives, the hardest rows of other labels.

    A component x counts as floor(256 * x); a score is the inner product of two rows in whole numbers, exact, and
    beyond a long its nearest end. Higher scores come first, ties by smaller key, null last. An anchor's positives are its first
    ``positives`` other rows of its label; the negatives of a pair are the first ``negatives`` rows of other labels whose score
    is between ``least`` and ``most`` hundredths of the positive's. What has fewer gives all. Returns ``anchor``, ``positive``,
    ``rank`` (from 1), ``negative``, ``positive_score``, ``negative_score``; a pair without negatives gives no row.

    Every anchor is compared with every row, in blocks: candidates are dealt once into blocks of bounded size, the anchors are
    sent to each, and a block returns its few best for each anchor. Blocks do not depend on labels or keys, so no label is a
    hot one.

    Rows with a null label or vector, or with a null or non-finite component, take no part. Rows of different lengths are
    not compared. Repeated rows are rows of their own: one may be the other's positive, and each anchor gives its
    own result. A row with a null key is a candidate as any other. An empty table gives an empty one.
    """
    rows = vectors.select(F.col(f"`{key}`").alias("vec"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("vector"),
                          F.coalesce(anchor, F.lit(False)).alias("anchor"))
    found = _numbers(rows)
    sizes = found.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("ints").cast("long")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, min(parts(found), -(-sizes["n"] // BLOCK_ROWS)), -(-sizes["bytes"] // BLOCK_BYTES))
    vec_type = found.schema["vec"].dataType
    candidates = found.select("*", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind")).drop("anchor")
    sent = found.where("anchor").drop("anchor").select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"))

    def nearest(own: _Rows, block: _Rows) -> Iterator[pa.RecordBatch]:
        place, best = block.place(), [np.zeros(0, np.int64)] * 3
        for at, run, s in _scored(own, block, True):
            s[own.row[at][:, None] == block.row[run]] = _LEAST
            bound = np.partition(s, s.shape[1] - positives, axis=1)[:, -positives] if s.shape[1] > positives else np.full(len(s), _LEAST)
            i, j = np.nonzero((s >= bound[:, None]) & (s != _LEAST))
            best = [np.concatenate(x) for x in zip(best, (at[i], run[j], s[i, j]), strict=True)]
            keep = _first(best[0], best[2], place[best[1]], positives)
            best = [x[keep] for x in best]
        yield _found(own.row[best[0]], None, best[1], best[2], block)

    def hardest(own: _Rows, block: _Rows) -> Iterator[pa.RecordBatch]:
        place, best = block.place(), [np.zeros(0, np.int64)] * 4
        pairs = [(i, p["place"], -(-least * p["score"] // 100), most * p["score"] // 100)
                 for i, known in enumerate(own.table["known"].to_pylist()) for p in known]
        pairs = [(i, n, max(low, _LEAST + 1), min(high, _MOST)) for i, n, low, high in pairs if low <= high]
        if not pairs:
            return
        of, number, low, high = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        floor, ceiling = np.full(len(own.row), _MOST), np.full(len(own.row), _LEAST)
        np.minimum.at(floor, of, low)
        np.maximum.at(ceiling, of, high)
        for at, run, s in _scored(own, block, False):
            i, j = np.nonzero((s >= floor[at][:, None]) & (s <= ceiling[at][:, None]) & (s != _LEAST))
            score, who, where = s[i, j], at[i], run[j]
            for n in np.unique(number):
                pair = np.full(len(own.row), -1)
                pair[of[number == n]] = np.flatnonzero(number == n)
                mine_, fits = pair[who], pair[who] >= 0
                fits[fits] &= (score[fits] >= low[mine_[fits]]) & (score[fits] <= high[mine_[fits]])
                best = [np.concatenate(x) for x in zip(best, (mine_[fits], where[fits], score[fits], who[fits]), strict=True)]
            keep = _first(best[0], best[2], place[best[1]], negatives)
            best = [x[keep] for x in best]
        yield _found(own.row[best[3]], number[best[0]], best[1], best[2], block)

    def _found(row, number, at, score, block: _Rows) -> pa.RecordBatch:
        columns = [pa.array(row), pa.array(score), block.table["vec"].combine_chunks().take(pa.array(at)), pa.array(block.row[at])]
        names = ["anchor_row", "score", "vec", "row"]
        if number is not None:
            columns, names = [*columns, pa.array(number.astype(np.int32))], [*names, "place"]
        return pa.RecordBatch.from_arrays(columns, names=names)

    plain = [T.StructField("anchor_row", T.LongType()), T.StructField("score", T.LongType()), T.StructField("vec", vec_type), T.StructField("row", T.LongType())]
    order = [F.col("score").desc(), F.col("vec").asc_nulls_last(), F.col("row")]
    dealt = candidates.unionByName(sent).repartition(blocks, "block")
    near = _meet(dealt, T.StructType(plain), nearest)
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("anchor_row").orderBy(*order))).where(F.col("place") <= positives)
    near = stored(near.select("anchor_row", "place", F.col("vec").alias("positive"), F.col("score").alias("positive_score")), "positives")

    known = near.groupBy(F.col("anchor_row").alias("row")).agg(F.collect_list(F.struct("place", F.col("positive_score").alias("score"))).alias("known"))
    asking = sent.join(known, "row")
    dealt = candidates.withColumn("known", F.lit(None).cast(asking.schema["known"].dataType)).unionByName(asking).repartition(blocks, "block")
    hard = _meet(dealt, T.StructType([*plain, T.StructField("place", T.IntegerType())]), hardest)
    window = Window.partitionBy("anchor_row", "place").orderBy(*order)
    hard = hard.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= negatives)
    names = found.where("anchor").select(F.col("row").alias("anchor_row"), F.col("vec").alias("anchor"))
    return hard.join(near, ["anchor_row", "place"]).join(names, "anchor_row").select(
        "anchor", "positive", "rank", F.col("vec").alias("negative"), "positive_score", F.col("score").alias("negative_score"))
