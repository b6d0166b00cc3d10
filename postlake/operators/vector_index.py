"""A stored index for approximate search by cosine: vectors in cells with compact codes, of which a search reads a few.

An index is a folder: ``centres`` (a vector per cell), ``rows``, partitioned by cell, and the ``schema`` of what is indexed. A row holds its vector,
and its code, one byte per component; the search goes by codes and looks at the vectors only of what is left.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.functions.text import lookup
from postlake.operators.ranking import first_n
from postlake.operators.totals import Totals
from postlake.session import cut_lineage

#: Rows of a cell, and queries that look into it, that meet in one place.
CELL_ROWS, CELL_QUERIES = 50_000, 5_000
#: Candidates by code for each wanted row, whose vectors are then compared.
CANDIDATES = 4
_BLOCK = 256


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def usable(vec: str):
    """Whether a vector has a direction: no null or non-finite component, and one that is not zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def centres(corpus: DataFrame, cells: int, cid="id", vec="vector", sample=50_000, rounds=10) -> np.ndarray:
    """Directions of at most ``cells`` cells: spherical k-means over the ``sample`` rows with the smallest hash of their id."""
    rows = corpus.filter(usable(vec)).select(cid, vec).orderBy(F.xxhash64(cid), cid).limit(sample).toArrow()
    x = _matrix(rows[vec].combine_chunks()) if len(rows) else np.zeros((0, 1))
    found = np.unique(x, axis=0)
    found = found[np.random.default_rng(len(found)).permutation(len(found))[:cells]]
    for _ in range(rounds):
        near = np.concatenate([(x[i:i + 4096] @ found.T).argmax(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)
        sums = np.zeros_like(found)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(size > 0, sums / np.where(size > 0, size, 1), found)
    return found


def build(corpus: DataFrame, root: str, cells: int, cid="id", vec="vector", sample=50_000) -> dict:
    """Write an index of all usable vectors at ``root``: how many ``rows`` it holds, and how many were ``skipped``."""
    spark, found = corpus.sparkSession, centres(corpus, cells, cid, vec, sample)
    corpus.select(F.col(cid).alias("id"), F.col(vec).alias("vector")).limit(0).write.parquet(f"{root}/schema")
    rows = [(i, c.tolist()) for i, c in enumerate(found)]
    spark.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.parquet(f"{root}/centres")
    return add(corpus, root, cid, vec)


def add(corpus: DataFrame, root: str, cid="id", vec="vector") -> dict:
    """Put more rows into the cells of an index; its centres stay."""
    spark = corpus.sparkSession
    found = spark.sparkContext.broadcast(_centres(spark, root))  # as many as there are cells
    vectors = corpus.select(F.col(cid).alias("id"), F.col(vec).alias("vector"))
    schema = T.StructType([*vectors.schema.fields, T.StructField("code", T.BinaryType()), T.StructField("cell", T.IntegerType())])

    def place(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column(1))
            codes = np.rint(x / np.abs(x).max(1, keepdims=True) * 127).astype(np.int8)
            cell = (x @ found.value.T).argmax(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(cell)], names=schema.names)

    totals = Totals({"rows": F.count_if(usable("vector")), "skipped": F.count_if(~usable("vector"))})
    placed = totals.on(vectors).filter(usable("vector")).mapInArrow(place, schema).hint("rebalance", "cell")
    placed.write.mode("append").partitionBy("cell").parquet(f"{root}/rows")
    return totals.get()


def _rows(spark: SparkSession, root: str) -> DataFrame:
    fields = spark.read.parquet(f"{root}/schema").schema.fields
    schema = T.StructType([*fields, T.StructField("code", T.BinaryType()), T.StructField("cell", T.IntegerType())])
    return spark.read.schema(schema).parquet(f"{root}/rows")


def _centres(spark: SparkSession, root: str) -> np.ndarray:
    rows = spark.read.parquet(f"{root}/centres").orderBy("cell").collect()
    return np.array([r["centre"] for r in rows])


def search(spark: SparkSession, root: str, queries: DataFrame, k: int, probes: int, qid="query_id", vec="vector") -> DataFrame:
    """(query_id, id, score, rank) of the ``k`` best rows in the ``probes`` cells nearest to each query.

    Cells that no query looks into are not read. Within a cell codes are compared, and the vectors of the best
    ``CANDIDATES`` times ``k`` of a query; the scores are cosines, rounded to 9 places, ties go to the smaller id. What
    lies in other cells is missed. Queries without a direction find nothing.
    """
    found = _centres(spark, root)
    rows = _rows(spark, root)
    asked = queries.filter(usable(vec)).select(F.col(qid).alias("query_id"), F.col(vec).alias("_q"))
    schema = T.StructType([asked.schema["query_id"], rows.schema["id"], T.StructField("cell", T.IntegerType()), T.StructField("near", T.DoubleType())])
    result = T.StructType([asked.schema["query_id"], rows.schema["id"], T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())])
    if not len(found):
        return spark.createDataFrame([], result)
    known = spark.sparkContext.broadcast(found)

    @F.arrow_udf("array<int>")
    def nearest(v: pa.Array) -> pa.Array:
        cosines = _matrix(v) @ known.value.T
        best = np.argsort(-cosines, axis=1, kind="stable")[:, :probes].astype(np.int32)
        return pa.array(list(best), pa.list_(pa.int32()))

    sent = cut_lineage(asked.select("query_id", "_q", F.explode(nearest("_q")).alias("cell")), "asked")
    wanted = {r["cell"]: r["n"] for r in sent.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a cell
    if not wanted:
        return spark.createDataFrame([], result)
    read = rows.filter(F.col("cell").isin(list(wanted)))
    sizes = {r["cell"]: r["n"] for r in read.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    parts = {c: math.ceil(n / CELL_ROWS) for c, n in sizes.items()}
    blocks = {c: math.ceil(wanted[c] / CELL_QUERIES) for c in sizes}

    def dealt(df, ident, own, other, named):
        copies = F.explode(F.sequence(F.lit(0), lookup(other, F.col("cell")) - 1))
        mine = F.pmod(F.xxhash64(ident), lookup(own, F.col("cell"))).cast("int")
        names = ("part", "block") if named else ("block", "part")
        return df.filter(F.col("cell").isin(list(sizes))).withColumn(names[0], mine).withColumn(names[1], copies)

    stored = dealt(read.select("cell", "id", "code"), "id", parts, blocks, True).withColumn("_q", F.lit(None).cast(asked.schema["_q"].dataType))
    stored = stored.withColumn("query_id", F.lit(None).cast(asked.schema["query_id"].dataType)).withColumn("asks", F.lit(0))
    asking = dealt(sent, "query_id", blocks, parts, False).withColumns({
        "id": F.lit(None).cast(rows.schema["id"].dataType), "code": F.lit(None).cast("binary"), "asks": F.lit(1)})
    key = ["cell", "part", "block"]
    both = stored.unionByName(asking).repartition(*key).sortWithinPartitions(*key, "asks")

    def meet(batches):
        place, held, ready = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in (*key, "asks")], 1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for start, end in zip(edges, edges[1:]):
                if start == end:
                    continue
                if place is None or (keys[start, :3] != place).any():
                    place, held, ready = keys[start, :3], [], None
                run = batch.slice(start, end - start)
                if not keys[start, 3]:
                    held.append(run.select(["id", "code"]))
                    continue
                if ready is None:
                    table = pa.Table.from_batches(held).combine_chunks()
                    codes = np.frombuffer(b"".join(table["code"].to_pylist()), np.int8).reshape(len(table), -1).astype(np.float32)
                    ready = table["id"].combine_chunks(), codes / np.linalg.norm(codes, axis=1, keepdims=True)
                ids, codes = ready
                for at in range(0, len(run), _BLOCK):
                    part = run.slice(at, _BLOCK)
                    s = _matrix(part.column("_q")).astype(np.float32) @ codes.T
                    n = min(CANDIDATES * k, s.shape[1])
                    best = np.argpartition(-s, n - 1, axis=1)[:, :n]
                    take = pa.array(np.repeat(np.arange(len(part)), n))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("query_id").take(take), ids.take(pa.array(best.reshape(-1))), part.column("cell").take(take),
                         pa.array(np.take_along_axis(s, best, 1).reshape(-1).astype(np.float64))], names=schema.names)

    near = first_n(both.mapInArrow(meet, schema), ["query_id"], ["-near", "id"], CANDIDATES * k).select("query_id", "id", "cell")

    @F.arrow_udf("double")
    def cosine(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(np.round((_matrix(a) * _matrix(b)).sum(1), 9))

    looked_at = near.join(read.select("cell", "id", "vector"), ["cell", "id"]).join(asked, "query_id")
    scored = looked_at.select("query_id", "id", cosine("_q", "vector").alias("score"))
    return first_n(scored, ["query_id"], ["-score", "id"], k)
