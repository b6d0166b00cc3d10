"""Near-duplicate vectors by E8 lattice cells of random projections."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.llm.components import components
from postlake.llm.shared import groups, stored
from postlake.llm.words import U, mix

#: Tables, lattice points that make up a cell, length of a unit vector's projection relative to the lattice, cells
#: that a vector looks into per table (its own and those nearest to it).
TABLES, POINTS, SCALE, PROBES = 10, 2, 4.0, 4
#: Members of a component that are compared with each other in one place.
BLOCK = 512


def decode(y: np.ndarray) -> np.ndarray:
    """The nearest point of E8 to each row of eight, doubled so that it is whole: the even sums of whole numbers,
    or of halves."""

    def even(x):
        near = np.rint(x)
        off = x - near
        odd = np.flatnonzero(near.sum(1) % 2)
        worst = np.abs(off[odd]).argmax(1)
        near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
        return near

    whole, half = even(y), even(y - 0.5) + 0.5
    nearer = ((y - half) ** 2).sum(1) < ((y - whole) ** 2).sum(1)
    return (2 * np.where(nearer[:, None], half, whole)).astype(np.int64)


@lru_cache(maxsize=1)
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled."""
    whole = [v for i, j in combinations(range(8), 2) for a, b in product((-2, 2), repeat=2)
             for v in [[a if k == i else b if k == j else 0 for k in range(8)]]]
    return np.array(whole + [v for v in product((-1, 1), repeat=8) if v.count(-1) % 2 == 0])


@lru_cache(maxsize=8)
def _projections(dims: int) -> np.ndarray:
    """Orthonormal directions for all tables, drawn anew as often as the space is used up."""
    rng, wanted, drawn = np.random.default_rng(8), TABLES * POINTS * 8, []
    while sum(len(d) for d in drawn) < wanted:
        drawn.append(np.linalg.qr(rng.normal(size=(max(dims, 8), max(dims, 8))))[0][:, :dims] if dims >= 8
                     else rng.normal(size=(8, dims)) / np.sqrt(8))
    return np.concatenate(drawn)[:wanted] * np.sqrt(max(dims, 8) / 8) * SCALE / np.sqrt(8)


def cells(x: np.ndarray) -> np.ndarray:
    """For unit vectors, the hashes of the cells they look into: vector, table, probe. The first is their own."""
    y = (x @ _projections(x.shape[1]).T).reshape(len(x) * TABLES * POINTS, 8)
    home = decode(y)
    # The nearest other points of each lattice point, by how much farther they are.
    step = neighbours()
    extra = (step ** 2).sum(1) / 4 - (y - home / 2) @ step.T
    near = np.argpartition(extra, PROBES, axis=1)[:, :PROBES]
    cost = np.take_along_axis(extra, near, 1).reshape(len(x), TABLES, POINTS * PROBES)

    def key(points):
        total = np.zeros(len(points), U)
        for k in range(8):
            total = mix(total * U(31) + points[:, k].astype(np.int64).view(U))
        return total.reshape(len(x), TABLES, -1)

    own = key(home)
    other = key((home[:, None] + step[near]).reshape(-1, 8)).reshape(len(x), TABLES, POINTS * PROBES)
    best = np.argsort(cost, axis=2)[:, :, :PROBES - 1]
    out = np.empty((len(x), TABLES, PROBES), U)
    for probe in range(PROBES):
        parts = own.copy()
        if probe:
            chosen = best[:, :, probe - 1:probe]
            np.put_along_axis(parts, chosen // PROBES, np.take_along_axis(other, chosen, 2), 2)
        total = np.broadcast_to(np.arange(TABLES).astype(U), parts.shape[:2])
        for k in range(POINTS):
            total = mix(total * U(31) + parts[:, :, k])
        out[:, :, probe] = total
    return out


def _classes(rows: DataFrame) -> DataFrame:
    """Usable vectors, equal ones of a label once: ``node``, ``least`` key, ``many``, ``label``, ``unit`` (doubles)."""
    schema = T.StructType([rows.schema["vec"], T.StructField("row", T.LongType()), rows.schema["label"],
                           T.StructField("digest", T.BinaryType()), T.StructField("unit", T.BinaryType())])

    def clean(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        row = TaskContext.get().partitionId() << 40
        for batch in got:
            units, digests = [], []
            for vector in batch.column("vector").to_pylist():
                x = None if vector is None or any(v is None for v in vector) else np.array(vector, np.float64)
                size = 0.0 if x is None or not len(x) or not np.isfinite(x).all() else np.abs(x).max()
                if not size:
                    units.append(None)
                    digests.append(None)
                    continue
                x = x / size  # squares of very large and very small numbers stay finite
                units.append((x / np.linalg.norm(x)).tobytes())
                digests.append(xxhash.xxh3_128_digest((np.array(vector, np.float64) + 0.0).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec"), pa.array(range(row, row + len(units)), pa.int64()), batch.column("label"),
                 pa.array(digests, pa.binary()), pa.array(units, pa.binary())], names=schema.names)
            row += len(units)

    return stored(rows.mapInArrow(clean, schema), "vectors")


def _looked_up(nodes: DataFrame) -> DataFrame:
    """Cells of every node: ``cell`` (of a label), ``node``, ``home`` (its own cell, not one near it)."""

    def look(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in got:
            for start in range(0, len(batch), 500):
                run = batch.slice(start, 500)
                units, node = run.column("unit").to_pylist(), run.column("node").to_numpy()
                seed = run.column("seed").to_numpy().astype(np.int64).view(U)
                for size in sorted({len(u) for u in units}):
                    own = [i for i, u in enumerate(units) if len(u) == size]
                    found = mix(cells(np.frombuffer(b"".join(units[i] for i in own)).reshape(len(own), -1)) ^ seed[own][:, None, None])
                    home = np.zeros(found.shape, bool)
                    home[:, :, 0] = True
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found.reshape(-1).view(np.int64)), pa.array(np.repeat(node[own], TABLES * PROBES)),
                         pa.array(home.reshape(-1))], names=["cell", "node", "home"])

    seeded = nodes.select("node", "unit", F.xxhash64("label", F.octet_length("unit")).alias("seed"))
    return stored(seeded.mapInArrow(look, "cell long, node long, home boolean"), "cells")


def _verified(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Pairs of one label whose cosine is ``least`` or more."""
    a = pairs.join(nodes.select(F.col("node").alias("a"), F.col("unit").alias("x"), F.col("label").alias("x_label")), "a")
    both = a.join(nodes.select(F.col("node").alias("b"), F.col("unit").alias("y"), F.col("label").alias("y_label")), "b")

    @F.arrow_udf("double")
    def cosine(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([float(np.frombuffer(a) @ np.frombuffer(b)) if len(a) == len(b) else 0.0
                         for a, b in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.float64())

    return both.where("x_label = y_label").withColumn("cosine", cosine("x", "y")).where(F.col("cosine") >= least).select("a", "b")


def _counted(nodes: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """For each node of a component, the rows of other nodes that it links with.

    A component's members are dealt into blocks; each pair of blocks is multiplied out in one task, which returns
    a sum per member, never pairs.
    """
    members = labels.join(nodes.select("node", "unit", "many"), "node")
    sizes = labels.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(
        F.least(other, F.col("own")).alias("i"), F.greatest(other, F.col("own")).alias("j")))
    rows = dealt.select("component", "node", "unit", "many", "own", F.inline(meets))

    def multiply(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(product_of, groups(got, ["component", "i", "j"]))

    def product_of(group: pa.Table) -> pa.RecordBatch:
        x = np.frombuffer(b"".join(group["unit"].to_pylist())).reshape(len(group), -1)
        many, own = group["many"].to_numpy(), group["own"].to_numpy()
        inside = group["i"][0].as_py() == group["j"][0].as_py()
        links = np.zeros(len(group), np.int64)
        for start in range(0, len(x), 256):
            close = x[start:start + 256] @ x.T >= least
            close &= (own[start:start + 256, None] != own[None]) | inside
            close[np.arange(len(close)), np.arange(start, start + len(close))] = False
            links[start:start + 256] = close @ many
        return pa.RecordBatch.from_arrays([group["node"].combine_chunks(), pa.array(links)], names=["node", "links"])

    grouped = rows.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "node")
    return grouped.mapInArrow(multiply, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93) -> DataFrame:
    """Links between vectors of one label whose cosine is ``least`` or more, and their components.

    Every vector is indexed: in each of several tables its random projections are decoded to E8 lattice points, which name
    its cell; it looks into its own cell and those that its projections are nearest to. Each vector is compared with
    the first of every cell it looks into; components of these links hold nearly all others, and what
    shares a cell across components is compared as well. Within a component all members are compared, in double
    precision, so a link is missed only if no chain of cells connects its ends: at 0.93 and the tables set here a pair alone is
    missed once in two hundred, at 0.96 once in thousands.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows whose label is null, link
    with nothing; vectors of different lengths do not link. Equal vectors of a label are compared once and link with
    each other; repeated rows count as vectors of their own. Null keys take part; a component is named by its
    smallest key that is not null. Returns ``vec`` (the key), ``n_links``, ``component``.
    """
    rows = vectors.select(F.col(key).alias("vec"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    found = _classes(rows)
    usable = found.where("digest is not null and label is not null")
    classes = stored(usable.groupBy("label", "digest").agg(
        F.min("row").alias("node"), F.min("vec").alias("least"), F.count("*").alias("many")), "vector-classes")
    nodes = stored(found.select(F.col("row").alias("node"), "unit").join(classes.drop("digest"), "node"), "nodes")
    looked = _looked_up(nodes)
    heads = looked.groupBy("cell").agg(F.min(F.when(F.col("home"), F.col("node"))).alias("head"), F.min("node").alias("_a"), F.max("node").alias("_b"))
    # Written down, so that a cell with many vectors can be split where it is joined; so below.
    heads = stored(heads.where("_a <> _b and head is not null").select("cell", "head"), "heads")
    shared = stored(looked.join(heads, "cell"), "shared-cells")
    pairs = shared.where("node <> head").select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()
    links = stored(_verified(pairs, nodes, least), "vector-links")
    labels = components(links)

    placed = shared.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")).select("cell", "node", "home", "component")
    placed = stored(placed, "placed")
    mixed = placed.groupBy("cell").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).where("_a <> _b").select("cell")
    rest = stored(placed.join(stored(mixed, "mixed"), "cell", "left_semi"), "mixed-cells")
    at_home = rest.where("home").select("cell", F.col("node").alias("_node"), F.col("component").alias("_component"))
    # Components meet first, so that members of one never do, however many a cell holds.
    meeting = rest.select("cell", "component").distinct().join(at_home.select("cell", "_component").distinct(), "cell").where("component <> _component")
    crossed = rest.join(stored(meeting, "meeting"), ["cell", "component"]).join(at_home, ["cell", "_component"]).select(
        F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b")).distinct()
    more = stored(_verified(crossed, nodes, least), "late-vector-links")
    if not more.isEmpty():
        labels = components(links.unionAll(more))

    counted = _counted(nodes, labels, least)
    named = classes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("least").alias("name"))
    full = named.join(names, "component").join(counted, "node", "left").select(
        "label", "digest", "name", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"))
    return found.select("vec", "label", "digest").join(full, ["label", "digest"], "left").select(
        "vec", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("name", "vec").alias("component"))
