"""Similarity join on word shingles: filters under many token orders, intersected before sets are compared."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.llm.components import components
from postlake.llm.shared import batches, groups, stored
from postlake.llm.words import SPACED, U, Words, grams, mix, words

#: Groups of token orders, and orders of a group. Two sets are candidates if they share the first token under all
#: orders of some group: for a similarity of 0.75, each order agrees with that probability, so a pair is
#: missed by all groups with probability (1 - 0.75 ** 3) ** 36 = 3e-9.
GROUPS, ORDERS = 36, 3
#: Of all 108 orders, so many must agree as well; a pair of similarity 0.75 has 81 on average, and fewer than 54
#: with probability 1e-9.
AGREE = 54
#: Members of a bucket up to which all its pairs meet at once, and rows that are compared in one place: by their
#: first tokens, and with their whole texts.
SMALL, BLOCK, CROSSED = 64, 1000, 256


@lru_cache(maxsize=1)
def _orders() -> np.ndarray:
    return mix(np.arange(1, GROUPS * ORDERS + 1).astype(U)) | U(1)


def shingle_sets(w: Words, size: int = 5) -> list[np.ndarray]:
    """Sorted hashes of the distinct ``size``-word shingles of each text, of all its words where it has fewer."""
    keys, valid = grams(w, size)
    sets = []
    for doc in range(len(w.first) - 1):
        start, end = w.first[doc], w.first[doc + 1]
        if end - start >= size:
            sets.append(np.unique(keys[start:end - size + 1]))
        elif end > start:
            whole = U(end - start)
            for h in w.hashes[start:end]:
                whole = mix(np.array([whole ^ h]))[0]
            sets.append(np.array([whole], U))
        else:
            sets.append(np.zeros(0, U))
    return sets


def first_tokens(tokens: np.ndarray) -> np.ndarray:
    """The least place that any token takes under each order, which identifies the token."""
    least = np.full(GROUPS * ORDERS, np.iinfo(U).max, U)
    for start in range(0, len(tokens), 2048):
        np.minimum(least, (tokens[start:start + 2048, None] * _orders()).min(0), out=least)
    return least


def signature(tokens: np.ndarray) -> tuple[np.ndarray, bytes]:
    """A key for each group of orders, and a byte for each order, of the first tokens."""
    least = mix(first_tokens(tokens))
    keys = np.arange(GROUPS).astype(U)
    for j in range(ORDERS):
        keys = mix(keys ^ least[j::ORDERS])
    return keys.view(np.int64), (least & U(255)).astype(np.uint8).tobytes()


def _signed(docs: DataFrame) -> DataFrame:
    schema = T.StructType([docs.schema["doc"], docs.schema["text_hash"], T.StructField("row", T.LongType()), T.StructField("n", T.LongType()),
                           T.StructField("digest", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType())),
                           T.StructField("sketch", T.BinaryType())])

    def sign(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for rows in got:
            for start, run in batches(rows, "text"):
                sets = shingle_sets(words(run, SPACED))
                # A set of one element is similar to its equals alone, which its digest finds.
                signed = [signature(s) if len(s) > 1 else (None, None) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc").slice(start, len(run)), rows.column("text_hash").slice(start, len(run)), pa.array(range(row, row + len(run)), pa.int64()),
                     pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                     pa.array([k for k, _ in signed], pa.list_(pa.int64())), pa.array([s for _, s in signed], pa.binary())],
                    names=schema.names)
                row += len(run)

    return docs.mapInArrow(sign, schema)


def _pairs(rows: DataFrame) -> DataFrame:
    """Candidate pairs within the groups ``key``, ``part`` that agree under AGREE orders at least: all of a small
    bucket, and of a large one each row with the best row before it."""
    few = SMALL

    def compare(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in got:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            key, part = held["key"].to_numpy(), held["part"].to_numpy()
            last = len(key) - 1
            while last >= 0 and key[last] == key[-1] and part[last] == part[-1]:
                last -= 1
            if last >= 0:
                yield from found(held.slice(0, last + 1))
                held = held.slice(last + 1)
        if held is not None and len(held):
            yield from found(held)

    def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, part, node = (rows[c].to_numpy() for c in ("key", "part", "node"))
        sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(len(key), -1)
        small = rows["size"].to_numpy() <= few
        best, partner = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        out = []
        live = np.arange(len(key))
        for gap in range(1, len(key)):
            live = live[live + gap < len(key)]
            live = live[(key[live] == key[live + gap]) & (part[live] == part[live + gap])]
            if not len(live):
                break
            a, b = live, live + gap
            same = np.concatenate([(sketch[a[i:i + 4096]] == sketch[b[i:i + 4096]]).sum(1) for i in range(0, len(a), 4096)] or [np.zeros(0, np.int64)])
            near = same >= AGREE
            a, b, same = a[near], b[near], same[near]
            better = same > best[b]
            best[b[better]], partner[b[better]] = same[better], a[better]
            out.append((a[small[a]], b[small[a]]))
        rest = np.flatnonzero((best > 0) & ~small)
        out.append((partner[rest], rest))
        a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        if len(a):
            ends = np.unique(np.sort(np.stack([node[a], node[b]], 1), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

    dealt = rows.repartition("key", "part").sortWithinPartitions("key", "part", "node")
    return dealt.mapInArrow(compare, "a long, b long").where("a <> b").distinct()


def _linked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose whole sets are as similar as asked. Texts meet their nodes by document and digest."""
    ends = nodes.select("node", "doc", "digest")
    a = pairs.join(ends.toDF("a", "a_doc", "a_digest"), "a")
    both = a.join(ends.toDF("b", "b_doc", "b_digest"), "b")
    texts = docs.select(F.xxhash64("doc").alias("hash"), "doc", "text")
    left = both.withColumn("hash", F.xxhash64("a_doc")).join(texts.toDF("hash", "doc", "a_text"), "hash").where(F.col("doc").eqNullSafe(F.col("a_doc"))).drop("doc", "hash")
    full = left.withColumn("hash", F.xxhash64("b_doc")).join(texts.toDF("hash", "doc", "b_text"), "hash").where(F.col("doc").eqNullSafe(F.col("b_doc"))).drop("doc", "hash")

    def verify(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in got:
            keep = []
            for start in range(0, len(rows), 200):
                run = rows.slice(start, 200)
                sides = []
                for side in "ab":
                    texts = [t or b"" for t in run.column(f"{side}_text").cast(pa.binary()).to_pylist()]
                    sets = [s for _, part in batches(pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["t"]), "t")
                            for s in shingle_sets(words(part, SPACED))]
                    sides.append((sets, run.column(f"{side}_digest").to_pylist()))
                (left, left_ids), (right, right_ids) = sides
                for x, y, i, j in zip(left, right, left_ids, right_ids, strict=True):
                    if xxhash.xxh3_128_digest(x.tobytes()) != i or xxhash.xxh3_128_digest(y.tobytes()) != j:
                        keep.append(False)  # another text of a repeated key
                        continue
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([rows.column("a"), rows.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return full.select("a", "b", "a_text", "b_text", "a_digest", "b_digest").mapInArrow(verify, "a long, b long")


def _crossed(unsettled: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links between components among the members of unsettled buckets.

    Members of buckets that overlap form a cluster, which is dealt into blocks; each pair of blocks meets in one
    task with its texts. Of pairs in different components that agree under AGREE orders the intersections come
    from a product of the sets' membership matrices, a run of shingles at a time; only links leave the task.
    """
    clusters = components(unsettled.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")))
    sizes = clusters.groupBy("component").agg(F.ceil(F.count("*") / CROSSED).cast("int").alias("blocks"))
    members = (clusters.join(sizes, "component").withColumnRenamed("component", "cluster")
               .join(unsettled.select("node", "component").distinct(), "node").join(nodes.select("node", "doc", "digest", "sketch"), "node"))
    texts = docs.select(F.xxhash64("doc").alias("hash"), F.col("doc").alias("_doc"), "text")
    full = (members.withColumn("hash", F.xxhash64("doc")).join(texts, "hash").where(F.col("doc").eqNullSafe(F.col("_doc")))
            .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(
        F.least(other, F.col("own")).alias("i"), F.greatest(other, F.col("own")).alias("j")))
    rows = full.select("cluster", "node", "component", "own", "digest", "sketch", "text", F.inline(meets))

    def compare(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(got, ["cluster", "i", "j"]):
            a, b = links(group)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def links(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        node, component, own = (group[c].to_numpy() for c in ("node", "component", "own"))
        sketch = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint8).reshape(len(node), -1)
        inside = group["i"][0].as_py() == group["j"][0].as_py()
        left, right = [], []
        for i in range(len(node) - 1):
            near = (component[i + 1:] != component[i]) & (inside | (own[i + 1:] != own[i]))
            at = np.flatnonzero(near) + i + 1
            at = at[(sketch[at] == sketch[i]).sum(1) >= AGREE]
            left.append(np.full(len(at), i))
            right.append(at)
        a, b = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (left, right))
        if not len(a):
            return a, b
        used = np.unique(np.concatenate([a, b]))
        texts, digests = group["text"].take(pa.array(used)).cast(pa.binary()).to_pylist(), group["digest"].take(pa.array(used)).to_pylist()
        sets = [s for _, run in batches(pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["t"]), "t")
                for s in shingle_sets(words(run, SPACED))]
        # Another text of a repeated key is not the node's.
        right_text = np.array([xxhash.xxh3_128_digest(s.tobytes()) == d for s, d in zip(sets, digests, strict=True)])
        a, b = np.searchsorted(used, a), np.searchsorted(used, b)
        sizes = np.array([len(s) for s in sets])
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        place = np.unique(tokens, return_inverse=True)[1]
        order = np.argsort(place, kind="stable")
        place, owner = place[order], owner[order]
        shared = np.zeros((len(sets), len(sets)), np.float32)
        for start in range(0, int(place[-1]) + 1, 4096):
            first, last = np.searchsorted(place, [start, start + 4096])
            holds = np.zeros((len(sets), 4096), np.float32)
            holds[owner[first:last], place[first:last] - start] = 1
            shared += holds @ holds.T
        both = shared[a, b].astype(np.int64)
        linked = (100 * both >= percent * (sizes[a] + sizes[b] - both)) & right_text[a] & right_text[b]
        return node[used[a[linked]]], node[used[b[linked]]]

    grouped = rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "node")
    return grouped.mapInArrow(compare, "a long, b long").where("a <> b").distinct()


def _united(labels: DataFrame, more: DataFrame) -> DataFrame:
    """``labels`` of components with those united that ``more`` links join; nodes without a label stand for themselves."""
    ends = {c: labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}2")) for c in ("a", "b")}
    across = more.join(ends["a"], "a", "left").join(ends["b"], "b", "left").select(
        F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b"))
    joined = components(across)
    named = labels.join(joined.toDF("component", "next"), "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    return stored(named.unionAll(joined.join(labels.select("node"), "node", "left_anti").select("node", "component")), "united")


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """Each document with the size of its set of five-word shingles and its component of similar documents.

    Words are what ASCII white space separates; A-Z count as a-z. Two documents link if their sets' intersection
    is ``percent`` hundredths of their union at least (75 or more; the filters are built for that). Equal
    sets are one node. Nodes that share their first tokens under all orders of a group share a bucket; within it
    pairs must agree under half of all orders, and only then are the whole sets compared. A small
    bucket compares all its pairs, a large one each member with the best before it, in blocks, the
    bucket's first member being in every block; then members of large buckets that are not in one component
    yet are compared with their whole sets, block by block, so no link between components is lost.

    Documents without a word have no shingles and link with nothing. Repeated rows are documents that are
    equal; null keys take part, but the component is named by the smallest key that is not null.
    Returns ``doc`` (the key), ``text_hash`` (xxhash64 of the text), ``n_shingles``, ``component`` (smallest key of the component),
    ``group`` (a number of the component, null without words). Columns but those named are not read.
    """
    wanted = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash"))
    signed = stored(_signed(wanted), "signatures")
    classes = stored(signed.where("digest is not null").groupBy("digest").agg(
        F.min("row").alias("node"), F.min("doc").alias("least")), "classes")
    nodes = signed.join(classes.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node")
    rows = nodes.where("keys is not null").select("node", F.explode("keys").alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("head")).where("size > 1")
    sketches = nodes.where("keys is not null").select("node", "sketch")
    buckets = stored(rows.join(sizes, "key").join(sketches, "node"), "buckets")

    n_parts = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), n_parts).cast("int")
    spread = buckets.withColumn("part", F.explode(F.when((F.col("size") > BLOCK) & (F.col("node") == F.col("head")),
                                                         F.sequence(F.lit(0), n_parts - 1)).otherwise(F.array(own))))
    pairs = stored(_pairs(spread), "pairs")
    links = stored(_linked(pairs, nodes, wanted, percent), "links")
    labels = components(links)

    # Large buckets that hold several components: their members meet with their whole sets.
    placed = (buckets.where(F.col("size") > SMALL).join(labels, "node", "left")
              .select("key", "node", "head", F.coalesce("component", "node").alias("component")))
    mixed = placed.groupBy("key").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).where("_a <> _b").select("key")
    unsettled = stored(placed.join(mixed, "key", "left_semi"), "unsettled")
    if not unsettled.isEmpty():
        more = stored(_crossed(unsettled, nodes, wanted, percent), "late-links")
        if not more.isEmpty():
            labels = _united(labels, more)

    found = classes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = found.groupBy("component").agg(F.min("least").alias("name"))
    named = found.join(least, "component").select("digest", "name", F.col("component").alias("group"))
    return signed.select("doc", "text_hash", "n", "digest").join(named, "digest", "left").select(
        "doc", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("digest").isNull(), F.col("doc")).otherwise(F.col("name")).alias("component"), "group")
