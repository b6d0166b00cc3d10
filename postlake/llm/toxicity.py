"""Toxicity scores from a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.llm.shared import batches, stored
from postlake.llm.words import U, Words, words

#: Bits of a term's hash; bytes of the word beginnings that are terms beside whole words.
BITS = 24
HEADS = (4, 5, 6, 8)


def terms(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashed terms and the text of each: words, and beginnings of words, which compounds share."""
    long = [w.ends - w.starts > n for n in HEADS]
    hashes = [w.hashes, *(w.head_hashes(n)[m] ^ U(n) for n, m in zip(HEADS, long, strict=True))]
    return np.concatenate(hashes) >> U(64 - BITS), np.concatenate([w.owner, *(w.owner[m] for m in long)])


class Model(NamedTuple):
    """``terms`` sorted, a weight and a row of factors each. A score is the logistic of
    ``bias + sum w_i + sum over pairs of <v_i, v_j>`` over the distinct terms of a text."""

    terms: np.ndarray
    weights: np.ndarray
    factors: np.ndarray
    bias: float
    known: np.ndarray

    @classmethod
    def of(cls, terms, weights, factors, bias):
        known = np.zeros(1 << (BITS - 3), np.uint8)
        np.bitwise_or.at(known, (terms >> U(3)).astype(np.int64), (U(1) << (terms & U(7))).astype(np.uint8))
        return cls(terms, weights, factors, bias, known)

    def found(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """The model's terms in each text, once each: text and place in ``terms``, by text."""
        hashed, owner = terms(w)
        at = np.flatnonzero((self.known[(hashed >> U(3)).astype(np.int64)] >> (hashed & U(7)).astype(np.uint8)) & 1)
        pairs = np.unique(owner[at] * len(self.terms) + np.searchsorted(self.terms, hashed[at]))
        return np.divmod(pairs, max(len(self.terms), 1))

    def score(self, texts: list[bytes]) -> np.ndarray:
        owner, term = self.found(words(texts))
        return _logistic(_raw(owner, term, len(texts), self.weights, self.factors, self.bias)[0])


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _raw(owner, term, n, weights, factors, bias):
    sums, squares = np.zeros((n, factors.shape[1])), np.zeros(len(term))
    for f in range(factors.shape[1]):  # a factor at a time: all of them take several times the memory
        own = factors[term, f]
        sums[:, f] = np.bincount(owner, own, n)
        squares += own ** 2
    pairs = (sums ** 2).sum(1) - np.bincount(owner, squares, n)
    return bias + np.bincount(owner, weights[term], n) + pairs / 2, sums


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, key: str = "doc_id", text: str = "text",
        label: str = "toxic", per_class: int = 15_000, n_terms: int = 2048, n_frequent: int = 512, rank: int = 4, rounds: int = 200,
        least_ratio: float = 8.0, least_pair: float = 25.0) -> Model:
    """Learn from labelled documents for which ``learn`` (a condition over ``doc``, their key) holds.

    Of each class about ``per_class`` documents at most are read, chosen by a hash of their key: the bound of the
    labelled sample, of what is sent to all tasks and of what returns. Its terms are counted per class. Candidates are the ``n_terms``
    that tell the classes apart best, by a log-likelihood ratio of ``least_ratio`` or more, and the ``n_frequent`` that most documents
    hold, whatever they tell alone: of these such stay as make a pair, with any candidate, whose ratio is ``least_pair`` above those of its two
    terms together. Terms that stay get a weight and ``rank`` factors each, fitted by gradient steps; the bias is set right for the share of each class among all rows. Rows with a null key or label are not
    used; of rows with one key the largest label counts. With a single class every score is its rate,
    without any label 0.
    """
    own = labels.select(F.col(key).alias("doc"), F.col(label).cast("int").alias("label")).where("label in (0, 1)")
    own = own.where(F.col("doc").isNotNull())
    if learn is not None:
        own = own.where(learn)
    total = dict(own.groupBy("label").count().collect())
    clean, toxic = total.get(0, 0), total.get(1, 0)
    if not clean or not toxic:
        rate = toxic / max(clean + toxic, 1)
        return Model.of(np.zeros(0, U), np.zeros(0), np.zeros((0, rank)), float(np.log(rate / (1 - rate))) if 0 < rate < 1
                        else (60.0 if rate else -60.0))
    share = F.when(F.col("label") == 1, min(1.0, per_class / toxic)).otherwise(min(1.0, per_class / clean))
    drawn = own.where(F.pmod(F.xxhash64("doc"), F.lit(1 << 30)) < share * (1 << 30))
    drawn = drawn.groupBy("doc").agg(F.max("label").alias("label"))
    texts = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    sample = stored(texts.join(F.broadcast(drawn), "doc").select("text", "label"), "toxicity-sample")

    def count(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in got:
            for start, run in batches(rows, "text"):
                label = rows.column("label").slice(start, len(run)).to_numpy()
                hashed, owner = terms(words(run))
                pairs = np.unique(owner.astype(U) << U(BITS) | hashed)
                term, owner = pairs & U((1 << BITS) - 1), (pairs >> U(BITS)).astype(np.int64)
                found, place = np.unique(term, return_inverse=True)
                ones = np.bincount(place, label[owner]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.astype(np.int64)), pa.array(ones), pa.array(np.bincount(place) - ones)],
                    names=["term", "toxic", "clean"])

    counted = sample.mapInArrow(count, "term long, toxic long, clean long").groupBy("term").agg(
        F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    sizes = dict(sample.groupBy("label").count().collect())
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    # Log-likelihood ratio of the two rates, against one rate for both.
    both = (a + b) / (n1 + n0 + 2)
    ratio = a * F.log(a / (n1 + 1) / both) + b * F.log(b / (n0 + 1) / both)
    counted = counted.where("a + b >= 3").withColumn("ratio", ratio)
    best = counted.where(F.col("ratio") >= least_ratio).orderBy(F.desc("ratio"), "term").limit(n_terms).select("term").collect()
    frequent = counted.orderBy(F.desc(F.col("a") + F.col("b")), "term").limit(n_frequent).select("term").collect()
    telling = np.array(sorted(r.term for r in best), U)
    chosen = np.unique(np.array([r.term for r in best + frequent], U))
    bare = Model.of(chosen, np.zeros(len(chosen)), np.zeros((len(chosen), rank)), 0.0)
    places = docs.sparkSession.sparkContext.broadcast(bare)

    def locate(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in got:
            for start, run in batches(rows, "text"):
                owner, term = places.value.found(words(run))
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(run)))])
                yield pa.RecordBatch.from_arrays(
                    [rows.column("label").slice(start, len(run)),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(term, pa.int32()))],
                    names=["label", "terms"])

    shape = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("terms", T.ArrayType(T.IntegerType()))])
    rows = sample.mapInArrow(locate, shape).toArrow()
    label = rows["label"].combine_chunks().to_numpy()
    runs = rows["terms"].combine_chunks()
    owner, term = np.repeat(np.arange(len(label)), runs.value_lengths().to_numpy()), runs.flatten().to_numpy()
    keep = np.isin(chosen, telling)
    keep[_paired(owner, term, label, keep, least_pair)] = True
    number, own = np.cumsum(keep) - 1, keep[term]
    kept = Model.of(chosen[keep], np.zeros(keep.sum()), np.zeros((keep.sum(), rank)), 0.0)
    return _fit(kept, owner[own], number[term[own]], label, rank, rounds, np.log(toxic / clean) - np.log(n1 / n0))


def _paired(owner, term, label, telling, least: float, block: int = 500) -> np.ndarray:
    """Which terms that are not ``telling`` make a pair, with any term, that tells the classes apart by ``least`` more than its two
    terms do. Texts, as ``owner`` numbers them, are in order."""
    m, others = len(telling), np.flatnonzero(~telling)
    together = np.zeros((2, len(others), m), np.float32)
    for start in range(0, len(label), block):
        first, end = np.searchsorted(owner, [start, start + block])
        holds = np.zeros((min(block, len(label) - start), m), np.float32)
        holds[owner[first:end] - start, term[first:end]] = 1
        ones = label[start:start + block] == 1
        for k, part in enumerate((holds[~ones], holds[ones])):
            together[k] += part[:, others].T @ part
    sizes = np.array([(label == 0).sum(), (label == 1).sum()], np.float64) + 1
    of = label[owner] == 1
    alone = _ratio(np.stack([np.bincount(term[~of], minlength=m), np.bincount(term[of], minlength=m)]), sizes)
    found = []
    for start in range(0, len(others), 64):  # their ratios take ten times the memory of their counts
        some = others[start:start + 64]
        more = _ratio(together[:, start:start + 64], sizes) - alone[some][:, None] - alone
        more[np.arange(len(some)), some] = 0
        found.append(some[(more >= least).any(1)])
    return np.concatenate([others[:0], *found])


def _ratio(counts, sizes):
    """Log-likelihood ratio of the rates of both classes, against one rate for both."""
    b, a = counts.astype(np.float64) + 0.5
    both = (a + b) / sizes.sum()
    return a * np.log(a / sizes[1] / both) + b * np.log(b / sizes[0] / both)


def _fit(model: Model, owner, term, label, rank: int, rounds: int, shift: float) -> Model:
    """Adam on the logistic loss with a small ridge; ``shift`` corrects the bias for the shares in the sample."""
    n, m = len(label), len(model.terms)
    state = [np.zeros(m), np.random.default_rng(5).normal(0, 0.02, (m, rank)), np.array([np.log((label.mean() + 1e-9) / (1 - label.mean() + 1e-9))])]
    first, second = [np.zeros_like(x) for x in state], [np.zeros_like(x) for x in state]
    for step in range(1, rounds + 1):
        raw, sums = _raw(owner, term, n, *state[:2], state[2][0])
        off = (_logistic(raw) - label) / n
        each = off[owner]
        slope = [np.bincount(term, each, m) + 1e-4 * state[0],
                 np.stack([np.bincount(term, each * (sums[owner, f] - state[1][term, f]), m) for f in range(rank)], 1)
                 + 1e-4 * state[1], np.array([off.sum()])]
        for x, d, u, v in zip(state, slope, first, second, strict=True):
            u += 0.1 * (d - u)
            v += 0.01 * (d * d - v)
            x -= 0.05 * (u / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return Model.of(model.terms, state[0], state[1], float(state[2][0] + shift))


def with_score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score of each whole text, 0 to 1; null and empty texts get that of no terms. Every row
    and column stays; a column called ``name`` is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        rows = pa.RecordBatch.from_arrays([texts], names=["text"])
        found = [sent.value.score(run) for _, run in batches(rows, "text")]
        return pa.array(np.concatenate(found) if found else np.zeros(0))

    return docs.withColumn(name, score(F.col(text).cast("binary")))
