"""Language of a text from the mixture of languages that explains its n-grams best."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.llm.shared import batches
from postlake.llm.words import U, mix

#: Lengths of the n-grams in bytes, and the bits of their hashes.
ORDERS = (2, 3, 4)
BITS = 15
#: A-Z become a-z, other ASCII characters that are not letters a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0x80 else 32 for b in range(256))


def grams(text: bytes) -> np.ndarray:
    """Places in the table of all n-grams of a text that hold no two spaces in a row."""
    data = np.frombuffer(b" " + text.translate(_FOLD) + b" ", np.uint8)
    gap = (data[1:] == 32) & (data[:-1] == 32)
    data = data[np.concatenate([[True], ~gap])].astype(U)
    out = []
    for k, n in enumerate(ORDERS):
        if len(data) < n:
            continue
        value = np.full(len(data) - n + 1, n, U)
        for j in range(n):
            value = value << U(8) | data[j:len(data) - n + 1 + j]
        out.append((mix(value) >> U(64 - BITS)).astype(np.int64) + (k << BITS))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Model(NamedTuple):
    languages: list[str]
    #: Log-likelihood of each n-gram in each language, n-grams by rows.
    logs: np.ndarray

    def mixture(self, text: bytes, penalty: float, rounds: int = 15) -> tuple[list[int], np.ndarray]:
        """Languages of the text, and their shares of it.

        Expectation-maximisation over all languages ranks them. Of the first one, two, ... that set is taken
        which has the greatest log-likelihood less ``penalty * log(number of n-grams) / 2`` for each
        language beyond one; n-grams of several lengths overlap, so their likelihood counts by the number
        of lengths.
        """
        found, count = np.unique(grams(text), return_counts=True)
        if not len(found):
            return [0], np.ones(1)
        logs, count = self.logs[found], count.astype(np.float32)
        top = logs.max(1, keepdims=True)
        chance, total = np.exp(logs - top), count.sum()
        part = _shares(chance, count / total, rounds)
        order = np.argsort(-part, kind="stable").tolist()
        best, part = order[:1], np.ones(1)
        value = count @ (logs[:, best[0]] - top[:, 0]) / len(ORDERS)
        cost = penalty * np.log(total) / 2
        for size in range(2, len(order) + 1):
            among = sorted(order[:size])
            own = np.ascontiguousarray(chance[:, among])
            shares = _shares(own, count / total, rounds)
            likely = count @ np.log(own @ shares + 1e-30) / len(ORDERS) - cost * (size - 1)
            if likely <= value:
                break
            best, part, value = among, shares, likely
        return best, part


def _shares(chance: np.ndarray, weight: np.ndarray, rounds: int) -> np.ndarray:
    """Shares of the columns' languages by expectation-maximisation from equal shares."""
    part = np.full(chance.shape[1], 1 / chance.shape[1], np.float32)
    for _ in range(rounds):
        new = part * ((weight / (chance @ part)) @ chance)
        done, part = abs(new - part).max() < 1e-3, new
        if done:
            break
    return part


def fit(docs: DataFrame, learn: Column | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang",
        per_language: int = 3000, smooth: float = 0.5) -> Model:
    """Learn n-gram likelihoods from documents with a language for which ``learn`` (over ``doc``, the key) holds.

    About ``per_language`` documents of a language at most are read, chosen by a hash of key and text; the
    counts of their n-grams are summed up by Spark. Rows with a null language, key or text are not used.
    Without any such row there is no language, and every text is ``und``.
    """
    own = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    own = own.where("doc is not null and text is not null and lang is not null")
    if learn is not None:
        own = own.where(learn)
    total = dict(own.groupBy("lang").count().collect())
    languages = sorted(total)
    if not languages:
        return Model([], np.zeros((len(ORDERS) << BITS, 0), np.float32))
    share = F.create_map(*[F.lit(x) for name, n in total.items() for x in (name, min(1.0, per_language / n))])
    drawn = own.where(F.pmod(F.xxhash64("doc", "text"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))

    def count(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for rows in got:
            for start, run in batches(rows, "text"):
                for name, words in zip(rows.column("lang").slice(start, len(run)).to_pylist(), run, strict=True):
                    if name not in sums:
                        sums[name] = np.zeros(len(ORDERS) << BITS, np.int64)
                    sums[name] += np.bincount(grams(words), minlength=len(ORDERS) << BITS)
        for name, sum_ in sums.items():
            at = np.flatnonzero(sum_)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(sum_[at])],
                                             names=["lang", "gram", "n"])

    counts = np.zeros((len(ORDERS) << BITS, len(languages)))
    rows = drawn.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    place = {name: i for i, name in enumerate(languages)}
    np.add.at(counts, (rows["gram"].to_numpy(), np.array([place[x] for x in rows["lang"].to_pylist()], np.int64)),
              rows["n"].to_numpy())
    counts = counts.reshape(len(ORDERS), 1 << BITS, -1) + smooth
    logs = np.log(counts / counts.sum(1, keepdims=True))
    return Model(languages, logs.reshape(len(ORDERS) << BITS, -1).astype(np.float32))


def with_language(docs: DataFrame, model: Model, text: str = "text", penalty: float = 2.0) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``shares``.

    ``shares`` maps the languages found in the whole text to their parts of it; the greatest of them (of equal
    ones the first by name) is ``lang_pred`` with its part as ``score``. A text that is null or has no letter
    is ``und`` with score 0 and no shares. Every row stays; columns of these three names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    shape = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("shares", pa.map_(pa.string(), pa.float64()))])

    def predict(words: str | None) -> dict:
        if not sent.value.languages or not words or not any(map(str.isalpha, words)):
            return {"lang_pred": "und", "score": 0.0, "shares": []}
        among, part = sent.value.mixture(words.lower().encode(), penalty)
        best = int(np.argmax(part))
        names = [sent.value.languages[i] for i in among]
        return {"lang_pred": names[best], "score": min(1.0, float(part[best])), "shares": list(zip(names, part.tolist(), strict=True))}

    @F.arrow_udf("struct<lang_pred: string, score: double, shares: map<string, double>>")
    def mixtures(texts: pa.Array) -> pa.Array:
        return pa.array([predict(t) for t in texts.to_pylist()], shape)

    keep = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "shares")]
    return docs.select(*keep, mixtures(F.col(text)).alias("_found")).select(*keep, "_found.*")
