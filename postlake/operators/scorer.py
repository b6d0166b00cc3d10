"""A user's model in place of the reply table."""

import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake import vocab
from postlake.schemas import REPLIES

#: Replies as ``validate_replies`` takes them, with what they cost.
SCORED = T.StructType([*REPLIES.fields, *[T.StructField(c, T.LongType()) for c in ("tokens_in", "tokens_out", "requests")]])
#: Models that this worker has loaded, by the call of ``score`` that wanted them.
_LOADED: dict[str, Callable] = {}


class Reply(NamedTuple):
    """What a model says about one text."""

    text: str
    tokens_in: int = 0
    tokens_out: int = 0


def runs(texts: list[str], limit: int) -> Iterator[list[int]]:
    """Places of texts in runs of at most ``limit`` bytes; a longer text is a run by itself."""
    run, size = [], 0
    for i, text in enumerate(texts):
        length = len(text.encode())
        if run and size + length > limit:
            yield run
            run, size = [], 0
        run.append(i)
        size += length
    if run:
        yield run


def ask(model: Callable, texts: list[str], tries: int) -> list[tuple]:
    """(reply or None, error or None, requests) of each text.

    If a call fails, each of its texts is asked alone, ``tries`` times at most, so that one text that a model
    cannot read costs no other its reply. A model may also return an exception for a text, which is then asked alone as well.
    """
    def call(some):
        got = list(model(some))
        if len(got) != len(some):
            raise ValueError(f"{len(got)} replies to {len(some)} texts")
        return [Reply(g) if isinstance(g, str) else g for g in got]

    try:
        first = call(texts)
    except Exception as exc:  # whatever a user's model raises
        first = [exc] * len(texts)
    out = []
    for text, reply in zip(texts, first, strict=True):
        requests, error = 1, None
        for _ in range(tries):
            if not isinstance(reply, Exception):
                break
            requests += 1
            try:
                reply = call([text])[0]
            except Exception as exc:
                reply = exc
        if isinstance(reply, Exception):
            error, reply = f"{type(reply).__name__}: {reply}"[:vocab.ERROR_CHARS], None
        out.append((reply, error, requests))
    return out


def score(postings: DataFrame, load: Callable[[], Callable], name: str, key="raw_posting_id", text="text",
          batch_bytes=1 << 20, tries=2) -> DataFrame:
    """Replies of a model to ``postings``, one row each, in the columns of SCORED.

    ``load()`` gives the model, a function from a list of texts to a list of replies (JSON texts, or ``Reply`` with token
    counts). A worker loads it once, however many tasks it runs. The model sees at most ``batch_bytes`` of text at a time.
    A posting whose calls all fail is a row with an ``error`` and no reply; a model that cannot be loaded fails the job. A null text
    is asked as an empty one. Work that follows should read the stored result: a frame that is evaluated twice asks twice.
    """
    call = uuid.uuid4().hex

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if call not in _LOADED:
                _LOADED[call] = load()
            keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for run in runs(texts, batch_bytes):
                got = ask(_LOADED[call], [texts[i] for i in run], tries)
                replies = [r for r, _, _ in got]
                columns = [keys.take(pa.array(run, pa.int64())), pa.array([name] * len(run)), pa.array([r and r.text for r in replies], pa.string()),
                           pa.array([e for _, e, _ in got], pa.string()), pa.array([r.tokens_in if r else 0 for r in replies], pa.int64()),
                           pa.array([r.tokens_out if r else 0 for r in replies], pa.int64()), pa.array([n for *_, n in got], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=SCORED.fieldNames())

    return postings.select(F.col(key).cast("bigint"), text).mapInArrow(reply, SCORED)
