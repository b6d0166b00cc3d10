"""Counts equal those of taking the longest piece again and again."""

import random

import public_tokenizers
import pytest

from postlake.llm.queries import word_pieces
from postlake.llm.wordpiece import Automaton, with_counts


def _greedy(word, first, later, unknown=1):
    n, known = 0, first
    while word:
        size = next((k for k in range(len(word), 0, -1) if word[:k] in known), 0)
        if not size:
            return unknown
        word, n, known = word[size:], n + 1, later
    return n


@pytest.mark.parametrize("seed", range(30))
def test_automaton_is_greedy(seed):
    rng = random.Random(seed)

    def some(n):
        return bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, n)))
    first, later = {some(5) for _ in range(12)}, {some(5) for _ in range(12)}
    automaton = Automaton(first, later)
    for _ in range(300):
        word = some(14)
        assert automaton.count(word) == _greedy(word, first, later), (word, first, later)
    assert automaton.count(b"") == 0


def test_whole_texts(spark):
    first, later = word_pieces(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    known = set(first), set(later)
    texts = [None, "", "  \n", "Hello  hello\tworld", "ünïcödé 日本語🙂 xx", "anan " * 4000, "y" * 30_000, "Hello"]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in with_counts(docs, first, later, mark=b" ").collect()}
    want = {i: sum(_greedy(b" " + w, *known) for w in (t or "").encode().split()) for i, t in enumerate(texts) if i != 6}
    assert {k: v for k, v in got.items() if k != 6} == want
    assert with_counts(docs.limit(0), first, later).count() == 0
