"""Every id of every document lies in one piece, ids equal the other library's, and padding is small."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from postlake.llm.packing import Packer, added_tokens, encode, pack
from postlake.llm.queries import op1_packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = ["", None, "a", "it's  two\n\n spaces \t and <|endoftext|> ends ", "über straße 12345 ½ ²x 日本語 🙂🙂",
         "word " * 3000, "\u0085 　 x", "x" * 5000, "same", "same"]


def _ids():
    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    known.encode_special_tokens = True
    return [known.encode(t or "", add_special_tokens=False).ids + [0] for t in TEXTS]


def test_packs_every_id_once(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bin string").repartition(3)
    got = pack(docs, RANKS, open_windows=2).collect()
    pieces, windows = {}, {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        pieces.setdefault(r.doc, []).append((r.start, ids))
        windows.setdefault(r.sequence_id, []).append((r.offset, len(ids)))
        assert r.doc_tokens == len(_ids()[r.doc])
    for doc, want in enumerate(_ids()):
        found = sorted(pieces[doc], key=lambda p: p[0])
        assert [p[0] for p in found] == list(np.cumsum([0] + [len(p[1]) for p in found])[:-1])
        assert np.concatenate([p[1] for p in found]).tolist() == want
    for spans in windows.values():
        end = 0
        for offset, n in sorted(spans):
            assert offset == end
            end += n
        assert end <= 1024
    total = sum(map(len, _ids()))
    assert len(windows) == -(-total // 1024)


def test_no_rows_and_null_key(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pack(empty, RANKS).count() == 0
    one = spark.createDataFrame([(None, None), (None, None)], "doc_id long, text string")
    assert [(r.doc, r.doc_tokens) for r in pack(one, RANKS).collect()] == [(None, 1), (None, 1)]


@pytest.mark.parametrize("sizes", [[3, 3, 3, 3], [8, 1, 7, 9, 2], [20]])
def test_windows_are_full_or_open(sizes):
    packer = Packer(8, 2)
    for i, n in enumerate(sizes):
        packer.put(i, 0, np.arange(n, dtype="<u4"), n)
    assert all(sum(len(p[2]) for p in w) == 8 for w in packer.sent)
    assert len(packer.rest()) <= 2


def test_added_tokens_have_their_ids(spark, tmp_path):
    """Without ``encode_special_tokens``: the literal of an added token is that token, in the query and the pipeline."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    known, added = Tokenizer.from_file(vocabulary), added_tokens(vocabulary)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>\n\n y <|endoftext", *(t or "" for t in TEXTS)]
    want = [known.encode(t, add_special_tokens=False).ids for t in texts]
    assert 50256 in want[0]
    assert [encode(t, RANKS, added).tolist() for t in texts] == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    sizes = {i: len(ids) + 1 for i, ids in enumerate(want)}
    assert {r.doc_id: r.doc_tokens for r in op1_packing(spark, str(tmp_path)).collect()} == sizes
    assert {r.doc_id: r.doc_tokens for r in corpus_pipeline.pack(spark, docs, str(tmp_path)).collect()} == sizes


@pytest.mark.parametrize("text", [" " * 2_000_000 + "word", "a b" + "\n" * 2_000_000 + "word", "x" + " \u3000\t\x85" * 300_000 + " y's  z",
                                  "a" + " " * 1_200_000 + "<|endoftext|>" + "\n" * 1_200_000 + " .\x1c" + " " * 1_200_000,
                                  ("b" + " " * 100_000) * 3 + "\x1c", " " * 99_999 + "c", " " * 100_001 + "'s"])
def test_long_runs_of_white_space(text):
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    want = Tokenizer.from_file(vocabulary).encode(text, add_special_tokens=False).ids
    assert np.array_equal(encode(text, RANKS, added_tokens(vocabulary)), want)


def test_workers_need_no_pandas(spark):
    """The module brings none, and the leftovers of neighbouring partitions are packed from Arrow; a key beside a null one keeps all its digits."""
    import postlake.llm.packing as module

    docs = spark.createDataFrame([(None, "a b"), (2**53 + 1, "c d")], "doc_id long, text string").coalesce(1)
    packed = pack(docs, RANKS)
    assert "InPandas" not in packed._jdf.queryExecution().executedPlan().toString() and not hasattr(module, "pd")
    assert {r.doc for r in packed.collect()} == {None, 2**53 + 1}
