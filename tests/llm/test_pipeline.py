"""Each stage's decisions against plain ones on a small input, and the stages one after the other."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from postlake.llm.shared import stored

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    pool = [f"w{i}" for i in range(3000)]

    def some(n):
        return " ".join(rng.choice(pool) for _ in range(n))
    rows, labels = [], []
    for i in range(300):
        toxic = i % 6 == 0
        text = some(60) + (" you vile idiot " + some(20) if toxic else "")
        rows.append((i, text))
        if i < 240:
            labels.append((i, 1, int(toxic)))
    passage, leak = some(70), some(14)
    rows += [(1000 + i, some(40) + " " + passage + " " + some(30)) for i in range(4)]
    rows += [(2000, some(30) + " " + leak + " " + some(30)), (2001, rows[1][1]), (2002, rows[1][1] + " extra"), (2003, None), (2004, ""), (2005, "..."),
             (2006, passage), (None, rows[2][1]), (None, some(50)), (None, some(50)), (2007, some(30)), rows[4], rows[4]]
    path = str(tmp_path_factory.mktemp("tables"))
    docs = [(d, t, "en", None, None if t is None else len(t)) for d, t in rows]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, "never there")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for _, stage in pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append([(r.doc_id, r.text, r.n_chars) for r in docs.collect()])
    ids = [[k[0] for k in stage] for stage in kept]
    assert not any(i is not None and i < 300 and i % 6 == 0 for i in ids[0]) and {1, 2000, 2003, 2004} <= set(ids[0])
    assert ids[0].count(4) == 3 and ids[1].count(4) == 1 and ids[1].count(None) == 2
    assert 1 in ids[1] and not {2001, 2002} & set(ids[1]) and {2003, 2004, 2005, 2006} <= set(ids[1])
    texts = {k[0]: k for k in kept[2]}
    assert len(texts[1000][1].split()) == 140 and all(len(texts[i][1].split()) == 70 for i in (1001, 1002, 1003))
    assert 2006 not in texts and texts[1001][2] == len(texts[1001][1]) and texts[2003][1] is None
    assert 2000 not in ids[3] and set(ids[2]) - set(ids[3]) == {2000}
    packed = pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert sorted({r.doc_id for r in packed if r.doc_id is not None}) == sorted(i for i in ids[3] if i is not None)
    assert len(pipeline.run(spark, folder).collect()) == len(packed)


def test_other_columns_are_kept_by_any_name(spark, folder):
    """Columns that stages use themselves, or that are called like the operators' own."""
    names = ["_row", "_best", "_score", "score", "_text", "_words", "_cut", "row", "doc", "hash", "text_hash", "best", "group", "digest", "id", "a.b"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    wide = docs.withColumns({n: F.concat(F.lit(f"{n} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for n in names})
    plain = docs
    for _, stage in pipeline.STAGES[:-1]:
        wide, plain = (stored(stage(spark, d, folder), "stage") for d in (wide, plain))
        assert wide.columns == [*docs.columns, *names]
        rows = wide.collect()
        assert all(r[n] == f"{n} {'-' if r.doc_id is None else r.doc_id}" for r in rows for n in names)
        assert sorted((r.doc_id, r.text, r.n_chars) for r in rows if r.doc_id is not None and r.text is not None) == sorted(
            (r.doc_id, r.text, r.n_chars) for r in plain.collect() if r.doc_id is not None and r.text is not None)
    bare = pipeline.cut_repeats(spark, docs.select("text", "doc_id"), folder)
    assert bare.columns == ["text", "doc_id"] and bare.count() == pipeline.cut_repeats(spark, docs, folder).count()


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
