import hashlib

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    base = " ".join(f"word{i} tho" for i in range(40))
    rows = [(0, base), (1, base + " tail"), (2, "THE same"), (3, "the same"), (4, "12 34"), (5, None), (6, "other words here")]
    df = spark.createDataFrame([(i, t, "en", "s", 9) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    stage = dict(pipeline.STAGES)
    ids = lambda d: sorted(r.doc_id for r in d.collect())
    one = stage["language_id"](spark, df, str(tmp_path))
    assert ids(one) == [0, 1, 2, 3, 6] and one.columns == df.columns
    two = stage["exact_dedup"](spark, one, str(tmp_path))
    assert ids(two) == [0, 1, 3, 6] and sorted(two.columns) == sorted(df.columns)
    three = stage["ngram_join"](spark, two, str(tmp_path))
    assert ids(three) == [0, 3, 6]
    four = stage["mixing"](spark, three, str(tmp_path)).collect()
    assert sum(len(r.text.split()) for r in four) == round(1.5 * sum(len(dict(rows)[i].split()) for i in (0, 3, 6)))
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.decoded_sha256) for r in out) == sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in four)


def test_null_and_repeated_ids(spark, tmp_path):
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "A b c d"), (1, "e f g"), (2, "e f g"), (None, "h i j k l"), (None, "h i j k l"), (None, "m n")]
    df = spark.createDataFrame([(i, t, "en", "s", 9) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(pipeline.STAGES)
    one = stage["exact_dedup"](spark, df, str(tmp_path))
    assert one.columns == df.columns
    assert sorted((r.doc_id or 0, r.text.lower()) for r in one.collect()) == [(0, "h i j k l"), (0, "m n"), (1, "a b c d"), (2, "e f g")]
    n = sum(len(t.split()) for _, t in rows)
    out = stage["mixing"](spark, df, str(tmp_path)).collect()
    assert sum(len(r.text.split()) for r in out) == round(1.5 * n) and any(r.doc_id is None for r in out)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    taken = pipeline.mixing.op4_mixing(spark, str(tmp_path)).collect()
    assert len(taken) == len(rows) and sum(r.taken for r in taken) == round(1.5 * n) and all(r.taken <= 2 * r.size for r in taken)


def test_texts_without_a_known_gram_go(spark, tmp_path):
    rows = [(i, "the thing that they think", "en") for i in range(40)] + [(100, "日本語の文章", "en"), (101, "the thing", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id for r in dict(pipeline.STAGES)["language_id"](spark, df, str(tmp_path)).collect()}
    assert got == {*range(40), 101}
    assert dict(pipeline.STAGES)["language_id"](spark, df.withColumn("lang", pipeline.F.lit(None).cast("string")), str(tmp_path)).count() == 0
