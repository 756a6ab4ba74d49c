"""Rows that share ids, have none, or clash in column names: each operator and stage by value, not by count."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattiq.llm import common, exact_dedup, language_id, mixing, ngram_join


def texts(got):
    return sorted(r.text for r in got)


def test_sample_bounds_hold_at_any_size():
    assert common.below(10_000 / 1e12) > 1e10 and common.below(1) == (1 << 63) - 1 and common.below(0) == 0


def test_languages_have_equal_shares(spark):
    rows = [("t%d" % (i % 3), "aa") for i in range(3000)] + [("u", "bb")] * 20
    got = {r.lang: r["count"] for r in language_id.stratified(spark.createDataFrame(rows, "text string, lang string"), 400).groupBy("lang").count().collect()}
    assert got["bb"] == 20 and 300 < got["aa"] < 460


def test_exact_copies_go_by_row(spark):
    rows = [(5, "aa", 1), (7, "AA", 2), (5, "only", 3), (5, "only", 4), (None, "cc", 5), (None, "CC", 6), (None, "aa", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row int").withColumn("_key", F.lit(1)).withColumn("text_sha256", F.lit("x"))
    got = exact_dedup.drop_copies(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, r.text.lower()) for r in got.collect()) == [(0, "cc"), (5, "only"), (7, "aa")]


def test_hot_groups_meet_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rows = [(i, "hot") for i in range(9)] + [(20 + i, f"t{i // 2}") for i in range(6)]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**{i: (8, 9) for i in range(9)}, **{20 + i: (21 + i // 2 * 2, 2) for i in range(6)}}


def test_near_copies_go_by_row(spark):
    base = [f"w{i}" for i in range(60)]
    near = " ".join([*base, "tail"])
    rows = [(4, " ".join(base), 0), (4, near, 1), (None, near + " end", 2), (4, "other text here", 3), (9, None, 4), (9, "", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int").withColumn("_of", F.lit(2)).withColumn("_row", F.lit(1))
    got = ngram_join.one_of_each(df)
    assert got.columns == df.columns
    kept = sorted(r.component_id for r in got.collect())
    assert kept in ([0, 3, 4, 5], [1, 3, 4, 5])


def test_hub_that_does_not_link(spark):
    rng, base = random.Random(3), [f"w{i}" for i in range(200)]
    rows = []
    for i in range(120):
        w = list(base)
        w[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        rows.append((i + 1, " ".join(w)))
    hub = list(base)
    for k in range(0, 200, 20):
        hub[k] = f"h{k}"
    counted, plain = [], ngram_join.components
    ngram_join.components = lambda links, scratch, name: counted.append(links.count()) or plain(links, scratch, name)
    try:
        got = ngram_join.near_components(spark.createDataFrame([*rows, (0, " ".join(hub))], "doc_id long, text string")).collect()
    finally:
        ngram_join.components = plain
    assert {r.component_id for r in got if r.doc_id} == {1} and max(counted) < 120 * 12


@pytest.mark.parametrize("n", [30_000])
def test_very_long_texts(spark, n):
    long = " ".join(f"w{i}" for i in range(n))
    df = spark.createDataFrame([(1, long, "s", 0), (2, long + " z", "s", 0), (3, "a b", "t", 0)], "doc_id long, text string, source string, n_chars long")
    assert [r.component_id for r in ngram_join.near_components(df).orderBy("doc_id").collect()] == [1, 1, 3]
    got = mixing.mixed_documents(df).collect()
    assert sum(len(r.text.split()) for r in got) == round(1.5 * (2 * n + 3))
    known = {1: long.split(), 2: [*long.split(), "z"], 3: ["a", "b"]}
    for r in got:  # the words of a pass are words of the document, in order
        at = iter(known[r.doc_id])
        assert all(w in at for w in r.text.split()) and r.n_chars == len(r.text)


def test_mixing_keeps_rows_apart(spark):
    rows = [(1, "a b c d"), (1, "p q r s t u"), (None, "x y z"), (2, None)]
    df = spark.createDataFrame([(i, t, "s", 0) for i, t in rows], "doc_id long, text string, source string, n_chars int")
    for c in ("pass", "_spans", "_id", "_row", "_words", "_picked", "shard"):
        df = df.withColumn(c, F.lit(3))
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns and dict(got.dtypes)["n_chars"] == "int"
    got = got.collect()
    assert any(r.doc_id is None for r in got) and sum(len(r.text.split()) for r in got) == round(1.5 * 13)
    for r in got:
        assert any(r.text in (t or "") for i, t in rows if i == r.doc_id) and r["pass"] == 3


def brute_mix(rows, mix):
    """Words taken of each row, from slots and permutations, one word at a time."""
    taken = [0] * len(rows)
    for s in mix.sources:
        order = sorted((i for i, r in enumerate(rows) if r[2] == s["name"]), key=lambda i: (rows[i][0], len((rows[i][1] or "").split())))
        owner = [i for i in order for _ in (rows[i][1] or "").split()]
        left = s["take"]
        for p in range(s["passes"] + 1):
            if not left:
                break
            blocks = -(-len(owner) // mix.block)
            for b in mixing.permute(np.arange(blocks), blocks, mix.key(s["index"], p)):
                for i in owner[b * mix.block : (b + 1) * mix.block]:
                    if left:
                        taken[i] += 1
                        left -= 1
    return taken


def test_words_taken_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 300))), rng.choice(["a", "b", "b", "c"]), i) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in mixing.op4_mixing(spark, str(tmp_path)).collect()}
    mix = mixing.Mix(df)
    assert [got[i].taken for i in range(60)] == brute_mix(rows, mix)
    slots = mix.slots().collect()
    assert len({r.shard for r in slots}) > 20 and all(r.n_shards <= mix.shards and (r.shard is None) == (r.taken == 0) for r in got.values())
    blocks = mixing.packed_blocks(df).collect()
    assert sum(len(r.text.split()) for r in blocks) == sum(r.taken for r in got.values()) and all(len(r.text.split()) <= mixing.BLOCK_WORDS for r in blocks)
    assert sorted((r.shard, r.source, r.block) for r in blocks) == sorted((r.shard, r["_index"], r["_block"]) for r in slots if r["_words"])


def test_names_clash_in_language_stage(spark):
    rows = [(i, t, lang) for i in range(40) for t, lang in (("the thing that they think", "en"), ("das Ding und der Schuh", "de"))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for c in ("score", "lang_pred", "_text", "row", "_n"):
        df = df.withColumn(c, F.lit(7))
    f = language_id.fit(df)
    got = language_id.keep_identified(df, f)
    assert got.columns == df.columns and got.count() == 80 and {r.score for r in got.collect()} == {7}


def test_language_counts_against_brute_force(spark):
    rows = [(i, t, lang) for i in range(30) for t, lang in (("the thing that they think", "en"), ("das Ding und der Schuh", "de"), ("le chat que la dame", "fr"))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    f = language_id.fit(df)
    letters = language_id.letter_table()
    for text in ("the thing", "der Schuh that", "zzz"):
        h, _, n = language_id.gram_hashes([text], letters)
        masks = [{int(s) for s in np.flatnonzero(f.masks[0] >> np.uint64(i) & np.uint64(1))} for i in range(3)]
        slots = language_id.slots(h)
        hits = [sum(all(int(s[k]) in masks[i] for s in slots) for k in range(len(h))) for i in range(3)]
        true = [max(0, (x - len(h) * p) / (1 - p)) for x, p in zip(hits, f.false, strict=True)]
        lang, score = f.predict([text], letters)[0]
        best = max(range(3), key=lambda i: (true[i], -i))
        assert (lang, round(score, 9)) == ((f.langs[best], round(true[best] / sum(true), 9)) if sum(true) else (f.common, 0.0))


def test_digest_of_a_text_of_megabytes(spark):
    text = "Ab " * 1_500_000
    got = exact_dedup.exact_groups(spark.createDataFrame([(1, text), (2, text.lower())], "doc_id long, text string")).collect()
    assert {(r.keep_id, r.group_size, r.text_sha256) for r in got} == {(2, 2, hashlib.sha256(text.lower().encode()).hexdigest())}


@pytest.mark.parametrize("name", ["language_id", "exact_dedup", "ngram_join", "mixing"])
def test_stages_keep_columns_and_odd_rows(spark, tmp_path, name):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(i, "the thing that they think of", "en", "s") for i in range(30)] + [(None, "the other thing they thought", "en", None), (7, "the thing", None, "s"), (8, None, "en", "s"), (9, "", "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for c in ("_row", "_of", "_key", "score", "pass", "_spans", "component_id", "keep_id", "row"):
        df = df.withColumn(c, F.lit(5))
    stage = dict(pipeline.STAGES)[name]
    got = stage(spark, df, str(tmp_path))
    assert got.columns == df.columns
    found = {(r.doc_id, r.text) for r in got.collect()}
    want = {
        "language_id": {(r[0], r[1]) for r in rows if r[1]},
        "exact_dedup": {(29, "the thing that they think of"), (None, "the other thing they thought"), (7, "the thing"), (9, "")},
        "ngram_join": {(0, "the thing that they think of"), (None, "the other thing they thought"), (7, "the thing"), (8, None), (9, "")},
    }
    assert found == want[name] if name in want else sum(len(t.split()) for _, t in found) > 0
    empty = stage(spark, df.limit(0), str(tmp_path))
    assert empty.columns == df.columns and empty.count() == 0


def test_windows_of_rows_that_share_an_id(spark):
    from lattiq.llm import substring_dedup

    w = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(w[:20]), 0), (3, " ".join([*w[:20], "x"]), 1), (3, " ".join(["y", *w[20:40]]), 2), (2, " ".join(w[20:40]), 3), (None, " ".join(w), 4)]
    got = {r.n: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, n int"), keep=["n"]).collect()}
    assert got == {0: (20, 0, rows[0][1]), 1: (21, 20, "x"), 2: (21, 20, "y"), 3: (20, 0, rows[3][1]), 4: (40, 0, rows[4][1])}


@pytest.mark.parametrize("most", [50_000, 2, 0])
def test_trees_and_split_groups_agree(spark, monkeypatch, most):
    from lattiq.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "GROUP_RUNS", most)
    rng = random.Random(6)
    base = [rng.choice("abc") for _ in range(120)]
    rows = []
    for i in range(12):
        at = rng.randrange(60)
        rows.append((i, " ".join([*(rng.choice("abc") for _ in range(10)), *base[at : at + 40], *(rng.choice("abc") for _ in range(10))])))
    first = {}
    for i, t in rows:
        words = t.split()
        for k in range(len(words) - 12):
            first.setdefault(tuple(words[k : k + 13]), i)
    for r in substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        words = dict(rows)[r.doc_id].split()
        gone = {j for k in range(len(words) - 12) if first[tuple(words[k : k + 13])] < r.doc_id for j in range(k, k + 13)}
        assert r.n_removed == len(gone) and r.kept.split() == [x for j, x in enumerate(words) if j not in gone]


def test_bytes_of_rows_without_ids(spark):
    from lattiq.llm import suffix_array_dedup

    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared, other = text(300), text(260)
    rows = [(None, text(50) + shared, 0), (2, shared + text(40), 1), (5, other + text(30), 2), (5, text(20) + other, 3), (6, text(400), 4)]
    got = {r.n: (r.n_removed, r.n_spans) for r in suffix_array_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, n int"), keep=["n"]).collect()}
    assert got == {0: (300, 1), 1: (300, 1), 2: (260, 1), 3: (260, 1), 4: (0, 0)}


def test_recall_where_not_all_rows_are_probed(spark):
    from lattiq.llm import ann

    rng = np.random.default_rng(9)
    centres = rng.normal(size=(60, 16)) * 3
    x = (centres[rng.integers(60, size=6000)] + rng.normal(size=(6000, 16))).astype(np.float32).astype(float)
    books = ann.kmeans(x[:, :8], 35), ann.kmeans(x[:, 8:], 35)
    assert ann.share_for(x, *books, 10) < 0.5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.search(df, F.col("vec_id") % 100 == 0).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q, got in found.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len({v for _, v, _ in got} & set(np.argsort(d, kind="stable")[:10].tolist()))
        assert [k for k, _, _ in sorted(got)] == list(range(1, 11)) and all(abs(s - d[v]) < 1e-12 for _, v, s in got)
    assert len(found) == 60 and hits >= 0.9 * 600
