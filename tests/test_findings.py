"""Cases that a review found: odd lines, models of many pieces, long lists."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest

from lattiq.operators import evaluate as E
from lattiq.operators import ngram as B
from lattiq.operators import perturb as P
from lattiq.operators import search as S
from lattiq.operators import windows
from lattiq.operators.steps import Folder, numbered
from lattiq.plans import decoding, models, registry
from lattiq.sources import binary, pieces


def test_syllables_of_words_with_line_breaks(spark, tmp_path):
    spark.createDataFrame([(0, "a.\nb c\td\te x"), (1, "\nq")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.ch, r.syl) for r in registry.QUERIES["read_syllables"](spark, str(tmp_path)).collect()}
    assert got == {("a.\n", "a.\nb"), ("c\td", "c\td\te"), ("x", "x"), ("\nq", "\nq")}


def network_file():
    layers = [("AFFINE_TRANSFORM", 4, 6, np.arange(24) / 8, np.arange(6) / 4, None), ("VQ_AFFINE_TRANSFORM", 6, 2, np.arange(6) / 2, [0.5, 1.0], [3, 2, 2, 3, 1, 2, 3, 3, 2, 1]), ("FIXEDSCALE", 2, 2, [2.0, 3.0], None, None),
              ("AFFINE_TRANSFORM", 2, 5, np.arange(10) / 16, np.arange(5), None), ("SOFTMAX", 5, 5, None, None, None), ("SUMGROUP", 5, 5, None, None, [1] * 5)]
    return binary.network_bytes([("m", [0, 1, 3], 0), ("o", [4], 1)], [("t", 2, [0.0, 1.0, 0.0, 0.0]), ("u", 1, [0.5])], 4, 1, layers, [-0.5, -1.0, -1.5, -2.0, -2.5])


def by_row(packed):
    out = {}
    for r in packed.values.orderBy("kind", "id", "row").collect():
        out.setdefault((r.kind, r.id), []).extend(r["values"])
    return out


def test_network_in_pieces(spark):
    files = spark.createDataFrame([("a", network_file()), ("b", network_file())], "path string, content binary")
    whole = {(r.kind, r.id): r for r in binary.parse_networks(files.where("path = 'a'")).collect()}
    for size in (4, 20, 1 << 18):  # rows and headers reach over the ends of pieces
        heads, values = pieces.parse_network_pieces(pieces.cut_files(files, size))
        got = by_row(pieces.Packed(heads, values.where("path = 'b'")))
        for i in (0, 1, 3):
            assert got["weights", i] == whole["layer", i]["values"] and got["bias", i] == whole["layer", i]["more"]
        assert got["scale", 2] == whole["layer", 2]["values"] and np.allclose(1 / np.exp(got["prior", 0]), whole["prior", 0]["values"])
        assert {(r.kind, r.id): (r.name, r.ints, r.n, r.part) for r in heads.where("path = 'a'").collect()} == {k: (r.name, r.ints, r.n, r.part) for k, r in whole.items() if k[0] != "prior"}
    active = spark.createDataFrame([(0, 4), (1, 1)], "place int, state int")
    cut_whole = {(r.kind, r.id): r for r in binary.active_states(binary.parse_networks(files.where("path = 'a'")), active).collect()}
    cut = pieces.active_states(pieces.parse_network_pieces(pieces.cut_files(files.where("path = 'a'"), 20)), active)
    got = by_row(cut)
    assert got["weights", 3] == cut_whole["layer", 3]["values"] and got["bias", 3] == cut_whole["layer", 3]["more"] and got["weights", 0] == cut_whole["layer", 0]["values"]
    assert {(r.kind, r.id): r.ints for r in cut.heads.collect()} == {k: r.ints for k, r in cut_whole.items() if k[0] != "prior"}
    with pytest.raises(Exception, match="lacks a piece"):
        pieces.parse_network_pieces(pieces.cut_files(files, 20).where("at <> 40"))
    weights = network_file().index((np.arange(24) / 8).astype("<f4").tobytes())
    with pytest.raises(Exception, match="values are missing"):
        pieces.parse_network_pieces(pieces.cut_files(files, 4).where(f"at <> {weights + 8}")).values.collect()


def test_network_of_all_vectors_is_no_single_row(spark, tmp_path):
    spark.range(5000).selectExpr("id AS vec_id", "transform(sequence(1, 64), i -> float(id % 97) / i) AS embedding", "int(id % 3) AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = numbered(registry.vectors(spark, str(tmp_path)).select("vec_id", "v"), ["vec_id"], "place")
    most = lambda df: df.selectExpr("max(octet_length(content))", "sum(octet_length(content))").first()
    for got in (models.network_pieces(spark, rows), models.mixture_pieces(spark, str(tmp_path))):
        largest, total = most(got)
        assert total > 1_000_000 and largest <= pieces.PIECE + 256
    assert registry.QUERIES["network_active_states"](spark, str(tmp_path)).count() == 1667


def test_mixtures_in_pieces(spark):
    states = [("s", [(-1.0, np.arange(3), np.arange(3) + 1, 2.0), (-2.0, -np.arange(3), np.arange(3) + 2, 3.0)]), ("none", []), ("t", [(-0.5, np.ones(3), np.ones(3), 4.0)])]
    files = spark.createDataFrame([("a", binary.mixture_bytes(3, [("m", [0, 2], 0)], states, [("t", 2, [0.0, 1.0, 0.0, 0.0])]))], "path string, content binary")
    whole = binary.parse_mixture_models(files)
    want = {(r.id, r.part): (r["values"], r.more, r.lw, r.gconst) for r in whole.where("kind = 'mixture'").collect()}
    for size in (4, 24, 1 << 18):
        heads, values = pieces.parse_mixture_pieces(pieces.cut_files(files, size))
        got = {(r.kind, r.id, r.row): r["values"] for r in values.collect()}
        assert {k: (got["mean", *k], got["inverse", *k], *got["lw", *k], *got["gconst", *k]) for k in want} == want and len(got) == 4 * len(want)
        assert [(r.name, r.n) for r in heads.where("kind = 'state'").orderBy("id").collect()] == [("s", 2), ("none", 0), ("t", 1)]


def test_ngram_graph_sends_no_table_over_the_driver(spark):
    table = B.ngram_table(spark.createDataFrame([(["a", "b", "a"],), (["b"],)], "tokens array<string>"), 3)
    got = B.ngram_graph(table, 3)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString() and got.where("dst = '</s>'").count() == 5


def test_ngram_graph_deals_words_out_once(spark, tmp_path):
    spark.createDataFrame([(1, 0, "a b a"), (1, 1, "b c")], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = registry.QUERIES["ngram_graph"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1  # blocks of windows; no table of n-grams is dealt out
    assert got.count() == 34


ODD = [["a", "b", "a"], [], ["the"], ["the", "</s>", "the", "<s>"], ["", "", "x"], ["\u00e9\U00020000", "a", None, "a"], ["a", "b", "a"], *[["the", f"w{i}", "of", "the", f"w{i % 3}"] for i in range(40)], ["q"] * 300]


@pytest.mark.parametrize(("order", "chunk", "bucket"), [(1, 10, 10), (2, 25, 16), (3, 40, 64), (3, 1 << 21, 1 << 20), (5, 100, 50)])
def test_ngram_table_by_hand(spark, monkeypatch, order, chunk, bucket):
    """Many chunks and buckets, words that are common and so lie in many of them, nulls and marks in a sentence."""
    monkeypatch.setattr(windows, "CHUNK", chunk)
    monkeypatch.setattr(B, "BUCKET", bucket)
    n = Counter(tuple(t[i : i + k]) for t in (["<s>", *x, "</s>"] for x in ODD) for k in range(1, order + 1) for i in range(len(t) - k + 1))
    total = Counter()
    for g, m in n.items():
        total[len(g), g[:-1]] += m
    want = {g: (math.log(m / total[len(g), g[:-1]]), math.log(0.4) if len(g) < order and g[-1] not in ("</s>", None) else 0.0) for g, m in n.items()}
    got = B.ngram_table(spark.createDataFrame([*((t,) for t in ODD), (None,)], "tokens array<string>").repartition(3), order).collect()
    assert len(got) == len(want) and all(r.ord == len(r.words) for r in got)
    assert all((r.logp, r.backoff) == pytest.approx(want[tuple(r.words)]) for r in got)


def test_ngram_graph_of_a_closed_model_is_that_of_any(spark):
    table = B.ngram_table(spark.createDataFrame([([w or "" for w in t],) for t in ODD], "tokens array<string>"), 3)
    both = [Counter((r.src, r.dst, r.label, round(r.w, 9)) for r in B.ngram_graph(table, 3, closed).collect()) for closed in (True, False)]
    assert both[0] == both[1] and both[0].total() > 100


def test_ngram_graph_of_odd_turns_is_that_of_the_sql(spark, tmp_path):
    texts = [None, "", " ", "a  b ", "a a a a", "x </s> y", "<s> <s>", "a\nb c", "\u00e9 \U00020000", None, "the of the of the"]
    spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = Counter((r.src, r.dst, r.label, r.w) for r in registry.QUERIES["ngram_graph"](spark, str(tmp_path)).select("src", "dst", "label", "w").collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = Counter(con.sql(f"SELECT src, dst, label, w FROM ({registry.ORACLE_SQL['ngram_graph']})").fetchall())
    assert got == want


def test_homophones_by_hand(spark):
    alts = {chr(0x4E00 + i): [chr(0x4E00 + (i + k) % 5) for k in range(1, 1 + i % 4)] for i in range(5)}  # one character has none
    alts["\u4e01"] = ["xy", "\U00020000"]  # of other lengths
    texts = [(1 << 59, "".join(chr(0x4E00 + i * i % 6) for i in range(400)) + "a\U00020000"), (5, "\u4e01\u4e01"), (7, "\u4e03" * 300), (-3, "\u4e02b" * 70)]

    def by_hand(k, text):
        n = len(text)
        a = round(n * 0.7)
        places = sorted(range(n - 1), key=lambda i: ((k * 31 + i * 17) % 101, i))[: a + k * 7 % max(1, n - 1 - a + 1)]
        return "".join(alts[c][(k + i) % len(alts[c])] if i in places and alts.get(c) else c for i, c in enumerate(text))

    rows = spark.createDataFrame([(t, k, 1.5) for k, t in texts] + [(None, 4, 0.5), ("\u4e01\u4e02", None, 0.5)], "text string, id long, other double")
    for chars in (alts, alts | {"\u4e01": ["\u4e04"]}):
        alts = chars
        got = P.substitute_homophones(rows, spark.createDataFrame(list(alts.items()), "ch string, alts array<string>")).collect()
        assert {r.id: r.text for r in got} == {k: by_hand(k, t) for k, t in texts} | {4: None, None: "\u4e01\u4e02"} and sorted(r.other for r in got) == [0.5, 0.5, 1.5, 1.5, 1.5, 1.5]


def test_syllables_go_to_texts_by_distinct_characters(spark):
    rows = spark.createDataFrame([(None, "今天 ab 今"), (1, "好"), (2, ""), (3, None), (4, "ab  今 ")], "id long, text string")
    table = spark.createDataFrame([("今", "jin"), ("ab", "word"), ("天", None)], "ch string, syl string")
    got = E.syllable_tokens(rows, table)
    assert {r.id: r.tokens for r in got.collect()} == {None: ["jin", "UNK", "word", "jin"], 1: ["UNK"], 2: ["UNK"], 3: [], 4: ["word", "UNK", "jin"]}


def test_a_superstep_is_one_table_dealt_by_utterance(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(u, t, [-float(x) for x in rng.random(4) * 9]) for u, n in enumerate([1, 2, 4, 7, 7]) for t in range(n)], "utt long, t int, scores array<double>")
    kept, keep = [], Folder.keep

    def noted(self, frame, name, *by):
        kept.append((name, frame._jdf.queryExecution().executedPlan().toString()))
        return keep(self, frame, name, *by)

    monkeypatch.setattr(Folder, "keep", noted)
    decoder = decoding.word_decoder(spark, beam=2)
    kept.clear()
    decoder.run(df, lattice=True)
    assert len(kept) == 1 + 7  # the frames, and a table for each of seven
    assert all(line.split("hashpartitioning(")[1].startswith("utt#") and "arc#" not in line.split("hashpartitioning(")[1].split(")")[0] for _, plan in kept[1:] for line in plan.splitlines() if "hashpartitioning(" in line)
    tokens = spark.read.parquet(f"{decoder.folder.path}/tokens")  # of tokens that no result reads, those of the last superstep at most are left
    assert tokens.where("not over and not fresh and not leads and at < 6").isEmpty()
    got, want = decoder.lattice(), S.lattice_rows(S.decode(df, models.small_net(spark), 2))
    rows = lambda d: sorted((r.utt, r.start, r.stop, r.word, r.prev, round(r.am, 9), round(r.lm, 9)) for r in d.collect())
    assert rows(got) == rows(want) and len(rows(got)) > 5
    assert {r.utt: tuple(r.words) for r in decoder.best().collect()} == {r.utt: tuple(r.words) for r in S.decode(df, models.small_net(spark), 2).collect()}
