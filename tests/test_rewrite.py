import math

import pytest
from pyspark.sql import functions as F

from lattiq.operators import graph as G
from lattiq.operators import lexicon as L
from lattiq.operators import ngram as B
from lattiq.operators import rewrite as W
from lattiq.sources import text

ARCS = "src long, dst long, ilabel string, olabel string, w double"


def rows(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def finals(spark, *nodes):
    return spark.createDataFrame([(n,) for n in nodes], "node long")


def test_renumber(spark):
    arcs = spark.createDataFrame([(0, 7, 3, "a", "a", 0.0), (1, 3, 9, "b", "b", 0.0), (2, 7, 5, "c", "c", -1.0)], "pos long, " + ARCS)
    out, ends = W.renumber(arcs, finals(spark, 9, 5))
    assert rows(out) == [(0, 1, "a", "a", 0.0), (0, 2, "c", "c", -1.0), (1, 3, "b", "b", 0.0)] and rows(ends) == [(2,), (3,)]


def test_words_to_phones(spark):
    arcs = spark.createDataFrame([(0, 1, "ab", "AB", -0.5), (1, 2, "zz", "zz", 0.0)], ARCS)
    out = rows(W.words_to_phones(arcs, spark.createDataFrame([("ab", ["a", "b"])], "word string, phones array<string>")))
    assert out == [("0", "0:1:ab:a b:1", "a", "AB", -0.5), ("0:1:ab:a b:1", "1", "b", "<eps>", 0.0), ("1", "2", "zz", "zz", 0.0)]


def test_push_forward(spark):
    arcs = spark.createDataFrame([(0, 1, "a", "X", -1.0), (1, 2, "b", "<eps>", -0.5), (2, 3, "c", "<eps>", -0.25), (2, 4, "d", "<eps>", 0.0), (0, 3, "e", "Y", -2.0), (3, 4, "sil", "<eps>", -0.125)], ARCS)
    assert rows(W.push_forward(arcs, finals(spark, 4))) == [(0, 1, "a", "<eps>", 0.0), (0, 3, "e", "Y", -2.0), (1, 2, "b", "<eps>", 0.0), (2, 3, "c", "X", -1.75), (2, 4, "d", "X", -1.5), (3, 4, "sil", "<eps>", -0.125)]


def test_partial_expansion(spark):
    branch = lambda at, end: [(0, at, "x", "W", 0.0), (at, at + 1, "p", "<eps>", -0.5), (at + 1, at + 2, "q", "<eps>", -0.25), (at + 2, end, "r", "R", 0.0)]
    arcs = spark.createDataFrame(branch(10, 99) + branch(20, 99) + [(0, 30, "s", "<eps>", 0.0), (30, 99, "t", "<eps>", 0.0)], ARCS)
    out, entries = W.expand_partly(arcs, finals(spark, 99), 5.0)
    assert rows(entries) == [(0, "p q")]
    assert rows(out) == sorted([(0, 10, "x", "W", 0.0), (10, 12, "D=0", "<eps>", -0.75), (12, 99, "r", "R", 0.0), (0, 20, "x", "W", 0.0), (20, 22, "D=0", "<eps>", -0.75), (22, 99, "r", "R", 0.0), (0, 30, "s", "<eps>", 0.0), (30, 99, "t", "<eps>", 0.0)])
    found = spark.createDataFrame([("p q",), ("p q",), ("s t",)], "phones string")
    assert rows(W.repeated_chains(found, 0.0)) == [] and rows(W.repeated_chains(found, 5.0)) == [(0, "p q", 2)]


def test_ngram_graph_scores_sentences_as_the_model(spark):
    lines = [["a", "b"], ["a", "b", "a"], ["b"]]
    table = B.ngram_table(spark.createDataFrame([(t,) for t in lines], "tokens array<string>"), 3)
    model = {tuple(r.words): (r.logp, r.backoff) for r in table.collect()}
    arcs = {}
    for r in B.ngram_graph(table, 3).collect():
        arcs.setdefault(r.src, []).append((r.dst, r.label, r.w))

    def walk(state, word):
        """The best way to read one word: fall back until an arc has it."""
        found = [(w, dst) for dst, label, w in arcs.get(state, []) if label == word]
        return max(found) if found else max(((w + v, d) for dst, label, w in arcs.get(state, []) if label == "<F>" for v, d in [walk(dst, word)]), default=(-math.inf, ""))

    def expected(history, word):
        for k in range(min(2, len(history)), -1, -1):
            h = tuple(history[len(history) - k:])
            if h + (word,) in model:
                return model[h + (word,)][0] + sum(model.get(tuple(history[len(history) - j:]), (0, 0))[1] for j in range(k + 1, min(2, len(history)) + 1))
        raise AssertionError

    for words in (["a", "b"], ["a", "b", "a"], ["b", "b", "a"], ["a", "a"]):
        state, history = "<s>", ["<s>"]
        for word in words:
            w, state = walk(state, word)
            assert abs(w - expected(history, word)) < 1e-9, (words, word)
            history.append(word)


def test_pronunciations_and_models(spark):
    words = spark.createDataFrame([("w", ["x", "y", "z"])], "word string, syls array<string>")
    table = spark.createDataFrame([("x", "x", 0.6), ("x", "k", 0.3), ("x", "n", 0.1), ("y", "y", 0.5), ("y", "j", 0.5)], "ref string, hyp string, ratio double")
    assert sorted(r.phones for r in L.pronunciations(words, table).collect()) == [["k", "j", "z"], ["k", "y", "z"], ["x", "j", "z"], ["x", "y", "z"]]
    models = spark.createDataFrame([("b", [1, 2]), ("a", [3])], "model string, states array<int>")
    syls = spark.createDataFrame([("ba", "b", "a"), ("a", None, "a")], "syl string, initial string, final string")
    assert rows(L.compose_models(syls, models)) == [("a", [3]), ("ba", [1, 2, 3])]
    with pytest.raises(Exception, match="no such model"):
        L.compose_models(spark.createDataFrame([("ca", "c", "a")], "syl string, initial string, final string"), models).collect()


def test_line_writers(spark, tmp_path):
    r = spark.createDataFrame([("1", ["sil", "a", "b"], -2.5), ("2", None, 0.0)], "id string, words array<string>, score double")
    text.write_lines(text.decode_lines(r), str(tmp_path / "out"))
    assert sorted(x.value for x in spark.read.text(str(tmp_path / "out")).collect()) == ["NULL\t(2)\t0.000000", "a b\t(1)\t-2.500000"]
    assert text.dot_lines(spark.createDataFrame([(0, 1, "a", "B", 0.0)], ARCS)).where("place = 3").first().value == '0->1 [label="a:B"];'
    got = spark.createDataFrame([([1, 2, 3],), ([],)], "x array<int>").select(text.vector_text(F.col("x"), 2)).collect()
    assert [g[0] for g in got] == ["1,2,\n3", ""]
    assert text.scoring_lines(spark.createDataFrame([("a b c", "7")], "text string, id string")).first()[0] == "abc\t(7)"


TINY = [(0, 1, "a", "A", -0.5), (1, 2, "<eps>", "<eps>", -0.2), (1, 3, "b", "B", 0.0), (2, 3, "c", "C", -0.1), (0, 4, "a", "A", -0.5), (4, 3, "d", "D", 0.0)]


def language(df, ends, start="0"):
    """The label sequences of an acyclic graph with their weights."""
    out, last = {}, {str(r.node) for r in ends.collect()}
    for r in df.collect():
        out.setdefault(str(r.src), []).append((str(r.dst), r.ilabel, r.w))
    found = set()

    def go(node, labels, w):
        if node in last:
            found.add((labels, round(w, 9)))
        for dst, label, v in out.get(node, []):
            go(dst, (*labels, label), w + v)

    go(start, (), 0.0)
    return found


def test_factor_and_tails_keep_the_language(spark):
    arcs, ends = spark.createDataFrame(TINY, ARCS), finals(spark, 3)
    want = language(arcs, ends)
    out, last = G.factor(arcs, ends)
    assert language(out, last) == want and out.count() == 5
    more = spark.createDataFrame([(0, 1, "a", "a", 0.0), (1, 2, "z", "z", 0.0), (0, 3, "b", "b", 0.0), (3, 2, "z", "z", 0.0), (0, 4, "c", "c", 0.0), (4, 5, "y", "y", 0.0)], ARCS)
    out, last = G.merge_tails(more, finals(spark, 2, 5))
    labels = lambda found: {(tuple(x for x in p if x != "<eps>"), w) for p, w in found}
    assert labels(language(out, last)) == labels(language(more, finals(spark, 2, 5))) and out.where("ilabel = 'z'").count() == 1


def test_contexts_agree_along_paths(spark):
    arcs, ends = spark.createDataFrame(TINY, ARCS), finals(spark, 3)
    out, last, symbols = G.expand_contexts(arcs, ends)
    for labels, _ in language(out, last):
        parts = [x.replace("+", "-").split("-") for x in labels]
        assert all(a[2] == b[1] and a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False)) and parts[0][0] == "<eps>" and parts[-1][2] == "<eps>"
    assert {tuple(x.split("-")[1].split("+")[0] for x in labels) for labels, _ in language(out, last)} == {labels for labels, _ in language(arcs, ends)}
    assert symbols.count() == out.select("ilabel").distinct().count()


def test_push_to_head_keeps_path_weights(spark):
    arcs = spark.createDataFrame([(0, 1, "a", "<eps>", 0.0), (1, 2, "b", "<eps>", 0.0), (2, 3, "c", "X", -1.0), (2, 4, "d", "Y", -0.25), (0, 5, "e", "Z", -2.0)], ARCS)
    out = W.push_to_head(arcs, finals(spark, 3, 4, 5))
    assert rows(out) == [(0, 1, "a", "<eps>", -0.25), (0, 5, "e", "Z", -2.0), (1, 2, "b", "<eps>", 0.0), (2, 3, "c", "X", -0.75), (2, 4, "d", "Y", 0.0)]
    with pytest.raises(ValueError, match="weight"):
        W.push_to_head(spark.createDataFrame([(0, 1, "a", "X", 0.0)], ARCS), finals(spark, 1))


def test_reverse_with_several_finals(spark):
    arcs, ends = spark.createDataFrame(TINY, ARCS), finals(spark, 2, 3)
    out, last = G.reverse_graph(arcs, ends)
    back = {(tuple(x for x in reversed(p) if x != "<eps>"), w) for p, w in language(out, last)}
    assert back == {(tuple(x for x in p if x != "<eps>"), w) for p, w in language(arcs, ends)}


def test_physical_labels(spark):
    table = spark.createDataFrame([("a-b+c", "p1"), ("a-b", "p2"), ("b+d", "p3"), ("sil-b+c", "p4"), ("a-b+sil", "p5")], "logical string, physical string")
    labels = ["a-b+c", "a-b+x", "y-b+d", "<eps>-b+c", "a-b+<eps>", "x-sil+y", "<F>", "<eps>", "q-b+z", "<eps>-b+d"]
    got = {r.label: r.physical for r in L.to_physical(spark.createDataFrame([(x,) for x in labels], "label string"), table).collect()}
    assert [got[x] for x in labels] == ["p1", "p2", "p3", "p4", "p5", "sil", "<eps>", "<eps>", "<none>", "<none>"]
