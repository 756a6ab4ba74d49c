"""Forward pass, decoding over tables, built graphs, alignment in little space, fixed-point scores."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattiq.operators import align, build, decode, graph, network, nn, search
from lattiq.plans import decoding, models


def layers(rng):
    w = lambda *s: rng.normal(size=s)
    L = network.Layer
    return [L("AFFINE_TRANSFORM", 9, 8, w(72), w(8), []), L("RELU", 8, 8, None, None, []), L("PNORM", 8, 4, None, None, []), L("SOFTMAX", 4, 4, None, None, []), L("SUMGROUP", 4, 3, None, None, [1, 2, 1])]


@pytest.mark.parametrize("span,every", [(4096, 1), (5, 1), (4, 2), (6, 3)])
def test_forward_in_spans(spark, span, every):
    rng = np.random.default_rng(2)
    net = network.Network(3, 3, layers(rng), 1 / np.array([0.2, 0.3, 0.5]))
    network.check(net)
    rows, want = [], {}
    for name, n in (("a", 17), ("b", 1), ("c", 4), ("d", 5)):
        x = rng.normal(size=(n, 3))
        rows += [(name, t, v.tolist()) for t, v in enumerate(x)]
        wide = np.concatenate([x, x[-1:], x[-1:]])
        for t in range(n):
            lead = t if t == 0 else t - (t - 1) % every
            y = wide[lead : lead + 3].reshape(1, -1)
            w, b = net.layers[0].values.reshape(8, 9), net.layers[0].bias
            y = np.maximum(y @ w.T + b, 0)
            y = np.sqrt((y.reshape(4, 2) ** 2).sum(axis=1))
            y = np.exp(y) / np.exp(y).sum()
            y = np.array([y[0], y[1] + y[2], y[3]]) / np.array([0.2, 0.3, 0.5])
            want[name, t] = np.log(y / y.sum())
    df = spark.createDataFrame(rows, "utt string, t int, x array<double>").repartition(5)
    got = {(r.utt, r.t): r.scores for r in network.forward(df, net, span=span, every=every).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_networks_that_do_not_fit(spark):
    good = layers(np.random.default_rng(1))
    for k, wrong in ((0, network.Layer("AFFINE_TRANSFORM", 9, 8, np.zeros(71), np.zeros(8), [])), (1, network.Layer("RELU", 7, 7, None, None, [])), (2, network.Layer("PNORM", 8, 3, None, None, [])), (4, network.Layer("SUMGROUP", 4, 3, None, None, [2, 2, 1])), (3, network.Layer("MAXOUT", 4, 4, None, None, []))):
        with pytest.raises(ValueError):
            network.check(network.Network(3, 3, [*good[:k], wrong, *good[k + 1 :]], None))
    with pytest.raises(ValueError):
        network.check(network.Network(3, 3, good, np.ones(4)))
    gap = spark.createDataFrame([("a", 0, [1.0, 2.0, 3.0]), ("a", 2, [1.0, 2.0, 3.0])], "utt string, t int, x array<double>")
    with pytest.raises(Exception, match="gaps"):
        network.forward(gap, network.Network(3, 3, good, None)).collect()


def test_wide_layers_take_linear_time(spark):
    """The sum of a layer is bound once: a width of 20,000 ends at once."""
    wide = spark.range(4).select(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: i / 20_000).alias("x"))
    got = wide.select(nn.softmax(F.col("x")).alias("s"), nn.rms_normalise(F.col("x")).alias("r"), nn.log_posterior(F.col("x"), F.col("x")).alias("p")).select(nn.total(F.col("s")).alias("s"), F.element_at("r", -1).alias("r"), F.col("p")[0].alias("p")).first()
    assert abs(got.s - 1) < 1e-9 and got.r == 1.0 and abs(got.p + np.log(20_000)) < 1e-9


def frames(rng, n):
    return [[-rng.random() * 9 for _ in range(4)] for _ in range(n)]


def all_paths(scores):
    """The best score of every word sequence, by trying all ways through the net of ``decoding.WORD_ARCS``."""
    arcs = [(0, 1, [(0, -0.5, None), (1, -0.5, -1.0)], "low", -0.5), (0, 1, [(2, -0.25, None)], "high", -0.75), (0, 2, [(3, -0.1, None)], None, -0.25), (2, 1, [(0, -0.5, None), (1, -0.5, -1.0)], "low", -0.125)]
    best = {}

    def go(t, k, state, score, words):
        _, dst, states, _, _ = arcs[k]
        tied, own, _ = states[state]
        score += scores[t][tied]
        if t + 1 == len(scores):
            if state + 1 == len(states) and dst == 1:
                best[words] = max(best.get(words, -1e9), score)
            return
        go(t + 1, k, state, score + own, words)
        if state + 1 < len(states):
            go(t + 1, k, state + 1, score + states[state + 1][2], words)
        else:
            enter(t + 1, dst, score, words)

    def enter(t, node, score, words):
        for k, (src, _, _, word, w) in enumerate(arcs):
            if src == node:
                go(t, k, 0, score + w, (*words, word) if word else words)
        if node == 1:
            enter(t, 0, score - 0.0625, words)

    enter(0, 0, 0.0, ())
    return best


def test_words_against_all_paths(spark):
    rng = random.Random(6)
    given = {u: frames(rng, n) for u, n in enumerate([1, 2, 3, 5, 6, 6])}
    df = spark.createDataFrame([(u, t, s) for u, x in given.items() for t, s in enumerate(x)], "utt long, t int, scores array<double>")
    decoder = decoding.word_decoder(spark)
    decoder.run(df, lattice=True)
    got = {r.utt: (tuple(r.words), round(r.score, 9), r.at_final) for r in decoder.best().collect()}
    for u, x in given.items():
        words, score = max(all_paths(x).items(), key=lambda p: p[1])
        assert got[u] == (words, round(score, 9), True)
    # the same net with its entry written out, in one task
    one = {r.utt: (tuple(r.words), round(r.score, 9), r.at_final) for r in search.decode(df, models.small_net(spark), 3000).collect()}
    assert one == got
    rows = lambda d: sorted((r.utt, r.start, r.stop, r.word, r.prev, round(r.am, 9), round(r.lm, 9)) for r in d.collect())
    assert rows(decoder.lattice()) == rows(search.lattice_rows(search.decode(df, models.small_net(spark), 3000)))
    # a word of the lattice's last row is the last word decoded
    ends = {r.utt: r.word for r in decoder.lattice().collect() if r.stop == len(given[r.utt])}
    assert all(ends[u] == got[u][0][-1] for u in ends)


def test_beams_dead_utterances_and_pointers_for_every_arc(spark):
    rng = random.Random(7)
    df = spark.createDataFrame([(u, t, s) for u in range(3) for t, s in enumerate(frames(rng, 4))], "utt long, t int, scores array<double>")
    plain, every = decoding.word_decoder(spark, beam=2), decoding.word_decoder(spark, beam=2, framewise=True)
    plain.run(df)
    every.run(df)
    assert sorted(plain.best().collect()) == sorted(every.best().collect())
    assert every._table("back").count() >= plain._table("back").count()
    none = decoding.word_decoder(spark)
    none.run(df.limit(0))
    assert none.best().collect() == []
    with pytest.raises(Exception, match="no such model"):
        arcs = spark.createDataFrame([(0, 1, "what", "w", 0.0)], "src long, dst long, ilabel string, olabel string, w double")
        models = spark.createDataFrame([("la", [0], [0.0], [0.0])], "model string, states array<int>, own array<double>, move array<double>")
        decode.Decoder(arcs, spark.createDataFrame([(1,)], "node long"), graph.closure(arcs), models)


# ---- graphs ------------------------------------------------------------------------------


def sentences(spark):
    return spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b", "c"]), (3, ["a", "c"]), (4, ["b"]), (5, ["a", "b"])], "id long, tokens array<string>")


LEXICON = [("a", ["x", "y"]), ("b", ["x"]), ("b", ["z", "z"]), ("c", ["y"])]


def accepted(built, **more):
    return sorted((r.words, r.inputs) for r in build.sentences_of(built["arcs"], built["finals"], built["dictionary"]).collect())


SAID = {w: [" ".join(p) for v, p in LEXICON if v == w] for w in "abc"}
ACCEPTED = sorted({(" ".join(s), " ".join(p)) for s in (["a", "b"], ["a", "b", "c"], ["a", "c"], ["b"]) for p in itertools.product(*(SAID[w] for w in s))})


def test_a_built_graph_accepts_its_sentences(spark, tmp_path):
    """With labels in context, silence that may be passed by, and chains as dictionary entries."""
    lexicon = spark.createDataFrame(LEXICON, "word string, phones array<string>")
    phones = ["x", "y", "z", "sil"]
    physical = spark.createDataFrame([(f"{a}-{b}+{c}", f"#{b}") for a in phones for b in "xyz" for c in phones], "logical string, physical string")
    built, _ = build.decoding_graph(spark, str(tmp_path / "b"), sentences(spark), lexicon, physical, silence="sil", ratio=2)
    marked = [(w, " ".join("#" + p for p in i.split(" "))) for w, i in ACCEPTED]
    assert accepted(built) == sorted(marked + [(w, "sil " + i) for w, i in marked])
    arcs = spark.createDataFrame([(0, 1, "x-y+z", "w", 0.0)], "src long, dst long, ilabel string, olabel string, w double")
    with pytest.raises(Exception, match="no model for"):
        build.in_models({"arcs": arcs, "finals": None}, physical.where("logical like 'z%'"))["arcs"].collect()


def test_a_build_goes_on_where_it_stopped(spark, tmp_path):
    lexicon = spark.createDataFrame(LEXICON, "word string, phones array<string>")
    at = str(tmp_path / "b")
    _, first = build.decoding_graph(spark, at, sentences(spark), lexicon, steps=2)
    assert first.ran == ["words", "words-shared"]
    broken = lexicon.withColumn("phones", F.when(F.col("word") == "c", F.raise_error(F.lit("lost")).cast("array<string>")).otherwise(F.col("phones")))
    with pytest.raises(Exception, match="lost"):
        build.decoding_graph(spark, at, sentences(spark), broken)
    built, again = build.decoding_graph(spark, at, sentences(spark), lexicon)
    assert again.ran == ["phones", "phones-shared", "ready"] and accepted(built) == ACCEPTED
    assert [r.step for r in again.sizes().where("name = 'arcs'").orderBy("place").collect()] == ["words", "words-shared", "phones", "phones-shared", "ready"]
    _, other = build.decoding_graph(spark, at, sentences(spark), lexicon, mode=1, steps=1)
    assert other.ran == ["words"]  # other options share nothing


def test_trees_are_factored_as_other_graphs_are(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.choice("ab") for _ in range(rng.randrange(1, 5))]) for i in range(40)]
    arcs, finals = graph.context_graph(spark.createDataFrame(rows, "id long, tokens array<string>"))
    fast = graph.factor(arcs, finals)
    monkeypatch.setattr(graph, "arc_tree", lambda *a: None)
    slow = graph.factor(arcs, finals)
    shape = lambda g: (g[0].count(), g[1].count(), sorted(map(tuple, graph.degrees(g[0]).groupBy("in_degree", "out_degree").count().collect())))
    assert shape(fast) == shape(slow)


def test_long_eps_paths(spark):
    chain = [(i, i + 1, "<eps>", "<eps>", -1.0) for i in range(20)] + [(20, 21, "a", "a", 0.0), (3, 21, "b", "b", 0.0)]
    arcs = spark.createDataFrame(chain, "src long, dst long, ilabel string, olabel string, w double")
    got = sorted((r.node, r.stop, r.w, r.depth, tuple(r.path)) for r in graph.closure(graph.branches(arcs)).collect())
    want = [(i, j, float(i - j), j - i, tuple(0 for _ in range(i, j))) for i in range(20) for j in (3, 20) if j > i]
    assert got == sorted(want)
    with pytest.raises(ValueError, match="more than 12"):
        graph.closure(arcs, longest=12)
    with pytest.raises(ValueError, match="circle"):
        graph.closure(spark.createDataFrame([*chain, (5, 2, "<eps>", "<eps>", 0.0)], arcs.schema))


# ---- alignment, fixed point --------------------------------------------------------------


def test_long_paths_are_those_of_the_whole_table(monkeypatch):
    rng = random.Random(5)
    for _ in range(150):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 25))] for _ in range(2))
        cost = rng.choice([(1, 1, 1), (1, 1, 2), (3, 2, 4)])
        monkeypatch.setattr(align, "PARTS", rng.choice([2, 3, 32]))
        assert align.long_path(a, b, cost, rng.choice([8, 60, 10**6])) == align.table_paths([a], [b], cost)[0]
    monkeypatch.setattr(align, "CELLS", 100)
    pairs = [("abc" * 9, "acb" * 9), ("", "ab"), ("ab", "ab")]
    assert align.paths([list(a) for a, _ in pairs], [list(b) for _, b in pairs]) == [align.align_tokens(list(a), list(b)) for a, b in pairs]


def test_steps_of_paths(spark):
    rows = [(["a", "b"], ["a", "c", "d"], "MIS"), ([], ["x"], "I"), (["x"], [], "D"), (["q"], ["q"], ""), (["q"], ["q"], None)]
    got = [[tuple(s) for s in r.p] for r in spark.createDataFrame(rows, "r array<string>, h array<string>, path string").coalesce(1).select(align.aligned_pairs(F.col("r"), F.col("h"), F.col("path")).alias("p")).collect()]
    assert got == [[(1, "M", "a", "a"), (2, "I", None, "c"), (3, "S", "b", "d")], [(1, "I", None, "x")], [(1, "D", "x", None)], [], []]


def test_fixed_point_bounds(spark):
    mixtures = F.array(F.struct(F.array(F.lit(10), F.lit(-7)).alias("mu"), F.array(F.lit(300_000), F.lit(200_000)).alias("iv"), F.lit(99).alias("g")), F.struct(F.array(F.lit(0), F.lit(0)).alias("mu"), F.array(F.lit(1), F.lit(1)).alias("iv"), F.lit(2**30).alias("g")))
    term = lambda d, v: (((d * v) >> 17) * d) >> 1
    want = -((((term(-45, 300_000) + term(19, 200_000)) >> 2) + 99) >> 1)
    one = spark.range(1).select(F.array(F.lit(-35), F.lit(12)).alias("x"))
    assert one.select(nn.fixed_mixture(F.col("x"), mixtures).alias("s")).first().s == want
    with pytest.raises(Exception, match="no 32-bit number"):
        one.select(nn.fixed_mixture(F.transform("x", lambda v: v * 1000), mixtures)).collect()
