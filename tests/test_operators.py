import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattiq.functions import text as X
from lattiq.operators import evaluate as E
from lattiq.operators import frames as R
from lattiq.operators import graph as G
from lattiq.operators import lexicon as L
from lattiq.operators import search as S
from lattiq.operators import perturb as P
from lattiq.operators.align import align, align_tokens, paths
from lattiq.sources import macro
from lattiq.sources import binary, text


def scores(spark, rows):
    return E.score(spark.createDataFrame(rows, "id string, ref array<string>, hyp array<string>"))


def test_golden_example(spark):
    r = scores(spark, [("001", list("今天天氣很好"), list("今天天色很差"))])
    x = r.first()
    assert (x.distance, x.C, x.M, x.D, x.I, x.S, x.path, x["corr"], x.acc) == (2, 6, 4, 0, 0, 2, "MMMSMS", 66.67, 66.67)
    assert [(p.op, p.ref_token, p.hyp_token) for p in E.pair_rows(r).collect()][3] == ("S", "氣", "色")
    assert E.summary(r).first().sentence_acc == 0.0


def test_alignment_edges_and_random(spark):
    rng = random.Random(3)
    rows = [("e", [], []), ("d", ["a"], []), ("i", [], ["a", "b"]), ("t", ["a", "b"], ["b", "a"])]
    rows += [(str(k), [rng.choice("abc") for _ in range(rng.randrange(9))], [rng.choice("abc") for _ in range(rng.randrange(9))]) for k in range(60)]
    got = {r.id: r for r in scores(spark, rows).collect()}
    folded = {r.id: r.path for r in spark.createDataFrame(rows, "id string, ref array<string>, hyp array<string>").select("id", align(F.col("ref"), F.col("hyp"))["path"].alias("path")).collect()}
    for key, ref, hyp in rows:
        r = got[key]
        assert r.path == align_tokens(ref, hyp) == folded[key]
        assert r.M + r.D + r.S == len(ref) and r.M + r.I + r.S == len(hyp) and r.D + r.I + r.S == r.distance
    assert got["e"]["corr"] == 0 and got["i"]["acc"] == 0


def test_long_pairs():
    rng = random.Random(4)
    ref = [rng.choice("abcd") for _ in range(700)]
    hyp = [x for x in ref if rng.random() > 0.1] + ["z"]
    assert paths([ref, [], ref[:5]], [hyp, ["a"], []]) == [align_tokens(ref, hyp), "I", "DDDDD"]


GOLDEN = """FILE: 001
REF: 今 天 天 氣 很 好
HYP: 今 天 天 色 很 差
Edit_Distance: 2
Utterance:      Corr:66.67 Acc:66.67    C:6 M:4 D:0 I:0 S:2
MCH: 今 -> 今
MCH: 天 -> 天
MCH: 天 -> 天
SUB: 氣 -> 色
MCH: 很 -> 很
SUB: 好 -> 差


#### Summary of 1 sentences
Sentence Accuracy: 0.00 (0/1)
Character-level:        Corr:66.67 Acc:66.67    C:6 M:4 D:0 I:0 S:2
"""


def test_golden_report(spark):
    refs = spark.createDataFrame([("001", "今天天氣很好"), ("002", "x")], "id string, text string")
    hyps = spark.createDataFrame([("001", "今天天色很差", 1), ("001", "今", 2), ("9", "x", 1)], "id string, text string, rank int")
    lines = "\n".join(r.value for r in E.whole_report(E.evaluate(refs, hyps)).collect()) + "\n"
    assert lines.expandtabs(8) == GOLDEN


def test_padding_and_end_lines(spark):
    r = E.report(scores(spark, [("1", ["ab", "今", "x"], ["abcd", "y"])])).first().block.split("\n")
    assert r[1:3] == ["REF:   ab 今 x", "HYP: abcd  y  "] or len(r[1]) == len(r[2]) + 1
    assert {x.split(":")[0] for x in r[5:8]} == {"SUB", "DEL"} and any(x.endswith(" ->") for x in r[5:8])


def test_comparison_table(spark, tmp_path):
    answers = spark.createDataFrame([(1, "821190000000001", "7", "今天"), (2, "821190000000002", "8", "好")], "no int, file_name string, num string, text string")
    result = E.result_rows(spark.createDataFrame([("今 天 (spk_821190000000001_7.wav) -3",), ("junk",)], "value string"))
    table = E.comparison(answers, result)
    assert table.columns == E.RESULT_COLUMNS and [tuple(r)[3:6] for r in table.orderBy("no").collect()] == [("今天", "今天", ""), ("好", "", "")]
    E.write_comparison(table, str(tmp_path / "t"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).count() == 2


def test_homophones_and_cuts(spark):
    table = P.homophones(spark.createDataFrame([("今", "jin"), ("金", "jin"), ("斤", "jin"), ("天", "tian")], "ch string, sound string"), spark.createDataFrame([("金",), ("今",)], "ch string"))
    assert {r.ch: r.alts for r in table.collect()} == {"今": ["金"], "斤": ["今", "金"], "金": ["今"]}
    got = {r.id: r.text for r in P.substitute_homophones(spark.createDataFrame([(1, "今a天今斤"), (2, ""), (3, "今")], "id long, text string"), table).collect()}
    assert got[2] == "" and got[3] == "今" and got[1][1:3] == "a天" and got[1][4] == "斤" and got[1] != "今a天今斤"
    cut = P.cuts(spark.createDataFrame([(1, list(range(40)))], "id long, x array<int>"), "x", "id", (5, 30), 2).collect()
    assert [(r.width, len(r.x)) for r in cut] == [(5, 30), (5, 30)]


def test_models(spark):
    rows = [("m", "t", ["s"])]
    ids = spark.createDataFrame([("s", 4)], "state string, id int"), spark.createDataFrame([("t", 2)], "matrix string, id int")
    assert tuple(L.tied_models(spark.createDataFrame(rows, "model string, matrix string, names array<string>"), *ids).first()) == ("m", [4], 2)
    with pytest.raises(Exception, match="two models"):
        L.unique_models(spark.createDataFrame([("a",), ("a",)], "model string"), "model").collect()
    with pytest.raises(Exception, match="out of range"):
        spark.createDataFrame([(9.0,)], "x double").select(X.checked_quantise(F.col("x"), 4096.0)).collect()
    with pytest.raises(ValueError):
        X.decode_options(300_001, 1.0)
    text_ = '~m "x"\n<MEAN> 1\n2\n<VARIANCE> 1\n0.5\n~h "a"\n<BEGINHMM>\n<NUMSTATES> 3\n<STATE> 2\n<NUMMIXES> 2\n<MIXTURE> 1 0.25\n~m "x"\n<MIXTURE> 2 0.75\n<MEAN> 1\n0\n<VARIANCE> 1\n1\n<TRANSP> 3\n0 1 0 0 .5 .5 0 0 0\n<ENDHMM>\n~h "b"\n<BEGINHMM>\n<NUMSTATES> 3\n<STATE> 2\n<MEAN> 1\n1\n<VARIANCE> 1\n2\n~t "a.t"\n<ENDHMM>'
    models, states, matrices = macro.tied(macro.parse_definitions(spark.createDataFrame([("f", bytearray(text_.encode()))], "path string, content binary")))
    assert sorted(map(tuple, models.collect())) == [("a", [0], 0), ("b", [1], 0)]
    assert [len(r.mixtures) for r in states.orderBy("id").collect()] == [2, 1] and matrices.first().logs[5] == np.log(0.5)


def test_token_passing_against_all_paths(spark):
    from lattiq.plans import models as M

    rng = np.random.default_rng(1)
    emit = rng.normal(size=(6, 4)).round(3)
    frames = spark.createDataFrame([("u", t, emit[t].tolist()) for t in range(6)], "utt string, t int, scores array<double>")
    net = M.small_net(spark, 2.0)
    # every path, state by state: (arc, place in its states)
    chain = {"lo": [(0, -0.5, 0.0), (1, -0.5, -1.0)], "hi": [(2, -0.25, 0.0)], "sil": [(3, -0.1, 0.0)]}
    arcs = [a for a in M.NET_ARCS if a[2] != "<eps>"]
    best = (-np.inf, None)

    def go(t, arc, at, score, words):
        nonlocal best
        s, own, _ = chain[arc[2]][at]
        score += emit[t, s]
        end = at == len(chain[arc[2]]) - 1
        if t == 5:
            if end and arc[1] == 1:
                best = max(best, (score, words))
            return
        go(t + 1, arc, at, score + own, words)
        if not end:
            go(t + 1, arc, at + 1, score + chain[arc[2]][at + 1][2], words)
        else:
            for b in arcs:
                extra = 0.0 if b[0] == arc[1] else -0.0625 if (arc[1], b[0]) == (1, 0) else None
                if extra is not None:
                    go(t + 1, b, 0, score + 2.0 * (b[4] + extra), words + ([b[3]] if b[3] != "<eps>" else []))

    for b in arcs:
        if b[0] == 0:
            go(0, b, 0, 2.0 * b[4], [b[3]] if b[3] != "<eps>" else [])
    got = S.decode(frames, net).first()
    assert abs(got.score - best[0]) < 1e-9 and got.words == best[1] and got.at_final
    rows = S.lattice_rows(S.decode(frames, net)).collect()
    assert rows and all(r.start < r.stop and r.word in ("low", "high") for r in rows)


def test_empty_summary_is_null(spark):
    assert E.summary(scores(spark, [])).first()["corr"] is None


def test_references_and_hypotheses(spark):
    lines = spark.createDataFrame([(0, "a", "(1)"), (1, "b", "1"), (2, "NULL", "2")], "line_no long, text string, id string")
    assert [(r.id, r.text) for r in E.references(lines).orderBy("id").collect()] == [("1", "b"), ("2", "NULL")]
    hyps = E.hypotheses(spark.createDataFrame([(0, "x  y", "(1)\t-3"), (1, "NULL", "1"), (2, "z", "1")], "line_no long, text string, id string"))
    assert [(r.id, r.text, r.rank) for r in hyps.orderBy("rank").collect()] == [("1", "x y", 1), ("1", "z", 2)]


def test_text_functions(spark):
    df = spark.createDataFrame([("ab今 x  ",)], "t string")
    r = df.select(X.words(F.col("t")).alias("w"), X.characters(F.col("t")).alias("c"), X.syllables(F.col("t"), F.create_map(F.lit("今"), F.lit("jin"))).alias("s")).first()
    assert r.w == ["ab今", "x"] and r.c == ["a", "b", "今", "x"] and r.s == ["UNK", "UNK", "jin", "UNK"]


def test_graph_reverse_twice_and_offsets(spark):
    arcs, finals = G.context_graph(spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a"]), (3, ["d", "e"])], "id long, tokens array<string>"))
    final = finals.first()[0]
    rows = sorted(map(tuple, arcs.collect()))
    assert sorted(map(tuple, G.reverse(G.reverse(arcs, final), final).collect())) == rows
    assert G.offsets(arcs).agg(F.sum("n_arcs")).first()[0] == len(rows)
    assert [(r[0], r[1]) for r in rows if r[2] == "a"] == [(0, 1), (0, final)]


def test_modes_of_context_graph(spark):
    s = spark.createDataFrame([(1, ["a"]), (2, ["b", "c"])], "id long, tokens array<string>")
    labels = lambda m: sorted(r.ilabel for r in G.context_graph(s, m)[0].collect())
    assert labels(1) == ["a", "b", "c", "sil", "sil"] and labels(2) == ["@0", "@1", "a", "b", "c"]


def test_closure(spark):
    kind = "src long, dst long, ilabel string, w double"
    arcs = spark.createDataFrame([(0, 1, "a", -0.5), (1, 2, "<eps>", -0.2), (1, 3, "b", 0.0), (2, 3, "c", -0.1)], kind)
    assert [tuple(r)[:4] for r in G.closure(arcs).collect()] == [(1, 2, -0.2, 1)]
    assert G.closure(arcs, spark.createDataFrame([(2,)], "node long")).count() == 0
    with pytest.raises(ValueError, match="circle"):
        G.closure(arcs.unionByName(spark.createDataFrame([(2, 1, "<eps>", 0.0)], kind)), depth=4)


def test_lookup_fails_on_missing(spark):
    table = L.symbols(spark.createDataFrame([("b",), ("a",), ("a",)], "sym string"))
    assert sorted(map(tuple, table.collect())) == [("<eps>", 0), ("a", 1), ("b", 2)]
    with pytest.raises(Exception, match="no such symbol"):
        L.lookup(spark.createDataFrame([("z",)], "label string"), "label", table).collect()


def test_arma(spark):
    for n in (3, 4, 5, 6, 9, 40):
        x = [float((i * 7) % 11) for i in range(n)]
        y = list(x)
        for t in range(2, n - 2):
            y[t] = (y[t - 2] + y[t - 1] + x[t] + x[t + 1] + x[t + 2]) / 5
        got = spark.createDataFrame([(x,)], "x array<double>").select(R.arma(F.col("x"), 2)).first()[0]
        assert np.allclose(got, y if n > 4 else x)


def test_viterbi_against_all_paths(spark):
    import itertools

    rng = np.random.default_rng(0)
    emit, trans, start = rng.normal(size=(5, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
    rows = [("u", t, emit[t].tolist()) for t in range(5)]
    got = S.viterbi(spark.createDataFrame(rows, "u string, t int, e array<double>"), "u", "t", "e", trans.tolist(), start.tolist()).first()
    total = lambda p: start[p[0]] + emit[0, p[0]] + sum(trans[a, b] + emit[t + 1, b] for t, (a, b) in enumerate(zip(p, p[1:], strict=False)))
    best = max(itertools.product((0, 1), repeat=5), key=total)
    assert got.path == "".join(map(str, best)) and abs(got.score - total(best)) < 1e-9


def test_readers(spark, tmp_path):
    (tmp_path / "g.txt").write_text("0 1 a A -0.5\n1 2 b\n2\n")
    arcs, finals = text.arcs(spark, str(tmp_path / "g.txt"))
    rows = sorted(map(tuple, arcs.collect()))
    assert rows[0][:4] == (0, 1, "a", "A") and abs(rows[0][4] + 0.5 * np.log(10)) < 1e-12 and rows[1] == (1, 2, "b", "b", 0.0)
    assert finals.first()[0] == 2 and "0\t1\ta\tA" in text.arc_lines(arcs, finals).orderBy("value").first()[0]
    (tmp_path / "lm.arpa").write_text("\\data\\\nngram 1=2\n\n\\1-grams:\n-1.0 a -0.3\n-2.0 b\n\n\\2-grams:\n-0.5 a b\n\n\\end\\\n")
    got = {(r.ord, " ".join(r.words)): (r.logp, r.backoff) for r in text.ngrams(spark, str(tmp_path / "lm.arpa")).collect()}
    assert set(got) == {(1, "a"), (1, "b"), (2, "a b")} and abs(got[1, "a"][1] + 0.3 * np.log(10)) < 1e-12 and got[1, "b"][1] == 0
    x = np.arange(6, dtype=np.float32).reshape(3, 2)
    (tmp_path / "f.mfc").write_bytes(binary.feature_bytes(x))
    assert [r.x for r in binary.features(spark, str(tmp_path / "f.mfc")).orderBy("t").collect()] == x.tolist()
    (tmp_path / "t.txt").write_text("f1 hello\nf2 a b\n")
    with pytest.raises(Exception, match="two tokens"):
        text.transcripts(spark, str(tmp_path / "t.txt")).collect()
    assert text.transcripts(spark, str(tmp_path / "t.txt"), strict=False).count() == 1
    (tmp_path / "m.ark").write_text("u1 [\n 1 2\n 3 4 ]\nu2 [\n 5 6 ]\n")
    assert sorted((r.utt, r.t, r.x) for r in text.ark(spark, str(tmp_path / "m.ark")).collect()) == [("u1", 0, [1, 2]), ("u1", 1, [3, 4]), ("u2", 0, [5, 6])]
