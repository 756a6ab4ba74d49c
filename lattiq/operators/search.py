"""Beam and path search: best rows, the best state path, token passing over arc graphs, lattices."""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattiq.functions import text as X


def beam(rows: DataFrame, key: str, score: str, k: int, *ties: str) -> DataFrame:
    """The k best rows of each key."""
    order = Window.partitionBy(key).orderBy(F.desc(score), *ties)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def n_best(rows: DataFrame, key: str, final: str, score: str, n: int, *ties: str) -> DataFrame:
    """The n best rows of each key, those at a final node first."""
    order = Window.partitionBy(key).orderBy(F.desc(final), F.desc(score), *ties)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def best_per(rows: DataFrame, keys: list[str], score: str, *ties: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), *ties)
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def lattice_unique(rows: DataFrame, *order: str) -> DataFrame:
    """The first row of each (start, stop, word, prev) in the given order."""
    w = Window.partitionBy("start", "stop", "word", "prev").orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def viterbi(frames: DataFrame, key: str, order: str, scores: str, transition: list[list[float]], start: list[float]) -> DataFrame:
    """(key, path, score): the best state sequence of each key; keys are independent, frames are not.

    scores holds a log score for each state; equal scores go to the smaller state.  A fold over the frames of a key carries
    the best score and path for each state.
    """
    n = len(start)
    packed = frames.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(scores).cast("array<double>").alias("e")))).alias("f"))
    cell = lambda sc, p: F.struct(sc.alias("s"), p.alias("p"))
    first = F.array(*[cell(F.lit(start[i]) + F.col("f")[0]["e"][i], F.lit(str(i))) for i in range(n)])

    def step(best, frame):
        def entry(j):
            come = F.array(*[F.struct((best[i]["s"] + F.lit(transition[i][j])).alias("s"), F.lit(-i).alias("i")) for i in range(n)])
            top = F.array_max(come)
            return F.transform(F.array(top), lambda t: cell(t["s"] + frame["e"][j], F.concat(F.element_at(best, 1 - t["i"])["p"], F.lit(str(j)))))[0]

        return F.array(*[entry(j) for j in range(n)])

    folded = packed.select(key, F.aggregate(F.slice("f", F.lit(2), F.greatest(F.size("f") - 1, F.lit(0))), first, step).alias("b"))
    top = folded.select(key, F.array_max(F.transform("b", lambda x, i: F.struct(x["s"], (-i).alias("i"), x["p"]))).alias("t"))
    return top.select(key, F.col("t.p").alias("path"), F.col("t.s").alias("score"))


@dataclass
class Net:
    """A decoding graph as plain arrays: arcs (src, dst, w, word id), their chains of states, entries of nodes, finals.

    states, own and move run over the states of all arcs: tied state, log probability to stay, and to go on from the state before
    (0 for the first).  first[a] .. first[a + 1] are the states of arc a.  Redirects are already among the entries: for each
    node the arcs that follow it directly or over eps arcs, with the weight on the way.
    """

    dst: np.ndarray
    word: np.ndarray
    first: np.ndarray
    states: np.ndarray
    own: np.ndarray
    move: np.ndarray
    entry_at: np.ndarray
    entry_arc: np.ndarray
    entry_w: np.ndarray
    final: np.ndarray
    words: list[str]


#: Arcs and states that a net may have: it is sent to every executor.
NET_STATES = 20_000_000


def net(arcs: DataFrame, finals: DataFrame, closure: DataFrame, models: DataFrame, dictionary: DataFrame | None = None, alpha: float = 1.0) -> Net:
    """The net of a graph: arcs (src, dst, ilabel, olabel, w), eps closure (node, stop, w), models (model, states, own, move).

    own and move hold a log probability for each state of a model; dictionary (entry, phones) resolves labels ``D=k``.  Weights are
    scaled by alpha.  A label that is no model is an error, and so is a net of more than NET_STATES states.
    """
    size = arcs.count()
    if size > NET_STATES:
        raise ValueError(f"{size} arcs are more than a net may have")
    table = {r["model"]: (r["states"], r["own"], r["move"]) for r in models.collect()}
    entries = {f"D={r['entry']}": r["phones"].split(" ") for r in dictionary.collect()} if dictionary is not None else {}
    rows = sorted(((r["src"], r["dst"], r["ilabel"], r["olabel"], r["w"] * alpha) for r in arcs.where(F.col("ilabel") != "<eps>").collect()), key=lambda r: (r[0], r[1], r[2], r[3], r[4]))
    nodes = 1 + max([0, *(max(r[0], r[1]) for r in rows), *(r["m"] or 0 for r in arcs.select(F.max(F.greatest("src", "dst")).alias("m")).collect()), *(r["node"] for r in finals.collect())])
    words = sorted({r[3] for r in rows} | {"<eps>"}, key=lambda w: (w != "<eps>", w))
    number = {w: i for i, w in enumerate(words)}
    first, states, own, move = [0], [], [], []
    leaving: dict[int, list[int]] = {}
    for k, (src, _, label, _, _) in enumerate(rows):
        for model in entries.get(label, [label]):
            if model not in table:
                raise ValueError(f"no such model: {model}")
            for x, y in zip((states, own, move), table[model], strict=True):
                x.extend(y)
        first.append(len(states))
        leaving.setdefault(src, []).append(k)
    if len(states) > NET_STATES:
        raise ValueError(f"{len(states)} states are more than a net may have")
    entry: dict[int, dict[int, float]] = {n: {k: rows[k][4] for k in ks} for n, ks in leaving.items()}
    for r in closure.collect():  # the best way over eps arcs to each arc
        for k in leaving.get(r["stop"], []):
            have = entry.setdefault(r["node"], {})
            have[k] = max(have.get(k, -np.inf), r["w"] * alpha + rows[k][4])
    at = np.zeros(nodes + 1, np.int64)
    for n, e in entry.items():
        at[n + 1] = len(e)
    pairs = [(k, w) for n in sorted(entry) for k, w in sorted(entry[n].items())]
    move = np.array(move, float)
    move[np.array(first[:-1], int)] = 0.0
    final = np.zeros(nodes, bool)
    final[[r["node"] for r in finals.collect()]] = True
    return Net(np.array([r[1] for r in rows]), np.array([number[r[3]] for r in rows]), np.array(first), np.array(states), np.array(own, float), move, np.cumsum(at), np.array([k for k, _ in pairs], int), np.array([w for _, w in pairs], float), final, words)


SILENT = ("sil", "<eps>", "</s>")


def pass_tokens(g: Net, scores: np.ndarray, beam: int) -> tuple[list[str] | None, float, bool, list[tuple]]:
    """Words, score and whether at a final node, of the best path through the frames (rows of scores by tied state), and lattice rows.

    One token at most for each state of the net.  In each frame the best token of each node that has left an arc enters the arcs
    behind it (the one that was there first wins a tie), a token stays or goes on to the next state (a tie goes to the one that
    stays), and the beam best ones stay.  A history entry (arc, frame, entry before, score and scaled model score so far) is made
    where an arc with an output is entered.  A lattice row (start, stop, word, word before, acoustic, model) is given when
    such an arc is left by the best token of its node.
    """
    n = len(g.states)
    arc_of = np.repeat(np.arange(len(g.dst)), np.diff(g.first))
    is_last = np.zeros(n, bool)
    is_last[g.first[1:] - 1] = True
    total, lm, hist = np.full(n, -np.inf), np.zeros(n), np.full(n, -1)
    history: list[tuple[int, int, int, float, float]] = []
    lattice: list[tuple] = []
    for t, frame in enumerate(scores):
        live = np.flatnonzero(np.isfinite(total))
        new, new_lm, new_hist = np.full(n, -np.inf), np.zeros(n), np.full(n, -1)
        stay = live if t else live[:0]
        new[stay], new_lm[stay], new_hist[stay] = total[stay] + g.own[stay], lm[stay], hist[stay]
        inner = live[~is_last[live]]
        moved = total[inner] + g.move[inner + 1]
        better = moved > new[inner + 1]
        inner, moved = inner[better], moved[better]
        new[inner + 1], new_lm[inner + 1], new_hist[inner + 1] = moved, lm[inner], hist[inner]
        best: dict[int, int] = {}
        for s in live[is_last[live]]:
            node = int(g.dst[arc_of[s]])
            if node not in best or total[s] > total[best[node]]:
                best[node] = int(s)
        leaving = [(node, total[s], lm[s], int(hist[s]), int(arc_of[s])) for node, s in best.items()] if t else [(0, 0.0, 0.0, -1, -1)]
        for node, score, model, h, arc in leaving:
            if arc >= 0 and g.word[arc]:
                lattice.append(lattice_row(g, history, h, t, score, model))
            lo, hi = g.entry_at[node], g.entry_at[node + 1]
            arcs, w = g.entry_arc[lo:hi], g.entry_w[lo:hi]
            slot = g.first[arcs]
            better = score + w > new[slot]
            for k, x, at in zip(arcs[better], w[better], slot[better], strict=True):
                new[at], new_lm[at], new_hist[at] = score + x, model + x, h
                if g.word[k]:
                    history.append((int(k), t, h, score + x, model + x))
                    new_hist[at] = len(history) - 1
        live = np.flatnonzero(np.isfinite(new))
        new[live] += frame[g.states[live]]
        if len(live) > beam:
            order = np.lexsort((live, -new[live]))
            new[live[order[beam:]]] = -np.inf
        total, lm, hist = new, new_lm, new_hist
    live = np.flatnonzero(np.isfinite(total))
    if not len(live):
        return None, 0.0, False, lattice
    ends = live[is_last[live] & g.final[g.dst[arc_of[live]]]]
    pool = ends if len(ends) else live
    s = pool[np.argmax(total[pool])]
    if g.word[arc_of[s]]:
        lattice.append(lattice_row(g, history, int(hist[s]), len(scores), total[s], lm[s]))
    words, h = [], hist[s]
    while h >= 0:
        words.append(g.words[g.word[history[h][0]]])
        h = history[h][2]
    return [w for w in reversed(words) if w not in SILENT], float(total[s]), bool(len(ends)), lattice


def lattice_row(g: Net, history: list, h: int, stop: int, score: float, model: float) -> tuple:
    """The row of the history entry h: start, stop, word, word before, acoustic and model score since the entry before."""
    arc, start, before, since, base = history[h]
    prev, earlier = (g.words[g.word[history[before][0]]], history[before][4]) if before >= 0 else ("<s>", 0.0)
    word = g.words[g.word[arc]]
    return start, stop, "sil" if word == "</s>" else word, prev, float((score - since) - (model - base)), float(base - earlier)


def decode(frames: DataFrame, g: Net, beam: int = 3000, key: str = "utt", order: str = "t", scores: str = "scores") -> DataFrame:
    """(key, words, score, at_final, lattice): token passing over each utterance, whose frames (key, order, scores) meet in one task.

    Utterances are independent and bounded in length; frames of one utterance are not.  words is null where no token is left.
    """
    X.decode_options(beam, 1.0)
    shared = frames.sparkSession.sparkContext.broadcast({f.name: getattr(g, f.name) for f in fields(g)})
    kind = frames.schema[key].dataType.simpleString()
    row = "struct<start:int,stop:int,word:string,prev:string,am:double,lm:double>"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        words, score, final, lattice = pass_tokens(Net(**shared.value), np.stack(pdf[scores].to_numpy()), beam)
        names = ("start", "stop", "word", "prev", "am", "lm")
        return pd.DataFrame({key: [pdf[key].iloc[0]], "words": [words], "score": [score], "at_final": [final], "lattice": [[dict(zip(names, r, strict=True)) for r in lattice]]})

    return frames.select(key, order, scores).groupBy(key).applyInPandas(run, f"`{key}` {kind}, words array<string>, score double, at_final boolean, lattice array<{row}>")


def lattice_rows(decoded: DataFrame, key: str = "utt") -> DataFrame:
    """(key, start, stop, word, prev, am, lm): distinct lattice rows; silence at the start of a sentence is left out."""
    rows = decoded.select(key, F.inline("lattice")).where("not (word = 'sil' and start = 0)").distinct()
    w = Window.partitionBy(key, "start", "stop", "word", "prev").orderBy("am", "lm")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
