"""The forward pass of a network model: frames to log posteriors, as matrix products over Arrow batches.

A model is the rows that ``sources.binary.parse_networks`` gives.  Its weights are checked and sent to the executors once.  Frames
are spliced inside tasks: an utterance is cut into spans of SPAN frames, each with the few frames behind it that its blocks
need, so that a long utterance is many small groups and no frame is shuffled more than twice.  Time is linear in the frames and in
the number of weights.

Defined cases: frames of an utterance are numbered from 0 without gaps (a gap is an error, as a block would mix far frames); at the end of an
utterance the last frame is repeated; a null vector is an error; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Weights that a model may have: they are collected and sent to every executor.
MOST_WEIGHTS = 100_000_000
#: Frames of an utterance that one group holds.
SPAN = 4096


@dataclass
class Layer:
    kind: str
    wide: int
    out: int
    values: np.ndarray | None
    bias: np.ndarray | None
    ints: list[int]


@dataclass
class Network:
    """Frames of dim values, block frames to a splice, layers in order, one over each prior (or none)."""

    dim: int
    block: int
    layers: list[Layer]
    inverse_prior: np.ndarray | None


def network_of(rows: DataFrame) -> Network:
    """The network of the rows of one model file, checked: sizes of neighbouring layers, of weights, codes and priors."""
    part = rows.where("kind in ('splice', 'layer', 'prior')")
    size = part.agg(F.coalesce(F.sum(F.coalesce(F.size("values"), F.lit(0)) + F.coalesce(F.size("ints"), F.lit(0))), F.lit(0))).first()[0]
    if size > MOST_WEIGHTS:
        raise ValueError(f"{size} weights are more than a network may have")
    got = part.select("path", "kind", "id", "name", "ints", "n", "part", "values", "more").collect()
    if len({r["path"] for r in got}) != 1:
        raise ValueError("one model at a time")
    array = lambda x: None if x is None else np.array(x, float)
    splice = [r for r in got if r["kind"] == "splice"]
    if len(splice) != 1:
        raise ValueError("a network has one splice")
    layers = [Layer(r["name"], r["ints"][0], r["ints"][1], array(r["values"]), array(r["more"]), list(r["ints"][2:])) for r in sorted((r for r in got if r["kind"] == "layer"), key=lambda r: r["id"])]
    prior = [array(r["values"]) for r in got if r["kind"] == "prior"]
    net = Network(splice[0]["n"], splice[0]["part"], layers, prior[0] if prior else None)
    check(net)
    return net


def check(net: Network) -> None:
    width = net.dim * net.block
    for k, layer in enumerate(net.layers):
        wrong = layer.wide != width
        if layer.kind == "AFFINE_TRANSFORM":
            wrong |= layer.values is None or len(layer.values) != layer.wide * layer.out or len(layer.bias) != layer.out
        elif layer.kind == "VQ_AFFINE_TRANSFORM":
            size, dim, out, groups = layer.ints[:4]
            codes = np.array(layer.ints[4:])
            wrong = dim * groups != width or out != layer.out or len(layer.values) != size * dim or len(codes) != out * groups or len(layer.bias) != out or (len(codes) and (codes.min() < 1 or codes.max() > size))
        elif layer.kind == "FIXEDSCALE":
            wrong |= len(layer.values) != layer.wide or layer.out != layer.wide
        elif layer.kind == "PNORM":
            wrong |= layer.out < 1 or layer.wide % layer.out != 0
        elif layer.kind == "SUMGROUP":
            wrong |= len(layer.ints) != layer.out or sum(layer.ints) > layer.wide or min(layer.ints, default=1) < 1
        elif layer.kind in ("NORMALIZE", "RELU", "SOFTMAX"):
            wrong |= layer.out != layer.wide
        else:
            raise ValueError(f"no such layer: {layer.kind}")
        if wrong:
            raise ValueError(f"layer {k} ({layer.kind}) does not fit {width} values")
        width = layer.out
    if net.inverse_prior is not None and len(net.inverse_prior) != width:
        raise ValueError(f"{len(net.inverse_prior)} priors for {width} outputs")


def layer_output(layer: Layer, x: np.ndarray, floor: float = 1e-20) -> np.ndarray:
    """The layer's output for a row of x each."""
    if layer.kind == "AFFINE_TRANSFORM":
        return x @ layer.values.reshape(layer.out, layer.wide).T + layer.bias
    if layer.kind == "VQ_AFFINE_TRANSFORM":  # products with the code words once, then sums by code
        size, dim, out, groups = layer.ints[:4]
        code = np.array(layer.ints[4:]).reshape(out, groups) - 1
        dots = x.reshape(len(x), groups, dim) @ layer.values.reshape(size, dim).T
        y = np.zeros((len(x), out))
        for g in range(groups):
            y += dots[:, g, code[:, g]]
        return y + layer.bias
    if layer.kind == "PNORM":
        return np.sqrt((x.reshape(len(x), layer.out, -1) ** 2).sum(axis=2))
    if layer.kind == "NORMALIZE":  # the factor is 1 at most, as in nn.rms_normalise
        rms = np.sqrt((x * x).mean(axis=1, keepdims=True))
        return x / np.maximum(rms, 1.0)
    if layer.kind == "RELU":
        return np.maximum(x, 0.0)
    if layer.kind == "FIXEDSCALE":
        return x * layer.values
    if layer.kind == "SOFTMAX":
        top = x.max(axis=1, keepdims=True)
        e = np.exp(x - top)
        return np.maximum(e / e.sum(axis=1, keepdims=True), floor)
    starts = np.cumsum([0, *layer.ints[:-1]])
    return np.add.reduceat(x[:, : sum(layer.ints)], starts, axis=1)


def posteriors(net: Network, x: np.ndarray, log: bool) -> np.ndarray:
    for layer in net.layers:
        x = layer_output(layer, x)
    if net.inverse_prior is not None:
        x = x * net.inverse_prior
        x = x / x.sum(axis=1, keepdims=True)
    return np.log(x) if log else x


def blocks_of(x: np.ndarray, first: int, n: int, block: int) -> np.ndarray:
    """Blocks of frames first .. first + n - 1; behind the end the last frame is repeated."""
    at = np.minimum(first + np.arange(n)[:, None] + np.arange(block)[None, :], len(x) - 1)
    return x[at].reshape(n, -1)


#: Blocks that are multiplied at a time.
ROWS = 512


def forward(frames: DataFrame, net: Network, key: str = "utt", order: str = "t", value: str = "x", out: str = "scores", log: bool = True, every: int = 1, span: int = SPAN) -> DataFrame:
    """(key, order, out): the (log) posteriors over the priors of every frame.

    every: behind frame 0, only each every-th frame is computed, and the frames up to the next take its scores over.
    """
    if span < max(net.block, every):
        raise ValueError("a span is shorter than a block")
    span -= span % every
    shared = frames.sparkSession.sparkContext.broadcast(net)
    t = F.col(order).cast("long")
    own = F.floor((t + every - 1) / span)  # frames that share a score share a span
    behind = (t + every - 1) % span < net.block - 1
    parts = F.when(behind & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    kind = frames.schema[key].dataType
    arrow_kind = to_arrow_type(kind)
    rows = frames.select(F.col(key), F.struct(t.alias("t"), own.alias("own"), F.col(value).cast("array<double>").alias("x")).alias("_f"), F.explode(parts).alias("_part"))
    rows = rows.select(key, "_part", F.col("_f.t").alias("_t"), F.col("_f.own").alias("_own"), F.col("_f.x").alias("_x"))
    dealt = rows.repartition(F.col(key), F.col("_part")).sortWithinPartitions(key, "_part", "_t")
    schema = T.StructType([T.StructField(key, kind), T.StructField(order, T.LongType()), T.StructField(out, T.ArrayType(T.DoubleType()))])

    def scored(name, part, times, owns, vectors):
        net = shared.value
        t, x = np.array(times), np.array(vectors, float)
        if x.ndim != 2 or x.shape[1] != net.dim:
            raise ValueError(f"frames of {name} do not have {net.dim} values")
        if (np.diff(t) != 1).any() or (part == 0 and t[0] != 0):
            raise ValueError(f"frames of {name} have gaps or repeat")
        n = int((np.array(owns) == part).sum())
        for a in range(0, n, ROWS):
            b = min(n, a + ROWS)
            if every == 1:
                y = posteriors(net, blocks_of(x, a, b - a, net.block), log)
            else:  # frames 0, 1, 1 + every, ... are computed
                lead = np.where(t[a:b] == 0, 0, t[a:b] - (t[a:b] - 1) % every) - t[0]
                some, place = np.unique(lead, return_inverse=True)
                y = posteriors(net, np.concatenate([blocks_of(x, int(s), 1, net.block) for s in some]), log)[place]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([name] * (b - a), arrow_kind), pa.array(t[a:b]), flat], names=[key, order, out])

    def run(batches):
        held, at = [[], [], []], None
        for batch in batches:
            for name, part, *rest in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (name, part) != at:
                    if at is not None:
                        yield from scored(*at, *held)
                    held, at = [[], [], []], (name, part)
                for x, v in zip(held, rest, strict=True):
                    x.append(v)
        if at is not None:
            yield from scored(*at, *held)

    return dealt.mapInArrow(run, schema)
