"""A recurrent layer (long short-term memory) over the frames of utterances.

For a frame x, the state h, c of the frame before (0 at the begin) and gates i, f, g, o, the rows of z = W x + U h + b in this order:
c = sigmoid(f) c + sigmoid(i) tanh(g), h = sigmoid(o) tanh(c); h is the output.  A public definition, without a claim to equal any one program.

Utterances are independent and are run side by side, a step for all of them at a time; a task holds ROWS frames, and an utterance that goes on
behind them keeps its state, so memory does not grow with its length.

Defined cases: frames of an utterance are taken in the order given; a null vector is an error; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Frames that a task runs at a time.
ROWS = 8192


@dataclass
class Lstm:
    """Weights of inputs (4 n rows), of the state (4 n rows of n), and bias."""

    w: np.ndarray
    u: np.ndarray
    b: np.ndarray

    def __post_init__(self) -> None:
        n = self.u.shape[1]
        if self.u.shape != (4 * n, n) or self.w.shape[0] != 4 * n or self.b.shape != (4 * n,):
            raise ValueError("the weights of the layer do not fit each other")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def steps(layer: Lstm, xs: list[np.ndarray], states: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
    """(outputs, end states) of several utterances side by side, the longest first so that those that have ended drop off."""
    n = layer.u.shape[1]
    order = sorted(range(len(xs)), key=lambda i: -len(xs[i]))
    inputs = [xs[i] @ layer.w.T + layer.b for i in order]
    h, c = (np.stack([states[i][k] for i in order]) for k in range(2))
    out = [np.zeros((len(xs[i]), n)) for i in order]
    live = len(order)
    for t in range(len(inputs[0])):
        while len(inputs[live - 1]) <= t:
            live -= 1
        z = np.stack([inputs[k][t] for k in range(live)]) + h[:live] @ layer.u.T
        i, f, g, o = (z[:, k * n : (k + 1) * n] for k in range(4))
        c[:live] = sigmoid(f) * c[:live] + sigmoid(i) * np.tanh(g)
        h[:live] = sigmoid(o) * np.tanh(c[:live])
        for k in range(live):
            out[k][t] = h[k]
    place = {i: k for k, i in enumerate(order)}
    return [out[place[i]] for i in range(len(xs))], [(h[place[i]].copy(), c[place[i]].copy()) for i in range(len(xs))]


def recurrent(frames: DataFrame, layer: Lstm, key: str = "utt", order: str = "t", value: str = "x", out: str = "h", rows: int = ROWS) -> DataFrame:
    """(key, order, out): the outputs of the layer for every frame."""
    shared = frames.sparkSession.sparkContext.broadcast(layer)
    kinds = [frames.schema[c].dataType for c in (key, order)]
    arrow_kinds = [to_arrow_type(k) for k in kinds]
    schema = T.StructType([T.StructField(key, kinds[0]), T.StructField(order, kinds[1]), T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches):
        layer = shared.value
        n = layer.u.shape[1]
        held: list[tuple] = []  # (key, orders, vectors, state)
        size = 0

        def done():
            got, ends = steps(layer, [np.array(h[2], float) for h in held], [h[3] for h in held])
            for (name, at, _, _), y in zip(held, got, strict=True):
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * n, pa.int32()), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), arrow_kinds[0]), pa.array(at, arrow_kinds[1]), values], names=[key, order, out])
            held[:] = [(held[-1][0], [], [], ends[-1])]  # it may go on

        for batch in batches:
            for name, at, x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not held or held[-1][0] != name:
                    if held and not held[-1][1]:
                        held.pop()
                    held.append((name, [], [], (np.zeros(n), np.zeros(n))))
                held[-1][1].append(at)
                held[-1][2].append(x)
                size += 1
                if size >= rows:
                    yield from done()
                    size = 0
        if held and not held[-1][1]:
            held.pop()
        if held:
            yield from done()

    return frames.select(key, order, value).repartition(key).sortWithinPartitions(key, order).mapInArrow(run, schema)
