"""Binary files: features, decoding graphs, symbols, dictionaries, redirect tables, acoustic models.

Every format is packed, so a file is one row and is read by one task; many files are many tasks.  Parsers take rows
(path, content), as ``spark.read.format("binaryFile")`` gives them, and packers give bytes.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


NAME = 32  # bytes of a name in a model
SYMBOL = 50
PHONES = 60
ARC = np.dtype([("in", "<i4"), ("out", "<i4"), ("w", "<f4"), ("dst", "<i4")])
ENTRY = np.dtype([("word", "<i4"), ("n", "<i4"), ("phones", "<i4", (PHONES,))])


def contents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def parsed(files: DataFrame, parse, kind: str) -> DataFrame:
    """Rows of all files; parse gives lists of tuples for one (path, content)."""

    def run(pdfs):
        names = [c.strip().split(" ")[0] for c in split_top(kind)]
        for pdf in pdfs:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                rows = parse(name, bytes(data))
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, kind)


def split_top(kind: str) -> list[str]:
    """The columns of a schema text."""
    out, depth = [""], 0
    for ch in kind:
        depth += ch in "<("
        depth -= ch in ">)"
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return out


def features(spark: SparkSession, path: str) -> DataFrame:
    return parse_features(contents(spark, path))


def parse_features(files: DataFrame) -> DataFrame:
    """(utt, t, x): a 12-byte big-endian header (frames, period, frame bytes, kind) and float32 frames."""

    def parse(name, data):
        n, _, size, _ = struct.unpack(">iihh", data[:12])
        x = np.frombuffer(data, ">f4", n * size // 4, 12).reshape(n, size // 4).astype(np.float32)
        return [(name, t, row) for t, row in enumerate(x)]

    return parsed(files, parse, "utt string, t int, x array<float>")


def feature_bytes(x: np.ndarray, period: int = 100_000, kind: int = 9) -> bytes:
    return struct.pack(">iihh", len(x), period, 4 * x.shape[1], kind) + x.astype(">f4").tobytes()


def feature_files(frames: DataFrame) -> DataFrame:
    """(path, content): a feature file for each utterance of frames (utt, t, x), which meets in one task."""

    def run(pdf):
        pdf = pdf.sort_values("t")
        return pd.DataFrame({"path": [pdf["utt"].iloc[0]], "content": [feature_bytes(np.stack(pdf["x"].to_numpy()).astype(np.float32))]})

    return frames.select("utt", "t", "x").groupBy("utt").applyInPandas(run, "path string, content binary")


def graph_bytes(arcs: list[tuple], finals: list[int], nodes: int) -> bytes:
    """A graph of arcs (src, in, out, w, dst): counts, arcs of each node (16 bits), arcs in the order of their sources, finals."""
    arcs = sorted(arcs, key=lambda a: a[0])
    n = np.bincount([a[0] for a in arcs], minlength=nodes)
    if n.max(initial=0) > 65535:
        raise ValueError("a node has more than 65535 arcs")
    body = np.array([(a[1], a[2], a[3], a[4]) for a in arcs], ARC)
    return struct.pack("<iii", nodes, len(arcs), len(finals)) + n.astype("<u2").tobytes() + body.tobytes() + np.array(finals, "<i4").tobytes()


def parse_graphs(files: DataFrame, alpha: float = 1.0, fixed: bool = False) -> DataFrame:
    """(path, src, place, dst, in_id, out_id, w, final): arcs with scaled weights (times 1024 for fixed point); a row with dst null for each final."""
    scale = alpha * (1024 if fixed else 1)

    def parse(name, data):
        nodes, arcs, finals = struct.unpack_from("<iii", data)
        n = np.frombuffer(data, "<u2", nodes, 12)
        body = np.frombuffer(data, ARC, arcs, 12 + 2 * nodes)
        src = np.repeat(np.arange(nodes), n)
        ends = np.frombuffer(data, "<i4", finals, 12 + 2 * nodes + 16 * arcs)
        rows = [(name, int(s), i, int(a["dst"]), int(a["in"]), int(a["out"]), float(a["w"]) * scale, False) for i, (s, a) in enumerate(zip(src, body, strict=True))]
        return rows + [(name, int(e), None, None, None, None, None, True) for e in ends]

    return parsed(files, parse, "path string, src long, place long, dst long, in_id int, out_id int, w double, final boolean")


def symbol_bytes(names: list[str]) -> bytes:
    return struct.pack("<i", len(names)) + b"".join(n.encode()[: SYMBOL - 1].ljust(SYMBOL, b"\0") for n in names)


def text_of(data: bytes) -> str:
    return data.split(b"\0", 1)[0].decode("utf-8", "replace")


def parse_symbols(files: DataFrame) -> DataFrame:
    """(path, id, sym)."""
    return parsed(files, lambda name, d: [(name, i, text_of(d[4 + SYMBOL * i : 4 + SYMBOL * (i + 1)])) for i in range(struct.unpack_from("<i", d)[0])], "path string, id int, sym string")


def dictionary_bytes(entries: list[tuple[int, list[int]]]) -> bytes:
    out = np.zeros(len(entries), ENTRY)
    for i, (word, phones) in enumerate(entries):
        if len(phones) > PHONES:
            raise ValueError(f"an entry has at most {PHONES} phones")
        out[i]["word"], out[i]["n"] = word, len(phones)
        out[i]["phones"][: len(phones)] = phones
    return struct.pack("<i", len(entries)) + out.tobytes()


def parse_dictionaries(files: DataFrame) -> DataFrame:
    """(path, entry, word, phones)."""

    def parse(name, data):
        rows = np.frombuffer(data, ENTRY, struct.unpack_from("<i", data)[0], 4)
        return [(name, i, int(r["word"]), r["phones"][: r["n"]].tolist()) for i, r in enumerate(rows)]

    return parsed(files, parse, "path string, entry int, word int, phones array<int>")


def redirect_bytes(paths: dict[int, list[tuple[int, float]]], nodes: int) -> bytes:
    """A redirect table: counts, paths of each node (16 bits), where they begin, their ends, their weights."""
    n = np.array([len(paths.get(i, [])) for i in range(nodes)])
    flat = [p for i in range(nodes) for p in paths.get(i, [])]
    head = struct.pack("<iiii", nodes, nodes, len(flat), len(flat))
    return head + n.astype("<u2").tobytes() + (np.cumsum(n) - n).astype("<u4").tobytes() + np.array([p[0] for p in flat], "<i4").tobytes() + np.array([p[1] for p in flat], "<f4").tobytes()


def parse_redirects(files: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(path, node, stop, w), weights scaled."""

    def parse(name, data):
        nodes, _, ends, _ = struct.unpack_from("<iiii", data)
        n = np.frombuffer(data, "<u2", nodes, 16)
        stop = np.frombuffer(data, "<i4", ends, 16 + 6 * nodes)
        w = np.frombuffer(data, "<f4", ends, 16 + 6 * nodes + 4 * ends)
        return [(name, int(a), int(b), float(c) * alpha) for a, b, c in zip(np.repeat(np.arange(nodes), n), stop, w, strict=True)]

    return parsed(files, parse, "path string, node long, stop long, w double")


class Reader:
    """Steps through packed bytes."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self.data, kind, n, self.at)
        self.at += out.nbytes
        return out

    def int(self) -> int:
        return int(self.take("<i4", 1)[0])

    def name(self) -> str:
        self.at += NAME
        return text_of(self.data[self.at - NAME : self.at])


def packed_name(name: str) -> bytes:
    return name.encode()[: NAME - 1].ljust(NAME, b"\0")


def models_part(r: Reader, n: int) -> list[tuple]:
    out = []
    for _ in range(n):
        name, states = r.name(), r.int()
        out.append((name, r.take("<i4", states - 2).tolist(), r.int()))
    return out


def matrices_part(r: Reader, n: int) -> list[tuple]:
    out = []
    for _ in range(n):
        name, states = r.name(), r.int()
        out.append((name, states, r.take("<f4", states * states).astype(float).tolist()))
    return out


#: One row for each model, matrix, mixture, layer or prior; columns that a kind has no use for are null.
MODEL_ROW = "path string, kind string, id int, name string, ints array<int>, n int, part int, values array<double>, more array<double>, lw double, gconst double"


def model_row(path: str, kind: str, id_: int, name=None, ints=None, n=None, part=None, values=None, more=None, lw=None, gconst=None) -> tuple:
    return path, kind, id_, name, ints, n, part, values, more, lw, gconst


def shared_rows(path: str, models: list[tuple], matrices: list[tuple]) -> list[tuple]:
    rows = [model_row(path, "model", i, m[0], m[1], m[2]) for i, m in enumerate(models)]
    return rows + [model_row(path, "matrix", i, t[0], None, t[1], None, t[2]) for i, t in enumerate(matrices)]


def mixture_bytes(dim: int, models: list[tuple], states: list[tuple], matrices: list[tuple], least: float = -11.5) -> bytes:
    """Models (name, states, matrix), states (name, [(lw, mean, inverse variance, constant)]), matrices (name, n, values).

    Mixtures with a log weight below least are left out (the others keep their weights), and vectors are padded to a multiple of 4.
    """
    wide = dim + -dim % 4
    pad = lambda v: np.pad(np.array(v, "<f4"), (0, wide - dim)).tobytes()
    out = [struct.pack("<iiii", len(models), wide, len(states), len(matrices))]
    for name, ids, matrix in models:
        out += [packed_name(name), struct.pack("<i", len(ids) + 2), np.array(ids, "<i4").tobytes(), struct.pack("<i", matrix)]
    for name, mixtures in states:
        kept = [m for m in mixtures if m[0] >= least]
        out += [packed_name(name), struct.pack("<i", len(kept)), np.array([m[0] for m in kept], "<f4").tobytes(), *(pad(m[1]) for m in kept), *(pad(m[2]) for m in kept), np.array([m[3] for m in kept], "<f4").tobytes()]
    for name, n, values in matrices:
        out += [packed_name(name), struct.pack("<i", n), np.array(values, "<f4").tobytes()]
    return b"".join(out)


def parse_mixture_models(files: DataFrame) -> DataFrame:
    """Rows of Gaussian mixture models: kinds model (ints: tied states, n: matrix), mixture (id: state, part, lw, values: mean, more: inverse variance, gconst), matrix (n, values)."""

    def parse(path, data):
        r = Reader(data)
        models, dim, states, matrices = (r.int() for _ in range(4))
        named, rows = models_part(r, models), []
        for i in range(states):
            name, n = r.name(), r.int()
            lw, mean, var, g = r.take("<f4", n), r.take("<f4", n * dim).reshape(n, dim), r.take("<f4", n * dim).reshape(n, dim), r.take("<f4", n)
            rows += [model_row(path, "mixture", i, name, None, n, j, mean[j].astype(float).tolist(), var[j].astype(float).tolist(), float(lw[j]), float(g[j])) for j in range(n)]
        return shared_rows(path, named, matrices_part(r, matrices)) + rows

    return parsed(files, parse, MODEL_ROW)


LAYERS = ("AFFINE_TRANSFORM", "VQ_AFFINE_TRANSFORM", "PNORM", "NORMALIZE", "RELU", "FIXEDSCALE", "SOFTMAX", "SUMGROUP")


def network_bytes(models: list[tuple], matrices: list[tuple], dim: int, block: int, layers: list[tuple], log_priors: list[float]) -> bytes:
    """Models and matrices as in mixture_bytes; layers (type, in, out, values, bias, ints); priors in ln."""
    out = [packed_name("HMM"), struct.pack("<i", len(models))]
    for name, ids, matrix in models:
        out += [packed_name(name), struct.pack("<i", len(ids) + 2), np.array(ids, "<i4").tobytes(), struct.pack("<i", matrix)]
    for name, n, values in matrices:
        out += [packed_name(name), struct.pack("<i", n), np.array(values, "<f4").tobytes()]
    out += [packed_name("DNN"), struct.pack("<i", len(layers)), packed_name("SPLICE"), struct.pack("<ii", dim, block)]
    for kind, a, b, values, bias, ints in layers:
        out += [packed_name(kind), struct.pack("<ii", a, b)]
        if kind == "VQ_AFFINE_TRANSFORM":  # ints: code word size and dim, index rows and dim, then the index
            out += [np.array(ints[:2], "<i4").tobytes(), np.array(values, "<f4").tobytes(), np.array(ints[2:], "<i4").tobytes(), np.array(bias, "<f4").tobytes()]
        else:
            out += [np.array(x, t).tobytes() for x, t in ((values, "<f4"), (bias, "<f4"), (ints, "<i4")) if x is not None]
    return b"".join([*out, packed_name("PRIOR"), struct.pack("<i", len(log_priors)), np.array(log_priors, "<f4").tobytes()])


def parse_networks(files: DataFrame) -> DataFrame:
    """Rows of network models: model and matrix as in mixture models, splice (n: width, part: block), layer (name: type, ints: in and out and what follows, values, more: bias), prior (values: 1 / prior)."""

    def parse(path, data):
        r = Reader(data)
        r.name()
        n = r.int()
        models, matrices = models_part(r, n), None
        matrices = matrices_part(r, n)
        rows = shared_rows(path, models, matrices)
        r.name()
        layers = r.int()
        if r.name() != "SPLICE":
            raise ValueError("no splice in the network")
        rows.append(model_row(path, "splice", 0, n=r.int(), part=r.int()))
        for i in range(layers):
            kind, a, b = r.name(), r.int(), r.int()
            if kind not in LAYERS:
                raise ValueError(f"no such layer: {kind}")
            values = bias = None
            ints = [a, b]
            if kind == "AFFINE_TRANSFORM":
                values, bias = r.take("<f4", a * b), r.take("<f4", b)
            elif kind == "VQ_AFFINE_TRANSFORM":
                size, dim = r.int(), r.int()
                values = r.take("<f4", size * dim)
                out, wide = r.int(), r.int()
                ints += [size, dim, out, wide, *r.take("<i4", out * wide).tolist()]
                bias = r.take("<f4", out)
            elif kind == "FIXEDSCALE":
                values = r.take("<f4", a)
            elif kind == "SUMGROUP":
                ints += r.take("<i4", b).tolist()
            rows.append(model_row(path, "layer", i, kind, ints, None, None, None if values is None else values.astype(float).tolist(), None if bias is None else bias.astype(float).tolist()))
        if r.name() != "PRIOR":
            raise ValueError("no priors in the network")
        return rows + [model_row(path, "prior", 0, values=(1 / np.exp(r.take("<f4", r.int()).astype(float))).tolist())]

    return parsed(files, parse, MODEL_ROW)


def active_states(network: DataFrame, active: DataFrame) -> DataFrame:
    """Rows of a network with only the active output states (place, state): rows of the last affine layer, priors and tied states.

    A state that is not active keeps its number in a model, as no arc of a graph with this list of states reaches it.
    """
    places = active.agg(F.map_from_entries(F.collect_list(F.struct("state", "place"))).alias("_to"), F.array_sort(F.collect_list(F.struct("place", "state"))).alias("_from"))
    last = network.where("kind = 'layer' and name = 'AFFINE_TRANSFORM'").groupBy("path").agg(F.max("id").alias("_last"))
    rows = network.crossJoin(F.broadcast(places)).join(F.broadcast(last), "path", "left")
    here = (F.col("kind") == "layer") & (F.col("id") == F.col("_last"))
    wide = F.element_at("ints", 1)
    picked = F.flatten(F.transform("_from", lambda p: F.slice("values", p["state"] * wide + 1, wide)))
    take = lambda c: F.transform("_from", lambda p: F.element_at(F.col(c), p["state"] + 1))
    ints = F.when(F.col("kind") == "model", F.transform("ints", lambda s: F.coalesce(F.try_element_at("_to", s), s))).when(here, F.array(wide, F.size("_from")))
    after = (F.col("kind") == "layer") & (F.col("name") == "SOFTMAX") & (F.col("id") > F.col("_last"))
    return rows.withColumns({
        "ints": ints.when(after, F.array(F.size("_from"), F.size("_from"))).otherwise(F.col("ints")),
        "values": F.when(here, picked).when(F.col("kind") == "prior", take("values")).otherwise(F.col("values")),
        "more": F.when(here, take("more")).otherwise(F.col("more")),
    }).drop("_to", "_from", "_last")
