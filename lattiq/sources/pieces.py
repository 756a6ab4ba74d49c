"""Model files in pieces, for models that one row or task can't hold.

A file is rows (path, at, content): the bytes from a place on, at a multiple of 4, as all its fields are of 4 bytes or multiples.  A writer gives each row of
values its place in the file, and values that stand together there become pieces of about PIECE bytes.  A reader walks over the
headers on the driver, which fetches some WINDOW bytes where a header stands and no values, and tasks then cut values out of the pieces.  The
directory of a file is on the driver: a few numbers for each layer, model, matrix or state.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.operators.steps import cut
from lattiq.sources import binary

PIECE = 1 << 18
WINDOW = 1 << 14

PIECES = "path string, at long, content binary"
#: Values by section: kind and id (of a layer or state), row within it.
VALUES = "path string, kind string, id int, row long, values array<float>"


def cut_files(files: DataFrame, piece: int = PIECE) -> DataFrame:
    """Pieces of whole files (path, content)."""
    starts = F.sequence(F.lit(0), F.greatest(F.octet_length("content") - 1, F.lit(0)), F.lit(piece))
    return files.select("path", "content", F.explode(starts).alias("_at")).select("path", F.col("_at").cast("long").alias("at"), F.substring("content", F.col("_at") + 1, F.lit(piece)).alias("content"))


def row_pieces(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """Pieces of rows (path, at, values): 32-bit numbers that stand at a place of the file."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        at, x = pdf["at"].to_numpy(), [np.asarray(v, "<f4") for v in pdf["values"]]
        ends = at + 4 * np.array([len(v) for v in x])
        if (ends[:-1] > at[1:]).any():
            raise ValueError("two rows of values stand in one place of a file")
        runs = [0, *(np.flatnonzero(ends[:-1] != at[1:]) + 1).tolist(), len(x)]
        return pd.DataFrame({"path": pdf["path"].iloc[0], "at": at[runs[:-1]], "content": [b"".join(v.tobytes() for v in x[i:j]) for i, j in zip(runs, runs[1:], strict=False)]})

    return rows.select("path", "at", F.col("values").cast("array<float>").alias("values")).groupBy("path", F.floor(F.col("at") / piece)).applyInPandas(pack, PIECES)


def byte_pieces(spark, path: str, parts: list[tuple[int, bytes]]) -> DataFrame:
    return spark.createDataFrame([(path, at, data) for at, data in parts], PIECES)


class Walk(binary.Reader):
    """Steps over a file in pieces; what it takes is fetched, what it skips is not."""

    def __init__(self, pieces: DataFrame, path: str, longest: int) -> None:
        super().__init__(b"")
        self.pieces, self.path, self.longest, self.first = pieces.where(F.col("path") == path), path, longest, 0

    def _bytes(self, n: int) -> bytes:
        lo = self.at
        if not self.first <= lo <= lo + n <= self.first + len(self.data):
            hi = lo + max(n, WINDOW)
            near = self.pieces.where(F.col("at").between(lo - self.longest, hi - 1))
            begin = F.greatest(F.lit(lo) - F.col("at"), F.lit(0)).cast("int")
            got = near.select(F.greatest("at", F.lit(lo)).alias("at"), F.substring("content", begin + 1, (F.lit(hi) - F.greatest("at", F.lit(lo))).cast("int")).alias("x"), (F.octet_length("content") > begin).alias("_in"))
            self.first, self.data = lo, b""
            for r in sorted(got.where("_in").select("at", "x").collect()):
                if r["at"] != lo + len(self.data):
                    break
                self.data += bytes(r["x"])
        self.at += n
        out = self.data[lo - self.first : lo - self.first + n]
        if len(out) != n:
            raise ValueError(f"{self.path} ends at {lo + len(out)}, or lacks a piece there")
        return out

    def take(self, kind: str, n: int) -> np.ndarray:
        return np.frombuffer(self._bytes(n * np.dtype(kind).itemsize), kind, n)

    def name(self) -> str:
        return binary.text_of(self._bytes(binary.NAME))


class Section(NamedTuple):
    """count values from a place on, in rows of wide values."""

    path: str
    kind: str
    id: int
    at: int
    count: int
    wide: int


class Packed(NamedTuple):
    """A model: rows of MODEL_ROW without the values of layers, mixtures and priors, and these values as rows of VALUES."""

    heads: DataFrame
    values: DataFrame


def values_of(pieces: DataFrame, sections: list[Section]) -> DataFrame:
    """Rows of VALUES; a row that reaches over the end of a piece is put together from its parts."""
    by_path: dict[str, list[Section]] = {}
    for s in sorted(sections, key=lambda s: s.at):
        by_path.setdefault(s.path, []).append(s)
    schema = pa.schema([("path", pa.string()), ("kind", pa.string()), ("id", pa.int32()), ("row", pa.int64()), ("wide", pa.int32()), ("off", pa.int32()), ("values", pa.list_(pa.float32()))])

    def run(batches, whole: bool):
        for batch in batches:
            for path, at, content in zip(batch.column("path").to_pylist(), batch.column("at").to_pylist(), batch.column("content"), strict=True):
                data = content.as_buffer()
                stop = at + len(data)
                for s in by_path.get(path, ()):
                    lo, hi = max(at, s.at), min(stop, s.at + 4 * s.count)
                    if lo >= hi:
                        continue
                    if (lo - s.at) % 4 or (hi - lo) % 4:
                        raise ValueError(f"a piece of {path} begins or ends within a number, at {at}")
                    x, first = np.frombuffer(data, "<f4", (hi - lo) // 4, lo - at), (lo - s.at) // 4
                    bounds = np.unique([0, *range(-first % s.wide, len(x), s.wide), len(x)])
                    off, size = (first + bounds[:-1]) % s.wide, np.diff(bounds)
                    pick = np.flatnonzero((size == s.wide) == whole)
                    if not len(pick):
                        continue
                    ends = pa.array(np.append(bounds[:-1][pick], bounds[pick[-1] + 1]).astype(np.int32)) if whole else None
                    lists = pa.ListArray.from_arrays(ends, pa.array(x)) if whole else pa.array([x[bounds[i] : bounds[i + 1]] for i in pick], pa.list_(pa.float32()))
                    m = len(pick)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * m), pa.array([s.kind] * m), pa.array(np.full(m, s.id, np.int32)), pa.array((first + bounds[:-1][pick]) // s.wide), pa.array(np.full(m, s.wide, np.int32)), pa.array(off[pick].astype(np.int32)), lists], schema=schema)

    kind = "path string, kind string, id int, row long, wide int, off int, values array<float>"
    whole = pieces.select("path", "at", "content").mapInArrow(lambda b: run(b, True), kind)
    parts = pieces.select("path", "at", "content").mapInArrow(lambda b: run(b, False), kind).groupBy("path", "kind", "id", "row", "wide").agg(F.flatten(F.array_sort(F.collect_list(F.struct("off", "values")))["values"]).alias("values"))
    short = F.raise_error(F.concat(F.lit("values are missing in "), F.col("path"))).cast("array<float>")
    merged = parts.withColumn("values", F.when(F.size("values") != F.col("wide"), short).otherwise(F.col("values")))
    columns = ["path", "kind", "id", "row", "values"]
    return whole.select(*columns).unionByName(merged.select(*columns))


def packed(pieces: DataFrame, walk) -> Packed:
    """A model of files in pieces; walk (a Walk) gives the heads and sections of one file."""
    kept = cut(pieces)
    files = kept.groupBy("path").agg(F.max(F.octet_length("content")).alias("n")).collect()  # a row for each file
    heads, sections = [], []
    for f in sorted(files):
        rows, places = walk(Walk(kept, f["path"], f["n"]))
        heads += rows
        sections += places
    return Packed(kept.sparkSession.createDataFrame(heads, binary.MODEL_ROW), values_of(kept, sections))


def parse_mixture_pieces(pieces: DataFrame) -> Packed:
    """Heads: models, matrices, and a row of kind state (n: its mixtures) for each state; values: kinds lw, mean, inverse (variance) and gconst, row by row."""

    def walk(r: Walk):
        models, dim, states, matrices = (r.int() for _ in range(4))
        named, heads, places = binary.models_part(r, models), [], []
        for i in range(states):
            name, n = r.name(), r.int()
            heads.append(binary.model_row(r.path, "state", i, name, n=n))
            for kind, wide in (("lw", 1), ("mean", dim), ("inverse", dim), ("gconst", 1)):
                places.append(Section(r.path, kind, i, r.at, n * wide, wide))
                r.at += 4 * n * wide
        return binary.shared_rows(r.path, named, binary.matrices_part(r, matrices)) + heads, places

    return packed(pieces, walk)


def parse_network_pieces(pieces: DataFrame) -> Packed:
    """Heads as in parse_networks, with ints; values: kinds weights (a row for each output, or for each code word), bias, scale and prior (in ln)."""

    def walk(r: Walk):
        places: list[Section] = []

        def skip(kind, i, count, wide=1):
            places.append(Section(r.path, kind, i, r.at, count, wide))
            r.at += 4 * count

        r.name()
        n = r.int()
        models = binary.models_part(r, n)
        heads = binary.shared_rows(r.path, models, binary.matrices_part(r, n))
        r.name()
        layers = r.int()
        if r.name() != "SPLICE":
            raise ValueError("no splice in the network")
        heads.append(binary.model_row(r.path, "splice", 0, n=r.int(), part=r.int()))
        for i in range(layers):
            kind, a, b = r.name(), r.int(), r.int()
            if kind not in binary.LAYERS:
                raise ValueError(f"no such layer: {kind}")
            ints = [a, b]
            if kind == "AFFINE_TRANSFORM":
                skip("weights", i, a * b, max(a, 1))
                skip("bias", i, b)
            elif kind == "VQ_AFFINE_TRANSFORM":
                size, dim = r.int(), r.int()
                skip("weights", i, size * dim, max(dim, 1))
                out, wide = r.int(), r.int()
                ints += [size, dim, out, wide, *r.take("<i4", out * wide).tolist()]
                skip("bias", i, out)
            elif kind == "FIXEDSCALE":
                skip("scale", i, a)
            elif kind == "SUMGROUP":
                ints += r.take("<i4", b).tolist()
            heads.append(binary.model_row(r.path, "layer", i, kind, ints))
        if r.name() != "PRIOR":
            raise ValueError("no priors in the network")
        skip("prior", 0, r.int())
        return heads, places

    return packed(pieces, walk)


def active_states(network: Packed, active: DataFrame) -> Packed:
    """A network with only the active output states (place, state), as ``binary.active_states``: a join of rows by their state."""
    heads, values = network
    to = active.select(F.col("state").cast("long").alias("row"), F.col("place").cast("long").alias("_to"))
    last = heads.where("kind = 'layer' and name = 'AFFINE_TRANSFORM'").groupBy("path").agg(F.max("id").alias("_last"))  # a row for each file
    held = values.join(F.broadcast(last), "path", "left")
    outer = (F.col("kind") == "prior") | F.col("kind").isin("weights", "bias") & F.coalesce(F.col("id") == F.col("_last"), F.lit(False))
    picked = held.where(outer).join(to, "row").withColumn("row", F.col("_to"))
    columns = ["path", "kind", "id", "row", "values"]
    n = active.agg(F.count("*").cast("int").alias("_n"))
    tied = heads.where("kind = 'model'").select("path", "id", F.posexplode("ints").alias("_i", "row")).join(to, "row", "left")
    tied = tied.groupBy("path", "id").agg(F.array_sort(F.collect_list(F.struct("_i", F.coalesce("_to", "row").cast("int").alias("s"))))["s"].alias("_ints"))  # the states of one model
    of = heads.join(F.broadcast(last), "path", "left").crossJoin(F.broadcast(n)).join(tied.withColumn("kind", F.lit("model")), ["path", "kind", "id"], "left")
    here = (F.col("kind") == "layer") & (F.col("id") == F.col("_last"))
    after = (F.col("kind") == "layer") & (F.col("name") == "SOFTMAX") & (F.col("id") > F.col("_last"))
    ints = F.when(here, F.array(F.element_at("ints", 1), F.col("_n"))).when(after, F.array("_n", "_n")).otherwise(F.coalesce("_ints", "ints"))
    return Packed(of.withColumn("ints", ints).select(heads.columns), picked.select(*columns).unionByName(held.where(~outer).select(*columns)))
