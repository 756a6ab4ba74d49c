"""Sound: PCM files in blocks, change of the sampling rate, cepstral features.  Public definitions, without a claim to equal any one program.

A signal is rows (utt, block, x): the samples block * span .. of an utterance, span of them in every block but the last.  A block that needs
samples of its neighbours gets them as a halo (``with_halo``), so a long file is many tasks; only reading a file is one.

Defined cases: an empty signal gives no rows; null samples are an error; samples before the begin and behind the end are 0 for filters;
frames that do not end inside the signal are left out.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Samples of a block.
SPAN = 1 << 16


def wave(data: bytes) -> tuple[int, np.ndarray]:
    """(rate, samples) of a RIFF file of 16-bit PCM; several channels are averaged."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("no RIFF file")
    at, rate, channels, samples = 12, None, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if kind != 1 or bits != 16:
                raise ValueError("only 16-bit PCM is read")
        elif name == b"data":
            samples = np.frombuffer(data, "<i2", min(size, len(data) - at - 8) // 2, at + 8)
        at += 8 + size + size % 2
    if rate is None or samples is None:
        raise ValueError("a file without format or data")
    n = len(samples) // channels * channels
    return rate, samples[:n].reshape(-1, channels).mean(axis=1)


def wave_bytes(samples: np.ndarray, rate: int) -> bytes:
    body = np.clip(np.rint(samples), -32768, 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(body)) + body


def read_waves(files: DataFrame, span: int = SPAN) -> DataFrame:
    """(utt, rate, block, x) of files (path, content)."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rate, x = wave(data)
                for k in range(0, len(x), span):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rate], pa.int32()), pa.array([k // span]), pa.array([x[k : k + span].tolist()], pa.list_(pa.float64()))], names=["utt", "rate", "block", "x"])

    return files.select("path", "content").mapInArrow(run, "utt string, rate int, block long, x array<double>")


def in_blocks(pieces: DataFrame, span: int = SPAN) -> DataFrame:
    """(utt, block, x) of pieces (utt, at, x) of any length, which begin at the sample at and do not overlap."""
    last = F.floor((F.col("at") + F.size("x") - 1) / span)
    rows = pieces.where("size(x) > 0").select("utt", "at", "x", F.explode(F.sequence(F.floor(F.col("at") / span), last)).alias("block"))
    begin = F.greatest(F.lit(0), F.col("block") * span - F.col("at"))
    rows = rows.select("utt", "block", "at", F.slice("x", (begin + 1).cast("int"), F.least(F.lit(span), (F.col("block") + 1) * span - F.col("at")).cast("int")).alias("x"))
    whole = rows.groupBy("utt", "block").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("p"))  # span samples at most
    return whole.select("utt", "block", F.flatten("p.x").alias("x"))


def with_halo(blocks: DataFrame, before: int, after: int, span: int = SPAN) -> DataFrame:
    """(utt, block, x, lead, own): blocks with up to before samples in front (so many: lead) and up to after behind; own of them are the block's."""
    if max(before, after) > span:
        raise ValueError("a halo is longer than a block")
    each = F.array(
        F.struct(F.col("block").alias("block"), F.lit(1).alias("side"), F.col("x").alias("x")),
        F.struct((F.col("block") + 1).alias("block"), F.lit(0).alias("side"), F.slice("x", F.greatest(F.lit(1), F.size("x") - before + 1), F.lit(before)).alias("x")),
        F.struct((F.col("block") - 1).alias("block"), F.lit(2).alias("side"), F.slice("x", F.lit(1), F.lit(after)).alias("x")),
    )
    rows = blocks.select("utt", F.explode(each).alias("e")).select("utt", "e.*")
    part = lambda k: F.first(F.when(F.col("side") == k, F.col("x")), True)
    nothing = F.array().cast("array<double>")
    met = rows.groupBy("utt", "block").agg(part(1).alias("o"), F.coalesce(part(0), nothing).alias("a"), F.coalesce(part(2), nothing).alias("b")).where("o is not null")
    return met.select("utt", "block", F.concat("a", "o", "b").alias("x"), F.size("a").alias("lead"), F.size("o").alias("own"))


def low_pass(up: int, down: int, half: int = 16) -> np.ndarray:
    """A windowed sinc filter for a change of the rate by up / down, with half zero crossings on each side."""
    wide = half * max(up, down)
    k = np.arange(-wide, wide + 1)
    return up / max(up, down) * np.sinc(k / max(up, down)) * (0.5 + 0.5 * np.cos(np.pi * k / (wide + 1)))


def resample(blocks: DataFrame, up: int, down: int, half: int = 16, span: int = SPAN) -> DataFrame:
    """(utt, at, x): the signal at up / down times its rate, in pieces; sample m is the sum over k of x[k] h[m down - k up].

    Only the taps that meet a sample are multiplied (a polyphase filter), about 2 half max(1, down / up) for each sample.
    """
    common = int(np.gcd(up, down))
    up, down = up // common, down // common
    h = low_pass(up, down, half)
    centre = len(h) // 2
    reach = centre // up + 1
    taps = 2 * centre // up + 2

    def run(batches):
        for batch in batches:
            for name, block, x, lead, own in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                first = block * span
                m = np.arange(-(-first * up // down), -(-(first + own) * up // down))
                k = -(-(m * down - centre) // up)[:, None] + np.arange(taps)[None, :]
                tap = m[:, None] * down - k * up + centre
                at = k - (first - lead)
                good = (tap >= 0) & (tap < len(h)) & (at >= 0) & (at < len(x))
                y = np.where(good, np.array(x)[np.clip(at, 0, len(x) - 1)] * h[np.clip(tap, 0, len(h) - 1)], 0.0).sum(axis=1)
                if len(m):
                    yield pa.RecordBatch.from_arrays([pa.array([name], batch.schema.field(0).type), pa.array([int(m[0])]), pa.array([y.tolist()], pa.list_(pa.float64()))], names=["utt", "at", "x"])

    schema = T.StructType([T.StructField("utt", blocks.schema["utt"].dataType), T.StructField("at", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    return with_halo(blocks, min(span, reach), min(span, reach), span).mapInArrow(run, schema)


@dataclass
class FrontEnd:
    """Frames of wide samples every hop samples; size of the transform; mel filters from low to high Hz; cepstra, the one of order 0 first."""

    rate: int = 8000
    wide: int = 200
    hop: int = 80
    size: int = 256
    filters: int = 23
    low: float = 64.0
    high: float = 4000.0
    cepstra: int = 13
    emphasis: float = 0.97
    floor: float = 1e-10

    def mel_filters(self) -> np.ndarray:
        """A triangle for each filter over the bins of the spectrum, evenly spaced on the mel scale."""
        mel = lambda f: 1127.0 * np.log(1 + np.asarray(f, float) / 700.0)
        edge = np.linspace(mel(self.low), mel(self.high), self.filters + 2)
        bins = mel(np.arange(self.size // 2 + 1) * self.rate / self.size)
        up = (bins[None, :] - edge[:-2, None]) / (edge[1:-1] - edge[:-2])[:, None]
        fall = (edge[2:, None] - bins[None, :]) / (edge[2:] - edge[1:-1])[:, None]
        return np.maximum(0, np.minimum(up, fall))

    def cosines(self) -> np.ndarray:
        m = np.arange(self.filters)
        return np.sqrt(2.0 / self.filters) * np.cos(np.pi * np.arange(self.cepstra)[:, None] * (m[None, :] + 0.5) / self.filters)

    def window(self) -> np.ndarray:
        return 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(self.wide) / (self.wide - 1))

    def features(self, x: np.ndarray) -> np.ndarray:
        """Cepstra of frames, a row each."""
        before = np.concatenate((x[:, :1], x[:, :-1]), axis=1)
        power = np.abs(np.fft.rfft((x - self.emphasis * before) * self.window(), self.size, axis=1)) ** 2
        return np.log(np.maximum(power @ self.mel_filters().T, self.floor)) @ self.cosines().T


def cepstra(blocks: DataFrame, front: FrontEnd, span: int = SPAN) -> DataFrame:
    """(utt, t, x): the cepstra of the overlapping frames of a signal; frame t begins at sample t * hop."""

    def run(batches):
        for batch in batches:
            for name, block, x, lead, own in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                first, x = block * span, np.array(x[lead:], float)
                t = np.arange(-(-first // front.hop), -(-(first + own) // front.hop))
                t = t[t * front.hop - first + front.wide <= len(x)]
                if not len(t):
                    continue
                y = front.features(x[(t * front.hop - first)[:, None] + np.arange(front.wide)[None, :]])
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(t), batch.schema.field(0).type), pa.array(t.astype(np.int64)), rows], names=["utt", "t", "x"])

    if front.wide > front.size:
        raise ValueError("a frame is longer than the transform")
    schema = T.StructType([T.StructField("utt", blocks.schema["utt"].dataType), T.StructField("t", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    return with_halo(blocks, 0, min(span, front.wide), span).mapInArrow(run, schema)
