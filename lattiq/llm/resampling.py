"""Operator 13, importance resampling towards a target distribution by external sort-count.

Features are the runs of 1 to 2 consecutive words; each falls into one of BUCKETS buckets by its CRC-32.

1. Texts are read once.  Each batch writes its features as one packed stream of 16-bit buckets, with the
   offsets of its documents, to a scratch table; nothing of the texts is needed later.
2. Streams are sorted and run-length encoded.  A task merges the runs of its streams, so that at most BUCKETS
   rows a task are shuffled, and sums of runs are the counts of all documents.
3. The gain of a bucket compares its share in the target with its share in the documents; there are BUCKETS of them,
   whatever the input.  Streams are read again, gains are gathered, and ``np.add.reduceat`` over the offsets sums
   those of each document.
4. Gumbel noise from a hash of the id makes the highest scores a sample without replacement.  Documents are numbered
   in range partitions, one row a partition meets the others.

The CRC of two words follows from the CRCs of the words by linearity, so each distinct word of a batch is summed
once and pairs are vectorised.

Defined cases: null texts and texts without words have no features and weight 0; documents of fewer than LEAST_WORDS words are
scored and never drawn; very long texts fill a stream of their own; repeated rows are documents each by itself; null ids hash as
empty text and come last among ties; an empty table of documents gives an empty result, and an empty target gives
gains from its smoothing alone; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.llm.common import Scratch, arrow, documents, rows_of
from lattiq.operators.steps import numbered

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
#: Features that a stream holds at least before it is written, unless its batch ends: 2 bytes each.
STREAM = 1 << 20

_WORD = bytes([b for b in range(256) if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80])
_TABLE = bytes([b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD else 0x20 for b in range(256)])


def words_of(text: str | None) -> list[bytes]:
    """The words of a text: A-Z lowered, runs of digits, letters and bytes above 0x7F."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Pairs:
    """CRCs of ``a + b`` from those of a and b, by tables of the shift over len(b) bytes."""

    def __init__(self) -> None:
        self.tables = np.zeros((0, 4, 256), np.uint32)

    def reach(self, longest: int) -> None:
        """Tables for all lengths up to the longest; a shift over a byte more is one step of the CRC with a zero byte."""
        have = len(self.tables)
        if longest < have:
            return
        byte = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)  # what the lowest byte leaves
        out = np.zeros((max(longest + 1, 2 * have, 64), 4, 256), np.uint32)
        out[0] = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)
        out[:have] = self.tables
        for n in range(max(1, have), len(out)):
            out[n] = (out[n - 1] >> np.uint32(8)) ^ byte[out[n - 1] & np.uint32(255)]
        self.tables = out

    def joined(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        t = self.tables.reshape(-1)
        at = size.astype(np.int64) * 1024
        out = b.copy()
        for k in range(4):
            out ^= t[at + 256 * k + ((a >> np.uint32(8 * k)) & np.uint32(255))]
        return out


#: Words above this length get no tables; pairs that end in one are summed by themselves.
LONG_WORD = 1024


def stream_of(texts: list[list[bytes]], pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all features, where each text begins), for the words of some texts."""
    number: dict[bytes, int] = {}
    place = np.array([number.setdefault(w, len(number)) for words in texts for w in words], np.int64)
    n = np.array([len(words) for words in texts], np.int64)
    starts = np.concatenate(([0], np.cumsum(np.maximum(2 * n - 1, 0))))
    if not len(place):
        return np.zeros(0, np.uint16), starts
    crc = np.array([zlib.crc32(w) for w in number], np.uint32)
    spaced = np.array([zlib.crc32(b" ", c) for c in crc.tolist()], np.uint32)
    size = np.array([len(w) for w in number], np.int64)
    pairs.reach(min(int(size.max()), LONG_WORD))
    a, b = place[:-1], place[1:]
    two = pairs.joined(spaced[a], crc[b], np.minimum(size[b], LONG_WORD))
    by_place = list(number) if size.max() > LONG_WORD else []
    for i in np.flatnonzero(size[b] > LONG_WORD):
        two[i] = zlib.crc32(by_place[b[i]], int(spaced[a[i]]))
    inside = np.ones(len(place), bool)  # a pair begins at every word but the last of a text
    inside[np.cumsum(n)[n > 0] - 1] = False
    out = np.zeros(int(starts[-1]), np.uint16)
    begin = np.repeat(starts[:-1], n) + 2 * (np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n))
    out[begin] = crc[place] % BUCKETS
    out[begin[inside] + 1] = two[inside[:-1]] % BUCKETS
    return out, starts


STREAMS = pa.schema([("ids", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("stream", pa.binary())])


def streams(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(ids, words, starts, stream): packed buckets of some documents each, with the offsets of the documents."""

    def scan(batches):
        pairs = Pairs()

        def written(held):
            out, starts = stream_of([words for _, words in held], pairs)
            return arrow(STREAMS, [([key for key, _ in held], [len(words) for _, words in held], starts.tolist(), out.tobytes())])

        for rows in rows_of(batches, "id", "text"):
            held, size = [], 0
            for key, text in rows:
                held.append((key, words_of(text)))
                size += 2 * len(held[-1][1])
                if size >= STREAM:
                    yield written(held)
                    held, size = [], 0
            if held:
                yield written(held)

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(scan, "ids array<long>, words array<long>, starts array<long>, stream binary")


COUNTS = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])


def bucket_counts(packed: DataFrame) -> DataFrame:
    """(bucket, n) over all streams: each is sorted and run-length encoded, a task merges its runs."""

    def count(batches):
        bucket, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for rows in rows_of(batches, "stream"):
            for (data,) in rows:
                s = np.sort(np.frombuffer(data, np.uint16))
                if not len(s):
                    continue
                first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
                both, size = np.concatenate((bucket, s[first].astype(np.int64))), np.concatenate((n, np.diff(np.append(first, len(s)))))
                order = np.argsort(both, kind="stable")
                both, size = both[order], size[order]
                first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
                bucket, n = both[first], np.add.reduceat(size, first)
        yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(n)], schema=COUNTS)

    return packed.select("stream").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int]) -> np.ndarray:
    """floor(1000 ln) of the smoothed share in the target over that in the source, for each bucket."""
    s_all, t_all = sum(source.values()), sum(target.values())
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1) * (s_all + BUCKETS) / ((source.get(b, 0) + 1) * (t_all + BUCKETS)))) for b in range(BUCKETS)], np.int64)


def noise(key: int | None, seed: int) -> int:
    """Gumbel noise in thousandths, from the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORES = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_features", "n_words", "weight", "score")])


def scores(packed: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """(doc_id, n_features, n_words, weight, score) of every document in the streams."""

    def gather(batches):
        for rows in rows_of(batches, "ids", "words", "starts", "stream"):
            for ids, words, starts, data in rows:
                at = np.array(starts, np.int64)
                n = np.diff(at)
                total = np.zeros(len(ids), np.int64)
                if at[-1]:
                    total[n > 0] = np.add.reduceat(gain[np.frombuffer(data, np.uint16)], at[:-1][n > 0])
                weight = total // np.maximum(n, 1)
                score = weight + np.array([noise(key, seed) for key in ids], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n), pa.array(words, pa.int64()), pa.array(weight), pa.array(score)], schema=SCORES)

    return packed.mapInArrow(gather, "doc_id long, n_features long, n_words long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, n_words, weight, score, rank): every document, those drawn with their rank from 1.

    percent of the documents of least_words words are drawn, by the highest scores, ties to the smaller id.
    """
    scratch = Scratch(docs.sparkSession, "resampling")
    packed = scratch.keep(streams(docs, id_col, text_col), "streams", "zstd")
    aim = streams(target.select(F.lit(0).alias("id"), F.col(target_col).alias("text")), "id", "text")
    counted = lambda df: {r["bucket"]: r["n"] for r in bucket_counts(df).collect()}  # noqa: E731  BUCKETS rows at most
    every = scratch.keep(scores(packed, gains(counted(packed), counted(aim)), seed), "scores")
    scratch.drop("streams")
    able = F.col("n_words") >= least_words
    size = percent * every.where(able).count() // 100
    order = numbered(every.where(able).withColumn("_none", F.col("doc_id").isNull()), ["score desc", "_none", "doc_id", "weight", "n_features"], "_place")
    drawn = order.withColumn("rank", F.when(F.col("_place") < size, F.col("_place") + 1)).drop("_none", "_place")
    return drawn.unionByName(every.where(~able).withColumn("rank", F.lit(None).cast("long")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
