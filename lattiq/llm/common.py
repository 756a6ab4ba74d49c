"""Plumbing shared by the corpus operators: scratch tables, byte hashing, intervals.

Large intermediate results are cut with Parquet tables in the shared folder that the
session names in ``spark.checkpoint.dir``; a lost executor then costs the tasks of one
step.  Every helper works on one document at a time, so memory is bounded by the longest
text and by the Arrow batch (``ARROW_ROWS`` rows).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that Spark hands to Python at a time: bounds a worker's memory on long texts.
ARROW_ROWS = 512
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Base of the polynomial byte hash (odd, so that it has an inverse modulo 2**64).
BASE = 0x9E3779B97F4A7C15


def tune(spark: SparkSession) -> None:
    """Session settings that the operators rely on; all are runtime SQL settings."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    # shuffle files of a finished query go at its end; what is kept stands in scratch tables
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


class Scratch:
    """Named Parquet tables in the shared checkpoint folder."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        tune(spark)
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="lattiq-")  # one machine, one process, as in tests
            spark.conf.set("spark.checkpoint.dir", root)
        self.spark, self.path = spark, f"{root.rstrip('/')}/lattiq-{label}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)  # what the result still reads goes with the driver

    def keep(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        df.write.mode("overwrite").option("compression", codec).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Keys with more rows than this, or than 1 / HOT_SHARE of all rows, are joined by a broadcast of at most HOT_SHARE keys.
HOT_ROWS = 500
HOT_SHARE = 50_000


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], size: str) -> DataFrame:
    """rows joined with a table of their keys, whose column size counts the rows of each key.

    Both are scratch tables.  Rows of hot keys meet a broadcast and stay where they are; the others
    are shuffled.  No more than HOT_SHARE keys can be hot, whatever the rows.
    """
    hot = F.col(size) > max(HOT_ROWS, rows.count() // HOT_SHARE)
    if table.where(hot).isEmpty():
        return rows.join(table.drop(size), keys)
    large = F.broadcast(table.where(hot).drop(size))
    return rows.join(large, keys).unionByName(rows.join(large.select(*keys), keys, "left_anti").join(table.where(~hot).drop(size), keys))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened by underscores until no column of df has them (in any case)."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def below(share: float) -> int:
    """The bound for a hash of 63 bits below which a share of all rows lies; fine enough for any table."""
    return min((1 << 63) - 1, max(0, int(share * (1 << 63))))


def chosen(share, *cols):
    """Rows in a sample of about that share, by a hash of the columns; share is a number or a column of bounds from ``below``."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 1) < (share if not isinstance(share, (int, float)) else F.lit(below(share)))


def lower_az(col):
    """Lower-case A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(col, F.lit("")), UPPER, LOWER)


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n at least."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for key, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            out = np.ones(size, np.uint64)
            done, factor = 1, base
            while done < size:
                out[done : 2 * done] = out[:done] * np.uint64(factor)
                done, factor = 2 * done, factor * factor % (1 << 64)
            _powers[key] = out
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of one text, joined by single spaces, with span hashes."""

    def __init__(self, text: str | None, lower: bool) -> None:
        raw = (text or "").encode("utf-8", "surrogatepass")
        parts = (raw.lower() if lower else raw).split()  # bytes: splits at exactly those six characters, lowers A-Z alone
        self.n = len(parts)
        self.data = b" ".join(parts)
        buf = np.frombuffer(self.data, np.uint8)
        gaps = np.flatnonzero(buf == 32)
        self.start = np.concatenate(([0], gaps + 1)) if self.n else np.zeros(0, np.int64)
        self.end = np.concatenate((gaps, [len(buf)])) if self.n else np.zeros(0, np.int64)
        self._buf, self._sum = buf, None

    def spans(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of the words first..last (inclusive), as int64."""
        up, down = powers(len(self._buf) + 1)
        if self._sum is None:
            self._sum = np.zeros(len(self._buf) + 1, np.uint64)
            np.cumsum((self._buf.astype(np.uint64) + np.uint64(1)) * up[: len(self._buf)], out=self._sum[1:])
        a, b = self.start[first], self.end[last]
        h = (self._sum[b] - self._sum[a]) * down[a]
        return mix(h + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all runs of k consecutive words."""
        if self.n < k:
            return np.zeros(0, np.int64)
        i = np.arange(self.n - k + 1)
        return self.spans(i, i + k - 1)


def window_runs(h: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts that share their leftmost minimum.

    For each p, the minimum of h over p .. p+w-1 depends on the window's content alone, so
    equal windows choose it at equal offsets.  Returns (first p, last p, position of the
    minimum) of each run; a run has at most w starts.
    """
    key = (h.view(np.uint64) & np.uint64(0xFFFFFFFF80000000)) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size * 2 <= w:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < w:
        key = np.minimum(key[: len(key) - (w - size)], key[w - size :])
    at = (key & np.uint64(0x7FFFFFFF)).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
    last = np.concatenate((first[1:] - 1, [len(at) - 1]))
    return first, last, at[first]


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal intervals of a union of half-open intervals (touching ones join)."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], start[1:] > end[:-1]))
    return start[new], end[np.concatenate((new[1:], [True]))]


def rows_of(batches: Iterator, *names: str) -> Iterator[list[tuple]]:
    """The rows of each Arrow batch as a list of tuples of Python values."""
    for batch in batches:
        yield list(zip(*(batch.column(n).to_pylist() for n in names), strict=True))


def arrow(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
