"""Operator 5, removal of repeated byte strings by bucket-pointer refinement.

A byte goes when a string of LENGTH bytes that covers it also starts somewhere else.
Suffixes are put into q-gram buckets and the buckets are refined by the bucket identifiers
of later offsets, as in bucket-pointer refinement.  So that this needs neither all suffixes
nor a global array, a bucket's identifier is a hash of its string, the same on every
executor, and the work goes from coarse to fine, each level over what the last one left
open:

1. Every window of LENGTH bytes names its leftmost minimal q-gram hash.  Windows side by
   side with the same minimum form a run; the run enters the bucket of that q-gram.  Equal
   windows always meet in one bucket, so buckets of one run are finished.
2. Runs of a bucket are refined by the identifier of the run's whole string.  Runs that
   stay together are repeated as a whole; runs that are alone in a bucket of several are
   left open.
3. The windows of open runs are refined against the other runs of their bucket: positions
   are numbered by their q-gram buckets, then pairs of numbers at p and p + 64 give the
   128-byte buckets, and pairs of those at p and p + 72 the 200-byte buckets.  Buckets of up
   to GROUP_RUNS different runs are numbered inside tasks; the positions of larger ones are
   rows, which get the same pairs as hashed bucket identifiers, and each level counts its
   buckets by a partial aggregate and leaves what is alone, so no bucket is gathered.

Defined cases: a null text is empty; texts below LENGTH bytes keep everything; very long
texts are read whole; repeated rows are each other's copies; rows that share an id, or have
a null one, are texts of their own and lose what the others hold; an empty table gives an
empty result; other columns do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattiq.llm.common import BASE, Scratch, arrow, documents, join_hot, merged, mix, powers, rows_of, window_runs

LENGTH = 200
Q = 64
#: Different runs of a bucket that a task holds; so many runs of about 270 bytes take some 150 MB of a worker.
GROUP_RUNS = 8_000


def prefix_sums(data: bytes) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def strings(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Identifiers of the strings start .. end."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def all_strings(sums: np.ndarray, n: int) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[n:] - sums[:-n]) * down[: len(sums) - n])


def identifiers(sums: np.ndarray, length: int) -> list[np.ndarray]:
    """Bucket identifiers of all places at each level: of Q bytes, then by pairs with the identifier at a later offset, up to length."""
    out, reach = [all_strings(sums, Q)], Q
    while reach < length:
        step = min(reach, length - reach)
        reach += step
        out.append(mix(out[-1][:-step] * np.uint64(BASE) + out[-1][step:]))
    return out


def source_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, text): the key tells rows apart whatever their ids; rows that repeat id and text share it, and all they lose."""
    return docs.select(F.xxhash64(id_col, text_col).alias("id"), F.col(text_col).alias("text"))


def runs(source: DataFrame, length: int) -> DataFrame:
    schema = pa.schema([("bucket", pa.int64()), ("whole", pa.int64()), ("id", pa.int64()), ("at", pa.int32()), ("n", pa.int16())])

    def scan(batches):
        for rows in rows_of(batches, "id", "text"):
            for key, text in rows:
                data = text.encode("utf-8", "surrogatepass")
                if len(data) < length:
                    continue
                sums = prefix_sums(data)
                grams = all_strings(sums, Q)
                first, last, low = window_runs(grams, length - Q + 1)
                yield pa.RecordBatch.from_arrays([pa.array(grams[low].view(np.int64)), pa.array(strings(sums, first, last + length).view(np.int64)), pa.array(np.full(len(first), key)), pa.array(first.astype(np.int32)), pa.array((last - first + 1).astype(np.int16))], schema=schema)

    return source.where(f"octet_length(text) >= {length}").mapInArrow(scan, "bucket long, whole long, id long, at int, n smallint")


def refine(contexts: list[tuple], length: int) -> list[tuple]:
    """Covered intervals of the open runs among (open, id, at, bytes) whose buckets are complete."""
    data = b"".join(c[3] for c in contexts)
    size = np.array([len(c[3]) for c in contexts])
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(contexts)), size)
    place = np.arange(len(data)) - begin[owner]
    room = size[owner] - place
    number = np.unique(all_strings(prefix_sums(data), Q), return_inverse=True)[1].astype(np.uint64)
    reach = Q
    at = np.flatnonzero(room >= reach)
    at = at[at < len(number)]
    level = np.full(len(data), 0, np.uint64)
    level[at] = number[at]
    while reach < length:
        step = min(reach, length - reach)  # the later offset whose bucket number refines this one
        at = at[room[at] >= reach + step]
        pairs = level[at] << np.uint64(32) | level[at + step]
        new, n = np.unique(pairs, return_inverse=True, return_counts=True)[1:]
        reach += step
        if reach < length:
            nxt = np.zeros(len(data), np.uint64)
            nxt[at] = new.astype(np.uint64)
            level = nxt
        else:
            at = at[n[new] > 1]
    open_ = np.array([c[0] for c in contexts])
    at = at[open_[owner[at]]]
    out = []
    for i in np.unique(owner[at]):
        p = place[at[owner[at] == i]]
        a, b = merged(p, p + length)
        out += [(contexts[i][1], contexts[i][2] + int(x), contexts[i][2] + int(y)) for x, y in zip(a, b, strict=True)]
    return out


SPAN = pa.schema([("id", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])


def covered(docs: DataFrame, id_col: str, text_col: str, length: int, scratch: Scratch) -> DataFrame:
    """Intervals (id, a, b) whose union is all bytes to be removed."""
    source = source_of(docs, id_col, text_col)
    found = scratch.keep(runs(source, length), "runs")
    buckets = scratch.keep(found.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1"), "buckets")
    hits = scratch.keep(join_hot(found, buckets, ["bucket"], "k"), "hits")
    scratch.drop("runs", "buckets")
    kinds = scratch.keep(hits.groupBy("bucket", "whole").agg(F.count("*").alias("k"), F.min(F.struct("id", "at", "n")).alias("one")), "kinds")
    twice = join_hot(hits, kinds.where("k > 1").select("bucket", "whole", "k"), ["bucket", "whole"], "k")
    full = twice.select("id", F.col("at").alias("a"), (F.col("at") + F.col("n") - 1 + length).cast("int").alias("b"))
    mixed = kinds.groupBy("bucket").agg(F.count("*").alias("kinds"), F.count_if(F.col("k") == 1).alias("alone")).where("kinds > 1 and alone > 0")
    mixed = scratch.keep(mixed.withColumn("size", F.col("kinds")), "mixed")
    todo = join_hot(kinds, mixed, ["bucket"], "size").select("bucket", (F.col("k") == 1).alias("open"), (F.col("kinds") > GROUP_RUNS).alias("large"), "one.id", "one.at", "one.n")
    by_doc = todo.groupBy("id").agg(F.collect_list(F.struct("bucket", "open", "large", "at", "n")).alias("todo"))
    texts = source.where(f"octet_length(text) >= {length}")  # of repeated rows all come; only strings that occur twice anyway are counted more often

    def cut(batches):
        schema = pa.schema([("bucket", pa.int64()), ("open", pa.bool_()), ("large", pa.bool_()), ("id", pa.int64()), ("at", pa.int32()), ("data", pa.binary())])
        for rows in rows_of(batches, "id", "text", "todo"):
            for key, text, todo in rows:
                data = (text or "").encode("utf-8", "surrogatepass")
                out = [(t["bucket"], t["open"], t["large"], key, t["at"], data[t["at"] : t["at"] + t["n"] - 1 + length]) for t in todo]
                yield arrow(schema, out)

    cuts = scratch.keep(by_doc.join(texts, "id").mapInArrow(cut, "bucket long, open boolean, large boolean, id long, at int, data binary"), "cuts", "zstd")

    def in_memory(batches):
        held, bucket, size = [], None, 0
        for rows in rows_of(batches, "bucket", "open", "id", "at", "data"):
            for r in rows:
                if size > 1_000_000 and r[0] != bucket:
                    yield arrow(SPAN, refine(held, length))
                    held, size = [], 0
                bucket = r[0]
                held.append(r[1:])
                size += len(r[4])
        if held:
            yield arrow(SPAN, refine(held, length))

    levels = [f"level{i}" for i in range(1, len(identifiers(prefix_sums(b" " * length), length)))]

    def by_rows(batches):
        schema = pa.schema([*((n, pa.int64()) for n in levels), ("open", pa.bool_()), ("id", pa.int64()), ("a", pa.int32())])
        for rows in rows_of(batches, "open", "id", "at", "data"):
            for open_, key, at, data in rows:
                k = len(data) - length + 1
                h = [x[:k].view(np.int64) for x in identifiers(prefix_sums(data), length)[1:]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, h), pa.array([open_] * k), pa.array(np.full(k, key)), pa.array((at + np.arange(k)).astype(np.int32))], schema=schema)

    small = cuts.where("not large").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(in_memory, "id long, a int, b int")
    out = full.unionByName(small)
    if cuts.where("large").isEmpty():
        return out
    places = scratch.keep(cuts.where("large").mapInArrow(by_rows, ", ".join(f"{n} long" for n in levels) + ", open boolean, id long, a int"), "places")
    for n in levels:  # a bucket of one is finished; what stays is refined by the next level
        again = scratch.keep(places.groupBy(n).agg(F.count("*").alias("k")).where("k > 1"), f"again-{n}")
        places = scratch.keep(join_hot(places, again, [n], "k"), f"places-{n}")
    return out.unionByName(places.where("open").select("id", "a", (F.col("a") + length).cast("int").alias("b")))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep: list[str] | None = None) -> DataFrame:
    """Each row's columns in keep, n_bytes, n_removed, n_spans, kept_sha256, and kept: the bytes that stay."""
    scratch = Scratch(docs.sparkSession, "bytes")
    spans = scratch.keep(covered(docs, id_col, text_col, length, scratch), "spans")
    scratch.drop("hits", "kinds", "mixed", "cuts", "places", *(f"{x}-level{i}" for x in ("again", "places") for i in (1, 2)))
    by_doc = spans.groupBy("id").agg(F.collect_list(F.struct("a", "b")).alias("_spans"))
    kept = F.struct(*(keep or [id_col])).alias("_kept")
    rows = docs.select(kept, F.xxhash64(id_col, text_col).alias("id"), F.col(text_col).alias("_text")).join(by_doc, "id", "left")
    kind = T.StructType([rows.schema["_kept"], *(T.StructField(n, t) for n, t in (("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType()), ("kept", T.BinaryType())))])

    def cut(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("_text").to_pylist(), batch.column("_spans").to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                n, removed = 0, 0
                if spans:
                    a, b = merged(np.array([s["a"] for s in spans]), np.array([s["b"] for s in spans]))
                    a, b = np.minimum(a, len(data)), np.minimum(b, len(data))
                    n, removed = len(a), int((b - a).sum())
                    edges = [0, *np.stack([a, b], 1).ravel().tolist(), len(data)]
                    data, whole = b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)), len(data)
                else:
                    whole = len(data)
                out.append((whole, removed, n, hashlib.sha256(data).hexdigest(), data))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("_kept"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))], names=["_kept", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.mapInArrow(cut, kind).select("_kept.*", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir)).drop("kept")


SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '.{1,400}') AS b FROM documents),
blocks AS (SELECT doc_id, generate_subscripts(b, 1) AS k, unnest(b) AS x FROM d),
two AS (SELECT doc_id, k, x || coalesce(lead(x) OVER (PARTITION BY doc_id ORDER BY k), '') AS y FROM blocks),
win AS (SELECT doc_id, (k - 1) * 200 + o + 1 AS i, md5(substr(y, 2 * o + 1, 400)) AS g FROM two, range(0, 200) t(o) WHERE 2 * o + 400 <= length(y)),
bytes AS (SELECT doc_id, (k - 1) * 200 + o + 1 AS p, substr(x, 2 * o + 1, 2) AS byte FROM blocks, range(0, 200) t(o) WHERE 2 * o < length(x)),
again AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
starts AS (SELECT doc_id, i FROM win SEMI JOIN again USING (g)),
marked AS (SELECT x.doc_id, byte, p, starts.i IS NOT NULL AS start FROM bytes x LEFT JOIN starts ON starts.doc_id = x.doc_id AND starts.i = p),
cut AS (SELECT doc_id, byte, p, coalesce(p - max(CASE WHEN start THEN p END) OVER (PARTITION BY doc_id ORDER BY p) < 200, false) AS gone FROM marked),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM cut),
kept AS (SELECT doc_id, count(*) AS n, count_if(gone) AS r, count_if(opens) AS s, coalesce(string_agg(byte, '' ORDER BY p) FILTER (NOT gone), '') AS h FROM runs GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_bytes, coalesce(r, 0)::BIGINT AS n_removed, coalesce(s, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(h, ''))) AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)
"""
