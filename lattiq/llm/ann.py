"""Operator 8, approximate nearest neighbours with an inverted multi-index.

The two halves of a vector are quantised separately; a pair of centroids is a cell.  For a
query, a heap walks the pairs in order of summed squared distance until the cells hold a
share of all rows; all rows of these cells are reranked by exact Euclidean distance in
double precision.  The share follows a measured recall: on a bounded sample, the neighbours
by brute force of up to TRIAL_QUERIES rows must lie within it for RECALL of all of them.  So
it is large where vectors are close to random directions and small where they cluster.

Centroids and share are fitted on a sample of about SAMPLE_ROWS rows (by hash of id and
vector); there are CENTROIDS times the fourth root of the rows of each half, MOST_CENTROIDS
at most.  Every row is indexed.  Cells are dealt into parts of about PART_BYTES; a cell above
that, as a common vector makes, is split over several.  A task holds one part at a time and
lets all queries that probe it pass by in batches, so no vector is sent more than once and a
query once for each part that it probes; ten rows a query and part come out.

Defined cases: vectors that are null, of length zero, hold null or non-finite components
or have another length than most take no part, nor do rows with a null id; a row repeated
with one id counts as a candidate each time and as a query once; a query's own id is never
its answer; with fewer candidates than k all are returned; an empty table gives an empty
result; other columns do not matter.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattiq.llm.common import Scratch, chosen

CENTROIDS = 4
MOST_CENTROIDS = 256
SAMPLE_ROWS = 20_000
RECALL = 0.96
TRIAL_QUERIES = 400
#: Rows that a query reranks at least, in multiples of k.
LEAST = 10
PART_BYTES = 16_000_000


def kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Centroids of the rows of x; fewer than k where x has fewer different rows."""
    x = np.unique(x, axis=0)
    c = x[np.random.default_rng(1).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = nearest(x, c).argmin(1)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids."""
    return (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)


def matrix(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def walk(left: np.ndarray, right: np.ndarray, counts: np.ndarray, want: int) -> list[int]:
    """Cells in order of left + right distance until their rows reach want (multi-sequence walk)."""
    a, b = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    out, have = [], 0
    heap, seen = [(left[a[0]] + right[b[0]], 0, 0)], {(0, 0)}
    while heap and have < want:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(right) + int(b[j])
        if counts[cell]:
            out.append(cell)
            have += int(counts[cell])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (left[a[x]] + right[b[y]], x, y))
    return out


def cells_of(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    half = lo.shape[1]
    return nearest(x[:, :half], lo).argmin(1) * len(hi) + nearest(x[:, half:], hi).argmin(1)


def share_for(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int) -> float:
    """The share of rows that the nearest cells must hold for RECALL of the k nearest rows, measured on the sample x."""
    if len(x) <= k + 1:
        return 1.0
    half = lo.shape[1]
    cell = cells_of(x, lo, hi)
    counts = np.bincount(cell, minlength=len(lo) * len(hi))
    need = []
    for i in np.random.default_rng(2).permutation(len(x))[:TRIAL_QUERIES]:
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        near = np.argpartition(d, k)[:k]
        order = np.argsort((nearest(x[i : i + 1, :half], lo)[0][:, None] + nearest(x[i : i + 1, half:], hi)[0]).ravel(), kind="stable")
        upto = np.empty(len(order))
        upto[order] = np.cumsum(counts[order])
        need.append(upto[cell[near]] / len(x))
    return float(np.quantile(np.concatenate(need), RECALL))


ENTRY = "part int, query boolean, id long, v array<double>, cell int, cells array<int>"


def search(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest rows found for each query: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    schema = "query_id long, rank int, vec_id long, score double"
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = vectors.where(F.col(id_col).isNotNull() & v.isNotNull()).where(finite & F.exists(v, lambda x: x != 0)).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"), is_query.alias("q"))
    dims = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return spark.createDataFrame([], schema)
    dim, total = dims["d"], dims["count"]
    half = dim // 2
    good = good.where(F.size("v") == dim)
    sample = good if total <= SAMPLE_ROWS else good.where(chosen(SAMPLE_ROWS / total, "id", "v"))
    x = matrix(sample.select("v").toArrow()["v"], dim)
    centroids = max(2, min(MOST_CENTROIDS, int(CENTROIDS * total**0.25)))
    books = (kmeans(x[:, :half], centroids), kmeans(x[:, half:], centroids))
    want = max(LEAST * k, int(np.ceil(share_for(x, *books, k) * total)))
    book = spark.sparkContext.broadcast(books)

    def assign(batches):
        lo, hi = book.value
        for batch in batches:
            if batch.num_rows:
                cell = cells_of(matrix(batch.column("v"), dim), lo, hi)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), batch.column("q"), pa.array(cell.astype(np.int32))], names=["id", "v", "q", "cell"])

    index = scratch.keep(good.mapInArrow(assign, "id long, v array<double>, q boolean, cell int"), "index")
    counts = np.zeros(len(books[0]) * len(books[1]), np.int64)
    for r in index.groupBy("cell").count().collect():  # at most MOST_CENTROIDS**2 rows
        counts[r["cell"]] = r["count"]
    # deal cells into parts: small ones share a part, large ones are split
    full = max(1000, PART_BYTES // (8 * dim))
    first, pieces, part, room = np.zeros(len(counts), int), np.ones(len(counts), int), 0, full
    for cell in np.flatnonzero(counts):
        if counts[cell] > full:
            pieces[cell] = -(-int(counts[cell]) // full)
            part += room < full
            first[cell], part, room = part, part + int(pieces[cell]), full
            continue
        if counts[cell] > room:
            part, room = part + 1, full
        first[cell] = part
        room -= counts[cell]
    deal = spark.createDataFrame([(int(c), int(first[c]), int(pieces[c])) for c in np.flatnonzero(counts)], "cell int, first int, pieces int")
    rows = index.join(F.broadcast(deal), "cell").select((F.col("first") + F.pmod(F.xxhash64("id"), F.col("pieces"))).cast("int").alias("part"), F.lit(False).alias("query"), "id", "v", "cell", F.lit(None).cast("array<int>").alias("cells"))
    plan = spark.sparkContext.broadcast((books, counts, first, pieces))

    def probe(batches):
        (lo, hi), counts, first, pieces = plan.value
        for batch in batches:
            if not batch.num_rows:
                continue
            m = matrix(batch.column("v"), dim)
            left, right = nearest(m[:, :half], lo), nearest(m[:, half:], hi)
            out = []
            for i, (key, vec) in enumerate(zip(batch.column("id").to_pylist(), batch.column("v").to_pylist(), strict=True)):
                by: dict[int, list[int]] = {}
                for cell in walk(left[i], right[i], counts, want):
                    for p in range(first[cell], first[cell] + pieces[cell]):
                        by.setdefault(int(p), []).append(cell)
                out += [(p, True, key, vec, None, cells) for p, cells in by.items()]
            cols = list(zip(*out, strict=True))
            kinds = (pa.int32(), pa.bool_(), pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["part", "query", "id", "v", "cell", "cells"])

    queries = index.where("q").groupBy("id").agg(F.min("v").alias("v")).repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "id")
    probes = queries.mapInArrow(probe, ENTRY)

    def rerank(batches):
        name, held, ready = None, [], None
        for batch in batches:
            part, query = batch.column("part").to_numpy(), batch.column("query").to_numpy(zero_copy_only=False)
            out: list[tuple[int, int, float]] = []
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (query[1:] != query[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if hi == lo:
                    continue
                piece = batch.slice(lo, hi - lo)
                if part[lo] != name:
                    name, held, ready = part[lo], [], None
                if not query[lo]:
                    held.append((piece.column("id").to_numpy(), piece.column("cell").to_numpy(), matrix(piece.column("v"), dim)))
                    continue
                if ready is None and held:
                    ids, cell, m = (np.concatenate(c) for c in zip(*held, strict=True))
                    order = np.argsort(cell, kind="stable")
                    ready, held = (ids[order], cell[order], m[order], (m[order] ** 2).sum(1)), []
                if ready is not None:
                    ids, cell, m, norms = ready
                    q = matrix(piece.column("v"), dim)
                    for key, cells, vec in zip(piece.column("id").to_pylist(), piece.column("cells").to_pylist(), q, strict=True):
                        cells = np.array(cells)
                        begin, end = np.searchsorted(cell, cells), np.searchsorted(cell, cells, side="right")
                        at = np.concatenate([np.arange(a, b) for a, b in zip(begin, end, strict=True)])
                        at = at[ids[at] != key]
                        if not len(at):
                            continue
                        rough = norms[at] - 2 * (m[at] @ vec) + vec @ vec
                        if len(at) > k:  # all that rounding could let into the first k
                            at = at[rough <= np.partition(rough, k - 1)[k - 1] + 1e-9 * (1 + vec @ vec)]
                        score = np.sqrt(((m[at] - vec) ** 2).sum(1))
                        best = np.lexsort((ids[at], score))[:k]
                        out += [(key, int(ids[at[b]]), float(score[b])) for b in best]
            cols = list(zip(*out, strict=True)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "vec_id", "score"])

    both = rows.unionByName(probes).repartition("part").sortWithinPartitions("part", "query")
    found = both.mapInArrow(rerank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, F.col("vec_id") % 100 == 0)
