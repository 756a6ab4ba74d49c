"""Counts of the windows of words in sentences: packed blocks by bucket, so that words travel once a block."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of a bucket on average, at most, and of a block's chunk: what a task holds at a time.
BUCKET, CHUNK = 1 << 20, 1 << 21


def _key(columns: list[np.ndarray], size: int) -> np.ndarray:
    """A number for each row of numbers from -1 below size, in the rows' order."""
    key, span = columns[0].astype(np.int64) + 1, size + 1
    for c in columns[1:]:
        if span * (size + 1) >= 1 << 62:
            values, key = np.unique(key, return_inverse=True)
            span = len(values)
        key, span = key * (size + 1) + c + 1, span * (size + 1)
    return key


def _distinct(rows: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The different rows in their order, with sums of n."""
    key = _key(list(rows.T), size)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return rows[order[first]], np.add.reduceat(n[order], first)


def _narrow(x: np.ndarray) -> tuple[int, bytes]:
    """Bytes that a number takes, and the numbers by planes of bytes, which pack better."""
    top = int(x.max(initial=0))
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return width, x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def pack(rows: np.ndarray, n: np.ndarray, words: pa.Array) -> bytes:
    """A block of sorted rows of numbers of words (-1: none) with counts, and the words that it needs."""
    used = np.unique(rows[rows >= 0])
    local = np.where(rows >= 0, np.searchsorted(used, rows) + 1, 0)
    own = words.take(pa.array(used))
    lengths = pc.fill_null(pc.add(pc.binary_length(own), 1), 0).to_numpy()  # 0: a null
    text = own.buffers()[2]
    text = text.to_pybytes()[: np.maximum(lengths - 1, 0).sum()] if text is not None else b""
    columns = [np.diff(local[:, 0], prepend=0), *local.T[1:], n, lengths]
    parts = [_narrow(c) for c in columns]
    body = b"".join([*(x for _, x in parts), text])
    head = np.array([len(rows), rows.shape[1], len(used), len(body), *(w for w, _ in parts)], "<i8").tobytes()
    return head + pa.Codec("zstd", compression_level=3).compress(body, asbytes=True)


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Rows, counts and words of a block."""
    many, order, n_words, size = np.frombuffer(block, "<i8", 4).tolist()
    widths = np.frombuffer(block, "<i8", order + 2, 32).tolist()
    body = pa.Codec("zstd").decompress(memoryview(block)[32 + 8 * (order + 2) :], size, asbytes=True)
    at, columns = 0, []
    for k, width in enumerate(widths):
        count = many if k <= order else n_words
        planes = np.frombuffer(body, np.uint8, count * width, at).reshape(width, count)
        columns.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"<u{width}").astype(np.int64))
        at += count * width
    rows = (np.stack([np.cumsum(columns[0]), *columns[1:order]], axis=1) - 1).astype(np.int32)
    lengths = columns[-1]
    ends = np.concatenate([[0], np.cumsum(np.maximum(lengths - 1, 0))])
    words = pa.LargeStringArray.from_buffers(n_words, pa.py_buffer(ends.tobytes()), pa.py_buffer(body[at:]))
    return rows, columns[order], pc.if_else(pa.array(lengths > 0), words, None)


def _windows(lists: list[pa.Array], order: int) -> tuple[np.ndarray, pa.Array]:
    """The windows of up to order words at all places of sentences but the last (-1 behind the end), and the sorted words that they number."""
    sizes = np.concatenate([pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in lists]).astype(np.int64)
    coded = pa.concat_arrays([x.flatten().cast(pa.large_string()) for x in lists]).dictionary_encode("encode")
    by_word = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(by_word), np.int32)
    rank[by_word] = np.arange(len(by_word))
    flat, ends = rank[coded.indices.to_numpy()], np.repeat(np.cumsum(sizes), sizes)
    places = np.flatnonzero(np.arange(len(flat)) + 1 < ends)
    rows = np.full((len(places), order), -1, np.int32)
    for k in range(order):
        inside = places + k < ends[places]
        rows[inside, k] = flat[places[inside] + k]
    return rows, coded.dictionary.take(pa.array(by_word))


def packed_windows(order: int, buckets: int, common: list[str]) -> Callable:
    """From lists of words to (bucket, block): a window's bucket follows from its first word, or from two if that is common."""

    def blocks(lists: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        rows, words = _windows(lists, order)
        if not len(rows):
            return
        rows, n = _distinct(rows, np.ones(len(rows), np.int64), len(words))
        code = np.fromiter((crc32(b"" if (w := x.as_py()) is None else w.encode()) for x in words), np.uint64, len(words))
        two = pc.is_in(words, value_set=pa.array(common, pa.large_string())).to_numpy(zero_copy_only=False)
        mixed = np.where(two[rows[:, 0]], code[rows[:, 0]] + (code[rows[:, 1]] + np.uint64(1)) * np.uint64(0x9E3779B1), code[rows[:, 0]])
        bucket = (mixed % np.uint64(buckets)).astype(np.int64)
        dealt = np.argsort(bucket, kind="stable")
        rows, n, bucket = rows[dealt], n[dealt], bucket[dealt]
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([bucket[lo]], pa.int32()), pa.array([pack(rows[lo:hi], n[lo:hi], words)], pa.binary())], ["bucket", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            column = batch.column(0)
            step = max(1, len(column) * CHUNK // max(1, len(column.flatten())))
            for lo in range(0, len(column), step):
                held.append(column.slice(lo, step))
                size += len(held[-1].flatten())
                if size >= CHUNK:
                    yield from blocks(held)
                    held, size = [], 0
        if held:
            yield from blocks(held)

    return run


def counted_windows(order: int, common: dict[str, int]) -> Callable:
    """From all blocks of a bucket to (ord, words, n, total) of n-grams of two words and more: total is that of the n-grams with the same words before the last.

    common: places of common words before others; their windows lie in many buckets.
    """
    piece = 20_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [unpack(x.as_buffer()) for batch in batches for x in batch.column(0)]
        if not blocks:
            return
        coded = pa.concat_arrays([words for _, _, words in blocks]).dictionary_encode("encode")
        ids, words = np.append(coded.indices.to_numpy(), -1), coded.dictionary
        bases = np.cumsum([0, *(len(w) for _, _, w in blocks)])
        rows = np.concatenate([np.where(r >= 0, ids[np.where(r >= 0, r + base, -1)], -1) for (r, _, _), base in zip(blocks, bases, strict=False)])
        rows, n = _distinct(rows, np.concatenate([n for _, n, _ in blocks]), len(words))
        del blocks
        given = pa.array([common.get(w, -1) for w in words.to_pylist()], pa.int64()).to_numpy()
        change = np.ones(len(rows), bool)
        change[1:] = rows[1:, 0] != rows[:-1, 0]
        for k in range(1, order):
            heads = np.flatnonzero(change)
            change[1:] |= rows[1:, k] != rows[:-1, k]
            firsts = np.flatnonzero(change)
            total = np.add.reduceat(np.where(rows[:, k] >= 0, n, 0), heads)[np.searchsorted(heads, firsts, "right") - 1]
            if k == 1:
                total = np.where(given[rows[firsts, 0]] >= 0, given[rows[firsts, 0]], total)
            count = np.add.reduceat(n, firsts)
            there = np.flatnonzero(rows[firsts, k] >= 0)
            for lo in range(0, len(there), piece):
                at = there[lo : lo + piece]
                flat = words.take(pa.array(rows[firsts[at], : k + 1].reshape(-1))).cast(pa.string())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * (k + 1), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k + 1), pa.int32()), lists, pa.array(count[at]), pa.array(total[at])], ["ord", "words", "n", "total"])

    return run
