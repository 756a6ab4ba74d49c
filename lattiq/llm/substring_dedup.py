"""Operator 3, substring dedup of word windows by prefix-partitioned suffix trees.

A word goes when a window of WINDOW words that covers it also starts in a document with a
smaller id.  Suffixes (by words) are split into groups by prefixes of variable length, each
group fits in memory, and the deep internal nodes of a group's tree, those of WINDOW words
at least, are the repeats; the smallest document below such a node decides:

1. Of the suffixes that begin a window, those side by side whose windows have the same
   leftmost minimal PREFIX-gram travel as one run, in the group of that prefix.  Equal
   windows always meet in one group; groups that lie in one document end here.
2. Runs with the same words hang below one leaf.  All but those of its smallest document go.
3. Of groups with several leaves, those of up to GROUP_RUNS runs are built into trees inside
   tasks: suffixes are ranked by ever longer prefixes (1, 2, 4, 8 words, then WINDOW), and
   suffixes that share the last rank share a deep internal node.
4. Larger groups are split: their suffixes are dealt by longer prefixes, one of LONGER after
   the other, until a group has up to GROUP_RUNS suffixes.  A group that has more at WINDOW
   words is a single deep node, for which a partial aggregate is enough.

Defined cases: a null text has no words; texts of fewer words than WINDOW keep everything;
very long texts are read whole; rows that share an id are one document and do not count
against each other, and each loses its own words only; rows with a null id take no part;
repeated rows lose the same words; an empty table gives an empty result; other columns do
not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattiq.llm.common import BASE, Scratch, Words, arrow, documents, join_hot, merged, mix, rows_of, window_runs

WINDOW = 13
PREFIX = 5
#: Runs, or suffixes, of a group that a task builds a tree of; with about 170 bytes each.
GROUP_RUNS = 50_000
#: Words of the longer prefixes that split larger groups.
LONGER = (8, 11)
#: Words that a task's trees hold at a time, about.
TREE_WORDS = 1_000_000


def source_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, sub, text) of rows that take part; sub tells texts under one id apart."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.hash(text_col).alias("sub"), F.col(text_col).alias("text"))
    return rows.where("id is not null and text is not null")


RUN = pa.schema([("prefix", pa.int64()), ("whole", pa.int64()), ("id", pa.int64()), ("sub", pa.int32()), ("at", pa.int32()), ("n", pa.int16())])


def runs(source: DataFrame, window: int) -> DataFrame:
    def scan(batches):
        for rows in rows_of(batches, "id", "sub", "text"):
            for key, sub, text in rows:
                words = Words(text, lower=False)
                if words.n < window:
                    continue
                grams = words.grams(PREFIX)
                first, last, low = window_runs(grams, window - PREFIX + 1)
                k = len(first)
                yield pa.RecordBatch.from_arrays([pa.array(grams[low]), pa.array(words.spans(first, last + window - 1)), pa.array(np.full(k, key)), pa.array(np.full(k, sub, np.int32)), pa.array(first.astype(np.int32)), pa.array((last - first + 1).astype(np.int16))], schema=RUN)

    return source.mapInArrow(scan, "prefix long, whole long, id long, sub int, at int, n smallint")


SPAN = pa.schema([("id", pa.int64()), ("sub", pa.int32()), ("a", pa.int32()), ("b", pa.int32())])


def ranks(words: np.ndarray, window: int) -> np.ndarray:
    """A number for each place, equal for places whose next window words are equal (as far as there are so many)."""
    number, reach = np.unique(words, return_inverse=True)[1].astype(np.uint64), 1
    while reach < window:
        step = min(reach, window - reach)
        later = np.concatenate((number[step:], np.zeros(step, np.uint64)))
        number = np.unique(number << np.uint64(32) | later, return_inverse=True)[1].astype(np.uint64)
        reach += step
    return number.astype(np.int64)


def tree_spans(held: list[tuple], window: int) -> pa.RecordBatch:
    """Words to be removed from the contexts (id, sub, at, words) of complete groups."""
    parts = [np.frombuffer(h[3], np.int64) for h in held]
    size = np.array([len(p) for p in parts])
    node = ranks(np.concatenate(parts), window)
    owner = np.repeat(np.arange(len(parts)), size)
    place = np.arange(len(node)) - np.repeat(np.cumsum(size) - size, size)
    inside = np.flatnonzero(place + window <= size[owner])
    ids = np.array([h[0] for h in held], np.int64)
    least = np.full(int(node.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, node[inside], ids[owner[inside]])
    gone = inside[ids[owner[inside]] > least[node[inside]]]
    if not len(gone):
        return arrow(SPAN, [])
    at = np.array([h[2] for h in held], np.int64)[owner[gone]] + place[gone]
    new = np.flatnonzero(np.concatenate(([True], (owner[gone][1:] != owner[gone][:-1]) | (at[1:] > at[:-1] + 1))))
    end = np.append(new[1:], len(gone)) - 1
    who = owner[gone][new]
    return pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(np.array([h[1] for h in held], np.int32)[who]), pa.array(at[new].astype(np.int32)), pa.array((at[end] + window).astype(np.int32))], schema=SPAN)


CONTEXT = "group long, id long, sub int, at int, words binary"


def trees(contexts: DataFrame, window: int) -> DataFrame:
    """Spans (id, sub, a, b) of the contexts of groups that fit in memory, many groups in a task one after the other."""

    def run(batches):
        held, group, size = [], None, 0
        for rows in rows_of(batches, "group", "id", "sub", "at", "words"):
            for name, *context in rows:
                if size > TREE_WORDS and name != group:
                    yield tree_spans(held, window)
                    held, size = [], 0
                group = name
                held.append(context)
                size += len(context[3]) // 8
        if held:
            yield tree_spans(held, window)

    return contexts.repartition("group").sortWithinPartitions("group").mapInArrow(run, "id long, sub int, a int, b int")


def suffixes(contexts: DataFrame, window: int, depth: int) -> DataFrame:
    """The suffixes of contexts, window words of each, grouped by their first depth words."""
    schema = pa.schema([("group", pa.int64()), ("id", pa.int64()), ("sub", pa.int32()), ("at", pa.int32()), ("words", pa.binary())])

    def run(batches):
        for rows in rows_of(batches, "id", "sub", "at", "words"):
            out = []
            for key, sub, at, data in rows:
                words = np.frombuffer(data, np.uint64)
                k = len(words) - window + 1
                name = np.zeros(k, np.uint64)
                for j in range(depth):
                    name = mix(name * np.uint64(BASE) + words[j : j + k])
                out += [(int(g), key, sub, at + i, data[8 * i : 8 * (i + window)]) for i, g in enumerate(name.view(np.int64))]
            yield arrow(schema, out)

    return contexts.select("id", "sub", "at", "words").mapInArrow(run, CONTEXT)


def covered(docs: DataFrame, id_col: str, text_col: str, window: int, scratch: Scratch) -> DataFrame:
    """Intervals of words (id, sub, a, b) whose union is all words to be removed."""
    source = source_of(docs, id_col, text_col)
    found = scratch.keep(runs(source, window), "runs")
    groups = scratch.keep(found.groupBy("prefix").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("k")).where("lo < hi").select("prefix", "k"), "groups")
    hits = scratch.keep(join_hot(found, groups, ["prefix"], "k"), "hits")
    scratch.drop("runs", "groups")
    leaves = scratch.keep(hits.groupBy("prefix", "whole").agg(F.min("id").alias("least"), F.count("*").alias("k")), "leaves")
    split = leaves.groupBy("prefix").agg(F.count("*").alias("leaves")).where("leaves > 1")
    placed = join_hot(hits, leaves, ["prefix", "whole"], "k").select("prefix", "id", "sub", "at", "n", (F.col("id") > F.col("least")).alias("later"))
    placed = scratch.keep(placed, "placed")
    scratch.drop("hits")
    full = placed.where("later").select("id", "sub", F.col("at").alias("a"), (F.col("at") + F.col("n") - 1 + window).cast("int").alias("b"))
    first = scratch.keep(placed.where("not later"), "first")
    size = scratch.keep(first.groupBy("prefix").agg(F.count("*").alias("runs"), F.count("*").alias("k")).join(split.select("prefix"), "prefix"), "split")
    open_ = join_hot(first, size, ["prefix"], "k").groupBy("id", "sub").agg(F.collect_list(F.struct("prefix", "at", "n", (F.col("runs") > GROUP_RUNS).alias("large"))).alias("todo"))

    def cut(batches):
        schema = pa.schema([("group", pa.int64()), ("large", pa.bool_()), ("id", pa.int64()), ("sub", pa.int32()), ("at", pa.int32()), ("words", pa.binary())])
        for rows in rows_of(batches, "id", "sub", "text", "todo"):
            out = []
            for key, sub, text, todo in rows:
                grams = Words(text, lower=False).grams(1)
                out += [(t["prefix"], t["large"], key, sub, t["at"], grams[t["at"] : t["at"] + t["n"] - 1 + window].tobytes()) for t in todo]
            yield arrow(schema, out)

    cuts = scratch.keep(open_.join(source, ["id", "sub"]).mapInArrow(cut, "group long, large boolean, id long, sub int, at int, words binary"), "cuts")
    out = full.unionByName(trees(cuts.where("not large").drop("large"), window))
    large = cuts.where("large")
    if large.isEmpty():
        return out
    for depth in [d for d in LONGER if d < window]:
        level = scratch.keep(suffixes(large, window, depth), f"by-{depth}")
        sizes = scratch.keep(level.groupBy("group").agg(F.count("*").alias("k"), F.count("*").alias("suffixes")).where("k > 1"), f"size-{depth}")
        level = scratch.keep(join_hot(level, sizes, ["group"], "k"), f"at-{depth}")
        out = out.unionByName(trees(level.where(F.col("suffixes") <= GROUP_RUNS).drop("suffixes"), window))
        large = level.where(F.col("suffixes") > GROUP_RUNS)
    deep = scratch.keep(suffixes(large, window, window).drop("words"), "deep")
    least = scratch.keep(deep.groupBy("group").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("k")).where("least < most").drop("most"), "least")
    more = join_hot(deep, least, ["group"], "k").where("id > least")
    return out.unionByName(more.select("id", "sub", F.col("at").alias("a"), (F.col("at") + window).cast("int").alias("b")))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """Each row's columns in keep, n_words, n_removed, kept_sha256, and kept: the words that stay, joined by a space."""
    scratch = Scratch(docs.sparkSession, "words")
    spans = scratch.keep(covered(docs, id_col, text_col, window, scratch), "spans")
    scratch.drop("leaves", "placed", "first", "split", "cuts", "deep", "least", *(f"{x}-{d}" for x in ("by", "size", "at") for d in LONGER))
    by_doc = spans.groupBy("id", "sub").agg(F.collect_list(F.struct("a", "b")).alias("_spans"))
    kept = F.struct(*(keep or [id_col])).alias("_kept")
    rows = docs.select(kept, F.col(id_col).cast("long").alias("id"), F.hash(text_col).alias("sub"), F.col(text_col).alias("_text")).join(by_doc, ["id", "sub"], "left")
    kind = T.StructType([rows.schema["_kept"], *(T.StructField(n, t) for n, t in (("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType()), ("kept", T.StringType())))])

    def cut(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("_text").to_pylist(), batch.column("_spans").to_pylist(), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                n, removed = len(words), 0
                if spans:
                    a, b = merged(np.array([s["a"] for s in spans]), np.array([s["b"] for s in spans]))
                    a, b = np.minimum(a, n), np.minimum(b, n)
                    removed = int((b - a).sum())
                    edges = [0, *np.stack([a, b], 1).ravel().tolist(), n]
                    words = [w for x, y in zip(edges[::2], edges[1::2], strict=True) for w in words[x:y]]
                kept = b" ".join(words)
                out.append((n, removed, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("_kept"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], names=["_kept", "n_words", "n_removed", "kept_sha256", "kept"])

    return rows.mapInArrow(cut, kind).select("_kept.*", "n_words", "n_removed", "kept_sha256", "kept")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir)).drop("kept")


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
f AS (SELECT g, min(doc_id) AS lo FROM win GROUP BY g),
later AS (SELECT doc_id, i FROM win JOIN f USING (g) WHERE doc_id > lo),
marked AS (SELECT x.doc_id, word, p, later.i IS NOT NULL AS start FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d) x LEFT JOIN later ON later.doc_id = x.doc_id AND later.i = p),
cut AS (SELECT doc_id, word, p, coalesce(p - max(CASE WHEN start THEN p END) OVER (PARTITION BY doc_id ORDER BY p) < 13, false) AS gone FROM marked),
kept AS (SELECT doc_id, count(*) AS n, count_if(gone) AS r, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT gone), '') AS t FROM cut GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(r, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)
"""
