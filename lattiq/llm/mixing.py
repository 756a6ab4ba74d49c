"""Operator 4, mixing sources to target weights by blocks of tokens.

The words of each source, in id order, are packed into blocks of BLOCK_WORDS words.
Targets follow the weights (water-filling under the cap of MOST times a source's size).
For every output shard a multinomial draw over the quotas that are left gives the number
of slots of each source, so that a source's slots add up to its target; a shard owns the
slots drawn for it, and ``packed_blocks`` returns the blocks by shard.  There is a shard for
every SHARD_WORDS words of the mix, SHARDS at least and MOST_SHARDS at most (they then grow).
Slot j of a source is mapped through the source's own pseudorandom permutation of its block indices (one
permutation for every pass over the source; a keyed Feistel network, walked until it lands
inside), and the slots are joined with the blocks by (source, index).  The last slot of a
source takes the first words of its block only, so the words taken meet the target exactly
(rounded); no word is taken more than MOST times.

Only one row per source reaches the driver.  Word offsets come from range partitions of
(source, id) with one sum for each partition and source, so a source that holds a third of
all rows is spread over many tasks; slots and blocks are joined row by row.

Defined cases: a null text has size 0 and nothing is taken from it; a null source is a
source of its own, last in order; sources without words have target 0; repeated rows and
equal ids are packed one after the other; empty tables give empty results; other columns
do not matter, whatever their names; very long texts span many blocks.  Reruns over the same rows give the same result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.llm.common import Scratch, documents, fresh, quoted, rows_of

BLOCK_WORDS = 64
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2
SHARDS = 64
SHARD_WORDS = 1 << 24
MOST_SHARDS = 1 << 12
SEED = 7


def targets(sizes: list[int], weights: list[float], total: float, most: int = MOST) -> list[float]:
    """Targets in proportion to the weights, none above most times its size."""
    caps = [most * n for n in sizes]
    out, open_ = [0.0] * len(sizes), [i for i, c in enumerate(caps) if c > 0]
    left = min(float(total), float(sum(caps)))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > caps[i]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = float(caps[i])
            left -= caps[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def shard_counts(slots: list[int], shards: int, seed: int) -> np.ndarray:
    """Slots of each source in each shard: multinomial draws over the quotas that are left."""
    rng, left = np.random.default_rng(seed), np.array(slots, np.int64)
    out = np.zeros((shards, len(slots)), np.int64)
    for k in range(shards):
        want = int(round(left.sum() / (shards - k)))
        while want > 0 and left.sum() > 0:
            got = np.minimum(rng.multinomial(want, left / left.sum()), left)
            out[k] += got
            left -= got
            want -= int(got.sum())
    return out


def permute(j: np.ndarray, n: int, key: bytes, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0 .. n-1, at the places j; back: its inverse."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.blake2b(key + bytes([r]), digest_size=8).digest(), "little")) for r in range(4)]

    def scramble(x: np.ndarray, k: np.uint64) -> np.ndarray:
        f = (x ^ k) * np.uint64(0x9E3779B97F4A7C15)
        f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (f >> np.uint64(32)) & low

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> np.uint64(half), x & low
        for k in reversed(keys) if back else keys:
            a, b = (b ^ scramble(a, k), a) if back else (b, a ^ scramble(b, k))
        return a << np.uint64(half) | b

    x = once(j.astype(np.uint64))
    while len(out := np.flatnonzero(x >= n)):  # walk the cycle until the value is inside
        x[out] = once(x[out])
    return x.astype(np.int64)


class Mix:
    """The steps of one mix, as tables: sources, sizes with offsets, slots, and block uses."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, shards: int | None = None, block_words: int = BLOCK_WORDS, seed: int = SEED, row_col: str | None = None) -> None:
        self.spark = spark = docs.sparkSession
        self.scratch, self.block, self.seed = Scratch(spark, "mix"), block_words, seed
        size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
        rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(source_col).alias("_source"), size.alias("_size"), (F.col(row_col) if row_col else F.lit(None)).cast("long").alias("_row"))
        n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        # ties of (source, id) are ordered by size, so that the layout does not depend on the order of the input
        laid = rows.repartitionByRange(n, F.col("_source").asc_nulls_last(), F.col("_id"), F.col("_size")).sortWithinPartitions(F.col("_source").asc_nulls_last(), F.col("_id"), F.col("_size"))
        self.rows = self.scratch.keep(laid.withColumns({"_part": F.spark_partition_id()}).mapInArrow(_local_offsets, "_id long, _source string, _size long, _row long, _part int, _at long"), "rows")
        parts = self.rows.groupBy("_source", "_part").agg(F.sum("_size").alias("n")).collect()  # one row per source and partition it touches
        by: dict[str | None, list] = {}
        for r in parts:
            by.setdefault(r["_source"], []).append((r["_part"], r["n"]))
        names = sorted((x for x in by if x is not None), key=lambda x: [ord(c) for c in x]) + ([None] if None in by else [])
        sizes = [sum(k for _, k in by[x]) for x in names]
        goal = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], share * sum(sizes))
        self.sources = [{"index": i, "name": x, "size": m, "target": g, "take": min(int(round(g)), MOST * m)} for i, (x, m, g) in enumerate(zip(names, sizes, goal, strict=True))]
        begins = []
        for s in self.sources:
            at = 0
            for part, k in sorted(by[s["name"]]):
                begins.append((s["index"], s["name"], part, at, s["size"], float(s["target"])))
                at += k
        self.begins = spark.createDataFrame(begins, "_index int, _source string, _part int, _begin long, source_size long, target double")
        for s in self.sources:
            blocks = -(-s["size"] // block_words)
            passes, rest = divmod(s["take"], s["size"]) if s["size"] else (0, 0)
            s |= {"blocks": blocks, "passes": passes, "rest": rest}
            # the open pass stops at rest words; its short block, if among its slots, may cost one slot more
            open_, last_at = -(-rest // block_words), None
            if rest:
                last_at = int(permute(np.array([blocks - 1]), blocks, self.key(s["index"], passes), back=True)[0])
                short = s["size"] - (blocks - 1) * block_words
                open_ += int(last_at < open_ and open_ * block_words - (block_words - short) < rest)
            s["last_at"] = last_at
            s |= {"open": open_, "slots": passes * blocks + open_}

        self.shards = shards or min(MOST_SHARDS, max(SHARDS, -(-sum(s["take"] for s in self.sources) // SHARD_WORDS)))

    def key(self, source: int, pass_: int) -> bytes:
        return f"{self.seed}/{source}/{pass_}".encode()

    def offsets(self) -> DataFrame:
        """Each row with its source's figures and the place of its first word in the source."""
        return self.rows.join(F.broadcast(self.begins), F.col("_begin").isNotNull() & self.rows["_source"].eqNullSafe(self.begins["_source"]) & (self.rows["_part"] == self.begins["_part"])).select("_id", "_row", "_size", "_index", "source_size", "target", (F.col("_begin") + F.col("_at")).alias("_first"))

    def slots(self) -> DataFrame:
        """All slots: shard, source index, slot, pass, block, and the words taken from the block."""
        counts = shard_counts([s["slots"] for s in self.sources], self.shards, self.seed)
        upto = np.cumsum(counts, axis=0)
        plan, block = [dict(s) for s in self.sources], self.block
        chunk = 1 << 16
        pieces = [(i, lo, min(lo + step, s["slots"])) for i, s in enumerate(plan) if (step := max(chunk, -(-s["slots"] // 4096))) for lo in range(0, s["slots"], step)]
        seed = self.seed

        def make(batches):
            plan, upto = shared.value
            for rows in rows_of(batches, "source", "lo", "hi"):
                for i, lo, hi in ((i, at, min(at + chunk, hi)) for i, lo, hi in rows for at in range(lo, hi, chunk)):
                    s = plan[i]
                    j = np.arange(lo, hi, dtype=np.int64)
                    pass_, place = j // s["blocks"], j % s["blocks"]
                    at, words = np.zeros(len(j), np.int64), np.zeros(len(j), np.int64)
                    short = s["size"] - (s["blocks"] - 1) * block
                    for p in np.unique(pass_):
                        own = pass_ == p
                        at[own] = permute(place[own], s["blocks"], f"{seed}/{i}/{p}".encode())
                        full = np.where(at[own] == s["blocks"] - 1, short, block)
                        if p == s["passes"]:  # the open pass stops at rest words
                            before = place[own] * block
                            if (last := s["last_at"]) is not None:
                                before = before - (block - short) * (place[own] > last)
                            full = np.clip(s["rest"] - before, 0, full)
                        words[own] = full
                    shard = np.searchsorted(upto[:, i], j, side="right")
                    yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(np.full(len(j), i), pa.int32()), pa.array(j), pa.array(pass_), pa.array(at), pa.array(words)], names=["shard", "_index", "slot", "pass", "_block", "_words"])

        shared = self.spark.sparkContext.broadcast((plan, upto))
        frame = self.spark.createDataFrame(pieces, "source int, lo long, hi long").repartition(max(1, min(len(pieces), 1 << 12)))
        return frame.mapInArrow(make, "shard int, _index int, slot long, pass long, _block long, _words long")

    def pieces(self) -> DataFrame:
        """The parts of rows that blocks hold: row, block, first word in the block, words."""
        b = F.lit(self.block)
        lo, hi = F.floor(F.col("_first") / b), F.floor((F.col("_first") + F.col("_size") - 1) / b)
        rows = self.offsets().where("_size > 0").withColumn("_block", F.explode(F.sequence(lo, hi)))
        begin = F.greatest(F.col("_first"), F.col("_block") * b)
        end = F.least(F.col("_first") + F.col("_size"), (F.col("_block") + 1) * b)
        return rows.select("_id", "_row", "_first", "_index", "_block", (begin - F.col("_block") * b).alias("_from"), (end - F.col("_block") * b).alias("_to"))

    def uses(self) -> DataFrame:
        """Each piece of a row with the words that each slot takes of it."""
        taken = F.least(F.col("_to"), F.col("_words")) - F.col("_from")
        return self.pieces().join(self.slots().hint("merge"), ["_index", "_block"]).withColumn("_taken", F.greatest(taken, F.lit(0))).where("_taken > 0")


def _local_offsets(batches):
    """Words of the same source before each row, within its partition."""
    source, at = object(), 0
    for batch in batches:
        out = []
        for s, n in zip(batch.column("_source").to_pylist(), batch.column("_size").to_pylist(), strict=True):
            if s != source:
                source, at = s, 0
            out.append(at)
            at += n
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_id", "_source", "_size", "_row", "_part")), pa.array(out, pa.int64())], names=["_id", "_source", "_size", "_row", "_part", "_at"])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = Mix(documents(spark, sf_dir))
    if not mix.sources:
        return mix.offsets().select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("n_shards"), F.lit(None).cast("int").alias("shard"))
    taken = mix.uses().groupBy("_index", "_first").agg(F.sum("_taken").alias("taken"), F.count_distinct("shard").alias("n_shards"), F.min("shard").alias("shard"))
    rows = mix.offsets()
    some = rows.where("_size > 0").join(taken.hint("merge"), ["_index", "_first"], "left")  # no two rows with words begin at one place
    none = rows.where("_size = 0").withColumns({"taken": F.lit(0).cast("long"), "n_shards": F.lit(0).cast("long"), "shard": F.lit(None).cast("int")})
    both = some.unionByName(none)
    return both.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("taken", "n_shards")), "shard")


def picked_words(text: Column, spans: Column) -> Column:
    """The words of a text at spans (a: first word, n: words), in order.

    The words are an argument of a function, so that the text is split once and not once a span.
    """
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = lambda w: F.flatten(F.transform(spans, lambda s: F.slice(w, (s["a"] + 1).cast("int"), s["n"].cast("int"))))
    return F.transform(F.array(words), cut)[0]


def spans_of(mix: Mix, *keys: str) -> DataFrame:
    """The words taken (_spans, in order) of each row by the keys."""
    span = F.struct(((F.col("_block") * mix.block + F.col("_from")) - F.col("_first")).alias("a"), F.col("_taken").alias("n"))
    return mix.uses().groupBy("_row", *keys).agg(F.array_sort(F.collect_list(span)).alias("_spans"))


def keyed_mix(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, str, Mix]:
    """The documents with a key column, its name, and their mix."""
    row = fresh(docs, "_row")[0]
    # written once, so that the key of a row is the same for all that read it
    keyed = Scratch(docs.sparkSession, "keyed").keep(docs.withColumn(row, F.monotonically_increasing_id()), "docs", "zstd")
    return keyed, row, Mix(keyed, id_col, text_col, source_col, row_col=row)


def packed_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The output shards: shard, place (order within the shard, pseudorandom over the sources), source index, block, text of up to BLOCK_WORDS words."""
    keyed, row, mix = keyed_mix(docs, id_col, text_col, source_col)
    kind = "shard int, place long, source int, block long, text string"
    if not mix.sources:
        return docs.sparkSession.createDataFrame([], kind)
    slot = ["shard", "_index", "slot", "_block"]
    pieces = spans_of(mix, *slot, "_from").withColumnRenamed("_row", row)
    text = keyed.select(row, F.col(text_col).alias("_text")).join(pieces, row).select(*slot, "_from", F.array_join(picked_words(F.col("_text"), F.col("_spans")), " ").alias("_part"))
    parts = F.array_sort(F.collect_list(F.struct("_from", "_part")))  # a block holds BLOCK_WORDS words at most
    blocks = text.groupBy(*slot).agg(F.array_join(F.transform(parts, lambda p: p["_part"]), " ").alias("text"))
    return blocks.select("shard", F.xxhash64(F.lit(mix.seed), "_index", "slot").alias("place"), F.col("_index").alias("source"), F.col("_block").alias("block"), "text")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as documents: a row for each pass over a document's source that takes words of it.

    Its text is the words that the pass takes, in order, joined by one space; all other
    columns are those of the document, and ``n_chars``, if there, is counted anew.  Rows
    that the mix takes nothing from go.  Ids may be null and repeat, and columns have any
    names: rows have a key of their own.
    """
    keyed, row, mix = keyed_mix(docs, id_col, text_col, source_col)
    if not mix.sources:
        return docs.limit(0)
    spans, text = fresh(keyed, "_spans", "_picked")
    taken = spans_of(mix, "pass").select(F.col("_row").alias(row), F.col("_spans").alias(spans))
    out = keyed.join(taken, row).withColumn(text, F.array_join(picked_words(F.col(quoted(text_col)), F.col(spans)), " "))
    other = lambda c: F.char_length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(quoted(c))
    return out.select(*(F.col(text).alias(c) if c == text_col else other(c) for c in docs.columns))
