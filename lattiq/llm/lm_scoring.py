"""Operator 9, scoring of texts by a Brown class-based bigram model trained on the corpus.

The score of a text is the sum over its tokens of log10 P(class | class before) +
log10 P(word | class).  Exchange clustering puts the most frequent training words into
classes (it maximises the likelihood of the class bigrams, moving one word at a time).
These words and the classes grow with the vocabulary: CLUSTERED words or the square root
of the number of types if that is more, and CLASSES classes times the square root of the
growth.  The words are dealt to parts of CLUSTERED at most; in each sweep a part moves its
own words one by one, with the other parts' words where the last sweep left them.  The
neighbours of the clustered words stay in a table; the driver holds the class of each and
counts of pairs of classes.  A distributed pass counts the neighbours of every other training word against
these classes, text edges and words without a class yet, and puts it where the likelihood
gains most.  A word seen once counts for UNSEEN of its occurrence as an unseen word, so that
unseen words have a class of their own with transitions.  Counts, class transitions and
emissions come from all training rows.

No vocabulary is gathered in one place: documents are packed into blocks of about
BLOCK_BYTES, the distinct words of each block are joined with the counts of the whole
corpus, and each block is scored beside its own slice of the vocabulary.

Defined cases: a null text is empty and consists of its end; rows with a null id train and
are not held out; repeated rows count each time; without training rows every token has
count 0; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.llm.common import Scratch, Words, arrow, documents, rows_of

CLUSTERED = 1000
CLASSES = 60
SWEEPS = 3
BLOCK_BYTES = 4_000_000
#: Neighbour counts that one task holds at a time, about.
ENTRIES = 4_000_000
#: Neighbour counts whose gains are computed at a time; small, so that they stay in the processor's cache.
GAINS = 3_000
#: Share of words seen once that goes to unseen words.
UNSEEN = 0.5
#: Marks, beside its class, a word seen once.
ONCE = 1 << 15


def pack(docs: DataFrame, id_col: str, text_col: str, train: Column) -> DataFrame:
    """Documents in blocks of bounded bytes: block, ids, train flags, texts."""
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("texts", pa.list_(pa.string()))])

    def run(batches):
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0
        for rows in rows_of(batches, "id", "train", "text"):
            for r in rows:
                held.append(r)
                size += len(r[2] or "")
                if size >= BLOCK_BYTES:
                    yield arrow(schema, [(part << 32 | seq, *map(list, zip(*held, strict=True)))])
                    held, size, seq = [], 0, seq + 1
        if held:
            yield arrow(schema, [(part << 32 | seq, *map(list, zip(*held, strict=True)))])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(train, F.lit(True)).alias("train"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "block long, ids array<long>, train array<boolean>, texts array<string>")


def block_texts(batches):
    """(block, ids, train flags, texts) of each row of packed blocks."""
    for rows in rows_of(batches, "block", "ids", "train", "texts"):
        yield from rows


def block_words(blocks: DataFrame) -> DataFrame:
    schema = pa.schema([("block", pa.int64()), ("word", pa.int64()), ("n", pa.int32())])

    def run(batches):
        for block, _, train, texts in block_texts(batches):
            hashes = [Words(t, lower=True).grams(1) for t in texts]
            used = np.repeat(np.array(train), [len(h) for h in hashes])
            words, back = np.unique(np.concatenate(hashes), return_inverse=True)
            n = np.bincount(back, used.astype(float), len(words)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), block)), pa.array(words), pa.array(n)], schema=schema)

    return blocks.mapInArrow(run, "block long, word long, n int")


def vocabulary_size(types: int) -> tuple[int, int]:
    """Words that exchange clustering takes of so many types, and the classes it puts them into."""
    k = max(CLUSTERED, math.isqrt(types))
    return k, int(CLASSES * math.sqrt(k / CLUSTERED))


def laid_out(train: list[bool], texts: list[str | None], known: np.ndarray, values: np.ndarray, other: int, edge: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of the training texts one after the other, edges between them, and the value of each: of known (sorted) words their own."""
    parts = [x for used, t in zip(train, texts, strict=True) if used for x in (np.zeros(1, np.int64), Words(t, lower=True).grams(1))]
    h = np.concatenate([*parts, np.zeros(1, np.int64)])
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    value = np.where(known[at] == h, values[at], other)
    value[np.cumsum([0, *(len(a) + len(b) for a, b in zip(parts[::2], parts[1::2], strict=True))])] = edge
    return h, value


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out, back = np.unique(keys, return_inverse=True)
    return out, np.bincount(back, n, len(out)).astype(np.int64)


def bigrams(blocks: DataFrame, frequent: np.ndarray) -> DataFrame:
    """Neighbours in training texts, one of them frequent at least: pair (a * (k + 2) + b), n; k stands for other words, k + 1 for edges."""
    k = len(frequent)
    order = np.argsort(frequent)
    shared = blocks.sparkSession.sparkContext.broadcast((frequent[order], order))

    def run(batches):
        held, size = [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(x) for x in summed(*map(np.concatenate, zip(*held, strict=True)))], names=["pair", "n"])

        for _, _, train, texts in block_texts(batches):
            _, index = laid_out(train, texts, *shared.value, k, k + 1)
            a, b = index[:-1], index[1:]
            some = (a < k) | (b < k)
            held.append(np.unique(a[some] * (k + 2) + b[some], return_counts=True))
            size += len(held[-1][0])
            if size > ENTRIES:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return blocks.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def sweep(own: np.ndarray, both: np.ndarray, inner: tuple[np.ndarray, np.ndarray, np.ndarray], right_of: np.ndarray, left_of: np.ndarray) -> int:
    """Move each of the words once to the class that raises the likelihood most; own and both change; returns the words moved.

    both: counts of pairs of classes of all words.  inner: neighbours (a, b, n) among these words; right_of and left_of:
    counts of each word's other neighbours, behind and before it, by class.
    """
    k, classes = len(own), len(both)
    a, b, n = inner
    by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    to, n_to, from_, n_from = b[by_a], n[by_a], a[by_b], n[by_b]
    cut_a, cut_b = np.searchsorted(a[by_a], np.arange(k + 1)), np.searchsorted(b[by_b], np.arange(k + 1))
    moved = 0
    for w in range(k):
        x, y = slice(cut_a[w], cut_a[w + 1]), slice(cut_b[w], cut_b[w + 1])
        old, self_n = own[w], n_to[x][to[x] == w].sum()
        right = right_of[w] + np.bincount(own[to[x]], n_to[x], classes)
        left = left_of[w] + np.bincount(own[from_[y]], n_from[y], classes)
        right[old] -= self_n
        left[old] -= self_n
        both[old] -= right
        both[:, old] -= left
        both[old, old] -= self_n
        # the gain of class g: row and column g grow by right and left, the cell where they meet by both
        base = f(both)
        gain = f(both + right[None, :]).sum(1) - base.sum(1) + f(both + left[:, None]).sum(0) - base.sum(0)
        d = np.diag(both)
        gain += f(d + right + left + self_n) - f(d + right) - f(d + left) + f(d)
        rows, cols = both.sum(1) + left, both.sum(0) + right  # what the word adds to other classes' margins whatever its own class
        gain -= f(rows + right.sum() + self_n) - f(rows) + f(cols + left.sum() + self_n) - f(cols)
        new = int(np.argmax(gain))
        if gain[new] <= gain[old] + 1e-9:
            new = old
        both[new] += right
        both[:, new] += left
        both[new, new] += self_n
        own[w] = new
        moved += new != old
    return moved


def exchange(pairs: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """Classes of words, most frequent first, by exchange clustering of their bigram counts in one part."""
    k = len(pairs)
    a, b = np.nonzero(pairs)
    own, none = np.arange(k) % classes, np.zeros((k, classes))
    both = np.zeros((classes, classes))
    np.add.at(both, (own[a], own[b]), pairs[a, b])
    for _ in range(sweeps):
        if not sweep(own, both, (a, b, pairs[a, b]), none, none):
            break
    return own


def class_pairs(pairs: DataFrame, own: np.ndarray, classes: int) -> np.ndarray:
    """Counts of neighbouring classes, with other words and edges as the last two kinds."""
    k, kinds = len(own), classes + 2
    shared = pairs.sparkSession.sparkContext.broadcast(np.concatenate((own, [classes, classes + 1])))

    def run(batches):
        seen = np.zeros(kinds * kinds, np.int64)
        for batch in batches:
            pair, n = batch.column("pair").to_numpy(), batch.column("n").to_numpy()
            np.add.at(seen, shared.value[pair // (k + 2)] * kinds + shared.value[pair % (k + 2)], n)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["cell", "n"])

    table = pairs.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most kinds**2 rows
    out = np.zeros(kinds * kinds)
    out[table["cell"].to_numpy()] = table["n"].to_numpy()
    return out.reshape(kinds, kinds)


def swept(pairs: DataFrame, own: np.ndarray, both: np.ndarray) -> np.ndarray:
    """The classes of the clustered words after a sweep of every part over its own."""
    k, classes = len(own), len(both)
    parts = -(-k // CLUSTERED)
    width = classes + -(-k // parts)  # a neighbour is a class, or a word of the same part
    shared = pairs.sparkSession.sparkContext.broadcast((own, both))

    def deal(batches):
        for batch in batches:
            own = shared.value[0]
            pair, n = batch.column("pair").to_numpy(), batch.column("n").to_numpy()
            a, b = pair // (k + 2), pair % (k + 2)
            inner = (a < k) & (b < k)
            a, b, n = a[inner], b[inner], n[inner]
            same = a % parts == b % parts
            behind = np.where(same, classes + b // parts, own[b])
            key = np.concatenate((a // parts * 2 * width + behind, ((b // parts * 2 + 1) * width + own[a])[~same]))
            part = np.concatenate((a % parts, (b % parts)[~same]))
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(key), pa.array(np.concatenate((n, n[~same])))], names=["part", "key", "n"])

    schema = pa.schema([("word", pa.int64()), ("g", pa.int64())])

    def move(table):
        own, both = shared.value
        members = np.arange(table["part"][0].as_py(), k, parts)
        mine = own[members]
        key, n = table["key"].to_numpy(), table["n"].to_numpy().astype(float)
        word, behind, code = key // (2 * width), key // width % 2 == 0, key % width
        inner, outer = code >= classes, np.zeros((2, len(members), classes))
        np.add.at(outer, ((~behind & ~inner).astype(int)[~inner], word[~inner], code[~inner]), n[~inner])
        sweep(mine, both.copy(), (word[inner], code[inner] - classes, n[inner]), *outer)
        return pa.Table.from_arrays([pa.array(members), pa.array(mine)], schema=schema)

    dealt = pairs.mapInArrow(deal, "part long, key long, n long").groupBy("part", "key").agg(F.sum("n").alias("n"))
    table = dealt.groupBy("part").applyInArrow(move, "word long, g long").toArrow()  # a row for each clustered word
    out = own.copy()
    out[table["word"].to_numpy()] = table["g"].to_numpy()
    return out


def clustered(pairs: DataFrame, k: int, classes: int) -> np.ndarray:
    """Exchange clustering of k words by their neighbours."""
    own = np.arange(k) % classes
    for _ in range(SWEEPS):
        new = swept(pairs, own, class_pairs(pairs, own, classes)[:classes, :classes])
        if (new == own).all():
            break
        own = new
    return own


def neighbours(blocks: DataFrame, frequent: np.ndarray, own: np.ndarray, classes: int, buckets: int) -> DataFrame:
    """Counts of each other word's neighbours by class in each block, in buckets of words: bucket, words, codes, n."""
    schema = pa.schema([("bucket", pa.int32()), ("words", pa.binary()), ("codes", pa.binary()), ("n", pa.binary())])
    kinds = classes + 2  # classes, other words, edges; codes from kinds on are of the word behind
    order = np.argsort(frequent)
    shared = blocks.sparkSession.sparkContext.broadcast((frequent[order], own[order]))

    def run(batches):
        for _, _, train, texts in block_texts(batches):
            h, value = laid_out(train, texts, *shared.value, classes, classes + 1)
            at = np.flatnonzero(value == classes)
            words, back = np.unique(h[at], return_inverse=True)
            key, n = np.unique(np.concatenate((back * 2 * kinds + value[at - 1], back * 2 * kinds + kinds + value[at + 1])), return_counts=True)
            word, code, n = words[key // (2 * kinds)], (key % (2 * kinds)).astype(np.uint16), n.astype(np.int32)
            bucket = ((word.view(np.uint64) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)
            by = np.argsort(bucket, kind="stable")
            word, code, n, bucket = word[by], code[by], n[by], bucket[by]
            names, begin = np.unique(bucket, return_index=True)
            out = [(int(g), word[x:y].tobytes(), code[x:y].tobytes(), n[x:y].tobytes()) for g, x, y in zip(names, begin, np.append(begin, len(word))[1:], strict=True)]
            yield arrow(schema, out)

    return blocks.mapInArrow(run, "bucket int, words binary, codes binary, n binary")


def assigned(found: DataFrame, right: np.ndarray, left: np.ndarray) -> DataFrame:
    """Each word of the buckets with its count and the class whose likelihood it raises most: word, c, g.

    right and left: counts of each class (rows) before and behind each kind of neighbour (columns).
    """
    kinds = right.shape[1]
    shared = found.sparkSession.sparkContext.broadcast(np.concatenate((left, right), 1).T.copy())
    schema = pa.schema([("word", pa.int64()), ("c", pa.int64()), ("g", pa.int32())])

    def choose(table):
        have = shared.value  # by code, then class
        base, cols, rows = f(have), have[:kinds].sum(0), have[kinds:].sum(0)
        once = f(have + 1) - base
        word, code, n = (np.concatenate([np.frombuffer(x, t) for x in table[c].to_pylist()]) for c, t in (("words", np.int64), ("codes", np.uint16), ("n", np.int32)))
        words, back = np.unique(word, return_inverse=True)
        key, n = summed(back * 2 * kinds + code, n)
        who, code = key // (2 * kinds), key % (2 * kinds)
        c = np.bincount(who, np.where(code < kinds, n, 0), len(words))
        g = np.zeros(len(words), np.int32)
        begin = np.searchsorted(who, np.arange(len(words) + 1))
        lo = 0
        while lo < len(words):  # about GAINS counts at a time, whole words
            hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + GAINS, side="right")) - 1)
            x = slice(begin[lo], begin[hi])
            gain = once[code[x]]
            several = np.flatnonzero(n[x] > 1)
            at = code[x][several]
            gain[several] = f(have[at] + n[x][several][:, None]) - base[at]
            total = np.add.reduceat(gain, begin[lo:hi] - begin[lo], axis=0)
            m = c[lo:hi][:, None]
            total -= f(rows + m) - f(rows) + f(cols + m) - f(cols)
            g[lo:hi] = np.argmax(total, 1)
            lo = hi
        return pa.Table.from_arrays([pa.array(words), pa.array(c.astype(np.int64)), pa.array(g)], schema=schema)

    return found.groupBy("bucket").applyInArrow(choose, "word long, c long, g int")


def word_classes(blocks: DataFrame, counts: DataFrame, types: int, tokens: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """The class of every training word with its count (word, c, g), and the number of classes."""
    spark = blocks.sparkSession
    size, classes = vocabulary_size(types)
    top = counts.orderBy(F.desc("c"), "word").limit(size).toArrow()
    frequent, c = top["word"].to_numpy(), top["c"].to_numpy()
    k = len(frequent)
    if not k:
        return counts.select("word", "c", F.lit(0).alias("g")), classes
    pairs = scratch.keep(bigrams(blocks, frequent), "pairs")
    own = clustered(pairs, k, classes)
    have = class_pairs(pairs, own, classes)
    scratch.drop("pairs")
    right, left = have[:classes], have[:, :classes].T
    seeds = spark.createDataFrame([(int(w), int(m), int(g)) for w, m, g in zip(frequent, c, own, strict=True)], "word long, c long, g int")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * tokens // ENTRIES))
    rest = assigned(neighbours(blocks, frequent, own, classes, buckets), right, left)
    return seeds.unionByName(rest), classes


def held_out(col: Column) -> Column:
    return F.coalesce(F.crc32(col.cast("string")) % 7 == 2, F.lit(False))


def lm_scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, train, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    blocks = scratch.keep(pack(docs, id_col, text_col, train), "blocks", "zstd")
    words = scratch.keep(block_words(blocks), "words")
    counts = scratch.keep(words.where("n > 0").groupBy("word").agg(F.sum("n").alias("c")), "counts")
    trained = blocks.select(F.explode("train").alias("t")).where("t").count()  # the end of each training text is a token
    stats = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_all, n_types = int(stats[0]) + trained, int(stats[1]) + bool(trained)
    classed, classes = word_classes(blocks, counts, n_types, n_all, scratch)
    classed = scratch.keep(classed, "classed")
    rare, edge = classes, classes + 1  # unseen words; text ends, and what stands before a text
    used = F.when(F.col("c") == 1, 1 - UNSEEN).otherwise(F.col("c"))
    by_class = classed.groupBy("g").agg(F.sum(used).alias("n"), F.count_if(F.col("c") == 1).alias("once")).collect()  # a row for each class
    slices = scratch.keep(words.select("block", "word").join(classed, "word"), "slices")
    scratch.drop("words", "counts")
    total = np.ones(classes)
    for r in by_class:
        total[r["g"]] = r["n"]
    base_all = np.log10(n_all + n_types + 1)
    # words never seen are taken to be as many as those seen once
    unseen = -np.log10(sum(r["once"] for r in by_class) + 1)
    out_schema = pa.schema([("id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("emission", pa.float64()), ("classes", pa.binary())])

    def encode(left, right):
        word, c, g = (right.column(n).to_numpy() for n in ("word", "c", "g"))
        order = np.argsort(word)
        word, c, g = word[order], c[order], g[order]
        log_base = np.log10(c + 1.0) - base_all
        log_emit = np.log10(np.where(c == 1, 1 - UNSEEN, c) / total[g])
        mark = (g | np.where(c == 1, ONCE, 0)).astype(np.uint16)
        out = []
        for _, ids, train, texts in block_texts(left.to_batches()):
            for key, used, text in zip(ids, train, texts, strict=True):
                h = Words(text, lower=True).grams(1)
                if len(word):
                    at = np.minimum(np.searchsorted(word, h), len(word) - 1)
                    seen = word[at] == h
                else:
                    at, seen = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
                hit = at[seen]
                known = int(seen.sum())
                base = log_base[hit].sum() - base_all * (len(h) - known) + np.log10(trained + 1.0) - base_all
                emit = log_emit[hit].sum() + unseen * (len(h) - known)
                marks = np.full(len(h), rare, np.uint16)
                marks[seen] = mark[hit]
                out.append((key, used, len(h) + 1, known + bool(trained), float(base), float(emit), marks.tobytes()))
        return pa.Table.from_batches([arrow(out_schema, out)])

    encoded = blocks.groupBy("block").cogroup(slices.groupBy("block")).applyInArrow(encode, "id long, train boolean, n_tokens long, n_known long, base_score double, emission double, classes binary")
    encoded = scratch.keep(encoded, "encoded", "zstd")
    scratch.drop("blocks", "slices", "classed")

    def framed(data: bytes) -> np.ndarray:
        return np.concatenate(([edge], np.frombuffer(data, np.uint16).astype(np.int64), [edge]))

    def pairs_of(data: bytes) -> np.ndarray:
        g = framed(data) & (ONCE - 1)
        return g[:-1] * (edge + 1) + g[1:]

    def transitions(batches):
        seen = np.zeros((edge + 1) ** 2)
        for rows in rows_of(batches, "train", "classes"):
            for used, data in rows:
                if used:
                    mark = framed(data)
                    g, part = mark & (ONCE - 1), np.where(mark & ONCE, UNSEEN, 0.0)
                    a, b, x, y = g[:-1], g[1:], part[:-1], part[1:]
                    seen += np.bincount(a * (edge + 1) + b, (1 - x) * (1 - y), len(seen))
                    if part.any():  # words seen once stand for unseen ones in part
                        i, j = np.flatnonzero(x), np.flatnonzero(y)
                        seen += np.bincount(rare * (edge + 1) + b[i], x[i] * (1 - y[i]), len(seen))
                        seen += np.bincount(a[j] * (edge + 1) + rare, (1 - x[j]) * y[j], len(seen))
                        seen[rare * (edge + 1) + rare] += (x * y).sum()
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["pair", "n"])

    table = encoded.select("train", "classes").mapInArrow(transitions, "pair long, n double").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most (edge + 1)**2 rows
    n = np.zeros((edge + 1) ** 2)
    n[table["pair"].to_numpy()] = table["n"].to_numpy()
    n = n.reshape(edge + 1, edge + 1)
    single = (n.sum(0) + 1) / (n.sum() + len(n))
    rows, kinds = n.sum(1, keepdims=True), (n > 0).sum(1, keepdims=True)
    log_p = np.log10((n + np.maximum(kinds, 1) * single) / (rows + np.maximum(kinds, 1))).ravel()
    shared = spark.sparkContext.broadcast(log_p)

    def score(batches):
        for batch in batches:
            table = shared.value
            extra = [float(table[pairs_of(d)].sum()) for d in batch.column("classes").to_pylist()]
            scores = np.array(batch.column("emission").to_pylist(), float) + np.array(extra, float)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "train", "n_tokens", "n_known", "base_score")), pa.array(scores)], names=["id", "train", "n_tokens", "n_known", "base_score", "score"])

    out = encoded.mapInArrow(score, "id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "train", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scores(documents(spark, sf_dir), ~held_out(F.col("doc_id")))
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
