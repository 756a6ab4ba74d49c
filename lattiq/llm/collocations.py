"""Operator 11, phrase collocations by vertical positional inverted lists.

Texts (A-Z lowered) are cut into pieces, pieces into words.  Words of one language are laid out in blocks of about BLOCK_WORDS
words, with a gap between pieces, and every block is turned into vertical lists: for each word the places where it occurs.

1. The lengths of a word's lists, summed over the blocks, are its exact frequency.  Words with LEAST occurrences get numbers,
   which go back to the blocks that hold them.
2. In each block the lists of the frequent phrases of k words are merged with the lists of the frequent phrases that begin
   one place later (for k = 1 these are the postings of the adjacent word).  Where both meet, a phrase of k + 1 words occurs; it
   is named by the pair of numbers, so equal names are equal phrases; numbers are hashes, of which no two may be the same.  Again lengths
   are summed, and only the lists of frequent phrases are extended.  Pairs are counted in PASSES parts, which bounds the space of the shuffle.
3. The pair also names the longest parts of a phrase at both ends.  Joins on numbers give the frequencies of all cuts,
   the scores, and the shorter candidates that a longer one covers.

A phrase has one row a block at most in any shuffle, whatever its frequency.  Blocks of one language may be of any number; only
the report is ranked by language, after each task has cut its rows to the report's length.

Defined cases: null texts are empty, a null language is ``und``; pieces without words count nothing; very long texts are read whole
(a block ends with the text that fills it); repeated rows count each; ids do not matter and may be null; an empty table gives an empty
result; other columns do not matter.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattiq.llm.common import BASE, Scratch, arrow, documents, mix, rows_of

LEAST = 30
LONGEST = 4
REPORT = 2000
#: A longer candidate covers a shorter one with at most so many times its occurrences, in percent.
COVER = 80
SCALE = 2_000_000
#: Words after which a block ends, at the end of a text.
BLOCK_WORDS = 2_000_000

_TABLE = bytes([b + 32 if 0x41 <= b <= 0x5A else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256)])


def tokens_of(text: str | None) -> list[bytes]:
    """Words, with a line feed for each border of pieces, and empty strings that mean nothing."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).replace(b"\n", b" \n ").split(b" ")


def squeezed(x: np.ndarray, kind: str) -> bytes:
    """Whole numbers by byte planes, compressed."""
    return pa.compress(x.astype(kind).view(np.uint8).reshape(len(x), -1).T.tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def loosened(data: bytes, n: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = pa.decompress(data, width * n, codec="zstd", asbytes=True) if n else b""
    return np.frombuffer(planes, np.uint8).reshape(width, n).T.copy().view(kind).reshape(n).astype(np.int64)


def packed(places: np.ndarray, sizes: np.ndarray) -> bytes:
    """Sorted places of many lists, one after the other, as differences within each list."""
    step = np.diff(places, prepend=0)
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    step[first] = places[first]
    return squeezed(step, "<u4")


def unpacked(data: bytes, sizes: np.ndarray) -> np.ndarray:
    step = loosened(data, int(sizes.sum()), "<u4")
    total = np.cumsum(step)
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    return total - np.repeat((total - step)[first], sizes[sizes > 0])


BLOCKS = pa.schema([("block", pa.int64()), ("many", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.string())), ("sizes", pa.binary()), ("places", pa.binary())])


def blocks(docs: DataFrame, text_col: str, lang_col: str, block_words: int) -> DataFrame:
    """(block, many, lang, words, sizes, places): the vertical lists of all words (so many) of each block."""

    def scan(batches):
        task, made = TaskContext.get().partitionId(), count()
        held: dict[str, tuple[defaultdict, list[np.ndarray]]] = {}
        size: dict[str, int] = {}

        def written(lang):
            number, parts = held.pop(lang)
            size.pop(lang)
            place = np.concatenate(parts)
            at = np.flatnonzero(place > 0)  # 0 is the gap
            order = at[np.argsort(place[at], kind="stable")]
            sizes = np.bincount(place[at], minlength=len(number) + 1)[1:]
            words = [w.decode("utf-8", "surrogatepass") for w in number]
            return arrow(BLOCKS, [(task << 12 | next(made), len(words), lang, words, squeezed(sizes, "<u4"), packed(order, sizes))])

        for rows in rows_of(batches, "lang", "text"):
            for lang, text in rows:
                if lang not in held:
                    held[lang], size[lang] = (defaultdict(count(1).__next__), []), 0
                number, parts = held[lang]
                tokens = tokens_of(text)
                number[b"\n"], number[b""] = 0, -1  # taken out again below, so that only words stay
                place = np.array([number[w] for w in tokens], np.int32)
                del number[b"\n"], number[b""]
                parts += [place[place >= 0], np.zeros(1, np.int32)]
                size[lang] += len(tokens)
                if size[lang] >= block_words:
                    yield written(lang)
        for lang in list(held):
            yield written(lang)

    source = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    return source.mapInArrow(scan, "block long, many long, lang string, words array<string>, sizes binary, places binary")


def word_rows(lists: DataFrame) -> DataFrame:
    """(block, lang, place, word, n): a row for each list of each block."""
    schema = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("place", pa.int32()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                words = batch.column("words")[i].values
                k = batch.column("many")[i].as_py()
                n = loosened(batch.column("sizes")[i].as_py(), k, "<u4")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, batch.column("block")[i].as_py())), pa.array([batch.column("lang")[i].as_py()] * k, pa.string()), pa.array(np.arange(k, dtype=np.int32)), words, pa.array(n)], schema=schema)

    return lists.select("block", "many", "lang", "words", "sizes").mapInArrow(run, "block long, lang string, place int, word string, n long")


#: Parts that the pairs of a level are counted in, one after the other, so that only one stands in shuffle files at a time; and the rows of a part, for fewer.
PASSES, PASS_ROWS = 4, 4_000_000
#: Bits of the place of a list in its block.
PLACE = 28


def pair_rows(lists: DataFrame, part: int, passes: int) -> DataFrame:
    """(at, p, s, n): a row for each list of each block whose pair is in the part; at is the block and the place of the list."""
    schema = pa.schema([("at", pa.int64()), ("p", pa.int64()), ("s", pa.int64()), ("n", pa.int32())])

    def run(batches):
        for rows in rows_of(batches, "block", "many", "p", "s", "sizes"):
            for block, many, p, s, sizes in rows:
                p, s, n = np.cumsum(loosened(p, many, "<i8")), np.cumsum(loosened(s, many, "<i8")), loosened(sizes, many, "<u4").astype(np.int32)
                mine = np.flatnonzero(mix(p.view(np.uint64) * np.uint64(BASE) + s.view(np.uint64)) % np.uint64(passes) == part)
                yield pa.RecordBatch.from_arrays([pa.array((block << PLACE) + mine), pa.array(p[mine]), pa.array(s[mine]), pa.array(n[mine])], schema=schema)

    return lists.select("block", "many", "p", "s", "sizes").mapInArrow(run, "at long, p long, s long, n int")


def counted(lists: DataFrame, least: int, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """(found: (p, s, f, id) of the frequent pairs, kept: (block, place, id) of their lists).

    One shuffle brings the rows of a pair together, one a block, where they are summed and stay if the pair is frequent.
    """
    pair = Window.partitionBy("p", "s")
    parts, passes = [], passes_for(lists)
    for part in range(passes):
        rows = pair_rows(lists, part, passes).withColumns({"f": F.sum("n").over(pair), "first": F.row_number().over(pair.orderBy("at")) == 1})
        parts.append(scratch.keep(rows.where(F.col("f") >= least).select("at", "p", "s", "f", "first"), f"{name}-{part}", "zstd"))
    kept = parts[0]
    for x in parts[1:]:
        kept = kept.unionByName(x)
    found = kept.where("first").select("p", "s", "f")
    for seed in range(64):
        number = F.xxhash64("p", "s", F.lit(seed))
        numbered = found.withColumn("id", number)
        if numbered.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").isEmpty():  # else two pairs share a number
            break
    return numbered, kept.select(F.shiftright("at", PLACE).alias("block"), F.col("at").bitwiseAND(F.lit((1 << PLACE) - 1)).alias("place"), number.alias("id"))


PAIRS = pa.schema([("block", pa.int64()), ("many", pa.int64()), ("p", pa.binary()), ("s", pa.binary()), ("sizes", pa.binary()), ("places", pa.binary())])


def passes_for(lists: DataFrame) -> int:
    return min(PASSES, 1 + (lists.agg(F.sum("many")).first()[0] or 0) // PASS_ROWS)


def extended(lists: DataFrame, held: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(block, many, p, s, sizes, places): lists (so many) of the pairs of frequent phrases that begin side by side; some of the blocks at a time.

    held (block, held) names the frequent ones of each block by the places of their lists and their numbers.
    """

    def run(batches):
        for rows in rows_of(batches, "block", "many", "sizes", "places", "at", "ids"):
            for block, many, sizes, places, at, ids in rows:
                sizes = loosened(sizes, many, "<u4")
                every = unpacked(places, sizes)
                at, ids = np.array(at, np.int64), np.array(ids, np.int64)
                order = np.argsort(ids)
                at, ids = at[order], ids[order]
                local = np.full(len(sizes), -1, np.int64)
                local[at] = np.arange(len(at))
                phrase = np.repeat(local, sizes)
                every, phrase = every[phrase >= 0], phrase[phrase >= 0]
                merge = np.argsort(every)  # the lists of a block in the order of their places: none share a place
                every, phrase = every[merge], phrase[merge]
                meet = np.flatnonzero(every[1:] == every[:-1] + 1)
                key = phrase[meet] * len(ids) + phrase[meet + 1]
                order = np.argsort(key, kind="stable")
                key = key[order]
                first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
                n = np.diff(np.append(first, len(key)))
                pair = key[first]
                left, right = (np.diff(ids[x], prepend=0) for x in (pair // max(1, len(ids)), pair % max(1, len(ids))))
                yield arrow(PAIRS, [(block, len(pair), squeezed(left, "<i8"), squeezed(right, "<i8"), squeezed(n, "<u4"), packed(every[meet][order], n))])

    out, passes = None, passes_for(lists)
    for part in range(passes):
        mine = F.pmod(F.xxhash64("block"), F.lit(passes)) == part
        rows = lists.where(mine).select("block", "many", "sizes", "places").join(held.where(mine), "block")
        rows = rows.select("block", "many", "sizes", "places", F.col("held.place").alias("at"), F.col("held.id").alias("ids"))
        longer = scratch.keep(rows.mapInArrow(run, "block long, many long, p binary, s binary, sizes binary, places binary"), f"{name}-{part}", "zstd")
        out = longer if out is None else out.unionByName(longer)
    return out


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, block_words: int = BLOCK_WORDS) -> tuple[list[DataFrame], DataFrame, Scratch]:
    """(tables of the frequent phrases of 1 to longest words, words (lang, n) in all, their scratch tables).

    Columns: id, lang, phrase, f, p and s (numbers of the phrases without the last and without the first word), last (last word), and
    cuts (array of the frequencies l, r of both parts, by the words before the cut), lefts and rights: the frequencies of all beginnings and ends.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    lists = scratch.keep(blocks(docs, text_col, lang_col, block_words), "lists1", "zstd")
    rows = word_rows(lists)
    sums = scratch.keep(rows.groupBy("lang").agg(F.sum("n").alias("n")), "sums")
    words = rows.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least).select(F.monotonically_increasing_id().alias("id"), "lang", F.col("word").alias("phrase"), "f", F.lit(None).cast("long").alias("p"), F.lit(None).cast("long").alias("s"), F.col("word").alias("last"), F.array("f").alias("lefts"), F.array("f").alias("rights"), F.expr("cast(array() as array<struct<l:long,r:long>>)").alias("cuts"))
    tables = [scratch.keep(words, "phrases1")]
    kept = rows.join(tables[0].select("lang", F.col("phrase").alias("word"), "id"), ["lang", "word"]).select("block", "place", "id")
    for k in range(2, longest + 1):
        held = scratch.keep(kept.groupBy("block").agg(F.collect_list(F.struct("place", "id")).alias("held")), f"held{k}", "zstd")  # the frequent lists of one block; a table, so that the shuffle before ends here
        longer = extended(lists, held, scratch, f"lists{k}")
        scratch.drop(f"lists{k - 1}", f"held{k}", *(f"{x}{k - 1}-{part}" for x in ("lists", "kept") for part in range(PASSES)))
        lists, short = longer, tables[-1]
        found, kept = counted(longer, least, scratch, f"kept{k}")
        a = short.select(F.col("id").alias("p"), "lang", F.col("phrase").alias("_head"), F.col("lefts").alias("_l"))
        b = short.select(F.col("id").alias("s"), F.col("last").alias("_last"), F.col("rights").alias("_r"))
        both = found.join(a, "p").join(b, "s")
        cuts = F.transform(F.sequence(F.lit(1), F.lit(k - 1)), lambda i: F.struct(F.element_at("_l", i).alias("l"), F.element_at("_r", F.lit(k) - i).alias("r")))
        tables.append(scratch.keep(both.select("id", "lang", F.concat_ws(" ", "_head", "_last").alias("phrase"), "f", "p", "s", F.col("_last").alias("last"), F.concat("_l", F.array("f")).alias("lefts"), F.concat("_r", F.array("f")).alias("rights"), cuts.alias("cuts")), f"phrases{k}"))
    scratch.drop(*(f"{x}{longest}-{part}" for x in ("lists", "kept") for part in range(PASSES)))
    return tables, sums, scratch


def covered(tables: list[DataFrame], cover: int) -> list[DataFrame]:
    """For each table of phrases of 2 words and more, the numbers (id) of those that a longer candidate covers."""
    out = []
    for k in range(1, len(tables)):
        parts, inside = [], tables[k].select("id", F.col("f").alias("_a"))
        at = [tables[m].select("f", "p", "s") for m in range(k + 1, len(tables))]
        for m, longer in enumerate(at):
            ends = longer.select("f", F.explode(F.array("p", "s")).alias("id"))
            for below in range(k + m, k, -1):  # from the parts of below + 1 words down to those of k + 1
                ends = ends.join(tables[below].select("id", "p", "s"), "id").select("f", F.explode(F.array("p", "s")).alias("id"))
            parts.append(ends.groupBy("id").agg(F.max("f").alias("f")))
        if not parts:
            out.append(inside.select("id").limit(0))
            continue
        top = parts[0]
        for x in parts[1:]:
            top = top.unionByName(x)
        out.append(top.join(inside, "id").where(F.col("f").cast("decimal(20,0)") * 100 >= F.col("_a").cast("decimal(20,0)") * cover).select("id").distinct())
    return out


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, report: int = REPORT, cover: int = COVER, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best collocations of each language."""
    tables, sums, scratch = phrases(docs, text_col, lang_col, least, longest, block_words)
    whole = None
    for table, gone in zip(tables[1:], covered(tables, cover), strict=True):
        left = table.join(gone, "id", "left_anti").select("lang", "phrase", F.col("f").alias("a"), F.posexplode("cuts").alias("_k", "_c"))
        scored = left.select("lang", "phrase", "a", "_k", F.col("_c.l").alias("l"), F.col("_c.r").alias("r"), F.expr(f"cast(a as decimal(20,0)) * {SCALE} div (_c.l + _c.r)").alias("score"))
        low = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "_k", "l", "r")).alias("_m"))
        rows = low.select("lang", "phrase", "a", "_m.l", "_m.r", "_m.score")
        whole = rows if whole is None else whole.unionByName(rows)
    docs.sparkSession.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", str(max(1000, report)))  # each task cuts its own rows to the report
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = whole.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= report)
    found = scratch.keep(best.join(sums, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "report")
    scratch.drop("sums", *(f"phrases{k}" for k in range(1, longest + 1)))
    return found


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


_CUT = r"[.,;:!?\x0A-\x0D]"
SQL = rf"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_CUT}')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split(translate(piece, chr(9), ' '), ' '), lambda x: x <> '') AS w FROM pieces),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS p FROM w, range(1, {LONGEST + 1}) t(k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, p, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, p, a, string_split(p, ' ') AS ws FROM f WHERE k > 1),
halves AS (SELECT lang, p, a, j, array_to_string(ws[1:j], ' ') AS head, array_to_string(ws[j + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
cuts AS (SELECT h.lang, h.p, h.a, j, x.a AS l, y.a AS r, ({SCALE}::HUGEINT * h.a) // (x.a + y.a) AS score FROM halves h JOIN f x ON x.lang = h.lang AND x.p = h.head JOIN f y ON y.lang = h.lang AND y.p = h.tail),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
parts AS (SELECT DISTINCT lang, a AS b, array_to_string(ws[i:i + m - 1], ' ') AS p FROM c, range(2, {LONGEST}) u(m), range(1, {LONGEST}) v(i) WHERE m < c.k AND i + m - 1 <= c.k),
gone AS (SELECT DISTINCT c.lang, c.p FROM c JOIN parts USING (lang, p) WHERE 100 * b >= {COVER} * a),
kept AS (SELECT lang, p AS phrase, a, l, r, score FROM low ANTI JOIN gone USING (lang, p))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM kept JOIN t USING (lang) QUALIFY rank <= {REPORT}"""
