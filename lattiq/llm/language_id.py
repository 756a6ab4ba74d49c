"""Operator 7, language identification with language-bitmask n-gram filters.

Training counts the character n-grams of labelled texts by language; a language claims an
n-gram whose relative frequency there is at least CLAIM of the highest among languages.
The claims stand in a bit-sliced Bloom filter: each slot is a bitmask with one bit per
language (one 64-bit plane for every 64 languages), and a query, the AND of K_HASHES
slots, returns all languages that hold an n-gram at once.  For a text, the hits of each
language are counted, corrected for the filter's false positives (fill ** K_HASHES of the
queries), and the largest corrected count decides.

The classifier is fitted on a bounded sample of labelled rows: ``sample_rows`` of them,
whole texts, chosen by a hash of text and row with equal shares for the languages (rare ones
whole).  Prediction reads every whole text in one pass
without a shuffle; the filter sent to executors has a fixed size.

Defined cases: a text that is null or has no letter gives ``und`` and score 0; a text none
of whose n-grams is known gets the most frequent training language and score 0; ties go
to the smaller language name; without training rows every text is ``und``; repeated rows
and null ids are rows like others; very long texts are read whole; an empty table gives an
empty result; other columns do not matter, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattiq.llm.common import below, chosen, documents, mix, rows_of, tune

SIZES = (3, 4)
CLAIM = 0.3
K_HASHES = 2
SLOT_BITS = 21
SAMPLE_ROWS = 10_000
#: n-grams seen fewer times in a language's sample are not counted for it.
LEAST_COUNT = 3


def letter_table() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_hashes(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts, the text each belongs to, and the letters in each text.

    Everything that is not a letter counts as one blank kind; n-grams without a letter in
    second place are left out.
    """
    parts = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(p) + 2 for p in parts])
    blank = np.zeros(1, np.uint32)
    code = np.concatenate([x for p in parts for x in (blank, p, blank)]) if parts else np.zeros(0, np.uint32)
    owner = np.repeat(np.arange(len(parts)), sizes)
    is_letter = letters[code]
    count = np.bincount(owner[is_letter], minlength=len(parts))
    code = np.where(is_letter, code, 0).astype(np.uint64)
    out, who = [], []
    for n in SIZES:
        if len(code) < n:
            continue
        m = len(code) - n + 1
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + code[k : k + m]
        good = is_letter[1 : m + 1] & (owner[:m] == owner[n - 1 :])
        out.append(h[good])
        who.append(owner[:m][good])
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), count
    return mix(np.concatenate(out)), np.concatenate(who), count


def slots(h: np.ndarray) -> list[np.ndarray]:
    """The K_HASHES slots of each hash."""
    return [((h >> np.uint64(k * SLOT_BITS)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64) for k in range(K_HASHES)]


class Filters:
    """The bit-sliced filter: masks[plane][slot] has bit l if language 64 * plane + l claims it."""

    def __init__(self, langs: list[str], common: str | None, masks: np.ndarray, false: np.ndarray) -> None:
        self.langs, self.common, self.masks, self.false = langs, common, masks, false

    @classmethod
    def of(cls, langs: list[str], common: str | None, claims: dict[str, np.ndarray]) -> Filters:
        masks = np.zeros((max(1, -(-len(langs) // 64)), 1 << SLOT_BITS), np.uint64)
        fill = []
        for i, lang in enumerate(langs):
            for s in slots(claims[lang]):
                masks[i // 64, s] |= np.uint64(1) << np.uint64(i % 64)
            fill.append(float((masks[i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean()))
        return cls(langs, common, masks, np.array(fill) ** K_HASHES)

    def parts(self) -> tuple:
        """Plain values and arrays, which executors can read without this package."""
        return self.langs, self.common, self.masks, self.false

    def predict(self, texts: list[str | None], letters: np.ndarray) -> list[tuple[str, float]]:
        h, who, count = gram_hashes([t or "" for t in texts], letters)
        n = np.bincount(who, minlength=len(texts)).astype(float)
        hits = np.zeros((len(self.langs), len(texts)))
        at = slots(h)
        for plane, mask in enumerate(self.masks):
            both = mask[at[0]]
            for s in at[1:]:
                both = both & mask[s]
            for bit in range(min(64, len(self.langs) - 64 * plane)):
                hits[64 * plane + bit] = np.bincount(who, (both >> np.uint64(bit) & np.uint64(1)).astype(float), len(texts))
        true = np.maximum(0, (hits - n * self.false[:, None]) / (1 - np.minimum(self.false, 0.999))[:, None]) if self.langs else hits
        out = []
        for i in range(len(texts)):
            if not count[i] or not self.langs:
                out.append(("und", 0.0))
            elif not (total := float(true[:, i].sum())):
                out.append((self.common, 0.0))
            else:
                best = int(np.argmax(true[:, i]))  # languages are in order: the first of equals
                out.append((self.langs[best], float(true[best, i]) / total))
        return out


def stratified(rows: DataFrame, sample_rows: int) -> DataFrame:
    """About sample_rows rows, as many of each language as there are or an equal share of what others leave."""
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    left, quota = float(sample_rows), {}
    for i, lang in enumerate(sorted(sizes, key=lambda x: (sizes[x], x))):
        quota[lang] = min(sizes[lang], left / (len(sizes) - i))
        left -= quota[lang]
    bound = F.create_map(*[F.lit(x) for lang in sizes for x in (lang, below(quota[lang] / sizes[lang]))])
    # rows with one text differ by their numbers, so a hot text is neither taken nor left as a whole
    return rows.withColumn("_n", F.monotonically_increasing_id()).where(chosen(F.element_at(bound, F.col("lang")), "text", "_n")).drop("_n")


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Filters:
    """Fit on at most about sample_rows rows whose text and label are not null."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    total = rows.count()
    if total > sample_rows:
        rows = stratified(rows, sample_rows)

    def count(batches):
        letters, seen = letter_table(), {}
        for part in rows_of(batches, "text", "lang"):
            for lang in {lang for _, lang in part}:
                h, _, _ = gram_hashes([t for t, own in part if own == lang], letters)
                seen.setdefault(lang, []).append(np.unique(h, return_counts=True))
        schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
        for lang, found in seen.items():
            grams, back = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
            n = np.bincount(back, np.concatenate([c for _, c in found])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams.view(np.int64)), pa.array(n)], schema=schema)

    grams = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = grams.where(F.col("n") >= LEAST_COUNT).toArrow()  # bounded by the sample
    langs = sorted({r[0] for r in rows.select("lang").distinct().collect()})
    lang, gram, n = np.array(table["lang"].to_pylist(), object), table["gram"].to_numpy().view(np.uint64), table["n"].to_numpy()
    totals = {x: max(1, int(n[lang == x].sum())) for x in langs}
    share = n / np.array([totals[x] for x in lang]) if len(n) else np.zeros(0)
    _, back = np.unique(gram, return_inverse=True)
    most = np.zeros(int(back.max()) + 1 if len(back) else 0)
    np.maximum.at(most, back, share)
    claimed = share >= CLAIM * most[back]
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    common = min(counts, key=lambda x: (-counts[x], x)) if counts else None
    return Filters.of(langs, common, {x: gram[claimed & (lang == x)] for x in langs})


def identified(docs: DataFrame, filters: Filters, keep: list[str], text_col: str = "text") -> DataFrame:
    """(row, lang_pred, score); row holds the columns in keep, so that their names clash with none."""
    spark = docs.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(filters.parts())
    source = docs.select(F.struct(*keep).alias("row"), F.col(text_col).alias("text"))
    kind = T.StructType([source.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        letters, filters = letter_table(), Filters(*shared.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found: list[tuple[str, float]] = []
            part: list = []
            size = 0
            for t in texts:  # by about 300,000 characters at a time
                part.append(t)
                size += len(t or "")
                if size > 300_000:
                    found += filters.predict(part, letters)
                    part, size = [], 0
            found += filters.predict(part, letters) if part else []
            cols = [batch.column("row"), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=["row", "lang_pred", "score"])

    return source.mapInArrow(run, kind)


def predict(docs: DataFrame, filters: Filters, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns in keep, with lang_pred and score."""
    return identified(docs, filters, keep, text_col).select("row.*", "lang_pred", "score")


def held_out(col: Column) -> Column:
    return F.crc32(col.cast("string")) % 5 == 0


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    filters = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, filters, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, filters: Filters) -> DataFrame:
    """The rows whose language can be told, with all columns.

    ``und`` rows go, and texts none of whose n-grams is known (score 0).  Without labels no
    language can be told and no row stays.
    """
    return identified(docs, filters, docs.columns).where("lang_pred <> 'und' and score > 0").select("row.*")
