"""Deterministic corruption of transcripts: substitution by keyed places, homophones, cuts.

Choices come from integer arithmetic on row keys and places, so reruns and other engines agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def substitute(tokens: Column, key: Column, every: int = 7) -> Column:
    """Tokens whose keyed place divides by every are replaced by their neighbour; the last never changes."""
    n = F.size(tokens)
    return F.transform(tokens, lambda t, i: F.when(((key * 13 + i) % every == 0) & (i < n - 1), F.element_at(tokens, (i + 2).cast("int"))).otherwise(t))


def homophones(sounds: DataFrame, common: DataFrame) -> DataFrame:
    """(ch, alts): for each character (ch, sound) the others of the same sound that are common (column ch), in order.

    One row for each character: the table is as small as the writing system.
    """
    kept = sounds.join(common.select("ch").distinct(), "ch", "left_semi").select(F.col("ch").alias("alt"), "sound").distinct()
    pairs = sounds.distinct().join(kept, "sound").where("ch <> alt")
    return pairs.groupBy("ch").agg(F.array_sort(F.collect_set("alt")).alias("alts"))


def change_count(length: Column, key: Column, lo: float = 0.7, hi: float | None = None) -> Column:
    """How many places change: from round(lo * length) to length - 1, or to round(hi * length), by key."""
    a = F.bround(length * F.lit(lo)).cast("int")
    b = (length - 1 if hi is None else F.bround(length * F.lit(hi)).cast("int"))
    return F.greatest(F.lit(0), a + F.pmod(key * 7, F.greatest(F.lit(1), b - a + 1)).cast("int"))


#: What is CJK: X.is_cjk
CJK_FIRST, CJK_LAST = 0x4E00, 0x9FA5


class Homophones:
    """Keyed substitution by a table of (ch, alts), with numpy over the code points of a text."""

    def __init__(self, table: list[tuple[str, list[str]]]) -> None:
        kept = [(ord(ch), alts) for ch, alts in table if ch and len(ch) == 1 and CJK_FIRST <= ord(ch) <= CJK_LAST and alts]
        self.entry = np.full(CJK_LAST - CJK_FIRST + 1, -1)
        self.entry[[c - CJK_FIRST for c, _ in kept]] = np.arange(len(kept))
        self.size = np.array([len(alts) for _, alts in kept], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = [x for _, alts in kept for x in alts]
        self.codes = np.array([ord(x) for x in self.flat], np.uint32) if all(len(x) == 1 for x in self.flat) else None

    def changed(self, text: str | None, key: int | None, count: int | None) -> str | None:
        """The text with the first count places, of all but the last one in the order of ((key * 31 + i * 17) % 101, i), changed."""
        if text is None or key is None or not count or len(text) < 2:
            return text
        x = np.frombuffer(text.encode("utf-32-le"), np.uint32).copy()
        rank = (np.arange(len(x) - 1) * 17 + key * 31 % 101) % 101
        upto = np.cumsum(np.bincount(rank, minlength=101))
        top = min(int(np.searchsorted(upto, count)), 100)  # the last rank that changes, of which not all places may
        goes = rank < top
        goes[np.flatnonzero(rank == top)[: count - (int(upto[top - 1]) if top else 0)]] = True
        at = np.flatnonzero(goes & (x[:-1] >= CJK_FIRST) & (x[:-1] <= CJK_LAST))
        entry = self.entry[x[at] - CJK_FIRST]
        at, entry = at[entry >= 0], entry[entry >= 0]
        pick = self.start[entry] + (key % self.size[entry] + at) % self.size[entry]
        if self.codes is not None:
            x[at] = self.codes[pick]
            return x.tobytes().decode("utf-32-le")
        out = list(text)
        for i, k in zip(at.tolist(), pick.tolist(), strict=True):
            out[i] = self.flat[k]
        return "".join(out)


def substitute_homophones(rows: DataFrame, table: DataFrame, key: str = "id", text: str = "text", lo: float = 0.7, hi: float | None = None) -> DataFrame:
    """rows with text changed at keyed places to keyed homophones (ch, alts); the last character never changes, nor what is not CJK.

    The table goes to the tasks with the code: a row for each character of the script.
    """
    known = Homophones([(r["ch"], r["alts"]) for r in table.select("ch", "alts").collect()])
    place, schema = rows.columns.index(text), rows.schema

    def run(batches):
        for batch in batches:
            *columns, keys, counts = batch.columns
            columns[place] = pa.array([known.changed(*r) for r in zip(columns[place].to_pylist(), keys.to_pylist(), counts.to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-2])

    count = change_count(F.char_length(text), F.col(key), lo, hi)
    return rows.select("*", F.col(key).cast("long").alias("_key"), count.alias("_count")).mapInArrow(run, schema)


def cuts(rows: DataFrame, signal: str, key: str, widths: tuple[int, ...] = (50, 100, 150), repeats: int = 3) -> DataFrame:
    """rows with the signal less a window of twice the width around a keyed place: (width, repeat) copies of each, where the signal is long enough."""
    n = F.size(signal)
    grid = F.array(*[F.struct(F.lit(w).alias("width"), F.lit(r).alias("repeat")) for w in widths for r in range(1, repeats + 1)])
    out = rows.withColumn("_g", F.explode(grid)).withColumns({"width": F.col("_g.width"), "repeat": F.col("_g.repeat")}).where(n >= 2 * F.col("width"))
    at = (F.col("width") + F.pmod(F.col(key) * 13 + F.col("repeat") * 7, n - 2 * F.col("width") + 1)).cast("int")
    front, end = F.slice(signal, F.lit(1), at - F.col("width")), F.slice(signal, at + F.col("width") + 1, F.greatest(F.lit(0), n - at - F.col("width")))
    return out.withColumn(signal, F.concat(front, end)).drop("_g")
