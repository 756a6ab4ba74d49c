"""Back-off n-gram models as arcs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.operators.steps import cut, transient_shuffles
from lattiq.operators.windows import BUCKET, counted_windows, packed_windows


def bigram_counts(sentences: DataFrame) -> DataFrame:
    """(a, b, n) over tokens with sentence ends."""
    padded = sentences.select(F.concat(F.array(F.lit("<s>")), "tokens", F.array(F.lit("</s>"))).alias("t"))
    pairs = padded.select(F.explode(F.arrays_zip(F.slice("t", F.lit(1), F.size("t") - 1).alias("a"), F.slice("t", F.lit(2), F.size("t") - 1).alias("b"))).alias("p"))
    return pairs.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n"))


def backoff_arcs(bigrams: DataFrame) -> DataFrame:
    """Arcs of the word graph of a bigram model: words leave the back-off node <B>, words fall back to it.

    Weights are relative frequencies (ln); the back-off weight of a word is ln 0.4.
    """
    of_a = bigrams.groupBy("a").agg(F.sum("n").alias("na"))
    of_b = bigrams.where("b <> '</s>'").groupBy("b").agg(F.sum("n").alias("nb"))
    all_b = of_b.agg(F.sum("nb").alias("all"))
    top = bigrams.join(of_a, "a").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("b").alias("label"), F.ln(F.col("n") / F.col("na")).alias("w"))
    uni = of_b.crossJoin(F.broadcast(all_b)).select(F.lit("<B>").alias("src"), F.col("b").alias("dst"), F.col("b").alias("label"), F.ln(F.col("nb") / F.col("all")).alias("w"))
    back = of_b.select(F.col("b").alias("src"), F.lit("<B>").alias("dst"), F.lit("<F>").alias("label"), F.ln(F.lit(0.4)).alias("w"))
    return top.unionByName(uni).unionByName(back)


def ngram_table(sentences: DataFrame, order: int, backoff: float = 0.4) -> DataFrame:
    """(ord, words, logp, backoff) up to an order: relative frequencies (ln) and one back-off weight.

    Only n-grams below the order that do not end a sentence fall back.  The table is closed: it has all
    prefixes and suffixes of its n-grams.  Words are counted first, in a table of their own.
    """
    t = sentences.select(F.concat(F.array(F.lit("<s>")), "tokens", F.array(F.lit("</s>"))).alias("t")).where("t is not null")
    seen = t.select(F.explode(F.transform("t", lambda x, i: F.struct(x.alias("word"), (i < F.size("t") - 1).alias("inner")))).alias("x")).select("x.*")
    with transient_shuffles(sentences.sparkSession):
        words = cut(seen.groupBy("word").agg(F.count("*").alias("n"), F.count_if("inner").alias("inner")))
    n = words.agg(F.sum("n")).first()[0] or 0
    parts = [words.select(F.lit(1).alias("ord"), F.array("word").alias("words"), "n", F.lit(n).alias("total"))]
    if order > 1:
        buckets = max(int(sentences.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // BUCKET))
        common = words.where(F.col("inner") * (4 * buckets) > n).select("word", "inner").collect()  # fewer than 4 * buckets
        blocks = t.mapInArrow(packed_windows(order, buckets, [r["word"] for r in common]), "bucket int, block binary")
        dealt = blocks.repartitionById(buckets, "bucket").select("block")
        parts.append(dealt.mapInArrow(counted_windows(order, {r["word"]: r["inner"] for r in common}), "ord int, words array<string>, n long, total long"))
    falls = (F.col("ord") < order) & (F.element_at("words", -1) != "</s>")
    return reduce(DataFrame.unionByName, parts).select("ord", "words", F.ln(F.col("n") / F.col("total")).alias("logp"), F.when(falls, F.ln(F.lit(backoff))).otherwise(F.lit(0.0)).alias("backoff"))


def ngram_graph(ngrams: DataFrame, order: int, closed: bool = False) -> DataFrame:
    """Arcs (src, dst, label, w) of a back-off model (ord, words, logp, backoff) of any order.

    A state is an n-gram's words; ``aux:`` states lie between a state and what it falls back to, the
    longest known shorter suffix, <B> below unigrams.  An n-gram whose prefix or whose every suffix is
    unknown is left out.  The arc of a sentence end carries all back-off weights of its suffixes.

    closed: all prefixes and suffixes of n-grams are known and sentence ends do not fall back, as in an
    ``ngram_table``.  An n-gram then has all that its arcs need, and nothing is written, joined or dealt out.
    """
    g = ngrams.select("ord", "words", F.array_join("words", " ").alias("g"), "logp", "backoff", F.element_at("words", -1).alias("label"))
    if closed:
        part = lambda first, n: F.array_join(F.slice("words", first, n), " ")
        rows = g.select("*", part(F.lit(1), F.col("ord") - 1).alias("src"), part(F.lit(2), F.col("ord") - 1).alias("to"), F.lit(0.0).alias("below"))
        return _inlined(rows, *_word_arcs(F.col("ord") == 1), *_higher_arcs(order, F.col("ord") > 1))
    g = cut(g)
    known = g.select(F.col("g").alias("s"), F.col("ord").alias("k"), F.col("backoff").alias("b"))
    high = g.where("ord > 1").withColumn("src", F.array_join(F.slice("words", F.lit(1), F.col("ord") - 1), " ")).drop("words")
    tails = g.where("ord > 1").select("g", F.explode(F.transform(F.sequence(F.lit(1), F.col("ord") - 1), lambda k: F.array_join(F.slice("words", F.col("ord") - k + 1, k), " "))).alias("s"))
    falls = tails.join(known.hint("merge"), "s").groupBy("g").agg(F.max_by("s", "k").alias("to"), F.sum("b").alias("below"))
    high = high.join(falls.hint("merge"), "g").join(known.select(F.col("s").alias("src")).hint("merge"), "src", "left_semi")  # all as large as the model: none goes over the driver
    return _inlined(g.where("ord = 1"), *_word_arcs(F.lit(True))).unionByName(_inlined(high, *_higher_arcs(order, F.lit(True))))


def _inlined(rows: DataFrame, *arcs: Column) -> DataFrame:
    return rows.select(F.inline(F.array_compact(F.array(*arcs))))


def _arc(when: Column, src: Column, dst: Column, label: Column, w: Column) -> Column:
    return F.when(when, F.struct(src.alias("src"), dst.alias("dst"), label.alias("label"), w.alias("w")))


def _own(to: Column, when: Column) -> list[Column]:
    """The arcs by which the state of an n-gram falls back."""
    aux, fall = F.concat(F.lit("aux:"), F.col("g")), F.lit("<F>")
    return [_arc(when, F.col("g"), aux, fall, F.col("backoff")), _arc(when, aux, to, fall, F.lit(0.0))]


def _word_arcs(when: Column) -> list[Column]:
    """Arcs of a unigram (g, label, logp, backoff)."""
    return [*_own(F.lit("<B>"), when & (F.col("label") != "</s>")), _arc(when & (F.col("label") != "<s>"), F.lit("<B>"), F.col("g"), F.col("label"), F.col("logp"))]


def _higher_arcs(order: int, when: Column) -> list[Column]:
    """Arcs of a longer n-gram (ord, g, src, to, label, logp, backoff, below)."""
    end, lone = F.col("label") == "</s>", (F.col("ord") < order) | (F.col("src") == F.col("to"))
    inside = _arc(when & ~end, F.col("src"), F.when(lone, F.col("g")).otherwise(F.col("to")), F.col("label"), F.col("logp"))
    ends = _arc(when & end, F.col("src"), F.lit("</s>"), F.col("label"), F.col("logp") + F.col("backoff") + F.col("below"))
    return [inside, *_own(F.col("to"), when & ~end & lone), ends]
