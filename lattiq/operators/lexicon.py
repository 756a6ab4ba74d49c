"""Symbols, lexicons, lookups, phonetic fallback, confusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.operators.steps import numbered

EPS = "<eps>"


def symbols(labels: DataFrame) -> DataFrame:
    """(sym, id): distinct labels (column sym) in byte order from 1; <eps> is 0."""
    rest = numbered(labels.select("sym").distinct().where(F.col("sym") != EPS), ["sym"], "id").withColumn("id", (F.col("id") + 1).cast("int"))
    return rest.unionByName(labels.sparkSession.range(1).select(F.lit(EPS).alias("sym"), F.lit(0).cast("int").alias("id")))


def merge(*tables: DataFrame) -> DataFrame:
    out = tables[0].select("sym")
    for t in tables[1:]:
        out = out.union(t.select("sym"))
    return symbols(out)


def lookup(rows: DataFrame, label: str, table: DataFrame, missing: int | None = None) -> DataFrame:
    """rows with column id; a label that the table lacks is an error, or gets the id missing."""
    out = rows.join(table.select(F.col("sym").alias(label), "id"), label, "left")
    fail = F.raise_error(F.concat(F.lit("no such symbol: "), F.col(label))).cast("int") if missing is None else F.lit(missing)
    return out.withColumn("id", F.coalesce("id", fail))


def fallback(rows: DataFrame, table: DataFrame, *keys: str, default: str) -> DataFrame:
    """rows with column physical: that of the first of the key columns that the table (logical, physical) has."""
    out = rows
    for i, k in enumerate(keys):
        out = out.join(table.select(F.col("logical").alias(k), F.col("physical").alias(f"_p{i}")), k, "left")
    return out.withColumn("physical", F.coalesce(*[F.col(f"_p{i}") for i in range(len(keys))], F.lit(default))).drop(*[f"_p{i}" for i in range(len(keys))])


def duplicates(models: DataFrame, key: str) -> DataFrame:
    return models.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def unique_models(models: DataFrame, key: str) -> DataFrame:
    """models; a name that occurs twice is an error."""
    n = models.groupBy(key).agg(F.count("*").alias("_n"))
    return models.join(n, key).where(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("two models of one name: "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)).drop("_n")


def label_symbols(lexicon: DataFrame, models: DataFrame) -> DataFrame:
    """(sym, id) of all words and phones of a lexicon (word, phones) and all model names (model)."""
    return merge(lexicon.select(F.col("word").alias("sym")), lexicon.select(F.explode("phones").alias("sym")), models.select(F.col("model").alias("sym")))


def model_index(arcs: DataFrame, models: DataFrame) -> DataFrame:
    """arcs with column model: the index of the input label among models (model, id); -1 for <eps>, -k - 100 for D=k; a miss is an error."""
    out = arcs.join(models.select(F.col("model").alias("ilabel"), F.col("id").alias("_id")), "ilabel", "left")
    fixed = F.when(F.col("ilabel") == EPS, F.lit(-1)).when(F.col("ilabel").startswith("D="), -F.substring("ilabel", 3, 20).try_cast("int") - 100)
    return out.withColumn("model", F.coalesce(fixed, F.col("_id"), F.raise_error(F.concat(F.lit("no such model: "), F.col("ilabel"))).cast("int"))).drop("_id")


def missing_models(arcs: DataFrame, models: DataFrame) -> DataFrame:
    """(label, n): input labels that are neither models nor <eps> nor D=k, as a report."""
    wanted = arcs.where((F.col("ilabel") != EPS) & ~F.col("ilabel").startswith("D=")).groupBy(F.col("ilabel").alias("label")).agg(F.count("*").alias("n"))
    return wanted.join(models.select(F.col("model").alias("label")), "label", "left_anti")


def tied_models(models: DataFrame, states: DataFrame, matrices: DataFrame) -> DataFrame:
    """(model, states, tm): state names (model, names) and a matrix name (matrix) resolved to ids (state, id) and (matrix, id); a miss is an error."""
    rows = models.select("model", "matrix", F.posexplode("names").alias("i", "state")).join(states.select("state", F.col("id").alias("s")), "state", "left")
    miss = lambda c: F.raise_error(F.concat(F.lit("not found: "), F.col(c))).cast("int")
    rows = rows.withColumn("s", F.coalesce("s", miss("state")))
    packed = rows.groupBy("model", "matrix").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("p"))
    return packed.join(matrices.select("matrix", F.col("id").alias("tm")), "matrix", "left").select("model", F.col("p.s").alias("states"), F.coalesce("tm", miss("matrix")).alias("tm"))


SILENT = (EPS, "sil", "sp")


def logical_form(label: Column) -> Column:
    """A context label as it is looked up: <F> is <eps>; eps, sil and sp stand alone; a missing side is silence."""
    part = lambda k: F.regexp_extract(label, r"(?s)^(.*)-(.*)\+(.*)$", k)
    left, centre, right = part(1), part(2), part(3)
    side = lambda c: F.when(c.isin(EPS, "<F>"), "sil").otherwise(c)
    whole = F.concat(side(left), F.lit("-"), centre, F.lit("+"), side(right))
    alone = F.when(label == "<F>", EPS).otherwise(label)
    return F.when(centre == "", alone).when(centre == "<F>", EPS).when(centre.isin(*SILENT), centre).otherwise(whole)


def to_physical(rows: DataFrame, table: DataFrame, label: str = "label", missing: str = "<none>") -> DataFrame:
    """rows with column physical: that of the logical form in the table (logical, physical); a label with two real sides falls back to L-C, then C+R.

    Labels without context stand for themselves; what is not found at all becomes the visible mark missing.
    """
    part = lambda k: F.regexp_extract(F.col(label), r"(?s)^(.*)-(.*)\+(.*)$", k)
    real = ~part(1).isin(*SILENT, "<F>", "") & ~part(3).isin(*SILENT, "<F>", "")
    keyed = rows.withColumns({"_k": logical_form(F.col(label)), "_l": F.when(real, F.concat(part(1), F.lit("-"), part(2))), "_r": F.when(real, F.concat(part(2), F.lit("+"), part(3)))})
    alone = ~F.contains("_k", F.lit("+"))
    out = keyed
    for c in ("_k", "_l", "_r"):
        out = out.join(table.select(F.col("logical").alias(c), F.col("physical").alias(f"{c}p")), c, "left")
    return out.withColumn("physical", F.coalesce("_kp", F.when(alone, F.col("_k")), "_lp", "_rp", F.lit(missing))).drop("_k", "_l", "_r", "_kp", "_lp", "_rp")


def syllable_map(rows: DataFrame) -> DataFrame:
    """One row: a map of characters to syllables (ch, syl); the writing system bounds it."""
    return rows.agg(F.map_from_entries(F.collect_list(F.struct("ch", "syl"))).alias("syllables"))


def confusion_ratios(counts: DataFrame) -> DataFrame:
    """(ref, hyp, n) with each row's share of its ref."""
    return counts.withColumn("ratio", F.expr("n / sum(n) over (partition by ref)"))


def confusion_lines(sentences: DataFrame, confusions: DataFrame, at_least: float = 0.1) -> DataFrame:
    """(id, line): every combination of the likely confusions of a sentence's tokens (id, tokens), written token_confusion, the last one with _@."""
    likely = confusions.where(F.col("ratio") > at_least).groupBy("ref").agg(F.array_sort(F.collect_set("hyp")).alias("hyps"))
    places = sentences.select("id", F.size("tokens").alias("n"), F.posexplode("tokens").alias("i", "ref")).join(likely, "ref", "left")
    end = F.when(F.col("i") == F.col("n") - 1, "_@").otherwise("")
    forms = F.transform(F.coalesce("hyps", F.array("ref")), lambda h: F.concat(F.col("ref"), F.lit("_"), h, end))
    packed = places.withColumn("forms", forms).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "forms"))).alias("c"))
    grown = F.aggregate(F.col("c.forms"), F.array(F.array().cast("array<string>")), lambda acc, fs: F.flatten(F.transform(acc, lambda a: F.transform(fs, lambda f: F.concat(a, F.array(f))))))
    return packed.select("id", F.explode(grown).alias("x")).select("id", F.array_join("x", " ").alias("line"))


def confusion_entries(lines: DataFrame, phones: DataFrame) -> DataFrame:
    """(entry, phones): the distinct tokens of confusion lines with the phones (syl, phones) of their confusion; a miss is an error."""
    entry = lines.select(F.explode(F.split("line", " ")).alias("entry")).distinct().withColumn("syl", F.split("entry", "_")[1])
    out = entry.join(phones, "syl", "left")
    return out.select("entry", F.coalesce("phones", F.raise_error(F.concat(F.lit("no phones: "), F.col("syl")))).alias("phones"))


def distinct_entries(lexicon: DataFrame) -> DataFrame:
    return lexicon.dropDuplicates(["word", "phones"])


def pronunciations(words: DataFrame, confusions: DataFrame, at_least: float = 0.1) -> DataFrame:
    """(word, phones): every combination of the likely confusions (ref, hyp, ratio) of a word's syllables (word, syls).

    A syllable without a ratio above the bound stands for itself; the number of rows of a word is the product
    over its syllables, which is the feature.
    """
    likely = confusions.where(F.col("ratio") > at_least).groupBy("ref").agg(F.array_sort(F.collect_set("hyp")).alias("hyps"))
    places = words.select("word", F.posexplode("syls").alias("i", "ref")).join(likely, "ref", "left")
    choices = places.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("hyps", F.array("ref")).alias("hyps")))).alias("c"))
    grown = F.aggregate(F.col("c.hyps"), F.array(F.array().cast("array<string>")), lambda acc, hyps: F.flatten(F.transform(acc, lambda a: F.transform(hyps, lambda h: F.concat(a, F.array(h))))))
    return choices.select("word", F.explode(grown).alias("phones"))


def compose_models(syllables: DataFrame, models: DataFrame) -> DataFrame:
    """(syl, states): the states of the initial and final models (model, states) of each syllable (syl, initial, final) in sequence.

    A syllable without an initial has its final's states only; a name that is no model fails.
    """
    named = lambda c: models.select(F.col("model").alias(c), F.col("states").alias(f"{c}_states"))
    rows = syllables.join(named("initial"), "initial", "left").join(named("final"), "final", "left")
    miss = (F.col("initial").isNotNull() & F.col("initial_states").isNull()) | F.col("final_states").isNull()
    both = F.concat(F.coalesce("initial_states", F.array().cast("array<int>")), F.col("final_states"))
    return rows.select("syl", F.when(miss, F.raise_error(F.concat(F.lit("no such model: "), F.col("syl"))).cast("array<int>")).otherwise(both).alias("states"))
