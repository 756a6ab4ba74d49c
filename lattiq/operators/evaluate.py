"""Transcript evaluation: references against hypotheses, scores, summaries, confusions, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.functions import text as X
from lattiq.operators.align import aligned_pairs, with_path


def references(lines: DataFrame) -> DataFrame:
    """(id, text) from (line_no, text, id); brackets and bars leave the id, the last line of an id wins."""
    return lines.groupBy(X.clean_id(F.col("id")).alias("id")).agg(F.max_by("text", "line_no").alias("text"))


def hypotheses(lines: DataFrame) -> DataFrame:
    """(id, text, rank) from (line_no, text, id): id up to its first ``)``, white space made single, text NULL dropped."""
    name = F.replace(F.split(F.col("id"), r"\)")[0], F.lit("("), F.lit(""))
    rows = lines.select(name.alias("id"), F.regexp_replace("text", r"\s+", " ").alias("text"), "line_no").where("text <> 'NULL'")
    return rows.withColumn("rank", F.expr("row_number() over (partition by id order by line_no)")).drop("line_no")


def corrupted(refs: DataFrame, factor: int = 31) -> DataFrame:
    """A hypothesis for each reference (id long, tokens) by an arithmetic rule on token places."""
    key = lambda i: (F.col("id") * factor + i + 1) % 10
    edit = lambda t, i: F.when(key(i) == 0, F.array().cast("array<string>")).when(key(i) == 3, F.array(F.concat(F.lit("#"), t))).when(key(i) == 6, F.array(t, t)).otherwise(F.array(t))
    return refs.select("id", F.flatten(F.transform("tokens", edit)).alias("hyp"))


def score(pairs: DataFrame, ref: str = "ref", hyp: str = "hyp", cost: tuple[int, int, int] = (1, 1, 1)) -> DataFrame:
    """pairs with path, C, M, D, I, S, distance, Corr and Acc."""
    out = with_path(pairs, ref, hyp, cost)
    steps = {x: F.char_length(F.regexp_replace("path", f"[^{x}]", "")).cast("long") for x in "MDIS"}
    out = out.withColumns({"C": F.coalesce(F.array_size(ref), F.lit(0)).cast("long"), **steps})
    c, weighted = F.col("C"), sum((F.col(x) * w for x, w in zip("DIS", cost, strict=True)), F.lit(0).cast("long"))
    return out.withColumns({"distance": weighted, "corr": X.rate(c - F.col("D") - F.col("S"), c), "acc": X.rate(c - F.col("D") - F.col("I") - F.col("S"), c)})


def summary(scores: DataFrame, *by: str) -> DataFrame:
    """Corpus totals, micro rates (null for an empty corpus), macro rates, and the share of perfect sentences."""
    sums = [F.sum(x).alias(x) for x in "CMDIS"]
    perfect = (F.col("C") == F.col("M")) & (F.col("D") + F.col("I") + F.col("S") == 0)
    out = scores.groupBy(*by).agg(*sums, F.count("*").alias("sentences"), F.count_if(perfect).alias("perfect"), F.round(F.avg("corr"), 4).alias("macro_corr"), F.round(F.avg("acc"), 4).alias("macro_acc"))
    part = lambda x: F.round(F.try_divide(F.lit(100.0) * x, F.col("C")), 2)
    return out.withColumns({"corr": part(F.col("C") - F.col("D") - F.col("S")), "acc": part(F.col("C") - F.col("D") - F.col("I") - F.col("S")), "sentence_acc": F.round(F.try_divide(F.lit(100.0) * F.col("perfect"), F.col("sentences")), 2)})


def pair_rows(scores: DataFrame, *keep: str) -> DataFrame:
    """One row for each aligned pair."""
    return scores.select(*keep, F.inline(aligned_pairs(F.col("ref"), F.col("hyp"), F.col("path")))).select(*keep, "pos", "op", F.col("ref").alias("ref_token"), F.col("hyp").alias("hyp_token"))


def confusions(pairs: DataFrame) -> DataFrame:
    """Counts of matched and substituted pairs with their share of the reference token."""
    n = pairs.where("op in ('M', 'S')").groupBy("ref_token", "hyp_token").agg(F.count("*").alias("n"))
    return n.withColumn("ratio", F.round(F.col("n") / F.expr("sum(n) over (partition by ref_token)"), 6))


def tokens(text: Column, level: str, syllables: Column | None = None) -> Column:
    """Tokens of a text at the level word, character or syllable (with a map of syllables)."""
    if level == "word":
        return X.words(text)
    return X.syllables(text, syllables) if level == "syllable" else X.characters(text)


def evaluate(refs: DataFrame, hyps: DataFrame, level: str = "character", syllables: Column | None = None) -> DataFrame:
    """Scores of the first hypothesis of each id (id, text, rank) against its reference (id, text); other ids do not count."""
    first = hyps.where("rank = 1").select("id", tokens(F.col("text"), level, syllables).alias("hyp"))
    return score(refs.select("id", tokens(F.col("text"), level, syllables).alias("ref")).join(first, "id"))


PAIR_NAMES = {"M": "MCH", "S": "SUB", "D": "DEL", "I": "INS"}


def report(scores: DataFrame, analysis: bool = True) -> DataFrame:
    """(id, block): one text block for each utterance, tokens padded to their partners; analysis: lines of matches and substitutions too."""
    steps = aligned_pairs(F.col("ref"), F.col("hyp"), F.col("path"))
    side = lambda own, other: F.array_join(F.transform("_steps", lambda s: X.padded(s["op"], s[own], s[other])), " ")
    shown = F.col("_steps") if analysis else F.filter("_steps", lambda s: s["op"].isin("D", "I"))
    name = F.create_map(*[F.lit(x) for kv in PAIR_NAMES.items() for x in kv])
    ends = lambda s: F.concat(F.when(s["op"] == "I", "").otherwise(F.concat(F.lit(" "), s["ref"])), F.lit(" ->"), F.when(s["op"] == "D", "").otherwise(F.concat(F.lit(" "), s["hyp"])))
    lines = F.array_join(F.transform(shown, lambda s: F.concat(F.element_at(name, s["op"]), F.lit(":"), ends(s), F.lit("\n"))), "")
    head: Column = F.format_string("FILE: %s\nREF: %s\nHYP: %s\nEdit_Distance: %d\nUtterance:\tCorr:%.2f Acc:%.2f\tC:%d M:%d D:%d I:%d S:%d\n%s", "id", side("ref", "hyp"), side("hyp", "ref"), "distance", "corr", "acc", "C", "M", "D", "I", "S", lines)
    return scores.withColumn("_steps", steps).select("id", head.alias("block"))


def summary_block(totals: DataFrame) -> DataFrame:
    """(block): the lines that end a report; rates are 0 for an empty corpus."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    text = F.format_string("\n#### Summary of %d sentences\nSentence Accuracy: %.2f (%d/%d)\nCharacter-level:\tCorr:%.2f Acc:%.2f\tC:%d M:%d D:%d I:%d S:%d", "sentences", zero("sentence_acc"), "perfect", "sentences", zero("corr"), zero("acc"), *(count(x) for x in "CMDIS"))
    return totals.select(text.alias("block"))


def report_rows(scores: DataFrame, analysis: bool = True) -> DataFrame:
    """(last, id, value): the blocks and the summary of a report; last and id order them."""
    blocks = report(scores, analysis).select(F.lit(0).alias("last"), "id", F.col("block").alias("value"))
    end = summary_block(summary(scores)).select(F.lit(1).alias("last"), F.lit("").alias("id"), F.col("block").alias("value"))
    return blocks.unionByName(end)


def whole_report(scores: DataFrame, analysis: bool = True) -> DataFrame:
    """(value): the blocks in the order of their ids, an empty line after each, then the summary; for a text sink."""
    return report_rows(scores, analysis).orderBy("last", "id").select("value")


def syllable_tokens(rows: DataFrame, table: DataFrame, default: str = "UNK") -> DataFrame:
    """(id, tokens): the characters of texts (id, text; ids do not repeat) as the syllables of a table (ch, syl); what it lacks becomes default.

    The distinct characters of a text are joined with the table, which may be of any size, and only those that it has go to the text, as a map.
    """
    each = rows.select(F.col("id").alias("_id"), F.explode(F.array_distinct(X.characters(F.col("text")))).alias("ch")).join(table.select("ch", "syl"), "ch")
    found = each.groupBy("_id").agg(F.map_from_entries(F.collect_set(F.struct("ch", "syl"))).alias("_map"))  # the characters of one text
    joined = rows.join(found.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("_id")), "left")  # texts are not sorted
    return joined.select("id", F.coalesce(F.when(F.col("_map").isNull(), F.transform(X.characters(F.col("text")), lambda t: F.lit(default))).otherwise(X.syllables(F.col("text"), F.col("_map"), default)), F.array().cast("array<string>")).alias("tokens"))


RESULT_COLUMNS = ["no", "file name", "file number", "answer", "result_1(0%)", "result_2(random)", "replace", "insert", "delete"]


def result_rows(lines: DataFrame, mark: str = "82119") -> DataFrame:
    """(file_name, num, text) of recogniser lines ``text (spk..mark..``: 15 characters from the mark on, a number up to .wav, text without blanks."""
    value, at = F.col("value"), F.instr("value", mark)
    stop, speaker = F.instr("value", ".wav"), F.instr("value", "(spk")
    cut = lambda lo, n: F.substring(value, lo, F.greatest(n, F.lit(0)))
    rows = lines.where((at > 0) & (stop > 0) & (speaker > 0))
    return rows.select(cut(at, F.lit(15)).alias("file_name"), cut(at + 16, stop - at - 16).alias("num"), F.replace(cut(F.lit(1), speaker - 2), F.lit(" "), F.lit("")).alias("text"))


def comparison(answers: DataFrame, *results: DataFrame) -> DataFrame:
    """The nine-column table: answers (no, file_name, num, text) with up to two results (file_name, num, text); the last three stay empty.

    An answer without a result gets an empty field; of several results for one answer the last in text order stays.
    """
    out = answers.select("no", "file_name", "num", F.col("text").alias("answer"))
    for i, r in enumerate(results):
        out = out.join(r.groupBy("file_name", "num").agg(F.max("text").alias(f"r{i}")), ["file_name", "num"], "left")
    value = lambda i: F.coalesce(F.col(f"r{i}"), F.lit("")) if i < len(results) else F.lit("")
    columns = [F.col("no"), F.col("file_name"), F.col("num"), F.col("answer"), value(0), value(1), F.lit(""), F.lit(""), F.lit("")]
    return out.select(*(c.alias(n) for c, n in zip(columns, RESULT_COLUMNS, strict=True)))


def write_comparison(table: DataFrame, path: str) -> None:
    table.orderBy("no").write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)
