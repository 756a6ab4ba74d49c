"""Line formats: transcripts, references, hypotheses, arc graphs, n-gram models, matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.functions import text as X
from lattiq.operators.steps import numbered, running_sum


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value); the number is the place within the file's partition order."""
    return spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())


def transcripts(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return transcript_lines(spark.read.text(path), strict)


def transcript_lines(lines: DataFrame, strict: bool = True) -> DataFrame:
    """(file_name, text) from lines of exactly two tokens; other lines fail, or go where strict is off."""
    parts = lines.select(F.split(F.trim("value"), r"\s+").alias("p"))
    good = F.size("p") == 2
    rows = parts.where(F.when(good, True).otherwise(F.raise_error(F.lit("a transcript line has two tokens")).cast("boolean"))) if strict else parts.where(good)
    return rows.select(F.col("p")[0].alias("file_name"), F.col("p")[1].alias("text"))


def tab_lines(spark: SparkSession, path: str) -> DataFrame:
    return tabbed(numbered_lines(spark, path))


def tabbed(lines: DataFrame) -> DataFrame:
    """(line_no, text, id) of lines ``text<TAB>id``, for evaluate.references and evaluate.hypotheses."""
    return lines.select("line_no", F.split("value", "\t")[0].alias("text"), F.split("value", "\t")[1].alias("id"))


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    return lexicon_lines(spark.read.text(path))


def lexicon_lines(lines: DataFrame) -> DataFrame:
    """(word, phones) of lines ``word phone ...``; repeated entries are one."""
    p = F.split(F.trim("value"), r"\s+")
    return lines.where("trim(value) <> ''").select(p[0].alias("word"), F.slice(p, F.lit(2), F.size(p) - 1).alias("phones")).dropDuplicates()


def arcs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_arcs(spark.read.text(path))


def resolved_arcs(arcs_: DataFrame, symbols: DataFrame) -> DataFrame:
    """arcs with columns in_id and out_id from symbols (sym, id); D=k inputs are -k - 100; a label that is no symbol is an error."""
    find = lambda df, label, name: df.join(symbols.select(F.col("sym").alias(label), F.col("id").alias(name)), label, "left")
    miss = lambda label: F.raise_error(F.concat(F.lit("no such symbol: "), F.col(label))).cast("int")
    out = find(find(arcs_, "ilabel", "in_id"), "olabel", "out_id")
    return out.withColumns({"in_id": F.coalesce(X.dictionary_label(F.col("ilabel")), "in_id", miss("ilabel")), "out_id": F.coalesce("out_id", miss("olabel"))})


def parse_arcs(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(arcs, finals) of a text graph; weights go from log10 to ln, a missing output is the input."""
    p = F.split(F.trim("value"), r"[\t ]+")
    rows = lines.where("trim(value) <> ''").select(p.alias("p"), F.size(p).alias("n"))
    label = lambda k: F.try_element_at("p", F.lit(k))
    third = label(4)
    plain = third.isNull() | X.is_number(third)
    weight = F.coalesce(F.when(plain, third).otherwise(label(5)).try_cast("double"), F.lit(0.0))
    out = rows.where("n > 1").select(F.col("p")[0].cast("long").alias("src"), F.col("p")[1].cast("long").alias("dst"), label(3).alias("ilabel"), F.when(plain, label(3)).otherwise(third).alias("olabel"), X.to_ln(weight).alias("w"))
    return out, rows.where("n = 1").select(F.col("p")[0].cast("long").alias("node"))


def arc_lines(arcs_: DataFrame, finals: DataFrame) -> DataFrame:
    """Lines of a text graph; weights in log10, none where 0."""
    w = F.when(F.col("w") != 0, X.to_log10(F.col("w")).cast("string"))
    return arcs_.select(F.concat_ws("\t", "src", "dst", "ilabel", "olabel", w).alias("value")).union(finals.select(F.col("node").cast("string")))


def ngrams(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, words, logp, backoff) of ARPA files; a line's order is that of the last heading before it in its file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("pos"), "value")
    return parse_ngrams(lines)


def parse_ngrams(lines: DataFrame) -> DataFrame:
    """(file, ord, words, logp, backoff) of lines (file, pos, value); ln values, missing back-off 0.

    The headings, a few for each file, are joined as one array a file; lines stay where they are.
    """
    heading = F.regexp_extract("value", r"^\\(\d+)-grams:", 1).try_cast("int")
    heads = lines.where(heading.isNotNull()).groupBy("file").agg(F.collect_list(F.struct("pos", heading.alias("ord"))).alias("heads"))
    held = lines.join(F.broadcast(heads), "file").withColumn("h", F.array_max(F.filter("heads", lambda h: h["pos"] < F.col("pos"))))
    p = F.split(F.trim("value"), r"\s+")
    rows = held.select("file", F.col("h.ord").alias("ord"), p.alias("p")).where((F.size("p") > F.col("ord")) & X.is_number(F.col("p")[0]))
    return rows.select("file", "ord", F.slice("p", F.lit(2), F.col("ord")).alias("words"), X.to_ln(F.col("p")[0].cast("double")).alias("logp"), X.to_ln(F.coalesce(F.try_element_at("p", F.col("ord") + 2).try_cast("double"), F.lit(0.0))).alias("backoff"))


def ark(spark: SparkSession, path: str) -> DataFrame:
    return parse_ark(spark.read.text(path, lineSep="]"))


def parse_ark(pieces: DataFrame) -> DataFrame:
    """(utt, t, x) of a text matrix archive cut at ``]``."""
    name = F.regexp_extract("value", r"^(\S+)\s+\[", 1)
    blank = F.lit(" \t\r\n")
    body = F.split(F.btrim(F.regexp_extract("value", r"(?s)\[(.*?)\]", 1), blank), r"\s*\n\s*")
    utterances = pieces.select(F.concat(F.btrim("value", blank), F.lit("]")).alias("value")).where(F.contains("value", F.lit("[")))
    rows = utterances.select(name.alias("utt"), F.posexplode(body).alias("t", "row"))
    return rows.select("utt", "t", F.split(F.trim("row"), r"\s+").cast("array<float>").alias("x"))


def decode_lines(results: DataFrame) -> DataFrame:
    """Lines ``words<TAB>(id)<TAB>score`` of results (id, words, score); no words is written NULL, silence and ends are left out."""
    shown = F.filter("words", lambda w: ~w.isin("sil", "<eps>", "</s>"))
    return results.select(F.format_string("%s\t(%s)\t%.6f", F.when(F.col("words").isNull(), "NULL").otherwise(F.array_join(shown, " ")), "id", "score").alias("value"))


def dot_lines(arcs_: DataFrame, words: int | None = None) -> DataFrame:
    """(place, value): the lines of a DOT file, arcs in the order of src and dst.

    words: nodes are written up to that which reaches so many arcs with a word (an output other than <eps> and <F>).  Nodes that
    an earlier node's word arc leads to are left out.
    """
    word = ~F.col("olabel").isin("<eps>", "<F>")
    reached = arcs_.where(word).groupBy(F.col("dst").alias("src")).agg(F.min("src").alias("_from"))
    kept = arcs_.join(reached, "src", "left").where("_from is null or _from >= src").drop("_from") if words is not None else arcs_
    if words is not None:
        per = running_sum(kept.groupBy("src").agg(F.count_if(word).alias("n")), ["src"], F.col("n"), "upto", before=True)
        kept = kept.join(per.where(F.col("upto") < words).select("src"), "src", "left_semi")
    label = F.format_string('%s->%s [label="%s:%s"];', F.col("src").cast("string"), F.col("dst").cast("string"), "ilabel", "olabel")
    edges = numbered(kept, ["src", "dst", "ilabel", "olabel"], "place").select((F.col("place") + 3).alias("place"), label.alias("value"))
    spark = arcs_.sparkSession
    head = spark.createDataFrame([(0, "digraph g{"), (1, 'edge [fontname="MSJH"];'), (2, "rankdir=LR;")], "place long, value string")
    return head.unionByName(edges).unionByName(spark.createDataFrame([((1 << 62), "}")], "place long, value string"))


def vector_text(x, each: int):
    """Values joined by commas, a line break after every ``each``."""
    places = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / each).cast("int"))
    return F.when(F.size(x) > 0, F.array_join(F.transform(places, lambda k: F.array_join(F.slice(x, k * each + 1, F.lit(each)).cast("array<string>"), ",")), ",\n")).otherwise("")


def scoring_lines(rows: DataFrame) -> DataFrame:
    """Lines ``text<TAB>(id)`` with all blanks taken out of the text."""
    return rows.select(F.concat(F.replace("text", F.lit(" "), F.lit("")), F.lit("\t("), F.col("id"), F.lit(")")).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    """One column of lines as text, replacing what is there."""
    lines.write.mode("overwrite").text(path)


def lines_of(values: DataFrame) -> DataFrame:
    """Rows (place, value) as one column in the order of the places."""
    return values.orderBy("place").select("value")


def syllables(spark: SparkSession, path: str) -> DataFrame:
    return syllable_lines(numbered_lines(spark, path))


def syllable_lines(lines: DataFrame, blank: str = r"\s+") -> DataFrame:
    """(ch, syl) of lines ``character syllable``; the last line of a character wins.  blank: what lies between (a pattern)."""
    p = F.split("value", blank, 2)
    return lines.where(F.size(p) == 2).groupBy(p[0].alias("ch")).agg(F.max_by(p[1], "line_no").alias("syl"))


def symbol_names(spark: SparkSession, path: str) -> DataFrame:
    return symbol_lines(spark.read.text(path))


def symbol_lines(lines: DataFrame) -> DataFrame:
    """(sym): the first field of each line."""
    return lines.where("trim(value) <> ''").select(F.split(F.trim("value"), r"[\t ]+")[0].alias("sym"))


def feature_list(lines: DataFrame) -> DataFrame:
    """(transcription, speaker, path) of lines ``TRANSCRIPT<TAB>(speaker_path)``."""
    p = F.split("value", "\t")
    inner = F.regexp_extract(p[1], r"^\((.*)\)$", 1)
    return lines.select(p[0].alias("transcription"), F.regexp_extract(inner, "^([^_]*)_", 1).alias("speaker"), F.regexp_extract(inner, "^[^_]*_(.*)$", 1).alias("path"))


def files(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(path, name, bytes) of all files below a folder; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select("path", X.basename(F.col("path")).alias("name"), F.col("length").alias("bytes")).where(F.endswith("name", F.lit(suffix)))


def check_list(wanted: DataFrame, present: DataFrame, strict: bool = True) -> DataFrame:
    """wanted (path) with column there; strict: a missing file, or an empty list, is an error."""
    if strict and wanted.isEmpty():
        raise ValueError("the list of inputs is empty")
    out = wanted.join(present.select("path", F.lit(True).alias("_there")).distinct(), "path", "left").withColumn("there", F.coalesce("_there", F.lit(False))).drop("_there")
    return out.where(F.when(F.col("there"), True).otherwise(F.raise_error(F.concat(F.lit("no such file: "), F.col("path"))).cast("boolean"))) if strict else out


def confusion_lines(lines: DataFrame) -> DataFrame:
    """(ref, hyp, n, ratio) of a square matrix of counts: a row ``syllable n n ...`` for each, columns in the order of the rows (line_no)."""
    p = F.split(F.trim("value"), r"[\t ]+")
    rows = numbered(lines.where("trim(value) <> ''"), ["line_no"], "row").select("row", p[0].alias("ref"), F.slice(p, F.lit(2), F.size(p) - 1).alias("c"))
    cells = rows.select("ref", F.posexplode("c").alias("row", "n")).withColumn("n", F.col("n").cast("long"))
    named = cells.join(rows.select("row", F.col("ref").alias("hyp")), "row").select("ref", "hyp", "n")
    return named.withColumn("ratio", F.expr("try_divide(n, sum(n) over (partition by ref))"))


def redirect_lines(paths: DataFrame) -> DataFrame:
    """(node, line) of a redirect table (node, stop, w, path): ``count stop,log10 w,branches ...``."""
    one = F.struct("stop", F.array_join(F.col("path").cast("array<string>"), ".").alias("p"), F.format_string("%.6f", X.to_log10(F.col("w"))).alias("w"))
    packed = paths.groupBy("node").agg(F.array_sort(F.collect_list(one)).alias("x"))  # a few paths a node, as closure() checks
    texts = F.transform("x", lambda r: F.concat_ws(",", r["stop"].cast("string"), r["w"], r["p"]))
    return packed.select("node", F.concat_ws(" ", F.size("x").cast("string"), F.array_join(texts, " ")).alias("line"))


def redirect_table(lines: DataFrame) -> DataFrame:
    """(node, stop, w, path) of redirect lines (node, line); a line ``0`` has none."""
    p = F.split(F.trim("line"), " ")
    rows = lines.select("node", F.explode(F.slice(p, F.lit(2), F.size(p) - 1)).alias("x")).select("node", F.split("x", ",").alias("f"))
    return rows.select("node", F.col("f")[0].cast("long").alias("stop"), X.to_ln(F.col("f")[1].cast("double")).alias("w"), F.split(F.col("f")[2], r"\.").cast("array<int>").alias("path"))


def ark_lines(frames: DataFrame) -> DataFrame:
    """(utt, value): frames (utt, t, x) as text matrices ``utt [ values .. ]``."""
    row = F.concat(F.array_join(F.transform("x", lambda v: F.format_string("%f", v.cast("double"))), " "), F.lit(" \n"))
    packed = frames.select("utt", F.struct("t", row.alias("r")).alias("f")).groupBy("utt").agg(F.array_sort(F.collect_list("f")).alias("f"))
    return packed.select("utt", F.concat("utt", F.lit(" [ "), F.array_join("f.r", ""), F.lit("]")).alias("value"))


def test_frames(spark: SparkSession, frames: int, window: int, dim: int, seed: int = 1) -> DataFrame:
    """(utt, t, x): keyed values in -0.5 .. 0.5, the first and the last frame repeated by half a window on each side."""
    if window % 2 != 1:
        raise ValueError("the window must be odd")
    half = window // 2
    value = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.greatest(F.lit(0), F.least(F.lit(frames - 1), F.col("t") - half)), i), F.lit(1_000_000)) / 1e6 - 0.5
    return spark.range(frames + window - 1).select(F.lit("test").alias("utt"), F.col("id").cast("int").alias("t")).withColumn("x", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), value))


def lattice_lines(rows: DataFrame) -> DataFrame:
    """Lines of a lattice (start, stop, word, prev, am, lm), in order."""
    line = F.concat_ws("\t", F.col("start").cast("string"), F.col("stop").cast("string"), "word", "prev", F.format_string("%.6f", "am"), F.format_string("%.6f", "lm"))
    return rows.orderBy("start", "stop", "word", "prev").select(line.alias("value"))


def token_line() -> Column:
    """The line of a token (node, branch, state, score, hist)."""
    return F.format_string("node:%d branch:%d state:%d score:%.6f hist:%d", "node", "branch", "state", "score", "hist")


def token_lines(tokens: DataFrame) -> DataFrame:
    """One line a token, for a look at a search."""
    return tokens.select(token_line().alias("value"))


def array_header(name: str, kind: str, values: DataFrame, each: int = 20) -> DataFrame:
    """One row (value): a C array of the values (place, v), a line break after every each; for tables small enough for a chip."""
    packed = values.agg(F.array_sort(F.collect_list(F.struct("place", "v"))).alias("x"), F.count("*").alias("n"))
    return packed.select(F.concat(F.lit(f"const {kind} {name}["), F.col("n").cast("string"), F.lit("]={"), vector_text(F.col("x.v"), each), F.lit("};")).alias("value"))


def auxiliary_lexicon(spark: SparkSession, sentences: int = 0) -> DataFrame:
    """(word, phones) of silence, ends and connectors, and of a label ``@k`` for each sentence."""
    fixed = spark.createDataFrame([("sil", ["sil"]), ("sp", ["sp"]), ("<s>", ["sil"]), ("</s>", ["sil"]), ("<eps>", ["<eps>"]), ("<F>", ["<F>"])], "word string, phones array<string>")
    return fixed.unionByName(spark.range(sentences).select(F.concat(F.lit("@"), F.col("id").cast("string")).alias("word"), F.array(F.lit("sil")).alias("phones")))


def silence_graph(spark: SparkSession, optional: bool = False) -> tuple[DataFrame, DataFrame]:
    """(arcs, finals) of a silence, or of one that may be a short pause or nothing."""
    labels = ["sil", "sp", "<eps>"] if optional else ["sil"]
    return spark.createDataFrame([(0, 1, x, "<eps>", 0.0) for x in labels], "src long, dst long, ilabel string, olabel string, w double"), spark.createDataFrame([(1,)], "node long")
