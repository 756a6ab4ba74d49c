"""Queries on transcripts at character and syllable level, result tables, homophones, confusion networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattiq.functions import text as X
from lattiq.operators import evaluate as E
from lattiq.operators import lexicon as L
from lattiq.operators import perturb as P
from lattiq.plans.registry import DP, ORACLE_SQL, hyp_sql, query, r6, scored, table, vectors
from lattiq.sources import text

#: Tokens of a text at character level: those that are not pure ASCII fall into their characters.
CHARS = "flatten(list_transform(string_split(regexp_replace({t}, ' +$', ''), ' '), lambda t: CASE WHEN length(t) = strlen(t) THEN [t] ELSE string_split(t, '') END))"
WORDS = "SELECT item_id AS id, string_split(text, ' ') AS ref FROM benchmark"
SCORES = 'SELECT id, "C", "M", "D", "I", "S", distance, corr, acc, path FROM scored'
HYPS = f"tok AS ({WORDS}), hyps AS ({hyp_sql(31)})"


def refs_and_hyps(spark, d):
    refs = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    hyps = E.corrupted(refs.select("id", F.split("text", " ").alias("tokens")), 31)
    return refs, hyps.select("id", F.array_join("hyp", " ").alias("text"), F.lit(1).alias("rank"))


def spread(spark, df):
    return df.repartition(spark.sparkContext.defaultParallelism, "id")  # few rows, heavy ones


@query(f"""WITH RECURSIVE {HYPS}, pairs AS (SELECT id, {CHARS.format(t="array_to_string(ref, ' ')")} AS ref, {CHARS.format(t="array_to_string(hyp, ' ')")} AS hyp FROM hyps), {DP} {SCORES}""")
def cer_char_utterance(spark, d):
    refs, hyps = refs_and_hyps(spark, d)
    return E.evaluate(spread(spark, refs), hyps, "character").select("id", *"CMDIS", "distance", "corr", "acc", "path")


#: A syllable table of our own: the first two letters of every token of more than three bytes that has an odd length.
SYL = f"SELECT DISTINCT t AS ch, t[1:2] AS syl FROM (SELECT unnest({CHARS.format(t='text')}) AS t FROM benchmark) WHERE strlen(t) > 3 AND length(t) % 2 = 1"
LOOKUP = "list_transform({x}, lambda t: coalesce(m[t], 'UNK'))"


def syllable_rows(spark, d):
    ch = table(spark, d, "benchmark").select(F.explode(X.characters(F.col("text"))).alias("ch")).distinct()
    return ch.where("octet_length(ch) > 3 and char_length(ch) % 2 = 1").select("ch", F.left("ch", F.lit(2)).alias("syl"))


@query(f"""WITH RECURSIVE {HYPS}, syl AS ({SYL}), m AS (SELECT map(list(ch), list(syl)) AS m FROM syl),
pairs AS (SELECT id, {LOOKUP.format(x=CHARS.format(t="array_to_string(ref, ' ')"))} AS ref, {LOOKUP.format(x=CHARS.format(t="array_to_string(hyp, ' ')"))} AS hyp FROM hyps, m), {DP} {SCORES}""")
def cer_syllable_utterance(spark, d):
    refs, hyps = refs_and_hyps(spark, d)
    known = syllable_rows(spark, d)
    ref, hyp = (E.syllable_tokens(spread(spark, x), known).withColumnRenamed("tokens", n) for x, n in ((refs, "ref"), (hyps, "hyp")))
    return E.score(ref.join(hyp, "id")).select("id", *"CMDIS", "distance", "corr", "acc", "path")


@query(f"SELECT id, array_to_string(list_transform(x, lambda t: coalesce(m[t], 'UNK')), ' ') AS syllables FROM (SELECT conv_id * 100 + turn AS id, {CHARS.format(t='text')} AS x FROM conversations), (SELECT map(list(ch), list(syl)) AS m FROM ({SYL}))")
def token_syllables(spark, d):
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    return E.syllable_tokens(rows, syllable_rows(spark, d)).select("id", F.array_join("tokens", " ").alias("syllables"))


@query(f"""WITH {HYPS}, first AS (SELECT id, array_to_string(hyp, '') AS text FROM hyps), tok2 AS (SELECT id, ref FROM tok),
second AS (SELECT id, array_to_string(hyp, '') AS text FROM ({hyp_sql(17).replace("FROM tok", "FROM tok2")}))
SELECT tok.id AS no, '82119' || lpad(tok.id::VARCHAR, 10, '0') AS "file name", (tok.id % 7)::VARCHAR AS "file number", array_to_string(ref, '') AS answer, first.text AS "result_1(0%)", second.text AS "result_2(random)", '' AS "replace", '' AS "insert", '' AS "delete"
FROM tok JOIN first USING (id) JOIN second ON second.id = tok.id""")
def comparison_table(spark, d):
    refs, _ = refs_and_hyps(spark, d)
    name = F.concat(F.lit("82119"), F.lpad(F.col("id").cast("string"), 10, "0"))
    answers = refs.select(F.col("id").alias("no"), name.alias("file_name"), (F.col("id") % 7).cast("string").alias("num"), F.replace("text", F.lit(" "), F.lit("")).alias("text"))

    def results(factor):
        hyp = E.corrupted(refs.select("id", F.split("text", " ").alias("tokens")), factor)
        line = F.concat(F.array_join("hyp", " "), F.lit(" (spk_"), name, F.lit("_"), (F.col("id") % 7).cast("string"), F.lit(".wav) -12.5"))
        return E.result_rows(hyp.select(line.alias("value")))

    return E.comparison(answers, results(31), results(17))


@query("SELECT page_id, 'wav/' || regexp_extract(url, '[^/]*$') AS path, (length(url) - 1) // 39 AS frames, 1.5::DOUBLE * 100 / length(url) AS rt FROM pages")
def path_prefix(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", X.with_prefix(X.basename(F.col("url")), "wav").alias("path"), X.frame_count(F.char_length("url"), 39).cast("long").alias("frames"), X.real_time_factor(F.lit(1.5), F.char_length("url")).alias("rt"))


#: A text of letters becomes one of characters U+4E00 and on; five sounds for them; common are those of even place.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
CJK = "".join(chr(0x4E00 + 3 * i) for i in range(26))
SOUND = "(unicode(ch) - 19968) // 3"


@query(f"""WITH t AS (SELECT doc_id AS id, translate(text, '{LETTERS}', '{CJK}') AS text FROM documents WHERE text IS NOT NULL AND text <> ''),
chars AS (SELECT unnest(string_split('{CJK}', '')) AS ch), sounds AS (SELECT ch, ({SOUND}) % 5 AS sound, ({SOUND}) % 2 = 0 AS common FROM chars),
alts AS (SELECT a.ch, list(b.ch ORDER BY b.ch) AS alts FROM sounds a JOIN sounds b ON a.sound = b.sound AND a.ch <> b.ch AND b.common GROUP BY a.ch), m AS (SELECT map(list(ch), list(alts)) AS m FROM alts),
c AS (SELECT id, text, length(text) AS n, round_even(length(text) * 0.7::DOUBLE, 0)::INT AS a FROM t),
p AS (SELECT id, text, n, string_split(text, '') AS x, greatest(0, a + (id * 7) % greatest(1, n - 1 - a + 1)) AS k FROM c),
e AS (SELECT id, unnest(x) AS ch, generate_subscripts(x, 1) - 1 AS i, n, k FROM p),
r AS (SELECT *, CASE WHEN i <= n - 2 THEN row_number() OVER (PARTITION BY id ORDER BY CASE WHEN i <= n - 2 THEN 0 ELSE 1 END, (id * 31 + i * 17) % 101, i) END AS rank FROM e)
SELECT id, string_agg(CASE WHEN rank <= k AND ch BETWEEN '一' AND '龥' AND coalesce(len(m[ch]), 0) > 0 THEN m[ch][(id + i) % len(m[ch]) + 1] ELSE ch END, '' ORDER BY i) AS text FROM r, m GROUP BY id""")
def homophone_substitution(spark, d):
    rows = table(spark, d, "documents").where("text is not null and text <> ''").select(F.col("doc_id").alias("id"), F.translate("text", LETTERS, CJK).alias("text"))
    place = ((F.ascii("ch") - 0x4E00) / 3).cast("int")
    ch = rows.sparkSession.range(1).select(F.explode(F.split(F.lit(CJK), "")).alias("ch"))
    return P.substitute_homophones(rows, P.homophones(ch.select("ch", (place % 5).alias("sound")), ch.where(place % 2 == 0)))


@query("SELECT page_id, len(list_filter(string_split(url, ''), lambda c: c BETWEEN '一' AND '龥'))::INT AS n FROM (SELECT page_id, translate(html, 'ae', '一龥') AS url FROM pages)")
def cjk_characters(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.translate("html", "ae", "一龥").alias("url"))
    return rows.select("page_id", F.size(F.filter(F.split("url", ""), X.is_cjk)).alias("n"))


@query(f"""WITH t AS (SELECT doc_id AS id, translate(text, '{LETTERS}', '{CJK}') AS text FROM documents WHERE text IS NOT NULL),
c AS (SELECT id, flatten(list_transform(string_split(regexp_replace(text, ' +$', ''), ' '), lambda t: CASE WHEN length(t) = strlen(t) THEN [t] ELSE string_split(t, '') END)) AS x FROM t)
SELECT id, len(x)::INT AS n, len(list_filter(x, lambda c: c BETWEEN '一' AND '龥' AND ((unicode(c) - 19968) // 3) % 2 = 0))::INT AS known, md5(array_to_string(list_transform(x, lambda c: CASE WHEN c BETWEEN '一' AND '龥' AND ((unicode(c) - 19968) // 3) % 2 = 0 THEN 's' || ((unicode(c) - 19968) // 3) ELSE 'UNK' END), ' ')) AS digest FROM c""")
def syllables_of_characters(spark, d):
    """Texts of CJK characters, every second of which has a syllable: a join of characters, whatever the size of the table."""
    rows = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.translate("text", LETTERS, CJK).alias("text"))
    ch = rows.sparkSession.range(1).select(F.explode(F.split(F.lit(CJK), "")).alias("ch"))
    place = ((F.ascii("ch") - 0x4E00) / 3).cast("int")
    got = E.syllable_tokens(rows, ch.where(place % 2 == 0).select("ch", F.concat(F.lit("s"), place.cast("string")).alias("syl")))
    return got.select("id", F.size("tokens").alias("n"), F.size(F.filter("tokens", lambda t: t != "UNK")).alias("known"), F.md5(F.array_join("tokens", " ")).alias("digest"))


@query(f"""SELECT 0 AS last, id::VARCHAR AS id, block AS value FROM ({ORACLE_SQL["cer_report"]})
UNION ALL SELECT 1, '', format('\n#### Summary of {{}} sentences\nSentence Accuracy: {{:.2f}} ({{}}/{{}})\nCharacter-level:\tCorr:{{:.2f}} Acc:{{:.2f}}\tC:{{}} M:{{}} D:{{}} I:{{}} S:{{}}', sentences, sentence_acc, perfect, sentences, corr, acc, "C", "M", "D", "I", "S") FROM ({ORACLE_SQL["cer_word_summary"]})""")
def cer_whole_report(spark, d):
    """The rows of a whole report, with the columns that order them."""
    return E.report_rows(scored(spark, d).withColumn("id", F.col("id").cast("string")))


@query("SELECT event_id, format('node:{} branch:{} state:{} score:{:.6f} hist:{}', user_id, event_id % 7, event_id % 3, value, event_id // 5) AS value FROM events")
def token_dump(spark, d):
    e = table(spark, d, "events")
    rows = e.select("event_id", F.col("user_id").cast("long").alias("node"), (F.col("event_id") % 7).alias("branch"), (F.col("event_id") % 3).alias("state"), F.col("value").alias("score"), F.floor(F.col("event_id") / 5).alias("hist"))
    return rows.select("event_id", text.token_line().alias("value"))


@query("""WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS syl FROM benchmark), s AS (SELECT syl, syl[1] AS i, syl[2:] AS f FROM w WHERE length(syl) > 1)
SELECT syl, [ascii(CASE WHEN length(syl) % 3 = 0 THEN f ELSE i END)] || CASE WHEN length(syl) % 3 = 0 THEN [length(f)] ELSE [1, ascii(f), length(f)] END AS states FROM s""")
def syllable_models(spark, d):
    """Syllables as the states of their initial and final; every third has no initial.  A model's states: its first character and its length."""
    w = table(spark, d, "benchmark").select(F.explode(F.split("text", " ")).alias("syl")).distinct().where("char_length(syl) > 1")
    parts = w.select("syl", F.when(F.char_length("syl") % 3 != 0, F.left("syl", F.lit(1))).alias("initial"), F.expr("substring(syl, 2)").alias("final"))
    names = parts.select(F.col("initial").alias("model")).unionByName(parts.select(F.col("final").alias("model"))).where("model is not null").distinct()
    models = names.select("model", F.array(F.ascii("model"), F.char_length("model")).alias("states"))
    return L.compose_models(parts, models).select("syl", "states")


WIDE = "SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings"


@query(f"""WITH g AS (SELECT vec_id, v, w AS width, r AS repeat, len(v) AS n FROM ({WIDE}), (SELECT unnest([5, 10, 15]) AS w), (SELECT unnest([1, 2, 3]) AS r)),
a AS (SELECT *, w2 + (vec_id * 13 + repeat * 7) % (n - 2 * w2 + 1) AS cut_at FROM (SELECT *, width AS w2 FROM g) WHERE n >= 2 * w2)
SELECT vec_id, width::INT AS width, repeat::INT AS repeat, len(y)::INT AS n, round(list_sum(y), 6) + 0.0 AS total FROM (SELECT *, list_concat(v[1:cut_at - width], v[cut_at + width + 1:]) AS y FROM a)""")
def random_cuts(spark, d):
    got = P.cuts(vectors(spark, d).select("vec_id", "v"), "v", "vec_id", (5, 10, 15))
    return got.select("vec_id", "width", "repeat", F.size("v").alias("n"), r6(F.aggregate("v", F.lit(0.0).cast("double"), lambda a, x: a + x)).alias("total"))


def conf_sql(tokens: str) -> str:
    return f"""toks AS ({tokens}), n AS (SELECT x.a AS ref, x.b AS hyp, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(t)), lambda k: {{'a': t[k], 'b': t[k + 1]}})) AS x FROM toks) GROUP BY ALL),
ratio AS (SELECT ref, hyp, n / sum(n) OVER (PARTITION BY ref) AS ratio FROM n)"""


CONF = conf_sql("SELECT string_split(text, ' ') AS t FROM benchmark")
SPELT = conf_sql("SELECT string_split(lower(n_name), '') AS t FROM nation")


def neighbour_confusions(t):
    """Confusions of our own: each token (t) is confused with the one behind it."""
    places = F.sequence(F.lit(1), F.size("t") - 1)
    pairs = t.where("size(t) > 1").select(F.explode(F.transform(places, lambda k: F.struct(F.element_at("t", k).alias("ref"), F.element_at("t", k + 1).alias("hyp")))).alias("x"))
    return L.confusion_ratios(pairs.groupBy("x.ref", "x.hyp").agg(F.count("*").alias("n")))


def passages(spark, d):
    return table(spark, d, "benchmark").select(F.split("text", " ").alias("t"))


@query(f"WITH {CONF} SELECT ref, hyp, round(ratio, 6) AS ratio FROM ratio WHERE ratio > 0.1")
def confusion_sets(spark, d):
    return neighbour_confusions(passages(spark, d)).where("ratio > 0.1").select("ref", "hyp", F.round("ratio", 6).alias("ratio"))


@query(f"""WITH RECURSIVE {SPELT}, likely AS (SELECT ref, list(hyp ORDER BY hyp) AS hyps FROM ratio WHERE ratio > 0.3 GROUP BY ref),
sent AS (SELECT n_nationkey AS id, string_split(lower(n_name), '') AS t FROM nation),
grow AS (SELECT id, t, 1 AS i, []::VARCHAR[] AS parts FROM sent UNION ALL
  SELECT id, t, i + 1, list_append(parts, t[i] || '_' || h || CASE WHEN i = len(t) THEN '_@' ELSE '' END) FROM (SELECT g.*, unnest(coalesce(hyps, [t[i]])) AS h FROM grow g LEFT JOIN likely ON ref = t[i] WHERE i <= len(t)))
SELECT id, array_to_string(parts, ' ') AS line FROM grow WHERE i = len(t) + 1""")
def confusion_network(spark, d):
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.split(F.lower("n_name"), "").alias("t"))
    return L.confusion_lines(names.withColumnRenamed("t", "tokens"), neighbour_confusions(names), 0.3).select("id", "line")


@query(f"WITH {CONF} SELECT DISTINCT ref || '_' || hyp || e AS entry, hyp[1:2] || ' ' || hyp[3:] AS phones FROM ratio, (SELECT unnest(['', '_@']) AS e) WHERE ratio > 0.3")
def confusion_dictionary(spark, d):
    likely = neighbour_confusions(passages(spark, d)).where("ratio > 0.3")
    lines = likely.select(F.explode(F.array(F.concat_ws("_", "ref", "hyp"), F.concat_ws("_", "ref", "hyp", F.lit("@")))).alias("line"))
    phones = likely.select(F.col("hyp").alias("syl"), F.concat(F.left("hyp", F.lit(2)), F.lit(" "), F.expr("substring(hyp, 3)")).alias("phones")).distinct()
    return L.confusion_entries(lines, phones)
