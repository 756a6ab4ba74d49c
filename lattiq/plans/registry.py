"""All registered queries of the library itself and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.functions import text as X
from lattiq.operators import align as A
from lattiq.operators import evaluate as E
from lattiq.operators import frames as R
from lattiq.operators import graph as G
from lattiq.operators import lexicon as L
from lattiq.operators import ngram as B
from lattiq.operators import nn as N
from lattiq.operators import perturb as P
from lattiq.operators import rewrite as W
from lattiq.operators import search as S
from lattiq.operators.steps import numbered, running_sum

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c):
    """Six decimals, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


# ---- transcript evaluation ---------------------------------------------------------------

TOK = "SELECT item_id AS id, string_split(text, ' ') AS ref FROM benchmark"


def hyp_sql(factor: int) -> str:
    edit = f"CASE (id * {factor} + i) % 10 WHEN 0 THEN []::VARCHAR[] WHEN 3 THEN ['#' || ref[i]] WHEN 6 THEN [ref[i], ref[i]] ELSE [ref[i]] END"
    return f"SELECT id, ref, flatten(list_transform(range(1, len(ref) + 1), lambda i: {edit})) AS hyp FROM tok"


#: The cost table row by row: a recursive query over hypothesis tokens, a list fold over reference tokens.
DP = """
first AS (SELECT id, ref, hyp, 0 AS p, list_transform(range(0, len(ref) + 1), lambda q: {'q': q, 'c': q, 'm': 0::BIGINT, 'd': q, 'i': 0::BIGINT, 's': 0::BIGINT, 'path': repeat('D', q)}) AS line FROM pairs),
dp AS (SELECT * FROM first UNION ALL
  SELECT id, ref, hyp, p + 1,
    list_reduce(list_transform(range(1, len(ref) + 1), lambda q: [{'q': q, 'c': 0::BIGINT, 'm': 0::BIGINT, 'd': 0::BIGINT, 'i': 0::BIGINT, 's': 0::BIGINT, 'path': ''}]),
      lambda acc, x: list_append(acc, CASE
        WHEN ref[x[1].q] = hyp[p + 1] THEN {'q': x[1].q, 'c': line[x[1].q].c, 'm': line[x[1].q].m + 1, 'd': line[x[1].q].d, 'i': line[x[1].q].i, 's': line[x[1].q].s, 'path': line[x[1].q].path || 'M'}
        WHEN acc[len(acc)].c <= line[x[1].q + 1].c AND acc[len(acc)].c <= line[x[1].q].c THEN {'q': x[1].q, 'c': acc[len(acc)].c + 1, 'm': acc[len(acc)].m, 'd': acc[len(acc)].d + 1, 'i': acc[len(acc)].i, 's': acc[len(acc)].s, 'path': acc[len(acc)].path || 'D'}
        WHEN line[x[1].q + 1].c <= line[x[1].q].c THEN {'q': x[1].q, 'c': line[x[1].q + 1].c + 1, 'm': line[x[1].q + 1].m, 'd': line[x[1].q + 1].d, 'i': line[x[1].q + 1].i + 1, 's': line[x[1].q + 1].s, 'path': line[x[1].q + 1].path || 'I'}
        ELSE {'q': x[1].q, 'c': line[x[1].q].c + 1, 'm': line[x[1].q].m, 'd': line[x[1].q].d, 'i': line[x[1].q].i, 's': line[x[1].q].s + 1, 'path': line[x[1].q].path || 'S'} END),
      [{'q': 0::BIGINT, 'c': (p + 1)::BIGINT, 'm': 0::BIGINT, 'd': 0::BIGINT, 'i': (p + 1)::BIGINT, 's': 0::BIGINT, 'path': repeat('I', p + 1)}])
  FROM dp WHERE p < len(hyp)),
scored AS (SELECT id, ref, hyp, len(ref)::BIGINT AS "C", c.m AS "M", c.d AS "D", c.i AS "I", c.s AS "S", c.c AS distance, c.path AS path,
  CASE WHEN len(ref) > 0 THEN round(100.0 * (len(ref) - c.d - c.s)::DOUBLE / len(ref), 2) ELSE 0 END AS corr,
  CASE WHEN len(ref) > 0 THEN round(100.0 * (len(ref) - c.d - c.i - c.s)::DOUBLE / len(ref), 2) ELSE 0 END AS acc
  FROM (SELECT id, ref, hyp, line[len(line)] AS c FROM dp WHERE p = len(hyp)))
"""


def scored_sql(select: str, factor: int = 31) -> str:
    return f"WITH RECURSIVE tok AS ({TOK}), pairs AS ({hyp_sql(factor)}), {DP} {select}"


def scored(spark: SparkSession, d: str, factor: int = 31) -> DataFrame:
    refs = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.split("text", " ").alias("tokens"))
    pairs = refs.join(E.corrupted(refs, factor), "id").withColumnRenamed("tokens", "ref")
    # the fold is heavy for each row: spread the few rows over the cores
    return E.score(pairs.repartition(spark.sparkContext.defaultParallelism, "id"))


@query(scored_sql('SELECT id, "C", "M", "D", "I", "S", distance, corr, acc, path FROM scored'))
def cer_word_utterance(spark, d):
    return scored(spark, d).select("id", *"CMDIS", "distance", "corr", "acc", "path")


@query(scored_sql("""SELECT sum("C")::BIGINT AS "C", sum("M")::BIGINT AS "M", sum("D")::BIGINT AS "D", sum("I")::BIGINT AS "I", sum("S")::BIGINT AS "S", count(*) AS sentences,
count(*) FILTER (WHERE "C" = "M" AND "D" + "I" + "S" = 0) AS perfect, round(avg(corr), 4) AS macro_corr, round(avg(acc), 4) AS macro_acc,
round(100.0::DOUBLE * (sum("C") - sum("D") - sum("S"))::DOUBLE / sum("C"), 2) AS corr, round(100.0::DOUBLE * (sum("C") - sum("D") - sum("I") - sum("S"))::DOUBLE / sum("C"), 2) AS acc,
round(100.0::DOUBLE * count(*) FILTER (WHERE "C" = "M" AND "D" + "I" + "S" = 0) / count(*), 2) AS sentence_acc FROM scored"""))
def cer_word_summary(spark, d):
    return E.summary(scored(spark, d))


PAIRS_SQL = """, steps AS (SELECT id, ref, hyp, path, unnest(range(1, len(path) + 1)) AS pos FROM scored),
aligned AS (SELECT id, pos, path[pos] AS op,
  CASE WHEN path[pos] <> 'I' THEN ref[len(regexp_replace(path[1:pos], '[^MSD]', '', 'g'))] END AS ref_token,
  CASE WHEN path[pos] <> 'D' THEN hyp[len(regexp_replace(path[1:pos], '[^MSI]', '', 'g'))] END AS hyp_token FROM steps)
"""


@query(scored_sql("", 31).rstrip() + PAIRS_SQL + "SELECT id, pos::INT AS pos, op, ref_token, hyp_token FROM aligned")
def cer_alignment_pairs(spark, d):
    return E.pair_rows(scored(spark, d), "id")


@query(scored_sql("", 31).rstrip() + PAIRS_SQL + ", n AS (SELECT ref_token, hyp_token, count(*) AS n FROM aligned WHERE op IN ('M', 'S') GROUP BY ALL) SELECT ref_token, hyp_token, n, round(n / sum(n) OVER (PARTITION BY ref_token), 6) AS ratio FROM n")
def confusion_counts(spark, d):
    return E.confusions(E.pair_rows(scored(spark, d), "id"))


WIDTH = "CASE WHEN length({t}) = strlen({t}) THEN length({t}) ELSE 2 * length({t}) END"
W_REF, W_HYP = WIDTH.format(t="ref_token"), WIDTH.format(t="hyp_token")
#: Aligned tokens side by side, and a line for each pair.
SHOWN = f""", shown AS (SELECT id, pos, op,
  CASE op WHEN 'I' THEN repeat(' ', {W_HYP}) WHEN 'S' THEN repeat(' ', greatest(0, ({W_HYP}) - ({W_REF}))) || ref_token ELSE ref_token END AS r,
  CASE op WHEN 'D' THEN repeat(' ', {W_REF}) WHEN 'S' THEN repeat(' ', greatest(0, ({W_REF}) - ({W_HYP}))) || hyp_token ELSE hyp_token END AS h,
  CASE op WHEN 'M' THEN 'MCH: ' || ref_token || ' -> ' || hyp_token WHEN 'S' THEN 'SUB: ' || ref_token || ' -> ' || hyp_token WHEN 'D' THEN 'DEL: ' || ref_token || ' ->' ELSE 'INS: -> ' || hyp_token END || chr(10) AS line FROM aligned),
sides AS (SELECT id, string_agg(r, ' ' ORDER BY pos) AS rs, string_agg(h, ' ' ORDER BY pos) AS hs, string_agg(line, '' ORDER BY pos) AS lines FROM shown GROUP BY id)
"""


@query(scored_sql("", 31).rstrip() + PAIRS_SQL + SHOWN + """SELECT id, format('FILE: {}\nREF: {}\nHYP: {}\nEdit_Distance: {}\nUtterance:\tCorr:{:.2f} Acc:{:.2f}\tC:{} M:{} D:{} I:{} S:{}\n{}', id::VARCHAR, rs, hs, distance, corr, acc, "C", "M", "D", "I", "S", lines) AS block FROM scored JOIN sides USING (id)""")
def cer_report(spark, d):
    return E.report(scored(spark, d).withColumn("id", F.col("id").cast("string"))).withColumn("id", F.col("id").cast("long"))


@query(f"""WITH tok AS ({TOK}), a AS ({hyp_sql(31)}), b AS ({hyp_sql(17)})
SELECT tok.id, array_to_string(tok.ref, ' ') AS answer, array_to_string(a.hyp, ' ') AS first, array_to_string(b.hyp, ' ') AS second FROM tok LEFT JOIN a ON a.id = tok.id LEFT JOIN b ON b.id = tok.id""")
def answer_vs_two_results(spark, d):
    refs = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.split("text", " ").alias("tokens"))
    one = E.corrupted(refs, 31).select("id", F.array_join("hyp", " ").alias("first"))
    two = E.corrupted(refs, 17).select("id", F.array_join("hyp", " ").alias("second"))
    return refs.select("id", F.array_join("tokens", " ").alias("answer")).join(one, "id", "left").join(two, "id", "left")


def turns(spark, d):
    return table(spark, d, "conversations")


@query("SELECT conv_id::VARCHAR AS id, regexp_replace(text, '\\s+', ' ', 'g') AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE turn % 4 <> 0) WHERE r = 1")
def nbest_first(spark, d):
    lines = turns(spark, d).select(F.concat(F.lit("("), F.col("conv_id").cast("string"), F.lit(")\t-1.5")).alias("id"), F.when(F.col("turn") % 4 == 0, "NULL").otherwise(F.col("text")).alias("text"), F.col("turn").alias("line_no"))
    return E.hypotheses(lines).where("rank = 1").select("id", "text")


@query("SELECT conv_id::VARCHAR AS id, max_by(text, turn) AS text FROM conversations GROUP BY ALL")
def references_last_wins(spark, d):
    return E.references(turns(spark, d).select(F.format_string("(%d|)", "conv_id").alias("id"), "text", F.col("turn").alias("line_no")))


@query("SELECT conv_id, turn, len(string_split(regexp_replace(text, ' +$', ''), ' '))::INT AS n_words, list_sum(list_transform(string_split(regexp_replace(text, ' +$', ''), ' '), lambda t: CASE WHEN length(t) = strlen(t) THEN 1 ELSE length(t) END))::INT AS n_chars FROM conversations")
def token_levels(spark, d):
    return turns(spark, d).select("conv_id", "turn", F.size(X.words(F.col("text"))).alias("n_words"), F.size(X.characters(F.col("text"))).alias("n_chars"))


@query("SELECT page_id, regexp_extract(url, '[^/]*$') AS base, left(url, greatest(length(url) - 4, 0)) AS stem, replace(url, ' ', '') AS packed, TRY_CAST(regexp_extract(url, '[0-9]+') AS DOUBLE) IS NOT NULL AS numeric FROM pages")
def path_functions(spark, d):
    return table(spark, d, "pages").select("page_id", X.basename(F.col("url")).alias("base"), X.without_extension(F.col("url")).alias("stem"), F.replace("url", F.lit(" "), F.lit("")).alias("packed"), X.is_number(F.regexp_extract("url", "[0-9]+", 0)).alias("numeric"))


# ---- symbols and lexicons ----------------------------------------------------------------

WORDS_B = "SELECT DISTINCT unnest(string_split(text, ' ')) AS sym FROM benchmark"
WORDS_C = "SELECT DISTINCT unnest(string_split(text, ' ')) AS sym FROM conversations"


def labels(spark, d, name):
    return table(spark, d, name).select(F.explode(F.split("text", " ")).alias("sym"))


@query(f"SELECT sym, (row_number() OVER (ORDER BY sym))::INT AS id FROM ({WORDS_B}) UNION ALL SELECT '<eps>', 0")
def symbol_table(spark, d):
    return L.symbols(labels(spark, d, "benchmark"))


@query(f"SELECT sym, (row_number() OVER (ORDER BY sym))::INT AS id FROM ({WORDS_B} UNION {WORDS_C}) UNION ALL SELECT '<eps>', 0")
def symbol_merge(spark, d):
    return L.merge(labels(spark, d, "benchmark"), labels(spark, d, "conversations"))


@query(f"WITH s AS (SELECT sym, row_number() OVER (ORDER BY sym) AS id FROM ({WORDS_B})), w AS (SELECT unnest(string_split(text, ' ')) AS label FROM conversations) SELECT label, coalesce(id, -1)::INT AS id, count(*) AS n FROM w LEFT JOIN s ON s.sym = label GROUP BY ALL")
def label_lookup_unk(spark, d):
    counts = labels(spark, d, "conversations").groupBy(F.col("sym").alias("label")).agg(F.count("*").alias("n"))
    return L.lookup(counts, "label", L.symbols(labels(spark, d, "benchmark")), missing=-1)


@query(f"""WITH t AS (SELECT sym AS logical, '#' || sym AS physical FROM ({WORDS_B}) WHERE length(sym) > 3), w AS ({WORDS_C})
SELECT sym AS tri, sym[1:4] AS lo, sym[-4:] AS hi, coalesce(a.physical, b.physical, c.physical, '<none>') AS physical FROM w LEFT JOIN t a ON a.logical = sym LEFT JOIN t b ON b.logical = sym[1:4] LEFT JOIN t c ON c.logical = sym[-4:]""")
def fallback_lookup(spark, d):
    known = labels(spark, d, "benchmark").distinct().where("char_length(sym) > 3").select(F.col("sym").alias("logical"), F.concat(F.lit("#"), "sym").alias("physical"))
    rows = labels(spark, d, "conversations").distinct().select(F.col("sym").alias("tri"), F.left("sym", F.lit(4)).alias("lo"), F.right("sym", F.lit(4)).alias("hi"))
    return L.fallback(rows, known, "tri", "lo", "hi", default="<none>").select("tri", "lo", "hi", "physical")


@query("SELECT phones, count(*) AS n FROM (SELECT text AS phones FROM documents WHERE text IS NOT NULL) GROUP BY ALL HAVING count(*) > 1")
def duplicate_models(spark, d):
    return L.duplicates(table(spark, d, "documents").where("text is not null").select(F.col("text").alias("phones")), "phones")


@query("""WITH t AS (SELECT item_id AS id, unnest(string_split(text, ' ')) AS c, generate_subscripts(string_split(text, ' '), 1) AS i FROM benchmark)
SELECT id, i::INT AS i, coalesce(lag(c) OVER w, 'sil') || '-' || c || '+' || coalesce(lead(c) OVER w, 'sil') AS label FROM t WINDOW w AS (PARTITION BY id ORDER BY i)""")
def triphone_expand(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("id").orderBy("i")
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.posexplode(F.split("text", " ")).alias("i", "c"))
    return rows.select("id", (F.col("i") + 1).cast("int").alias("i"), X.triphone(F.coalesce(F.lag("c").over(w), F.lit("sil")), F.col("c"), F.coalesce(F.lead("c").over(w), F.lit("sil"))).alias("label"))


@query("""SELECT doc_id, array_to_string(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN (doc_id * 13 + i - 1) % 7 = 0 AND i < len(t) THEN t[i + 1] ELSE t[i] END), ' ') AS text FROM (SELECT doc_id, string_split(text, ' ') AS t FROM documents)""")
def perturb_tokens(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("t"))  # split once, not once for each token
    return rows.select("doc_id", F.array_join(P.substitute(F.col("t"), F.col("doc_id")), " ").alias("text"))


# ---- graphs ------------------------------------------------------------------------------

GRAPH = """tok AS (SELECT item_id AS id, string_split(text, ' ') AS t, len(string_split(text, ' ')) - 1 AS n FROM benchmark),
base AS (SELECT *, coalesce(sum(n) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n) OVER () AS total FROM tok),
steps AS (SELECT *, unnest(range(0, n + 1)) AS i FROM base),
arcs AS (SELECT CASE WHEN i = 0 THEN 0 ELSE b + i END::BIGINT AS src, CASE WHEN i = n THEN total + 1 ELSE b + i + 1 END::BIGINT AS dst, t[i + 1] AS ilabel, t[i + 1] AS olabel, 0.0::DOUBLE AS w FROM steps)"""


def graph(spark, d):
    return G.context_graph(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.split("text", " ").alias("tokens")))


def size_of(finals):
    return finals.first()[0] + 1  # one number for each graph


@query(f"WITH {GRAPH} SELECT * FROM arcs")
def context_graph(spark, d):
    return graph(spark, d)[0]


@query(f"WITH {GRAPH} SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM arcs UNION ALL SELECT dst, 0, 1 FROM arcs) GROUP BY node")
def graph_degree(spark, d):
    return G.degrees(graph(spark, d)[0])


@query(f"WITH {GRAPH}, n AS (SELECT src AS node, count(*) AS n_arcs FROM arcs GROUP BY src) SELECT node, n_arcs, coalesce(sum(n_arcs) OVER (ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM n")
def graph_csr(spark, d):
    return G.offsets(graph(spark, d)[0])


FLIP = "CASE {c} WHEN 0 THEN (SELECT max(dst) FROM arcs) WHEN (SELECT max(dst) FROM arcs) THEN 0 ELSE {c} END AS {a}"


@query(f"WITH {GRAPH} SELECT {FLIP.format(c='dst', a='src')}, {FLIP.format(c='src', a='dst')}, ilabel, olabel, w FROM arcs")
def graph_reverse(spark, d):
    arcs, finals = graph(spark, d)
    return G.reverse(arcs, size_of(finals) - 1)


@query(f"WITH {GRAPH} SELECT * FROM arcs UNION ALL SELECT (SELECT max(dst) FROM arcs), 0, '<eps>', '<eps>', -0.5::DOUBLE * ln(10.0::DOUBLE)")
def graph_loop(spark, d):
    arcs, finals = graph(spark, d)
    return G.add_loop(arcs, size_of(finals) - 1, -0.5, back=True)


@query(f"""WITH {GRAPH}, k AS (SELECT max(dst) AS f, max(dst) + 1 AS n FROM arcs), g AS (SELECT 1 AS o UNION ALL SELECT 1 + n FROM k)
SELECT src + o AS src, dst + o AS dst, ilabel, olabel, w FROM arcs, g UNION ALL SELECT 0, o, '<F>', '<F>', 0.0::DOUBLE FROM g UNION ALL SELECT f + o, 1 + 2 * n, '<F>', '<F>', 0.0::DOUBLE FROM k, g""")
def graph_stack(spark, d):
    arcs, finals = graph(spark, d)
    n = size_of(finals)
    return G.stack([(arcs, finals, n), (arcs, finals, n)])[0]


@query(f"""WITH {GRAPH}, k AS (SELECT max(dst) AS f, max(dst) + 1 AS n FROM arcs)
SELECT * FROM arcs UNION ALL SELECT src + n, dst + n, ilabel, olabel, w FROM arcs, k UNION ALL SELECT f, n, '<eps>', '<eps>', 0.0::DOUBLE FROM k""")
def graph_concat(spark, d):
    arcs, finals = graph(spark, d)
    n = size_of(finals)
    return G.concat([(arcs, finals, n), (arcs, finals, n)])


HOLES = "eps_arcs AS (SELECT src, dst, CASE WHEN dst % 3 = 0 THEN '<eps>' ELSE ilabel END AS ilabel, -0.25::DOUBLE AS w FROM arcs)"


CLOSURE = """paths AS (SELECT src AS node, dst AS stop, w, 1 AS depth FROM eps_arcs WHERE ilabel = '<eps>'
  UNION ALL SELECT p.node, a.dst, p.w + a.w, p.depth + 1 FROM paths p JOIN eps_arcs a ON a.src = p.stop WHERE a.ilabel = '<eps>' AND p.depth < 30)
SELECT p.node, p.stop, round(p.w, 6) AS w, p.depth FROM paths p WHERE EXISTS (SELECT 1 FROM eps_arcs a WHERE a.src = p.stop AND a.ilabel <> '<eps>')"""


@query(f"WITH RECURSIVE {GRAPH}, {HOLES}, {CLOSURE}")
def eps_closure(spark, d):
    arcs = graph(spark, d)[0]
    holes = arcs.select("src", "dst", F.when(F.col("dst") % 3 == 0, "<eps>").otherwise(F.col("ilabel")).alias("ilabel"), F.lit(-0.25).cast("double").alias("w"))
    return G.closure(holes).select("node", "stop", F.round("w", 6).alias("w"), "depth")


@query(f"""WITH {GRAPH}, l AS (SELECT DISTINCT dst AS node, ilabel AS x FROM arcs), r AS (SELECT DISTINCT src AS node, ilabel AS x FROM arcs)
SELECT src, dst, coalesce(l.x, '<eps>') || '-' || ilabel || '+' || coalesce(r.x, '<eps>') AS label, olabel, w FROM arcs LEFT JOIN l ON l.node = src LEFT JOIN r ON r.node = dst""")
def context_expansion(spark, d):
    return G.triphones(graph(spark, d)[0])


@query("""WITH t AS (SELECT string_split(text, ' ') AS t FROM benchmark), p AS (SELECT unnest(list_transform(range(1, len(t) + 1), lambda k: {'depth': k, 'prefix': array_to_string(t[1:k], ' ')})) AS x FROM t)
SELECT x.depth::INT AS depth, x.prefix AS prefix, count(*) AS n FROM p GROUP BY ALL""")
def prefix_tree(spark, d):
    return G.prefix_tree(table(spark, d, "benchmark").select(F.split("text", " ").alias("tokens")))


@query("""WITH t AS (SELECT list_concat(['<s>'], string_split(text, ' '), ['</s>']) AS t FROM conversations), p AS (SELECT unnest(list_transform(range(1, len(t)), lambda k: {'a': t[k], 'b': t[k + 1]})) AS x FROM t),
n AS (SELECT x.a AS a, x.b AS b, count(*) AS n FROM p GROUP BY ALL), na AS (SELECT a, sum(n) AS na FROM n GROUP BY a), nb AS (SELECT b, sum(n) AS nb FROM n WHERE b <> '</s>' GROUP BY b)
SELECT a AS src, b AS dst, b AS label, round(ln(n / na), 6) AS w FROM n JOIN na USING (a) UNION ALL SELECT '<B>', b, b, round(ln(nb / sum(nb) OVER ()), 6) FROM nb UNION ALL SELECT b, '<B>', '<F>', round(ln(0.4::DOUBLE), 6) FROM nb""")
def bigram_backoff_arcs(spark, d):
    arcs = B.backoff_arcs(B.bigram_counts(turns(spark, d).select(F.split("text", " ").alias("tokens"))))
    return arcs.withColumn("w", F.round("w", 6))


@query(f"""WITH {GRAPH}, p AS (SELECT *, row_number() OVER (ORDER BY dst DESC, src) AS pos FROM arcs), ends AS (SELECT src AS node, pos * 2 AS seen FROM p UNION ALL SELECT dst, pos * 2 + 1 FROM p),
s AS (SELECT node, min(seen) AS seen FROM ends GROUP BY node), num AS (SELECT node, row_number() OVER (ORDER BY node = (SELECT max(dst) FROM arcs), seen) - 1 AS number FROM s)
SELECT a.number AS src, b.number AS dst, ilabel, olabel, w FROM p JOIN num a ON a.node = src JOIN num b ON b.node = dst""")
def graph_renumber(spark, d):
    arcs, finals = graph(spark, d)
    return W.renumber(numbered(arcs, ["dst desc", "src"], "pos"), finals)[0]


@query(f"WITH {GRAPH} SELECT src AS node, max(w - (dst % 7)) AS best FROM arcs GROUP BY src")
def graph_best_leaving(spark, d):
    return G.best_leaving(graph(spark, d)[0].withColumn("w", F.col("w") - F.col("dst") % 7))


@query(f"""WITH {GRAPH}, lex AS (SELECT DISTINCT ilabel AS word, string_split(ilabel, '') AS p FROM arcs WHERE length(ilabel) > 0),
x AS (SELECT src, dst, ilabel, olabel, w, p, unnest(range(0, len(p))) AS i FROM arcs JOIN lex ON word = ilabel), name AS (SELECT *, concat_ws(':', src, dst, ilabel, array_to_string(p, ' ')) AS inner_name FROM x)
SELECT CASE WHEN i = 0 THEN src::VARCHAR ELSE inner_name || ':' || i END AS src, CASE WHEN i = len(p) - 1 THEN dst::VARCHAR ELSE inner_name || ':' || (i + 1) END AS dst, p[i + 1] AS ilabel, CASE WHEN i = 0 THEN olabel ELSE '<eps>' END AS olabel, w FROM name
UNION ALL SELECT src::VARCHAR, dst::VARCHAR, ilabel, olabel, w FROM arcs WHERE length(ilabel) = 0""")
def word_phone_graph(spark, d):
    arcs = graph(spark, d)[0]
    lexicon = arcs.where("length(ilabel) > 0").select(F.col("ilabel").alias("word"), F.split("ilabel", "").alias("phones")).distinct()
    return W.words_to_phones(arcs, lexicon)


@query("""WITH t AS (SELECT list_concat(['<s>'], string_split(text, ' '), ['</s>']) AS t FROM conversations),
p AS (SELECT unnest(flatten(list_transform(range(1, 4), lambda k: list_transform(range(1, len(t) - k + 2), lambda i: t[i:i + k - 1])))) AS g FROM t),
n AS (SELECT g, len(g) AS k, count(*) AS n FROM p GROUP BY g),
m AS (SELECT g, k, ln(n / sum(n) OVER (PARTITION BY k, g[1:k - 1])) AS logp, CASE WHEN k < 3 AND g[k] <> '</s>' THEN ln(0.4::DOUBLE) ELSE 0 END AS bo, array_to_string(g, ' ') AS s, g[k] AS label FROM n),
h AS (SELECT m.*, b.s AS one, b.bo AS one_bo, c.s AS two, coalesce(c.bo, 0) AS two_bo, array_to_string(m.g[1:m.k - 1], ' ') AS src FROM m JOIN m b ON b.k = 1 AND b.s = m.label LEFT JOIN m c ON m.k = 3 AND c.k = 2 AND c.s = m.g[2] || ' ' || m.g[3] WHERE m.k > 1),
q AS (SELECT *, coalesce(two, one) AS dest FROM h WHERE src IN (SELECT s FROM m)),
a AS (SELECT s AS src, 'aux:' || s AS dst, '<F>' AS label, bo AS w FROM m WHERE k = 1 AND label <> '</s>' UNION ALL SELECT 'aux:' || s, '<B>', '<F>', 0 FROM m WHERE k = 1 AND label <> '</s>' UNION ALL SELECT '<B>', s, label, logp FROM m WHERE k = 1 AND label <> '<s>'
UNION ALL SELECT src, CASE WHEN k < 3 OR src = dest THEN s ELSE dest END, label, logp FROM q WHERE label <> '</s>' UNION ALL SELECT s, 'aux:' || s, '<F>', bo FROM q WHERE label <> '</s>' AND (k < 3 OR src = dest) UNION ALL SELECT 'aux:' || s, dest, '<F>', 0 FROM q WHERE label <> '</s>' AND (k < 3 OR src = dest)
UNION ALL SELECT src, '</s>', label, logp + bo + one_bo + two_bo FROM q WHERE label = '</s>')
SELECT src, dst, label, round(w, 6) + 0.0 AS w FROM a""")
def ngram_graph(spark, d):
    tokens = F.coalesce(F.split("text", " "), F.array().cast("array<string>"))  # a turn without text is a sentence without words, as in SQL
    table_ = B.ngram_table(turns(spark, d).select(tokens.alias("tokens")), 3)
    return B.ngram_graph(table_, 3, closed=True).withColumn("w", r6("w"))


# ---- frames ------------------------------------------------------------------------------


def events(spark, d):
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")


@query("SELECT event_id, CASE WHEN var_pop(value) OVER u > 0 THEN round((value - avg(value) OVER u) / sqrt(var_pop(value) OVER u), 6) ELSE 0 END + 0.0 AS z FROM events WINDOW u AS (PARTITION BY user_id)")
def mvn_user(spark, d):
    return R.normalise(events(spark, d), "user_id", "value").select("event_id", r6("z").alias("z"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS ma FROM events")
def ma_user(spark, d):
    return R.moving_average(events(spark, d), "user_id", ["ts", "event_id"], "value", 2).select("event_id", F.round("ma", 6).alias("ma"))


@query("""WITH RECURSIVE s AS (SELECT user_id, list(value ORDER BY ts, event_id) AS x FROM events GROUP BY user_id),
f AS (SELECT user_id, x, 3 AS t, x[1:2] AS y FROM s UNION ALL SELECT user_id, x, t + 1, list_append(y, (y[t - 2] + y[t - 1] + x[t] + x[t + 1] + x[t + 2]) / 5) FROM f WHERE t <= len(x) - 2 AND len(x) > 4),
g AS (SELECT user_id, CASE WHEN len(x) > 4 THEN list_concat(y, x[-2:]) ELSE x END AS y FROM f WHERE t = len(x) - 1 OR len(x) <= 4)
SELECT user_id, (generate_subscripts(y, 1) - 1)::INT AS t, round(unnest(y), 4) + 0.0 AS y FROM g""")
def arma_user(spark, d):
    s = events(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("x")).select("user_id", F.col("x.value").alias("x"))
    return s.select("user_id", F.posexplode(R.arma(F.col("x"), 2)).alias("t", "y")).withColumn("y", F.round("y", 4) + F.lit(0.0))


@query("SELECT event_id, len(b)::INT AS n, round(list_sum(b), 6) AS total FROM (SELECT event_id, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS b FROM events)")
def splice_user(spark, d):
    return R.splice(events(spark, d), "user_id", ["ts", "event_id"], "value", 5).select("event_id", F.size("block").alias("n"), F.round(N.total(F.col("block")), 6).alias("total"))


@query("SELECT event_id, CASE WHEN row_number() OVER w % 2 = 1 THEN value ELSE lag(value) OVER w END AS held FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def frame_skip(spark, d):
    return R.skip(events(spark, d), "user_id", ["ts", "event_id"], "value").select("event_id", "held")


@query("SELECT event_id, round(value - coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0), 6) + 0.0 AS delta FROM events")
def lattice_delta(spark, d):
    return R.deltas(events(spark, d), "user_id", ["ts", "event_id"], "value").select("event_id", r6("delta").alias("delta"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, event_id % 7, date_trunc('day', ts) ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def lattice_dedup(spark, d):
    rows = events(spark, d).select("event_id", "ts", F.col("user_id").alias("start"), F.col("event_type").alias("word"), (F.col("event_id") % 7).alias("stop"), F.date_trunc("day", "ts").alias("prev"))
    return S.lattice_unique(rows, "ts", "event_id").select("event_id")


@query("SELECT user_id, event_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 5")
def beam_topk(spark, d):
    return S.beam(events(spark, d), "user_id", "value", 5, "event_id").select("user_id", "event_id", "rank")


@query("SELECT user_id, event_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'purchase') DESC, value DESC, event_id) AS rank FROM events) WHERE rank <= 3")
def nbest_prefer_final(spark, d):
    rows = events(spark, d).withColumn("final", F.col("event_type") == "purchase")
    return S.n_best(rows, "user_id", "final", "value", 3, "event_id").select("user_id", "event_id", "rank")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def best_per_state(spark, d):
    rows = events(spark, d).withColumn("newest", -F.col("event_id"))
    return S.best_per(rows, ["user_id", "event_type"], "value", "newest").select("user_id", "event_type", "event_id")


@query("SELECT dim::INT AS dim, round(avg(x), 6) + 0.0 AS mean, round(var_pop(x), 6) AS var FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) GROUP BY dim")
def mean_var_dim(spark, d):
    v = table(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("v"))
    return R.moments(v, "v").select("dim", r6("mean").alias("mean"), F.round("var", 6).alias("var"))


# ---- vectors -----------------------------------------------------------------------------

VEC = "(SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


def vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


def sums(df: DataFrame, **columns) -> DataFrame:
    """Each array as its rounded sum and its rounded sum weighted by place: a check of all values and their order."""
    out = []
    for name, c in columns.items():
        places = F.transform(F.sequence(F.lit(1), F.size(c)), lambda i: i.cast("double"))
        out += [r6(N.total(c)).alias(name), F.round(N.dot(c, places), 4).alias(f"{name}_order")]
    return df.select("vec_id", *out)


def sums_sql(inner: str) -> str:
    return f"SELECT vec_id, round(list_sum(y), 6) + 0.0 AS y, round(list_sum(list_transform(range(1, len(y) + 1), lambda i: y[i] * i)), 4) AS y_order FROM (SELECT vec_id, {inner} AS y FROM {VEC})"


PART = "list_transform(range(0, len(v) // 8), lambda g: {})"


def vector_query(name: str, inner: str, make: Callable) -> None:
    QUERIES[name] = lambda spark, d: sums(vectors(spark, d), y=make(F.col("v")))
    ORACLE_SQL[name] = sums_sql(inner)


vector_query("relu", "list_transform(v, lambda x: greatest(x, 0.0::DOUBLE))", N.relu)
vector_query("pnorm", PART.format("sqrt(list_sum(list_transform(v[g * 8 + 1:g * 8 + 8], lambda x: x * x)))"), lambda v: N.p_norm(v, 8))
vector_query("sum_group", PART.format("list_sum(v[g * 8 + 1:g * 8 + 8])"), lambda v: N.sum_group(v, 8))
vector_query("rms_norm", "list_transform(v, lambda x: x * least(1.0::DOUBLE, 1.0 / sqrt(list_sum(list_transform(v, lambda z: z * z)) / len(v))))", N.rms_normalise)
vector_query("softmax_floor", "list_transform(v, lambda x: greatest(exp(x) / list_sum(list_transform(v, lambda z: exp(z))), 1e-20::DOUBLE))", N.softmax)
vector_query("fixed_scale", "list_transform(range(1, len(v) + 1), lambda i: v[i] * i)", lambda v: N.scale(v, F.transform(F.sequence(F.lit(1), F.size(v)), lambda i: i.cast("double"))))
vector_query("affine_small", "list_transform(range(1, 5), lambda r: list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * ((i * r) % 5))) + r)", lambda v: N.affine(v, F.transform(F.sequence(F.lit(1), F.lit(4)), lambda r: F.transform(F.sequence(F.lit(1), F.size(v)), lambda i: ((i * r) % 5).cast("double"))), F.array(*[F.lit(float(r)) for r in range(1, 5)])))
vector_query("vq_gather", "list_transform(range(1, len(v) + 1), lambda i: v[(i * 3) % len(v) + 1])", lambda v: N.gather(v, F.transform(F.sequence(F.lit(1), F.size(v)), lambda i: (i * 3) % F.size(v) + 1)))
vector_query("prior_norm", "list_transform(range(1, len(v) + 1), lambda i: ln((exp(v[i]) / i) / list_sum(list_transform(range(1, len(v) + 1), lambda k: exp(v[k]) / k))))", lambda v: N.log_posterior(F.transform(v, F.exp), F.transform(F.sequence(F.lit(1), F.size(v)), lambda i: i.cast("double"))))
vector_query("quantise", "list_transform(v, lambda x: floor(x * 4096.0::DOUBLE + 0.5))", lambda v: F.transform(v, lambda x: X.quantise(x, 4096.0).cast("double")))
vector_query("quantise_down", "list_transform(v, lambda x: trunc(x * 1024.0::DOUBLE))", lambda v: F.transform(v, lambda x: X.quantise_down(x, 1024.0).cast("double")))
vector_query("clamp_inverse", "list_transform(v, lambda x: greatest(1e-30::DOUBLE, least(1e30::DOUBLE, x)))", N.clamp)
vector_query("cut_window", "list_concat(v[1:10 + vec_id % 20 - 1], v[10 + vec_id % 20 + 7:])", lambda v: R.cut(v, (F.col("vec_id") % 20 + 13).cast("int"), F.lit(3)))


@query(f"SELECT vec_id, bool_and(floor(x * 4096.0::DOUBLE + 0.5) BETWEEN -32768 AND 32767) AS fits FROM (SELECT vec_id, unnest(v) AS x FROM {VEC}) GROUP BY vec_id")
def quantise_range(spark, d):
    return vectors(spark, d).select("vec_id", F.forall("v", lambda x: X.quantise(x, 4096.0).between(-32768, 32767)).alias("fits"))


@query(f"SELECT vec_id, round(list_reduce(v, lambda a, b: CASE WHEN least(a, b) - greatest(a, b) < -23.02585 THEN greatest(a, b) ELSE greatest(a, b) + ln(1 + exp(least(a, b) - greatest(a, b))) END), 6) + 0.0 AS y FROM {VEC}")
def logadd(spark, d):
    return vectors(spark, d).select("vec_id", r6(F.reduce(F.slice("v", F.lit(2), F.size("v")), F.col("v")[0], lambda a, b: N.log_add(a, b))).alias("y"))


@query("""WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS mu, var_pop(x) AS var FROM e GROUP BY label, i)
SELECT vec_id, m.label AS state, round(-0.5 * sum((x - mu) * (x - mu) / var + ln(2 * pi() * var)), 4) AS ll FROM e JOIN m USING (i) GROUP BY vec_id, m.label""")
def gmm_loglik(spark, d):
    long = vectors(spark, d).select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("mu"), F.var_pop("x").alias("var"))
    packed = long.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "mu", "var"))).alias("p")).select(F.col("label").alias("state"), F.col("p.mu").alias("mu"), F.transform("p.var", lambda x: 1 / x).alias("iv"), N.total(F.transform("p.var", lambda x: F.ln(x * (2 * 3.141592653589793)))).alias("g"))
    rows = vectors(spark, d).select("vec_id", "v").crossJoin(F.broadcast(packed))  # one row for each of a model's states
    return rows.select("vec_id", "state", F.round(N.gaussian(F.col("v"), F.col("mu"), F.col("iv"), F.col("g")), 4).alias("ll"))


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, round(max(share), 6) AS top FROM (SELECT user_id, value, value / sum(value) OVER (PARTITION BY user_id) AS share FROM events) GROUP BY user_id")
def row_ratios(spark, d):
    rows = events(spark, d).withColumn("share", F.expr("value / sum(value) over (partition by user_id)"))
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.max("share"), 6).alias("top"))


REPEATS = """WITH t AS (SELECT string_split(text, ' ') AS t FROM conversations), p AS (SELECT unnest(list_transform(range(1, len(t) - 1), lambda k: array_to_string(t[k:k + 2], ' '))) AS path FROM t),
n AS (SELECT path, count(*) AS n FROM p GROUP BY path HAVING count(*) > 1)"""


def repeats(spark, d):
    t = turns(spark, d).select(F.split("text", " ").alias("t")).where("size(t) >= 3")
    paths = t.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - 2), lambda k: F.array_join(F.slice("t", k, F.lit(3)), " "))).alias("path"))
    return paths.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")


@query(REPEATS + " SELECT * FROM n")
def repeat_paths(spark, d):
    return repeats(spark, d)


@query(REPEATS + " SELECT path, n FROM (SELECT path, n, sum(n) OVER (ORDER BY n DESC, path) AS upto, sum(n) OVER () AS total FROM n) WHERE upto / total <= 0.2")
def repeat_share_cut(spark, d):
    rows = repeats(spark, d)
    total = rows.agg(F.sum("n").alias("total"))
    ordered = running_sum(rows, ["n desc", "path"], F.col("n"), "upto")
    return ordered.crossJoin(F.broadcast(total)).where("upto / total <= 0.2").select("path", "n")


#: Sentences of three words of our own: region, nation and market of every customer.
PLACES = "SELECT c_custkey AS id, [r_name, n_name, c_mktsegment] AS t FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"


def place_names(spark, d):
    """(id, tokens) of these sentences."""
    joined = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey")).join(F.broadcast(table(spark, d, "region")), F.col("r_regionkey") == F.col("n_regionkey"))
    return joined.select(F.col("c_custkey").alias("id"), F.array("r_name", "n_name", "c_mktsegment").alias("tokens"))


for part in ("transcripts", "graphs", "models", "decoding"):  # they add their queries here
    importlib.import_module(f"lattiq.plans.{part}")
