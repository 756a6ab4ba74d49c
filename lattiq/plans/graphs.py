"""Queries on graph rewriting: factoring, pushing, contexts, chains, redirects, whole-graph figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattiq.operators import graph as G
from lattiq.operators import lexicon as L
from lattiq.operators import rewrite as W
from lattiq.operators.steps import numbered
from lattiq.plans.registry import GRAPH, HOLES, PLACES, WORDS_B, graph, place_names, query, r6, table


def places(spark, d):
    return G.context_graph(place_names(spark, d))


def shape(arcs):
    """Arcs by label with how many there are: the same whatever nodes are called."""
    return arcs.groupBy("ilabel", "olabel", r6("w").alias("w")).agg(F.count("*").alias("n"))


@query(f"""WITH p AS ({PLACES}), x AS (SELECT DISTINCT t[1:k] AS prefix FROM p, (SELECT unnest([1, 2, 3]) AS k))
SELECT prefix[-1] AS ilabel, prefix[-1] AS olabel, 0.0::DOUBLE AS w, count(*) AS n FROM x GROUP BY ALL""")
def graph_factor(spark, d):
    return shape(G.factor(*places(spark, d))[0])


@query(f"""WITH p AS ({PLACES}), x AS (SELECT DISTINCT t[k:] AS tail FROM p, (SELECT unnest([1, 2, 3]) AS k))
SELECT tail[1] AS ilabel, tail[1] AS olabel, 0.0::DOUBLE AS w, count(*) AS n FROM x GROUP BY ALL""")
def graph_merge_tails(spark, d):
    return shape(G.merge_tails(*places(spark, d))[0])


@query(f"""WITH {GRAPH}, b AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst, ilabel, olabel, w) - 1 AS b FROM arcs),
l AS (SELECT DISTINCT dst AS node, ilabel AS l FROM arcs), r AS (SELECT src AS node, ilabel AS r, b AS rb FROM b)
SELECT CASE WHEN src = 0 THEN '0' ELSE concat_ws('|', src, coalesce(l, '<eps>'), b) END AS src, concat_ws('|', dst, ilabel, coalesce(rb::VARCHAR, 'end')) AS dst, coalesce(l, '<eps>') || '-' || ilabel || '+' || coalesce(r, '<eps>') AS ilabel, olabel, w
FROM b LEFT JOIN l ON l.node = src LEFT JOIN r ON r.node = dst""")
def context_graph_split(spark, d):
    return G.expand_contexts(*graph(spark, d))[0]


@query(f"""WITH {GRAPH}, k AS (SELECT max(dst) AS f FROM arcs), g AS (SELECT src, dst, ilabel, olabel, w FROM arcs UNION ALL SELECT node, f + 1, '<eps>', '<eps>', 0.0::DOUBLE FROM k, (SELECT f AS node FROM k UNION ALL SELECT 1))
SELECT CASE dst WHEN 0 THEN f + 1 WHEN f + 1 THEN 0 ELSE dst END AS src, CASE src WHEN 0 THEN f + 1 WHEN f + 1 THEN 0 ELSE src END AS dst, ilabel, olabel, w FROM g, k""")
def graph_reverse_finals(spark, d):
    arcs, finals = graph(spark, d)
    return G.reverse_graph(arcs, finals.unionByName(spark.createDataFrame([(1,)], "node long")))[0]


@query(f"WITH {GRAPH} SELECT CASE src WHEN 3 THEN 0 WHEN 0 THEN 3 ELSE src END AS src, CASE dst WHEN 3 THEN 0 WHEN 0 THEN 3 ELSE dst END AS dst, ilabel, olabel, w FROM arcs")
def graph_swap_start(spark, d):
    return G.swap_start(*graph(spark, d), 3)[0]


@query(f"WITH {GRAPH} SELECT max(greatest(src, dst)) AS max_node, count(*) AS n_arcs, 1::BIGINT AS n_finals, count(*) + 1 AS n_lines FROM arcs")
def graph_counts(spark, d):
    return G.counts(*graph(spark, d))


@query(f"WITH {GRAPH} SELECT src, dst, ilabel, row_number() OVER (ORDER BY src, dst DESC) - 1 AS place FROM arcs")
def graph_arc_order(spark, d):
    return G.in_source_order(graph(spark, d)[0].withColumn("pos", -F.col("dst"))).select("src", "dst", "ilabel", "place")


@query(f"WITH {GRAPH}, e AS (SELECT DISTINCT ilabel, olabel, format('{{:.6f}}', w - (dst % 3) / 7) AS w6 FROM arcs) SELECT *, row_number() OVER (ORDER BY ilabel, olabel, w6) - 1 AS code FROM e")
def graph_encodings(spark, d):
    return G.encodings(graph(spark, d)[0].withColumn("w", F.col("w") - (F.col("dst") % 3) / 7))


#: The branches of the context graph as chains: each sentence is a word with its label on the first arc and weights on the way.
CHAIN = """c AS (SELECT src, dst, ilabel, CASE WHEN i = 0 THEN 'S' || id ELSE '<eps>' END AS olabel, -(1 + (b + i) % 4) / 4 AS w, id, i, n FROM (SELECT *, CASE WHEN i = 0 THEN 0 ELSE b + i END::BIGINT AS src, CASE WHEN i = n THEN total + 1 ELSE b + i + 1 END::BIGINT AS dst, t[i + 1] AS ilabel FROM steps))"""


def chain_arcs(spark, d, label_first=True):
    """The context graph with a label on the first (or last) arc of each branch; weights by node."""
    arcs, finals = graph(spark, d)
    first = F.when(F.col("src") == 0, F.concat(F.lit("S"), F.col("dst").cast("string"))).otherwise("<eps>")
    return arcs.select("src", "dst", "ilabel", first.alias("olabel"), (-(1 + F.col("dst") % 4) / 4).alias("w")), finals


FIRST = "g AS (SELECT id, i, n, src, dst, ilabel, -(1 + dst % 4) / 4 AS w, min(dst) FILTER (WHERE i = 0) OVER (PARTITION BY id) AS head, total FROM (SELECT id, i, n, total, CASE WHEN i = 0 THEN 0 ELSE b + i END::BIGINT AS src, CASE WHEN i = n THEN total + 1 ELSE b + i + 1 END::BIGINT AS dst, t[i + 1] AS ilabel FROM steps))"


@query(f"""WITH {GRAPH}, {FIRST} SELECT src, dst, ilabel, CASE WHEN i = n THEN 'S' || head ELSE '<eps>' END AS olabel, CASE WHEN i = n THEN sum(w) OVER (PARTITION BY id) ELSE 0.0 END::DOUBLE AS w FROM g""")
def push_labels_forward(spark, d):
    return W.push_forward(*chain_arcs(spark, d))


@query(f"""WITH {GRAPH}, {FIRST}, p AS (SELECT *, CASE WHEN i = n THEN -(1 + dst % 4) / 4 - i / 8 ELSE 0 END AS v FROM g), m AS (SELECT id, max(v) FILTER (WHERE i = n) AS best, max(n) AS n FROM p GROUP BY id)
SELECT src, dst, ilabel, CASE WHEN i = p.n THEN 'W' ELSE '<eps>' END AS olabel, round(CASE WHEN i = 0 THEN best ELSE 0 END, 6) + 0.0 AS w FROM p JOIN m USING (id)""")
def push_weights_to_head(spark, d):
    """Every branch has its weight on its last arc; it moves to the first."""
    arcs, finals = graph(spark, d)
    total = finals.first()[0]
    place = numbered(arcs, ["src"], "_n").drop("_n")
    last = F.col("dst") == total
    depth = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), (F.size(F.split("text", " ")) - 1).alias("n"))
    from lattiq.operators.steps import running_sum

    sizes = running_sum(depth, ["id"], F.col("n"), "upto").select(F.when(F.col("n") == 0, 0).otherwise(F.col("upto")).cast("long").alias("src"), "n")
    rows = place.join(sizes, "src", "left").withColumn("w", F.when(last, -(1 + F.col("dst") % 4) / 4 - F.col("n") / 8).otherwise(F.lit(0.0)))
    labelled = rows.select("src", "dst", "ilabel", F.when(last, "W").otherwise("<eps>").alias("olabel"), "w")
    return W.push_to_head(labelled, finals).withColumn("w", r6("w"))


@query(f"""WITH {GRAPH}, {FIRST}, k AS (SELECT id, min(src) FILTER (WHERE i = 1) AS src, max(dst) FILTER (WHERE i = n) AS dst, string_agg(ilabel, ' ' ORDER BY i) FILTER (WHERE i > 0) AS phones, sum(w) FILTER (WHERE i > 0) AS w, max(n) AS n FROM g GROUP BY id)
SELECT src, dst, phones, round(w, 6) AS w, (n - 1)::INT AS n_nodes FROM k WHERE n > 1""")
def graph_chains(spark, d):
    return W.chains(*chain_arcs(spark, d)).select("src", "dst", "phones", F.round("w", 6).alias("w"), F.size("nodes").alias("n_nodes"))


@query(f"""WITH {GRAPH}, {FIRST}, k AS (SELECT id, min(src) FILTER (WHERE i = 1) AS src, max(dst) FILTER (WHERE i = n) AS dst, string_agg(ilabel, ' ' ORDER BY i) FILTER (WHERE i > 0) AS phones, sum(w) FILTER (WHERE i > 0) AS w, max(n) AS n FROM g GROUP BY id),
c AS (SELECT * FROM k WHERE n > 1 UNION ALL SELECT * FROM k WHERE n > 1), s AS (SELECT phones, count(*) AS copies FROM c GROUP BY phones),
o AS (SELECT *, row_number() OVER (ORDER BY copies DESC, phones) - 1 AS entry, sum(copies) OVER (ORDER BY copies DESC, phones ROWS UNBOUNDED PRECEDING) AS upto, sum(copies) FILTER (WHERE copies > 1) OVER () AS total FROM s)
SELECT entry, phones, copies FROM o WHERE upto <= total * (2 / 5)""")
def chain_dictionary(spark, d):
    found = W.chains(*chain_arcs(spark, d))
    return W.repeated_chains(found.unionByName(found), 2)


@query(f"""WITH RECURSIVE {GRAPH}, {HOLES}, nb AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst, ilabel, w) - 1 AS b FROM eps_arcs),
paths AS (SELECT src AS node, dst AS stop, w, [b] AS path FROM nb WHERE ilabel = '<eps>' UNION ALL SELECT p.node, a.dst, p.w + a.w, list_append(p.path, a.b) FROM paths p JOIN nb a ON a.src = p.stop WHERE a.ilabel = '<eps>'),
good AS (SELECT * FROM paths p WHERE EXISTS (SELECT 1 FROM eps_arcs a WHERE a.src = p.stop AND a.ilabel <> '<eps>'))
SELECT node, count(*) || ' ' || string_agg(stop || ',' || format('{{:.6f}}', w * 0.4342944819) || ',' || array_to_string(path, '.'), ' ' ORDER BY stop, array_to_string(path, '.')) AS line FROM good GROUP BY node""")
def redirect_lines(spark, d):
    from lattiq.sources.text import redirect_lines as lines

    arcs = graph(spark, d)[0]
    holes = arcs.select("src", "dst", F.when(F.col("dst") % 3 == 0, "<eps>").otherwise(F.col("ilabel")).alias("ilabel"), F.lit("").alias("olabel"), F.lit(-0.25).cast("double").alias("w"))
    return lines(G.closure(G.branches(holes)))


@query(f"""WITH {GRAPH}, m AS (SELECT sym, row_number() OVER (ORDER BY sym) - 1 AS id FROM ({WORDS_B}) WHERE length(sym) % 2 = 0), a AS (SELECT src, dst, CASE WHEN dst % 5 = 0 THEN '<eps>' WHEN length(ilabel) % 2 = 1 OR ilabel = '' THEN 'D=' || (dst % 9) ELSE ilabel END AS ilabel FROM arcs)
SELECT src, dst, ilabel, CASE WHEN ilabel = '<eps>' THEN -1 WHEN ilabel[1:2] = 'D=' THEN -ilabel[3:]::INT - 100 ELSE id END::INT AS model FROM a LEFT JOIN m ON sym = ilabel""")
def arc_model_index(spark, d):
    words = graph(spark, d)[0].select("src", "dst", F.when(F.col("dst") % 5 == 0, "<eps>").when((F.char_length("ilabel") % 2 == 1) | (F.col("ilabel") == ""), F.concat(F.lit("D="), (F.col("dst") % 9).cast("string"))).otherwise(F.col("ilabel")).alias("ilabel"))
    models = numbered(table(spark, d, "benchmark").select(F.explode(F.split("text", " ")).alias("model")).distinct().where("char_length(model) % 2 = 0"), ["model"], "id").withColumn("id", F.col("id").cast("int"))
    return L.model_index(words, models).select("src", "dst", "ilabel", "model")


@query(f"SELECT sym, (row_number() OVER (ORDER BY sym))::INT AS id FROM (SELECT sym FROM ({WORDS_B}) UNION SELECT unnest(string_split(sym, '')) FROM ({WORDS_B}) UNION SELECT n_name FROM nation) UNION ALL SELECT '<eps>', 0")
def lexicon_symbols(spark, d):
    words = table(spark, d, "benchmark").select(F.explode(F.split("text", " ")).alias("word")).distinct()
    return L.label_symbols(words.select("word", F.split("word", "").alias("phones")), table(spark, d, "nation").select(F.col("n_name").alias("model")))


@query("""WITH t AS (SELECT DISTINCT coalesce(lag(c) OVER w, '<eps>') || '-' || c || '+' || coalesce(lead(c) OVER w, '<eps>') AS label, coalesce(lag(c) OVER w, 'sil') AS l, c, coalesce(lead(c) OVER w, 'sil') AS r, lag(c) OVER w IS NOT NULL AND lead(c) OVER w IS NOT NULL AS whole
  FROM (SELECT id, CASE WHEN i % 11 = 0 THEN 'sp' ELSE c END AS c, i FROM (SELECT item_id AS id, unnest(string_split(text, ' ')) AS c, generate_subscripts(string_split(text, ' '), 1) AS i FROM benchmark)) WINDOW w AS (PARTITION BY id ORDER BY i)),
k AS (SELECT *, l || '-' || c || '+' || r AS key, whole AND l NOT IN ('sp', 'sil', '<eps>') AND r NOT IN ('sp', 'sil', '<eps>') AS real FROM t),
forms AS (SELECT DISTINCT key AS logical FROM k WHERE length(key) % 3 = 0 UNION SELECT DISTINCT l || '-' || c FROM k WHERE length(l) % 2 = 0 UNION SELECT DISTINCT c || '+' || r FROM k WHERE length(r) % 3 = 1), tab AS (SELECT logical, '#' || logical AS physical FROM forms)
SELECT label, CASE WHEN c = 'sp' THEN 'sp' ELSE coalesce(a.physical, CASE WHEN real THEN b.physical END, CASE WHEN real THEN e.physical END, '<none>') END AS physical FROM k LEFT JOIN tab a ON a.logical = key LEFT JOIN tab b ON b.logical = l || '-' || c LEFT JOIN tab e ON e.logical = c || '+' || r""")
def triphone_to_physical(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("id").orderBy("i")
    c = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.posexplode(F.split("text", " ")).alias("i", "c")).withColumn("c", F.when((F.col("i") + 1) % 11 == 0, "sp").otherwise(F.col("c")))
    k = c.select(F.coalesce(F.lag("c").over(w), F.lit("<eps>")).alias("l"), "c", F.coalesce(F.lead("c").over(w), F.lit("<eps>")).alias("r")).distinct()
    sil = lambda x: F.when(F.col(x) == "<eps>", "sil").otherwise(F.col(x))
    key, left, right = F.concat(sil("l"), F.lit("-"), "c", F.lit("+"), sil("r")), F.concat(sil("l"), F.lit("-"), "c"), F.concat("c", F.lit("+"), sil("r"))
    forms = k.where(F.char_length(key) % 3 == 0).select(key.alias("logical")).union(k.where(F.char_length(sil("l")) % 2 == 0).select(left)).union(k.where(F.char_length(sil("r")) % 3 == 1).select(right)).distinct()
    labels = k.select(F.concat("l", F.lit("-"), "c", F.lit("+"), "r").alias("label"))
    return L.to_physical(labels, forms.select("logical", F.concat(F.lit("#"), "logical").alias("physical")))
