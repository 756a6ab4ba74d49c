"""Queries on whole chains: a network's forward pass, decoding over tables, built graphs, fixed-point scores, sound, recurrent layers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from lattiq.functions import text as X
from lattiq.operators import audio as A
from lattiq.operators import build as B
from lattiq.operators import decode as D
from lattiq.operators import frames as R
from lattiq.operators import graph as G
from lattiq.operators import network as K
from lattiq.operators import nn as N
from lattiq.operators import recurrent as U
from lattiq.operators import search as S
from lattiq.operators.steps import Folder
from lattiq.plans import models as M
from lattiq.plans.registry import PLACES, events, place_names, query, vectors
from lattiq.sources import binary

# ---- the forward pass --------------------------------------------------------------------

#: Weights of our own: layer k, output o, input i (from 0).
WEIGHT = "((({k} + 3) * (o + 1) * (i + 2) + 5 * i + o) % 23 - 11) / 32.0::DOUBLE"


def weight(k: int, out: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    o, i = np.arange(out)[:, None], np.arange(wide)[None, :]
    return (((k + 3) * (o + 1) * (i + 2) + 5 * i + o) % 23 - 11) / 32.0, (np.arange(out) % 5 - 2) / 8.0


def affine_sql(k: int, out: int, wide: int) -> str:
    return f"list_transform(range(0, {out}), lambda o: list_sum(list_transform(range(0, {wide}), lambda i: y[i + 1] * ({WEIGHT.format(k=k)}))) + (o % 5 - 2) / 8.0::DOUBLE)"


def small_network(spark):
    """A file of ten layers, read back: splice of 2 frames of 64 values, 128 - 32 - 32 - 32 - 24 - 12 - 12 - 16 - 10 - 10 - 5 values, priors."""
    w = {k: weight(k, out, wide) for k, out, wide in ((0, 32, 128), (3, 24, 32), (8, 10, 16))}
    book = np.array([[((c * i) % 7 - 3) / 4 for i in range(1, 5)] for c in range(1, 6)])
    index = [(o * g) % 5 + 1 for o in range(1, 17) for g in range(1, 4)]
    layers = [
        ("AFFINE_TRANSFORM", 128, 32, w[0][0].ravel(), w[0][1], None), ("RELU", 32, 32, None, None, None), ("NORMALIZE", 32, 32, None, None, None), ("AFFINE_TRANSFORM", 32, 24, w[3][0].ravel(), w[3][1], None),
        ("PNORM", 24, 12, None, None, None), ("FIXEDSCALE", 12, 12, np.arange(1, 13) / 8, None, None), ("VQ_AFFINE_TRANSFORM", 12, 16, book.ravel(), (np.arange(16) % 5 - 2) / 8, [5, 4, 16, 3, *index]),
        ("RELU", 16, 16, None, None, None), ("AFFINE_TRANSFORM", 16, 10, w[8][0].ravel(), w[8][1], None), ("SOFTMAX", 10, 10, None, None, None), ("SUMGROUP", 10, 5, None, None, [1, 2, 3, 2, 2]),
    ]
    content = binary.network_bytes([("m", [0, 1, 2], 0)], [("t", 2, [0.0, 1.0, 0.0, 0.0])], 64, 2, layers, (-(np.arange(5) + 1) / 2).tolist())
    return K.network_of(binary.parse_networks(spark.createDataFrame([("n", content)], "path string, content binary")))


NETWORK = f"""WITH f AS (SELECT vec_id, label, list_concat(v, coalesce(lead(v) OVER (PARTITION BY label ORDER BY vec_id), v)) AS y FROM (SELECT *, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)),
l0 AS (SELECT vec_id, {affine_sql(0, 32, 128)} AS y FROM f), l1 AS (SELECT vec_id, list_transform(y, lambda x: greatest(x, 0.0::DOUBLE)) AS y FROM l0),
l2 AS (SELECT vec_id, list_transform(y, lambda x: x / greatest(1.0::DOUBLE, r)) AS y FROM (SELECT *, sqrt(list_sum(list_transform(y, lambda z: z * z)) / 32) AS r FROM l1)), l3 AS (SELECT vec_id, {affine_sql(3, 24, 32)} AS y FROM l2),
l4 AS (SELECT vec_id, list_transform(range(0, 12), lambda g: sqrt(y[2 * g + 1] * y[2 * g + 1] + y[2 * g + 2] * y[2 * g + 2])) AS y FROM l3), l5 AS (SELECT vec_id, list_transform(range(1, 13), lambda i: y[i] * i / 8.0::DOUBLE) AS y FROM l4),
l6 AS (SELECT vec_id, list_transform(range(1, 17), lambda o: list_sum(list_transform(range(0, 12), lambda i: y[i + 1] * (((((o * (i // 4 + 1)) % 5 + 1) * (i % 4 + 1)) % 7 - 3) / 4.0::DOUBLE))) + ((o - 1) % 5 - 2) / 8.0::DOUBLE) AS y FROM l5),
l7 AS (SELECT vec_id, list_transform(y, lambda x: greatest(x, 0.0::DOUBLE)) AS y FROM l6), l8 AS (SELECT vec_id, {affine_sql(8, 10, 16)} AS y FROM l7),
l9 AS (SELECT vec_id, list_transform(y, lambda x: greatest(exp(x) / s, 1e-20::DOUBLE)) AS y FROM (SELECT *, list_sum(list_transform(y, lambda z: exp(z))) AS s FROM l8)),
l10 AS (SELECT vec_id, [y[1], y[2] + y[3], y[4] + y[5] + y[6], y[7] + y[8], y[9] + y[10]] AS y FROM l9), p AS (SELECT vec_id, list_transform(range(1, 6), lambda i: y[i] * exp(i / 2.0::DOUBLE)) AS y FROM l10)
SELECT vec_id, (i - 1)::INT AS state, round(ln(y[i] / list_sum(y)), 4) + 0.0 AS score FROM p, range(1, 6) t(i)"""


@query(NETWORK)
def network_forward(spark, d):
    """Log posteriors of every vector as a frame: those of a label, by number, are an utterance."""
    rows = vectors(spark, d).withColumn("t", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    scores = K.forward(rows.select("label", "t", "v"), small_network(spark), "label", "t", "v")
    at = rows.select("label", F.col("t").cast("long").alias("t"), "vec_id")
    return scores.join(at, ["label", "t"]).select("vec_id", F.posexplode("scores").alias("state", "x")).select("vec_id", "state", (F.round("x", 4) + F.lit(0.0)).alias("score"))


# ---- decoding over tables ----------------------------------------------------------------

#: A word "low" of two phones, by a dictionary entry, or "high" of one, silence between, and back; node 1 leads to 0 by eps.
WORD_ARCS = [(0, 1, "D=7", "low", -0.5), (0, 1, "hi", "high", -0.75), (0, 2, "sil", "<eps>", -0.25), (2, 1, "D=7", "low", -0.125), (1, 0, "<eps>", "<eps>", -0.0625)]


def word_decoder(spark, beam: int = 3000, **options) -> D.Decoder:
    arcs = spark.createDataFrame(WORD_ARCS, "src long, dst long, ilabel string, olabel string, w double")
    models = spark.createDataFrame([("la", [0], [-0.5], [0.0]), ("lb", [1], [-0.5], [-1.0]), ("hi", [2], [-0.25], [0.0]), ("sil", [3], [-0.1], [0.0])], "model string, states array<int>, own array<double>, move array<double>")
    dictionary = spark.createDataFrame([(7, "la lb")], "entry long, phones string")
    return D.Decoder(arcs, spark.createDataFrame([(1,)], "node long"), G.closure(arcs), models, dictionary, beam=beam, **options)


def short_frames(spark, d):
    """The events of a user, six to an utterance."""
    f = M.token_frames(spark, d)
    return f.select((F.col("utt") * 1000 + F.floor(F.col("t") / 6)).cast("long").alias("utt"), (F.col("t") % 6).alias("t"), "scores")


#: Places of the net in the order of its arcs: (slot, tied, own, next slot, cost of going on, node behind, output); and what is entered from a node.
SLOTS = """slots(slot, tied, own, nxt, move, node, word) AS (VALUES (0, 0, -0.5::DOUBLE, 1, -1.0::DOUBLE, NULL, 'low'), (1, 1, -0.5, NULL, NULL, 1, 'low'), (2, 2, -0.25, NULL, NULL, 1, 'high'), (3, 3, -0.1, NULL, NULL, 2, NULL), (4, 0, -0.5, 5, -1.0, NULL, 'low'), (5, 1, -0.5, NULL, NULL, 1, 'low')),
entry(node, slot, ew, word) AS (VALUES (0, 0, -0.5::DOUBLE, 'low'), (0, 2, -0.75, 'high'), (0, 3, -0.25, NULL), (1, 0, -0.5625, 'low'), (1, 2, -0.8125, 'high'), (1, 3, -0.3125, NULL), (2, 4, -0.125, 'low'))"""


def passed(beam: int, size: str, utt: str = "user_id * 1000 + n // {0}", net: str = SLOTS) -> str:
    """SQL of token passing with the words so far, and what a lattice needs: start, word, word before, scores on entry."""
    return f"""WITH RECURSIVE n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events),
f AS (SELECT ({utt.format(size)})::BIGINT AS utt, (n % {size})::INT AS t, [-abs(value - 20) / 8, -abs(value - 40) / 8, -abs(value - 80) / 8, -30 / 8]::DOUBLE[] AS e FROM n), {net},
v AS (SELECT utt, t, slot, ew + e[tied + 1] AS s, ew AS lm, CASE WHEN x.word IS NULL THEN [] ELSE [x.word] END::VARCHAR[] AS words, CASE WHEN x.word IS NOT NULL THEN 0 END AS st, x.word AS w, CASE WHEN x.word IS NOT NULL THEN '<s>' END AS p, ew AS se, ew AS be, 0.0::DOUBLE AS bb FROM f JOIN entry x ON x.node = 0 JOIN slots USING (slot) WHERE t = 0
UNION ALL SELECT utt, t, slot, s, lm, words, st, w, p, se, be, bb FROM (SELECT *, row_number() OVER (PARTITION BY utt ORDER BY s DESC, slot) AS top FROM (
  SELECT c.utt, c.t, c.slot, c.s + e[tied + 1] AS s, lm, words, st, w, p, se, be, bb FROM (SELECT *, row_number() OVER (PARTITION BY utt, slot ORDER BY s DESC, prio, came) AS r FROM (
    SELECT utt, t + 1 AS t, v.slot, s + own AS s, lm, words, st, w, p, se, be, bb, 0 AS prio, v.slot AS came FROM v JOIN slots USING (slot)
    UNION ALL SELECT utt, t + 1, nxt, s + move, lm, words, st, w, p, se, be, bb, 1, v.slot FROM v JOIN slots USING (slot) WHERE nxt IS NOT NULL
    UNION ALL SELECT utt, t + 1, x.slot, s + ew, lm + ew, CASE WHEN x.word IS NULL THEN words ELSE list_append(words, x.word) END, CASE WHEN x.word IS NULL THEN st ELSE t + 1 END, coalesce(x.word, b.w), CASE WHEN x.word IS NULL THEN p ELSE coalesce(b.w, '<s>') END, CASE WHEN x.word IS NULL THEN se ELSE s + ew END, CASE WHEN x.word IS NULL THEN be ELSE lm + ew END, CASE WHEN x.word IS NULL THEN bb WHEN b.w IS NULL THEN 0 ELSE be END, 2, b.slot
      FROM (SELECT v.*, slots.node, row_number() OVER (PARTITION BY utt, slots.node ORDER BY s DESC, v.slot) AS first FROM v JOIN slots USING (slot) WHERE slots.node IS NOT NULL) b JOIN entry x ON x.node = b.node WHERE first = 1)) c JOIN f USING (utt, t) JOIN slots USING (slot) WHERE r = 1)) WHERE top <= {beam}),
last AS (SELECT utt, max(t) AS last FROM f GROUP BY utt),
ended AS (SELECT v.*, coalesce(node = 1, false) AS at_final, slots.word AS here, row_number() OVER (PARTITION BY utt ORDER BY coalesce(node = 1, false) DESC, s DESC, slot) AS rank FROM v JOIN last USING (utt) JOIN slots USING (slot) WHERE t = last)"""


RANKED = passed(3000, "6") + " SELECT utt, rank::INT AS rank, array_to_string(words, ' ') AS words, round(s, 6) AS score, at_final FROM ended WHERE rank <= 3"


@query(RANKED)
def decoded_words(spark, d):
    """The three best word sequences of every utterance."""
    decoder = word_decoder(spark)
    decoder.run(short_frames(spark, d))
    return decoder.best(3).select("utt", "rank", F.array_join("words", " ").alias("words"), F.round("score", 6).alias("score"), "at_final")


#: Weights of the entries above, by which a language model counts more or less.
WEIGHTS = (-0.5625, -0.8125, -0.3125, -0.125, -0.75, -0.25, -0.5)


def scaled(net: str, by: float) -> str:
    """The net with the weights of its entries scaled."""
    head, entry = net.split("entry(node")
    for w in WEIGHTS:
        entry = entry.replace(f", {w}::DOUBLE", f", {w * by:.6f}::DOUBLE").replace(f", {w},", f", {w * by:.6f},")
    return f"{head}entry(node{entry}"


@query(passed(3000, "6", net=scaled(SLOTS, 4)) + " SELECT utt, array_to_string(words, ' ') AS words, round(s, 6) AS score FROM ended WHERE rank = 1")
def decoded_scaled(spark, d):
    """The best words where weights of the net count four times."""
    decoder = word_decoder(spark, alpha=4.0)
    decoder.run(short_frames(spark, d))
    return decoder.best().select("utt", F.array_join("words", " ").alias("words"), F.round("score", 6).alias("score"))


def lattice_sql(head: str) -> str:
    return head + """, left_ AS (SELECT utt, t + 1 AS stop, st, w, p, s, lm, se, be, bb FROM (SELECT v.*, slots.word AS here, row_number() OVER (PARTITION BY utt, t, slots.node ORDER BY s DESC, slot) AS first FROM v JOIN slots USING (slot) WHERE slots.node IS NOT NULL) JOIN last USING (utt) WHERE first = 1 AND here IS NOT NULL AND t < last
UNION ALL SELECT utt, t + 1, st, w, p, s, lm, se, be, bb FROM ended WHERE rank = 1 AND here IS NOT NULL)
SELECT utt, st::INT AS start, stop::INT AS stop, w AS word, p AS prev, round((s - se) - (lm - be), 6) + 0.0 AS am, round(be - bb, 6) + 0.0 AS lm FROM (SELECT *, row_number() OVER (PARTITION BY utt, st, stop, w, p ORDER BY (s - se) - (lm - be), be - bb) AS one FROM left_) WHERE one = 1"""


def lattice_columns(rows):
    return rows.select("utt", "start", "stop", "word", "prev", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("am", "lm")])


@query(lattice_sql(passed(3, "6")))
def decoded_lattice(spark, d):
    """The word lattice of every utterance, with a beam of three tokens."""
    decoder = word_decoder(spark, beam=3)
    decoder.run(short_frames(spark, d), lattice=True)
    return lattice_columns(decoder.lattice())


#: The same net with a word of two states instead of an entry, as the search in one task numbers it.
IN_TASK = """slots(slot, tied, own, nxt, move, node, word) AS (VALUES (0, 2, -0.25::DOUBLE, NULL, NULL, 1, 'high'), (1, 0, -0.5, 2, -1.0::DOUBLE, NULL, 'low'), (2, 1, -0.5, NULL, NULL, 1, 'low'), (3, 3, -0.1, NULL, NULL, 2, NULL), (4, 0, -0.5, 5, -1.0, NULL, 'low'), (5, 1, -0.5, NULL, NULL, 1, 'low')),
entry(node, slot, ew, word) AS (VALUES (0, 1, -0.5::DOUBLE, 'low'), (0, 0, -0.75, 'high'), (0, 3, -0.25, NULL), (1, 1, -0.5625, 'low'), (1, 0, -0.8125, 'high'), (1, 3, -0.3125, NULL), (2, 4, -0.125, 'low'))"""


@query(lattice_sql(passed(3, "1000000", "user_id", IN_TASK)))
def token_passing_lattice(spark, d):
    """The word lattice of all events of a user, by the search in one task."""
    return lattice_columns(S.lattice_rows(S.decode(M.token_frames(spark, d), M.small_net(spark), beam=3)))


# ---- graphs built in one call ------------------------------------------------------------


@query(f"WITH p AS (SELECT DISTINCT t FROM ({PLACES})) SELECT array_to_string(t, ' ') AS words, array_to_string(list_transform(string_split(array_to_string(t, ''), ''), lambda c: '#' || c), ' ') AS inputs, 1::BIGINT AS n FROM p")
def graph_build(spark, d):
    """What the graph built of all customers' places accepts: their words, and the models of their letters."""
    sentences = place_names(spark, d)
    lexicon = sentences.select(F.explode("tokens").alias("word")).distinct().select("word", F.split("word", "").alias("phones"))
    letters = lexicon.select(F.explode("phones").alias("c")).distinct()
    around = letters.select("c").unionByName(letters.sparkSession.createDataFrame([("sil",)], "c string"))
    physical = letters.crossJoin(F.broadcast(around.select(F.col("c").alias("l")))).crossJoin(F.broadcast(around.select(F.col("c").alias("r"))))  # an alphabet, three times
    physical = physical.select(F.concat("l", F.lit("-"), "c", F.lit("+"), "r").alias("logical"), F.concat(F.lit("#"), "c").alias("physical"))
    folder = Folder(spark, "build")
    built, _ = B.decoding_graph(spark, folder.path, sentences, lexicon, physical, ratio=2)
    return B.sentences_of(built["arcs"], built["finals"], built["dictionary"]).select("words", "inputs", "n")


# ---- fixed-point scores ------------------------------------------------------------------

FIXED = """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), h AS (SELECT *, vec_id % 2 AS half FROM e),
m AS (SELECT label, half, i, floor(avg(x) * 256 + 0.5)::BIGINT AS mu, floor(1 / (var_pop(x) + 0.01::DOUBLE) * 1024 + 0.5)::BIGINT AS iv, ln((var_pop(x) + 0.01::DOUBLE) * (2 * pi())) AS g FROM h GROUP BY ALL), k AS (SELECT label, half, trunc(sum(g) * 64)::BIGINT AS g FROM m GROUP BY ALL),
t AS (SELECT vec_id, m.label AS state, m.half, (((((floor(x * 256 + 0.5)::BIGINT - mu) * iv) >> 17) * (floor(x * 256 + 0.5)::BIGINT - mu)) >> 1) AS t FROM e JOIN m USING (i)), s AS (SELECT vec_id, state, half, sum(t)::BIGINT >> 2 AS s FROM t GROUP BY ALL)
SELECT vec_id, state, max(-((s + g) >> 1))::BIGINT AS score FROM s JOIN k ON k.label = state AND k.half = s.half GROUP BY ALL"""


@query(FIXED)
def fixed_point_scores(spark, d):
    """Every vector against the mixtures of every label in 32-bit integers: whole numbers, so that all bits agree."""
    whole = lambda c, by: F.transform(c, lambda v: X.quantise(v, by))
    one = lambda m: F.struct(whole(m["mu"], 256.0).alias("mu"), whole(m["iv"], 1024.0).alias("iv"), F.when(m["g"] < 0, F.ceil(m["g"] * 64)).otherwise(F.floor(m["g"] * 64)).alias("g"))
    mixtures = M.mixture_table(spark, d).select(F.col("label").alias("state"), F.transform("mixtures", one).alias("m"))
    rows = vectors(spark, d).select("vec_id", whole(F.col("v"), 256.0).alias("x")).crossJoin(F.broadcast(mixtures))  # one row for each of a model's states
    return rows.select("vec_id", "state", N.fixed_mixture(F.col("x"), F.col("m")).alias("score"))


# ---- sound, slopes, recurrent layers -----------------------------------------------------

SIGNAL = "s AS (SELECT user_id, list(value::DOUBLE ORDER BY ts, event_id) AS x FROM events GROUP BY user_id)"


def signals(spark, d, span: int):
    """The values of each user's events as a signal, in blocks of span samples."""
    f = events(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    rows = f.groupBy(F.col("user_id").cast("long").alias("utt"), F.floor(F.col("i") / span).alias("block")).agg(F.array_sort(F.collect_list(F.struct("i", F.col("value").cast("double").alias("v")))).alias("p"))
    return rows.select("utt", "block", F.col("p.v").alias("x"))


def sql_list(x) -> str:
    return "[" + ", ".join(sql_list(v) if hasattr(v, "__len__") else f"{float(v)!r}::DOUBLE" for v in x) + "]"


TAPS = A.low_pass(3, 2, 4)


@query(f"""WITH {SIGNAL}, h AS (SELECT {sql_list(TAPS)} AS h), m AS (SELECT user_id, x, unnest(range(0, ((len(x) * 3 + 1) // 2)::BIGINT)) AS m FROM s)
SELECT user_id::BIGINT AS utt, m::BIGINT AS i, round(coalesce(list_sum(list_transform(list_filter(range(0, len(x)), lambda k: m * 2 - k * 3 BETWEEN -{len(TAPS) // 2} AND {len(TAPS) // 2}), lambda k: x[k + 1] * h[m * 2 - k * 3 + {len(TAPS) // 2 + 1}])), 0), 6) + 0.0 AS v FROM m, h""")
def resampled_signal(spark, d):
    """Signals at three halves of their rate, in blocks of 32 samples."""
    got = A.resample(signals(spark, d, 32), 3, 2, half=4, span=32)
    return got.select("utt", F.posexplode("x").alias("k", "v"), "at").select("utt", (F.col("at") + F.col("k")).alias("i"), (F.round("v", 6) + F.lit(0.0)).alias("v"))


FRONT = A.FrontEnd(rate=64, wide=8, hop=3, size=16, filters=5, low=1.0, high=32.0, cepstra=4)


@query(f"""WITH {SIGNAL}, c AS (SELECT {sql_list(FRONT.window())} AS win, {sql_list(FRONT.mel_filters())} AS mel, {sql_list(FRONT.cosines())} AS co),
f AS (SELECT user_id, t, x[3 * t + 1:3 * t + 8] AS x FROM (SELECT user_id, x, unnest(range(0, (len(x) - 8) // 3 + 1)) AS t FROM s WHERE len(x) >= 8)),
e AS (SELECT user_id, t, list_transform(range(1, 9), lambda i: (x[i] - 0.97::DOUBLE * x[greatest(1, i - 1)]) * win[i]) AS y FROM f, c),
p AS (SELECT user_id, t, list_transform(range(0, 9), lambda k: list_sum(list_transform(range(0, 8), lambda n: y[n + 1] * cos(2 * pi() * k * n / 16))) ** 2 + list_sum(list_transform(range(0, 8), lambda n: y[n + 1] * sin(2 * pi() * k * n / 16))) ** 2) AS p FROM e),
l AS (SELECT user_id, t, list_transform(mel, lambda r: ln(greatest(1e-10::DOUBLE, list_sum(list_transform(range(1, 10), lambda k: p[k] * r[k]))))) AS l FROM p, c)
SELECT user_id::BIGINT AS utt, t::BIGINT AS t, (k - 1)::INT AS k, round(list_sum(list_transform(range(1, 6), lambda m: l[m] * co[k][m])), 5) + 0.0 AS v FROM l, c, range(1, 5) q(k)""")
def cepstral_features(spark, d):
    """Cepstra of signals, in blocks of 16 samples with frames that reach over their ends."""
    got = A.cepstra(signals(spark, d, 16), FRONT, span=16)
    return got.select("utt", "t", F.posexplode("x").alias("k", "v")).select("utt", "t", "k", (F.round("v", 5) + F.lit(0.0)).alias("v"))


@query("""WITH e AS (SELECT event_id, user_id, ts, value::DOUBLE AS v FROM events), w AS (SELECT event_id, first_value(v) OVER a AS f, last_value(v) OVER a AS l, lead(v, 1) OVER o AS a1, lead(v, 2) OVER o AS a2, lag(v, 1) OVER o AS b1, lag(v, 2) OVER o AS b2 FROM e
WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id), a AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT event_id, round((coalesce(a1, l) - coalesce(b1, f) + 2 * (coalesce(a2, l) - coalesce(b2, f))) / 10, 6) + 0.0 AS slope, round(-3 * (coalesce(a1, l) - coalesce(b1, f) + 2 * (coalesce(a2, l) - coalesce(b2, f))) / 10, 6) + 0.0 AS other FROM w""")
def feature_slopes(spark, d):
    rows = events(spark, d).withColumn("x", F.array(F.col("value").cast("double"), F.col("value").cast("double") * -3))
    got = R.regression(rows, "user_id", ["ts", "event_id"], "x")
    return got.select("event_id", *[(F.round(F.col("slope")[k], 6) + F.lit(0.0)).alias(n) for k, n in enumerate(("slope", "other"))])


#: A layer of two cells over three inputs.
CELLS = U.Lstm(np.array([[((3 * r + 5 * c) % 7 - 3) / 4 for c in range(3)] for r in range(8)]), np.array([[((2 * r + 3 * c) % 5 - 2) / 4 for c in range(2)] for r in range(8)]), np.array([(r % 3 - 1) / 4 for r in range(8)]))


@query(f"""WITH RECURSIVE l AS (SELECT {sql_list(CELLS.w)} AS w, {sql_list(CELLS.u)} AS u, {sql_list(CELLS.b)} AS b), f AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, [value / 100, (event_id % 7) / 7, (event_id % 3) / 3]::DOUBLE[] AS x FROM events),
v AS (SELECT DISTINCT user_id, 0::BIGINT AS event_id, 0::BIGINT AS t, [0.0, 0.0]::DOUBLE[] AS h, [0.0, 0.0]::DOUBLE[] AS c FROM f UNION ALL
SELECT user_id, event_id, t, list_transform(range(1, 3), lambda j: (1 / (1 + exp(-z[6 + j]))) * (1 - 2 / (exp(2 * d[j]) + 1))), d FROM (SELECT *, list_transform(range(1, 3), lambda j: (1 / (1 + exp(-z[2 + j]))) * c[j] + (1 / (1 + exp(-z[j]))) * (1 - 2 / (exp(2 * z[4 + j]) + 1))) AS d FROM (
  SELECT f.user_id, f.event_id, f.t, v.c, list_transform(range(1, 9), lambda g: b[g] + list_sum(list_transform(range(1, 4), lambda i: w[g][i] * x[i])) + list_sum(list_transform(range(1, 3), lambda j: u[g][j] * h[j]))) AS z FROM v JOIN f ON f.user_id = v.user_id AND f.t = v.t + 1, l)))
SELECT event_id, round(h[1], 6) + 0.0 AS a, round(h[2], 6) + 0.0 AS b FROM v WHERE t > 0""")
def recurrent_layer(spark, d):
    """The outputs of a recurrent layer over the events of each user."""
    x = F.array(F.col("value") / 100, (F.col("event_id") % 7) / 7, (F.col("event_id") % 3) / 3).cast("array<double>")
    rows = events(spark, d).select("user_id", F.struct("ts", "event_id").alias("at"), "event_id", x.alias("x"))
    placed = rows.withColumn("t", F.row_number().over(Window.partitionBy("user_id").orderBy("at")))
    got = U.recurrent(placed, CELLS, "user_id", "t", "x", rows=50)
    return got.join(placed.select("user_id", "t", "event_id"), ["user_id", "t"]).select("event_id", *[(F.round(F.col("h")[k], 6) + F.lit(0.0)).alias(n) for k, n in enumerate("ab")])
