"""Token passing over tables: all utterances at once, one superstep a frame, for nets of any size.

The net stays in tables, and so do tokens, back pointers and results; nothing of them is collected.  A token is (arc, phone place,
state): an arc with a label ``D=k`` shares the chain of its dictionary entry with all arcs of that label, and no chain is copied.  In a
superstep

1. tokens meet the chains: a token stays, or goes on to the next state or the next phone;
2. of the tokens that end at a node in one utterance the best one goes on, and meets the arcs behind the node (eps paths are entries of
   the node, see ``entries``);
3. the best token of each (utterance, arc, place, state) stays (a tie goes to the one that was there, then to the one that goes on inside its arc, then to
   the smaller arc that it comes from), the score of its tied state is added, and the beam keeps the best ones of each utterance.

A superstep deals the tokens out by utterance once, and is one job: a Parquet table in the checkpoint folder, whose folders part the tokens that results read
(back pointers, those that leave a word, those of a last frame) from the others, which are deleted behind the next superstep.  So lineage and space are
bounded, and a lost executor costs the tasks of one frame.  A back pointer (frame, arc) is a row where an arc with an output is entered.  Paths are read off
for all utterances together by pointer doubling.

Defined cases: frames of an utterance are numbered from 0; an utterance whose tokens all die has no row in the result; arcs whose label is no model and
no dictionary entry are an error; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattiq.functions import text as X
from lattiq.operators.graph import EPS
from lattiq.operators.steps import Folder, numbered

SILENT = ("sil", EPS, "</s>")


def chains(models: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """(label, place, state, tied, own, ends, to_place, to_state, to_tied, to_ends, move): a row for each state of each phone of each label.

    models (model, states, own, move) hold a log probability to stay and one to come from the state before (for the first state: from the
    phone before; what enters an arc pays the arc's weight only).  dictionary (entry, phones): labels
    ``D=entry`` with their phones.  to_place and to_state are where a token goes on to, null where it leaves the arc (ends).
    """
    phones = models.select(F.col("model").alias("label"), F.array("model").alias("_p"))
    if dictionary is not None:
        split = F.split("phones", " ") if dict(dictionary.dtypes)["phones"] == "string" else F.col("phones")
        phones = phones.unionByName(dictionary.select(F.concat(F.lit("D="), F.col("entry").cast("string")).alias("label"), split.alias("_p")))
    places = phones.select("label", F.size("_p").alias("_n"), F.posexplode("_p").alias("place", "model"))
    rows = places.join(models, "model", "left")
    rows = rows.withColumn("states", F.when(F.col("states").isNull(), F.raise_error(F.concat(F.lit("no such model: "), "model")).cast("array<int>")).otherwise(F.col("states")))
    each = rows.select("label", "place", "own", "move", F.posexplode("states").alias("state", "tied")).withColumns({"own": F.element_at("own", F.col("state") + 1), "move": F.element_at("move", F.col("state") + 1)})
    w = Window.partitionBy("label").orderBy("place", "state")  # a label has a few phones
    follows = lambda c: F.lead(c).over(w)
    rows = each.select("label", "place", "state", "tied", "own", follows("place").alias("to_place"), follows("state").alias("to_state"), follows("tied").alias("to_tied"), follows("move").alias("move"))
    rows = rows.withColumn("ends", F.col("to_place").isNull())
    return rows.withColumn("to_ends", follows("ends"))


def entries(arcs: DataFrame, closure: DataFrame, first: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(node, arc, label, dst, word, w, tied, ends): the arcs that follow a node directly or over eps paths, by the best of these ways.

    arcs (src, dst, ilabel, olabel, w) are numbered in their order; closure (node, stop, w); first (label, tied, ends): the state that a label begins with.
    """
    order = ["src", "dst", "ilabel", "olabel", "w"]
    plain = numbered(arcs.where(F.col("ilabel") != EPS).select(*order), order, "arc")
    known = plain.join(first.withColumnRenamed("label", "ilabel"), "ilabel", "left")
    known = known.withColumn("tied", F.when(F.col("tied").isNull(), F.raise_error(F.concat(F.lit("no such model: "), "ilabel")).cast("int")).otherwise(F.col("tied")))
    word = F.when(F.col("olabel") != EPS, F.col("olabel"))
    base = known.select("src", "arc", F.col("ilabel").alias("label"), "dst", word.alias("word"), (F.col("w") * alpha).alias("w"), "tied", "ends")
    direct = base.withColumnRenamed("src", "node")
    over = closure.groupBy("node", "stop").agg(F.max("w").alias("_w")).join(base.withColumnRenamed("src", "stop"), "stop")
    over = over.select("node", "arc", "label", "dst", "word", (F.col("w") + F.col("_w") * alpha).alias("w"), "tied", "ends")
    return direct.unionByName(over).groupBy("node", "arc", "label", "dst", "word", "tied", "ends").agg(F.max("w").alias("w"))


#: since, bt and ba: the score with which the token's back pointer (ht, ha) was made, and the one before it.  leads: the best of those that leave arcs into one node.
TOKEN = ["utt", "arc", "label", "dst", "word", "place", "state", "score", "lm", "ht", "ha", "since", "bt", "ba"]


class Decoder:
    """Token passing of frames (key, order, scores) through a net of tables.

    arcs, finals, closure, models, dictionary as in ``search.net``; weights are scaled by alpha.  framewise: a back pointer for every arc, not only for those
    with an output.
    """

    def __init__(self, arcs: DataFrame, finals: DataFrame, closure: DataFrame, models: DataFrame, dictionary: DataFrame | None = None, alpha: float = 1.0, beam: int = 3000, framewise: bool = False) -> None:
        X.decode_options(beam, alpha)
        spark = arcs.sparkSession
        self.spark, self.beam, self.framewise = spark, beam, framewise
        self.folder = Folder(spark, "decode")  # back pointers hold the score on entry, before that of the state
        self.chains = self.folder.keep(chains(models, dictionary), "chains")
        first = self.chains.where("place = 0 and state = 0").select("label", "tied", "ends")
        self.entries = self.folder.keep(entries(arcs, closure, first, alpha), "entries")
        self.finals = self.folder.keep(finals.select("node").distinct(), "finals")
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", str(max(1000, beam)))  # tasks cut an utterance's tokens to the beam before they meet

    def _entered(self, leaving: DataFrame, t: int) -> DataFrame:
        """Tokens at the arcs behind the nodes of leaving (utt, node, score, lm, ht, ha, since, bt, ba, came)."""
        new = F.lit(True) if self.framewise else F.col("word").isNotNull()
        made = lambda value, name: F.when(new, value).otherwise(F.col(name)).alias(name)
        score = F.col("score") + F.col("w")
        return leaving.join(self.entries, "node").select(
            "utt", "arc", "label", "dst", "word", F.lit(0).alias("place"), F.lit(0).alias("state"), score.alias("score"), (F.col("lm") + F.col("w")).alias("lm"),
            made(F.lit(t), "ht"), made(F.col("arc"), "ha"), made(score, "since"), made(F.col("ht"), "bt"), made(F.col("ha"), "ba"), new.alias("fresh"), "tied", "ends", F.lit(2).alias("_prio"), "came",
        )

    def _inside(self, tokens: DataFrame) -> DataFrame:
        """Tokens that stay where they are, or go on inside their arcs."""
        at = tokens.join(self.chains, ["label", "place", "state"])
        stay = F.struct("place", "state", (F.col("score") + F.col("own")).alias("score"), "tied", "ends", F.lit(0).alias("_prio"))
        on = F.struct(F.col("to_place").alias("place"), F.col("to_state").alias("state"), (F.col("score") + F.col("move")).alias("score"), F.col("to_tied").alias("tied"), F.col("to_ends").alias("ends"), F.lit(1).alias("_prio"))
        both = at.select(*[c for c in TOKEN if c not in ("place", "state", "score")], F.inline(F.when(F.col("ends"), F.array(stay)).otherwise(F.array(stay, on))))
        return both.withColumns({"fresh": F.lit(False), "came": F.col("arc")})

    def run(self, frames: DataFrame, key: str = "utt", order: str = "t", scores: str = "scores", lattice: bool = False) -> None:
        """Pass all frames; results are then read from ``best`` and ``lattice``."""
        rows = frames.select(F.col(key).alias("utt"), F.col(order).cast("int").alias("t"), F.col(scores).cast("array<double>").alias("scores"))
        kept = self.folder.keep(rows.withColumn("over", F.col("t") == F.max("t").over(Window.partitionBy("utt"))), "frames", "t")
        top = kept.agg(F.max("t")).first()[0]
        nothing = F.lit(None)
        start = kept.where("t = 0").select("utt").distinct().select(
            "utt", F.lit(0).cast("long").alias("node"), F.lit(0.0).alias("score"), F.lit(0.0).alias("lm"), nothing.cast("int").alias("ht"), nothing.cast("long").alias("ha"),
            F.lit(0.0).alias("since"), nothing.cast("int").alias("bt"), nothing.cast("long").alias("ba"), F.lit(-1).cast("long").alias("came"),
        )
        slot = Window.partitionBy("utt", "arc", "place", "state").orderBy(F.desc("score"), "_prio", "came")
        beam = Window.partitionBy("utt").orderBy(F.desc("score"), "arc", "place", "state")
        node = Window.partitionBy("utt", "dst", "ends").orderBy(F.desc("score"), "arc")
        parts = ["over", "fresh", "leads"] if lattice else ["over", "fresh"]
        tokens = None
        for t in range(-1 if top is None else top + 1):
            now = kept.where(F.col("t") == t).select("utt", "scores", "over")
            if tokens is None:
                moved = self._entered(start, 0)
            else:
                live = tokens.where("not over")
                leaving = live.where("leads").select("utt", F.col("dst").alias("node"), "score", "lm", "ht", "ha", "since", "bt", "ba", F.col("arc").alias("came"))
                moved = self._inside(live.select(*TOKEN)).unionByName(self._entered(leaving, t)).repartition("utt")
            one = moved.withColumn("_r", F.row_number().over(slot)).where("_r = 1")
            scored = one.join(now, "utt").withColumn("score", F.col("score") + F.element_at("scores", F.col("tied") + 1))
            pruned = scored.withColumn("_r", F.row_number().over(beam)).where(F.col("_r") <= self.beam)
            marked = pruned.withColumn("leads", F.col("ends") & (F.row_number().over(node) == 1))
            tokens = self.folder.keep(marked.select(*TOKEN, "over", "fresh", "leads"), f"tokens/at={t}", *parts)
            self.folder.drop(f"tokens/at={t - 1}/{'/'.join(f'{c}=false' for c in parts)}")
        self._kind, self._any, self._lattice = rows.schema["utt"].dataType.simpleString(), top is not None, lattice

    def _table(self, name: str) -> DataFrame:
        """The kept tokens that are back pointers (back), leave a word while frames follow (left), or are of a last frame (ended)."""
        kind = f"utt {self._kind}, arc long, label string, dst long, word string, place int, state int, score double, lm double, ht int, ha long, since double, bt int, ba long, over boolean, fresh boolean, leads boolean, at int"
        kept = self.spark.read.schema(kind).parquet(f"{self.folder.path}/tokens") if self._any else self.spark.createDataFrame([], kind)
        if name == "back":
            return kept.where("fresh").select("utt", F.col("at").alias("t"), "arc", "word", "lm", "bt", "ba")
        return kept.where("over" if name == "ended" else "not over and leads and word is not null and ht is not null")

    def ranked(self) -> DataFrame:
        """The tokens of the last frame of each utterance: those that leave an arc into a final node first, then by score (rank from 1)."""
        out = self._table("ended").join(self.chains.select("label", "place", "state", F.col("to_place").isNull().alias("_x")), ["label", "place", "state"])
        out = out.join(self.finals.select(F.col("node").alias("dst"), F.lit(True).alias("_f")), "dst", "left")
        out = out.withColumn("at_final", F.col("_x") & F.coalesce("_f", F.lit(False)))
        order = Window.partitionBy("utt").orderBy(F.desc("at_final"), F.desc("score"), "arc", "place", "state")
        return out.withColumn("rank", F.row_number().over(order)).drop("_x", "_f")

    def best(self, n: int = 1) -> DataFrame:
        """(utt, rank, words, score, at_final): the n best tokens of each utterance with the words on their way.

        Pointers double: after k rounds a row leads 2^k words back, and the places of a path are found from the largest step down, so a
        path of m words takes about 2 log m joins, and its rows are its words.
        """
        ends = self.folder.keep(self.ranked().where(F.col("rank") <= n).select("utt", "rank", "score", "at_final", "ht", "ha"), "ends")
        back = self._table("back")
        jumps = [self.folder.keep(back.where("bt is not null").select("utt", "t", "arc", "bt", "ba"), "jump0")]
        while not jumps[-1].isEmpty():
            a = jumps[-1]
            b = a.select("utt", F.col("t").alias("bt"), F.col("arc").alias("ba"), F.col("bt").alias("_t"), F.col("ba").alias("_a"))
            jumps.append(self.folder.keep(a.join(b, ["utt", "bt", "ba"]).select("utt", "t", "arc", F.col("_t").alias("bt"), F.col("_a").alias("ba")), f"jump{len(jumps)}"))
        path = ends.where("ht is not null").select("utt", "rank", F.col("ht").alias("t"), F.col("ha").alias("arc"), F.lit(0).cast("long").alias("depth"))
        for k in range(len(jumps) - 2, -1, -1):
            further = path.join(jumps[k], ["utt", "t", "arc"]).select("utt", "rank", F.col("bt").alias("t"), F.col("ba").alias("arc"), (F.col("depth") + (1 << k)).alias("depth"))
            path = self.folder.keep(path.unionByName(further), f"path{k}")
        named = path.join(back.select("utt", "t", "arc", "word"), ["utt", "t", "arc"])
        words = named.where(F.col("word").isNotNull() & ~F.col("word").isin(*SILENT)).groupBy("utt", "rank").agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "word"))).alias("_w"))  # the words of one path
        out = ends.join(words, ["utt", "rank"], "left")
        return out.select("utt", "rank", F.coalesce(F.col("_w.word"), F.array().cast("array<string>")).alias("words"), "score", "at_final")

    def lattice(self) -> DataFrame:
        """(utt, start, stop, word, prev, am, lm): a row where the best token of a node leaves a word, with its scores since the word before; silence at the start is left out."""
        if not self._lattice:
            raise ValueError("the run kept no lattice")
        last = self.ranked().where("rank = 1 and word is not null and ht is not null")
        columns = ["utt", F.col("ht").alias("start"), (F.col("at") + 1).alias("stop"), F.when(F.col("word") == "</s>", F.lit("sil")).otherwise(F.col("word")).alias("word"), "score", "since", "lm", "bt", "ba"]
        left = self._table("left").select(*columns).unionByName(last.select(*columns))  # an arc with a word is entered by a back pointer: it is the token's own
        prev = self._table("back").select("utt", F.col("t").alias("bt"), F.col("arc").alias("ba"), F.col("word").alias("_pw"), F.col("lm").alias("_pm"))
        rows = left.join(prev, ["utt", "bt", "ba"], "left")
        named = rows.select("utt", "start", "stop", "word", F.coalesce("_pw", F.lit("<s>")).alias("prev"), (F.col("score") - F.col("since")).alias("am"), (F.col("lm") - F.coalesce("_pm", F.lit(0.0))).alias("lm"))
        first = named.where("not (word = 'sil' and start = 0)").groupBy("utt", "start", "stop", "word", "prev").agg(F.min(F.struct("am", "lm")).alias("_f"))
        return first.select("utt", "start", "stop", "word", "prev", "_f.am", "_f.lm")
