"""Rewriting of arc tables (src, dst, ilabel, olabel, w): renumbering, words to phones, pushing, repeated chains.

Walks along chains double their pointers in each round, so a chain of n arcs takes log n rounds
of joins; each round stands in the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.operators.steps import cut, numbered, pointer_ends, running_sum

EPS = "<eps>"


def renumber(arcs: DataFrame, finals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes numbered by their first place in the scan order ``pos`` (start before end), finals last by old number.

    Returns (arcs, finals) with the new numbers; the first arc's start is 0.  The numbering is
    one window over one narrow row for each node.
    """
    ends = arcs.select(F.explode(F.array(F.struct(F.col("src").alias("node"), (F.col("pos") * 2).alias("at")), F.struct(F.col("dst").alias("node"), (F.col("pos") * 2 + 1).alias("at")))).alias("e"))
    seen = ends.groupBy("e.node").agg(F.min("e.at").alias("at"))
    known = seen.join(finals.select("node", F.lit(True).alias("final")).distinct(), "node", "left")
    placed = known.selectExpr("node", "coalesce(final, false) as last", "if(coalesce(final, false), node, at) as at")
    numbers = numbered(placed, ["last", "at"], "number").select("node", "number")
    at = lambda c: numbers.select(F.col("node").alias(c), F.col("number").alias(f"new_{c}"))
    out = arcs.join(at("src"), "src").join(at("dst"), "dst").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), "ilabel", "olabel", "w")
    return out, finals.join(numbers, "node").select(F.col("number").alias("node"))


def words_to_phones(arcs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Each word arc as a chain of phone arcs; nodes are strings, inner ones name their arc, the word and the place.

    The output label and the weight are on the first arc.  A word with several phone rows gives a
    chain for each; a label that the lexicon lacks (or has without phones) stays one arc.
    """
    joined = arcs.join(lexicon.select(F.col("word").alias("ilabel"), "phones"), "ilabel", "left")
    phones = F.when(F.coalesce(F.size("phones"), F.lit(0)) > 0, F.col("phones")).otherwise(F.array("ilabel"))
    steps = joined.withColumn("all", phones).select("src", "dst", F.col("ilabel").alias("word"), "olabel", "w", "all", F.posexplode("all").alias("i", "phone"))
    inner = lambda k: F.concat_ws(":", "src", "dst", "word", F.array_join("all", " "), k.cast("string"))
    first, last = F.col("i") == 0, F.col("i") == F.size("all") - 1
    return steps.select(
        F.when(first, F.col("src").cast("string")).otherwise(inner(F.col("i"))).alias("src"), F.when(last, F.col("dst").cast("string")).otherwise(inner(F.col("i") + 1)).alias("dst"),
        F.col("phone").alias("ilabel"), F.when(first, F.col("olabel")).otherwise(EPS).alias("olabel"), F.when(first, F.col("w")).otherwise(0.0).alias("w"))


def push_forward(arcs: DataFrame, finals: DataFrame) -> DataFrame:
    """Output labels and weights moved to the last arcs of the chains behind them.

    A walk goes on through nodes with one arc in and only eps outputs that are neither start nor final;
    the last arc of each walk takes the label and the sum of the weights, the arcs before it none.
    """
    cols = ["src", "dst", "ilabel", "olabel", F.col("w").cast("double").alias("w")]
    arcs = cut(arcs.select(*cols))
    quiet = arcs.groupBy(F.col("src").alias("node")).agg(F.min(F.col("olabel") == EPS).alias("quiet")).where("quiet").select("node")
    single = arcs.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n")).where("n = 1").select("node")
    inner = cut(quiet.join(single, "node").where("node <> 0").join(finals.select("node"), "node", "left_anti"))
    into = cut(arcs.join(inner.withColumnRenamed("node", "dst"), "dst").select(F.col("dst").alias("node"), "src", "ilabel", "olabel", "w"))
    ends = pointer_ends(into.join(inner.withColumnRenamed("node", "src"), "src").select("node", F.col("src").alias("to"), "w"))
    tops = inner.join(ends, "node", "left").select("node", F.coalesce("end", "node").alias("top"), F.coalesce("w", F.lit(0.0)).alias("upto"))
    word = ~F.col("olabel").isin(EPS, "<F>") & (F.col("ilabel") != "sil")
    origin = into.where(word).select(F.col("node").alias("top"), F.col("olabel").alias("label"), F.col("w").alias("first"))
    walk = cut(tops.join(origin, "top").select(F.col("node").alias("src"), "label", (F.col("first") + F.col("upto")).alias("before")))
    stays = inner.select(F.col("node").alias("dst"), F.lit(True).alias("goes_on"))
    rows = arcs.join(walk, "src", "left").join(stays, "dst", "left")
    moving = word | F.col("label").isNotNull()
    label = F.when(~moving, F.col("olabel")).when(F.col("goes_on"), EPS).otherwise(F.coalesce("label", "olabel"))
    weight = F.when(~moving, F.col("w")).when(F.col("goes_on"), 0.0).otherwise(F.col("w") + F.coalesce("before", F.lit(0.0)))
    return rows.select("src", "dst", "ilabel", label.alias("olabel"), weight.alias("w"))


def push_to_head(arcs: DataFrame, finals: DataFrame, starts: tuple[int, ...] = (0,)) -> DataFrame:
    """Weights moved back to the first arcs of words.

    Word ends are the starts and the targets of arcs with an output (other than <F>, and not at sil).  From them, an arc of weight
    0 takes the best weight behind it: the largest of its target's arcs, of which those of weight 0 are filled first in the
    same way; the target's arcs lose as much.  Arcs at <F>, sil and eps inputs take no part.  A word that ends before it
    has a weight, and arcs of weight 0 in a circle, are errors.
    """
    arcs = cut(arcs.select("src", "dst", "ilabel", "olabel", F.col("w").cast("double").alias("w")))
    spark = arcs.sparkSession
    part = (F.col("olabel") != "<F>") & ~F.col("ilabel").isin("sil", EPS)
    ends = arcs.where(~F.col("olabel").isin(EPS, "<F>") & (F.col("ilabel") != "sil")).select(F.col("dst").alias("node"))
    ends = cut(ends.unionByName(spark.createDataFrame([(s,) for s in starts], "node long")).distinct())
    open_arc = part & (F.col("w") == 0)
    # a node with one arc, of weight 0, passes on what is behind it and keeps that weight: pointers jump over such nodes
    passing = arcs.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.count_if(open_arc).alias("z"), F.max("dst").alias("to")).where("n = 1 and z = 1")
    jump = cut(pointer_ends(passing.join(ends, "node", "left_anti").select("node", "to", F.lit(0.0).alias("w"))).select(F.col("node").alias("dst"), F.col("end").alias("_to")))
    arcs = cut(arcs.join(jump, "dst", "left").withColumn("_to", F.coalesce("_to", "dst")))
    stops = arcs.join(jump.select(F.col("dst").alias("src")), "src", "left_anti")
    zero = cut(stops.where(open_arc).select("src", F.col("_to").alias("dst")).distinct())
    front = cut(zero.join(ends.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node")).distinct())
    inside = front
    while not front.isEmpty():
        front = cut(zero.join(front.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node")).distinct().join(inside, "node", "left_anti"))
        inside = cut(inside.unionByName(front))
    if not inside.join(ends, "node").isEmpty():
        raise ValueError("a word ends before it has a weight")
    own = cut(arcs.where(part & (F.col("w") != 0)).join(inside.withColumnRenamed("node", "src"), "src").select(F.col("src").alias("node"), "w"))
    open_, known = cut(zero.join(inside.withColumnRenamed("node", "src"), "src")), None
    todo = inside
    while not todo.isEmpty():  # nodes all of whose open arcs lead to known ones
        waits = open_ if known is None else open_.join(known.select(F.col("node").alias("dst")), "dst", "left_anti")
        ready = cut(todo.join(waits.select(F.col("src").alias("node")).distinct(), "node", "left_anti"))
        if ready.isEmpty():
            raise ValueError("arcs of weight 0 go in a circle")
        values = own if known is None else own.unionByName(open_.join(known.select(F.col("node").alias("dst"), F.col("best").alias("w")), "dst").select(F.col("src").alias("node"), "w"))
        best = ready.join(values.groupBy("node").agg(F.max("w").alias("best")), "node", "left")
        known = cut(best if known is None else known.unionByName(best))
        todo = cut(todo.join(ready, "node", "left_anti"))
    if known is None:
        return arcs.drop("_to")
    if not known.where("best is null").isEmpty():
        raise ValueError("no weight behind a node")
    ahead, behind = known.select(F.col("node").alias("_to"), F.col("best").alias("_ahead")), known.select(F.col("node").alias("src"), F.col("best").alias("_behind"))
    opens = ends.unionByName(inside).distinct().select(F.col("node").alias("src"), F.lit(True).alias("_open"))
    rows = arcs.join(ahead, "_to", "left").join(behind, "src", "left").join(opens, "src", "left")
    filled = F.when(open_arc & F.col("_open"), F.coalesce("_ahead", F.lit(0.0))).otherwise(F.col("w"))
    return rows.select("src", "dst", "ilabel", "olabel", (filled - F.coalesce("_behind", F.lit(0.0))).alias("w"))


def chains(arcs: DataFrame, finals: DataFrame) -> DataFrame:
    """(src, dst, phones, w, nodes): the longest chains of two or more plain arcs from word ends; nodes are the inner ones."""
    arcs = cut(arcs.select("src", "dst", "ilabel", "olabel", F.col("w").cast("double").alias("w")))
    several = arcs.groupBy("dst").agg(F.count("*").alias("n")).where("n > 1").select(F.col("dst").alias("node"))
    ends = arcs.where(F.col("olabel") != EPS).select(F.col("dst").alias("node")).unionByName(arcs.where(F.col("ilabel") == EPS).select(F.col("src").alias("node")))
    ends = cut(ends.unionByName(several).unionByName(finals.select("node")).unionByName(arcs.sparkSession.createDataFrame([(0,)], "node long")).distinct())
    plain = arcs.where((F.col("olabel") == EPS) & (F.col("ilabel") != EPS)).select("src", "dst", "ilabel", "w")
    lone = arcs.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n")).where("n = 1").select("node").join(ends, "node", "left_anti")
    step = cut(plain.join(lone.withColumnRenamed("node", "src"), "src"))
    inner = step.select(F.col("src").alias("node"))
    into = cut(plain.join(inner.withColumnRenamed("node", "dst"), "dst").select(F.col("dst").alias("node"), "src", "ilabel", "w"))  # one arc each
    up = pointer_ends(into.join(inner.withColumnRenamed("node", "src"), "src").select("node", F.col("src").alias("to"), "w"))
    tops = inner.join(up, "node", "left").select("node", F.coalesce("end", "node").alias("top"), F.coalesce("hops", F.lit(0)).alias("hops"))
    first = into.join(ends.withColumnRenamed("node", "src"), "src").select(F.col("node").alias("top"), F.lit(0).cast("long").alias("k"), "src", F.col("node").alias("dst"), "ilabel", "w")
    later = step.join(tops.withColumnRenamed("node", "src"), "src").select("top", (F.col("hops") + 1).alias("k"), "src", "dst", "ilabel", "w").join(first.select("top"), "top", "left_semi")
    rows = first.unionByName(later).groupBy("top").agg(F.array_sort(F.collect_list(F.struct("k", "src", "dst", "ilabel", "w"))).alias("x"))  # a chain is one entry of a dictionary
    return rows.select(F.col("x")[0]["src"].alias("src"), F.element_at("x", -1)["dst"].alias("dst"), F.array_join("x.ilabel", " ").alias("phones"), F.aggregate("x.w", F.lit(0.0).cast("double"), lambda a, b: a + b).alias("w"), F.slice("x.src", F.lit(2), F.size("x") - 1).alias("nodes"))


def repeated_chains(found: DataFrame, ratio: float) -> DataFrame:
    """(entry, phones, copies): chains by falling count, kept while their running share of all repeats is ratio / 5 at most."""
    n = found.groupBy("phones").agg(F.count("*").alias("copies"))
    total = n.agg(F.sum(F.when(F.col("copies") > 1, F.col("copies"))).alias("total"))
    order = ["copies desc", "phones"]
    ordered = running_sum(numbered(n, order, "entry"), order, F.col("copies"), "upto")
    return ordered.crossJoin(F.broadcast(total)).where(F.col("upto") <= F.col("total") * (ratio / 5)).select("entry", "phones", "copies")


def expand_partly(arcs: DataFrame, finals: DataFrame, ratio: float) -> tuple[DataFrame, DataFrame]:
    """(arcs, dictionary): each kept chain becomes one arc ``D=entry`` with its summed weight."""
    found = chains(arcs, finals)
    kept = repeated_chains(found, ratio)
    taken = found.join(kept, "phones")
    # a chain's nodes have one arc in and one out: all arcs at them go
    inside = taken.select(F.explode("nodes").alias("node"))
    rest = arcs.join(inside.select(F.col("node").alias("src")), "src", "left_anti").join(inside.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst", "ilabel", "olabel", "w")
    short = taken.select("src", "dst", F.concat(F.lit("D="), F.col("entry").cast("string")).alias("ilabel"), F.lit(EPS).alias("olabel"), "w")
    return rest.unionByName(short), kept.select("entry", "phones")
