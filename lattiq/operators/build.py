"""Building a decoding graph: a chain of graph steps, each a set of tables that stays, with their sizes.

A step that ended is not run again: after a failure, or with more steps, a build goes on behind the last finished one.  A step
is finished when its table of sizes is there, which is written last; a step whose options or whose steps before it have changed is run anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.operators import graph as G
from lattiq.operators import lexicon as L
from lattiq.operators import rewrite as W
from lattiq.operators.steps import Folder, cut, numbered

EPS = "<eps>"


class Build:
    """Named steps in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.order, self.key, self.ran = spark, folder.rstrip("/"), [], "", []

    def _there(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def step(self, name: str, options: str, make: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
        """The tables of a step, by name; made and written if they are not there yet."""
        self.key = hashlib.sha256(f"{self.key}|{name}|{options}".encode()).hexdigest()[:16]
        at = f"{self.folder}/{len(self.order):02d}-{name}-{self.key}"
        self.order.append((name, at))
        if not self._there(f"{at}/sizes/_SUCCESS"):
            rows = []
            for table, df in make().items():
                df.write.mode("overwrite").parquet(f"{at}/{table}")
                rows.append((table, self.spark.read.parquet(f"{at}/{table}").count()))
            self.spark.createDataFrame(rows, "name string, n long").coalesce(1).write.mode("overwrite").parquet(f"{at}/sizes")
            self.ran.append(name)
        names = [r["name"] for r in self.spark.read.parquet(f"{at}/sizes").collect()]  # a few tables
        return {t: self.spark.read.parquet(f"{at}/{t}") for t in names}

    def sizes(self) -> DataFrame:
        """(place, step, name, n): rows of each table of each step."""
        out = None
        for k, (step, at) in enumerate(self.order):
            rows = self.spark.read.parquet(f"{at}/sizes").select(F.lit(k).alias("place"), F.lit(step).alias("step"), "name", "n")
            out = rows if out is None else out.unionByName(rows)
        return out


def plain_nodes(arcs: DataFrame, finals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with names as numbers in the order of the names; the start "0" is 0."""
    names = arcs.select(F.col("src").alias("node")).union(arcs.select("dst")).union(finals.select("node")).distinct()
    number = numbered(names.withColumn("_later", F.col("node") != "0"), ["_later", "node"], "n").select("node", "n")
    at = lambda c: number.select(F.col("node").alias(c), F.col("n").alias(f"_{c}"))
    out = arcs.join(at("src"), "src").join(at("dst"), "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), "ilabel", "olabel", F.col("w").cast("double").alias("w"))
    return out, finals.join(number, "node").select(F.col("n").alias("node"))


def tables(pair: tuple[DataFrame, DataFrame]) -> dict[str, DataFrame]:
    return {"arcs": pair[0], "finals": pair[1]}


def shared(graph: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Equal arcs out of a node made one, with numbers as nodes."""
    return tables(plain_nodes(*G.factor(graph["arcs"], graph["finals"])))


def in_phones(graph: dict[str, DataFrame], lexicon: DataFrame) -> dict[str, DataFrame]:
    return tables(plain_nodes(W.words_to_phones(graph["arcs"], lexicon), graph["finals"].select(F.col("node").cast("string").alias("node"))))


def in_contexts(graph: dict[str, DataFrame]) -> dict[str, DataFrame]:
    arcs, finals, _ = G.expand_contexts(graph["arcs"], graph["finals"])
    return tables(plain_nodes(arcs, finals))


def in_models(graph: dict[str, DataFrame], physical: DataFrame) -> dict[str, DataFrame]:
    """Context labels as the physical models (logical, physical) that they fall back to; one that has none is an error."""
    found = L.to_physical(graph["arcs"], physical, "ilabel", "<none>")
    label = F.when(F.col("physical") == "<none>", F.raise_error(F.concat(F.lit("no model for "), "ilabel"))).otherwise(F.col("physical"))
    return {"arcs": found.withColumn("_p", label).select("src", "dst", F.col("_p").alias("ilabel"), "olabel", "w"), "finals": graph["finals"]}


def behind_silence(graph: dict[str, DataFrame], label: str) -> dict[str, DataFrame]:
    """The graph behind an arc that may be passed by: silence before the first word."""
    spark = graph["arcs"].sparkSession
    first = spark.createDataFrame([(0, 1, label, EPS, 0.0), (0, 1, EPS, EPS, 0.0)], "src long, dst long, ilabel string, olabel string, w double")
    top = graph["arcs"].agg(F.max(F.greatest("src", "dst"))).first()[0] or 0
    arcs = G.concat([(first, spark.createDataFrame([(1,)], "node long"), 2), (graph["arcs"], graph["finals"], top + 1)])
    return {"arcs": arcs, "finals": graph["finals"].select((F.col("node") + 2).cast("long").alias("node"))}


def decoding_graph(spark: SparkSession, folder: str, sentences: DataFrame, lexicon: DataFrame, physical: DataFrame | None = None, mode: int = 0, silence: str | None = None, ratio: float | None = None, version: str = "", steps: int | None = None) -> tuple[dict[str, DataFrame], Build]:
    """(the tables of the last step, the build): from sentences (id, tokens) and a lexicon (word, phones) to a graph that is decoded with.

    physical: models (logical, physical) of labels in context; without it, phones stay as they are.  mode: how sentences end (see
    ``graph.context_graph``).  silence: an arc before the first word that may be passed by.  ratio: repeated chains become dictionary entries up to
    this share, in fifths.  version names the inputs: a build of another version shares nothing with this one.  steps: how many to run.

    The last step's tables: arcs, finals, symbols (sym, id), redirects (node, stop, w, depth, path), dictionary (entry, phones).
    """
    build = Build(spark, folder)
    state: dict[str, DataFrame] = {}
    chain: list[tuple[str, str, Callable[[], dict[str, DataFrame]]]] = [
        ("words", f"{version}|{mode}", lambda: tables(G.context_graph(sentences, mode))),
        ("words-shared", "", lambda: shared(state)),
        ("phones", "", lambda: in_phones(state, lexicon)),
        ("phones-shared", "", lambda: shared(state)),
    ]
    if physical is not None:
        chain += [("contexts", "", lambda: in_contexts(state)), ("models", "", lambda: in_models(state, physical)), ("models-shared", "", lambda: shared(state))]
    if silence is not None:
        chain.append(("silence", silence, lambda: behind_silence(state, silence)))

    def ready() -> dict[str, DataFrame]:
        arcs, entries = state["arcs"], None
        if ratio is not None:
            arcs, entries = W.expand_partly(arcs, state["finals"], ratio)
            arcs = cut(arcs)
        if entries is None:
            entries = spark.createDataFrame([], "entry long, phones string")
        labels = arcs.select(F.col("ilabel").alias("sym")).where("not startswith(sym, 'D=')").unionByName(arcs.select(F.col("olabel").alias("sym")))
        return {"arcs": arcs, "finals": state["finals"], "symbols": L.symbols(labels), "redirects": G.closure(G.branches(arcs), longest=G.COMPILED_ARCS), "dictionary": entries}

    chain.append(("ready", str(ratio), ready))
    for name, options, make in chain[:steps]:
        state = build.step(name, options, make)
    return state, build


def sentences_of(arcs: DataFrame, finals: DataFrame, dictionary: DataFrame | None = None, longest: int = 10_000) -> DataFrame:
    """(words, inputs, w, n): what a graph without circles accepts: output words and input labels of its paths, joined by spaces, the weight of a path, and how many
    paths are alike.  Trees are read by doubling; other graphs take a round for each arc, equal ends of paths being one row, and more than longest
    arcs are an error.
    """
    step = arcs
    if dictionary is not None:
        names = dictionary.select(F.concat(F.lit("D="), F.col("entry").cast("string")).alias("ilabel"), F.col("phones").alias("_p"))
        step = arcs.join(names, "ilabel", "left").withColumn("ilabel", F.coalesce("_p", "ilabel")).drop("_p")
    said = lambda c: F.when(F.col(c) != EPS, F.col(c)).otherwise(F.lit(""))
    step = cut(step.select("src", "dst", said("ilabel").alias("ilabel"), said("olabel").alias("olabel"), F.round("w", 6).cast("double").alias("w6")))
    joined = lambda a, b: F.when(a == "", b).when(b == "", a).otherwise(F.concat(a, F.lit(" "), b))
    folder = Folder(arcs.sparkSession, "sentences")
    tree = G.arc_tree(step, folder)
    if tree is not None:
        both = lambda x, before, behind: F.round(before + behind, 6) if x == "w" else joined(before, behind)
        said = G.down_the_tree(tree, folder, {"words": F.col("olabel"), "inputs": F.col("ilabel"), "w": F.col("w6")}, both, "said")
        ends = tree.join(finals.select(F.col("node").alias("dst")), "dst", "left_semi").select("id")
        whole = said.join(ends, "id").select("words", "inputs", "w")
        empty = finals.where("node = 0").select(F.lit("").alias("words"), F.lit("").alias("inputs"), F.lit(0.0).alias("w"))
        return whole.unionByName(empty).groupBy("words", "inputs", "w").agg(F.count("*").alias("n"))
    front = arcs.sparkSession.range(1).select(F.lit(0).cast("long").alias("node"), F.lit("").alias("words"), F.lit("").alias("inputs"), F.lit(0.0).alias("w"), F.lit(1).cast("long").alias("n"))
    done, k = [], 0
    while not front.isEmpty():
        if k > longest:
            raise ValueError("a path does not end")
        done.append(front.join(finals.select("node"), "node", "left_semi").drop("node"))
        moved = front.join(step, front["node"] == step["src"]).select(F.col("dst").alias("node"), joined(F.col("words"), F.col("olabel")).alias("words"), joined(F.col("inputs"), F.col("ilabel")).alias("inputs"), F.round(F.col("w") + F.col("w6"), 6).alias("w"), "n")
        front, k = cut(moved.groupBy("node", "words", "inputs", "w").agg(F.sum("n").alias("n"))), k + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.groupBy("words", "inputs", "w").agg(F.sum("n").alias("n"))
