"""Text definitions of hidden Markov models, and their conversion to tied states.

A file is one definition with names that hold within it, so it is one row and one task; the rows that come out (models,
states, mixtures, matrices by name) are brought together by joins.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.functions import text as X
from lattiq.operators.lexicon import tied_models
from lattiq.operators.steps import numbered
from lattiq.sources.binary import parsed

#: kind: model (parts: state names, ref: matrix), state (id: place of a mixture, weight, ref: its name), mixture (values: mean, more: variance, gconst), matrix (values).
ROW = "path string, kind string, name string, id int, parts array<string>, ref string, weight double, values array<double>, more array<double>, gconst double"


class Tokens:
    def __init__(self, text: str) -> None:
        self.items, self.at = re.findall(r'"[^"]*"|\S+', text), 0

    def peek(self) -> str:
        return self.items[self.at].upper() if self.at < len(self.items) else ""

    def next(self) -> str:
        self.at += 1
        return self.items[self.at - 1]

    def name(self) -> str:
        return self.next().strip('"')

    def numbers(self) -> list[float]:
        n = int(self.next())
        self.at += n
        return [float(x) for x in self.items[self.at - n : self.at]]


def definition_rows(path: str, text: str) -> list[tuple]:
    """The rows of one definition; parts without a name get one from what they are part of."""
    t, rows = Tokens(text), []
    row = lambda kind, name, id_=None, parts=None, ref=None, weight=None, values=None, more=None, gconst=None: rows.append((path, kind, name, id_, parts, ref, weight, values, more, gconst))

    def mixture(name: str) -> str:
        if t.peek() == "~M":
            t.next()
            return t.name()
        mean = var = g = None
        while t.peek() in ("<MEAN>", "<VARIANCE>", "<GCONST>"):
            tag = t.next().upper()
            if tag == "<MEAN>":
                mean = t.numbers()
            elif tag == "<VARIANCE>":
                var = t.numbers()
            else:
                g = float(t.next())
        if g is None:
            g = sum(math.log(2 * math.pi * v) for v in var)
        row("mixture", name, values=mean, more=var, gconst=g)
        return name

    def state(name: str) -> str:
        if t.peek() == "~S":
            t.next()
            return t.name()
        if t.peek() == "<NUMMIXES>":
            t.next(), t.next()
        if t.peek() != "<MIXTURE>":  # a single Gaussian without a count
            row("state", name, 1, ref=mixture(f"{name}.m1"), weight=1.0)
        while t.peek() == "<MIXTURE>":
            t.next()
            k, w = int(t.next()), float(t.next())
            row("state", name, k, ref=mixture(f"{name}.m{k}"), weight=w)
        return name

    def matrix(name: str) -> str:
        if t.peek() == "~T":
            t.next()
            return t.name()
        t.next()
        n = int(t.next())
        t.at += n * n
        row("matrix", name, n, values=[float(x) for x in t.items[t.at - n * n : t.at]])
        return name

    while t.peek():
        tag = t.next().upper()
        if tag == "~M":
            mixture(t.name())
        elif tag == "~S":
            state(t.name())
        elif tag == "~T":
            matrix(t.name())
        elif tag == "~H":
            name, names, trans = t.name(), [], None
            while t.peek() != "<ENDHMM>":
                if t.peek() == "<STATE>":
                    t.next()
                    names.append(state(f"{name}.s{t.next()}"))
                elif t.peek() in ("<TRANSP>", "~T"):
                    trans = matrix(f"{name}.t")
                else:
                    t.next()
            t.next()
            row("model", name, parts=names, ref=trans)
    return rows


def definitions(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.encode("value", "utf-8").alias("content"))
    return parse_definitions(files)


def parse_definitions(files: DataFrame) -> DataFrame:
    return parsed(files, lambda path, data: definition_rows(path, data.decode("utf-8", "replace")), ROW)


def tied(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(models, states, matrices) of one definition, ids in byte order of names: models (model, states, tm), states (id, state, mixtures), matrices (id, matrix, n, logs).

    Mixtures are structs (lw, mu, iv, g): log weights, means, inverse variances between 1e-30 and 1e30, constants.  What a name
    refers to must be there.
    """
    mixes = rows.where("kind = 'mixture'").select(F.col("name").alias("ref"), F.col("values").alias("mu"), F.transform("more", lambda v: F.greatest(F.lit(1e-30), F.least(F.lit(1e30), F.try_divide(F.lit(1.0), v)))).alias("iv"), F.col("gconst").alias("g"))
    uses = rows.where("kind = 'state'").select(F.col("name").alias("state"), "id", "weight", "ref").join(mixes, "ref", "left")
    mu = F.coalesce("mu", F.raise_error(F.concat(F.lit("no such mixture: "), F.col("ref"))).cast("array<double>"))
    packed = uses.groupBy("state").agg(F.array_sort(F.collect_list(F.struct("id", X.mixture_log(F.col("weight")).alias("lw"), mu.alias("mu"), "iv", "g"))).alias("m"))
    mixtures = F.transform("m", lambda m: F.struct(m["lw"].alias("lw"), m["mu"].alias("mu"), m["iv"].alias("iv"), m["g"].alias("g")))
    states = numbered(packed.select("state", mixtures.alias("mixtures")), ["state"], "id").withColumn("id", F.col("id").cast("int"))
    logs = F.transform("values", X.transition_log)
    matrices = numbered(rows.where("kind = 'matrix'").select(F.col("name").alias("matrix"), F.col("id").alias("n"), logs.alias("logs")), ["matrix"], "id").withColumn("id", F.col("id").cast("int"))
    models = tied_models(rows.where("kind = 'model'").select(F.col("name").alias("model"), F.col("ref").alias("matrix"), F.col("parts").alias("names")), states.select("state", "id"), matrices.select("matrix", "id"))
    return models, states, matrices


def layout(models: DataFrame, states: DataFrame, dim: int) -> DataFrame:
    """One row: models, states of all models, tied states, mixtures, values of means: what an exported model takes."""
    m = models.agg(F.count("*").alias("n_models"), F.coalesce(F.sum(F.size("states")), F.lit(0)).alias("n_model_states"))
    s = states.agg(F.count("*").alias("n_states"), F.coalesce(F.sum(F.size("mixtures")), F.lit(0)).alias("n_mixtures"))
    return m.crossJoin(s).withColumn("n_values", F.col("n_mixtures") * dim)


def ram_bytes(beam: int, arcs, states):
    """Memory that a search on a chip takes, in bytes: fixed values of that search for its arena, four bytes twice a beam entry, one an arc and a state."""
    return 254 * 4 + 8 * beam + arcs + states
