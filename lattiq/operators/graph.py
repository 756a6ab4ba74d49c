"""Arc tables (src, dst, ilabel, olabel, w) and final nodes: building, joining, rewriting.

Node numbers come from content (token places, offsets), never from the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.operators.steps import Folder, cut, numbered, running_sum

EPS = "<eps>"
#: Arcs of a path that a compiled redirect table has room for.
COMPILED_ARCS = 12


def context_graph(sentences: DataFrame, mode: int = 0) -> tuple[DataFrame, DataFrame]:
    """Arcs and finals of a graph with one branch for each sentence (id, tokens).

    mode 0: the last token enters the final node; 1: an arc ``sil`` does; 2: ``@line`` does.
    The first node is 0.  Interior nodes are (sentence, place) pairs numbered through a
    running sum over sentence lengths; one row per sentence is all that the sum reads.
    """
    rows = sentences.where("size(tokens) > 0").withColumn("n", F.size("tokens") - (1 if mode == 0 else 0))
    sizes = running_sum(rows.select("id", "n"), ["id"], F.col("n"), "base", before=True)
    if mode == 2:
        sizes = numbered(sizes, ["id"], "line")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    steps = rows.select("id", "n", F.posexplode("tokens").alias("i", "label")).join(sizes.drop("n"), "id").crossJoin(F.broadcast(total))
    src = F.when(F.col("i") == 0, 0).otherwise(F.col("base") + F.col("i"))
    dst = F.when((F.col("i") == F.col("n")) & F.lit(mode == 0), F.col("total") + 1).otherwise(F.col("base") + F.col("i") + 1)
    arcs = steps.select(src.cast("long").alias("src"), dst.cast("long").alias("dst"), F.col("label").alias("ilabel"), F.col("label").alias("olabel"), F.lit(0.0).alias("w"))
    if mode:
        label = F.lit("sil") if mode == 1 else F.concat(F.lit("@"), F.col("line").cast("string"))
        ends = sizes.crossJoin(F.broadcast(total)).select((F.col("base") + F.col("n")).cast("long").alias("src"), (F.col("total") + 1).cast("long").alias("dst"), label.alias("ilabel"), label.alias("olabel"), F.lit(0.0).alias("w"))
        arcs = arcs.unionByName(ends)
    return arcs, total.select((F.col("total") + 1).cast("long").alias("node"))


def degrees(arcs: DataFrame) -> DataFrame:
    ends = arcs.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(arcs.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def offsets(arcs: DataFrame) -> DataFrame:
    """(node, n_arcs, first): where each node's arcs start when arcs lie in order of their source."""
    n = arcs.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_arcs"))
    return running_sum(n, ["node"], F.col("n_arcs"), "first", before=True)


def reverse(arcs: DataFrame, final: int) -> DataFrame:
    """Ends swapped; node 0 and the only final node change roles."""
    flip = lambda c: F.when(F.col(c) == 0, F.lit(final)).when(F.col(c) == final, F.lit(0)).otherwise(F.col(c)).cast("long")
    return arcs.select(flip("dst").alias("src"), flip("src").alias("dst"), "ilabel", "olabel", "w")


def add_loop(arcs: DataFrame, final: int, penalty: float, back: bool) -> DataFrame:
    """One eps arc from start to final, or back, with a log10 penalty."""
    a, b = (final, 0) if back else (0, final)
    row = arcs.sparkSession.range(1).select(F.lit(a).cast("long").alias("src"), F.lit(b).cast("long").alias("dst"), F.lit(EPS).alias("ilabel"), F.lit(EPS).alias("olabel"), (F.lit(float(penalty)) * F.ln(F.lit(10.0))).alias("w"))
    return arcs.unionByName(row)


def shifted(arcs: DataFrame, by: int) -> DataFrame:
    return arcs.withColumns({"src": (F.col("src") + by).cast("long"), "dst": (F.col("dst") + by).cast("long")})


def stack(graphs: list[tuple[DataFrame, DataFrame, int]]) -> tuple[DataFrame, int]:
    """Graphs (arcs, finals, nodes) side by side: start 0, ``<F>`` connectors, one new final."""
    spark, at, parts = graphs[0][0].sparkSession, 1, []
    final = 1 + sum(n for _, _, n in graphs)
    link = lambda a, b: [F.lit(a).cast("long").alias("src") if isinstance(a, int) else a.cast("long").alias("src"), F.lit(b).cast("long").alias("dst"), F.lit("<F>").alias("ilabel"), F.lit("<F>").alias("olabel"), F.lit(0.0).alias("w")]
    for arcs, finals, n in graphs:
        parts += [shifted(arcs, at), spark.range(1).select(*link(0, at)), finals.select(*link(F.col("node") + at, final))]
        at += n
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, final


def concat(graphs: list[tuple[DataFrame, DataFrame, int]]) -> DataFrame:
    """Graphs in sequence: each final of one graph leads by eps to the start of the next."""
    at, out = 0, None
    for k, (arcs, finals, n) in enumerate(graphs):
        part = shifted(arcs, at)
        if k + 1 < len(graphs):
            part = part.unionByName(finals.select((F.col("node") + at).cast("long").alias("src"), F.lit(at + n).cast("long").alias("dst"), F.lit(EPS).alias("ilabel"), F.lit(EPS).alias("olabel"), F.lit(0.0).alias("w")))
        out, at = part if out is None else out.unionByName(part), at + n
    return out


def reverse_graph(arcs: DataFrame, finals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(arcs, finals) of the reversed graph: ends swapped, start and final change roles; several finals first lead by eps to a new one."""
    ends = [r["node"] for r in finals.select("node").distinct().limit(2).collect()]
    if len(ends) != 1:
        top = arcs.agg(F.max(F.greatest("src", "dst"))).first()[0] or 0
        arcs, ends = funnel(arcs, finals, top + 1), [top + 1]
    return reverse(arcs, ends[0]), arcs.sparkSession.createDataFrame([(ends[0],)], "node long")


def funnel(arcs: DataFrame, finals: DataFrame, to: int) -> DataFrame:
    """Every final node leads by eps to the new node ``to``."""
    links = finals.select(F.col("node").cast("long").alias("src"), F.lit(to).cast("long").alias("dst"), F.lit(EPS).alias("ilabel"), F.lit(EPS).alias("olabel"), F.lit(0.0).alias("w"))
    return arcs.select("src", "dst", "ilabel", "olabel", "w").unionByName(links)


def swap_start(arcs: DataFrame, finals: DataFrame, start: int) -> tuple[DataFrame, DataFrame]:
    """The node start becomes 0, and node 0 takes its number."""
    at = lambda c: F.when(F.col(c) == start, F.lit(0)).when(F.col(c) == 0, F.lit(start)).otherwise(F.col(c)).cast("long")
    return arcs.withColumns({"src": at("src"), "dst": at("dst")}), finals.select(at("node").alias("node"))


def in_source_order(arcs: DataFrame, pos: str = "pos") -> DataFrame:
    """arcs with column place: their order by source, arcs of one source in their old order."""
    return numbered(arcs, ["src", pos], "place")


def counts(arcs: DataFrame, finals: DataFrame) -> DataFrame:
    """One row: max_node, n_arcs, n_finals, n_lines of the text form."""
    a = arcs.agg(F.max(F.greatest("src", "dst")).alias("max_node"), F.count("*").alias("n_arcs"))
    f = finals.agg(F.max("node").alias("_f"), F.count("*").alias("n_finals"))
    both = a.crossJoin(f)  # a row on each side
    return both.select(F.greatest("max_node", "_f").alias("max_node"), "n_arcs", "n_finals", (F.col("n_arcs") + F.col("n_finals")).alias("n_lines"))


def best_leaving(arcs: DataFrame) -> DataFrame:
    """(node, best): the largest weight of the arcs that leave each node."""
    return arcs.groupBy(F.col("src").alias("node")).agg(F.max("w").alias("best"))


def branches(arcs: DataFrame) -> DataFrame:
    """arcs with column b: the place of an arc among those of its source, by target and labels.

    All arcs are numbered in ranges, so a node of many arcs (the start has one for each sentence) is not one task.
    """
    placed = numbered(arcs, ["src", "dst", "ilabel", "olabel", "w"], "_n")
    first = placed.groupBy("src").agg(F.min("_n").alias("_f"))
    return placed.join(first, "src").withColumn("b", (F.col("_n") - F.col("_f")).cast("int")).drop("_n", "_f")


def closure(arcs: DataFrame, finals: DataFrame | None = None, depth: int = 30, most: int = 30_000, longest: int | None = None) -> DataFrame:
    """(node, stop, w, depth, path): all paths of eps arcs to nodes with another arc; path holds branches where arcs have a column b.

    Paths that end at a final node go.  Paths double: those of up to 2k arcs are those of up to k and those of exactly k with one of
    up to k behind, so paths of n arcs take log n rounds.  Eps arcs in a circle, which show by a path longer than depth, and
    nodes with more than most paths are errors, as nothing may be cut short.  longest: paths of more arcs, which a compiled table has no
    room for, are an error too.
    """
    branch = (F.col("b") if "b" in arcs.columns else F.lit(None)).cast("int")
    folder = Folder(arcs.sparkSession, "closure")
    eps = arcs.where(F.col("ilabel") == EPS)
    step = folder.keep(eps.select(F.col("src").alias("node"), F.col("dst").alias("stop"), F.col("w").cast("double").alias("w"), F.array(branch).alias("path")), "1")
    every, exact, k, last = step, step, 1, step.isEmpty()

    def behind(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select(F.col("node").alias("stop"), F.col("stop").alias("_s"), F.col("w").alias("_w"), F.col("path").alias("_p"))
        return a.join(b, "stop").select("node", F.col("_s").alias("stop"), (F.col("w") + F.col("_w")).alias("w"), F.concat("path", "_p").alias("path"))

    while not last:
        longer = folder.keep(behind(exact, every), f"{2 * k}")  # of k + 1 .. 2k arcs
        top = longer.agg(F.max(F.size("path"))).first()[0] or 0
        if top > depth:
            raise ValueError(f"eps arcs go {depth} deep, or in a circle")
        every, exact, last = every.unionByName(longer), longer.where(F.size("path") == 2 * k), top < 2 * k
        k *= 2
    several = every.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > most)
    if not several.isEmpty():
        raise ValueError(f"a node has more than {most} eps paths")
    out = every.withColumn("depth", F.size("path")).join(arcs.where(F.col("ilabel") != EPS).select(F.col("src").alias("stop")).distinct(), "stop", "left_semi")
    if finals is not None:
        out = out.join(finals.select(F.col("node").alias("stop")), "stop", "left_anti")
    if longest is not None and not out.where(F.col("depth") > longest).isEmpty():
        raise ValueError(f"a path has more than {longest} arcs")
    return out.select("node", "stop", "w", "depth", "path")


def triphones(arcs: DataFrame) -> DataFrame:
    """Labels ``L-C+R`` of every label into an arc's source and out of its end, on the nodes as they are.

    Two arcs of a path may then disagree on their contexts; ``expand_contexts`` splits the nodes.
    """
    left = arcs.select(F.col("dst").alias("src"), F.col("ilabel").alias("l")).distinct()
    right = arcs.select(F.col("src").alias("dst"), F.col("ilabel").alias("r")).distinct()
    both = arcs.join(left, "src", "left").join(right, "dst", "left")
    return both.select("src", "dst", F.format_string("%s-%s+%s", F.coalesce("l", F.lit(EPS)), "ilabel", F.coalesce("r", F.lit(EPS))).alias("label"), "olabel", "w")


def expand_contexts(arcs: DataFrame, finals: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(arcs, finals, symbols) with labels ``L-C+R`` whose contexts agree along every path.

    A node is split by (node, label before, arc behind): an arc C enters the copy that names C and leaves from the one that
    names it.  Nodes are strings.  Copies of a start without arcs into it are one node "0"; otherwise "0" leads to its copies
    by eps.  Every copy of a final is final.  An arc into a node without arcs has <eps> on its right.
    """
    named = branches(arcs)
    behind = named.select(F.col("src").alias("dst"), F.col("ilabel").alias("r"), F.col("b").alias("rb"))
    before = named.select(F.col("dst").alias("src"), F.col("ilabel").alias("l")).distinct()
    entered = not arcs.where("dst = 0").isEmpty()
    wide = named.join(before, "src", "left").join(behind, "dst", "left")
    left, right = F.coalesce("l", F.lit(EPS)), F.coalesce("r", F.lit(EPS))
    copy = lambda node, label, b: F.concat_ws("|", node, label, F.coalesce(b.cast("string"), F.lit("end")))
    src, dst = copy(F.col("src"), left, F.col("b")), copy(F.col("dst"), F.col("ilabel"), F.col("rb"))
    start = F.when(F.col("src") == 0, F.lit("0")).otherwise(src) if not entered else src
    out = wide.select(start.alias("src"), dst.alias("dst"), F.format_string("%s-%s+%s", left, "ilabel", right).alias("ilabel"), "olabel", F.col("w").cast("double").alias("w"))
    if entered:
        copies = wide.where("src = 0").select(src.alias("dst")).distinct()
        out = out.unionByName(copies.select(F.lit("0").alias("src"), "dst", F.lit(EPS).alias("ilabel"), F.lit(EPS).alias("olabel"), F.lit(0.0).alias("w")))
    ends = wide.join(finals.select(F.col("node").alias("dst")), "dst", "left_semi").select(dst.alias("node")).distinct()
    symbols = out.select(F.col("ilabel").alias("sym")).distinct()
    return out, ends, symbols


def encodings(arcs: DataFrame) -> DataFrame:
    """(ilabel, olabel, w6, code): the distinct triples of labels and weight to six decimals, numbered in order."""
    kinds = arcs.select("ilabel", "olabel", F.format_string("%.6f", F.col("w").cast("double")).alias("w6")).distinct()
    return numbered(kinds, ["ilabel", "olabel", "w6"], "code")


def arc_tree(arcs: DataFrame, folder: Folder) -> DataFrame | None:
    """arcs (src, dst, ilabel, olabel, w6) with id, up (the arc into their source, null at the start) and ends (nothing leaves their target); None if an
    inner node has several arcs into it, or the start has one."""
    nodes = arcs.groupBy(F.col("src").alias("node")).agg(F.lit(True).alias("_goes"))
    into = arcs.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("_n")).join(nodes, "node")
    if not into.where("_n > 1 or node = 0").isEmpty():
        return None
    rows = folder.keep(arcs.withColumn("id", F.monotonically_increasing_id()), "arcs")
    leads = nodes.select(F.col("node").alias("dst"), F.lit(False).alias("ends"))
    rows = rows.join(leads, "dst", "left").withColumn("ends", F.coalesce("ends", F.lit(True)))
    up = rows.where("not ends").select(F.col("dst").alias("src"), F.col("id").alias("up"))
    return folder.keep(rows.join(up, "src", "left"), "tree")


def down_the_tree(tree: DataFrame, folder: Folder, first: dict[str, Column], both, name: str) -> DataFrame:
    """(id, columns of first): what a fold over all arcs from the start to each arc gives; both(column, before, behind) joins two stretches.

    Stretches double in each round, so a path of n arcs takes log n rounds.  Equal paths are folded in the same order.
    """
    at, k = folder.keep(tree.select("id", "up", *[c.alias(x) for x, c in first.items()]), f"{name}0"), 0
    while not at.where("up is not null").isEmpty():
        above = at.select(F.col("id").alias("up"), F.col("up").alias("_up"), *[F.col(x).alias(f"_{x}") for x in first])
        joined = at.join(above, "up", "left")
        merged = [F.when(F.col("up").isNull(), F.col(x)).otherwise(both(x, F.col(f"_{x}"), F.col(x))).alias(x) for x in first]
        at = folder.keep(joined.select("id", F.col("_up").alias("up"), *merged), f"{name}{k + 1}")
        folder.drop(f"{name}{k}")
        k += 1
    return at.drop("up")


def factor_tree(tree: DataFrame, finals: DataFrame, folder: Folder) -> tuple[DataFrame, DataFrame]:
    """``factor`` of a tree whose leaves may be shared: nodes at the end of equal labels are one set, and a set of leaves alone is
    named by them."""
    label = lambda seed: F.xxhash64("ilabel", "olabel", "w6", F.lit(seed))
    named = down_the_tree(tree, folder, {"a": label(1), "b": label(2)}, lambda x, before, behind: F.xxhash64(before, behind, F.lit(x)), "path")
    rows = tree.join(named, "id")
    leaf = F.when(F.col("ends"), F.col("dst"))
    leaves = rows.where("ends").select("a", "b", "dst").distinct().groupBy("a", "b").agg(F.concat_ws(":", F.lit("leaf"), F.count("*"), F.bit_xor(F.xxhash64("dst"))).alias("_leaf"))
    inner = rows.groupBy("a", "b").agg(F.count_if(leaf.isNull()).alias("_inner"))
    sets = inner.join(leaves, ["a", "b"], "left").select("a", "b", F.when(F.col("_inner") > 0, F.concat_ws(":", "a", "b")).otherwise(F.col("_leaf")).alias("to"))
    rows = folder.keep(rows.join(sets, ["a", "b"]), "sets")
    above = rows.select(F.col("id").alias("up"), F.col("to").alias("_from"))
    arcs = rows.join(above, "up", "left").select(F.coalesce("_from", F.lit("0")).alias("src"), F.col("to").alias("dst"), "ilabel", "olabel", F.col("w6").alias("w")).distinct()
    ends = rows.join(finals.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("to").alias("node"))
    start = finals.where("node = 0").select(F.lit("0").alias("node"))
    return arcs, ends.unionByName(start).distinct()


def factor(arcs: DataFrame, finals: DataFrame, once: bool = False) -> tuple[DataFrame, DataFrame]:
    """(arcs, finals) in which arcs with equal labels and weights (to six decimals) out of a node are one, and their targets one node.

    Trees, which sentences are, are factored by their paths (``factor_tree``, log n rounds); other graphs take a round for each arc of depth.
    A new node stands for a set of old ones and is named by a hash; the start is "0".  once: only arcs whose
    targets have one arc into them are joined, as merging from the far side of a reversed graph needs.  Sets stay rows, one a
    member, so none is gathered; each round goes one arc deeper.
    """
    spark = arcs.sparkSession
    label = ["ilabel", "olabel", "w6", "alone"]
    base = arcs.select("src", "dst", "ilabel", "olabel", F.round("w", 6).cast("double").alias("w6"))
    if once:
        many = arcs.groupBy("dst").agg(F.count("*").alias("n")).where("n > 1").select("dst", F.col("dst").alias("alone"))
        base = base.join(many, "dst", "left")
    else:
        base = base.withColumn("alone", F.lit(None).cast("long"))
    base = cut(base)
    if not once:
        folder = Folder(spark, "factor")
        tree = arc_tree(base.drop("alone"), folder)
        if tree is not None:
            return factor_tree(tree, finals, folder)
    name_of = lambda *c: F.concat_ws(":", F.count("*"), F.bit_xor(F.xxhash64(*c)))
    members = cut(spark.range(1).select(F.lit("0").alias("name"), F.lit(0).cast("long").alias("node")))
    seen, parts, ends = members.select("name"), [], []
    while not members.isEmpty():
        ends.append(members.join(finals.select("node"), "node", "left_semi").select("name").distinct())
        wide = cut(members.join(base, members["node"] == base["src"]).select("name", *label, "dst").distinct())
        to = cut(wide.groupBy("name", *label).agg(name_of("dst").alias("to")))
        parts.append(to.select("name", "to", "ilabel", "olabel", F.col("w6").alias("w")))
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("name", *label)]
        nxt = wide.alias("a").join(to.alias("b"), same).select(F.col("b.to").alias("name"), F.col("a.dst").alias("node")).distinct()
        members = cut(nxt.join(seen, "name", "left_anti"))
        seen = cut(seen.unionByName(members.select("name").distinct()))
    out, last = parts[0], ends[0]
    for p, e in zip(parts[1:], ends[1:], strict=True):
        out, last = out.unionByName(p), last.unionByName(e)
    return out.select(F.col("name").alias("src"), F.col("to").alias("dst"), "ilabel", "olabel", "w").distinct(), last.select(F.col("name").alias("node")).distinct()


def merge_tails(arcs: DataFrame, finals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(arcs, finals): equal paths into the end share their arcs: reversed, factored where targets have one arc into them, reversed."""
    back, _ = reverse_graph(arcs, finals)
    top = back.agg(F.max(F.greatest("src", "dst")).alias("m")).first()["m"]
    out, ends = factor(back, arcs.sparkSession.createDataFrame([(_one(finals, arcs),)], "node long"), once=True)
    names = out.select(F.col("src").alias("node")).union(out.select("dst")).distinct()
    number = numbered(names.where("node <> '0'"), ["node"], "n").select("node", (F.col("n") + 1 + F.lit(top)).alias("n")).unionByName(arcs.sparkSession.createDataFrame([("0", 0)], "node string, n long"))
    at = lambda c: number.select(F.col("node").alias(c), F.col("n").alias(f"_{c}"))
    plain = out.join(at("src"), "src").join(at("dst"), "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), "ilabel", "olabel", "w")
    return reverse_graph(plain, ends.join(number, "node").select(F.col("n").alias("node")))


def _one(finals: DataFrame, arcs: DataFrame) -> int:
    """The node that is final after reversing: that which took the start's part."""
    ends = [r["node"] for r in finals.select("node").distinct().limit(2).collect()]
    return ends[0] if len(ends) == 1 else (arcs.agg(F.max(F.greatest("src", "dst"))).first()[0] or 0) + 1


def prefix_tree(sentences: DataFrame) -> DataFrame:
    """(depth, prefix, n): shared prefixes of sentences (tokens), which left factoring merges into one node each."""
    rows = sentences.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("tokens")), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice("tokens", F.lit(1), k), " ").alias("prefix")))).alias("x"))
    return rows.groupBy("x.depth", "x.prefix").agg(F.count("*").alias("n"))
