"""Operator 1, n-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of distinct word shingles; two link when their Jaccard similarity is at
least THRESHOLD.  Only what is needed to know all components is verified:

1. Documents with equal sets become one representative (by a 128-bit hash of the set).
2. All shingles have one order: light ones by hash, then heavy ones (in the prefixes of HEAVY
   or more representatives), rarest first.  A document of n shingles shares l of its first
   p + l - 1, p = n - ceil(t n) + 1, with every document it links with.  Each document chooses
   its own l, up to LENGTHEN, by estimated cost: the entries of the lists that its prefix
   meets, once for reading them, and VERIFY times their number divided by l for verifying the
   candidates that share so many.  A pair must share the smaller l of the two.
3. Every document with enough shared shingles is verified against the member it shares most
   with among the smallest members of its shingles' lists.  This contracts groups of near
   copies along stars.
4. Lists that still hold several components are worked off: short ones by their pairs
   across components, long ones in blocks of members inside tasks, where only documents
   outside the list's largest component are held, with an index of their prefixes.  A block
   joins components as it finds them, so it compares no pair inside one and gives a link
   only where two components meet; no list is capped.

The estimates of cost, and which shingles count as heavy, never change the result; at most
HEAVY_MOST heavy ones (the most frequent) are sent to the executors.

Defined cases: null and empty texts have no shingles and link with nothing; texts of fewer
words than WORDS have one shingle; very long texts have all of theirs; rows that share an id
are one document whose links are those of all its rows; rows with a null id get a null
component; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.llm.common import Scratch, Words, arrow, documents, fresh, mix, rows_of
from lattiq.llm.components import components
from lattiq.llm.exact_dedup import sized

WORDS = 5
#: Jaccard threshold as a fraction: numerator, denominator.
THRESHOLD = (4, 5)
HEAVY = 48
HEAVY_MOST = 1_000_000
#: Shared shingles that a document may ask for, and the cost of verifying a pair, in list entries read.
LENGTHEN = 4
VERIFY = 20
#: Lists up to this length are worked off by pairs, longer ones in blocks of members with
#: about BLOCK_SHINGLES shingles in all.
PAIRS = 64
BLOCK_SHINGLES = 1_000_000
#: Requests for texts up to this number are broadcast to the scan; more are joined by a shuffle.
BROADCAST_ROWS = 400_000
HUB_ROWS = 200


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted hashes of the distinct shingles of a text."""
    w = Words(text, lower=True)
    if not w.n:
        return np.zeros(0, np.int64)
    k = min(words, w.n)
    return np.unique(w.grams(k))


def prefix_length(n: int) -> int:
    t, u = THRESHOLD
    return n - -(-t * n // u) + 1


def lengthening(p: int, counts: np.ndarray) -> int:
    """The shared shingles l to ask for that cost least; counts: list entries of the first shingles in order, p of them at least."""
    most = min(LENGTHEN, len(counts) - p + 1)
    read = np.cumsum(counts)[p - 1 : p - 1 + most]
    return 1 + int(np.argmin(read * (1 + VERIFY / np.arange(1, most + 1))))


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    t, u = THRESHOLD
    if u * min(len(x), len(y)) < t * max(len(x), len(y)):
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return u * both >= t * (len(x) + len(y) - both)


def describe(docs: DataFrame) -> DataFrame:
    """(id, n, hi, lo, prefix) of each text: size, hash and first shingles in hash order, as many as the longest prefix has."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("prefix", pa.list_(pa.int64()))])

    def run(batches):
        for rows in rows_of(batches, "id", "text"):
            out = []
            for key, text in rows:
                s = shingles(text)
                v = s.view(np.uint64)
                hi, lo = int(mix(v).sum(dtype=np.uint64)), int(mix(v ^ np.uint64(0xA24BAED4963EE407)).sum(dtype=np.uint64))
                as_long = lambda x: x - (1 << 64) if x >> 63 else x
                out.append((key, len(s), as_long(hi), as_long(lo), s[: prefix_length(len(s)) + LENGTHEN - 1] if len(s) and key is not None else []))
            yield arrow(schema, out)

    return docs.mapInArrow(run, "id long, n long, hi long, lo long, prefix array<long>")


def heavy_shingles(lists: DataFrame, scratch: Scratch) -> tuple[np.ndarray, np.ndarray, float]:
    """Heavy shingles, sorted, their counts, and the mean length of the list of another one."""
    counts = lists.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    counts = scratch.keep(counts, "counts")
    usual = counts.where(F.col("c") < HEAVY).agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum(F.col("c") * F.col("c")), F.lit(0))).first()
    entries = (lists.agg(F.sum(F.size("prefix"))).first()[0] or 0) - (counts.agg(F.sum("c")).first()[0] or 0)  # in lists of one
    mean = (usual[1] + entries) / max(1, usual[0] + entries)
    counts = counts.where(F.col("c") >= HEAVY)
    top = counts.orderBy(F.desc("c"), "token").limit(HEAVY_MOST).toArrow()
    token, c = top["token"].to_numpy(), top["c"].to_numpy()
    order = np.argsort(token)
    scratch.drop("counts")
    return token[order], c[order], max(1.0, mean)


def is_in(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The place of each x among sorted values, -1 for none."""
    if not len(sorted_values):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return np.where(sorted_values[at] == x, at, -1)


def with_text(requests: DataFrame, docs: DataFrame) -> DataFrame:
    """Requests (column id and others) with the texts of their documents."""
    small = requests.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(requests) if small else requests, "id")


POST = pa.schema([("token", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("need", pa.int32())])


def postings(lists: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(token, id, n, need): the adaptive prefixes of all representatives."""
    heavy = lists.sparkSession.sparkContext.broadcast(heavy_shingles(lists, scratch))

    def posted(found: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
        size = [len(x[3]) for x in found]
        spread = lambda k, t: pa.array(np.repeat(np.array([x[k] for x in found], t), size))
        tokens = np.concatenate([x[3] for x in found]) if found else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(tokens), spread(0, np.int64), spread(1, np.int64), spread(2, np.int32)], schema=POST)

    def light(batches):
        tokens, _, usual = heavy.value
        for rows in rows_of(batches, "id", "n", "prefix"):
            out = []
            for key, n, prefix in rows:
                s = np.array(prefix, np.int64)
                if (is_in(tokens, s) < 0).all():
                    p = prefix_length(n)
                    need = lengthening(p, np.full(len(s), usual))
                    out.append((key, n, need, s[: p + need - 1]))
            yield posted(out)

    def costly(batches):
        tokens = heavy.value[0]
        for rows in rows_of(batches, "id", "prefix"):
            yield arrow(pa.schema([("id", pa.int64())]), [(x[0],) for x in rows if (is_in(tokens, np.array(x[1], np.int64)) >= 0).any()])

    def lengthened(batches):
        tokens, counts, usual = heavy.value
        for rows in rows_of(batches, "id", "text"):
            for key, text in rows:
                s = shingles(text)
                n, p = len(s), prefix_length(len(s))
                at = is_in(tokens, s)
                free, costs, c = s[at < 0], s[at >= 0], counts[at[at >= 0]]
                order = np.argsort(c, kind="stable")
                first = np.concatenate([free, costs[order]])[: p + LENGTHEN - 1]
                need = lengthening(p, np.concatenate([np.full(len(free), usual), c[order]])[: len(first)])
                yield posted([(key, n, need, first[: p + need - 1])])

    kind = "token long, id long, n long, need int"
    todo = scratch.keep(lists.select("id", "prefix").mapInArrow(costly, "id long"), "costly")
    more = with_text(todo, docs).select("id", "text").mapInArrow(lengthened, kind)
    return lists.select("id", "n", "prefix").mapInArrow(light, kind).unionByName(more)


def verify(pairs: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that link.  The texts of a's partners meet a's text, HUB_ROWS or so at a time."""
    spread = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_ROWS).cast("int").alias("k"))
    others = pairs.join(spread, "a").select("a", F.pmod(F.xxhash64("b"), F.col("k")).cast("int").alias("part"), F.col("b").alias("id"), F.lit(False).alias("hub"))
    hubs = others.select("a", "part").distinct().select("a", "part", F.col("a").alias("id"), F.lit(True).alias("hub"))
    requests = others.unionByName(hubs)
    rows = with_text(scratch.keep(requests, "requests"), docs).select("a", "part", "hub", "id", "text")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        group, sets = None, []
        for rows in rows_of(batches, "a", "part", "hub", "id", "text"):
            out = []
            for a, part, hub, key, text in rows:
                if (a, part) != group:
                    group, sets = (a, part), []
                s = shingles(text)
                if hub:
                    sets.append(s)
                elif len(s) and any(len(x) and linked(x, s) for x in sets):
                    out.append((a, key))
            yield arrow(schema, out)

    return rows.repartition("a", "part").sortWithinPartitions("a", "part", F.desc("hub")).mapInArrow(run, "a long, b long")


class Held:
    """Documents held in a block: an index of their prefixes, and components that join as links are found.

    Prefixes are in hash order here, which serves as well as any order that is the same for all.
    """

    def __init__(self, group: list[tuple], main: int) -> None:
        self.sets = [shingles(g[3]) for g in group]
        self.ids, self.need = [g[0] for g in group], np.array([g[2] for g in group])
        names = {comp: i for i, comp in enumerate(dict.fromkeys([main, *(g[1] for g in group)]))}
        self.name, self.up = names, list(range(len(names)))
        self.comp = [names[g[1]] for g in group]
        first = [self.prefix(s, need) for s, need in zip(self.sets, self.need, strict=True)]
        both = np.concatenate(first)
        order = np.argsort(both, kind="stable")
        self.token, self.owner = both[order], np.repeat(np.arange(len(first)), list(map(len, first)))[order]

    @staticmethod
    def prefix(s: np.ndarray, need: int) -> np.ndarray:
        return s[: prefix_length(len(s)) + need - 1]

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def links(self, key: int, comp: int, need: int, text: str) -> list[tuple[int, int]]:
        """Links of a passing document, one for each other component that it joins."""
        s = shingles(text)
        p = self.prefix(s, need)
        lo, hi = np.searchsorted(self.token, p), np.searchsorted(self.token, p, side="right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        shared = np.bincount(self.owner[at], minlength=len(self.sets))
        mine, out = self.name.get(comp), []
        for i in np.flatnonzero(shared >= np.minimum(self.need, need)):
            other = self.root(self.comp[i])
            if (mine is None or self.root(mine) != other) and self.ids[i] != key and linked(s, self.sets[i]):
                out.append((key, self.ids[i]))
                if mine is not None:
                    self.up[other] = self.root(mine)
                mine = other if mine is None else mine  # a component without held members counts while its document passes
        return out


def long_lists(members: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Links across components among members (token, id, n, need, comp) of long lists.

    Only members outside a list's largest component need a comparison.  They are held in
    blocks of bounded shingles, with an index of prefixes, and all members of the list pass by.  Lists
    with the same largest component often have the same members (one group of near copies
    has a list for each shingle it shares), so they are worked off as one list where that
    makes fewer rows pass by than each list by itself.
    """
    rounds = lambda held: F.ceil(held / BLOCK_SHINGLES).cast("long")
    largest = members.groupBy("token", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("n")).groupBy("token")
    largest = largest.agg(F.max(F.struct("c", "comp", "n")).alias("m"), F.sum("c").alias("k"), F.sum("n").alias("n"))
    largest = scratch.keep(largest.select("token", F.col("m.comp").alias("main"), "k", rounds(F.col("n") - F.col("m.n")).alias("own")), "largest")
    apart = largest.groupBy("main").agg(F.sum(F.col("k") * F.col("own")).alias("apart"))
    union = members.join(largest.select("token", "main"), "token").select("main", "id", "n", "comp").distinct()
    union = union.groupBy("main").agg(F.count("*").alias("k"), F.sum(F.when(F.col("comp") != F.col("main"), F.col("n"))).alias("held"))
    merged = apart.join(union, "main").select("main", rounds(F.col("held")).alias("all"), (F.col("k") * rounds(F.col("held")) < F.col("apart")).alias("merge"))
    lists = scratch.keep(largest.join(merged, "main").select("token", "main", F.when(F.col("merge"), F.lit(None)).otherwise(F.col("token")).alias("list"), F.when(F.col("merge"), F.col("all")).otherwise(F.col("own")).cast("int").alias("blocks")), "blocks")
    own = members.join(lists, "token").groupBy("list", "main", "blocks", "id", "comp").agg(F.min("need").alias("need"))
    few = own.where("comp <> main").select("list", "main", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.lit(True).alias("held"), "id", "comp", "need")
    everyone = own.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("list", "main", "block", F.lit(False).alias("held"), "id", "comp", "need")
    rows = with_text(scratch.keep(few.unionByName(everyone), "dealt"), docs).select("list", "main", "block", "held", "id", "comp", "need", "text")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        name, waiting, held = None, [], None
        for rows in rows_of(batches, "list", "main", "block", "held", "id", "comp", "need", "text"):
            out = []
            for *key_of, mine, key, comp, need, text in rows:
                if key_of != name:
                    name, waiting, held = key_of, [], None
                if mine:
                    waiting.append((key, comp, need, text))
                    continue
                if waiting:  # members are dealt by hash, and a block may get none
                    held = held or Held(waiting, name[1])
                    out += held.links(key, comp, need, text)
            yield arrow(schema, out)

    return rows.repartition("list", "main", "block").sortWithinPartitions("list", "main", "block", F.desc("held")).mapInArrow(run, "a long, b long")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id."""
    scratch = Scratch(docs.sparkSession, "join")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    meta = scratch.keep(describe(texts), "meta")
    texts = texts.where("id is not null and text is not null")
    some = meta.where("n > 0 and id is not null")
    sets = scratch.keep(some.groupBy("hi", "lo", "n").agg(F.min("id").alias("rep")), "sets")
    member = scratch.keep(some.select("hi", "lo", "n", "id").join(sets, ["hi", "lo", "n"]).select("id", "rep").distinct(), "member")
    # an id with several texts may stand for several sets; each of them keeps its prefix
    lists = scratch.keep(some.join(sets.select("hi", "lo", "n", F.col("rep").alias("id")), ["hi", "lo", "n", "id"], "left_semi").select("id", "n", "prefix").distinct(), "lists")
    posts = scratch.keep(postings(lists, texts, scratch), "all-posts")
    scratch.drop("lists")
    seen = posts.groupBy("token").agg(F.count("*").alias("k"), F.min(F.struct("id", "need")).alias("m")).where("k > 1").select("token", "k", F.col("m.id").alias("hub"), F.col("m.need").alias("asked"))
    posts = scratch.keep(posts.join(seen, "token"), "posts")
    scratch.drop("all-posts")

    stars = posts.where("id <> hub").groupBy("id", "hub").agg(F.count("*").alias("shared"), F.min(F.least("need", "asked")).alias("need"))
    stars = stars.where("shared >= need").groupBy("id").agg(F.max(F.struct("shared", (-F.col("hub")).alias("hub"))).alias("m"))
    stars = scratch.keep(stars.select((-F.col("m.hub")).alias("a"), F.col("id").alias("b")), "stars")
    found = scratch.keep(verify(stars, texts, scratch), "found")
    scratch.drop("stars", "requests")
    comps = components(found, scratch, "comps")

    at = scratch.keep(posts.drop("hub", "asked").join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component"), "at")
    several = at.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
    rest = scratch.keep(at.join(several, "token"), "rest")
    scratch.drop("at", "posts")
    short, long_ = rest.where(F.col("k") <= PAIRS), rest.where(F.col("k") > PAIRS)
    t, u = THRESHOLD
    x, y = short.alias("x"), short.alias("y")
    fits = F.col("x.n") * u >= F.col("y.n") * t
    fits = fits & (F.col("y.n") * u >= F.col("x.n") * t)
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.comp") != F.col("y.comp")) & fits)
    # a link shares need shingles of the two prefixes at least; if some of them are in long lists, the blocks compare the pair
    # the prefix that ends first in the order of all shingles has all it shares with the other set among the shared ones;
    # so the intersection is at most these and what lies behind that prefix
    behind = lambda n, need: F.greatest(F.lit(0), F.ceil(n * t / u) - need)
    shared = pairs.groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.n").alias("n"), F.col("y.n").alias("m"), F.col("x.need").alias("need"), F.col("y.need").alias("needs")).agg(F.count("*").alias("shared"))
    most = F.col("shared") + F.greatest(behind(F.col("n"), F.col("need")), behind(F.col("m"), F.col("needs")))
    enough = (F.col("shared") >= F.least("need", "needs")) & (most * (t + u) >= (F.col("n") + F.col("m")) * t)
    pairs = scratch.keep(shared.where(enough).select("a", "b").distinct(), "pairs")
    more = scratch.keep(verify(pairs, texts, scratch).unionByName(long_lists(long_.select("token", "id", "n", "need", "comp"), texts, scratch)), "more")
    scratch.drop("rest", "pairs", "requests", "largest", "blocks", "dealt")
    all_ = components(found.unionByName(more), scratch, "all")
    of_rep = member.join(all_.withColumnRenamed("node", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))
    of_id = of_rep.groupBy("id").agg(F.min("component").alias("component"))
    of_id = scratch.keep(of_id, "of_id")
    scratch.drop("sets", "member", "found", "more", "costly", *(f"{k}-{i}" for k in ("comps", "all") for i in ("roots",)), "comps", "all")
    out = meta.select("id", "n").join(of_id, "id", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with one row of each component of near copies, that with the smallest id; all columns stay.

    Rows have keys of their own: ids may repeat and be null (null counts as the largest), and
    columns have any names.  Rows without words all stay.
    """
    scratch = Scratch(docs.sparkSession, "gone")
    row, of = fresh(docs, "_row", "_of")
    keyed = scratch.keep(docs.withColumn(row, F.monotonically_increasing_id()), "keyed", "zstd")
    groups = near_components(keyed, row, text_col).select(row, F.col("component_id").alias(of))
    several = scratch.keep(groups.groupBy(of).agg(F.count("*").alias("k")).where("k > 1").select(of), "several")
    members = scratch.keep(groups.join(sized(several), of).join(keyed.select(row, F.col(id_col).alias("_id")), row), "members")
    best = members.groupBy(of).agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", row)).alias("best")).select(F.col("best")[row].alias(row))
    gone = scratch.keep(members.select(row).join(best, row, "left_anti"), "gone")
    return keyed.join(sized(gone), row, "left_anti").select(*docs.columns)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(documents(spark, sf_dir))


#: The words of each text as a list w.
WORDS_SQL = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS_SQL.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 100 * k >= 80 * (u.n + v.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) USING (doc_id)
"""
