"""Operator 2, exact dedup by progressive refinement: length, prefix hash, full hash.

DataFrame functions only.  Rows pass three ever finer keys.  The first two need the length
and a short prefix of a text; the full text is hashed for the dedup only in groups that
both of them leave with more than one row.

Defined cases: a null text counts as empty, and all empty texts are one group; of equal
texts the row with the largest id stays; rows that repeat one id are all marked as that
id is; rows with a null id never stay while a row with an id has the same text; an empty
table gives an empty result; other columns are neither read nor returned.  Very long texts
are hashed whole.  ``drop_copies`` keeps one row of each text whatever the ids and the names
of other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.llm.common import Scratch, documents, fresh, join_hot, lower_az

PREFIX_CHARS = 64
#: Above this many rows a key table is joined by a shuffle and not by a broadcast.
BROADCAST_ROWS = 200_000


def sized(df: DataFrame) -> DataFrame:
    """Mark a materialised table for broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normal: Column | None = None, scratch: Scratch | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 of the normalised text."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "exact")
    text = lower_az(F.col(text_col)) if normal is None else normal
    head = lower_az(F.substring(F.coalesce(F.col(text_col), F.lit("")), 1, PREFIX_CHARS)) if normal is None else F.substring(normal, 1, PREFIX_CHARS)
    length = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) if normal is None else F.octet_length(normal)
    keyed = docs.select(F.col(id_col).alias("_id"), length.alias("_len"), F.xxhash64(head).alias("_head"), text.alias("_text"))

    # one partial aggregate serves both cheap keys: a length of one row has one prefix
    cheap = scratch.keep(keyed.groupBy("_len", "_head").agg(F.count("*").alias("_n")), "cheap")
    lengths = cheap.groupBy("_len").agg(F.sum("_n").alias("_of_len")).where("_of_len > 1")
    heads = scratch.keep(cheap.where("_n > 1").join(lengths, "_len", "left_semi").select("_len", "_head", F.lit(True).alias("_open")), "heads")
    members = keyed.join(sized(heads), ["_len", "_head"], "left").withColumn("_full", F.when(F.col("_open"), F.sha2("_text", 256)))
    # the digest of a row that is alone is for the report; the dedup does not use it
    rows = scratch.keep(members.select("_id", "_full", F.coalesce("_full", F.sha2("_text", 256)).alias("text_sha256")), "rows")
    groups = rows.where("_full is not null").groupBy("_full").agg(F.max("_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = scratch.keep(groups.withColumn("_n", F.col("group_size")), "groups")
    several = join_hot(rows.where("_full is not null"), groups, ["_full"], "_n")
    alone = rows.where("_full is null").withColumns({"keep_id": F.col("_id"), "group_size": F.lit(1).cast("long")})
    both = several.unionByName(alone)
    return both.select(F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each text, with all its columns: that with the largest id, and one of them if it is repeated or all are null."""
    scratch = Scratch(docs.sparkSession, "gone")
    row, key = fresh(docs, "_row", "_key")
    # written once, so that the key of a row is the same for all that read it
    keyed = scratch.keep(docs.withColumn(row, F.monotonically_increasing_id()), "keyed", "zstd")
    groups = exact_groups(keyed.withColumn(key, F.struct(F.col(id_col).alias("id"), F.col(row).alias("row"))), key, text_col)
    gone = scratch.keep(groups.where("not kept").select(F.col(key)["row"].alias(row)), "gone")
    return keyed.join(sized(gone), row, "left_anti").select(*docs.columns)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW g AS (PARTITION BY t)
"""
