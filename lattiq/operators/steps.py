"""Shared means of operators: numbering without a single task, tables that cut lineage, walks by doubling."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Folder:
    """Tables in the folder that driver and executors share; deleted one by one, the rest with the driver."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="lattiq-")  # one machine, one process, as in tests
            spark.conf.set("spark.checkpoint.dir", root)
        self.spark, self.path = spark, f"{root.rstrip('/')}/lattiq-{label}-{uuid.uuid4().hex}"
        self._file(self.path).deleteOnExit(self._at(self.path))

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _file(self, path: str):
        return self._at(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        """df, written and read again; by: columns that its folders are named by."""
        w = df.write.mode("overwrite")
        (w.partitionBy(*by) if by else w).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self._file(self.path).delete(self._at(f"{self.path}/{name}"), True)


_folders: dict[str, tuple[Folder, count]] = {}


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the session's folder, so that long chains of steps keep a short lineage; it goes with the driver."""
    spark = df.sparkSession
    key = spark.sparkContext.applicationId
    if key not in _folders:
        _folders[key] = Folder(spark, "steps"), count()
    folder, number = _folders[key]
    folder.spark = spark
    return folder.keep(df, str(next(number)))


@contextmanager
def transient_shuffles(spark: SparkSession):
    """Within it the shuffle files of a table that is written go when it is."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def order_columns(order: list[str]) -> list[Column]:
    """Columns of an order such as ``["n desc", "path"]``."""
    return [F.desc(c[:-5]) if c.endswith(" desc") else F.col(c).asc() for c in order]


def laid_out(df: DataFrame, order: list[str]) -> DataFrame:
    """df in range partitions of the order, with column _p; written once, as the place of a row must not change."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cut(df.repartitionByRange(n, *order_columns(order)).withColumn("_p", F.spark_partition_id()))


def running_sum(df: DataFrame, order: list[str], value: Column, name: str, before: bool = False) -> DataFrame:
    """df with the sum of value over all rows up to this one in the order (or before it).

    Each partition sums its own rows; only one row a partition meets the others.
    """
    rows = laid_out(df.withColumn("_v", value.cast("long")), order)
    window = Window.partitionBy("_p").orderBy(*order_columns(order)).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    local = rows.withColumn("_s", F.coalesce(F.sum("_v").over(window), F.lit(0)))
    parts = rows.groupBy("_p").agg(F.sum("_v").alias("_t"))  # a row for each partition
    base = parts.selectExpr("_p", "coalesce(sum(_t) over (order by _p rows between unbounded preceding and 1 preceding), 0) as _b")
    return local.join(F.broadcast(base), "_p").withColumn(name, F.col("_s") + F.col("_b")).drop("_p", "_v", "_s", "_b")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with the place of each row in the order, from 0."""
    return running_sum(df, order, F.lit(1), name, before=True)


def pointer_ends(steps: DataFrame, weight: str = "w") -> DataFrame:
    """(node, end, w, hops): where each node of a forest of single steps (node, to, w) ends, with the sum on the way.

    Pointers double in each round, so a chain of n steps takes log n rounds.  Cycles are an error.
    """
    at = cut(steps.select("node", F.col("to").alias("end"), F.col(weight).cast("double").alias("w"), F.lit(1).cast("long").alias("hops")))
    total = at.count()
    while True:
        nxt = at.select(F.col("node").alias("end"), F.col("end").alias("_e"), F.col("w").alias("_w"), F.col("hops").alias("_h"))
        moved = cut(at.join(nxt, "end", "left"))
        if moved.where("_e is not null").isEmpty():
            return moved.select("node", "end", "w", "hops")
        if not moved.where(F.col("hops") > total).isEmpty():
            raise ValueError("the steps go in a circle")
        at = moved.select("node", F.coalesce("_e", "end").alias("end"), (F.col("w") + F.coalesce("_w", F.lit(0.0))).alias("w"), (F.col("hops") + F.coalesce("_h", F.lit(0))).alias("hops"))
