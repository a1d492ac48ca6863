"""What several operators share: reading tables, cutting lineage, connected components."""

from __future__ import annotations

import json
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table of that name; columns come as they are stored."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Where the setting is unset a temporary folder takes its place, but only on a local master: on a cluster
    executors can't see each other's folders, so there it is an error.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lexweave-"))
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, kept in the shared folder.

    Lost executors don't matter to it: the files are in shared storage.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Intermediate tables as Parquet in the shared folder, which can be deleted once nothing reads them any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/lexweave-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """The rows of df, written and read again; columns that aren't needed later aren't read."""
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, name: str) -> None:
        """Deletes a table; what has been read from it must have been kept elsewhere."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def id_filter(ids: DataFrame, *columns: str, bits: int = 1 << 20):
    """A condition that holds for all values of `columns` in `ids`, and for few others while those are few.

    It spares shuffling rows that a join would drop. Its size is fixed (128 kB by default), whatever the number of ids;
    it never drops a row that joins.
    """
    at = lambda i: F.pmod(F.xxhash64(*map(F.col, columns), F.lit(i)), F.lit(bits))
    one = lambda p: F.call_function("shiftleft", F.lit(1).cast("bigint"), p.bitwiseAND(F.lit(63)).cast("int"))
    found = ids.select(F.explode(F.array(at(0), at(1))).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(one(F.col("p"))).alias("b"))
    words = np.zeros(bits // 64, np.int64)
    at_most = found.toArrow()  # bits / 64 rows
    words[at_most["w"].to_numpy()] = at_most["b"].to_numpy()
    array = F.from_json(F.lit(json.dumps(words.tolist(), separators=(",", ":"))), "array<bigint>")  # folded into a constant
    held = [F.get(array, F.shiftright(at(i), 6).cast("int")).bitwiseAND(one(at(i))) != 0 for i in (0, 1)]
    return held[0] & held[1]


def ascii_lower(column):
    """A-Z in lower case, everything else as it is."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): for every node of `edges` (a, b) the smallest node it can reach.

    Every node points at a label. Each round hangs a node, and the label it has, on the least label
    among its neighbours, then lets every node skip to its label's label; rounds grow with the logarithm
    of a component's diameter. Minima are partial aggregates, so a hub's neighbours are pre-aggregated;
    no list of neighbours is gathered. Labels are settled in shared storage before each
    join, which leaves Spark free to split the partition of a frequent label or hub.
    """
    one_way = edges.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    both = settle(one_way.union(one_way.select("b", "a")).distinct())
    labels = settle(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")))
    total = F.sum(F.col("label").cast("decimal(38,0)"))
    before = labels.agg(total).first()[0]
    if before is None:
        return labels.withColumnRenamed("label", "component")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("least")), "b")
        seen = near.join(labels.select(F.col("node").alias("a"), "label"), "a")
        offers = seen.select(F.col("a").alias("node"), F.least("least", "label").alias("label")).union(
            seen.select(F.col("label").alias("node"), F.least("least", "label").alias("label")))
        hung = settle(offers.groupBy("node").agg(F.min("label").alias("label")))
        labels = settle(
            hung.join(hung.select(F.col("node").alias("label"), F.col("label").alias("next")), "label").select("node", F.col("next").alias("label"))
        )
        now = labels.agg(total).first()[0]
        if now == before:
            return labels.withColumnRenamed("label", "component")
        before = now
    raise RuntimeError("connected components did not settle")
