"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared folder in ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under ``spark.checkpoint.dir`` and read again."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


class WorkTables:
    """Tables under ``spark.checkpoint.dir`` that are deleted when the block ends.

    What is read from them must be stored elsewhere by then (see :func:`stored`).
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.names = spark, [], []

    def __enter__(self) -> WorkTables:
        return self

    def _place(self, name: str) -> str:
        self.paths.append(f"{ensure_checkpoint_dir(self.spark)}/{name}-{uuid.uuid4().hex}")
        return self.paths[-1]

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = self._place(name)
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def bucketed(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """``df`` bucketed by ``key``, so that grouping by it later moves no rows."""
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        table = f"tessera_{uuid.uuid4().hex}"
        df.write.bucketBy(buckets, key).option("path", self._place(name)).saveAsTable(table)
        self.names.append(table)
        return self.spark.table(table)

    def __exit__(self, *failure) -> None:
        for table in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        jvm = self.spark._jvm
        for path in self.paths:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def release_memory() -> None:
    """Hand memory that this process no longer uses back to the system: a Python worker
    lives on between tasks, and with it what its allocators keep."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def releasing(kernel: Callable) -> Callable:
    """A mapInArrow kernel that ends with :func:`release_memory`."""

    def run(batches):
        try:
            yield from kernel(batches)
        finally:
            release_memory()

    return run


def process_cache(name: str, make: Callable):
    """One value per Python worker process, kept across its tasks.

    Functions reach the workers by value, so their module globals do not last;
    a module object in ``sys.modules`` does.
    """
    store = sys.modules.setdefault("_tessera_llm_cache", types.ModuleType("_tessera_llm_cache"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


def looked_up(many: DataFrame, one: DataFrame, keys: list[str], weight: str, parts: int = 1000) -> DataFrame:
    """Inner join of ``many`` rows with ``one`` row per key, of which ``weight`` says how
    many of the ``many`` rows have it.

    Keys with more than a ``parts``-th of all rows (so fewer than ``parts`` of them)
    are broadcast; no other key has more than that share of the rows of the shuffle.
    """
    total = one.agg(F.sum(weight)).first()[0] or 0
    often = F.col(weight) > total // parts
    hot, rest = F.broadcast(one.filter(often).drop(weight)), one.filter(~often).drop(weight)
    return many.join(hot, keys).unionByName(many.join(hot.select(*keys), keys, "left_anti").join(rest, keys))


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph: ``(a, b)`` rows to ``(node, root)`` rows.

    Alternating large-star and small-star rounds; the root is the smallest
    node. Every round is a grouped minimum joined back (never a collected
    group), so a hub with many neighbours is dealt with by partial aggregation
    and the skew join. Each round is checkpointed. Nodes without an edge do
    not appear; self loops are ignored; no edges give no rows.
    """
    e = checkpointed(
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _fingerprint(e)
    while mark[0]:
        near = e.union(e.select("b", "a")).toDF("u", "v")
        low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = near.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        both = large.join(low, "a")
        e = checkpointed(both.select("a", F.col("m").alias("b"))
                         .union(both.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
        now = _fingerprint(e)
        if now == mark:
            break
        mark = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _fingerprint(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Slots:
    """Places of int64 keys in their sorted array (-1: absent): a slot table, with a
    binary search where slots collide."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(4, int(len(keys) * 8).bit_length()))
        self.slots = np.zeros(1 << int(64 - self.shift), np.int32)
        self.slots[self._slot(keys)] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, x):
        return (x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(x), -1, np.int32)
        at = self.slots[self._slot(x)]
        miss = np.flatnonzero(self.keys[at] != x)
        if len(miss):
            want = x[miss]
            near = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1).astype(np.int32)
            at[miss] = np.where(self.keys[near] == want, near, -1)
        return at
