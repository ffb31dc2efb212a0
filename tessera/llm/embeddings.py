"""Embedding near-dedup: Euclidean p-stable hashing and exact cosine checks.

A cosine of c between unit vectors is a Euclidean distance of sqrt(2 - 2c). Each
of ``TABLES`` tables cuts ``PROJECTIONS`` Gaussian projections of the unit vector
into cells of ``WIDTH``; vectors that share all cells of a table are candidates.
At the threshold of 0.95 (distance 0.316) a projection's cells agree with
probability 0.83, so a pair is found with 1 - (1 - 0.83^14)^60 = 0.99; closer
pairs are found more surely, and pairs at right angles collide in a table with
2e-6. Every candidate is verified in double precision, so no pair below the
threshold is linked.

Equal vectors are one class: they are hashed once and never expanded into
pairs; ``n_links`` counts the copies on both sides.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, mix64, stored

COSINE = 0.95
TABLES = 60
PROJECTIONS = 14
WIDTH = 1.5
SEED = 7
#: Vectors whose projections a task holds at once.
SLICE = 2048


def _usable(value) -> np.ndarray | None:
    """The components as doubles, or None where the vector links with nothing."""
    if value is None or any(x is None for x in value):
        return None
    v = np.array(value, np.float64)
    return v if len(v) and np.isfinite(v).all() and v.any() else None


def classes_of(vectors: DataFrame) -> DataFrame:
    """``(vec_id, class, raw)``: digest and doubles of each usable vector, else null."""

    def kernel(batches):
        for b in batches:
            digest, raw = [], []
            for value in b.column(1):
                v = _usable(value.as_py())
                data = None if v is None else v.tobytes()
                raw.append(data)
                digest.append(None if v is None else hashlib.blake2b(data, digest_size=16).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(digest, pa.string()), pa.array(raw, pa.binary())], names=["vec_id", "class", "raw"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(
        kernel, "vec_id long, class string, raw binary")


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)  # before squaring: no overflow or underflow
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def buckets(classes: DataFrame, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH) -> DataFrame:
    """``(bucket, class)``: a row for each class and table. Vectors of different length never share one."""

    def kernel(batches):
        planes: dict[int, tuple] = {}
        for b in batches:
            ids, raw = b.column(0).to_pylist(), b.column(1).to_pylist()
            by_size: dict[int, list[int]] = {}
            for i, r in enumerate(raw):
                by_size.setdefault(len(r) // 8, []).append(i)
            for dim, rows in by_size.items():
                if dim not in planes:
                    rng = np.random.default_rng([SEED, dim])
                    planes[dim] = (rng.standard_normal((dim, tables * projections)), rng.uniform(0, width, tables * projections))
                a, shift = planes[dim]
                for at in range(0, len(rows), SLICE):
                    own = rows[at:at + SLICE]
                    u = _unit(np.frombuffer(b"".join(raw[i] for i in own)).reshape(len(own), dim))
                    cell = np.floor((u @ a + shift) / width).astype(np.int64).view(np.uint64).reshape(len(own), tables, projections)
                    key = np.broadcast_to(mix64(np.arange(tables, dtype=np.uint64) + np.uint64(dim * 65536)), (len(own), tables)).copy()
                    for k in range(projections):
                        key = mix64(key + cell[:, :, k] * np.uint64(0x9E3779B97F4A7C15))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(np.array([ids[i] for i in own], object), tables), pa.string())],
                        names=["bucket", "class"])

    return classes.select("class", "raw").mapInArrow(kernel, "bucket long, class string")


def linked_pairs(classes: DataFrame, cosine: float = COSINE, **hashing) -> DataFrame:
    """``(a, b)``, a < b: the verified links among distinct vectors ``(class, raw)``."""
    keys = buckets(classes, **hashing)
    x, y = keys.toDF("bucket", "a"), keys.toDF("bucket", "b")
    pairs = x.join(y, "bucket").filter("a < b").select("a", "b").distinct()
    both = (pairs.join(classes.select(F.col("class").alias("a"), F.col("raw").alias("u")), "a")
            .join(classes.select(F.col("class").alias("b"), F.col("raw").alias("v")), "b"))

    def verify(batches):
        for t in batches:
            u, v = t.column(2).to_pylist(), t.column(3).to_pylist()
            keep = np.zeros(len(u), bool)
            by_size: dict[int, list[int]] = {}
            for i, r in enumerate(u):
                if len(r) == len(v[i]):
                    by_size.setdefault(len(r) // 8, []).append(i)
            for dim, rows in by_size.items():
                p = _scaled(np.frombuffer(b"".join(u[i] for i in rows)).reshape(-1, dim))
                q = _scaled(np.frombuffer(b"".join(v[i] for i in rows)).reshape(-1, dim))
                c = (p * q).sum(1) / np.sqrt((p * p).sum(1) * (q * q).sum(1))
                keep[rows] = c >= cosine
            yield t.select(["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "u", "v").mapInArrow(verify, "a string, b string")


def _scaled(v: np.ndarray) -> np.ndarray:
    """Rows scaled by a power of two (exact), so that squares neither overflow nor vanish."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1])


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, **hashing) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per input row.

    Null, empty and zero vectors and those with null or non-finite components
    link with nothing and are their own component; vectors of different length
    do not link. Every row counts as a vector, also with a repeated or null id;
    a null id never becomes a component_id beside others. Only vec_id and
    embedding are read.
    """
    rows = stored(classes_of(vectors), "vectors")
    classes = stored(rows.filter("class IS NOT NULL").groupBy("class", "raw").agg(
        F.count("*").alias("n"), F.min("vec_id").alias("low")), "vector-classes")
    links = stored(linked_pairs(classes, cosine, **hashing), "vector-links")
    both = links.union(links.select("b", "a"))
    size = classes.select(F.col("class").alias("b"), "n")
    near = both.join(size, "b").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("near"))
    roots = connected_components(links)
    info = (classes.select("class", "n", "low").join(near, "class", "left")
            .join(roots.withColumnRenamed("node", "class"), "class", "left")
            .select("class", "low", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), F.coalesce("root", "class").alias("root")))
    low = info.groupBy("root").agg(F.min("low").alias("component_id"))
    info = info.join(low, "root").select("class", "n_links", "component_id")
    out = rows.select("vec_id", "class").join(info, "class", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
