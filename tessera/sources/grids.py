"""Cell tables: generic parquet scan and the fixture grids of FIXTURES.md.

The fixture grids are derived from the driver's tables, so their size grows
with the scale factor:

* grid A (integer classes) from ``orders``,
* grid B (integer classes, fewer rows) from ``events``,
* grid C (float values) from ``embeddings``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..layer import Georef, Layer

# Fixed values of the fixture definitions (FIXTURES.md section 2).
GRID_WIDTH = 100
CLASS_MODULUS = 22
GEOREF_A = Georef(x0=-180.0, y0=90.0, dx=0.1, dy=0.1, srid=4326)


def read_cells(spark: SparkSession, path: str, name: str = "raster",
               georef: Georef | None = None, x: str = "x", y: str = "y", v: str = "v") -> Layer:
    """Scan a cell table stored as parquet; column pruning and filter pushdown
    reach the scan because the projection is a plain select. The georeference
    stored with the table applies unless one is given. On float
    columns NaN is NoData (NULL), as in the GeoTIFF source."""
    raw = spark.read.parquet(path)
    val = F.col(v)
    if raw.schema[v].dataType.typeName() in ("double", "float"):
        val = F.when(~F.isnan(val), val)
    df = raw.select(F.col(x).cast("int").alias("x"), F.col(y).cast("int").alias("y"), val.alias("v"))
    return Layer(df, name, georef or stored_georef(raw, v) or Georef())


def stored_georef(raw: DataFrame, v: str = "v") -> Georef | None:
    """The georeference that ``sinks.save_cells`` keeps with a cell table, if any."""
    kept = raw.schema[v].metadata.get("georef")
    return Georef(**kept) if kept else None


def _class_cells(key, value) -> list:
    return [
        (key % GRID_WIDTH).cast("int").alias("x"),
        F.floor(key / GRID_WIDTH).cast("int").alias("y"),
        F.nullif(F.floor(value) % CLASS_MODULUS, F.lit(0)).cast("int").alias("v"),
    ]


def grid_a(spark: SparkSession, sf_dir: str) -> Layer:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return Layer(o.select(*_class_cells(F.col("o_orderkey"), F.col("o_totalprice"))), "A", GEOREF_A)


def grid_b(spark: SparkSession, sf_dir: str) -> Layer:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return Layer(e.select(*_class_cells(F.col("event_id"), F.col("value"))), "B", GEOREF_A)


def grid_c(spark: SparkSession, sf_dir: str) -> Layer:
    """Float raster: one row per vector, one column per embedding position."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    c = e.select(F.col("vec_id").cast("int").alias("y"),
                 F.posexplode("embedding").alias("x", "v"))
    return Layer(c.select(F.col("x").cast("int").alias("x"), "y",
                          F.col("v").cast("double").alias("v")), "C", GEOREF_A)


def grid_wide(spark: SparkSession, sf_dir: str) -> Layer:
    """Grid A's cells with 64-bit values far beyond 2^53, of either sign."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    x, y, v = _class_cells(F.col("o_orderkey"), F.col("o_totalprice"))
    wide = (F.col("o_orderkey") % 7 - 3) * 1_200_000_000_000_000_000 + F.floor("o_totalprice") % 22 * 1_000_003
    return Layer(o.select(x, y, v, wide.cast("bigint").alias("wide")).select(
        "x", "y", F.when(F.col("v").isNotNull(), F.col("wide")).alias("v")), "wide", GEOREF_A)


def grid_unsigned(spark: SparkSession, sf_dir: str) -> Layer:
    """Grid A's cells with values of an unsigned 64-bit raster, as decimals."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    x, y, v = _class_cells(F.col("o_orderkey"), F.col("o_totalprice"))
    less = F.col("o_orderkey") % 9 * 1_000_000_000_000_000_003 + F.floor("o_totalprice")
    return Layer(o.select(x, y, v, less.cast("decimal(20,0)").alias("less")).select("x", "y", F.when(
        F.col("v").isNotNull(), F.lit("18446744073709551615").cast("decimal(20,0)") - F.col("less")).cast("decimal(20,0)").alias("v")), "unsigned", GEOREF_A)


GRIDS = {"A": grid_a, "B": grid_b, "C": grid_c}
