"""Raster and vector dataset catalogs.

A catalog is a small DataFrame of dataset records. The vector file used with
a raster is picked by the raster's srid: ``<base_path>/<srid>/<file>`` (a
pre-projected copy per coordinate system; no reprojection is done).
"""

from __future__ import annotations

from dataclasses import astuple, dataclass, is_dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_SRID = 4326

RASTER_SCHEMA = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("path", T.StringType(), False),
    T.StructField("pixel_value", T.IntegerType(), False),
    T.StructField("new_pixel", T.IntegerType(), False),
    T.StructField("srid", T.IntegerType(), True),
])

VECTOR_SCHEMA = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("base_path", T.StringType(), False),
    T.StructField("file", T.StringType(), False),
    T.StructField("srid", T.IntegerType(), True),
])


@dataclass(frozen=True)
class RasterRecord:
    name: str
    path: str
    pixel_value: int
    new_pixel: int
    srid: int = DEFAULT_SRID


@dataclass(frozen=True)
class VectorRecord:
    name: str
    base_path: str
    file: str
    srid: int = DEFAULT_SRID


def _catalog(spark: SparkSession, rows, schema: T.StructType) -> DataFrame:
    df = spark.createDataFrame([astuple(r) if is_dataclass(r) else tuple(r) for r in rows], schema)
    return df.withColumn("srid", F.coalesce(F.col("srid"), F.lit(DEFAULT_SRID)))


def raster_catalog(spark: SparkSession, records) -> DataFrame:
    """Catalog of rasters; a missing srid defaults to 4326."""
    return _catalog(spark, records, RASTER_SCHEMA)


def vector_catalog(spark: SparkSession, records) -> DataFrame:
    """Catalog of vector (zone) files; a missing srid defaults to 4326."""
    return _catalog(spark, records, VECTOR_SCHEMA)


def vector_path_col(base_path: Column, raster_srid: Column, file: Column) -> Column:
    """``base/<raster srid>/file`` as a column expression."""
    return F.concat_ws("/", base_path, raster_srid.cast("string"), file)


def vector_path(v: VectorRecord, raster: RasterRecord) -> str:
    return f"{v.base_path}/{raster.srid}/{v.file}"


def vector_paths_for(vectors: DataFrame, raster_srid: int) -> DataFrame:
    """Vector catalog with the path of the copy matching one raster srid."""
    return vectors.select("name", vector_path_col(F.col("base_path"), F.lit(raster_srid), F.col("file")).alias("path"),
                          F.lit(raster_srid).alias("srid"))
