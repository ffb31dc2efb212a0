"""GeoJSON zone scan (Polygon and MultiPolygon features).

``read_zones`` reads a FeatureCollection (``multiLine``, or by byte ranges where
files are large, see ``features.py``) or newline-delimited features (one Feature
per line, splittable) with a fixed schema. The
``coordinates`` field is declared as a string, which keeps its raw JSON for
both nesting depths; ``from_json`` then parses it per geometry type. All
geometries end up in MultiPolygon form ``array<polygon>``, polygon =
``array<ring>``, ring = ``array<array<double>>``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import default_parallelism
from . import features

# Fixed feature properties of the zone files: NAME (string) and ID (int).
PROPERTIES = T.StructType([
    T.StructField("NAME", T.StringType()),
    T.StructField("ID", T.IntegerType()),
])

FEATURE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("properties", PROPERTIES),
    T.StructField("geometry", T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("coordinates", T.StringType()),
    ])),
])

COLLECTION = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("features", T.ArrayType(FEATURE)),
])

# FeatureCollection files above this size (all together) are read by byte ranges.
SPREAD_BYTES = 64 << 20

POLYGON = "array<array<array<double>>>"
MULTIPOLYGON = "array<array<array<array<double>>>>"


@dataclass
class ZoneSet:
    """Zones as a table: zone_set, zone_id, zk, name, zid, geom_type, geom.

    ``zk`` is a 64-bit hash of (zone_set, zone_id): the narrow key the raster
    side joins and aggregates on (checked collision-free by ``check_ids``).
    ``max_zones`` and ``max_bytes`` are upper bounds of the zone count and of the
    size of the zones' ids and names when known (from the validation job); they
    bound what is broadcast per zone.
    """

    df: DataFrame
    name: str = "zones"
    srid: int = 4326
    max_zones: int | None = None
    max_bytes: int | None = None

    def polygons(self) -> "ZoneSet":
        """Only the Polygon features."""
        return ZoneSet(self.df.where(F.col("geom_type") == "Polygon"), self.name, self.srid, self.max_zones, self.max_bytes)

    def multipolygons(self) -> "ZoneSet":
        """Only the MultiPolygon features."""
        return ZoneSet(self.df.where(F.col("geom_type") == "MultiPolygon"), self.name, self.srid,
                       self.max_zones, self.max_bytes)

    def zone_count_bound(self) -> int:
        """Upper bound of the zone count (one small job when not yet known)."""
        self._measure()
        return self.max_zones

    def names_bound(self) -> int:
        """Upper bound of the bytes of all zones' keys, ids and names."""
        self._measure()
        return self.max_bytes

    def _measure(self) -> None:
        if self.max_zones is None or self.max_bytes is None:
            r = self.df.agg(F.count(F.lit(1)).alias("n"), F.sum(_name_bytes()).alias("b")).first()
            self.max_zones, self.max_bytes = r.n, int(r.b or 0)

    def lookup(self, zone_id: str) -> DataFrame:
        """One feature by id (a filter, not a driver-side map)."""
        return self.df.where(F.col("zone_id") == F.lit(zone_id))


def _name_bytes():
    """Bytes of a zone's row of keys, ids and names."""
    return F.lit(32) + sum(F.coalesce(F.octet_length(c), F.lit(0)) for c in ("zone_set", "zone_id", "name"))


def features_to_zones(features: DataFrame, zone_set: str) -> DataFrame:
    """Flatten feature rows to the zone table; other geometry types dropped."""
    gtype = F.col("geometry.type")
    coords = F.col("geometry.coordinates")
    strict = {"mode": "FAILFAST"}
    geom = (F.when(gtype == "Polygon", F.array(F.from_json(coords, POLYGON, strict)))
            .when(gtype == "MultiPolygon", F.from_json(coords, MULTIPOLYGON, strict)))
    # a ring needs vertices of two numbers; anything less is a broken file, not an empty zone
    whole = F.forall(geom, lambda part: F.forall(part, lambda ring: (F.size(ring) > 0) & F.forall(
        ring, lambda p: (F.size(p) >= 2) & p[0].isNotNull() & p[1].isNotNull())))
    geom = F.when(F.coalesce(whole, F.lit(False)), geom).otherwise(
        F.raise_error(F.concat(F.lit("zone with unreadable coordinates: "), F.coalesce("id", F.lit("(no id)")))))
    return (features.where(gtype.isin("Polygon", "MultiPolygon"))
            .select(F.lit(zone_set).alias("zone_set"),
                    F.col("id").alias("zone_id"),
                    F.xxhash64(F.lit(zone_set), F.col("id")).alias("zk"),
                    F.col("properties.NAME").alias("name"),
                    F.col("properties.ID").alias("zid"),
                    gtype.alias("geom_type"),
                    geom.alias("geom")))


def read_zones(spark: SparkSession, path: str, zone_set: str = "zones", srid: int = 4326,
               lines: bool = False, validate: bool = True) -> ZoneSet:
    """Scan a GeoJSON file (or folder of files) into a ``ZoneSet``.

    Input that does not parse (a cut-off file, a broken line, an ID that is no
    int, unreadable coordinates) raises; nothing is skipped.

    Small FeatureCollection files are parsed whole, one task a file. Beyond
    ``SPREAD_BYTES`` they are read by byte ranges, in two passes; features one per
    line (``lines=True``) need only one.

    ``validate`` runs one small job over the zone table: feature ids must be
    present and unique (a duplicate raises).
    """
    if lines:
        feats = spark.read.schema(FEATURE).option("mode", "FAILFAST").json(path)
    elif (large := _total_bytes(path) > SPREAD_BYTES) and _reachable(path) and features.splittable(spark, path):
        feature = F.from_json("text", FEATURE, {"mode": "FAILFAST"})
        feats = features.feature_texts(spark, path).select(feature.alias("f")).select("f.*")
    else:
        coll = spark.read.schema(COLLECTION).option("multiLine", True).option("mode", "FAILFAST").json(path)
        feats = coll.select(F.explode("features").alias("f")).select("f.*")
        if large:  # parsed by one task a file: spread for edge and crossing generation
            feats = feats.repartition(max(1, default_parallelism(spark)))
    zones = ZoneSet(features_to_zones(feats, zone_set), zone_set, srid)
    if validate:
        fp = _fingerprint(path)
        stamp = (path, zone_set, lines, fp)
        if fp is None or stamp not in _VALIDATED:
            found = _checked(zones.df)
            if fp is not None:
                _VALIDATED[stamp] = found
        else:
            found = _VALIDATED[stamp]
        zones.max_zones, zones.max_bytes = found
    return zones


# Validation results of unchanged zone files (path, size, modification time):
# re-reading the same file skips the id-check job.
_VALIDATED: dict = {}


def _fingerprint(path: str):
    """(size, mtime) of the file(s), or None when the file system is not
    reachable from the driver through pyarrow (then nothing is cached)."""
    try:
        from pyarrow import fs
        f, p = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        info = f.get_file_info(p)
        if info.type == fs.FileType.Directory:
            infos = f.get_file_info(fs.FileSelector(p, recursive=True))
            return tuple(sorted((i.path, i.size, i.mtime_ns) for i in infos))
        if info.mtime_ns is None:
            return None
        return (info.size, info.mtime_ns)
    except Exception:
        return None


def _total_bytes(path: str) -> int:
    """Size of a file or of the files in a folder (metadata only); when the
    size cannot be read, treat the input as large (features get spread)."""
    try:
        from pyarrow import fs
        f, p = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        info = f.get_file_info(p)
        if info.type == fs.FileType.Directory:
            return sum(i.size or 0 for i in f.get_file_info(fs.FileSelector(p, recursive=True)))
        return info.size or 0
    except Exception:
        return SPREAD_BYTES + 1


def _reachable(path: str) -> bool:
    """Whether pyarrow's file systems reach the path."""
    try:
        from pyarrow import fs
        f, p = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        return f.get_file_info(p).type != fs.FileType.NotFound
    except Exception:
        return False


def check_ids(zones: DataFrame) -> int:
    """Feature ids must be present and unique, and their hash keys distinct.
    One small job; returns the zone count."""
    return _checked(zones)[0]


def _checked(zones: DataFrame) -> tuple[int, int]:
    """:func:`check_ids`, and the bytes of ids and names."""
    per_key = zones.groupBy("zk").agg(
        F.count(F.lit(1)).alias("k"),
        F.count_distinct("zone_set", "zone_id").alias("ids"),
        F.count(F.when(F.col("zone_id").isNull(), 1)).alias("nulls"), F.sum(_name_bytes()).alias("bytes"))
    r = per_key.agg(F.sum("k").alias("total"), F.max("k").alias("maxk"),
                    F.max("ids").alias("maxids"), F.sum("nulls").alias("nulls"), F.sum("bytes").alias("bytes")).first()
    if r.total is None:
        return 0, 0
    if r.nulls or r.maxk > 1:
        bad = (zones.groupBy("zone_set", "zone_id").agg(F.count(F.lit(1)).alias("k"))
               .where(F.col("zone_id").isNull() | (F.col("k") > 1)).take(3))
        if r.nulls or bad:
            raise ValueError(f"zone ids must be present and unique; offending: "
                             f"{[(b.zone_id, b.k) for b in bad]}")
        raise ValueError("zone key hash collision; rename one of the colliding zones")
    return int(r.total), int(r.bytes)
