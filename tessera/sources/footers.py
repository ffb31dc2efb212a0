"""Facts of a stored cell table from its parquet footers, read in the executors.

The files are listed by Spark; each task reads footers only. A row group whose
footer can't tell (no statistics, or a floating-point value column, where NaN is
NoData but not counted as NULL) has just those columns read, batch by batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import geotiff as gt
from .mosaic import _local

FACTS = "path string, xmin long, xmax long, ymin long, ymax long, cells long, data_cells long, groups_read int"


def file_facts(spark: SparkSession, path: str, x: str = "x", y: str = "y", v: str = "v") -> DataFrame:
    """FACTS' columns, one row per parquet file; bounds of a file without rows are NULL.
    ``groups_read`` counts the row groups of which data pages were read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")

    def kernel(batches):
        import pyarrow as pa
        for b in batches:
            rows = [(p, *_facts(_local(p), x, y, v)) for p in b.column(0).to_pylist()]
            columns = list(zip(*rows)) or [()] * 8
            types = [pa.string(), *[pa.int64()] * 6, pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in FACTS.split(", ")])

    return files.mapInArrow(kernel, FACTS)


def _facts(path: str, x: str, y: str, v: str):
    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.parquet as pq
    with gt._open(path) as f:
        table = pq.ParquetFile(f)
        meta, floats = table.metadata, pa.types.is_floating(table.schema_arrow.field(v).type)
        place = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
        bounds = {x: [], y: []}
        cells = data = groups_read = 0
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            known = {c: group.column(place[c]).statistics for c in (x, y, v)}
            unknown = [c for c in (x, y) if known[c] is None or not known[c].has_min_max]
            for c in {x, y} - set(unknown):
                bounds[c] += [known[c].min, known[c].max]
            counted = not floats and known[v] is not None and known[v].has_null_count
            if counted:
                data += group.num_rows - known[v].null_count
            else:
                unknown.append(v)
            cells += group.num_rows
            if not unknown or not group.num_rows:
                continue
            groups_read += 1
            for part in table.iter_batches(row_groups=[g], columns=unknown):
                for c in unknown:
                    values = part.column(c)
                    if c != v:
                        ends = pc.min_max(values).as_py()
                        bounds[c] += [e for e in ends.values() if e is not None]
                    else:
                        data += len(values) - values.null_count - (pc.sum(pc.is_nan(values)).as_py() or 0 if floats else 0)
        ends = [f(bounds[c], default=None) for c in (x, y) for f in (min, max)]
        return (*ends, cells, data, groups_read)


def stored_metadata(spark: SparkSession, path: str, x: str = "x", y: str = "y", v: str = "v") -> DataFrame:
    """One row (xmin, xmax, ymin, ymax, cells, data_cells), as a scan of the cells would
    give it, from one row per file."""
    f = file_facts(spark, path, x, y, v)
    return f.agg(*[how(c).cast("int").alias(c) for c, how in (("xmin", F.min), ("xmax", F.max), ("ymin", F.min), ("ymax", F.max))],
                 *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("cells", "data_cells")])
