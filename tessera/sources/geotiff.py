"""Windowed GeoTIFF scan as a Python DataSource (``spark.read.format("geotiff")``).

The driver reads only the file's header (IFD, georeference, segment
offsets) and plans the window grid; every ``InputPartition`` carries a group
of pixel windows plus the byte ranges of the strips or tiles they touch (large
uncompressed strips are cut by rows, so one strip serves many tasks). Folders
of files are planned in the executors instead (``tessera.sources.mosaic``).
Executors read those byte ranges (``pyarrow.fs``, so local, HDFS or object
store paths work), decode them with numpy and yield Arrow record batches.

Options:

* ``band`` (default 0): the band read from a multi-band file (interleaved or
  band-separate);
* ``cells_per_partition`` (default 4M) and ``min_partitions``: how windows
  are grouped into tasks;

* ``form``: ``cells`` (default; ``x, y, v``), ``windows``
  (``win_x, win_y, cols, rows, t`` with ``t`` the row-major window cells,
  the analogue of an untiled raster RDD of (extent, tile) pairs), or
  ``tiles`` with option ``tile_size`` n: ``tc, tr, t`` layout tiles of n x n
  cells padded with NULL, read straight from the file (no retile shuffle);
* ``chunk``: windows of at most chunk x chunk cells, clipped to the raster;
* ``max_tile``: the same grid, but a raster with both sides within the limit
  is read whole;
* neither: the file's own segment layout (its tiles, or bands of strips).

Supported encodings: uncompressed and Deflate (compression 1, 8, 32946),
horizontal predictor 2 for integers, strips or tiles, one band read from
single- or multi-band files, integer and float sample formats. Others raise.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import (ArrayType, DataType, DecimalType, DoubleType, IntegerType, LongType, StringType,
                               StructField, StructType)

# Fixed values of the TIFF 6.0 / BigTIFF / GeoTIFF specifications.
TAG_WIDTH, TAG_LENGTH, TAG_BITS, TAG_COMPRESSION = 256, 257, 258, 259
TAG_STRIP_OFFSETS, TAG_SAMPLES, TAG_ROWS_PER_STRIP, TAG_STRIP_BYTES = 273, 277, 278, 279
TAG_PLANAR, TAG_PREDICTOR = 284, 317
TAG_TILE_WIDTH, TAG_TILE_LENGTH, TAG_TILE_OFFSETS, TAG_TILE_BYTES = 322, 323, 324, 325
TAG_SAMPLE_FORMAT = 339
TAG_PIXEL_SCALE, TAG_TIEPOINT, TAG_GEOKEYS, TAG_NODATA = 33550, 33922, 34735, 42113
TAG_TRANSFORM = 34264
GEOKEY_RASTER_TYPE, GEOKEY_GEOGRAPHIC, GEOKEY_PROJECTED = 1025, 2048, 3072
RASTER_PIXEL_IS_POINT = 2
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8, 17: 8, 18: 8}
TYPE_CODES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii",
              11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
COMPRESSION_NONE, COMPRESSION_DEFLATE = (1,), (8, 32946)
DEFAULT_SRID = 4326
HEADER_PROBE = 1 << 16
TARGET_CELLS_PER_PARTITION = 1 << 22
SEGMENT_CACHE_BYTES = 256 << 20
#: Uncompressed strips of more cells than this are cut by rows.
STRIP_CELLS = 1 << 20


def _open(path: str):
    from pyarrow import fs
    if "://" in path:
        f, p = fs.FileSystem.from_uri(path)
    else:
        f, p = fs.LocalFileSystem(), path
    return f.open_input_file(p)


@dataclass
class TiffHeader:
    path: str
    width: int
    height: int
    dtype: str                 # numpy dtype string with byte order
    compression: int
    predictor: int
    seg_w: int                 # segment (tile or strip) width
    seg_h: int                 # segment height
    tiled: bool
    offsets: list[int] | dict[int, int] = field(repr=False)   # by segment index
    counts: list[int] | dict[int, int] = field(repr=False)
    nodata: float | None = None
    samples: int = 1           # samples per pixel
    planar: int = 1            # 1 interleaved, 2 band-separate
    band: int = 0              # band read (0-based)
    x0: float = 0.0
    y0: float = 0.0
    dx: float = 1.0
    dy: float = 1.0
    srid: int = DEFAULT_SRID

    @property
    def segs_across(self) -> int:
        return math.ceil(self.width / self.seg_w)

    def spark_type(self) -> DataType:
        k = np.dtype(self.dtype).kind
        if k == "f":
            return DoubleType()
        if np.dtype(self.dtype) == np.dtype("uint64"):
            return DecimalType(20, 0)
        if np.dtype(self.dtype) in (np.dtype("uint32"), np.dtype("int64")):
            return LongType()
        return IntegerType()


def read_header(path: str) -> TiffHeader:
    """Parse the first IFD of a (Big)TIFF; reads a few kilobytes."""
    with _open(path) as f:
        size = f.size()
        head = f.read_at(min(HEADER_PROBE, size), 0)

        def read(off: int, n: int) -> bytes:
            if off + n <= len(head):
                return head[off:off + n]
            return f.read_at(n, off)

        bo = {b"II": "<", b"MM": ">"}.get(head[:2])
        if bo is None:
            raise ValueError(f"{path}: not a TIFF file")
        magic = struct.unpack(bo + "H", head[2:4])[0]
        big = magic == 43
        if magic not in (42, 43):
            raise ValueError(f"{path}: not a TIFF file")
        ifd = struct.unpack(bo + "Q", head[8:16])[0] if big else struct.unpack(bo + "I", head[4:8])[0]
        n_sz, ent_sz, off_fmt, inline = (8, 20, "Q", 8) if big else (2, 12, "I", 4)
        n = struct.unpack(bo + ("Q" if big else "H"), read(ifd, n_sz))[0]
        raw = read(ifd + n_sz, n * ent_sz)
        tags: dict[int, tuple] = {}
        for k in range(n):
            e = raw[k * ent_sz:(k + 1) * ent_sz]
            tag, typ = struct.unpack(bo + "HH", e[:4])
            cnt = struct.unpack(bo + off_fmt, e[4:4 + (8 if big else 4)])[0]
            nbytes = TYPE_SIZES.get(typ, 1) * cnt
            data = e[-inline:][:nbytes] if nbytes <= inline else read(
                struct.unpack(bo + off_fmt, e[-inline:])[0], nbytes)
            if typ == 2:
                tags[tag] = (data.rstrip(b"\x00").decode("ascii", "replace"),)
            elif typ in (5, 10):
                vals = struct.unpack(bo + TYPE_CODES[typ][0] * (2 * cnt), data)
                tags[tag] = tuple(vals[i] / vals[i + 1] if vals[i + 1] else 0.0 for i in range(0, len(vals), 2))
            elif typ in TYPE_CODES:
                tags[tag] = struct.unpack(bo + TYPE_CODES[typ] * cnt, data)

    def one(tag, default=None):
        return tags[tag][0] if tag in tags else default

    width, height = one(TAG_WIDTH), one(TAG_LENGTH)
    bits = one(TAG_BITS, 1)
    fmt = one(TAG_SAMPLE_FORMAT, 1)
    samples = one(TAG_SAMPLES, 1)
    planar = one(TAG_PLANAR, 1)
    kind = {1: "u", 2: "i", 3: "f"}.get(fmt)
    if kind is None or bits not in (8, 16, 32, 64):
        raise ValueError(f"{path}: unsupported sample format {fmt}/{bits} bits")
    dtype = np.dtype(f"{bo}{kind}{bits // 8}").str
    comp = one(TAG_COMPRESSION, 1)
    if comp not in COMPRESSION_NONE + COMPRESSION_DEFLATE:
        raise ValueError(f"{path}: compression {comp} is not supported (only none and Deflate)")
    pred = one(TAG_PREDICTOR, 1)
    if pred not in (1, 2) or (pred == 2 and kind == "f"):
        raise ValueError(f"{path}: predictor {pred} is not supported for this sample format")
    tiled = TAG_TILE_OFFSETS in tags
    if tiled:
        seg_w, seg_h = one(TAG_TILE_WIDTH), one(TAG_TILE_LENGTH)
        offsets, counts = list(tags[TAG_TILE_OFFSETS]), list(tags[TAG_TILE_BYTES])
    else:
        seg_w, seg_h = width, min(one(TAG_ROWS_PER_STRIP, height), height)
        offsets, counts = list(tags[TAG_STRIP_OFFSETS]), list(tags[TAG_STRIP_BYTES])
    h = TiffHeader(path, width, height, dtype, comp, pred, seg_w, seg_h, tiled, offsets, counts,
                   samples=samples, planar=planar)
    if TAG_NODATA in tags:
        try:
            text = str(tags[TAG_NODATA][0]).strip()
            h.nodata = int(text) if re.fullmatch(r"[+-]?\d+", text) else float(text)
        except ValueError:
            h.nodata = None
    if TAG_PIXEL_SCALE in tags and TAG_TIEPOINT in tags:
        sx, sy = tags[TAG_PIXEL_SCALE][:2]
        i, j, _, X, Y = tags[TAG_TIEPOINT][:5]
        h.dx, h.dy = float(sx), float(sy)
        h.x0, h.y0 = float(X - i * sx), float(Y + j * sy)
    elif TAG_TRANSFORM in tags:
        m = tags[TAG_TRANSFORM]
        if m[1] != 0 or m[4] != 0:
            raise ValueError(f"{path}: rotated or sheared georeference is not supported")
        h.dx, h.dy, h.x0, h.y0 = float(m[0]), float(-m[5]), float(m[3]), float(m[7])
    raster_type = 1
    if TAG_GEOKEYS in tags:
        gk = tags[TAG_GEOKEYS]
        for k in range(4, len(gk) - 3, 4):
            key, loc, _, val = gk[k:k + 4]
            if key in (GEOKEY_PROJECTED, GEOKEY_GEOGRAPHIC) and loc == 0 and val not in (0, 32767):
                h.srid = int(val)
            if key == GEOKEY_RASTER_TYPE and loc == 0:
                raster_type = val
    if raster_type == RASTER_PIXEL_IS_POINT:
        # the tiepoint names a cell centre: move the origin to the cell corner
        h.x0 -= h.dx / 2
        h.y0 += h.dy / 2
    return _cut_strips(h)


def _cut_strips(h: TiffHeader, cells: int = STRIP_CELLS) -> TiffHeader:
    """Uncompressed strips of more than ``cells`` cells as several strips of fewer rows
    (a divisor of theirs, or any number where the file is one strip)."""
    if h.tiled or h.compression not in COMPRESSION_NONE or h.width * h.seg_h <= cells or h.seg_h == 1:
        return h
    rows = max(1, cells // h.width)
    if h.seg_h < h.height:
        rows = next(r for r in range(rows, 0, -1) if h.seg_h % r == 0)
    row_bytes = h.width * (h.samples if h.planar == 1 else 1) * np.dtype(h.dtype).itemsize
    across = math.ceil(h.height / h.seg_h)  # strips of a band
    offsets, counts = [], []
    for i, (offset, count) in enumerate(zip(h.offsets, h.counts)):
        own = min(h.seg_h, h.height - i % across * h.seg_h)
        for at in range(0, own, rows):
            offsets.append(offset + at * row_bytes)
            counts.append(min(rows, own - at) * row_bytes if count else 0)
    h.seg_h, h.offsets, h.counts = rows, offsets, counts
    return h


def window_grid(h: TiffHeader, chunk: int | None = None, max_tile: int | None = None) -> list[tuple]:
    """(win_x, win_y, cols, rows) windows covering the raster."""
    if max_tile is not None and h.width <= max_tile and h.height <= max_tile:
        return [(0, 0, h.width, h.height)]
    size = chunk or max_tile
    if size:
        sw = sh = int(size)
    elif h.tiled:
        sw, sh = h.seg_w, h.seg_h
    else:  # bands of whole strips, about a million cells each
        sw = h.width
        sh = h.seg_h * max(1, (1 << 20) // max(1, h.width * h.seg_h))
    return [(x, y, min(sw, h.width - x), min(sh, h.height - y))
            for y in range(0, h.height, sh) for x in range(0, h.width, sw)]


class WindowGroup(InputPartition):
    """Windows of one file read by one task, with the file's cell offset in
    the mosaic of all files read together."""

    def __init__(self, path, header, windows, ox=0, oy=0):
        super().__init__(None)
        self.path, self.header, self.windows, self.ox, self.oy = path, header, windows, ox, oy


def check_tile_alignment(headers, offsets, mosaic, n: int) -> None:
    """Tiles straight from files need every file to start on the n-grid and
    to cover whole tiles except at the mosaic's right and bottom edge."""
    cols, rows = mosaic[5], mosaic[6]
    for h, (ox, oy) in zip(headers, offsets):
        if ox % n or oy % n:
            raise ValueError(f"{h.path}: offset ({ox}, {oy}) is not on the {n}-cell tile grid")
        if (h.width % n and ox + h.width != cols) or (h.height % n and oy + h.height != rows):
            raise ValueError(f"{h.path}: size {h.width}x{h.height} splits a {n}-cell tile")


def mosaic_offsets(headers: list[TiffHeader]) -> tuple[list[tuple[int, int]], tuple]:
    """Cell offset of every file relative to the top-left file; all files
    must share cell size and srid. Returns offsets and (x0, y0, dx, dy, srid,
    cols, rows) of the mosaic."""
    h0 = headers[0]
    for h in headers[1:]:
        if (h.dx, h.dy, h.srid) != (h0.dx, h0.dy, h0.srid):
            raise ValueError(f"{h.path}: cell size or srid differs from {h0.path}")
    x0, y0 = min(h.x0 for h in headers), max(h.y0 for h in headers)
    offs = []
    for h in headers:
        shift = (h.x0 - x0) / h.dx, (y0 - h.y0) / h.dy
        whole = tuple(round(s) for s in shift)
        if any(abs(s - w) > 1e-3 for s, w in zip(shift, whole)):
            raise ValueError(f"{h.path}: origin is {shift} cells from the mosaic's, not a whole number")
        offs.append(whole)
    _check_overlap(headers, offs)
    cols = max(o[0] + h.width for o, h in zip(offs, headers))
    rows = max(o[1] + h.height for o, h in zip(offs, headers))
    return offs, (x0, y0, h0.dx, h0.dy, h0.srid, cols, rows)


def _check_overlap(headers, offsets) -> None:
    """Files of a mosaic must not share cells (a sweep over their top edges)."""
    active: list = []
    for (ox, oy), h in sorted(zip(offsets, headers), key=lambda t: t[0][1]):
        active = [a for a in active if a[1][1] + a[0].height > oy]
        for other, (px, _) in active:
            if px < ox + h.width and ox < px + other.width:
                raise ValueError(f"{h.path} and {other.path} overlap")
        active.append((h, (ox, oy)))


def _segments(h: TiffHeader, win) -> list[tuple[int, int, int]]:
    """(index, seg_x0, seg_y0) of the segments a window touches."""
    x, y, w, r = win
    first = 0
    if h.planar == 2 and h.band:  # band-separate: each band's segments form a block
        first = h.band * h.segs_across * math.ceil(h.height / h.seg_h)
    out = []
    for sy in range(y // h.seg_h, (y + r - 1) // h.seg_h + 1):
        for sx in range(x // h.seg_w, (x + w - 1) // h.seg_w + 1):
            out.append((first + sy * h.segs_across + sx, sx * h.seg_w, sy * h.seg_h))
    return out


def _decode(h: TiffHeader, buf: bytes) -> np.ndarray:
    if h.compression in COMPRESSION_DEFLATE:
        buf = zlib.decompress(buf)
    a = np.frombuffer(buf, dtype=np.dtype(h.dtype))
    k = h.samples if h.planar == 1 else 1  # interleaved samples per pixel
    rows = len(a) // (h.seg_w * k)
    a = a[:rows * h.seg_w * k].reshape(rows, h.seg_w, k)
    if h.predictor == 2:  # differences run per sample along the row
        a = np.cumsum(a, axis=1, dtype=a.dtype)
    return a[:, :, h.band if k > 1 else 0]


class SegmentCache:
    """Decoded segments of one task, oldest evicted beyond a byte budget, so
    windows narrower than a strip do not decode the same strip again."""

    def __init__(self, budget: int = SEGMENT_CACHE_BYTES):
        self.budget, self.used, self.items = budget, 0, {}

    def get(self, idx):
        return self.items.get(idx)

    def put(self, idx, seg: np.ndarray) -> None:
        self.items[idx] = seg
        self.used += seg.nbytes
        while self.used > self.budget and len(self.items) > 1:
            old = next(iter(self.items))
            self.used -= self.items.pop(old).nbytes


def read_window(f, h: TiffHeader, win, cache: SegmentCache) -> np.ndarray:
    """Cells of one window as a 2-D array (rows, cols), native dtype."""
    x, y, w, r = win
    out = np.empty((r, w), dtype=np.dtype(h.dtype).newbyteorder("="))
    for idx, sx0, sy0 in _segments(h, win):
        seg = cache.get(idx)
        if seg is None:
            if h.counts[idx] == 0:  # sparse segment: all NoData (0 when none is set)
                kind = np.dtype(h.dtype).newbyteorder("=")
                fill = h.nodata if kind.kind == "f" else _whole_nodata(h.nodata, kind)
                seg = np.full((h.seg_h, h.seg_w), 0 if fill is None else fill, dtype=kind)
            else:
                seg = _decode(h, f.read_at(h.counts[idx], h.offsets[idx]))
            cache.put(idx, seg)
        ys, ye = max(y, sy0), min(y + r, sy0 + seg.shape[0], h.height)
        xs, xe = max(x, sx0), min(x + w, sx0 + h.seg_w, h.width)
        out[ys - y:ye - y, xs - x:xe - x] = seg[ys - sy0:ye - sy0, xs - sx0:xe - sx0]
    return out


def _arrow_type(a: np.ndarray):
    import pyarrow as pa
    if a.dtype.kind == "f":
        return pa.float64()
    if a.dtype == np.uint64:
        return pa.decimal128(20, 0)
    return pa.int64() if a.dtype in (np.uint32, np.int64) else pa.int32()


def _nodata_mask(h: TiffHeader, a: np.ndarray) -> np.ndarray:
    """True where a cell is NoData: NaN, or exactly the file's nodata value in the
    cell type. A nodata value that the cell type can't hold marks no cell."""
    if a.dtype.kind == "f":
        m = np.isnan(a)
        if h.nodata is not None:
            m |= a == a.dtype.type(h.nodata)
        return m
    value = _whole_nodata(h.nodata, a.dtype)
    return np.zeros(a.shape, dtype=bool) if value is None else a == a.dtype.type(value)


def _whole_nodata(nodata: float | int | None, dtype: np.dtype) -> int | None:
    """The nodata value as an integer of ``dtype``, or None where it isn't one."""
    if nodata is None or not math.isfinite(nodata) or nodata != int(nodata):
        return None
    info = np.iinfo(dtype)
    return int(nodata) if info.min <= int(nodata) <= info.max else None


def _masked(h: TiffHeader, a: np.ndarray, mask: np.ndarray | None = None):
    """Arrow array of a window's cells with NoData as null."""
    import pyarrow as pa
    t = _arrow_type(a)
    m = _nodata_mask(h, a) if mask is None else mask
    if a.dtype == np.uint64:
        from decimal import Decimal
        return pa.array([None if bad else Decimal(v) for v, bad in zip(a.reshape(-1).tolist(), m.reshape(-1).tolist())], type=t)
    return pa.array(a.reshape(-1).astype(t.to_pandas_dtype()), type=t, mask=m.reshape(-1))


class WindowFilter:
    """Which windows can hold cells inside pushed ranges, by column of the form read."""

    def __init__(self, form: str, tile_size: int | None, box=None):
        self.form, self.tile_size, self.bounds = form, tile_size, {}
        if box is not None:
            n = tile_size if form == "tiles" else 1
            names = ("tc", "tr") if form == "tiles" else ("x", "y")
            self.bounds = {names[0]: (box[0] // n, box[1] // n), names[1]: (box[2] // n, box[3] // n)}

    def keep(self, win, ox: int, oy: int) -> bool:
        """Window overlaps the pushed ranges (cell or tile coordinates)."""
        x, y, w, r = win
        if self.form == "tiles":
            n = self.tile_size
            spans = {"tc": ((x + ox) // n, (x + ox) // n), "tr": ((y + oy) // n, (y + oy) // n)}
        else:
            spans = {"x": (x + ox, x + ox + w - 1), "y": (y + oy, y + oy + r - 1)}
        for c, (lo, hi) in self.bounds.items():
            a, b = spans.get(c, (lo, hi))
            if (lo is not None and b < lo) or (hi is not None and a > hi):
                return False
        return True


def window_groups(h: TiffHeader, chunk: int | None, max_tile: int | None, target: int, keep):
    """Yields groups of about ``target`` cells of the windows to be read."""
    group, cells = [], 0
    for win in filter(keep, window_grid(h, chunk, max_tile)):
        group.append(win)
        cells += win[2] * win[3]
        if cells >= target:
            yield group
            group, cells = [], 0
    if group:
        yield group


def read_group(part: WindowGroup, form: str, tile_size: int | None):
    """Arrow batches of a group's windows in one of the forms."""
    import pyarrow as pa
    h = part.header
    cache = SegmentCache()
    with _open(part.path) as f:
        for win in part.windows:
            x, y, w, r = win
            if form == "grid":  # sizes from the header alone
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.path]), *[pa.array([k], pa.int32()) for k in (x + part.ox, y + part.oy, w, r)]],
                    names=["path", "win_x", "win_y", "cols", "rows"])
                continue
            a = read_window(f, h, win, cache)
            if form == "tiles":
                n = tile_size
                full = np.zeros((n, n), dtype=a.dtype)
                full[:r, :w] = a
                mask = np.ones((n, n), dtype=bool)  # padding beyond the raster is NoData
                mask[:r, :w] = _nodata_mask(h, a)
                vals = _masked(h, full, mask)
                offs = pa.array([0, n * n], type=pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(x + part.ox) // n], pa.int32()), pa.array([(y + part.oy) // n], pa.int32()),
                     pa.ListArray.from_arrays(offs, vals)], names=["tc", "tr", "t"])
            elif form == "windows":
                offs = pa.array([0, w * r], type=pa.int32())
                t = pa.ListArray.from_arrays(offs, _masked(h, a))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.path]), pa.array([x + part.ox], pa.int32()),
                     pa.array([y + part.oy], pa.int32()),
                     pa.array([w], pa.int32()), pa.array([r], pa.int32()), t],
                    names=["path", "win_x", "win_y", "cols", "rows", "t"])
            else:
                xs = np.tile(np.arange(x + part.ox, x + part.ox + w, dtype=np.int32), r)
                ys = np.repeat(np.arange(y + part.oy, y + part.oy + r, dtype=np.int32), w)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(xs), pa.array(ys), _masked(h, a)], names=["x", "y", "v"])


class GeoTiffReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.paths = _expand(options["path"])
        self.form = options.get("form", "cells")
        self.chunk = int(options["chunk"]) if "chunk" in options else None
        if self.form == "tiles":
            self.chunk = int(options["tile_size"])
        self.max_tile = int(options["max_tile"]) if "max_tile" in options else None
        self.schema = schema
        self.target = int(options.get("cells_per_partition", TARGET_CELLS_PER_PARTITION))
        self.band = int(options.get("band", 0))
        self.min_partitions = int(options.get("min_partitions", 1))
        self.filter = WindowFilter(self.form, self.chunk)

    def partitions(self):
        parts = []
        headers = [_with_band(read_header(p), self.band) for p in self.paths]
        offsets, mosaic = mosaic_offsets(headers)
        if self.form == "tiles":
            check_tile_alignment(headers, offsets, mosaic, self.chunk)
        total = sum(h.width * h.height for h in headers)
        target = max(1, min(self.target, -(-total // self.min_partitions)))
        for p, h, (ox, oy) in zip(self.paths, headers, offsets):
            for group in window_groups(h, self.chunk, self.max_tile, target, lambda w: self.filter.keep(w, ox, oy)):
                parts.append(WindowGroup(p, _slim(h, group), group, ox, oy))
        return parts

    def read(self, part: WindowGroup):
        yield from read_group(part, self.form, self.chunk)


class GeoTiffPushdownReader(GeoTiffReader):
    """Reader that also takes range filters on x / y (cells) or tc / tr
    (tiles) to skip windows at planning time. Every filter is handed back to
    Spark as well, so the pushdown only prunes and never decides results.
    Used when the session enables ``spark.sql.python.filterPushdown.enabled``."""

    def pushFilters(self, filters):
        from pyspark.sql.datasource import (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan,
                                            LessThanOrEqual)
        cols = ("tc", "tr") if self.form == "tiles" else ("x", "y")
        for f in filters:
            a = getattr(f, "attribute", None)
            v = getattr(f, "value", None)
            if a and len(a) == 1 and a[0] in cols and isinstance(v, (int, float)) and not isinstance(v, bool):
                lo, hi = self.filter.bounds.setdefault(a[0], [None, None])
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    lo = v if lo is None else max(lo, v)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    hi = v if hi is None else min(hi, v)
                self.filter.bounds[a[0]] = [lo, hi]
        return list(filters)


def _with_band(h: TiffHeader, band: int) -> TiffHeader:
    if not 0 <= band < h.samples:
        raise ValueError(f"{h.path}: band {band} requested, file has {h.samples}")
    h.band = band
    return h


def _slim(h: TiffHeader, windows) -> TiffHeader:
    """Header copy with only the segment offsets the windows need (a dict by
    segment index, so a partition carries a few entries, not the file's)."""
    need = {i for win in windows for i, _, _ in _segments(h, win)}
    return TiffHeader(**{**h.__dict__, "offsets": {i: h.offsets[i] for i in need},
                         "counts": {i: h.counts[i] for i in need}})


def _expand(path: str) -> list[str]:
    """A file, a comma-separated list, or a directory of .tif/.tiff files."""
    from pyarrow import fs
    out = []
    for p in [s for s in path.split(",") if s]:
        f, q = (fs.FileSystem.from_uri(p) if "://" in p else (fs.LocalFileSystem(), p))
        info = f.get_file_info(q)
        if info.type == fs.FileType.Directory:
            sel = f.get_file_info(fs.FileSelector(q, recursive=False))
            prefix = p[:len(p) - len(q)] if "://" in p else ""
            out += sorted(prefix + i.path for i in sel if i.path.lower().endswith((".tif", ".tiff")))
        else:
            out.append(p)
    if not out:
        raise ValueError(f"no GeoTIFF files at {path}")
    return out


def is_folder(path: str) -> bool:
    """Whether a path names one folder."""
    from pyarrow import fs
    if "," in path:
        return False
    f, q = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return f.get_file_info(q).type == fs.FileType.Directory


class GeoTiffDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self):
        h = read_header(_expand(self.options["path"])[0])
        vt = h.spark_type()
        if self.options.get("form", "cells") == "tiles":
            return StructType([StructField("tc", IntegerType()), StructField("tr", IntegerType()),
                               StructField("t", ArrayType(vt))])
        if self.options.get("form", "cells") == "grid":
            return StructType([StructField("path", StringType())] + [StructField(c, IntegerType()) for c in ("win_x", "win_y", "cols", "rows")])
        if self.options.get("form", "cells") == "windows":
            return StructType([StructField("path", StringType()), StructField("win_x", IntegerType()),
                               StructField("win_y", IntegerType()), StructField("cols", IntegerType()),
                               StructField("rows", IntegerType()), StructField("t", ArrayType(vt))])
        return StructType([StructField("x", IntegerType()), StructField("y", IntegerType()),
                           StructField("v", vt)])

    def reader(self, schema: StructType):
        if self.options.get("pushdown", "false") == "true" and self.options.get("form", "cells") not in ("windows", "grid"):
            return GeoTiffPushdownReader(self.options, schema)
        return GeoTiffReader(self.options, schema)


def default_parallelism(spark) -> int:
    from ..session import default_parallelism as dp
    return dp(spark)


def _pushdown(spark) -> str:
    on = str(spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).lower() == "true"
    return "true" if on else "false"


def register(spark) -> None:
    spark.dataSource.register(GeoTiffDataSource)


def read_geotiff(spark, path: str, name: str | None = None, chunk: int | None = None,
                 max_tile: int | None = None, form: str = "cells", band: int = 0):
    """GeoTIFF as a ``Layer`` (cells) or a windows DataFrame.

    The driver reads the file's header (georeference, size, segment offsets);
    cell data is read by the executors. Folders are planned there altogether.
    """
    from ..layer import Georef, Layer
    if is_folder(path):
        from .mosaic import read_mosaic
        return read_mosaic(spark, path, name, chunk, max_tile, form, band)
    register(spark)
    r = (spark.read.format("geotiff").option("form", form).option("pushdown", _pushdown(spark))
         .option("band", str(band))
         .option("min_partitions", str(default_parallelism(spark))))
    if chunk:
        r = r.option("chunk", str(chunk))
    if max_tile:
        r = r.option("max_tile", str(max_tile))
    df = r.load(path)
    if form in ("windows", "grid"):
        return df
    _, (x0, y0, dx, dy, srid, cols, rows) = mosaic_offsets([read_header(p) for p in _expand(path)])
    return Layer(df, name or path.rstrip("/").split("/")[-1], Georef(x0, y0, dx, dy, srid), (cols, rows))


def read_geotiff_tiles(spark, path: str, tile_size: int, name: str | None = None, band: int = 0):
    """GeoTIFF straight into a ``TileLayer`` on an n x n layout: each task
    reads its aligned windows and pads edge tiles, so no shuffle is needed.
    Returns (tile layer, layer metadata from the header: cols, rows)."""
    from ..layer import Georef, LayerMeta, TileLayer
    if is_folder(path):
        from .mosaic import read_mosaic
        return read_mosaic(spark, path, name, form="tiles", band=band, tile_size=tile_size)
    register(spark)
    df = (spark.read.format("geotiff").option("form", "tiles").option("tile_size", str(tile_size))
          .option("pushdown", _pushdown(spark)).option("band", str(band))
          .option("min_partitions", str(default_parallelism(spark))).load(path))
    _, (x0, y0, dx, dy, srid, cols, rows) = mosaic_offsets([read_header(p) for p in _expand(path)])
    tl = TileLayer(df, tile_size, name or path.rstrip("/").split("/")[-1], Georef(x0, y0, dx, dy, srid),
                   extent=(0, cols - 1, 0, rows - 1))
    return tl, LayerMeta.from_dims(cols, rows)
