"""Numpy kernels over Arrow batches of tiles (run inside Spark tasks).

A batch of k tiles of n x n cells is viewed as one (k, n, n) array, so the
work is vectorised across all tiles of the batch. Used through
``DataFrame.mapInArrow``; Arrow batch size is bounded by
``spark.sql.execution.arrow.maxBytesPerBatch``.
"""

from __future__ import annotations

import numpy as np


def tiles_to_array(t, n: int):
    """ListArray of k tiles -> (values (k, n, n), valid mask (k, n, n))."""
    import pyarrow as pa
    k = len(t)
    if isinstance(t, pa.ChunkedArray):
        t = pa.concat_arrays(t.chunks)
    flat = t.flatten()
    valid = ~np.asarray(flat.is_null().to_numpy(zero_copy_only=False), dtype=bool)
    kind = "f" if pa.types.is_floating(flat.type) else "i"
    vals = np.asarray(flat.fill_null(0).to_numpy(zero_copy_only=False),
                      dtype=np.float64 if kind == "f" else np.int64)
    return vals.reshape(k, n, n), valid.reshape(k, n, n)


def assembled_tiles(n: int):
    """mapInArrow function: cells (tc, tr, i, v) sorted by tile -> (tc, tr, t), row-major
    tiles of n x n. Holds the cells of one tile (and of one batch) at a time."""

    def run(batches):
        import pyarrow as pa

        def tile(key, places, values):
            i = np.concatenate(places)
            at = np.full(n * n, -1, np.int64)
            at[i] = np.arange(len(i))
            if np.count_nonzero(at >= 0) != len(i):
                raise ValueError("a cell (x, y) appears more than once in a raster")
            values = pa.concat_arrays(values).take(pa.array(at, mask=at < 0))
            t = pa.ListArray.from_arrays(pa.array([0, n * n], pa.int32()), values)
            return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int32()) for k in key), t], names=["tc", "tr", "t"])

        key, places, values = None, [], []
        for b in batches:
            tc, tr, i = (b.column(k).to_numpy() for k in range(3))
            cuts = (np.flatnonzero((tc[1:] != tc[:-1]) | (tr[1:] != tr[:-1])) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, b.num_rows]):
                if lo == hi:
                    continue
                if key != (tc[lo], tr[lo]):
                    if key:
                        yield tile(key, places, values)
                    key, places, values = (tc[lo], tr[lo]), [], []
                places.append(i[lo:hi])
                values.append(b.column(3).slice(lo, hi - lo))
        if key:
            yield tile(key, places, values)

    return run


def summed_tiles(layers: int, cells: int):
    """mapInArrow function: tiles (tc, tr, raster, t) sorted by key and raster -> (tc, tr, t),
    the cell-wise sums of the keys that all ``layers`` rasters have. Holds one running
    sum (and one batch) at a time. A cell that is NULL anywhere is NULL in the sum,
    integers that overflow raise, and so does a raster's second tile of such a key."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def values_of(column, j):
            """One tile's cells; decimals widened, so that sums of many fit."""
            values = column[j].values
            if values is None:
                return pa.nulls(cells, kind.value_type)
            return values.cast(pa.decimal256(60, values.type.scale)) if pa.types.is_decimal(values.type) else values

        def plus(a, b):
            total = pc.add(a, b) if pa.types.is_floating(a.type) else pc.add_checked(a, b)
            return total.cast(a.type)

        def tile(key, total):
            t = pa.ListArray.from_arrays(pa.array([0, len(total)], pa.int32()), total.cast(kind.value_type))
            return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int32()) for k in key), t], names=["tc", "tr", "t"])

        def whole():
            if met == layers and twice:
                raise ValueError("a tile appears more than once in a raster")
            return met == layers

        key, total, met, last, twice = None, None, 0, -1, False
        for b in batches:
            tc, tr, raster = (b.column(k).to_numpy() for k in range(3))
            kind = b.column(3).type
            for j in range(b.num_rows):
                if key != (tc[j], tr[j]):
                    if whole():
                        yield tile(key, total)
                    key, total, met, last, twice = (tc[j], tr[j]), None, 0, -1, False
                if raster[j] == last:
                    twice = True
                    continue
                last, met = raster[j], met + 1
                if met == raster[j] + 1:  # no raster missing so far
                    values = values_of(b.column(3), j)
                    total = values if total is None else plus(total, values)
        if key and whole():
            yield tile(key, total)

    return run


def box_sums(vals: np.ndarray, valid: np.ndarray, r: int):
    """Sum and count of valid cells in the (2r+1)^2 square, per tile only
    (cells beyond the tile border are not seen). Integer sums stay exact."""
    k, n, _ = vals.shape
    v = np.where(valid, vals, 0)
    c = valid.astype(np.int64)
    w = n + 2 * r
    pv = np.zeros((k, w, w), dtype=v.dtype)
    pc = np.zeros((k, w, w), dtype=np.int64)
    pv[:, r:r + n, r:r + n] = v
    pc[:, r:r + n, r:r + n] = c
    return padded_box_sums(pv, pc, n, r)


def padded_box_sums(pv: np.ndarray, pc: np.ndarray, n: int, r: int):
    """Box sums over (k, n+2r, n+2r) padded value and count blocks, separable:
    row sums, then column sums of those; returns (k, n, n) arrays. Each is a
    difference of running sums (integers exactly; small radii of floats directly)."""

    def box(a, axis):
        if r <= 4 and a.dtype.kind == "f":
            return sum(np.take(a, np.arange(d, d + n), axis) for d in range(2 * r + 1))
        upto = np.cumsum(a, axis)
        upto = np.concatenate((np.zeros_like(np.take(upto, [0], axis)), upto), axis)
        return np.take(upto, np.arange(2 * r + 1, 2 * r + 1 + n), axis) - np.take(upto, np.arange(n), axis)

    return box(box(pv, 2), 1), box(box(pc, 2), 1)


def _inside(tc, tr, n: int, bounds) -> np.ndarray:
    """(k, n, n) mask of cells within the raster bounds (xmin, xmax, ymin, ymax)."""
    xmin, xmax, ymin, ymax = bounds
    idx = np.arange(n)
    gx = tc[:, None, None] * n + idx[None, None, :]
    gy = tr[:, None, None] * n + idx[None, :, None]
    return (gx >= xmin) & (gx <= xmax) & (gy >= ymin) & (gy <= ymax)


def focal_mean_batches(n: int, r: int, bounds):
    """mapInArrow function: (tc, tr, t) -> (tc, tr, t mean as double)."""

    def run(batches):
        import pyarrow as pa
        for b in batches:
            if b.num_rows == 0:
                continue
            tc = b.column("tc").to_numpy()
            tr = b.column("tr").to_numpy()
            vals, valid = tiles_to_array(b.column("t"), n)
            s, c = box_sums(vals, valid, r)
            with np.errstate(invalid="ignore", divide="ignore"):
                mean = s.astype(np.float64) / c.astype(np.float64)
            inside = _inside(tc, tr, n, bounds)
            ok = inside & (c > 0)
            k = b.num_rows
            values = pa.array(mean.reshape(-1), type=pa.float64(), mask=~ok.reshape(-1))
            offsets = pa.array(np.arange(0, (k + 1) * n * n, n * n, dtype=np.int32))
            t = pa.ListArray.from_arrays(offsets, values)
            yield pa.RecordBatch.from_arrays([b.column("tc"), b.column("tr"), t], names=["tc", "tr", "t"])

    return run


def _span(o: int, n: int, r: int) -> slice:
    """Rows/cols of a source tile that a neighbour at offset -o needs."""
    return slice(n - r, n) if o == -1 else (slice(0, r) if o == 1 else slice(0, n))


def _place(o: int, n: int, r: int) -> slice:
    """Where a strip from the neighbour at offset o lands in the padded block."""
    return slice(0, r) if o == -1 else (slice(r + n, n + 2 * r) if o == 1 else slice(r, r + n))


NEIGHBOURS = [(ox, oy) for oy in (-1, 0, 1) for ox in (-1, 0, 1) if (ox, oy) != (0, 0)]


def halo_strips(n: int, r: int):
    """mapInArrow function: every tile emits, for each of its 8 neighbours,
    the r-wide border strip that neighbour needs. Output rows are keyed by
    the target tile; (ox, oy) is the source position relative to it."""

    def run(batches):
        import pyarrow as pa
        for b in batches:
            if b.num_rows == 0:
                continue
            k = b.num_rows
            tc = b.column("tc").to_numpy()
            tr = b.column("tr").to_numpy()
            vals, valid = tiles_to_array(b.column("t"), n)
            vtype = b.column("t").type.value_type
            for ox, oy in NEIGHBOURS:
                rs, cs = _span(oy, n, r), _span(ox, n, r)
                sv = vals[:, rs, cs].reshape(k, -1)
                sm = valid[:, rs, cs].reshape(k, -1)
                m = sv.shape[1]
                values = pa.array(sv.reshape(-1).astype(vtype.to_pandas_dtype()), type=vtype, mask=~sm.reshape(-1))
                offsets = pa.array(np.arange(0, (k + 1) * m, m, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tc - ox, pa.int32()), pa.array(tr - oy, pa.int32()),
                     pa.array(np.full(k, ox, np.int32)), pa.array(np.full(k, oy, np.int32)),
                     pa.ListArray.from_arrays(offsets, values)],
                    names=["tc", "tr", "ox", "oy", "s"])

    return run


def _place_strips(halo, pv: np.ndarray, pc: np.ndarray, n: int, r: int) -> None:
    """Write every neighbour strip of a batch into the padded blocks.

    ``halo`` is list<struct<ox, oy, s>> per tile; values and validity come
    out of Arrow as flat numpy arrays, so the only Python loop is one slice
    assignment per strip (at most 8 per tile).
    """
    import pyarrow as pa
    if isinstance(halo, pa.ChunkedArray):
        halo = pa.concat_arrays(halo.chunks)
    lengths = np.asarray(halo.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    if lengths.sum() == 0:
        return
    owner = np.repeat(np.arange(len(halo)), lengths)
    st = halo.flatten()
    ox = st.field("ox").to_numpy(zero_copy_only=False)
    oy = st.field("oy").to_numpy(zero_copy_only=False)
    s = st.field("s")
    flat = s.flatten()
    ok = ~np.asarray(flat.is_null().to_numpy(zero_copy_only=False), dtype=bool)
    vals = np.asarray(flat.fill_null(0).to_numpy(zero_copy_only=False), dtype=pv.dtype)
    offs = s.offsets.to_numpy()
    offs = offs - offs[0]
    for j in range(len(st)):
        ys, xs = _place(int(oy[j]), n, r), _place(int(ox[j]), n, r)
        shape = (ys.stop - ys.start, xs.stop - xs.start)
        a, b = offs[j], offs[j + 1]
        pv[owner[j], ys, xs] = vals[a:b].reshape(shape)
        pc[owner[j], ys, xs] = ok[a:b].reshape(shape)


def focal_mean_halo_batches(n: int, r: int, bounds):
    """mapInArrow function: (tc, tr, t, halo) -> (tc, tr, t mean) where halo
    is the list of neighbour strips of the tile (may be empty)."""

    def run(batches):
        import pyarrow as pa
        w = n + 2 * r
        for b in batches:
            if b.num_rows == 0:
                continue
            k = b.num_rows
            vals, valid = tiles_to_array(b.column("t"), n)
            pv = np.zeros((k, w, w), dtype=vals.dtype)
            pc = np.zeros((k, w, w), dtype=bool)
            pv[:, r:r + n, r:r + n] = np.where(valid, vals, 0)
            pc[:, r:r + n, r:r + n] = valid
            _place_strips(b.column("halo"), pv, pc, n, r)
            sv, sc = padded_box_sums(pv, pc.astype(np.int64), n, r)
            with np.errstate(invalid="ignore", divide="ignore"):
                mean = sv.astype(np.float64) / sc.astype(np.float64)
            tc = b.column("tc").to_numpy()
            tr = b.column("tr").to_numpy()
            inside = _inside(tc, tr, n, bounds)
            ok = inside & (sc > 0)
            values = pa.array(mean.reshape(-1), type=pa.float64(), mask=~ok.reshape(-1))
            offsets = pa.array(np.arange(0, (k + 1) * n * n, n * n, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column("tc"), b.column("tr"),
                                              pa.ListArray.from_arrays(offsets, values)],
                                             names=["tc", "tr", "t"])

    return run
