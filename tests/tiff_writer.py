"""Minimal GeoTIFF writer for test fixtures (strips or tiles, none/Deflate)."""

import struct
import zlib

import numpy as np


def write_tiff(path, a, *, tile=None, rows_per_strip=None, deflate=False, predictor=1,
               nodata=None, georef=None, epsg=None, big_endian=False, compression=None, bigtiff=False,
               pixel_is_point=False, transform=None, sparse=()):
    a = np.asarray(a)
    planes = [a] if a.ndim == 2 else list(a)  # (bands, h, w) -> band-separate file
    a = planes[0]
    h, w = a.shape
    bo = ">" if big_endian else "<"
    a = a.astype(a.dtype.newbyteorder(bo))
    kind = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    bits = a.dtype.itemsize * 8
    segs = []
    for a in [p.astype(p.dtype.newbyteorder(bo)) for p in planes]:
        segs += _segments(a, h, w, tile, rows_per_strip)
    blobs = []
    for k, s in enumerate(segs):
        if k in sparse:
            blobs.append(b"")
            continue
        if predictor == 2:
            s = np.diff(s, axis=1, prepend=np.zeros((s.shape[0], 1), dtype=s.dtype)).astype(s.dtype)
        b = s.tobytes()
        blobs.append(zlib.compress(b) if deflate else b)
    nb = len(planes)
    tags = {256: (4, [w]), 257: (4, [h]), 258: (3, [bits] * nb), 259: (3, [compression or (8 if deflate else 1)]),
            262: (3, [1]), 277: (3, [nb]), 284: (3, [2 if nb > 1 else 1]), 317: (3, [predictor]),
            339: (3, [kind] * nb)}
    if tile:
        tags[322] = (3, [tile]); tags[323] = (3, [tile])
    else:
        tags[278] = (4, [rows_per_strip or h])
    if nodata is not None:
        tags[42113] = (2, str(nodata))
    if georef:
        x0, y0, dx, dy = georef
        tags[33550] = (12, [dx, dy, 0.0])
        tags[33922] = (12, [0.0, 0.0, 0.0, x0, y0, 0.0])
    if transform:
        tags[34264] = (12, list(transform))
    keys = []
    if pixel_is_point:
        keys.append((1025, 0, 1, 2))
    if epsg:
        keys.append((3072, 0, 1, epsg))
    if keys:
        tags[34735] = (3, [1, 1, 0, len(keys)] + [v for k in keys for v in k])
    data_off = 16 if bigtiff else 8
    offsets = []
    for b in blobs:
        offsets.append(data_off)
        data_off += len(b)
    off_type = 16 if bigtiff else 4
    tags[324 if tile else 273] = (off_type, offsets)
    tags[325 if tile else 279] = (off_type, [len(b) for b in blobs])
    fmt = {2: "s", 3: "H", 4: "I", 12: "d", 16: "Q"}
    ent, cnt_fmt, inline, nfmt = (20, "Q", 8, "Q") if bigtiff else (12, "I", 4, "H")
    ifd_off = data_off + (data_off % 2)
    entries, extra = [], b""
    extra_off = ifd_off + struct.calcsize(bo + nfmt) + ent * len(tags) + inline
    for tag in sorted(tags):
        typ, vals = tags[tag]
        if typ == 2:
            payload = vals.encode() + b"\0"
            cnt = len(payload)
        else:
            payload = struct.pack(bo + fmt[typ] * len(vals), *vals)
            cnt = len(vals)
        if len(payload) <= inline:
            field = payload.ljust(inline, b"\0")
        else:
            field = struct.pack(bo + cnt_fmt, extra_off + len(extra))
            extra += payload + (b"\0" if len(payload) % 2 else b"")
        entries.append(struct.pack(bo + "HH" + cnt_fmt, tag, typ, cnt) + field)
    with open(path, "wb") as f:
        if bigtiff:
            f.write((b"MM" if big_endian else b"II") + struct.pack(bo + "HHHQ", 43, 8, 0, ifd_off))
        else:
            f.write((b"MM" if big_endian else b"II") + struct.pack(bo + "HI", 42, ifd_off))
        for b in blobs:
            f.write(b)
        f.write(b"\0" * (ifd_off - data_off))
        f.write(struct.pack(bo + nfmt, len(tags)) + b"".join(entries) + struct.pack(bo + cnt_fmt, 0) + extra)
    return path


def _segments(a, h, w, tile, rows_per_strip):
    if tile:
        out = []
        for ty in range(0, h, tile):
            for tx in range(0, w, tile):
                blk = np.zeros((tile, tile), dtype=a.dtype)
                part = a[ty:ty + tile, tx:tx + tile]
                blk[:part.shape[0], :part.shape[1]] = part
                out.append(blk)
        return out
    rps = rows_per_strip or h
    return [a[y:y + rps] for y in range(0, h, rps)]
