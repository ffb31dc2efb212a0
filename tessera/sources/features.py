"""Features of large GeoJSON FeatureCollection files, read by byte ranges.

A collection is one JSON document, so where a byte range begins inside it (in a
string? how deep? in which feature?) depends on everything before. Two passes
over the ranges settle that. The first reduces each range, for both answers to
"does it begin inside a string", to the brackets it closes of those open before and
those it leaves open; folding these facts in file order gives the state at the
beginning of each range. The second cuts the features out. What a range holds of
a feature that crosses its border is joined with the other parts in a group of
that feature alone.

Ranges are moved to the byte after the next ``}``, so no key, number, escape or
character is cut, and a feature always ends where a row (the bytes up to a
``}``) does. Only the facts reach the driver: a few bytes a range.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE_BYTES = 32 << 20
# Bytes read at a time when looking for the next closing brace.
_STEP = 1 << 16
# Bytes of features handed over at a time.
_BATCH = 4 << 20
_STRING = re.compile(rb'"(?:[^"\\]|\\.)*+("|\Z)', re.S)
_REST_OF_STRING = re.compile(rb'(?:[^"\\]|\\.)*+"', re.S)
_STRING_OR_BRACE = re.compile(rb'"(?:[^"\\]|\\.)*+(?:"|\Z)|\{', re.S)
_FLAT_ARRAY = re.compile(rb"\[[^][{}\0]*\]")
# A zero byte stands for the key "features" once strings are taken out.
_TOKEN = re.compile(rb"\0\s*:\s*\[|[][{}]")
_COMPRESSED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate", ".xz")


class Malformed(ValueError):
    pass


def _file(path: str):
    from pyarrow import fs
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    f, p = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return f.open_input_file(p)


def _row_start(f, at: int, size: int) -> int:
    """The first row that begins at or after byte ``at``."""
    if at <= 0 or at >= size:
        return min(max(at, 0), size)
    at -= 1
    while at < size:
        f.seek(at)
        step = f.read(_STEP)
        k = step.find(b"}")
        if k >= 0:
            return at + k + 1
        at += len(step)
    return size


def _content(path: str, start: int, end: int, size: int) -> bytes:
    with _file(path) as f:
        low, high = _row_start(f, start, size), _row_start(f, end, size)
        f.seek(low)
        return f.read(high - low)


def _brackets(text: bytes) -> tuple[list[bytes], bool]:
    """The brackets of text that begins outside of strings, without most balanced
    arrays, and whether it ends inside a string."""
    inside = False

    def take(m):
        nonlocal inside
        inside = not m.group(1)
        return b"\0" if m.group() == b'"features"' else b""

    text = _STRING.sub(take, text)
    for _ in range(3):  # points, rings, polygons
        text = _FLAT_ARRAY.sub(b"", text)
    return _TOKEN.findall(text), inside


def _summary(content: bytes, inside: bool) -> tuple[bool, int, list[int]]:
    """Of a range that begins in a string or not: whether it ends in one, how many
    brackets open before it closes, and those left open (2: the array of features)."""
    if inside:
        m = _REST_OF_STRING.match(content)
        if not m:
            return True, 0, []
        content = content[m.end():]
    tokens, inside = _brackets(content)
    closed, left = 0, []
    for t in tokens:
        if t in b"]}":
            if left:
                left.pop()
            else:
                closed += 1
        else:
            left.append(2 if len(t) > 1 else 1)
    return inside, closed, left


def _ranges(spark: SparkSession, path: str, range_bytes: int) -> DataFrame:
    """``(path, size, start)``: a row, and after the exchange a task's share, per range."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", F.col("length").alias("size"))
    ranges = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    n = max(1, int(ranges.agg(F.count(F.lit(1)).alias("n")).first().n))
    return ranges.repartition(min(n, 10_000), "path", "start")


def range_states(ranges: DataFrame, range_bytes: int) -> dict[tuple[str, int], tuple[bool, list[tuple[int, int]]]]:
    """By (path, start): whether the range begins in a string, and the brackets open
    there with the ranges they were opened in."""

    def kernel(batches):
        for b in batches:
            for r in b.to_pylist():
                content = _content(r["path"], r["start"], r["start"] + range_bytes, r["size"])
                for inside in (False, True):
                    ends, closed, left = _summary(content, inside)
                    yield pa.RecordBatch.from_pylist([dict(
                        path=r["path"], start=r["start"], inside=inside, ends=ends, closed=closed, left=left)], schema)

    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("inside", pa.bool_()), ("ends", pa.bool_()),
                        ("closed", pa.int64()), ("left", pa.list_(pa.int32()))])
    facts: dict[str, dict] = {}
    for r in ranges.mapInArrow(kernel, "path string, start long, inside boolean, ends boolean, closed long, left array<int>").collect():
        facts.setdefault(r.path, {})[r.start, r.inside] = r
    states = {}
    for path, of in facts.items():
        inside, stack = False, []
        for start in sorted({s for s, _ in of}):
            states[path, start] = inside, stack
            r = of[start, inside]
            if r.closed > len(stack):
                raise Malformed(f"{path}: brackets do not match")
            inside, stack = r.ends, stack[:len(stack) - r.closed] + [(kind, start) for kind in r.left]
        if inside or stack:
            raise Malformed(f"{path}: cut off before its end")
    return states


def cut(content: bytes, start: int, inside: bool, stack: list[tuple[int, int]]):
    """Yields ``(owner, seq, text)`` of a range's features: seq counts those that begin
    and end in it; 0 is a part of one that crosses, owned by the range it begins in."""
    open_ = [kind for kind, _ in stack]
    crossing = len(open_) > 2 and open_[1] == 2
    parts, owner, n = ([], stack[2][1], 0) if crossing else (None, start, 0)
    rows = content.split(b"}")
    for k, text in enumerate(rows):
        ended, at = k < len(rows) - 1, 0
        if inside:
            m = _REST_OF_STRING.match(text)
            at, inside = (m.end(), False) if m else (len(text), True)
        if not inside:
            tokens, inside = _brackets(text[at:])
            for t in tokens:
                if t == b"]":
                    if not open_:
                        raise Malformed("brackets do not match")
                    open_.pop()
                else:
                    open_.append(2 if len(t) > 1 else 3 if t == b"{" else 1)
        if parts is not None:
            parts.append(text)
        elif len(open_) > 2 and open_[1] == 2:
            # the braces of a row are all still open at its end
            braces = [m.start() for m in _STRING_OR_BRACE.finditer(text, at) if m.group() == b"{"]
            first = braces[-sum(x == 3 for x in open_[2:])]
            if not re.search(rb"(?:\A\s*,|\[)\s*\Z", text[:first]):
                raise Malformed("features must be objects with commas between them")
            parts, owner = [text[first:]], start
        if ended and not inside:
            if not open_:
                raise Malformed("brackets do not match")
            open_.pop()
        if parts is not None:
            if ended:
                parts.append(b"}")
            if len(open_) < 3:
                if len(open_) < 2 or not ended:
                    raise Malformed("brackets do not match")
                n += not crossing
                yield owner, 0 if crossing else n, b"".join(parts)
                parts, crossing = None, False
    if parts:
        yield owner, 0, b"".join(parts)


def feature_texts(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(text)``: the JSON text of every element of the files' "features" arrays.

    Files without features give no row. Cut-off files and brackets that do not match
    raise; what is inside a feature is for its parser to check. The other members
    of a collection are skipped.
    """
    ranges = _ranges(spark, path, range_bytes)
    states = range_states(ranges, range_bytes)

    def kernel(batches):
        for b in batches:
            for r in b.to_pylist():
                start, rows, held = r["start"], [], 0
                content = _content(r["path"], start, start + range_bytes, r["size"])
                for owner, seq, text in cut(content, start, *states[r["path"], start]):
                    rows.append(dict(path=r["path"], owner=owner, seq=seq, part=start, bytes=text))
                    held += len(text)
                    if held > _BATCH:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("path", pa.string()), ("owner", pa.int64()), ("seq", pa.int64()), ("part", pa.int64()), ("bytes", pa.binary())])
    parts = ranges.mapInArrow(kernel, "path string, owner long, seq long, part long, bytes binary")
    whole = parts.groupBy("path", "owner", "seq").agg(F.array_sort(F.collect_list(F.struct("part", "bytes"))).alias("parts"))
    joined = F.aggregate("parts", F.lit("").cast("binary"), lambda done, x: F.concat(done, x["bytes"]))
    return whole.select(F.decode(joined, "utf-8").alias("text"))


def splittable(spark: SparkSession, path: str) -> bool:
    """Whether all files are plain ones."""
    return not any(f.endswith(_COMPRESSED) for f in spark.read.option("recursiveFileLookup", "true").text(path).inputFiles())
