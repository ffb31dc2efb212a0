"""SimHash near-dedup by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of at most 23 bits. The
(23, 12) Golay code is perfect: every 23-bit word lies within 3 bits of exactly
one codeword. A segment's keys are the indices of all codewords within 4 bits
of it (one key, or six where the nearest codeword is 3 bits away), nearest first.
Segments 2 bits apart share a key: the codeword nearest to a word half-way
between them is within 4 bits of both. Of segments 1 bit apart, each one's
nearest codeword is a key of the other.

Four differing bits leave two of the three segments with at most 2 bits
together: 0 and up to 2, or 1 and 1. A bucket is two segments' codeword indices
(24 bits of selectivity), one of them the nearest. In the first case the equal
segment gives the nearest and the other a shared key; in the second, one
document's nearest meets the other's key in either segment. So every linked
pair shares a bucket, and a fingerprint has 29 buckets on average.

Equal fingerprints are one class before any key is made. Buckets are read as
sorted runs, compared in numpy and give a spanning forest of their links, never
all pairs. Runs longer than ``max_run`` are cut into blocks whose block pairs
are dealt out as tasks of their own, so no bucket has to fit into one task.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, connected_components, stored

SEED = 42
SHINGLE = 4
MAX_BITS = 4
MAX_RUN = 4096
#: Offsets and widths of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the (23, 12) Golay code: x^11+x^9+x^7+x^6+x^5+x+1.
GOLAY = 0b101011100011


# ---------------------------------------------------------------- fingerprints

def words_of(text: str | None) -> list[bytes]:
    """Words of the lower-cased text (A-Z only), split at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash over word shingles, repeats included; no words: 0.

    Hashes are taken in slices, so a very long text needs bounded memory.
    """
    import xxhash

    words = words_of(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[min(shingle, len(words)) - 1:].tolist()
    digest, counts = xxhash.xxh64_digest, np.zeros(2048, np.int64)
    offset = np.arange(8, dtype=np.int64) * 256
    for at in range(0, n, 65536):
        raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at:at + 65536], ends[at:at + 65536])])
        counts += np.bincount((np.frombuffer(raw, np.uint8).reshape(-1, 8) + offset).ravel(), minlength=2048)
    ones = counts.reshape(8, 256) @ np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
    return int.from_bytes(np.packbits(ones.ravel() * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` for every row; fp is the fingerprint as a signed long."""

    def kernel(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(kernel, "doc_id long, fp long")


# ---------------------------------------------------------------- Golay keys

def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes by byte (3 x 256) and, by syndrome, the error patterns (2048 x 6)
    that lead to all codewords within 4 bits, the nearest first; missing ones are -1."""
    syndrome = []
    for bit in range(23):
        r = 1 << bit
        for d in range(22, 10, -1):
            if r >> d & 1:
                r ^= GOLAY << (d - 11)
        syndrome.append(r)
    by_byte = np.zeros((3, 256), np.int64)
    for k in range(3):
        for v in range(256):
            for bit in range(8):
                if v >> bit & 1 and 8 * k + bit < 23:
                    by_byte[k, v] ^= syndrome[8 * k + bit]
    errors, used = np.full((2048, 6), -1, np.int64), np.zeros(2048, np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s, e = 0, 0
            for b in bits:
                s, e = s ^ syndrome[b], e | 1 << b
            errors[s, used[s]] = e
            used[s] += 1
    return by_byte, errors


def segment_keys(words: np.ndarray, tables) -> np.ndarray:
    """(n, 6) codeword indices within 4 bits of each 23-bit word; missing ones -1."""
    by_byte, errors = tables
    s = by_byte[0][words & 255] ^ by_byte[1][words >> 8 & 255] ^ by_byte[2][words >> 16 & 255]
    e = errors[s]
    return np.where(e < 0, -1, (words[:, None] ^ e) >> 11)


def bucket_keys(fps: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
    """``(key, row)`` arrays: the buckets of each fingerprint (uint64)."""
    seg = [segment_keys((fps >> np.uint64(o) & np.uint64((1 << w) - 1)).astype(np.int64), tables) for o, w in SEGMENTS]
    keys, rows = [], []
    for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        a, b = seg[i][:, :, None], seg[j][:, None, :]
        ok = (a >= 0) & (b >= 0)
        ok[:, 1:, 1:] = False  # one of the two is the nearest codeword
        key = (k << 24 | a << 12 | b)[ok]
        keys.append(key)
        rows.append(np.nonzero(ok)[0])
    return np.concatenate(keys), np.concatenate(rows)


# ---------------------------------------------------------------- links

def forest(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among distinct fingerprints (uint64)."""
    links, rest = [], np.arange(len(fps))
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            at = todo.pop()
            hit = np.bitwise_count(fps[rest] ^ fps[at]) <= bits
            todo += rest[hit].tolist()
            links += [(at, x) for x in rest[hit].tolist()]
            rest = rest[~hit]
    return links


def _run_links(keys, fps, bits):
    """Links of runs of equal keys (sorted): pairs at each distance within short
    runs, a spanning forest for runs of over 32 rows."""
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    length = np.diff(np.concatenate((first, [len(keys)])))
    out = []
    run = np.repeat(length, length)
    small = np.flatnonzero((run > 1) & (run <= 32))
    for d in range(1, int(run[small].max(initial=1))):
        i = small[small + d < len(keys)]
        i = i[keys[i] == keys[i + d]]
        hit = i[np.bitwise_count(fps[i] ^ fps[i + d]) <= bits]
        out.append(np.stack([fps[hit], fps[hit + d]], 1))
    for s, n in zip(first[length > 32], length[length > 32]):
        own = fps[s:s + n]
        got = np.array(forest(own, bits), np.int64).reshape(-1, 2)
        out.append(own[got])
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.uint64)


def links(classes: DataFrame, bits: int = MAX_BITS, max_run: int = MAX_RUN) -> DataFrame:
    """``(a, b)`` rows connecting all distinct fingerprints ``fp`` that are linked.

    The rows hold a spanning forest of each bucket's links: enough for the
    components, not every linked pair.
    """
    tables = golay_tables()

    def spread(batches):
        for b in batches:
            all_fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(all_fps), 2048):
                fps = all_fps[at:at + 2048]
                key, row = bucket_keys(fps, tables)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.astype(np.int32)), pa.array(fps[row].view(np.int64))], names=["key", "fp"])

    def batch(kind, a, b, block):
        n = len(a)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int8)), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)),
             pa.array(np.broadcast_to(block, n).astype(np.int64))], names=["kind", "a", "b", "block"])

    def scan(batches):
        keys, fps, seen = np.zeros(0, np.int32), np.zeros(0, np.uint64), 0  # the open run; its rows given out before
        for b in batches:
            keys = np.concatenate((keys, b.column(0).to_numpy()))
            fps = np.concatenate((fps, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            if not len(keys):
                continue
            if seen:  # the open run is a long one: give out what belongs to it
                n = int(np.searchsorted(keys, keys[0], "right"))
                yield batch(1, keys[:n], fps[:n].view(np.int64), (seen + np.arange(n)) // max_run)
                seen += n
                if n == len(keys):
                    keys, fps = keys[-1:], fps[-1:]
                    seen -= 1
                    continue
                keys, fps, seen = keys[n:], fps[n:], 0
            cut = int(np.searchsorted(keys, keys[-1], "left"))
            if cut:
                yield from closed(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
            if len(keys) > max_run:
                yield batch(1, keys[:-1], fps[:-1].view(np.int64), np.arange(len(keys) - 1) // max_run)
                seen = len(keys) - 1
                keys, fps = keys[-1:], fps[-1:]
        if len(keys):
            if seen:
                yield batch(1, keys, fps.view(np.int64), (seen + np.arange(len(keys))) // max_run)
            else:
                yield from closed(keys, fps)

    def closed(keys, fps):
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        length = np.diff(np.concatenate((first, [len(keys)])))
        long = np.repeat(length > max_run, length)
        for s, n in zip(first[length > max_run], length[length > max_run]):
            yield batch(1, keys[s:s + n], fps[s:s + n].view(np.int64), np.arange(n) // max_run)
        got = _run_links(keys[~long], fps[~long], bits)
        yield batch(0, got[:, 0].copy().view(np.int64), got[:, 1].copy().view(np.int64), 0)

    buckets = classes.select("fp").mapInArrow(spread, "key int, fp long")
    found = stored(
        buckets.repartition("key").sortWithinPartitions("key").mapInArrow(scan, "kind byte, a long, b long, block long"),
        "simhash-links")
    edges = found.filter("kind = 0").select("a", "b").distinct()

    # Long buckets: every pair of blocks is a task's group of at most 2 * max_run rows.
    long = found.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"), "block")
    last = long.groupBy("key").agg(F.max("block").alias("last"))
    pairs = long.join(last, "key").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    pairs = pairs.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "fp")

    def compare(t: pa.Table) -> pa.Table:
        fps = np.unique(t.column("fp").to_numpy().view(np.uint64))
        got = np.array(forest(fps, bits), np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(fps[got[:, 0]].view(np.int64)), "b": pa.array(fps[got[:, 1]].view(np.int64))})

    return edges.union(pairs.groupBy("key", "lo", "hi").applyInArrow(compare, "a long, b long"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = MAX_BITS, max_run: int = MAX_RUN) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per input row.

    Documents link when their fingerprints differ in at most ``bits`` (up to 4)
    bits; component_id is the smallest doc_id reachable. Null and empty texts
    have fingerprint 0 and link like any other; repeated rows stay repeated; a
    null doc_id keeps its row and never becomes a component_id beside others.
    Only ``doc_id`` and ``text`` are read, so further columns can't clash.
    """
    if not 0 <= bits <= 4:
        raise ValueError("the buckets guarantee links of at most 4 bits")
    fps = stored(fingerprints(docs, shingle), "simhash-fp")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = connected_components(links(classes, bits, max_run))
    joined = classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    ids = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = joined.join(ids, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
