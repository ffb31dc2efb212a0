"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are partitioned by their number of five-word shingles into classes
``(u/2, u]``. A document is searched for each class in windows of ``u`` shingles
every ``u/2`` (halves whose minima are merged, so each shingle is hashed once
for all classes). A passage that holds 0.8 of an item's shingles has a window
with a Jaccard similarity of at least 0.35 to the item; with ``HASHES`` = 32
bands of one row a window like that is missed with a probability below 2e-6.
Candidates are verified by exact containment of the item's shingles (as
strings) in the whole document.

The items are the stated query set. Equal rows are counted and taken once; the
distinct ones go in blocks of about ``BLOCK_CHARS`` characters (``ITEM_CHARS`` more
for each item). Each block's sketches go to the tasks with the function, and the
documents are scanned once per block, never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, releasing

SHINGLE = 5
CONTAINMENT = 0.8
HASHES = 32
BLOCK_CHARS = 16_000_000
#: What an item costs beside its text, in characters: its sketch and its id.
ITEM_CHARS = 64
#: Shingles of a task's documents that are sketched at once, and words whose hashes are kept.
SLICE = 1 << 17
KEPT_WORDS = 50_000
_WORD = re.compile(r"\w+")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return _WORD.findall(text.lower()) if text else []


def shingles(w: list[str]) -> set[str]:
    """Distinct five-word shingles; of one to four words, the whole sequence."""
    return {" ".join(w[i:i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set()


class _WordIds(dict):
    def __missing__(self, word):
        import xxhash

        if len(self) > KEPT_WORDS:
            self.clear()
        self[word] = x = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return x


def hashes(w: list[str], ids: _WordIds) -> np.ndarray:
    """uint64 hash of each shingle, in order."""
    n = len(w)
    if not n:
        return np.zeros(0, np.uint64)
    x = np.fromiter(map(ids.__getitem__, w), np.uint64, n)
    k = min(n, SHINGLE)
    h = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        h += x[j:j + len(h)] * _ODD[j]
    return mix64(h + np.uint64(k))


def permutations(n: int = HASHES) -> np.ndarray:
    """Constants of the permutations ``x -> x xor c`` of the (already random) hashes."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * _ODD[0])


class Index:
    """Sketches of a block of items by size class; ``copies`` tells how often each
    stands in the table (once, if not given)."""

    def __init__(self, items: list[tuple[int | None, str | None]], copies: list[int] | None = None):
        ids, c = _WordIds(), permutations()
        self.items, by_class = [], {}
        for (item_id, text), n in zip(items, copies or [1] * len(items)):
            w = words(text)
            s = shingles(w)
            if s:
                u = 1 << max(1, (len(s) - 1).bit_length())
                keys = (np.unique(hashes(w, ids))[None, :] ^ c[:, None]).min(1)
                by_class.setdefault(u, []).append((keys, len(self.items)))
                self.items.append((item_id, s, n))
        self.classes = {}
        for u, rows in sorted(by_class.items()):
            keys = np.concatenate([k for k, _ in rows])
            which = np.repeat([i for _, i in rows], HASHES)
            order = np.argsort(keys, kind="stable")
            bitmap = np.zeros(1 << 20, bool)
            bitmap[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.classes[u] = (keys[order], which[order], bitmap)

    def candidates(self, docs: list[np.ndarray]) -> set[tuple[int, int]]:
        """(document, item) pairs with a window and an item that share a band."""
        docs = [(i, h) for i, h in enumerate(docs) if len(h)]
        if not docs or not self.classes:
            return set()
        owner, n = np.array([i for i, _ in docs]), np.array([len(h) for _, h in docs])
        all_h = np.concatenate([h for _, h in docs])
        width = min(self.classes) // 2
        count = -(-n // width)
        start = np.cumsum(n) - n
        at = np.repeat(start, count) + width * _ranks(count)
        levels = []  # per class: each half's neighbour and document, and the halves merged for the next class
        for u in (1 << k for k in range(min(self.classes).bit_length() - 1, max(self.classes).bit_length())):
            first = np.cumsum(count) - count
            last = first + count - 1
            beside = np.minimum(np.arange(count.sum()) + 1, np.repeat(last, count))
            half = -(-count // 2)
            left = np.repeat(first, half) + 2 * _ranks(half)
            levels.append((u, beside, np.repeat(owner, count), left))
            count = half
        found = set()
        for c in permutations():  # one at a time: memory is that of the hashes, not HASHES times as much
            low = np.minimum.reduceat(all_h ^ c, at)
            for u, beside, doc, left in levels:
                win = np.minimum(low, low[beside])
                if u in self.classes:
                    keys, which, bitmap = self.classes[u]
                    hit = np.flatnonzero(bitmap[(win & np.uint64((1 << 20) - 1)).astype(np.int64)])
                    value = win[hit]
                    a, b = np.searchsorted(keys, value, "left"), np.searchsorted(keys, value, "right")
                    for d, x, y in zip(doc[hit[b > a]].tolist(), a[b > a].tolist(), b[b > a].tolist()):
                        found.update((d, i) for i in which[x:y].tolist())
                low = win[left]
        return found

    def matches(self, texts: Iterable[str | None], containment: float = CONTAINMENT):
        """Yields (document, item_id, shared, size, copies) for verified pairs. Of the
        texts, only those of a slice are held."""
        ids, todo, size = _WordIds(), [], 0

        def run():
            sets = {}
            for d, i in sorted(self.candidates([h for _, _, h in todo])):
                item_id, s, copies = self.items[i]
                at, text, _ = todo[d]
                if at not in sets:
                    sets = {at: shingles(words(text))}
                shared = len(s & sets[at])
                if shared >= containment * len(s) - 1e-9:
                    yield at, item_id, shared, len(s), copies

        for at, t in enumerate(texts):
            h = hashes(words(t), ids)
            todo.append((at, t, h))
            size += len(h)
            if size >= SLICE:
                yield from run()
                todo, size = [], 0
        yield from run()


def _ranks(count: np.ndarray) -> np.ndarray:
    """0, 1, ... count[0]-1, 0, 1, ... count[1]-1, ..."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _texts(b: pa.RecordBatch):
    """The batch's texts, one by one."""
    return (t.as_py() for t in b.column(b.schema.get_field_index("text")))


def _blocks(benchmark: DataFrame, block_chars: int):
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.length("text") > 0)
    items = items.groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    chars = items.agg(F.sum(F.length("text") + ITEM_CHARS).alias("n")).first().n or 0
    blocks = 1 + int(chars) // block_chars
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        rows.sort(key=lambda r: (r.item_id is None, r.item_id or 0, r.text))
        yield Index([(r.item_id, r.text) for r in rows], [r.copies for r in rows])


def contained(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT,
              block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(doc_id, item_id, n_shared, n_item, containment)`` for each document row and
    benchmark row with at least ``containment`` of the item's shingles in the document.

    Items and documents of one to four words have one shingle, their whole
    sequence; those without words match nothing. Repeated rows give repeated
    pairs; null ids are kept as null. Only doc_id, text and item_id are read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for index in _blocks(benchmark, block_chars):

        def kernel(batches, index=index):
            for b in batches:
                got = list(index.matches(_texts(b), containment))
                at, item, shared, size, copies = zip(*got) if got else ((),) * 5
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at, pa.int64())), pa.array(item, pa.int64()), pa.array(shared, pa.int64()),
                     pa.array(size, pa.int64()), pa.array([x / y for x, y in zip(shared, size)], pa.float64()), pa.array(copies, pa.int64())],
                    names=["doc_id", "item_id", "n_shared", "n_item", "containment", "copies"])

        part = docs.mapInArrow(releasing(kernel), "doc_id long, item_id long, n_shared long, n_item long, containment double, copies long")
        out = part if out is None else out.union(part)
    # a repeated item's pairs, once for each of its rows
    return out.select("*", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copies", "copy")


def decontaminated(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT,
                   block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no benchmark item (as in
    :func:`contained`); one narrow pass per block of items."""
    for index in _blocks(benchmark, block_chars):

        def kernel(batches, index=index):
            for b in batches:
                bad = {m[0] for m in index.matches(_texts(b), containment)}
                yield b.filter(pa.array([i not in bad for i in range(b.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(releasing(kernel), docs.schema)
    return docs
