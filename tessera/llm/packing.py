"""Best-fit packing of documents into sequences of bounded length.

Only a piece's length matters for where it goes, and there are at most
``capacity`` lengths. So the packing is planned on the number of pieces of each
length (at most ``capacity`` numbers, whatever the corpus), in runs of equal
sequences, and the pieces then look up their places by their rank among those of
their length:

* large items (above a third of the capacity) meet at most twice in a sequence:
  the longest one is matched with the longest that still fits beside it;
* smaller ones, longest first, go into the smallest remaining gap that holds
  them; new sequences are opened when no gap does.

A piece's rank is its place among its input task's pieces of that length plus
the earlier tasks' counts, so no group of equal lengths ever meets in one task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import ByteBPE, slices
from .common import process_cache, stored

CAPACITY = 1024
END_ID = 2

PIECES = "doc_id long, piece long, start long, length long, ids_crc32 long"


def plan(counts: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """Places of all pieces, from the number of pieces of each length.

    Per length, rows ``(first rank, first sequence, pieces per sequence, offset)``
    in order of the ranks: the i-th piece from the first rank goes to sequence
    ``first + i // per`` at ``offset + (i % per) * length``.
    """
    left = {k: n for k, n in counts.items() if n}
    if left and not 0 < min(left) <= max(left) <= capacity:
        raise ValueError("a piece is empty or longer than the capacity")
    rows: dict[int, list] = {k: [] for k in left}
    used = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs (first sequence, number) of sequences with it
    opened = 0

    def put(length, n, first, per, offset):
        rows[length].append((used[length], first, per, offset))
        used[length] += n
        left[length] -= n

    def leave(gap, first, n):
        if gap and n:
            gaps.setdefault(gap, []).append((first, n))

    def fill(length, first, n, gap):
        """Put pieces of a length into a run of sequences with ``gap`` left."""
        per = gap // length
        whole = min(n, left[length] // per)
        if whole:
            put(length, whole * per, first, per, capacity - gap)
            leave(gap - per * length, first, whole)
        more = 0
        if whole < n and left[length]:  # the last pieces, in a sequence that holds more
            more, rest = 1, left[length]
            put(length, rest, first + whole, rest, capacity - gap)
            leave(gap - rest * length, first + whole, 1)
        leave(gap, first + whole + more, n - whole - more)

    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    for a in large:
        for b in (k for k in large if k <= a and a + k <= capacity):
            n = left[a] // 2 if a == b else min(left[a], left[b])
            if n:
                first, opened = opened, opened + n
                if a == b:
                    put(a, 2 * n, first, 2, 0)
                else:
                    put(a, n, first, 1, 0)
                    put(b, n, first, 1, a)
                leave(capacity - a - b, first, n)
        if left[a]:
            first, n = opened, left[a]
            opened += n
            put(a, n, first, 1, 0)
            leave(capacity - a, first, n)
    for s in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        for gap in sorted(g for g in gaps if g >= s):
            for first, n in gaps.pop(gap):
                fill(s, first, n, gap)  # leaves the run as it is when no piece is left
            if not left[s]:
                break
        if left[s]:
            n = -(-left[s] // (capacity // s))
            first, opened = opened, opened + n
            fill(s, first, n, capacity)
    return {k: np.array(r, np.int64).reshape(-1, 4) for k, r in rows.items()}


def pieces(docs: DataFrame, tokenizer: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID,
           keep_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, part, nth)``, and ``ids`` if kept.

    A row's text is encoded whole and ended by ``end_id``; more than ``capacity``
    ids are cut so that all pieces but the first are full. ``part`` is the task,
    ``nth`` the piece's place among the task's pieces of its length.
    """

    def kernel(batches):
        bpe = process_cache(f"byte-bpe {tokenizer}", lambda: ByteBPE(tokenizer, pattern))
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        rows: list[tuple] = []

        def batch():
            cols = list(zip(*[r[:7] for r in rows])) or [()] * 7
            out = [pa.array(c, pa.int64()) for c in cols]
            if keep_ids:
                out.append(pa.array([r[7] for r in rows], pa.list_(pa.int32())))
            rows.clear()
            return pa.RecordBatch.from_arrays(out, names=names)

        held = 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = [bpe.ids(s) for s in slices(text.as_py() or "")]
                ids = np.concatenate([*ids, np.array([end_id], np.uint32)]).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                for k, start in enumerate((0, *range(first, len(ids), capacity))):
                    own = ids[start:first if k == 0 else start + capacity]
                    rows.append((doc_id, k, start, len(own), zlib.crc32(own.tobytes()), part, int(seen[len(own)]),
                                 own.astype(np.int32) if keep_ids else None))
                    seen[len(own)] += 1
                    held += len(own)
                    if len(rows) >= 4096 or held >= 1 << 20:
                        held = 0
                        yield batch()
            if rows:
                held = 0
                yield batch()

    schema = PIECES + ", part long, nth long" + (", ids array<int>" if keep_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(kernel, schema)


def packed(docs: DataFrame, tokenizer: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID,
           keep_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, one row per piece.

    Every row is a document of its own, repeated rows and rows without a doc_id
    included; null and empty texts are one piece, the end id. Special tokens'
    strings in texts are these tokens, as the tokenizer has it. Texts of any
    length are encoded in slices that no token crosses. An empty table gives no
    rows. Only doc_id and text are read, so further columns can't clash.
    """
    found = stored(pieces(docs, tokenizer, pattern, capacity, end_id, keep_ids), "packing-pieces")
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tasks = found.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places = plan(counts, capacity)
    before = tasks.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    def place(batches):
        for b in batches:
            length = b.column(3).to_numpy()
            rank = b.column(5).to_numpy() + b.column(6).to_numpy()
            seq, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length).tolist():
                own = np.flatnonzero(length == k)
                row = places[k][np.searchsorted(places[k][:, 0], rank[own], "right") - 1]
                i = rank[own] - row[:, 0]
                seq[own], offset[own] = row[:, 1] + i // row[:, 2], row[:, 3] + i % row[:, 2] * k
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(seq), pa.array(offset), *b.columns[7:]], names=[*names, *b.schema.names[7:]])

    schema = PIECES + ", sequence_id long, offset long"
    names = [c.split()[0] for c in schema.split(", ")]
    extra = ["ids"] if keep_ids else []
    ranked = found.join(before, ["part", "length"]).select(*names[:5], "before", "nth", *extra)
    return ranked.mapInArrow(place, schema + (", ids array<int>" if keep_ids else ""))


def sequences(docs: DataFrame, tokenizer: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``(sequence_id, input_ids, doc_ids, offsets)``: the packed sequences themselves,
    with the documents in them and where each begins. Rows as in :func:`packed`."""
    one = F.struct("offset", "doc_id", "ids")
    rows = packed(docs, tokenizer, pattern, capacity, end_id, keep_ids=True)
    return rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(one)).alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("input_ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets"))
