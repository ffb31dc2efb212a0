import bisect
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import packing as pk

A, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def laid_out(counts, capacity):
    """Sequences of a plan: ``{sequence: [(offset, length)]}``."""
    out = {}
    for k, rows in pk.plan(counts, capacity).items():
        rank = np.arange(counts[k])
        r = rows[np.searchsorted(rows[:, 0], rank, "right") - 1]
        i = rank - r[:, 0]
        for s, o in zip((r[:, 1] + i // r[:, 2]).tolist(), (r[:, 3] + i % r[:, 2] * k).tolist()):
            out.setdefault(s, []).append((o, k))
    return {s: sorted(x) for s, x in out.items()}


def one_by_one(counts, capacity):
    """Number of sequences of best fit, longest first, item by item."""
    gaps, n = [], 0
    for k in sorted(counts, reverse=True):
        for _ in range(counts[k]):
            at = bisect.bisect_left(gaps, k)
            gap = gaps.pop(at) if at < len(gaps) else capacity
            n += gap == capacity and at >= len(gaps)
            if gap > k:
                bisect.insort(gaps, gap - k)
    return n


@pytest.mark.parametrize("seed", range(60))
def test_plan(seed):
    rng = random.Random(seed)
    capacity = rng.choice([3, 10, 20, 64])
    counts = {rng.randint(1, capacity): rng.randint(1, 40) for _ in range(rng.randint(0, 15))}
    found = laid_out(counts, capacity)
    for items in found.values():
        ends = np.cumsum([k for _, k in items]).tolist()
        assert [o for o, _ in items] == [0, *ends[:-1]] and ends[-1] <= capacity
        assert sum(3 * k > capacity for _, k in items) <= 2
    assert sum(map(len, found.values())) == sum(counts.values())
    assert len(found) <= one_by_one(counts, capacity) + 1


def test_large_items_meet_their_best_partners():
    assert len(laid_out({6: 2, 5: 2, 4: 3}, 10)) == 4  # 6+4, 6+4, 5+5, 4
    assert pk.plan({}, 10) == {}
    with pytest.raises(ValueError):
        pk.plan({11: 1}, 10)


def test_plan_does_not_grow_with_the_counts():
    few, many = (sum(map(len, pk.plan({k: n for k in range(1, 200)}, 256).values())) for n in (1_000, 10**12))
    assert many <= 2 * few


def check(docs, got, capacity):
    library = Tokenizer.from_file(A)
    want = []
    for doc_id, text in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids), capacity), len(ids)]
        want += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    at = {}
    for r in got:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in at.values():
        items.sort()
        assert [o for o, _ in items] == [0, *np.cumsum([n for _, n in items])[:-1].tolist()]
        assert sum(n for _, n in items) <= capacity
    return len(at), sum(r.length for r in got)


def test_equals_the_library_and_fills_sequences(spark, docs, corpus, clashing):
    got = pk.packed(docs, A, PATTERN, 64).collect()
    sequences, tokens = check([r[:2] for r in corpus], got, 64)
    assert sequences <= 1.03 * tokens / 64 + 1
    key = [F.col(c) for c in ("doc_id", "piece", "length", "ids_crc32")]
    assert sorted(map(repr, pk.packed(clashing, A, PATTERN, 64).select(*key).collect())) == sorted(
        map(repr, spark.createDataFrame(got).select(*key).collect()))


def test_special_strings_and_ties(spark):
    rows = [(1, "a<|endoftext|>b"), (1, "a<|endoftext|>b"), (None, None), (None, ""), (2, "▁ \u0000 é"), *[(3, "same text")] * 40]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    check(rows, pk.packed(df, A, PATTERN, 16).collect(), 16)


def test_sequences_hold_the_ids(spark, docs):
    library = Tokenizer.from_file(A)
    rows = pk.sequences(docs.filter("doc_id < 20"), A, PATTERN, 128).collect()
    pieces = [r.input_ids[a:b] for r in rows for a, b in zip(r.offsets, [*r.offsets[1:], len(r.input_ids)])]
    assert all(len(r.input_ids) <= 128 for r in rows)
    want = [library.encode(r.text, add_special_tokens=False).ids + [2] for r in docs.filter("doc_id < 20").collect()]
    assert sorted(x for p in pieces for x in p) == sorted(x for p in want for x in p)


def test_empty_table(empty):
    assert pk.packed(empty, A, PATTERN).collect() == []
