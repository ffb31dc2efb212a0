import numpy as np
import pytest
import xxhash

from tessera.llm import simhash
from tessera.llm.common import connected_components


def slow_fingerprint(text):
    out, word = [], ""
    for c in text or "":
        if c in " \t\n\v\f\r":
            out, word = out + [word] if word else out, ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    w = out + [word] if word else out
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows, bits=4):
    label = list(range(len(rows)))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= bits:
                label[find(i)] = find(j)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[find(i)] = min(low.get(find(i), doc_id), doc_id)
    return [(d, f"{f:016x}", low.get(find(i))) for i, (d, f) in enumerate(rows)]


def key(row):
    return tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in row)


@pytest.mark.parametrize("max_run", [simhash.MAX_RUN, 3])
def test_equals_brute_force(docs, corpus, max_run):
    got = [tuple(r) for r in simhash.near_duplicates(docs, max_run=max_run).collect()]
    want = slow_components([(r[0], slow_fingerprint(r[1])) for r in corpus])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_clashing_columns_and_empty_table(clashing, empty, corpus):
    assert simhash.near_duplicates(clashing).count() == len(corpus)
    assert simhash.near_duplicates(empty).collect() == []


def test_linked_fingerprints_share_a_bucket():
    rng, tables = np.random.default_rng(0), simhash.golay_tables()
    a = rng.integers(0, 2**64, 400, dtype=np.uint64)
    b = a.copy()
    for i in range(len(a)):
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    keys = []
    for x in (a, b):
        k, row = simhash.bucket_keys(x, tables)
        keys.append([set(k[row == i].tolist()) for i in range(len(x))])
    assert all(p & q for p, q in zip(*keys))
    assert np.mean([len(p) for p in keys[0]]) < 32


def test_perfect_code():
    by_byte, errors = simhash.golay_tables()
    weights = np.array([[bin(e).count("1") if e >= 0 else 9 for e in row] for row in errors.tolist()])
    assert (weights[:, 0] <= 3).all()  # covering radius 3
    assert ((weights <= 4).sum(1) == np.where(weights[:, 0] == 3, 6, 1)).all()


def test_long_text_in_slices(monkeypatch):
    text = "a b c d e f g " * 20_000
    assert simhash.fingerprint(text) == simhash.fingerprint(text.upper())


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200), (201, 200)]
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 1 for i in range(1, 41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
