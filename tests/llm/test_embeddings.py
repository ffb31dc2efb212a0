import numpy as np
import pytest

from tessera.llm import embeddings as em

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 32))
    out = [(i, v.tolist(), 0) for i, v in enumerate(base)]
    n = 100
    for i in range(20):  # near copies at angles around the threshold
        for t in np.linspace(0.05, 0.45, 9):
            out.append((n, (base[i] * rng.uniform(0.1, 9) + t * np.linalg.norm(base[i]) / np.sqrt(32) * rng.standard_normal(32)).tolist(), 1))
            n += 1
    out += [(1000 + i, base[3].tolist(), 2) for i in range(40)]
    out += [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 32, 0), (2003, [1.0, None] * 16, 0), (2004, [float("nan")] * 32, 0), (2005, [float("inf")] + [1.0] * 31, 0),
            (2006, base[3][:16].tolist(), 0), (2007, [1e-30] * 32, 0), (2008, [1e30] * 32, 0), (None, base[7].tolist(), 0), (5, base[5].tolist(), 0), (5, base[6].tolist(), 1)]
    return out


def slow(rows):
    good = []
    for i, (_, v, _) in enumerate(rows):
        if v and not any(x is None for x in v) and np.isfinite(v).all() and np.any(v):
            x = np.array(v, np.float32).astype(float)
            good.append((i, x / np.linalg.norm(x)))
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for p, (i, u) in enumerate(good):
        for j, v in good[:p]:
            if len(u) == len(v) and u @ v >= 0.95:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    low = {}
    for i, (vec_id, _, _) in enumerate(rows):
        if vec_id is not None:
            low[find(i)] = min(low.get(find(i), vec_id), vec_id)
    return [(vec_id, links[i], low.get(find(i))) for i, (vec_id, _, _) in enumerate(rows)]


def test_recall_and_precision(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted((tuple(r)[:3] for r in em.near_duplicates(table).collect()), key=str)
    want = sorted(slow(rows), key=str)
    assert [(g[0]) for g in got] == [w[0] for w in want]
    assert sum(g[1] for g in got) >= 0.97 * sum(w[1] for w in want) > 0
    assert sum(g == w for g, w in zip(got, want)) >= 0.95 * len(want)


def test_no_link_below_the_threshold(spark):
    rng = np.random.default_rng(5)
    u = rng.standard_normal(48)
    u /= np.linalg.norm(u)
    rows = []
    for i in range(200):
        w = rng.standard_normal(48)
        w -= (w @ u) * u
        c = 0.93 + 0.0001 * i  # 0.93 .. 0.95
        rows.append((i, (c * u + np.sqrt(1 - c * c) * w / np.linalg.norm(w)).tolist()))
    rows.append((999, u.tolist()))
    got = {r.vec_id: r for r in em.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    n = (x @ x.T >= 0.95).sum(1) - 1
    assert all(got[r[0]].n_links <= k for r, k in zip(rows, n))


def test_odd_vectors_and_tables(spark, rows):
    from pyspark.sql import functions as F
    table = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("x").alias(c) for c in ("class", "raw", "n", "bucket", "root", "low")])
    got = {r.vec_id: r for r in em.near_duplicates(table).collect()}
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (2000, 2001, 2002, 2003, 2004, 2005))
    assert got[2007].component_id == got[2008].component_id == 2007  # extreme lengths, one direction
    assert em.near_duplicates(table.limit(0)).collect() == []
