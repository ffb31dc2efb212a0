import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string"


def trie(df):
    return cv.trie(df, lambda c: c - c % 5, lambda c: F.crc32(c.cast("string")) % 9, 8)


def brute(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v, key=lambda q: q[:2])] for c, v in own.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    members, children, sums, out = {}, {}, {}, []
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    for s in members:
        if s:
            children.setdefault(s[:-1], []).append(s)
    for s in sorted(members, key=len, reverse=True):
        leaves, saved = int(s not in children), (len(members[s]) - 1) * len(s[-1][1].encode()) if s else 0
        for k in children.get(s, []):
            leaves, saved = leaves + sums[k][0], saved + sums[k][1]
        sums[s] = leaves, saved
    for s, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(s))
        out.append((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(children.get(s, [])), *sums[s],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    """Copies, forks, null cells, missing bases, a long conversation, ids without rows."""
    rng = random.Random(5)
    out = [(c, t, rng.choice(["u", "a", None]), rng.choice(["x", "y", None, "é"])) for c in range(0, 60) if c % 7
           for t in range(rng.choice([1, 2, 5, 12]))]
    out += [(c, None if t == 0 else t, "u", f"same {t}") for c in range(100, 140) for t in range(9)]  # copies, a null turn each
    out += [(70, t, "u", "x" if t % 3 else "z") for t in range(400)]
    out += [(80, 0, "u", "again")] * 60  # repeated rows
    return out + [(None, 1, "u", "nobody's")] * 3


def test_equals_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(cv, "BLOCK", 7)  # running sums and joins over many blocks
    monkeypatch.setattr(cv, "IDS", 4)  # digests over many ranges
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(trie(df)) == brute(rows)


def test_conversations_across_parts(spark, rows):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        df = spark.createDataFrame(rows, SCHEMA)
        turns = cv.scanned(cv.hashed(df, 0))
        assert result(trie(df)) == brute(rows)
        assert turns.groupBy("conv_id").agg(F.max("pos").alias("n")).filter("conv_id = 70").first().n == 400
        assert turns.filter("conv_id = 80").select("pos").distinct().count() == 60
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_collisions_are_found(spark, monkeypatch):
    rows = [(c, t, "u", f"text {c % 3} {t}") for c in range(10, 20) for t in range(3)]
    right, differ, seen = cv.hashed, cv.contents_differ, []

    def hashed(df, salt):
        seen.append(salt)
        out = right(df, salt)
        return out if salt > 1 else out.withColumn("h1", F.lit(1).cast("long")).withColumn("h2", F.lit(0).cast("long"))

    monkeypatch.setattr(cv, "hashed", hashed)
    # the first salt's equal contents go unnoticed, so that the nodes' check must find them
    monkeypatch.setattr(cv, "contents_differ", lambda t: differ(t) if seen[-1] else False)
    monkeypatch.setattr(cv, "nodes_of", lambda c, m, f=cv.nodes_of: f(c, m).withColumn("same", F.col("same") & F.lit(seen[-1] > 0)))
    assert result(trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert seen == [0, 1, 2]


def test_empty_turnless_and_clashing(spark):
    assert trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert trie(spark.createDataFrame([(None, 1, "u", "x")], SCHEMA)).collect() == []
    lone = next(c for c in range(1001, 1100) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1)
    rows = [(lone, 0, None, None)]  # its base is absent, its own turn is skipped
    got = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("x").alias(k) for k in ("h1", "pos", "depth", "rep", "size", "base", "part")])
    assert result(trie(got)) == brute(rows) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_monoid():
    rng = np.random.default_rng(1)
    m, c = rng.integers(0, 2**63, 50, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, 50, np.uint64)
    pm, pc = cv.running(m, c)
    at = (np.uint64(1), np.uint64(0))
    for i in range(50):
        at = cv.compose(at, (m[i], c[i]))
        assert (pm[i], pc[i]) == at
    rest = cv.quotient((pm[9:10], pc[9:10]), (pm[49:], pc[49:]))
    assert cv.compose((pm[9:10], pc[9:10]), rest) == (pm[49:], pc[49:])
