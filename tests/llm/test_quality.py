import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import quality as q

LABELS = "doc_id long, quality int, toxic int"


def units(text):
    """UTF-16 code units, from the definition; U+0000 as U+FFFF."""
    out = []
    for c in map(ord, text):
        out += [c or 0xFFFF] if c < 0x10000 else [0xD800 + (c - 0x10000 >> 10), 0xDC00 + (c - 0x10000 & 0x3FF)]
    return out


def slow_model(texts, order):
    """Modified Kneser-Ney over tuples of code units, from the formulas."""
    def grams(text):
        s = [0] * (order - 1) + units(text)
        return [tuple(s[i:i + order]) for i in range(len(s) - order + 1)]

    counts = {order: Counter(g for t in texts for g in grams(t))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discount, total, mass = {}, {}, {}
    for k, table in counts.items():
        n = Counter(table.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
        discount[k] = [min(i, max(0.1, i - (i + 1) * y * n[i + 1] / n[i])) if n[i] else 0.5 for i in (1, 2, 3)]
        total[k], mass[k] = Counter(), Counter()
        for g, c in table.items():
            total[k][g[:-1]] += c
            mass[k][g[:-1]] += discount[k][min(c, 3) - 1]

    def p(g):
        k = len(g)
        if not k:
            return 1 / (len(counts[1]) + 1)
        lower, h = p(g[1:]), g[:-1]
        if not total[k][h]:
            return lower
        c = counts[k][g]
        seen = (c - discount[k][min(c, 3) - 1]) / total[k][h] if c else 0
        return seen + mass[k][h] / total[k][h] * lower

    return lambda text: sum(-math.log(p(g)) for g in grams(text))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    stems = ("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha")

    def prose(n):
        return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 4))) for _ in range(n)) + "."

    docs = [(i, prose(rng.randint(5, 120)), "en" if i % 3 else "fr") for i in range(240)]
    docs += [(300 + i, "!!".join(x.upper() for x in prose(60).split()), "en") for i in range(12)]
    docs += [(400, None, "en"), (401, "", "en"), (402, "no model for it", "xx"), (403, prose(30), None), (None, prose(40), "en"), (7, docs[7][1], "en"),
             (500, "漢字😀\u0000" * 30, "en"), (501, prose(9000), "en")]
    labels = [(i, 1, 0) for i in range(120)] + [(i, 0, 0) for i in range(300, 306)] + [(200, 1, 1), (200, 1, 0), (None, 1, 0), (7, 1, None), (9999, 1, 0)]
    return docs, labels


def test_scores_equal_the_formulas(spark, rows):
    docs, labels = rows
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    for blocks in (q.BLOCK_CHARS, 5000):
        got = q.classify(table, spark.createDataFrame(labels, LABELS), order=3, block_chars=blocks).collect()
        assert len(got) == len(docs)
        by_id = {r.doc_id: r for r in got}
        for lang in ("en", "fr"):
            model = slow_model([t for i, t, g in docs if g == lang and i is not None and i < 120 and t], 3)
            mine = sorted(model(t) / len(t) for i, t, g in docs if g == lang and i is not None and i < 120 and t)
            middle = (math.floor(mine[math.ceil(len(mine) / 2) - 1] / q.BIN) + 1) * q.BIN
            for i, t, g in docs:
                if g == lang and t and i in by_id and i != 7:
                    want = (model(t) + q.PRIOR_CHARS * middle) / (len(t) + q.PRIOR_CHARS)
                    assert by_id[i].log_ppl == pytest.approx(want, abs=2 * q.BIN)


def test_decisions_and_odd_rows(spark, rows):
    docs, labels = rows
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    table = table.select("*", *[F.lit("x").alias(c) for c in ("block", "blob", "gram", "n", "nll", "keep", "salt", "n_chars", "threshold")])
    got = {r.doc_id: r for r in q.classify(table, spark.createDataFrame(labels, LABELS)).collect()}
    assert not any(got[300 + i].keep for i in range(12)) and not got[500].keep
    assert sum(got[i].keep for i in range(240)) >= 236
    assert got[400].keep and got[401].keep and got[402].keep and got[403].keep
    assert got[402].log_ppl is None and got[402].threshold is None


def test_empty_tables(spark, rows):
    docs, labels = rows
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    none = spark.createDataFrame([], LABELS)
    assert all(r.keep and r.log_ppl is None for r in q.classify(table, none).collect())
    assert q.classify(table.limit(0), spark.createDataFrame(labels, LABELS)).collect() == []


def test_blocks_are_bounded_for_any_ids(spark, monkeypatch):
    """A third of the rows without an id, a third equal rows of one id."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice(("the", "her", "on", "and", "red")) for _ in range(30)) for _ in range(400)]
    docs = [(i, t, "en") for i, t in enumerate(texts)] + [(None, t[::-1], "en") for t in texts] + [(7, texts[7], "en")] * 400
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    packed, requests = [], q.requests
    monkeypatch.setattr(q, "requests", lambda p, *rest: packed.extend(p.select("block", "blob").collect()) or requests(p, *rest))
    got = q.classify(table, spark.createDataFrame([(i, 1, 0) for i in range(50)], LABELS), order=3, block_chars=10_000).collect()
    chars = Counter()
    for r in packed:
        chars[r.block] += sum(len(x) for t in q._unpacked(__import__("pyarrow").table({"blob": [bytes(r.blob)]})) for x in t.column("text").to_pylist())
    assert sum(chars.values()) == sum(len(t) for _, t, _ in docs) and max(chars.values()) <= 10_000 + max(map(len, texts))
    model = slow_model([t for i, t, _ in docs if i is not None and i < 50], 3)
    assert len(got) == len(docs) and sum(r.doc_id is None for r in got) == 400 and sum(r.doc_id == 7 for r in got) == 401
    mine = sorted(model(t) / len(t) for i, t, _ in docs if i is not None and i < 50)
    middle = (math.floor(mine[math.ceil(len(mine) / 2) - 1] / q.BIN) + 1) * q.BIN
    by_text = {t: model(t) for i, t, _ in docs[:400]}
    for r in got:
        if r.doc_id is not None:
            t = texts[r.doc_id]
            assert r.log_ppl == pytest.approx((by_text[t] + q.PRIOR_CHARS * middle) / (len(t) + q.PRIOR_CHARS), abs=2 * q.BIN)


def test_work_tables_are_deleted_and_texts_stay_in_their_buckets(spark, rows, tmp_path, monkeypatch):
    docs, labels = rows
    kept = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    plans, scores = [], q.document_scores
    monkeypatch.setattr(q, "document_scores", lambda *a: plans.append(scores(*a)) or plans[-1])
    try:
        table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
        assert q.classify(table, spark.createDataFrame(labels, LABELS)).count() == len(docs)
        left = {p.name.rsplit("-", 1)[0] for d in tmp_path.iterdir() for p in d.iterdir()}
        assert left == {"kn-scores"}
    finally:
        if kept:
            spark.sparkContext.setCheckpointDir(kept)
    blobs = [line for line in plans[0]._jdf.queryExecution().executedPlan().toString().split("\n") if "blob" in line]
    assert blobs and not any("Exchange" in line for line in blobs)
