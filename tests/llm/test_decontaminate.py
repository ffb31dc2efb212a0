import random

import numpy as np
import pytest

from tessera.llm import decontaminate as dc

ITEMS = "item_id long, text string"


@pytest.fixture()
def planted(spark, corpus):
    rng = random.Random(9)
    items = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eta", "zeta", "iota"]) + str(rng.randint(0, 40)) for _ in range(rng.randint(6, 300))))
             for i in range(30)]
    items += [(100, None), (101, ""), (102, "one"), (103, "two words"), (None, "a null id with enough words to make shingles"), (5, items[4][1])]
    docs = list(corpus)
    for i, (_, text) in enumerate(items[:30]):
        w = text.split()
        if i % 3 == 0:  # whole, in other case and punctuation, inside a long document
            w = [x.upper() + "," for x in w]
        elif i % 3 == 1:  # the last 15 per cent missing
            w = w[:len(w) - int(len(w) * 0.15)]
        else:  # half of it: must not be found
            w = w[:len(w) // 2]
        filler = corpus[i][1]
        docs.append((1000 + i, f"{filler} {' '.join(w)} {filler * 20}", "en", "s", 1))
    docs.append((2000, "A null ID with enough words, to make shingles!", "en", "s", 1))
    return docs, items


def slow(docs, items):
    out = []
    for d in docs:
        own = dc.shingles(dc.words(d[1]))
        for item_id, text in items:
            s = dc.shingles(dc.words(text))
            if s and len(s & own) >= 0.8 * len(s) - 1e-9:
                out.append((d[0], item_id, len(s & own), len(s), len(s & own) / len(s)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_chars", [dc.BLOCK_CHARS, 3000])
def test_equals_brute_force(spark, planted, block_chars):
    docs, items = planted
    from helpers_llm import TEXT
    got = dc.contained(spark.createDataFrame(docs, TEXT).repartition(3), spark.createDataFrame(items, ITEMS), block_chars=block_chars)
    want = slow(docs, items)
    assert len(want) > 20
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_a_third_of_the_items_alike(spark, planted):
    """Repeated items are collected once, and blocks keep near their size."""
    docs, items = planted
    from helpers_llm import TEXT
    many = items + [items[0]] * 3000 + [(None, None)] * 3000 + [(k, "") for k in range(3000)]
    bench = spark.createDataFrame(many, ITEMS).repartition(5)
    blocks = [index.items for index in dc._blocks(bench, 6000)]
    taken = [i for b in blocks for i in b]
    assert len(blocks) > 3 and len(taken) == len({(k, frozenset(s)) for k, s, _ in taken}) < len(items)
    assert max(c for _, _, c in taken) == 3001
    got = dc.contained(spark.createDataFrame(docs[-31:], TEXT), bench, block_chars=6000)
    assert sorted((tuple(r) for r in got.collect()), key=str) == slow(docs[-31:], many)


def test_filter_keeps_clean_rows_and_columns(spark, planted, clashing, empty):
    docs, items = planted
    from helpers_llm import TEXT
    table, bench = spark.createDataFrame(docs, TEXT), spark.createDataFrame(items, ITEMS)
    clean = [d[0] for d in docs if not slow([d], items)]
    kept = dc.decontaminated(table, bench, block_chars=3000)
    assert kept.columns == table.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(clean, key=str)
    assert dc.decontaminated(clashing, bench).columns == clashing.columns
    assert dc.decontaminated(empty, bench).collect() == []
    assert dc.contained(table, spark.createDataFrame([], ITEMS)).collect() == []
    assert dc.decontaminated(table, spark.createDataFrame([], ITEMS)).count() == len(docs)


def test_size_classes_retrieve():
    """Passages at all offsets with a fifth of the shingles gone are retrieved."""
    rng = np.random.default_rng(2)
    for size in (6, 9, 13, 20, 40, 90, 200):
        for offset in range(0, 40, 7):
            words = [f"w{x}" for x in rng.integers(0, 10**9, size)]
            index = dc.Index([(1, " ".join(words))])
            cut = size - int(0.2 * (size - 4))
            doc = [f"x{x}" for x in rng.integers(0, 10**9, 500)]
            doc[offset + 100:offset + 100] = words[:cut]
            assert index.candidates([dc.hashes(doc, dc._WordIds())]) == {(0, 0)}


def test_memory_is_that_of_a_slice():
    """A batch's texts are taken and sketched by slices, one permutation at a time."""
    import tracemalloc

    rng = np.random.default_rng(4)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 10**9, 4 + i))) for i in range(1, 9)]
    index = dc.Index(items)
    filler = [f"v{x}" for x in rng.integers(0, 10**6, 4000)]
    texts = [" ".join([*filler[k:], items[k % 8][1] if k % 50 == 0 else "", *filler[:k]]) for k in range(300)]
    tracemalloc.start()
    found = [(at, item) for at, item, *_ in index.matches(texts)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(k, k % 8 + 1) for k in range(0, 300, 50)]
    assert peak < 60e6
