import random
import zlib

import pytest

from tessera.llm import langid

STEMS = {"en": ("th", "er", "on", "an", "re"), "fr": ("é", "ou", "ai", "eau", "que"), "de": ("ch", "ä", "ung", "keit", "zu"), "ja": ("かな", "漢", "字", "の", "は")}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)

    def prose(lang, n):
        return " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))

    out = [(i, prose(lang := list(STEMS)[i % 4], rng.randint(4, 200)), lang, "s", 1) for i in range(400)]
    return out + [(500, None, "en", "s", 1), (501, "", "en", "s", 1), (502, "12 34 !! \n", "fr", "s", 1), (None, prose("de", 30), "de", "s", 1),
                  (503, prose("fr", 60), None, "s", 1), (504, prose("ja", 40_000), "ja", "s", 1), (3, "x", "en", "s", 1)]


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_held_out_accuracy(spark, rows):
    from helpers_llm import TEXT
    got = {(r.doc_id, r.held_out): r for r in langid.identify(spark.createDataFrame(rows, TEXT).repartition(3)).collect()}
    assert len(got) == len(rows) - 1
    test = [r for r in rows if held_out(r[0]) and r[0] < 400]
    assert len(test) > 60
    assert sum(got[r[0], True].lang_pred == r[2] for r in test) >= 0.95 * len(test)
    for i in (500, 501, 502):
        r = got[i, held_out(i)]
        assert (r.lang_pred, r.score) == ("und", 0.0)
    assert got[503, held_out(503)].lang_pred == "fr" and got[504, held_out(504)].lang_pred == "ja" and got[None, False].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got.values())


def test_learns_only_from_allowed_rows(spark, rows):
    from helpers_llm import TEXT
    wrong = [(i, t, "zz" if held_out(i) else lang, s, n) for i, t, lang, s, n in rows]
    got = langid.identify(spark.createDataFrame(wrong, TEXT)).collect()
    assert "zz" not in {r.lang_pred for r in got}
    same = langid.identify(spark.createDataFrame(rows, TEXT)).collect()
    assert sorted(map(str, got)) == sorted(map(str, same))


def test_nothing_to_learn_from(spark, clashing, empty, corpus, rows):
    from helpers_llm import TEXT
    got = langid.identify(spark.createDataFrame([(i, t, None, s, n) for i, t, _, s, n in rows], TEXT)).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    assert langid.identify(clashing).count() == len(corpus)
    assert langid.identify(empty).collect() == []


def test_windows_cover_the_text():
    data = bytes(range(1, 256)) * 5
    w = langid.windows(data)
    assert b"".join(x[:langid.WINDOW].tobytes() for x in w).rstrip(b"\0") == data
    assert (w[:-1, langid.WINDOW:] == w[1:, :langid.REACH]).all()


def test_fast_scores_equal_the_network():
    import numpy as np
    net = langid.train(["abc def", "éé àà", "xyz"] * 4, [0, 1, 0] * 4, 2)
    x = langid.windows("some text and é".encode())
    pooled = [sum(net[f"w{k}"][j][x[:, j:j + langid.WINDOW]] for j in range(k)).max(1) for k in langid.WIDTHS]
    logit = np.tanh(np.concatenate(pooled, 1)) @ net["out"] + net["bias"]
    want = logit - np.log(np.exp(logit).sum(1, keepdims=True))
    assert np.allclose(langid.Scorer(net)(x), want, atol=1e-4)


def test_rows_of_one_id_and_many_languages(spark, rows):
    """A language with all its rows on one id, equal rows by the thousand, 300 languages."""
    from collections import Counter

    from helpers_llm import TEXT
    free = next(i for i in range(1000, 1100) if not held_out(i))
    more = [(free, f"ñandú {k} señor año", "es", "s", 1) for k in range(6000)] + [(free + 4, "один и тот же", "ru", "s", 1)] * 6000
    more += [(i, f"{chr(0x4E00 + i % 300)} rare {i}", f"x{i % 300}", "s", 1) for i in range(2000, 2600)]
    got = Counter(lang for lang, _ in langid.sample(spark.createDataFrame([*rows, *more], TEXT).repartition(5)))
    assert {"es", "ru", "en", *(f"x{k}" for k in range(300))} <= set(got)
    assert got["es"] > 0 and max(got.values()) <= langid.PER_LANGUAGE * langid.SAMPLE_WINDOWS
    drawn = langid.sample(spark.createDataFrame(more, TEXT).repartition(5), per_language=50)
    assert 45 <= sum(c == "один и тот же"[:langid.WINDOW] for _, c in drawn) <= 50
