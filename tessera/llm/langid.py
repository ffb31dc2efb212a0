"""Language identification: a byte convolutional network trained in numpy.

Filters over 2, 3 and 4 bytes, the maximum of each filter over a window of
``WINDOW`` bytes, and a softmax. Training takes a bounded sample: up to
``PER_LANGUAGE`` documents of each language (``SAMPLE_DOCUMENTS`` in all), chosen by
a hash of their ids, with up to ``SAMPLE_WINDOWS`` windows of each. Prediction
reads every window of every whole text, in batches; a text's language is the
one with the highest mean log probability over its windows, weighted by bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
PER_LANGUAGE = 400
#: Documents learnt from in all; languages beyond it give one each.
SAMPLE_DOCUMENTS = 80_000
SAMPLE_WINDOWS = 4
EPOCHS = 6
BATCH = 64
RATE = 0.01
SEED = 11
#: Windows that a task scores at once, and those it gathers before.
SLICE, BUFFER = 64, 4096
REACH = max(WIDTHS) - 1


# ---------------------------------------------------------------- the network

def windows(data: bytes) -> np.ndarray:
    """(n, WINDOW + REACH) bytes: consecutive windows, each with the bytes that its
    last filters reach into; the end is padded by zeros."""
    n = max(1, -(-len(data) // WINDOW))
    padded = np.zeros(n * WINDOW + REACH, np.uint8)
    padded[:len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW + REACH)[::WINDOW]


def train(texts: list[str], labels: list[int], n_labels: int) -> dict[str, np.ndarray]:
    """Weights ``w<width>`` (width, 256, FILTERS), ``out`` and ``bias``; deterministic."""
    rng = np.random.default_rng(SEED)
    x = np.concatenate([windows(t.encode("utf-8", "surrogatepass")[:WINDOW]) for t in texts]).astype(np.int64)
    y = np.array(labels)
    net = {f"w{k}": rng.normal(0, 0.3, (k, 256, FILTERS)) for k in WIDTHS}
    net["out"], net["bias"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), n_labels)), np.zeros(n_labels)
    first = {k: np.zeros_like(v) for k, v in net.items()}
    second = {k: np.zeros_like(v) for k, v in net.items()}
    step = 0
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(x)), -(-len(x) // BATCH)):
            b, where, pooled = x[rows], {}, []
            for k in WIDTHS:
                score = sum(net[f"w{k}"][j][b[:, j:j + WINDOW]] for j in range(k))
                where[k] = score.argmax(1)
                pooled.append(np.take_along_axis(score, where[k][:, None], 1)[:, 0])
            pooled = np.concatenate(pooled, 1)
            act = np.tanh(pooled)
            logit = act @ net["out"] + net["bias"]
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            grad = {"out": act.T @ p, "bias": p.sum(0)}
            back = p @ net["out"].T * (1 - act * act)
            for i, k in enumerate(WIDTHS):
                g = np.zeros_like(net[f"w{k}"])
                own = back[:, i * FILTERS:(i + 1) * FILTERS]
                column = np.broadcast_to(np.arange(FILTERS), own.shape)
                for j in range(k):  # only the maximum's bytes get a gradient
                    np.add.at(g[j], (np.take_along_axis(b, where[k] + j, 1), column), own)
                grad[f"w{k}"] = g
            step += 1
            for k, g in grad.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                net[k] -= RATE * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return net


class Scorer:
    """Log probabilities of windows. The weights of two neighbouring bytes are added
    up front, side by side for all widths, so a position needs two look-ups."""

    def __init__(self, net: dict[str, np.ndarray]):
        self.out, self.bias = net["out"], net["bias"]
        w2, w3, w4 = (net[f"w{k}"].astype(np.float32) for k in WIDTHS)

        def pairs(a, b):
            return (a[:, None, :] + b[None, :, :]).reshape(65536, -1)

        none = np.zeros_like(w3[2])
        self.head = np.concatenate([pairs(w[0], w[1]) for w in (w2, w3, w4)], 1)
        self.tail = np.concatenate([pairs(w3[2], none), pairs(w4[2], w4[3])], 1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.intp)
        pair = x[:, :-1] << 8 | x[:, 1:]
        score = self.head.take(pair[:, :WINDOW], axis=0, mode="clip")
        score[:, :, FILTERS:] += self.tail.take(pair[:, 2:2 + WINDOW], axis=0, mode="clip")
        logit = np.tanh(score.max(1).astype(np.float64)) @ self.out + self.bias
        logit -= logit.max(1, keepdims=True)
        return logit - np.log(np.exp(logit).sum(1, keepdims=True))


def predict(texts: list[str | None], languages: list[str], scorer: Scorer | None) -> list[tuple[str, float]]:
    """``(language, score)`` of each whole text."""
    out: list = [("und", 0.0)] * len(texts)
    if scorer is None:
        return out
    total = np.zeros((len(texts), len(languages)))
    seen = np.zeros(len(texts), bool)
    waiting, owner, n = [], [], 0

    def flush():
        x = np.concatenate(waiting)
        who = np.repeat(owner, [len(w) for w in waiting])
        size = np.minimum((x != 0).sum(1), WINDOW)[:, None]
        np.add.at(total, who, np.concatenate([scorer(x[at:at + SLICE]) for at in range(0, len(x), SLICE)]) * size)

    for i, t in enumerate(texts):
        if t and any(c.isalpha() for c in t):
            seen[i] = True
            w = windows(t.encode("utf-8", "surrogatepass"))
            for at in range(0, len(w), BUFFER):
                waiting.append(w[at:at + BUFFER])
                owner.append(i)
                n += len(waiting[-1])
                if n >= BUFFER:
                    flush()
                    waiting, owner, n = [], [], 0
    if waiting:
        flush()
    for i in np.flatnonzero(seen):
        mean = total[i] / max(1, len((texts[i] or "").encode("utf-8", "surrogatepass")))
        p = np.exp(mean - mean.max())
        out[i] = (languages[int(p.argmax())], float(p.max() / p.sum()))
    return out


# ---------------------------------------------------------------- on tables

def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, rows: int = SAMPLE_DOCUMENTS) -> list[tuple[str, str]]:
    """``(lang, window)`` rows to learn from: at most ``per_language`` documents of every
    language, fewer where all languages together would pass ``rows`` documents.

    Rows are drawn one by one, by a hash of the row and its place, so that equal ids
    or texts don't come and go together: what is collected follows the bound
    however the rows repeat.
    """
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND length(text) > 0 AND doc_id IS NOT NULL")
    sizes = known.groupBy("lang").count().collect()  # the classes of the model
    if not sizes:
        return []
    per_language = max(1, min(per_language, rows // len(sizes)))
    # Twice the wanted share by hash, then the smallest hashes.
    shares = [(r["lang"], min(1 << 40, int((1 << 40) * 2.0 * per_language / r["count"]) if r["count"] > 8 * per_language else 1 << 40)) for r in sizes]
    share = F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, share long"))
    draw = F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(1 << 40))
    cuts = F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.lit(SAMPLE_WINDOWS - 1)),
        lambda k: F.substring("text", F.floor(F.length("text") * k / SAMPLE_WINDOWS).cast("int") + 1, F.lit(WINDOW))))
    drawn = known.withColumn("draw", draw).join(share, "lang").filter("draw < share").select("lang", "draw", "doc_id", cuts.alias("cuts")).collect()
    drawn.sort(key=lambda r: (r.lang, r.draw, r.doc_id, r.cuts))
    taken: dict[str, int] = {}
    out = []
    for r in drawn:
        taken[r.lang] = taken.get(r.lang, 0) + 1
        if taken[r.lang] <= per_language:
            out += [(r.lang, c) for c in r.cuts if c]
    return out


def identify(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``, one row per input row.

    Learns from rows with a lang, a text and a doc_id whose crc32 (of its decimal
    text) modulo 4 is not 2; held_out says that it is 2 (false for a null id).
    Null texts and those without a letter are ``und`` with score 0, as are all
    where there is nothing to learn from. Prediction reads the text alone;
    repeated rows each have their row, further columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    rows = sample(docs.filter(~held_out))
    languages = sorted({lang for lang, _ in rows})
    net = train([t for _, t in rows], [languages.index(lang) for lang, _ in rows], len(languages)) if rows else None

    def kernel(batches):
        scorer = Scorer(net) if net else None
        for b in batches:
            got = predict(b.column(2).to_pylist(), languages, scorer)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(
        kernel, "doc_id long, held_out boolean, lang_pred string, score double")
