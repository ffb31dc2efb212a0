"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model.

Character n-grams of all trusted documents (labels: quality 1, not toxic) are
counted per language; continuation counts, discounts and back-off weights are
joins and grouped counts over the sharded count tables. Documents travel in
blocks (consecutive rows of an input task, about ``BLOCK_CHARS`` characters
each whatever their ids and texts, packed as compressed Arrow), each block asks
for its distinct n-grams once, the requests are joined with the model's shards,
and the answers go back to their block. So the shuffled rows are a block's
distinct n-grams, not the corpus' tokens, and no table of the model has to fit
into a task or the driver. The packed blocks are written once, bucketed by
block: the requests and the answers travel to them, the texts stay where they are.

Characters are UTF-16 code units (one for nearly all, two for the rarest), so that
four of them fit into a long and no two n-grams share counts.

A document's score is its mean negative log probability per character (nats),
smoothed by ``PRIOR_CHARS`` characters at its language's trusted median so that
a few words do not decide. The threshold of a language lies
``REACH`` times the distance from the trusted scores' median to their 95 %
quantile beyond the median.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Slots, WorkTables, release_memory, releasing, stored

ORDER = 4
#: Bits of a symbol, a UTF-16 code unit; 0 pads a document's beginning, and U+0000 is
#: counted as the noncharacter U+FFFF.
BITS = 16
BLOCK_CHARS = 48_000_000
#: n-grams are cut from slices of this many characters (bounds a task's memory).
SLICE = 1 << 20
#: A block's rows are packed in pieces of about this many characters, and each row
#: counts as ROW_CHARS more, so that rows without text fill a block too.
PIECE = 1 << 21
ROW_CHARS = 64
PRIOR_CHARS = 40
REACH = 4.0
#: Scores are binned to this width for the exact quantiles of the bins.
BIN = 0.001
SALTS = 64


# ---------------------------------------------------------------- n-grams

def symbols(text: str) -> np.ndarray:
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")
    return np.where(units == 0, np.uint16(0xFFFF), units)


def ngrams(texts: list[str | None], order: int):
    """Yields ``(owner, gram)`` arrays: each character's n-gram (its own symbol in
    the lowest bits) and the index of its text, over whole texts in slices."""
    pieces, owners, size = [], [], 0

    def flush():
        s = np.concatenate(pieces)
        gram = s.copy()
        for k in range(1, order):
            gram[k:] |= s[:-k] << (BITS * k)
        lengths = [len(p) for p in pieces]
        starts = np.cumsum([0, *lengths[:-1]])
        body = np.ones(len(s), bool)
        for k in range(order - 1):
            body[starts + k] = False
        return np.repeat(np.array(owners), lengths)[body], gram[body]

    for i, t in enumerate(texts):
        if not t:
            continue
        s = np.concatenate((np.zeros(order - 1, np.uint16), symbols(t)))
        for at in range(0, len(s) - order + 1, SLICE):
            piece = s[at:at + SLICE + order - 1].astype(np.int64)
            pieces.append(piece)
            owners.append(i)
            size += len(piece)
            if size >= SLICE:
                yield flush()
                pieces, owners, size = [], [], 0
    if pieces:
        yield flush()


# ---------------------------------------------------------------- blocks

def _packed(docs: DataFrame, block_chars: int) -> DataFrame:
    """``(block, ids, blob)``: each task's rows, in order, as pieces of blocks: the
    distinct doc_ids and compressed Arrow. No block passes ``block_chars`` by more
    than one row."""

    def pack(batches):
        first, chars = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            size = pc.fill_null(pc.utf8_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + ROW_CHARS
            start = chars + np.cumsum(size) - size
            chars = int(start[-1] + size[-1])
            block, piece = start // block_chars, start // PIECE
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(piece) != 0)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                own = t.slice(low, high - low).combine_chunks()
                sink = pa.BufferOutputStream()
                options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
                with pa.ipc.new_stream(sink, own.schema, options=options) as out:
                    out.write_table(own)
                ids = pc.unique(own.column("doc_id").drop_null())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([first + int(block[low])], pa.int64()), pa.array([ids.to_pylist()], pa.list_(pa.int64())),
                     pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "ids", "blob"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.coalesce("lang", F.lit("und")).alias("lang")).mapInArrow(
        releasing(pack), "block long, ids array<long>, blob binary")


def _unpacked(packed: pa.Table):
    for blob in packed.column("blob"):
        yield pa.ipc.open_stream(blob.as_buffer()).read_all()


def _by_language(t: pa.Table):
    lang = np.array(t.column("lang").to_pylist(), object)
    for k in sorted(set(lang)):
        yield k, np.flatnonzero(lang == k), t.filter(pa.array(lang == k)).column("text").to_pylist()


def _merge(parts, gram, count):
    """Adds counts by gram; ``parts`` is the (grams, counts) so far."""
    g, inv = np.unique(np.concatenate((parts[0], gram)), return_inverse=True)
    return g, np.bincount(inv, weights=np.concatenate((parts[1], count)), minlength=len(g)).astype(np.int64)


def requests(packed: DataFrame, trusted: DataFrame, order: int) -> DataFrame:
    """``(block, lang, gram, n)``: each block's distinct n-grams with their count in
    its trusted documents."""

    def kernel(docs: pa.Table, ids: pa.Table) -> pa.Table:
        good = np.unique(ids.column("doc_id").to_numpy())
        found: dict[str, tuple] = {}
        for t in _unpacked(docs):
            known = np.array([x is not None and bool(len(good)) and good[min(np.searchsorted(good, x), len(good) - 1)] == x
                              for x in t.column("doc_id").to_pylist()], bool)
            for lang, rows, texts in _by_language(t):
                for owner, gram in ngrams(texts, order):
                    own = known[rows][owner]
                    so_far = found.get(lang, (np.zeros(0, np.int64),) * 2)
                    so_far = _merge(so_far, *np.unique(gram[own], return_counts=True))
                    rest = np.unique(gram[~own])
                    found[lang] = _merge(so_far, rest, np.zeros(len(rest), np.int64))
        block = docs.column("block")[0].as_py() if docs.num_rows else 0
        release_memory()
        return pa.concat_tables([pa.table({
            "block": pa.array(np.full(len(g), block, np.int64)), "lang": pa.array([lang] * len(g), pa.string()),
            "gram": pa.array(g), "n": pa.array(n)}) for lang, (g, n) in found.items()] or [pa.table({
                "block": pa.array([], pa.int64()), "lang": pa.array([], pa.string()),
                "gram": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})])

    return packed.select("block", "blob").groupBy("block").cogroup(trusted.groupBy("block")).applyInArrow(
        kernel, "block long, lang string, gram long, n long")


# ---------------------------------------------------------------- the model

def _low(column, k: int):
    return F.col(column).bitwiseAND(F.lit((1 << BITS * k) - 1)) if BITS * k < 64 else F.col(column)


def _with_language(rows: DataFrame, facts: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined with a few facts per language. Dealt by language and a salt, so
    that a language with most of the rows is not one task."""
    facts = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(*[c for c in rows.columns if c != "lang"]), F.lit(SALTS)).cast("int")
    return rows.withColumn("salt", salt).join(facts, ["lang", "salt"], how).drop("salt")


def kneser_ney(counts: DataFrame, order: int, work: WorkTables) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """Modified Kneser-Ney tables from highest-order counts ``(lang, gram, n)``.

    Returns per order 1..n the seen grams' probabilities ``(lang, gram, p)`` and
    the contexts' back-off weights ``(lang, ctx, g)``, and ``(lang, p0)``, the
    uniform distribution over the language's symbols and one unseen one.
    """
    tables = {order: counts}
    for k in range(order - 1, 0, -1):  # continuation counts: distinct symbols to the left
        tables[k] = tables[k + 1].groupBy("lang", _low("gram", k).alias("gram")).agg(F.count("*").alias("n"))
    p0 = tables[1].groupBy("lang").agg((1 / (F.count("*") + 1.0)).alias("p0"))
    probabilities, weights = [], []
    for k in range(1, order + 1):
        of = [F.sum((F.col("n") == i).cast("long")).cast("double") for i in (1, 2, 3, 4)]
        d = tables[k].groupBy("lang").agg(*[c.alias(f"n{i + 1}") for i, c in enumerate(of)])
        y = F.expr("CASE WHEN n1 + 2 * n2 > 0 THEN n1 / (n1 + 2 * n2) ELSE 0.5D END")
        d = d.withColumn("y", y).select("lang", *[
            F.expr(f"CASE WHEN n{i} > 0 THEN least({i}D, greatest(0.1D, {i} - {i + 1} * y * n{i + 1} / n{i})) ELSE 0.5D END").alias(f"d{i}")
            for i in (1, 2, 3)])
        own = _with_language(tables[k], d).select(
            "lang", "gram", F.shiftrightunsigned("gram", BITS).alias("ctx"), F.col("n").cast("double").alias("n"),
            F.expr("CASE n WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END").alias("d"))
        context = own.groupBy("lang", "ctx").agg(F.sum("n").alias("c"), F.sum("d").alias("mass"))
        context = work.stored(context.select("lang", "ctx", "c", (F.col("mass") / F.col("c")).alias("g")), f"kn-ctx{k}")
        own = own.join(context, ["lang", "ctx"])
        if k == 1:
            own = _with_language(own, p0).withColumnRenamed("p0", "lower")
        else:
            below = probabilities[-1].select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower"))
            own = own.withColumn("suffix", _low("gram", k - 1)).join(below, ["lang", "suffix"])
        probabilities.append(work.stored(own.select(
            "lang", "gram", ((F.col("n") - F.col("d")) / F.col("c") + F.col("g") * F.col("lower")).alias("p")), f"kn-p{k}"))
        weights.append(context.select("lang", "ctx", "g"))
    return probabilities, weights, p0


def scored_grams(grams: DataFrame, model, order: int) -> DataFrame:
    """``(lang, gram, nll)`` of distinct ``(lang, gram)`` rows; languages without a model drop out."""
    probabilities, weights, p0 = model
    out = _with_language(grams, p0).withColumnRenamed("p0", "q")
    for k in range(1, order + 1):
        p = probabilities[k - 1].select("lang", F.col("gram").alias("low"), "p")
        w = weights[k - 1]
        out = (out.withColumn("low", _low("gram", k)).join(p, ["lang", "low"], "left")
               .withColumn("ctx", F.shiftrightunsigned("low", BITS)).join(w, ["lang", "ctx"], "left")
               .select("lang", "gram", F.coalesce("p", F.coalesce("g", F.lit(1.0)) * F.col("q")).alias("q")))
    return out.select("lang", "gram", (-F.log("q")).alias("nll"))


class _Lookup:
    """Values of int64 keys that are all present."""

    def __init__(self, keys, values):
        order = np.argsort(keys)
        self.slots, self.values = Slots(keys[order]), values[order]

    def __call__(self, x):
        return self.values[self.slots(x)]


def document_scores(packed: DataFrame, answers: DataFrame, order: int) -> DataFrame:
    """``(doc_id, lang, n_chars, nll)``: summed negative log probability per row;
    null where the language has no model."""

    def kernel(docs: pa.Table, got: pa.Table) -> pa.Table:
        lang = np.array(got.column("lang").to_pylist(), object)
        gram, nll = got.column("gram").to_numpy(), got.column("nll").to_numpy()
        of = {k: _Lookup(gram[lang == k], nll[lang == k]) for k in set(lang)}
        out = []
        for t in _unpacked(docs):
            for k, rows, texts in _by_language(t):
                total = np.zeros(len(texts))
                if k in of:
                    for owner, g in ngrams(texts, order):
                        total += np.bincount(owner, weights=of[k](g), minlength=len(texts))
                out.append(pa.table({
                    "doc_id": t.column("doc_id").take(pa.array(rows)).combine_chunks(), "lang": pa.array([k] * len(rows), pa.string()),
                    "n_chars": pa.array([len(x or "") for x in texts], pa.int64()),
                    "nll": pa.array(total if k in of else [None] * len(rows), pa.float64())}))
        release_memory()
        return pa.concat_tables(out) if out else pa.table({
            "doc_id": pa.array([], pa.int64()), "lang": pa.array([], pa.string()), "n_chars": pa.array([], pa.int64()), "nll": pa.array([], pa.float64())})

    return packed.select("block", "blob").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        kernel, "doc_id long, lang string, n_chars long, nll double")


# ---------------------------------------------------------------- classifier

def _quantiles(scores: DataFrame, at: dict[str, float]) -> DataFrame:
    """Per language, upper edges of the bins that hold the given quantiles: from
    counts per bin, so that only a language's bins meet in one group."""
    bins = scores.groupBy("lang", F.floor(F.col("score") / BIN).alias("bin")).agg(F.count("*").alias("n"))
    total = bins.groupBy("lang").agg(F.sum("n").alias("all"))
    upto = bins.join(total, "lang").selectExpr(
        "lang", "bin", "all", "sum(n) OVER (PARTITION BY lang ORDER BY bin) AS upto")
    return upto.groupBy("lang").agg(*[
        (F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("bin") + 1)) * BIN).alias(name) for name, q in at.items()])


def classify(docs: DataFrame, labels: DataFrame, order: int = ORDER, reach: float = REACH,
             block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(doc_id, lang, n_chars, log_ppl, threshold, keep)``, one row per input row.

    Trusted text: rows of ``docs`` whose doc_id has a label quality 1 and no
    toxic 1. Null and empty texts score their language's median and are kept;
    a null language counts as ``und``; languages without trusted text have no
    score and are kept. Rows with a null doc_id are scored and never trusted;
    repeated rows are each scored (and each counted, if trusted). Only doc_id,
    text and lang are read, so further columns can't clash.
    """
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    good = good.filter("doc_id IS NOT NULL AND quality = 1 AND toxic = 0").select("doc_id")
    with WorkTables(docs.sparkSession) as work:
        packed = work.bucketed(_packed(docs, block_chars), "kn-blocks", "block")  # both passes meet the same blocks
        ids = packed.select(F.explode("ids").alias("doc_id"), F.col("block").alias("of")).join(good, "doc_id", "left_semi").toDF("doc_id", "block")
        asked = work.stored(requests(packed, ids, order), "kn-requests")
        corpus = work.stored(asked.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "kn-grams")
        model = kneser_ney(corpus.filter("n > 0"), order, work)
        answers = asked.select("block", "lang", "gram").join(scored_grams(corpus.select("lang", "gram"), model, order), ["lang", "gram"])
        scores = stored(document_scores(packed, answers, order), "kn-scores")

    trusted = scores.join(good, "doc_id", "left_semi").filter("n_chars > 0 AND nll IS NOT NULL")
    middle = _quantiles(trusted.select("lang", (F.col("nll") / F.col("n_chars")).alias("score")), {"mid": 0.5})
    smooth = (F.col("nll") + PRIOR_CHARS * F.col("mid")) / (F.col("n_chars") + PRIOR_CHARS)
    trusted = _with_language(trusted, middle).select("lang", smooth.alias("score"))
    limits = _quantiles(trusted, {"q50": 0.5, "q95": 0.95}).join(middle, "lang")
    return _with_language(scores, limits, "left").select(
        "doc_id", "lang", "n_chars", smooth.alias("log_ppl"),
        (F.col("q50") + reach * (F.col("q95") - F.col("q50") + BIN)).alias("threshold")).withColumn(
            "keep", F.coalesce(F.col("log_ppl") <= F.col("threshold"), F.lit(True)))
