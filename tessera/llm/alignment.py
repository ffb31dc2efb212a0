"""Alignment of two tokenizers over a corpus, by inverted pair bitmaps.

A is a byte-level BPE, B a SentencePiece model; both spell a text out in bytes.
The ends of both tokens cut the text into segments, and every segment is one
pair of occurrences that overlap: its A token and its B token.

Documents travel in blocks (consecutive rows of an input task). A block's index
holds, per pair of ids, the multiplicity planes of its documents: plane j is the
compressed bitmap of the documents that hold the pair a number of times with bit
j set. The planes OR-merged are the documents that hold the pair, their popcount
is the block's document count, and the counts of a pair's blocks add up to its
count in the corpus. The scores (count, and whether it is its A id's highest)
then return along the postings: a document's sum over plane j counts 2^j times.

So a pair travels once per block that holds it, however often it occurs, and a
group is a block or the blocks' counts of a pair, added up before the shuffle.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import ByteBPE, slices
from .common import process_cache, release_memory, releasing, stored

#: A block ends with the row that takes it to so many characters or documents.
BLOCK_CHARS = 6_000_000
BLOCK_DOCS = 32_768
SPACE = "▁"

RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long"


# ---------------------------------------------------------------- alignment

def _flat(tokens: list[bytes]):
    """Sizes of tokens, their bytes in a row, and where each begins there."""
    size = np.array([len(x) for x in tokens], np.int64)
    return size, np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size


def _spells(ids: np.ndarray, size: np.ndarray, flat: np.ndarray, at: np.ndarray, raw: np.ndarray) -> bool:
    """Are the bytes of the tokens ``ids``, joined, ``raw``?"""
    n = size[ids]
    end = np.cumsum(n)
    if not len(ids) or end[-1] != len(raw):
        return not len(ids) and not len(raw)
    return bool((flat[np.arange(len(raw)) + np.repeat(at[ids] - end + n, n)] == raw).all())


class Aligner:
    """Both tokenizers, and the links of a text."""

    def __init__(self, byte_file: str, pattern: str, piece_file: str):
        import sentencepiece

        self.a = ByteBPE(byte_file, pattern)
        self.b = m = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        self.a_bytes = self.a.tokens
        self.b_bytes = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace(SPACE, " ").encode()
                        for i, p in enumerate(map(m.id_to_piece, range(m.get_piece_size())))]
        if any(" " in p.lstrip(b" ").decode("utf-8", "replace") for i, p in enumerate(self.b_bytes) if not m.is_byte(i)):
            raise ValueError("pieces with a space mark inside are not supported")
        self.a_size, self.a_flat, self.a_at = _flat(self.a_bytes)
        self.b_size, self.b_flat, self.b_at = _flat(self.b_bytes)
        self.n_a, self.n_b = len(self.a_bytes), len(self.b_bytes)
        # Ids as text: an A id inside and at the end of its group's part, then the same of B.
        self.text = np.array([f"{i}{c}" for n, ends in ((self.n_a, ",|"), (self.n_b, ",;")) for c in ends for i in range(n)], object)

    def ids(self, text: str):
        """Yields ``(a, b)`` id arrays of the text's slices; None in place of one whose
        tokens don't spell it out."""
        for k, s in enumerate(slices(text)):
            own = s if k else " " + s  # later slices begin with their space
            a = self.a.ids(own, plain=True).astype(np.int64)
            b = np.array(self.b.encode(own[1:]), np.int64)  # adds the space
            raw = np.frombuffer(own.encode(), np.uint8)
            whole = _spells(a, self.a_size, self.a_flat, self.a_at, raw) and _spells(b, self.b_size, self.b_flat, self.b_at, raw)
            yield (a, b) if whole else None

    def links(self, a: np.ndarray, b: np.ndarray):
        """Per segment its pair (A id * B ids + B id), the number of groups, and the groups as text."""
        end_a, end_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        n = int(end_a[-1]) + 1
        at_a, at_b = np.zeros(n, bool), np.zeros(n, bool)
        at_a[end_a], at_b[end_b] = True, True
        ends, common = np.flatnonzero(at_a | at_b), at_a & at_b
        in_a, in_b = at_a[ends], at_b[ends]
        # Tokens that end before a segment's end: the token it lies in.
        pair = a[np.cumsum(in_a) - in_a] * self.n_b + b[np.cumsum(in_b) - in_b]
        last_a, last_b = common[end_a], common[end_b]
        # A group's A tokens stand before its B tokens: the tokens of the other side before each.
        stop_a, stop_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        size_a, size_b = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0)
        token = np.empty(len(a) + len(b), np.int64)
        token[np.arange(len(a)) + np.repeat(stop_b - size_b, size_a)] = a + last_a * self.n_a
        token[np.arange(len(b)) + np.repeat(stop_a, size_b)] = 2 * self.n_a + b + last_b * self.n_b
        return pair, len(stop_a), "".join(self.text[token].tolist())

    def aligned(self, text: str | None):
        """``(n_a, n_b, n_groups, n_links, digest, pairs, times)`` of one text: sizes, the
        digest of its groups, its distinct pairs and how often it holds each."""
        nothing = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
        if not text:
            return nothing
        n_a = n_b = n_groups = n_links = 0
        digest, before = hashlib.sha256(), b""
        pairs, times = nothing[5:]
        for ids in self.ids(text):
            if ids is None:
                return nothing
            pair, groups, spelled = self.links(*ids)
            digest.update(before + spelled[:-1].encode())
            before = b";"
            n_a, n_b, n_groups, n_links = n_a + len(ids[0]), n_b + len(ids[1]), n_groups + groups, n_links + len(pair)
            pair.sort()
            first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
            own, n = pair[first], np.diff(first, append=len(pair))
            if len(pairs):
                own, at = np.unique(np.concatenate((pairs, own)), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate((times, n)), minlength=len(own)).astype(np.int64)
            pairs, times = own, n
        return n_a, n_b, n_groups, n_links, digest.hexdigest(), pairs, times


# ---------------------------------------------------------------- postings

def bitmap(docs: np.ndarray, n_docs: int) -> bytes:
    """Compressed bitmap of sorted document places: the places (two bytes each), or
    all ``n_docs`` bits where that is shorter."""
    if 2 * len(docs) <= n_docs >> 3:
        return docs.astype("<u2").tobytes()
    bits = np.zeros(n_docs, bool)
    bits[docs] = True
    return np.packbits(bits).tobytes()


def places(raw: bytes, count: int, n_docs: int) -> np.ndarray:
    """The document places of a :func:`bitmap` of ``count`` documents."""
    if 2 * count <= n_docs >> 3:
        return np.frombuffer(raw, "<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8), count=n_docs))


def postings(pair: np.ndarray, doc: np.ndarray, times: np.ndarray, n_docs: int):
    """Yields ``(pair, documents, planes)`` from a block's (pair, document, times) entries.

    ``planes``: per plane its number of documents (four bytes) and its bitmap.
    The documents are the popcount of the OR of the planes: every times has a bit.
    """
    order = np.argsort(pair << 16 | doc)  # a pair has 47 bits at most, a place 16
    pair, doc, times = pair[order], doc[order], times[order]
    first = np.flatnonzero(np.concatenate((pair[:1] == pair[:1], pair[1:] != pair[:-1])))
    for at, to in zip(first.tolist(), [*first[1:].tolist(), len(pair)]):
        own, n = doc[at:to], times[at:to]
        planes = []
        for j in range(int(n.max()).bit_length()):
            with_bit = own[n >> j & 1 == 1]
            planes.append(struct.pack("<I", len(with_bit)) + bitmap(with_bit, n_docs))
        yield int(pair[at]), to - at, b"".join(planes)


def plane_sums(planes: bytes, n_docs: int):
    """Yields ``(2^j, document places)`` of the planes of a posting."""
    at, j = 0, 0
    while at < len(planes):
        (count,) = struct.unpack_from("<I", planes, at)
        size = 2 * count if 2 * count <= n_docs >> 3 else (n_docs + 7) // 8
        yield 1 << j, places(planes[at + 4:at + 4 + size], count, n_docs)
        at, j = at + 4 + size, j + 1


def index(docs: DataFrame, byte_file: str, pattern: str, piece_file: str,
          block_chars: int = BLOCK_CHARS, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Rows of blocks. Documents: ``place`` in the block and RESULT's columns,
    ``groups_sha256``. Postings: ``pair``, ``n_docs`` and ``planes``."""
    if block_docs > 1 << 16:
        raise ValueError("a block holds at most 65,536 documents")

    def kernel(batches):
        align = process_cache(f"align {byte_file} {piece_file}", lambda: Aligner(byte_file, pattern, piece_file))
        block, rows, entries, chars = TaskContext.get().partitionId() << 32, [], [], 0

        def batch(place, columns, sha, pair, n_docs, planes, n):
            none = lambda t: pa.nulls(n, t)
            return pa.RecordBatch.from_arrays([
                pa.array(np.full(n, block, np.int64)),
                none(pa.int32()) if place is None else pa.array(place, pa.int32()),
                *([none(pa.int64())] * 5 if columns is None else [pa.array(c, pa.int64()) for c in columns]),
                none(pa.string()) if sha is None else pa.array(sha, pa.string()),
                none(pa.int64()) if pair is None else pa.array(pair, pa.int64()),
                none(pa.int64()) if n_docs is None else pa.array(n_docs, pa.int64()),
                none(pa.binary()) if planes is None else pa.array(planes, pa.binary())], names=names)

        def close():
            cols = list(zip(*rows))
            yield batch(range(len(rows)), cols[:5], cols[5], None, None, None, len(rows))
            size = [len(p) for p, _ in entries]
            found = postings(np.concatenate([p for p, _ in entries]), np.repeat(np.arange(len(size)), size),
                             np.concatenate([t for _, t in entries]), len(rows))
            held = []
            for x in found:
                held.append(x)
                if len(held) == 16384:
                    yield batch(None, None, None, *zip(*held), len(held))
                    held = []
            if held:
                yield batch(None, None, None, *zip(*held), len(held))

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                *sizes, digest, pairs, times = align.aligned(text)
                rows.append((doc_id, *sizes, digest))
                entries.append((pairs.astype(np.int64), times))
                chars += len(text or "")
                if chars >= block_chars or len(rows) >= block_docs:
                    yield from close()
                    block, rows, entries, chars = block + 1, [], [], 0
        if rows:
            yield from close()

    schema = f"block long, place int, {RESULT}, groups_sha256 string, pair long, n_docs long, planes binary"
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(releasing(kernel), schema)


def pair_counts(rows: DataFrame, b_ids: int) -> DataFrame:
    """``(pair, count, best)``: in how many documents of the corpus each pair is
    linked, and whether that is its A id's highest count."""
    counts = rows.groupBy("pair").agg(F.sum("n_docs").alias("count"))
    counts = counts.select("pair", "count", F.floor(F.col("pair") / b_ids).alias("a_id"))
    most = counts.groupBy("a_id").agg(F.max("count").alias("most"))
    return counts.join(most, "a_id").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def aligned(docs: DataFrame, byte_file: str, pattern: str, piece_file: str, block_chars: int = BLOCK_CHARS,
            block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``, one
    row per input row.

    Every row is a document of its own, repeated rows and rows without a doc_id
    included. Null and empty texts, and texts that the tokens of A or B don't
    spell out byte by byte, have no tokens: zeros and an empty digest. Ties: every
    pair with an A id's highest count is a best one. Texts of any length are
    encoded in slices that no token crosses. An empty table gives no rows. Only
    doc_id and text are read, so further columns can't clash.
    """
    import sentencepiece

    b_ids = sentencepiece.SentencePieceProcessor(model_file=piece_file).get_piece_size()
    found = stored(index(docs, byte_file, pattern, piece_file, block_chars, block_docs), "alignment-index")
    posted = found.filter("pair IS NOT NULL").selectExpr("block AS of", "pair AS linked", "n_docs")
    scores = pair_counts(posted.selectExpr("linked AS pair", "n_docs"), b_ids)
    answers = posted.select("of", "linked").join(scores, posted["linked"] == scores["pair"]).select("of", "linked", "count", "best")

    def scored(block: pa.Table, answers: pa.Table) -> pa.Table:
        own = block.filter(pc.is_valid(block.column("place"))).sort_by("place")
        post = block.filter(pc.is_valid(block.column("pair")))
        n = own.num_rows
        best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
        known = answers.column("linked").to_numpy()
        order = np.argsort(known)
        at = order[np.searchsorted(known[order], post.column("pair").to_numpy())] if len(known) else order
        count = answers.column("count").to_numpy()[at].tolist()
        high = answers.column("best").to_numpy(zero_copy_only=False)[at].tolist()
        for planes, c, is_best in zip(post.column("planes"), count, high):
            for times, docs in plane_sums(planes.as_py(), n):
                total[docs] += c * times
                if is_best:
                    best[docs] += times
        release_memory()
        return pa.table([*[own.column(c).combine_chunks() for c in first], pa.array(best), pa.array(total),
                         own.column("groups_sha256").combine_chunks()], names=[*first, "n_best", "count_sum", "groups_sha256"])

    first = [c.split()[0] for c in RESULT.split(", ")]
    blocks = found.drop("n_docs").groupBy("block")
    return blocks.cogroup(answers.groupBy("of")).applyInArrow(
        scored, f"{RESULT}, n_best long, count_sum long, groups_sha256 string")
