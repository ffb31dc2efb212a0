"""SentencePiece encoding by a prefix table, and decoding.

A text's merge-type (BPE) encoding is determined prefix by prefix: every prefix
has one encoding, so one last token. Two tokens may stand side by side exactly
when the merges of their joined string end in these two, and a sequence whose
neighbours all may is the encoding. So the table holds, for each position, the
one vocabulary entry ending there (automaton matches) that may follow the last
token of the prefix before it; the ids are read backwards from the end.

Pieces never hold the space mark after another character, and characters
outside the vocabulary never merge, so the unit is the word. The new words of a
slice of texts are encoded together: numpy walks the pieces' trie from all their
characters at once and fills all their tables position by position. Words are
kept in a bounded table per worker; unknown characters become their UTF-8 bytes.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Slots, process_cache, releasing

SPACE = "▁"
CACHED_WORDS = 100_000
CACHED_PAIRS = 1_000_000
#: Longer words are encoded alone and not kept.
LONG_WORD = 64
#: Characters of texts whose words are gathered at once.
SLICE = 2_000_000


class Codec:
    """Encoder of one merge-type model file (identity normaliser, byte fallback)."""

    def __init__(self, model: str):
        import ahocorasick
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=model)
        self.eos = m.eos_id()
        self.ids, self.score, self.bytes = {}, {}, {}
        for i in range(m.get_piece_size()):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                self.ids[piece], self.score[piece] = i, m.get_score(i)
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces with a space mark inside are not supported")
        self.piece = {i: p for p, i in self.ids.items()}
        self.spelled = [str(i) for i in range(m.get_piece_size())]
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.known = {c for p in self.ids for c in p}
        every = "".join(re.escape(c) for c in sorted(self.known))
        self.runs = re.compile(f"[{every}]+|[^{every}]")
        #: By token id (-1: the beginning): the tokens tested after it, and whether they may follow.
        self.follow: dict[int, dict[int, bool]] = {i: {} for i in (-1, *self.piece)}
        self.tested = 0
        self.words: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}
        self.size = np.zeros(m.get_piece_size(), np.int64)
        for piece, i in self.ids.items():
            self.size[i] = len(piece)
        # The pieces' trie as arrays: (node, symbol) keys, the nodes they lead to, the token that ends in a node.
        self.symbol = np.zeros(0x110000, np.int64)
        self.symbol[[ord(c) for c in sorted(self.known)]] = np.arange(1, len(self.known) + 1)
        child, token = {}, [-1]
        for piece, i in self.ids.items():
            node = 0
            for c in piece:
                key = node << 16 | int(self.symbol[ord(c)])
                node = child.setdefault(key, len(token))
                if node == len(token):
                    token.append(-1)
            token[node] = i
        keys = np.array(sorted(child), np.int64)
        self.child, self.child_node = Slots(keys), np.array([child[k] for k in keys.tolist()], np.int64)
        self.token = np.array(token, np.int64)
        self.pair_keys, self.pair_ok = Slots(np.zeros(0, np.int64)), np.zeros(0, bool)

    def merged(self, s: str) -> list[str]:
        """Pieces left by the merges: best score first, leftmost among equals."""
        get, parts = self.score.get, list(s)
        while True:
            best, at = None, 0
            for i in range(len(parts) - 1):
                x = get(parts[i] + parts[i + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, i
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """May token ``right`` follow ``left`` (-1: begin a run)? Kept in ``follow``."""
        if self.tested >= CACHED_PAIRS:
            for tests in self.follow.values():
                tests.clear()
            self.tested = 0
        self.tested += 1
        r = self.piece[right]
        ok = self.merged(r) == [r] if left < 0 else self.merged(self.piece[left] + r) == [self.piece[left], r]
        self.follow[left][right] = ok
        return ok

    def run(self, s: str) -> tuple[int, ...]:
        """Ids of a run of known characters, by the prefix table."""
        follow = self.follow
        table: list = [None] * (len(s) + 1)  # what may follow the last token of each prefix
        last: list = [None] * (len(s) + 1)
        table[0], last[0] = follow[-1], (0, -1)
        for end, entry in self.automaton.iter(s):
            end += 1
            if table[end] is None:
                size, i = entry
                tests = table[end - size]
                if tests is not None:
                    ok = tests.get(i)
                    if ok is None:
                        ok = self.compatible(last[end - size][1], i)
                    if ok:
                        table[end], last[end] = follow[i], entry
        ids, at = [], len(s)
        while at:
            size, i = last[at]
            ids.append(i)
            at -= size
        return ids[::-1]

    def may_follow(self, left: np.ndarray, right: np.ndarray, new: dict[int, bool]) -> np.ndarray:
        """:meth:`compatible` for arrays; tests not known yet go to ``new``."""
        key = left + 1 << 16 | right
        at = self.pair_keys(key)
        ok = np.zeros(len(key), bool)
        ok[at >= 0] = self.pair_ok[at[at >= 0]]
        for k in np.flatnonzero(at < 0).tolist():
            x = int(key[k])
            if x not in new:
                new[x] = self.compatible(int(left[k]), int(right[k]))
            ok[k] = new[x]
        return ok

    def run_all(self, words: list[str]) -> list[tuple[int, ...]]:
        """:meth:`run` of many words of known characters at once."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        symbol = self.symbol[np.frombuffer("".join(words).encode("utf-32-le"), "<u4")]
        first = np.cumsum(size) - size
        start, stop = np.repeat(first, size), np.repeat(first + size, size)
        # All occurrences of pieces: walk the trie from every character.
        at, node, depth, found = np.arange(len(symbol)), np.zeros(len(symbol), np.int64), 0, []
        while len(at):
            go = self.child(node << 16 | symbol[at + depth])
            at, node = at[go >= 0], self.child_node[go[go >= 0]]
            depth += 1
            hit = self.token[node] >= 0
            found.append((at[hit], np.full(int(hit.sum()), depth), self.token[node[hit]]))
            more = at + depth < stop[at]
            at, node = at[more], node[more]
        begin, length, token = (np.concatenate(x) for x in zip(*found))
        word = np.repeat(np.arange(len(words)), size)
        slot = begin + word[begin]  # of the prefix before the piece: a word of n characters has n + 1 prefixes
        end = begin + length - start[begin]
        order = np.argsort(end.astype(np.int16), kind="stable")
        slot, length, token, cuts = slot[order], length[order], token[order], np.cumsum(np.bincount(end))
        last = np.full(len(symbol) + len(words), -2)
        last[first + np.arange(len(words))] = -1
        new: dict[int, bool] = {}
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            left = last[slot[a:b]]
            can = np.flatnonzero(left > -2)
            right = token[a:b][can]
            ok = can[self.may_follow(left[can], right, new)]
            last[slot[a:b][ok] + length[a:b][ok]] = token[a:b][ok]
        if new:
            keys = np.concatenate((self.pair_keys.keys, np.array(list(new), np.int64)))
            oks = np.concatenate((self.pair_ok, np.array(list(new.values()), bool)))
            if len(keys) > CACHED_PAIRS:
                keys, oks = keys[-len(new):], oks[-len(new):]
            order = np.argsort(keys)
            self.pair_keys, self.pair_ok = Slots(keys[order]), oks[order]
        # Backwards from the words' ends.
        which, here, got = np.arange(len(words)), first + size + np.arange(len(words)), []
        while len(which):
            t = last[here]
            got.append((which, t))
            here = here - self.size[t]
            more = last[here] >= 0
            which, here = which[more], here[more]
        which, ids = (np.concatenate(x) for x in zip(*got))
        order = np.argsort(which[::-1], kind="stable")
        ids, n = ids[::-1][order].tolist(), np.cumsum(np.bincount(which, minlength=len(words))).tolist()
        return [tuple(ids[a:b]) for a, b in zip([0, *n], n)]

    def learn(self, words: set[str]) -> None:
        """Encode the words that are not kept yet."""
        if len(self.words) > CACHED_WORDS:
            self.older, self.words = self.words, {}
        plain = []
        for w in words:
            if w not in self.words:
                if (old := self.older.get(w)) is not None:
                    self.words[w] = old
                elif len(w) <= LONG_WORD and self.known.issuperset(w):
                    plain.append(w)
                elif len(w) <= LONG_WORD:
                    self.words[w] = self.word(w)
        if plain:
            self.words.update(zip(plain, self.run_all(plain)))

    def forget(self) -> None:
        """Drop the words kept: they are a task's, the vocabulary the worker's."""
        self.words, self.older = {}, {}

    def word(self, w: str) -> tuple[int, ...]:
        """Ids of one word."""
        ids = []
        for part in self.runs.findall(w):
            if part[0] in self.known:
                ids += self.run(part)
            else:
                ids += [self.bytes[b] for b in part.encode("utf-8", "surrogatepass")]
        return tuple(ids)

    def encode_all(self, texts):
        """Yields each text's ids, the end id last."""
        waiting, size = [], 0
        for t in texts:
            waiting.append(_WORDS.findall(SPACE + t.replace(" ", SPACE)) if t else [])
            size += len(t or "")
            if size >= SLICE:
                yield from self._joined(waiting)
                waiting, size = [], 0
        yield from self._joined(waiting)

    def _joined(self, texts: list[list[str]]):
        self.learn(set().union(*texts))
        get = self.words.get
        for words in texts:
            ids: list[int] = []
            for w in words:
                ids += get(w) or self.word(w)
            ids.append(self.eos)
            yield ids

    def encode(self, text: str | None) -> list[int]:
        return next(self.encode_all([text]))

    def spell(self, ids: list[int]) -> str:
        """Decimal ids joined by one space."""
        return " ".join(map(self.spelled.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


_WORDS = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``, one row per input row.

    Null and empty texts have the end id alone and decode to the empty text.
    Repeated rows each have their row; only doc_id and text are read. ``model``
    is a path that the executors can open.
    """

    def kernel(batches):
        codec = process_cache(f"sentencepiece:{model}", lambda: Codec(model))
        for b in batches:
            n, ids_sha, decoded_sha = [], [], []
            for ids in codec.encode_all(t.as_py() for t in b.column(1)):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(codec.spell(ids).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(codec.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        codec.forget()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        releasing(kernel), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
