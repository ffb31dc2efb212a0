"""Byte-level BPE of a tokenizer file, as numpy ids, for texts of any length."""

from __future__ import annotations

import json
import re

import numpy as np

#: A text may be cut before such a space: it begins a new word, whatever stands
#: before it, so no token lies across the cut.
CUT = re.compile(r"(?<=\S) (?=\S)")
SLICE = 1 << 18


def slices(text: str, size: int = SLICE):
    """Pieces of ``text`` of about ``size`` characters, cut before single spaces
    between other characters; a stretch without one stays whole."""
    at = 0
    while len(text) - at > size:
        cut = CUT.search(text, at + size)
        if not cut:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


def byte_of_symbol() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable
    bytes for themselves, the others in order from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """Encoder of a byte-level BPE file (no normaliser, no prefix space).

    The merges run in tiktoken, which takes them from the file's vocabulary; that
    is the same encoding only if merge k makes token 256 + k, which is checked.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        of = byte_of_symbol()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(map(of.__getitem__, s)): i for s, i in vocab.items() if s not in self.special}
        for k, m in enumerate(merges):
            pair = m if isinstance(m, list) else m.split(" ")
            if vocab["".join(pair)] != 256 + k:
                raise ValueError("the vocabulary is not in the order of its merges")
        self.tokens = [b""] * (1 + max(*ranks.values(), *self.special.values()))
        for s, i in (*ranks.items(), *((s.encode(), i) for s, i in self.special.items())):
            self.tokens[i] = s
        self.encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)

    def ids(self, text: str, plain: bool = False) -> np.ndarray:
        """Ids of a text. Special tokens' strings in it are these tokens, or ordinary
        text where ``plain``."""
        allowed = set() if plain else "all"
        return self.encoding.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())
