"""Token counts of a text's sections, by offset mapping.

Each whole text is encoded once. The tokens of a byte-level vocabulary cover the
text's bytes without gaps, so the running sum of their lengths is their span.
Sections are the lines of a text, each with its line end. Tokens and sections
are two sorted lists of intervals, joined by one sorted search per text.

Rule for tokens that cross a boundary: a token counts for the section that
holds its first byte; ``n_crossing`` says how many of them reach beyond it. So
a document's counts sum to its number of tokens.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import process_cache

#: Texts are given out in batches of about this many sections.
SLICE = 50_000


class Encoder:
    def __init__(self, ranks: str, pattern: str):
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.size = np.zeros(max(table.values()) + 1, np.int64)
        for token, i in table.items():
            self.size[i] = len(token)

    def ids(self, text: str) -> np.ndarray:
        return np.asarray(self.encoding.encode_to_numpy(text, disallowed_special=()), np.int64)


def sections(text: str, encoder: Encoder) -> tuple[np.ndarray, ...]:
    """``(char_start, char_end, n_tokens, n_crossing)`` of each section of a text."""
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    start = np.concatenate(([0], np.flatnonzero(data[:-1] == 10) + 1)) if len(data) else np.zeros(1, np.int64)
    stop = np.concatenate((start[1:], [len(data)]))
    size = encoder.size[encoder.ids(text)]
    token_end = np.cumsum(size)
    owner = np.searchsorted(start, token_end - size, "right") - 1
    count = np.bincount(owner, minlength=len(start))
    crossing = np.bincount(owner[token_end > stop[owner]], minlength=len(start))
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return chars[start], chars[stop], count, crossing


def counted(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``(doc_id, section, char_start, char_end, n_tokens, n_crossing)``.

    One row per line of each input row, numbered from 0, spans in code points
    with exclusive ends. Null and empty texts have one empty section with no
    tokens. Repeated rows repeat; a null doc_id stays null; only doc_id and text
    are read. ``ranks`` is a path that the executors can open.
    """
    schema = "doc_id long, section long, char_start long, char_end long, n_tokens long, n_crossing long"

    def kernel(batches):
        encoder = process_cache(f"tokens:{ranks}", lambda: Encoder(ranks, pattern))

        def give(ids, rows, got):
            n = [len(g[0]) for g in got]
            columns = [np.concatenate([g[k] for g in got]).astype(np.int64) for k in range(4)]
            return pa.RecordBatch.from_arrays(
                [ids.take(pa.array(np.repeat(rows, n), pa.int64())), pa.array(np.concatenate([np.arange(x) for x in n]).astype(np.int64)),
                 *[pa.array(c) for c in columns]], names=["doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing"])

        for b in batches:
            rows, got, size = [], [], 0
            for i, t in enumerate(b.column(1)):
                rows.append(i)
                got.append(sections(t.as_py() or "", encoder))
                size += len(got[-1][0])
                if size >= SLICE:
                    yield give(b.column(0), rows, got)
                    rows, got, size = [], [], 0
            if rows:
                yield give(b.column(0), rows, got)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(kernel, schema)
