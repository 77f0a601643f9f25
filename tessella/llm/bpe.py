"""Byte-level BPE encoding and decoding (operator 1).

The tiktoken library encodes with a local rank file. A long text is cut at safe boundaries first: places where
the splitting pattern always ends a match, so the ids of the parts are the ids of the whole. Decoding works on
raw bytes, so ids whose bytes are no valid UTF-8 come back unharmed.

Defined cases: a null text counts as the empty text (no ids, no bytes); repeated rows are encoded each; an empty
table gives no rows; a null id column is passed on as null. Columns other than the two named are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm.common import batches_of, text_of

#: Characters of one part of a long text that is handed to the encoder at once.
PART = 1 << 15
#: White space of one run that the library's pattern takes without exhausting its stack.
RUN = 1 << 11

_ROWS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

#: A boundary before white space that follows something else, or between letters, digits and signs where no
#: match of the pattern can go on: a contraction only ever joins a sign to the letters after it.
_SAFE = re.compile(r"(?<=\S)(?=\s)|(?<=[A-Za-z])(?=[0-9!-&(-/:-@\[-`{-~])|(?<=[0-9])(?=[A-Za-z!-/:-@\[-`{-~])|(?<=[!-&(-/:-@\[-`{-~])(?=[0-9])")
_SPACES = re.compile(rf"[^\S\x1c-\x1f]{{{RUN},}}")
#: Characters that Python takes for white space and the pattern does not.
_ODD = re.compile("[\x1c-\x1f]")


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a local rank file: a base64 token and its rank in each line."""
    lines = Path(path).read_bytes().splitlines()
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line)}


def safe_parts(text: str, size: int = PART) -> list[str]:
    """Cuts a text into parts of about that size at safe boundaries only; joined, they give the text."""
    if len(text) <= size:
        return [text]
    odd = bool(_ODD.search(text))
    parts, start = [], 0
    while len(text) - start > size:
        cut = None
        for m in _SAFE.finditer(text, start + size):
            # next to a character the two white-space rules disagree on, no cut is sure
            if not odd or not _ODD.search(text[max(0, m.start() - 1) : m.start() + 1]):
                cut = m.start()
                break
        if cut is None:
            break
        parts.append(text[start:cut])
        start = cut
    parts.append(text[start:])
    return parts


class ByteBpe:
    """Encodes texts to ids and ids to bytes with the ranks of one file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.merges = ranks

    def encode(self, text: str) -> np.ndarray:
        """The ids of the whole text, as the library gives them without special tokens."""
        if len(text) >= RUN and _SPACES.search(text):
            return self._encode_spaced(text)
        if len(text) <= PART:
            return np.array(self.encoding.encode_ordinary(text), np.uint32)
        return np.concatenate([np.array(self.encoding.encode_ordinary(p), np.uint32) for p in safe_parts(text)])

    def _encode_spaced(self, text: str) -> np.ndarray:
        """As encode, for texts with very long runs of white space, on which the library's matcher overflows.

        The pattern gives such a run, but for its last character if something follows, as one match; the run is
        merged here as one piece, and the last character goes with what follows.
        """
        out, at = [], 0
        for m in _SPACES.finditer(text):
            end = m.end() - (m.end() < len(text))
            if m.start() > at:
                out += [self.encode_plain(p) for p in safe_parts(text[at : m.start()])]
            out.append(self.merge(text[m.start() : end].encode()))
            at = end
        if at < len(text):
            out += [self.encode_plain(p) for p in safe_parts(text[at:])]
        return np.concatenate(out)

    def encode_plain(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), np.uint32)

    def merge(self, piece: bytes) -> np.ndarray:
        """The ids of one match: the pair of lowest rank merges first, the leftmost of equal ones."""
        import heapq

        n, ranks = len(piece), self.merges
        if piece in ranks:
            return np.array([ranks[piece]], np.uint32)
        end, after, before, alive = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= n or end[j] != stop:
                continue
            alive[j], end[i], after[i] = False, end[j], after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and (b := after[a]) < n and (r := ranks.get(piece[a : end[b]])) is not None:
                    heapq.heappush(heap, (r, a, end[b]))
        return np.array([ranks[piece[i : end[i]]] for i in range(n) if alive[i]], np.uint32)

    def decode(self, ids) -> bytes:
        """The raw bytes of the ids."""
        return self.encoding.decode_bytes(ids.tolist() if isinstance(ids, np.ndarray) else list(ids))


def encode_decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and decoded bytes.

    The ids are decoded again from what was encoded. One narrow pass: no shuffle, each task holds one batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(read_ranks(ranks_path), pattern)

        def rows():
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids = bpe.encode(text)
                    yield doc_id, len(ids), ids.astype("<u4").tobytes(), bpe.decode(ids)

        yield from batches_of(rows(), _ROWS)

    picked = df.select(df[id_col].cast("long").alias("doc_id"), text_of(df, text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")
