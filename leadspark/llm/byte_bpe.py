"""Byte-level BPE encoding and decoding as a monoid reduced over a tree.

Two levels use the same plan: halves are encoded on their own, and two neighbours are joined by redoing a window
around their border that grows until what lies outside is proven unchanged.

* Text into pieces. A piece is one match of the pattern, found from left to right without looking back, and its
  match needs at most ``GUARD`` further characters. So in a left half every piece that ends ``GUARD`` characters
  before the border stands; from the first border inside the window that is also a border of the right half, the
  right half's pieces stand.
* Piece into tokens. A token sequence is the encoding of its bytes exactly if each two neighbouring tokens are the
  encoding of their joined bytes. So a window of tokens around the border is encoded anew and is large enough once
  the tokens at its ends fit the tokens outside.

Short leaves are encoded directly: the pair of lowest rank, leftmost first, merges until none is left.
Decoding joins the bytes of blocks of ids pairwise up a tree.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadspark.llm.arrow import with_columns

GUARD = 4  # characters after a match that can change it; the pattern needs two
LEAF_CHARS = 8192  # longer texts are cut in halves
LEAF_BYTES = 48  # longer pieces are cut in halves
LEAF_IDS = 4096  # ids that are decoded at once
CACHE_PIECES = 300_000  # encodings of pieces that a task remembers; it then starts afresh


class _Encodings(dict):
    """Piece to little-endian ids; forgets everything when full, which changes no result."""

    def __init__(self, encode):
        super().__init__()
        self._encode = encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.clear()
        got = np.asarray(self._encode(piece.encode("utf-8")), dtype="<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = got
        return got


class ByteBpe:
    """Encoder and decoder for one table of ranks and one pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES):
        self.ranks = ranks
        self.leaf_chars, self.leaf_bytes = max(leaf_chars, 1), max(leaf_bytes, 1)
        self.find = regex.compile(pattern).findall
        self.token = {i: b for b, i in ranks.items()}
        self.encoded = _Encodings(self.encode_piece)
        self._fits: dict[tuple[int, int], bool] = {}

    # ---- bytes of one piece ----

    def merge(self, data: bytes) -> list[int]:
        """Encode directly."""
        ranks = self.ranks
        if data in ranks:
            return [ranks[data]]
        if len(data) > 2 * self.leaf_bytes:
            return self._merge_long(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        joined = [ranks.get(data[i : i + 2]) for i in range(len(data) - 1)]
        while True:
            best, at = None, -1
            for i, r in enumerate(joined):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return [ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joined[at]
            if at:
                joined[at - 1] = ranks.get(parts[at - 1] + parts[at])
            if at < len(joined):
                joined[at] = ranks.get(parts[at] + parts[at + 1])

    def _merge_long(self, data: bytes) -> list[int]:
        """As ``merge``, with a heap: for windows that had to grow far."""
        ranks, n = self.ranks, len(data)
        end = list(range(1, n + 1))  # of the part that starts here; 0 once it is swallowed
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue
            end[middle], end[i] = 0, stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if i and (r := ranks.get(data[before[i] : stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def fits(self, a: int, b: int) -> bool:
        """Whether the two tokens are the encoding of their joined bytes."""
        known = self._fits.get((a, b))
        if known is None:
            if len(self._fits) >= CACHE_PIECES:
                self._fits.clear()
            known = self._fits[a, b] = self.merge(self.token[a] + self.token[b]) == [a, b]
        return known

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the joined bytes of two encodings."""
        if not left or not right or self.fits(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            width *= 2
            head, tail = left[:-width], right[width:]
            window = self.merge(b"".join(map(self.token.__getitem__, left[-width:] + right[:width])))
            if (not head or self.fits(head[-1], window[0])) and (not tail or self.fits(window[-1], tail[0])):
                return head + window + tail

    def encode_piece(self, data: bytes) -> list[int]:
        if len(data) <= self.leaf_bytes:
            return self.merge(data)
        middle = len(data) // 2
        return self.join_tokens(self.encode_piece(data[:middle]), self.encode_piece(data[middle:]))

    # ---- text ----

    def join_pieces(self, left: list[str], right: list[str]) -> list[str]:
        """The pieces of the joined texts; ``left`` and ``right`` are used up."""
        if not left or not right:
            return left or right
        loose = ""
        while left and len(loose) < GUARD:
            loose = left.pop() + loose
        take = 1
        while True:
            take *= 2
            whole = take >= len(right)
            text = loose + "".join(right[:take])
            borders, at = {}, len(loose)
            for k, piece in enumerate(right[:take]):
                borders[at] = k
                at += len(piece)
            found, at = [], 0
            for piece in self.find(text):
                if at in borders and (whole or at <= len(text) - GUARD):
                    return left + found + right[borders[at] :]
                found.append(piece)
                at += len(piece)
                if not whole and at > len(text) - GUARD:
                    break
            if whole:
                return left + found

    def pieces(self, text: str) -> list[str]:
        """Every match of the pattern."""
        if len(text) <= self.leaf_chars:
            return self.find(text)
        middle = len(text) // 2
        return self.join_pieces(self.pieces(text[:middle]), self.pieces(text[middle:]))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.encoded.__getitem__, self.pieces(text)))

    def decode(self, ids: bytes) -> bytes:
        numbers = np.frombuffer(ids, dtype="<u4").tolist()
        parts = [b"".join(map(self.token.__getitem__, numbers[i : i + LEAF_IDS])) for i in range(0, len(numbers), LEAF_IDS)]
        while len(parts) > 1:
            parts = [b"".join(parts[i : i + 2]) for i in range(0, len(parts), 2)]
        return parts[0] if parts else b""


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> ByteBpe:
    """The encoder for a file of base64 tokens and ranks; read once per Python worker."""
    with open(path, "rb") as f:
        return ByteBpe({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with ``ids``: the token ids of the whole text as little-endian unsigned 32-bit integers.

    A null text counts as empty and has no ids. Rows are independent: repeated rows, empty tables and further
    columns pass through; a column already called ``ids`` is replaced. ``path`` must be readable on every executor.
    """

    def make():
        bpe = load(path, pattern)

        def function(batch: pa.RecordBatch) -> list:
            return [pa.array([bpe.encode(t.as_py() or "") for t in batch.column(batch.schema.get_field_index(text))], type=pa.binary())]

        return function

    return with_columns(df.withColumn(text, F.col(text).cast("string")), [T.StructField(ids, T.BinaryType())], make)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with ``decoded``: the bytes that the ids stand for. Null ids count as none; unknown ids fail the job."""

    def make():
        bpe = load(path, pattern)

        def function(batch: pa.RecordBatch) -> list:
            return [pa.array([bpe.decode(x.as_py() or b"") for x in batch.column(batch.schema.get_field_index(ids))], type=pa.binary())]

        return function

    return with_columns(df, [T.StructField(decoded, T.BinaryType())], make)
