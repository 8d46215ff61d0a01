"""Operator 13: byte-level BPE encoding and decoding as a tree reduction.

The pattern cuts a text into pieces that are encoded apart. The encodings of byte strings form a monoid: encode(s) is
join(encode(left half), encode(right half)), down to leaves of a few bytes. A token sequence is the encoding of its
bytes if and only if each two neighbours are the encoding of their own bytes. So join re-encodes a window around the
boundary, at first the two tokens that meet, and lets it grow on each side until the pair at that edge is such an
encoding: no token beyond it can change. Decoding concatenates blocks of tokens up the tree.

Halves are cut at a power of two, so that long runs of one character meet in step, and a window that has to grow doubles:
a piece of n bytes takes about n log n steps.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm import textnum as T

LEAF = 4  # bytes up to which a string is merged directly
SHORT = 32  # bytes up to which the least rank is looked for in a list, not in a heap
NEVER = 1 << 62  # no rank
REMEMBERED = 400_000  # pieces, pairs of tokens, and leaves that a worker remembers; all are forgotten when there are more
CHUNK = 1 << 20  # characters in which a text is cut into pieces at once
AHEAD = 8  # characters by which the pattern may look past the end of a piece
BLOCK = 1024  # tokens in a leaf of decoding


class Coder:
    """The encoding of byte strings by merge ranks; each byte must have a rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        missing = [k for k in range(256) if bytes([k]) not in ranks]
        if missing:
            raise ValueError(f"no rank for byte {missing[0]}")
        self._pairs: dict[tuple[int, int], list[int]] = {}
        self._leaves: dict[bytes, list[int]] = {}

    def merged(self, s: bytes) -> list[int]:
        """The tokens of s by merging the pair of least rank, the leftmost first, until none has a rank."""
        rank, n = self.ranks.get, len(s)
        if n <= SHORT:
            parts = [s[k : k + 1] for k in range(n)]
            found = [rank(s[k : k + 2], NEVER) for k in range(n - 1)]
            while found and (least := min(found)) != NEVER:
                k = found.index(least)
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
                del found[k]
                if k < len(found):
                    found[k] = rank(parts[k] + parts[k + 1], NEVER)
                if k:
                    found[k - 1] = rank(parts[k - 1] + parts[k], NEVER)
            return [self.ranks[x] for x in parts]
        ends = list(range(1, n + 1))  # of the part that starts at each place
        before = list(range(-1, n - 1))
        heap = [(r, k) for k in range(n - 1) if (r := rank(s[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            mid = ends[k]
            if not 0 < mid < n or rank(s[k : ends[mid]]) != r:  # one of the two parts has been merged since
                continue
            end = ends[k] = ends[mid]
            ends[mid] = 0
            if end < n:
                before[end] = k
                if (r := rank(s[k : ends[end]])) is not None:
                    heapq.heappush(heap, (r, k))
            if k and (r := rank(s[before[k] : end])) is not None:
                heapq.heappush(heap, (r, before[k]))
        out, k = [], 0
        while k < n:
            out.append(self.ranks[s[k : ends[k]]])
            k = ends[k]
        return out

    def pair(self, x: int, y: int) -> list[int]:
        """The encoding of the bytes of two tokens."""
        found = self._pairs.get((x, y))
        if found is None:
            if len(self._pairs) > REMEMBERED:
                self._pairs.clear()
            found = self._pairs[x, y] = self.merged(self.bytes_of[x] + self.bytes_of[y])
        return found

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of the bytes of two encodings, one after the other."""
        if not a or not b:
            return a or b
        left, right = 1, 1  # tokens of a and of b in the window
        window = self.pair(a[-1], b[0])
        while True:
            more_left = left < len(a) and self.pair(a[-left - 1], window[0]) != [a[-left - 1], window[0]]
            more_right = right < len(b) and self.pair(window[-1], b[right]) != [window[-1], b[right]]
            if not more_left and not more_right:
                return a[:-left] + window + b[right:]
            left, right = min(len(a), left << more_left), min(len(b), right << more_right)
            window = self.merged(self.decode(a[len(a) - left :] + b[:right]))

    def encode(self, s: bytes) -> list[int]:
        """The tokens of a piece: that of the whole piece if it has a rank, else by halves."""
        whole = self.ranks.get(s)
        return self.reduced(s) if whole is None else [whole]

    def reduced(self, s: bytes) -> list[int]:
        """The tokens of s by the tree of its halves."""
        if len(s) <= LEAF:
            found = self._leaves.get(s)
            if found is None:
                if len(self._leaves) > REMEMBERED:
                    self._leaves.clear()
                found = self._leaves[s] = self.merged(s)
            return found
        half = 1 << ((len(s) - 1).bit_length() - 1)
        return self.join(self.reduced(s[:half]), self.reduced(s[half:]))

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the tokens, in blocks that are concatenated in pairs."""
        get = self.bytes_of.__getitem__
        parts = [b"".join(map(get, ids[k : k + BLOCK])) for k in range(0, len(ids), BLOCK)]
        while len(parts) > 1:
            parts = [b"".join(parts[k : k + 2]) for k in range(0, len(parts), 2)]
        return parts[0] if parts else b""


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of lines '<base64 of the token> <rank>'."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def _loaded(path: str) -> tuple[Coder, dict[str, bytes]]:
    """(coder, the packed tokens of remembered pieces), once for each Python worker and file."""
    return Coder(read_ranks(path)), {}


def pieces(text: str, pattern: regex.Pattern) -> Iterator[list[str]]:
    """The pattern's matches, in lists of bounded size; the matches must cover the text."""
    at, size = 0, CHUNK
    while at < len(text):
        found = pattern.findall(text, at, at + size)
        end = at + sum(map(len, found))
        if at + size < len(text):  # the last matches might have gone on, or been others
            while found and end > at + size - AHEAD:
                end -= len(found.pop())
            if not found:
                size *= 2
                continue
        elif end < len(text):
            raise ValueError("the pattern leaves out some characters")
        yield found
        at, size = end, CHUNK


def _encoder(path: str, pattern: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, known = _loaded(path)
        cut = regex.compile(pattern)
        for batch in batches:
            for lo, buf, off in T.slices(batch.column(1)):
                raw, packed = buf.tobytes(), []
                for a, b in zip(off[:-1], off[1:], strict=True):
                    own = []
                    for some in pieces(raw[a:b].decode(), cut):
                        if len(known) > REMEMBERED:
                            known.clear()
                        for p in set(some).difference(known):
                            known[p] = np.array(coder.encode(p.encode()), "<u4").tobytes()
                        own.append(b"".join(map(known.__getitem__, some)))
                    packed.append(b"".join(own))
                bounds = np.cumsum([0, *(len(x) // 4 for x in packed)]).astype(np.int32)
                ids = np.frombuffer(b"".join(packed), "<i4")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(packed)).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids))],
                    names=["doc_id", "ids"]
                )

    return run


def _decoder(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, _ = _loaded(path)
        for batch in batches:
            docs, flat = batch.column(0).cast(pa.int64()), batch.column(1).flatten().to_numpy().astype("<i4")
            ends = np.cumsum(batch.column(1).value_lengths().fill_null(0).to_numpy())
            packed, whole, at, size = [], [], 0, 0
            for row, end in enumerate(ends, 1):
                own = flat[at:end]
                packed.append(own.tobytes())
                whole.append(coder.decode(own.tolist()))
                at, size = end, size + len(own)
                if size > T.SLICE or row == len(ends):
                    yield pa.RecordBatch.from_arrays(
                        [docs.slice(row - len(packed), len(packed)), pa.array(packed, pa.binary()), pa.array(whole, pa.binary())],
                        names=["doc_id", "packed", "decoded"]
                    )
                    packed, whole, size = [], [], 0

    return run


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, ids) for each row of docs (doc_id, text): the tokens of the whole text, without special tokens.

    ranks is the path of a rank file, on every machine; each match of pattern is encoded separately. A null or empty text
    has no tokens. Rows that repeat a doc_id each get a row, null ids too. An empty table gives an empty result. Nothing is
    truncated, however long a text or a piece is. Other columns are ignored. A file without some byte raises ValueError.
    """
    return docs.select("doc_id", "text").mapInArrow(_encoder(ranks, pattern), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """(doc_id, packed, decoded) for each row of encoded (doc_id, ids): the ids as little-endian 32-bit integers, and their bytes.

    Null or no ids give no bytes; an id without a rank raises KeyError.
    """
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(ranks), "doc_id long, packed binary, decoded binary")


def _hash(name: str) -> Column:
    return F.sha2(name, 256).alias(f"{name}_sha256")


def round_trip(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): texts are encoded, and their ids alone decoded."""
    out = decode(encode(docs, ranks, pattern), ranks).withColumnRenamed("packed", "ids")
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), _hash("ids"), _hash("decoded"))
