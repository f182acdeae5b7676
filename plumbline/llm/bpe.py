"""Byte-level BPE as a monoid: halves are encoded on their own, neighbours joined at the boundary.

An element is a stretch of text with its token ids. Two neighbours are joined by encoding again a
window around their boundary, grown until what lies outside provably stays as it is:

* Between pieces of the split pattern. At a *sync point* every scan of the pattern begins a new
  match, whatever stands before: white space after something else (no alternative of the pattern
  takes white space after its first character), a digit next to a letter, anything after a digit,
  or a non-letter after a letter. From a sync point in the left half to one in the right half, the
  window is encoded anew; outside it both halves already have the pieces of the joined text.
* Inside one piece, if no sync point is near. A token sequence is the encoding of a piece if and
  only if each pair of neighbours is the encoding of its own bytes. A window of tokens is encoded
  again; when its first and last token come out as they were, all pairs are valid.

Decoding concatenates the bytes of tokens up the same tree.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Rows, documents

#: Characters of a leaf; a text up to this long is encoded at once.
LEAF = 512
#: White space as Unicode defines it (fixed values).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Only safe sync points: ASCII letters and digits, and white space after what isn't.
SYNC = re.compile(
    f"(?<=[^{SPACE}])(?=[{SPACE}])|(?<=[0-9])(?=[^0-9{SPACE}])(?=[\x00-\x7f])|(?<=[A-Za-z])(?=[0-9!-/:-@[-`{{-~])"
)
FIRST_WINDOW = 64
ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])


class Codec:
    """Ranks of a tokenizer file with the tree operations."""

    def __init__(self, path: str, pattern: str, leaf: int = LEAF):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.leaf = leaf
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.length_of = np.array([len(token) for token in self.bytes_of], dtype=np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), dtype="<u4")

    def piece(self, body: bytes) -> np.ndarray:
        return np.array(self.encoding._encode_single_piece(body), dtype="<u4")

    def encode(self, text: str) -> np.ndarray:
        return self.reduce(text, 0, len(text))

    def reduce(self, text: str, start: int, end: int) -> np.ndarray:
        if end - start <= self.leaf:
            return self.whole(text[start:end])
        middle = (start + end) // 2
        left, right = self.reduce(text, start, middle), self.reduce(text, middle, end)
        return self.join(text, start, middle, end, left, right)

    def join(self, text: str, start: int, middle: int, end: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(left) or not len(right):
            return left if len(left) else right
        low, high = last_sync(text, start, middle), first_sync(text, middle, end)
        keep = self.tokens_before(left, len(text[low:middle].encode()), from_end=True)
        drop = self.tokens_before(right, len(text[middle:high].encode()), from_end=False)
        if high - low > self.leaf and one_piece(text[low:middle], text[middle:high]):
            inner = self.join_piece(left[keep:], right[:drop])
        else:
            inner = self.whole(text[low:high])
        return np.concatenate([left[:keep], inner, right[drop:]])

    def tokens_before(self, ids: np.ndarray, size: int, from_end: bool) -> int:
        """Index of the token boundary that lies ``size`` bytes from the start or the end."""
        step = FIRST_WINDOW
        while True:
            part = ids[-step:] if from_end else ids[:step]
            ends = np.cumsum(self.length_of[part[::-1] if from_end else part])
            if not size:
                return len(ids) if from_end else 0
            at = int(np.searchsorted(ends, size))
            if at < len(ends):
                if ends[at] != size:
                    raise AssertionError("a sync point lies inside a token")
                return len(ids) - at - 1 if from_end else at + 1
            step *= 2

    def join_piece(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        step = 4
        while True:
            a, b = left[-step:], right[:step]
            window = self.piece(b"".join(self.bytes_of[i] for i in (*a, *b)))
            if (len(a) == len(left) or window[0] == a[0]) and (len(b) == len(right) or window[-1] == b[-1]):
                return np.concatenate([left[: len(left) - len(a)], window, right[len(b) :]])
            step *= 2

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def one_piece(left: str, right: str) -> bool:
    """Both sides are ASCII letters (after one space at most), so they and their union are one match each."""
    left = left.removeprefix(" ")
    return left.isalpha() and right.isalpha() and left.isascii() and right.isascii()


def first_sync(text: str, start: int, end: int) -> int:
    """The first sync point in [start, end), else ``end``; the search window doubles."""
    size = FIRST_WINDOW
    while start < end:
        found = SYNC.search(text, start + 1, min(end, start + size))
        # A match needs the character after it, which a window's end cuts off only for later points.
        if found and found.start() < end:
            return found.start()
        if start + size >= end:
            return end
        size *= 2
    return end


def last_sync(text: str, start: int, end: int) -> int:
    """The last sync point in (start, end), else ``start``."""
    size = FIRST_WINDOW
    while True:
        low = max(start, end - size)
        found = None
        for found in SYNC.finditer(text, low + 1, end):
            pass
        if found:
            return found.start()
        if low == start:
            return start
        size *= 2


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str, leaf: int = LEAF) -> Codec:
    return Codec(path, pattern, leaf)


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ids (little-endian unsigned 32-bit integers), decoded (bytes).

    ``path`` is a rank file that every executor can read. A null or empty text has no ids; a row is
    encoded on its own, so repeated rows and null identifiers come back as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, pattern)
        for batch in batches:
            out = Rows(ENCODED)
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = tool.encode(text.as_py())
                out.add(doc_id, ids.tobytes(), tool.decode(ids), size=12 * len(ids))
                if out.full():
                    yield from out.take()
            yield from out.take()

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, ids binary, decoded binary")


def token_count(ids) -> F.Column:
    return (F.length(ids) / 4).cast("bigint")
