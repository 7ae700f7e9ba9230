"""Byte-level BPE by a monoid tree reduction.

The encodings of byte strings are a monoid: ``join(encode(a), encode(b)) == encode(a + b)``, with the empty encoding as
identity. So a match of the pattern is encoded by encoding its halves, down to a few bytes, and joining them up the tree.

Why a join is exact. Merges take the pair of least rank, the leftmost of equals. Let two encodings meet at a border, and let the
last token x of the one and the first token y of the other, encoded alone as ``x + y``, give (x, y) again. Until a first merge
across the border, the merges of the whole are those of both sides, and those inside x and y come in the order in which
``x + y`` alone has them; so that first merge would be one of ``x + y`` too, which has none. Hence a row of encodings whose
neighbours all agree is the encoding of the whole, and any run of tokens of an encoding is the encoding of its bytes. A join
re-encodes a window of tokens around the border. If the result begins with the window's first old token and ends with its last,
the pairs at both edges are old pairs, nothing outside can change, and the join is done; else that side of the window doubles, at
most to the whole. Nothing is assumed of the ranks.
"""

from __future__ import annotations

import base64
import heapq
import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tessella.llm.language import parts_of

LEAF = 6  # bytes that are merged directly
SHORT = 48  # bytes of a window up to which a plain scan finds the next pair faster than a heap
KEPT = 1 << 18  # encodings of windows and of matches that a task keeps twice over, each of at most ``KEPT_SIZE`` bytes or characters
KEPT_SIZE = 32
NEVER = 1 << 60

Tokens = tuple[bytes, ...]  # tuples of bytes or numbers are not what the garbage collector has to visit


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


_BEYOND = re.compile("[^\x00-\u024f]")


def latin_pattern() -> str:
    """What the public pattern matches in texts of code points under U+0250, in plain classes, which match in half the time."""
    of = lambda kind: "".join(f"\\u{c:04x}" for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)
    letter, number, blank = of("L"), of("N"), r"\x09-\x0d\x20\x85\xa0"
    return rf"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{blank}{letter}{number}]+|[{blank}]+(?![^{blank}])|[{blank}]+"


class Kept(dict):
    """Results by key, made where missing. The last ``KEPT`` at least are held: once there are as many, they become the old ones, and those asked for
    again are new once more. Large keys are not held."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= KEPT_SIZE:
            if len(self) >= KEPT:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


class TreeBPE:
    """Encodes and decodes by a table of ranks that has all single bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str | None = None):
        import public_tokenizers
        import regex

        self.ranks, self.whole_split = ranks, regex.compile(pattern or public_tokenizers.PATTERN).findall
        self.latin_split = re.compile(latin_pattern()).findall if pattern in (None, public_tokenizers.PATTERN) else None
        self.token = {rank: token for token, rank in ranks.items()}
        self.windows, self.matches = Kept(self.merged), Kept(self.match_ids)

    def split(self, text: str) -> list[str]:
        """The matches of the pattern."""
        return self.latin_split(text) if self.latin_split and not _BEYOND.search(text) else self.whole_split(text)

    def merged(self, data: bytes) -> Tokens:
        """The tokens of a window: single bytes, of which the pair of least rank is merged until none has a rank."""
        return self._by_scan(data) if len(data) <= SHORT else self._by_heap(data)

    def _by_scan(self, data: bytes) -> Tokens:
        rank, cuts = self.ranks.get, list(range(len(data) + 1))
        pairs = [rank(data[k : k + 2], NEVER) for k in range(len(data) - 1)]
        while pairs and (least := min(pairs)) < NEVER:
            at = pairs.index(least)
            del cuts[at + 1], pairs[at]
            if at < len(pairs):
                pairs[at] = rank(data[cuts[at] : cuts[at + 2]], NEVER)
            if at:
                pairs[at - 1] = rank(data[cuts[at - 1] : cuts[at + 1]], NEVER)
        return tuple([data[i:j] for i, j in zip(cuts, cuts[1:])])

    def _by_heap(self, data: bytes) -> Tokens:
        rank, size = self.ranks.get, len(data)
        ends, begins = list(range(1, size + 1)), list(range(-1, size))  # of the part that begins there; of the part that ends there, less one
        ends.append(0)
        heap = [(r, k, k + 1, k + 2) for k in range(size - 1) if (r := rank(data[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, start, middle, end = heapq.heappop(heap)
            if ends[start] != middle or ends[middle] != end:
                continue  # one of both parts is gone
            ends[start], ends[middle], begins[end] = end, 0, start
            if end < size and (r := rank(data[start : ends[end]])) is not None:
                heapq.heappush(heap, (r, start, end, ends[end]))
            if start and (r := rank(data[begins[start] : end])) is not None:
                heapq.heappush(heap, (r, begins[start], start, end))
        out, at = [], 0
        while at < size:
            out.append(data[at : ends[at]])
            at = ends[at]
        return tuple(out)

    def join(self, left: Tokens, right: Tokens) -> Tokens:
        """The encoding of both sides' bytes together."""
        if not left or not right:
            return (*left, *right)
        window = self.windows[left[-1] + right[0]]
        if window[0] == left[-1] and window[-1] == right[0]:
            return left + right
        before, after = 2, 2
        while True:
            before, after = min(before, len(left)), min(after, len(right))
            window = self.windows[b"".join(left[-before:]) + b"".join(right[:after])]
            stays_left = before == len(left) or window[0] == left[-before]
            stays_right = after == len(right) or window[-1] == right[after - 1]
            if stays_left and stays_right:
                return left[:-before] + window + right[after:]
            before, after = before * (1 if stays_left else 2), after * (1 if stays_right else 2)

    def tokens(self, data: bytes) -> Tokens:
        """The encoding of bytes without any split: halves, joined."""
        if len(data) <= LEAF:
            return self.windows[data]
        half = len(data) // 2
        return self.join(self.tokens(data[:half]), self.tokens(data[half:]))

    def match_ids(self, match: str) -> tuple[int, ...]:
        """The ids of one match of the pattern; a match that is a token as it stands is that token."""
        data = match.encode()
        whole = self.ranks.get(data)
        return (whole,) if whole is not None else tuple([self.ranks[t] for t in self.tokens(data)])

    def encode(self, text: str) -> np.ndarray:
        return np.fromiter(chain.from_iterable(map(self.matches.__getitem__, self.split(text))), np.int32)

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids: halves, concatenated."""
        if len(ids) <= 1024:
            return b"".join(map(self.token.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """``id_col`` and ``ids`` (array of int) of every row's whole text.

    A null or empty text has no ids. Texts and matches of any length are encoded whole; repeated rows are encoded alike; an
    empty table gives an empty one; no string is a special token; other columns are not read. Rows stay where they are. The rank
    file's path must be readable on the executors.
    """
    path = ranks or default_ranks()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = TreeBPE(read_ranks(path))
        for part, texts in (x for batch in batches for x in parts_of(batch, 1)):
            ids = [bpe.encode(t) for t in texts]
            ends = np.cumsum([0, *(x.size for x in ids)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["id", "ids"])

    return rows.mapInArrow(encoded, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, ids_col: str = "ids", ranks: str | None = None) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of its ids. Null ids have null bytes; an id without a token is an error;
    a column ``decoded`` of before is replaced."""
    path, encoded = ranks or default_ranks(), encoded.drop("decoded")
    at, schema = encoded.columns.index(ids_col), StructType([*encoded.schema.fields, StructField("decoded", BinaryType())])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = TreeBPE(read_ranks(path))
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                lists = batch.column(at)
                ids, edges = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
                data = [bpe.decode(ids[a:b].tolist()) if there else None for a, b, there in zip(edges, edges[1:], lists.is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(decoded, schema)
