"""Chat formatting with offset-aligned loss masks.

A turn is rendered as ``### role``, its text and ``</turn>``, each on a line; marks inside texts are escaped so that no
mark can come from a text and the rendering can be undone. A conversation is rendered whole and encoded once with
offsets; the sorted spans of assistant texts are then intersected with the token spans by binary search.

Conversations are dealt by ranges of (id, turn, role, text), so one with very many turns is shared by several tasks, and
stream through one pass in blocks of whole turns. A block ends where its conversation does, at the end of a task's range,
or at ``BLOCK_CHARS``. This changes no result: the pattern that splits texts before the merges always splits between the
line feed that ends a turn and the ``###`` that begins the next (a mark never joins a line feed, and a single line feed is a piece
of its own before it), and merges never cross such a split. So ids, offsets and masks of the blocks, one after another, are those of the whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", "\n</turn>\n"
LOSS_ROLES = frozenset({"assistant"})
BLOCK_CHARS = 1 << 20
# Each control string and what stands for it inside a text.
ESCAPES = {"\\": "\\\\", "###": "\\h", "</turn>": "\\t"}
_CONTROL = re.compile("|".join(re.escape(c) for c in ESCAPES))
_BACK = {v: k for k, v in ESCAPES.items()} | {"\\n": "\n"}
_ESCAPED = re.compile(r"\\.")
_TURN = re.compile(r"### ([^\n]*)\n(.*?)\n</turn>\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[0]], text)


def render(turns: list[tuple[str, str]], loss_roles: frozenset[str] = LOSS_ROLES) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the sorted spans of the texts that count for the loss."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{OPEN}{escape(role).replace(chr(10), chr(92) + 'n')}\n", escape(text)
        if role in loss_roles and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted text."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def loss_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which tokens touch a span, and the positions they share with spans, merged. offsets: sorted (start, end) of tokens.

    The first span that ends after a token's start is found by binary search; the token counts if that span begins before
    the token ends. A token over a span's edge counts, but only its positions inside the span are shared.
    """
    mask = np.zeros(len(offsets), bool)
    if not spans or not len(offsets):
        return mask, []
    starts, ends = (np.array(x, np.int64) for x in zip(*spans))
    first = np.searchsorted(ends, offsets[:, 0], side="right")
    last = np.searchsorted(starts, offsets[:, 1], side="left")  # spans first .. last - 1 meet the token
    mask = (last > first) & (offsets[:, 1] > offsets[:, 0])
    met = (last - first)[mask]
    if not met.size:
        return mask, []
    span = np.arange(met.sum()) - np.repeat(np.cumsum(met) - met, met) + np.repeat(first[mask], met)
    begin = np.maximum(np.repeat(offsets[mask, 0], met), starts[span])
    end = np.minimum(np.repeat(offsets[mask, 1], met), ends[span])
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], begin[1:] > reach[:-1]])
    return mask, list(zip(begin[new].tolist(), reach[np.append(new[1:], True)].tolist()))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_ranks() -> str:
    """The vocabulary of ``default_tokenizer`` as a file of ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class RankEncoder:
    """Ids of whole texts with the bytes that each of them covers, from a file of ranks. No string is a special token."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        self.width[list(ranks.values())] = [len(token) for token in ranks]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, (start, end) of each in bytes of the text's UTF-8)."""
        ids = np.array(self.encoding.encode_ordinary(text), np.int32)
        ends = np.cumsum(self.width[ids])
        return ids, np.stack([ends - self.width[ids], ends], 1)


def encoded_with_mask(encoder: RankEncoder, text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(ids, loss by token, characters under the mask) of a formatted text with the spans of its loss texts."""
    ids, offsets = encoder.encode(text)
    if text.isascii():
        return ids, *loss_mask(offsets, spans)
    begins = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
    byte_of = np.append(np.flatnonzero(begins), begins.size)
    mask, shared = loss_mask(offsets, [(int(byte_of[s]), int(byte_of[e])) for s, e in spans])
    return ids, mask, [(int(np.searchsorted(byte_of, s)), int(np.searchsorted(byte_of, e))) for s, e in shared]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _nested(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *(p.size for p in parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0), kind))


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                         ranks: str | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``conv_col``, ``block``, ``whole``, ``formatted``, ``ids``, ``loss`` (by token), ``loss_spans`` (characters under the mask, merged).

    Turns are ordered by turn, role and text; a null turn comes first, a null role or text is empty, a null conversation id is
    a conversation of its own, repeated rows are turns like others. The blocks of a conversation, in the order of ``block``, are
    the conversation; ``whole`` is true where one block surely holds all of it. An empty table gives an empty one; other
    columns are not read. The rank file's path must be readable on the executors.
    """
    path = ranks or default_ranks()
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["conv"].dataType

    def format_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, task = RankEncoder(path), TaskContext.get().partitionId() << 40  # ranges are in the order of partitions
        done: list[tuple] = []

        def closed(conv: pa.Scalar, block: int, whole: bool, held: list[tuple[str, str]]) -> None:
            text, spans = render(held)
            ids, mask, shared = encoded_with_mask(encoder, text, spans)
            done.append((conv.as_py(), task + block, whole, text, ids, mask, [{"start": s, "end": e} for s, e in shared]))

        def flushed(conv_type: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*done))
            done.clear()
            flat = [pa.array(c, t) for c, t in zip(columns[:4], (conv_type, pa.int64(), pa.bool_(), pa.string()))]
            return pa.RecordBatch.from_arrays([*flat, _nested(columns[4], pa.int32()), _nested(columns[5], pa.bool_()), pa.array(columns[6], _SPANS)], names=["conv", "block", "whole", "formatted", "ids", "loss", "loss_spans"])

        conv, first, block, held, size, pending = None, True, 0, [], 0, 0
        for batch in batches:
            for this, role, text in zip(batch.column(0), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                new = conv is not None and this != conv
                if held and (new or size + len(text) > block_chars):
                    closed(conv, block, new and not first and block == 0, held)
                    pending += size
                    block, held, size = (0 if new else block + 1), [], 0
                    if pending > block_chars or len(done) >= 1000:
                        yield flushed(conv.type)
                        pending = 0
                    first = first and not new
                conv = this
                held.append((role, text))
                size += len(text)
        if held:
            closed(conv, block, False, held)  # it may go on in the next range
            yield flushed(conv.type)

    dealt = rows.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv", "turn", "role", "text")
    out = dealt.mapInArrow(format_all, f"conv {kind.simpleString()}, block long, whole boolean, formatted string, ids array<int>, loss array<boolean>, loss_spans array<struct<start:long,end:long>>")
    return out.withColumnRenamed("conv", conv_col)


class _Digest:
    """Running digests of one conversation."""

    def __init__(self) -> None:
        self.turns, self.chars, self.size = 0, 0, 0
        self.said, self.lost = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, spans: list[dict]) -> None:
        for role, said in parse(text):
            self.turns += 1
            self.said.update(f"{role}\n{said}\n".encode())
        for s in spans:
            said = unescape(text[s["start"] : s["end"]])
            self.chars += len(said)
            self.lost.update(said.encode())
        self.size += len(text)

    def row(self) -> tuple:
        return self.turns, self.said.hexdigest(), self.chars, self.lost.hexdigest(), self.size


_DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def conversation_digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Read formatted conversations back, in any order of rows: turns, loss text and sizes of each, as digests.

    Conversations of one block are digested where they lie. The blocks of all others are brought together in order and
    pass through one hash state at a time, as a digest of a whole conversation can only be made in order.
    """
    rows = formatted.select(F.col(conv_col).alias("conv"), "block", "whole", "formatted", "loss_spans")
    kind = rows.schema["conv"].dataType.simpleString()
    names = [x.split()[0] for x in _DIGESTS.split(", ")]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for whole, text, spans in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                state = _Digest()
                if whole:
                    state.add(text, spans)
                found.append(state.row() if whole else (None,) * 5)
            rest = pa.compute.if_else(batch.column(2), pa.scalar(None, pa.string()), batch.column(3))
            spans = pa.array([None if w else s for w, s in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist())], _SPANS)
            columns = list(zip(*found)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), rest, spans, *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["conv", "block", "formatted", "loss_spans", *names])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        for batch in batches:
            ended: list[tuple] = []
            for this, text, spans, *row in zip(batch.column(0), *(batch.column(k).to_pylist() for k in range(2, 9))):
                if state is not None and (text is None or this != conv):
                    ended.append((conv.as_py(), *state.row()))
                    state = None
                if text is None:
                    ended.append((this.as_py(), *row))
                    continue
                conv, state = this, state or _Digest()
                state.add(text, spans)
            yield _digest_batch(ended, batch.column(0).type, kinds, names)
        if state is not None:
            yield _digest_batch([(conv.as_py(), *state.row())], conv.type, kinds, names)

    single = rows.mapInArrow(alone, f"conv {kind}, block long, formatted string, loss_spans array<struct<start:long,end:long>>, {_DIGESTS}")
    out = single.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(together, f"conv {kind}, {_DIGESTS}")
    return out.withColumnRenamed("conv", conv_col)


def _digest_batch(rows: list[tuple], conv_type: pa.DataType, kinds: tuple, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (conv_type, *kinds))], names=["conv", *names])
