"""Packing documents into training sequences by cutting-stock patterns.

1. Each document becomes token ids and a closing id; it is cut into whole sequences and one remainder.
2. Remainders are counted in length classes of ``grain`` tokens (at most ``capacity / grain`` counts reach the driver).
3. Patterns of classes are found on that histogram (see ``cutting_stock``).
4. Pieces are ranked inside their class, in buckets of about ``_BUCKET_ROWS`` by a hash of the row, so that no class, however common,
   and no document, however often it is repeated, is one task; bucket counts added up give every piece its rank in the class, and the ranks of a class are handed out
   to patterns. The pattern table is bounded by the number of classes and is broadcast.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.cutting_stock import solve
from tessella.llm.store import stored

CAPACITY = 2048
END_ID = 1
_BUCKET_ROWS = 256
_GROUP_BUCKETS = 4096


class _Recent(dict):
    """Ids of recent words, computed when first asked for, in two halves: when this one is full, it becomes the older."""

    def __init__(self, compute: Callable[[bytes], bytes], keep: int):
        super().__init__()
        self.compute, self.keep, self.older = compute, keep // 2, {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.compute(word)
        if len(self) >= self.keep:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


# How the tokenizer prepares a text that words may be looked up for, as its file says it.
_BY_WORD = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
)


class WordTokenizer:
    """Ids of whole texts. A tokenizer that lower-cases and never joins across white space is asked word by word, and known words are
    looked up; any other tokenizer encodes whole texts.

    In the first case a text is split at ASCII white space. Words of plain Latin letters go to the tokenizer's model in its own
    units (runs of letters, single digits, runs of marks, contractions); any other word goes through the whole tokenizer. Ids
    of at most ``keep`` recent words, and of as many recent units, are held. Special tokens' strings are ordinary text.
    """

    _UNITS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|[^\sa-zß-öø-į0-9]+")
    _PLAIN = re.compile(r"[!-~¡-©«-±´¶-¸»¿-ÿĀ-į]*\Z")

    def __init__(self, path: str, keep: int = 400_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.by_word = (told["normalizer"], told["pre_tokenizer"]) == _BY_WORD and told["post_processor"] is None
        self.tokenize = self.whole.model.tokenize
        self.words, self.units = _Recent(self._word, keep), _Recent(self._unit, keep)
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(visible)]
        self.alphabet = "".join(chr(b) if b in set(visible) else chr(256 + hidden.index(b)) for b in range(256))

    def _unit(self, unit: str) -> bytes:
        if not unit.isascii():  # visible ASCII stands for itself
            unit = "".join([self.alphabet[b] for b in unit.encode()])
        tokens = self.tokenize(unit)
        return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])

    def _word(self, word: bytes) -> bytes:
        if word.isalpha():  # bytes: ASCII letters alone
            return self._unit(word.lower().decode())
        text = word.decode("utf-8", "replace")
        if self._PLAIN.match(text):
            return b"".join(map(self.units.__getitem__, self._UNITS.findall(text.lower())))
        ids = self.whole.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: bytes) -> bytes:
        """The text's ids as little-endian unsigned 32-bit numbers."""
        if not self.by_word:
            return np.array(self.whole.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.words.__getitem__, text.split()))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cut_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """``id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``: each document cut at multiples of ``capacity``; a null text is empty.

    The tokenizer's path must be readable on the executors.
    """
    path = tokenizer or default_tokenizer()
    tail = struct.pack("<I", end_id)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokenizer(path)
        for batch in batches:
            which, start, length, crc, tokens = [], [], [], [], []
            for row, text in enumerate(batch.column("text")):
                ids = memoryview(words.ids(text.as_py() or b"") + tail)
                n = len(ids) // 4
                for at in range(0, n, capacity):
                    piece = ids[4 * at : 4 * (at + capacity)]
                    which.append(row)
                    start.append(at)
                    length.append(len(piece) // 4)
                    crc.append(crc32(piece))
                    tokens.append(n)
            columns = [batch.column("id").take(pa.array(which, pa.int64())), *(pa.array(c, pa.int64()) for c in (start, length, crc, tokens))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(cut, f"id {rows.schema['id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long")


def _pattern_rows(patterns: list[tuple[np.ndarray, int]], classes: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, end rank, pieces of the class in the pattern, first sequence) of every pattern and class."""
    rows, rank, sequence = [], np.zeros(classes.size, np.int64), 0
    for counts, times in patterns:
        for k in np.flatnonzero(counts):
            rows.append((int(classes[k]), int(rank[k]), int(rank[k] + counts[k] * times), int(counts[k]), sequence))
            rank[k] += counts[k] * times
        sequence += times
    return rows


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, grain: int = 8, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: ``id_col``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``, ``padding`` (of the sequence).

    A sequence's pieces lie one after another from offset 0; it is padded to ``capacity`` unless its length is a power of
    two. Null and empty texts are one piece, the closing id. Repeated rows are packed once each. Only the id and the text are
    read; an empty table gives an empty one. Runs jobs at once: pieces are written to scratch and counted.

    A piece that fills a sequence needs no rank and stays where it is. The ranks of all others are counted in three steps: rows inside a bucket, buckets
    inside a group, groups inside a class; so the longest window of a class has one row for some ``_BUCKET_ROWS * _GROUP_BUCKETS`` of its pieces.
    """
    spark = docs.sparkSession
    pieces = cut_documents(docs, id_col, text_col, capacity, end_id, tokenizer)
    pieces = pieces.withColumn("class", F.ceil(F.col("length") / F.lit(grain)).cast("int"))
    pieces = stored(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")  # fixed once written
    widest = -(-capacity // grain)
    histogram = pieces.where(F.col("class") < widest).groupBy("class").agg(F.count("*").alias("n")).orderBy("class").collect()
    total = sum(r.n for r in histogram)
    classes = np.array([r["class"] for r in histogram], np.int64)
    patterns = solve(classes, np.array([r.n for r in histogram], np.int64), widest) if total else []
    table = spark.createDataFrame(_pattern_rows(patterns, classes), "class int, first long, end long, per int, sequence long")

    buckets = spark.createDataFrame([(r["class"], r.n // _BUCKET_ROWS + 1) for r in histogram], "class int, buckets long")  # a row a class
    placed = pieces.where(F.col("class") < widest).join(F.broadcast(buckets), "class").withColumn("bucket", F.pmod(F.xxhash64("row"), "buckets"))
    counts = placed.groupBy("class", "bucket").agg(F.count("*").alias("n")).withColumn("group", F.floor(F.col("bucket") / _GROUP_BUCKETS))
    earlier = lambda by, place: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = counts.groupBy("class", "group").agg(F.sum("n").alias("n")).select("class", "group", earlier(["class"], "group").alias("groups_before"))
    before = counts.select("class", "bucket", "group", earlier(["class", "group"], "bucket").alias("before")).join(groups, ["class", "group"])
    before = before.select("class", "bucket", (F.col("before") + F.col("groups_before")).alias("before"))
    inside = Window.partitionBy("class", "bucket").orderBy("row")
    ranked = placed.withColumn("rank", F.row_number().over(inside) - 1).join(before, ["class", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    fits = (ranked["class"] == table["class"]) & (ranked["rank"] >= table["first"]) & (ranked["rank"] < table["end"])
    slot = F.col("rank") - F.col("first")
    handed = ranked.join(F.broadcast(table), fits).select("row", "id", "start", "length", "ids_crc32", "doc_tokens", (F.col("sequence") + F.floor(slot / F.col("per"))).alias("sequence_id"))
    whole = Window.partitionBy("sequence_id")
    along = whole.orderBy(F.desc("length"), "row").rowsBetween(Window.unboundedPreceding, -1)
    filled = F.sum("length").over(whole)
    power = F.col("filled").bitwiseAND(F.col("filled") - 1) == 0
    out = handed.withColumns({"offset": F.coalesce(F.sum("length").over(along), F.lit(0)), "filled": filled})
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "filled"]
    alone = pieces.where(F.col("class") == widest).withColumns({"sequence_id": F.col("row") + sum(times for _, times in patterns), "offset": F.lit(0).cast("long"), "filled": F.col("length")})
    out = alone.select(*names).unionByName(out.select(*names))
    return out.select(
        F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", F.when(power, 0).otherwise(capacity - F.col("filled")).alias("padding")
    )
