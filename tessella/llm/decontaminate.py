"""Benchmark decontamination with one FM-index per shard of training text.

A task gathers the words of its documents into shards. Words that no benchmark phrase holds cannot be
part of an occurrence, so only runs of phrase words at least as long as the shortest phrase enter the
shard's index. Every phrase is then searched backwards through the index, its occurrences are located
from sampled suffix positions, and overlapping occurrences merge into removal spans.

No row is shuffled. The phrases are made on Spark, as pairs of a window and an item that has it, and dealt by a hash of the
pair into blocks of about ``block_words`` words, whatever the length or number of the items. One block at a time goes out to
the tasks; what it finds is written before the next, which is a further pass over the documents, and its broadcast is freed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.fm_index import FMIndex
from tessella.llm.store import dropped, fresh_path, stored

WINDOW = 13
#: Keeps 0-9, a-z and bytes of code points from U+0080, lower-cases A-Z, blanks all others.
_FOLD = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
SHARD_SYMBOLS = 1 << 17
SHARD_DOCS = 20_000
#: Texts are held beside a shard only while their rows are to be returned whole.
SHARD_BYTES = 1 << 25


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def windows_of(text: bytes | None, window: int = WINDOW) -> Iterator[bytes]:
    """Every window of an item, its words joined by blanks; an item of fewer words is one window, one without words has none."""
    words = words_of(text)
    return (b" ".join(words[at : at + window]) for at in range(max(1, len(words) - window + 1) if words else 0))


def window_items(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """``window``, ``item`` (as a string; null where the item has no id): distinct pairs."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = windows_of(text.as_py(), window)
                while part := list(islice(found, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([item] * len(part), pa.string())], names=["window", "item"])

    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return items.mapInArrow(windows, "window binary, item string").distinct()


class Phrases:
    """A block of phrases, encoded: vocabulary, patterns padded at the left, lengths, items of each."""

    def __init__(self, phrases: dict[tuple[bytes, ...], set[str]]):
        keys = list(phrases)
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for p in keys for w in p}))}
        self.lengths = np.array([len(p) for p in keys], np.int64)
        width = int(self.lengths.max(initial=1))
        self.patterns = np.zeros((len(keys), width), np.int64)
        for k, p in enumerate(keys):
            self.patterns[k, width - len(p) :] = [self.vocabulary[w] for w in p]
        self.items = [sorted(phrases[p]) for p in keys]
        self.shortest = int(self.lengths.min(initial=1))


class _Shard:
    def __init__(self, phrases: Phrases):
        self.phrases = phrases
        self.symbols: list[np.ndarray] = [np.zeros(1, np.int64)]
        self.run_doc: list[int] = []
        self.run_word: list[int] = []
        self.run_at: list[int] = []
        self.size, self.docs = 1, 0

    def add(self, words: list[bytes]) -> None:
        get = self.phrases.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (ids > 0).view(np.int8), [0]])))
        starts, ends = edge[::2], edge[1::2]
        long = ends - starts >= self.phrases.shortest
        for s, e in zip(starts[long].tolist(), ends[long].tolist()):
            self.run_doc.append(self.docs)
            self.run_word.append(s)
            self.run_at.append(self.size)
            self.symbols += [ids[s:e], np.zeros(1, np.int64)]
            self.size += e - s + 1
        self.docs += 1

    def found(self) -> list[tuple[list[tuple[int, int]], set[str]]]:
        """For each document of the shard: merged spans of words, and the items found."""
        out: list[tuple[list[tuple[int, int]], set[str]]] = [([], set()) for _ in range(self.docs)]
        if not self.run_at or not self.phrases.items:
            return out
        index = FMIndex(np.concatenate(self.symbols), len(self.phrases.vocabulary) + 1)
        lo, hi = index.search(self.phrases.patterns, self.phrases.lengths)
        hit = np.flatnonzero(lo < hi)
        if not hit.size:
            return out
        counts = (hi - lo)[hit]
        which = np.repeat(hit, counts)
        rows = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lo[hit], counts)
        at = index.locate(rows)
        run_at = np.array(self.run_at)
        run = np.searchsorted(run_at, at, side="right") - 1
        doc = np.array(self.run_doc)[run]
        start = np.array(self.run_word)[run] + at - run_at[run]
        for d, p in np.unique(np.stack([doc, which], 1), axis=0).tolist():
            out[d][1].update(self.phrases.items[p])
        order = np.lexsort((start, doc))
        for d, s, e in zip(doc[order].tolist(), start[order].tolist(), (start + self.phrases.lengths[which])[order].tolist()):
            spans = out[d][0]
            if spans and s <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(spans[-1][1], e))
            else:
                spans.append((s, e))
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


_FOUND = "struct<n_words:long,spans:array<struct<start:long,end:long>>,items:array<string>>"


def _pass(batches: Iterator[pa.RecordBatch], phrases: Phrases, schema: pa.Schema, shard_symbols: int, inside: int | None) -> Iterator[pa.RecordBatch]:
    """Rows (row, text, found) with what this block of phrases finds merged into found; the schema's columns are returned. The text can be
    the field ``inside`` of the row instead, so that it is not sent twice."""
    shard, held, size = _Shard(phrases), [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        results = iter(shard.found())
        for batch, n_words in held:
            found = []
            for before, n in zip(batch.column("found").to_pylist(), n_words):
                spans, items = next(results)
                had = [(x["start"], x["end"]) for x in before["spans"]]
                found.append({"n_words": n, "spans": [{"start": a, "end": b} for a, b in merged(had + spans)], "items": sorted({*before["items"], *items})})
            arrays = [pa.array(found, f.type) if f.name == "found" else batch.column(f.name) for f in schema]
            yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema([f if f.name == "found" else batch.schema.field(f.name) for f in schema]))

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            n_words = []
            for text in part.column("text") if inside is None else part.column("row").field(inside).cast(pa.binary()):
                words = words_of(text.as_py())
                n_words.append(len(words))
                shard.add(words)
            held.append((part.select(schema.names).take(pa.array(range(part.num_rows), pa.int64())), n_words))  # a copy: a slice would keep its whole batch, texts included
            size += held[-1][0].nbytes
            if shard.size >= shard_symbols or shard.docs >= SHARD_DOCS or size >= SHARD_BYTES:
                yield from flush()
                shard, held, size = _Shard(phrases), [], 0
    yield from flush()


def _searched(rows: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, window: int, block_words: int, shard_symbols: int, inside: int | None = None) -> DataFrame:
    """``row``, ``found`` for every row of ``rows`` (row, text), or (row) where the text is its field ``inside``."""
    spark = rows.sparkSession
    pairs = stored(window_items(benchmark, item_col, item_text_col, window), "windows")
    blocks = max(1, -(-pairs.count() * window // block_words))
    nothing = "named_struct('n_words', 0L, 'spans', cast(array() as array<struct<start:long,end:long>>), 'items', cast(array() as array<string>))"
    rows = rows.withColumn("found", F.expr(nothing))
    kind = f"row {rows.schema['row'].dataType.simpleString()}"
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    found = ("found", pa.struct([("n_words", pa.int64()), ("spans", span), ("items", pa.list_(pa.string()))]))
    last_path = None
    for block in range(blocks):
        mine: dict[tuple[bytes, ...], set[str]] = {}
        for r in pairs.where(F.pmod(F.xxhash64("window", F.coalesce("item", F.lit(""))), F.lit(blocks)) == block).toLocalIterator():  # about block_words words
            mine.setdefault(tuple(bytes(r.window).split()), set()).update(() if r["item"] is None else (r["item"],))
        phrases = spark.sparkContext.broadcast(Phrases(mine))
        last = block == blocks - 1
        wanted = pa.schema([("row", pa.null()), *([] if last or inside is not None else [("text", pa.binary())]), found])
        rows = rows.mapInArrow(lambda it, p=phrases, s=wanted: _pass(it, p.value, s, shard_symbols, inside), f"{kind}, {'text binary, ' if 'text' in wanted.names else ''}found {_FOUND}")
        if not last:
            path = fresh_path(spark, "searched")
            rows = stored(rows, "searched", path)
            phrases.destroy()
            if last_path:
                dropped(spark, last_path)
            last_path = path
    return rows


def removal_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", window: int = WINDOW, block_words: int = 2_000_000, shard_symbols: int = SHARD_SYMBOLS) -> DataFrame:
    """``id``, ``n_words``, ``spans`` (merged, of words, end exclusive) and ``items`` for every row of ``docs``.

    Null and wordless texts have no words and no spans; items of such a text match nothing. Item ids may have any type and are
    given as strings; an item with a null id is hit like any other, but is not among ``items``. Repeated rows stay repeated;
    equal windows of several items count for each of them. With an empty benchmark nothing is hit; empty documents give an empty table.
    """
    rows = docs.select(F.col(id_col).alias("row"), F.col(text_col).cast("string").cast("binary").alias("text"))
    out = _searched(rows, benchmark, item_col, item_text_col, window, block_words, shard_symbols)
    return out.select(F.col("row").alias("id"), "found.n_words", "found.spans", "found.items")


def _n_hit(spans: str) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", percent: int = 5,
                      window: int = WINDOW, block_words: int = 2_000_000, shard_symbols: int = SHARD_SYMBOLS) -> DataFrame:
    """The rows of ``docs``, all their columns, that are not contaminated as ``contamination`` says. No row is shuffled.

    Null and wordless texts stay; columns may have any names.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    held = text_col in docs.columns and docs.schema[text_col].dataType.simpleString() in ("string", "binary")
    rows = docs.select(whole.alias("row"), *([] if held else [F.col(text_col).cast("string").cast("binary").alias("text")]))
    out = _searched(rows, benchmark, item_col, item_text_col, window, block_words, shard_symbols, docs.columns.index(text_col) if held else None)
    n_hit = _n_hit("found.spans")
    clean = out.where(~((n_hit > 0) & (100 * n_hit >= percent * F.col("found.n_words"))))
    return clean.select("row.*")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 5, **options) -> DataFrame:
    """One row per row of ``docs``: n_words, n_hit, n_items, items_sha256, contaminated (hit words at least ``percent`` % of all), spans."""
    found = removal_spans(docs, benchmark, id_col, text_col, **options)
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.withColumn("n_hit", _n_hit("spans")).select(
        F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))).alias("contaminated"), "spans",
    )
