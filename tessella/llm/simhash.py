"""SimHash near-duplicates: pigeonhole blocks find candidates, the Hamming distance decides.

Fingerprints have 64 bits. They are cut into ``blocks`` parts; two fingerprints that differ in at most
``distance`` bits agree in at least ``blocks - distance`` parts, so every such pair shares one of the
keys made of ``blocks - distance`` parts. With 6 parts and 3 bits, that is 20 keys of 32 bits or more
for each distinct fingerprint, so buckets stay small at any corpus size.

Exact copies collapse to one fingerprint before the join. A bucket larger than ``chunk`` fingerprints is
cut into chunks and each pair of chunks is a group of its own, so no task ever holds a whole hot bucket,
and each group returns a spanning forest of its links, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tessella.llm.components import connected_components
from tessella.llm.store import joined_in_parts, stored

SHINGLE_WORDS = 3
SEED = 42
_STEP = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """The fingerprint of one text in UTF-8; null and wordless texts have fingerprint zero."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and exactly space and \\x09-\\x0d
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE_WORDS + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _STEP):
        part = words[at : at + _STEP + SHINGLE_WORDS - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(SHINGLE_WORDS)))) if len(words) >= SHINGLE_WORDS else [b" ".join(words)]
        hashes = np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist()))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``fp`` (the 64 bits as a signed long), one row per row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def block_masks(blocks: int, distance: int) -> list[int]:
    """One mask for each choice of ``blocks - distance`` parts, as signed longs."""
    if not 0 <= distance < blocks <= 64:
        raise ValueError("need 0 <= distance < blocks <= 64")
    edges = np.linspace(0, 64, blocks + 1).round().astype(int)
    parts = [((1 << int(hi)) - 1) ^ ((1 << int(lo)) - 1) for lo, hi in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(parts, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the graph that links values at most ``distance`` bits apart."""
    left, right, rest = [], [], values
    while rest.size:
        queue, rest = [rest[0]], rest[1:]
        while queue and rest.size:
            near = np.bitwise_count(rest ^ queue[-1]) <= distance
            at = queue.pop()
            if near.any():
                found = rest[near]
                left.append(np.full(found.size, at, np.uint64))
                right.append(found)
                queue.extend(found)
                rest = rest[~near]
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def _bucket_links(batches: Iterator[pa.RecordBatch], distance: int, small: int = 12) -> Iterator[pa.RecordBatch]:
    """Links inside each run of equal (table, key, i, j); the rows arrive sorted by these."""

    def links(table: pa.Table) -> pa.RecordBatch:
        fp = table.column("fp").to_numpy().view(np.uint64)
        keys = [table.column(c).to_numpy() for c in ("table", "key", "i", "j")]
        new = np.zeros(fp.size, bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        new[:1] = True
        run = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, fp.size))
        left, right = [], []
        at = np.flatnonzero(sizes[run] <= small)  # of small runs, all pairs at once, by how far apart they stand
        for step in range(1, small):
            at = at[at + step < fp.size]
            at = at[run[at] == run[at + step]] if at.size else at
            if not at.size:
                break
            near = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= distance]
            left.append(fp[near])
            right.append(fp[near + step])
        for s in np.flatnonzero(sizes > small):
            a, b = _forest(np.unique(fp[starts[s] : starts[s] + sizes[s]]), distance)
            left.append(a)
            right.append(b)
        a, b = (np.concatenate([np.zeros(0, np.uint64), *x]).view(np.int64) for x in (left, right))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    held: list[pa.RecordBatch] = []  # the last run may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch])
        keys = [table.column(c).to_numpy() for c in ("table", "key", "i", "j")]
        same = np.ones(table.num_rows, bool)
        for k in keys:
            same &= k == k[-1]
        cut = table.num_rows - (int(np.argmin(same[::-1])) if not same.all() else table.num_rows)
        if cut:
            yield links(table.slice(0, cut).combine_chunks())
        held = table.slice(cut).to_batches()
    if held:
        yield links(pa.Table.from_batches(held).combine_chunks())


def fingerprint_links(distinct: DataFrame, distance: int = 3, blocks: int = 6, chunk: int = 1024) -> DataFrame:
    """``a``, ``b``: links between distinct fingerprints (column ``fp``) that keep every component whole.

    In buckets of up to a dozen fingerprints all links are returned; in larger ones a spanning forest of
    all links of each pair of chunks.
    """
    keys = [F.struct(F.lit(t).cast("int").alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(block_masks(blocks, distance))]
    spread = distinct.repartition(distinct.sparkSession.sparkContext.defaultParallelism, "fp")  # else the few files of a small list bound the tasks
    rows = spread.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.table", "k.key")
    sizes = rows.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = rows.join(sizes, ["table", "key"])
    parts = F.ceil(F.col("n") / F.lit(chunk)).cast("int")
    members = members.withColumn("parts", parts).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("parts") - 1), F.col("c")))
    members = members.withColumn("o", F.explode(others))
    groups = members.select("table", "key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "fp")
    dealt = groups.repartition("table", "key", "i", "j").sortWithinPartitions("table", "key", "i", "j")
    return dealt.mapInArrow(lambda it: _bucket_links(it, distance), "a long, b long").distinct()


def fingerprint_classes(prints: DataFrame, distance: int = 3, blocks: int = 6) -> DataFrame:
    """``fp``, ``class`` (the smallest fingerprint reachable) of every distinct fingerprint of ``prints``."""
    distinct = stored(prints.select("fp").distinct(), "simhash-distinct")
    labels = connected_components(fingerprint_links(distinct, distance, blocks))
    return stored(distinct.join(labels, distinct.fp == labels.node, "left").select("fp", F.coalesce("component", "fp").alias("class")), "simhash-classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3, blocks: int = 6) -> DataFrame:
    """``<id_col>``, ``fingerprint`` (16 hex digits), ``component_id`` for every row of ``docs``.

    ``component_id`` is the smallest id reachable by links of at most ``distance`` bits, the row's own included.
    Null and wordless texts share fingerprint zero and link like any others. Repeated rows stay repeated. A null
    id counts for no minimum: a component with null ids alone has a null component_id. An empty table gives an
    empty result. Other columns of ``docs`` are not read.
    """
    prints = stored(fingerprints(docs, id_col, text_col), "simhash-prints")
    classes = fingerprint_classes(prints, distance, blocks)
    classed = prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")).join(classes, "fp")
    least = classed.groupBy("class").agg(F.min("least").alias("component_id"))
    members = stored(classed.join(least, "class").select("fp", "component_id", "n"), "simhash-members")
    total = members.agg(F.sum("n")).first()[0] or 0
    out = joined_in_parts(prints, members, "fp", "n", total)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


_BITS = 32768  # of one bitmap
_MAPS = 4096  # bitmaps at most: 16 MiB


def _maybe_in(keys: DataFrame, n: int, a: str = "a", b: str = "b") -> tuple[DataFrame, Column, Callable[[Column], Column]]:
    """Bitmaps (slot, map) of the hashes of ``n`` keys, at most ``_MAPS`` of them; a key's slot; and whether the map of its slot may hold it."""
    maps = min(_MAPS, max(1, 1 << (16 * n // _BITS).bit_length()))
    place = F.pmod(F.xxhash64(F.lit("map"), a, b), F.lit(maps * _BITS))
    slot, bit = F.floor(place / _BITS).cast("int"), F.pmod(place, F.lit(_BITS)).cast("int")
    table = keys.groupBy(slot.alias("slot")).agg(F.bitmap_construct_agg(bit.cast("long")).alias("map"))
    byte = lambda m: F.conv(F.hex(F.substring(m, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return table, slot, lambda m: F.coalesce(F.call_function("shiftright", byte(m), F.pmod(bit, F.lit(8))).bitwiseAND(1) == 1, F.lit(False))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3, blocks: int = 6) -> DataFrame:
    """The rows of ``docs``, all their columns, that stay when one row of each near-duplicate class does: that with the smallest id.

    Of rows with that id, the one whose text has the smallest hash stays, and of equal rows one. Null ids come last, so a class
    of null ids alone also keeps one. Classes are those of ``near_duplicates``. Columns may have any names; an empty table gives an empty one.

    Bitmaps of bounded size tell which rows may have to go or may be repeated. All others stay where they are; only those are
    shuffled with their texts and held against the list of kept rows.
    """
    text, own = F.col(f"`{text_col}`").cast("string"), F.col(f"`{id_col}`")
    keys = [F.xxhash64(F.lit(k), F.coalesce(own.cast("string"), F.lit("")), F.coalesce(text, F.lit("")), own.isNull(), text.isNull()) for k in (0, 1)]
    rows = docs.select(F.struct(own.isNull().alias("none"), own.alias("id"), keys[0].alias("a"), keys[1].alias("b")).alias("row"), text.alias("text"))
    prints = stored(fingerprints(rows, "row", "text"), "simhash-prints")
    classes = fingerprint_classes(prints, distance, blocks)
    first = prints.groupBy("fp").agg(F.min("id").alias("row")).join(classes, "fp").groupBy("class").agg(F.min("row").alias("row"))
    first = stored(first.select("row.a", "row.b"), "simhash-kept")
    counted = prints.groupBy(F.col("id.a").alias("a"), F.col("id.b").alias("b")).agg(F.count("*").alias("n"))
    open_keys = stored(counted.join(first.withColumn("kept", F.lit(True)), ["a", "b"], "left").where("kept is null or n > 1").select("a", "b"), "simhash-open")
    maps, slot, held = _maybe_in(open_keys, open_keys.count())
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), keys[0].alias("a"), keys[1].alias("b"))
    told = whole.withColumn("slot", slot).join(F.broadcast(maps), "slot", "left").withColumn("open", held(F.col("map"))).select("row", "a", "b", "open")
    kept = told.where("open").join(first, ["a", "b"]).dropDuplicates(["a", "b"])
    return told.where("not open").select("row").unionByName(kept.select("row")).select("row.*")
