"""Hybrid retrieval: exact nearest vectors, keyword matches with a fallback, rank fusion, and a rerank hook.

Many queries are searched at once. Query vectors go out in blocks of bounded size, each partition keeps the best rows of
each query, and only those are shuffled and ranked; no pair beyond them leaves a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import round_exact
from tessella.sources.readers import scratch_folder, until_exit

RRF_K = 60
BLOCK = 4096
ROWS, TILE = 2048, 256  # rows and queries that a task brings together at once


def fetch_size(limit: int, rerank: bool) -> int:
    """How many candidates each leg fetches."""
    return min(max(6 * limit, 20), 50) if rerank else max(3 * limit, 15)


def _nearest(row: np.ndarray, ids: np.ndarray, distance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` nearest of each ``row``; of equals, the smaller id."""
    order = np.lexsort((ids, distance, row))
    row = row[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], ids[order][kept], distance[order][kept]


def _best_of_partition(batches: Iterator[pa.RecordBatch], ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Rows and queries meet in tiles, so what is held besides the best so far does not grow with their numbers."""
    held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # best (query in the tile, id, distance) so far of each tile of queries
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            at = np.flatnonzero(np.asarray(part.column(1).is_valid()))
            if not at.size or not ids.size:
                continue
            rows = np.array(part.column(1).take(pa.array(at)).to_pylist(), np.float64)
            length = np.linalg.norm(rows, axis=1)
            own = part.column(0).to_numpy(zero_copy_only=False)[at][length > 0]
            rows = rows[length > 0] / length[length > 0, None]
            for q in range(0, len(ids) if len(own) else 0, TILE):
                distance = 1.0 - queries[q : q + TILE] @ rows.T
                far = np.partition(distance, k - 1, axis=1)[:, k - 1 : k] if len(own) > k else np.full((len(distance), 1), np.inf)
                row, column = np.nonzero(~(distance > far))  # all that are as near as the k-th, then ids decide
                near = (row, own[column], distance[row, column])
                held[q] = _nearest(*(np.concatenate(x) for x in zip(held[q], near)), k) if q in held else _nearest(*near, k)
    for q, (row, found, distance) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array(ids[q + row]), pa.array(found), pa.array(distance)], names=["query_id", "id", "distance"])


def dense_topk(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """``query_id``, ``id``, ``distance`` (1 - cosine), ``rank`` (from 1) of the ``k`` nearest rows of each query, exactly.

    Ties go to the smaller id. Null and zero vectors are never found and find nothing. Queries are read in blocks of
    about ``block`` vectors, each one pass over the rows; the best rows of a block are written before the next one goes out, and its
    vectors are freed.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    queries = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("v").isNotNull())
    blocks = max(1, -(-queries.count() // block))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")).cast("long")
    parts = []
    for b in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        vectors = np.array(mine.column("v").to_pylist(), np.float64).reshape(mine.num_rows, -1) if mine.num_rows else np.zeros((0, 1))
        length = np.linalg.norm(vectors, axis=1)
        ids = mine.column("id").to_numpy()[length > 0]
        shared = spark.sparkContext.broadcast((ids, vectors[length > 0] / length[length > 0, None]))
        near = rows.mapInArrow(lambda it, s=shared: _best_of_partition(it, *s.value, k), "query_id long, id long, distance double")
        parts.append(near.withColumn("rank", rank).where(F.col("rank") <= k))
        if blocks > 1:
            path = scratch_folder(spark, "nearest")
            parts[-1].write.parquet(path)
            parts[-1] = spark.read.schema(parts[-1].schema).parquet(until_exit(spark, path))
            shared.destroy()
    return reduce(DataFrame.unionByName, parts)


def term_hits(text: Column, terms: list[str]) -> Column:
    """The occurrences of the terms as whole blank-separated words; no other word is made an array element."""
    either = "|".join(f"\\Q{t}\\E" for t in terms)
    return F.regexp_extract_all(F.lower(text), F.lit(rf"(?<!\S)(?:{either})(?!\S)"), F.lit(0))


def sparse_hits(docs: DataFrame, terms: list[str], id_col: str, text_col: str, require_all: bool = True) -> DataFrame:
    """``id``, ``score`` (occurrences of the terms among the blank-separated words) of rows with all terms, or with any."""
    found = term_hits(F.col(text_col), terms)
    rows = docs.select(F.col(id_col).alias("id"), found.alias("found"))
    least = len(set(terms)) if require_all else 1
    return rows.where(F.size(F.array_distinct("found")) >= least).select("id", F.size("found").cast("long").alias("score"))


def sparse_topk(docs: DataFrame, terms: list[str], k: int, id_col: str, text_col: str) -> DataFrame:
    """The ``k`` best rows with all terms; if no row has all, the best with any. Both levels come from one pass: each keeps
    its first ``k``, and the fallback counts only if the first level is empty."""
    found = term_hits(F.col(text_col), terms)
    level = docs.select(F.col(id_col).alias("id"), F.when(F.size(F.array_distinct(found)) >= len(set(terms)), 0).otherwise(1).alias("level"), F.size(found).cast("long").alias("score"))
    level = level.where(F.col("score") > 0)
    first = level.orderBy("level", F.desc("score"), "id").limit(k)
    kept = first.withColumn("top", F.min("level").over(Window.partitionBy(F.lit(0)))).where(F.col("level") == F.col("top"))
    return kept.select("id", "score", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "id")).cast("long").alias("rank"))


def rrf(dense: DataFrame, sparse: DataFrame, keys: list[str], k: int = RRF_K, digits: int | None = None) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists (``rank`` from 1; the k-th place counts 1 / (k + rank - 1)).

    A row of one list alone keeps a null distance or rank of the other. With ``digits`` the sum is rounded after each addition, the dense part first,
    by its exact binary value.
    """
    a = dense.select(*keys, F.col("rank").alias("dense_rank"), *[c for c in dense.columns if c not in (*keys, "rank")])
    b = sparse.select(*keys, F.col("rank").alias("sparse_rank"))
    part = lambda c: F.coalesce(1.0 / (F.lit(k) + F.col(c) - 1), F.lit(0.0))
    both = a.join(b, keys, "full_outer")
    if digits is None:
        return both.withColumn("rrf", part("dense_rank") + part("sparse_rank"))
    return both.withColumn("rrf", round_exact(part("dense_rank"), digits)).withColumn("rrf", round_exact(F.col("rrf") + part("sparse_rank"), digits))


def fused_order() -> list[Column]:
    """The best fused score first; of equals, the nearer vector, then the better keyword match."""
    return [F.desc("rrf"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), F.asc("id")]


def fused_topk(fused: DataFrame, query: list[str], k: int) -> DataFrame:
    """The ``k`` best rows of each query with their ``place``."""
    at = F.row_number().over(Window.partitionBy(*query).orderBy(*fused_order())).cast("long")
    return fused.withColumn("place", at).where(F.col("place") <= k)


def rerank(pool: DataFrame, score: Column | Callable[[DataFrame], DataFrame], limit: int, tie: list[Column]) -> DataFrame:
    """The ``limit`` best rows of a bounded pool by ``score``: an expression, or a function that adds ``rerank_score``."""
    scored = score(pool) if callable(score) and not isinstance(score, Column) else pool.withColumn("rerank_score", score)
    return scored.orderBy(F.desc("rerank_score"), *tie).limit(limit)


def hashing_embedder(size: int = 64) -> Callable:
    """A deterministic stand-in for an embedding model: hashed words, normalised, as a function over a column of text. Built-in functions
    alone, so it runs in generated code; a null text has the vector of zeros."""

    def embed(text: Column | str) -> Column:
        text = F.col(text) if isinstance(text, str) else text
        words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
        places = F.transform(words, lambda w: F.struct(F.pmod(F.crc32(w.cast("binary")), F.lit(size)).cast("int").alias("at"), F.when(F.crc32(w.cast("binary")).bitwiseAND(1 << 20) > 0, 1.0).otherwise(-1.0).alias("by")))
        start = F.array_repeat(F.lit(0.0), size)
        summed = F.aggregate(places, start, lambda v, p: F.transform(v, lambda x, i: F.when(i == p["at"], x + p["by"]).otherwise(x)))
        return F.transform(F.array(summed), lambda v: F.transform(v, lambda x: (x / F.greatest(F.lit(1e-9), F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, y: s + y * y)))).cast("float")))[0]

    return embed
