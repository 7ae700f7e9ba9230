"""A vector index of cells: rows laid out by their nearest centroid, searched cell by cell with whole matrices.

Centroids come from a few rounds of spherical k-means over a bounded sample; every row is indexed. A search reads the cells nearest to each query
first. Rows of a cell are further from a query than the cell's centroid is, less the cell's radius, as angles obey the triangle inequality. So
the k-th angle found excludes cells for certain: the exact search reads the rest of them, the quick one only for queries that have found fewer than
``k`` rows (as under a filter). Rows and queries meet as blocks of one cell, so a pair of vectors is never a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.search import dense_topk
from tessella.sources.readers import scratch_folder, until_exit

CHUNK = 1024  # vectors of one cell that meet a block of queries at once
ROWS, AIMED = 512, 64  # vectors, and queries, that meet all centroids at once
TINY = 1e-7  # a bound is loosened by what rounding can take from an angle


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(until_exit(df.sparkSession, path))


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(places of vectors with a length, their unit vectors)."""
    at = np.flatnonzero(np.asarray(column.is_valid()))
    if not at.size:
        return at, np.zeros((0, 1))
    vectors = column.take(pa.array(at))
    rows = np.concatenate([np.array(vectors.slice(start, ROWS).to_pylist(), np.float64) for start in range(0, len(at), ROWS)])
    length = np.linalg.norm(rows, axis=1)
    return at[length > 0], rows[length > 0] / length[length > 0, None]


def train(rows: DataFrame, vector_col: str, n_cells: int = 0, sample: int = 100_000, rounds: int = 8) -> np.ndarray:
    """Unit centroids, at most ``n_cells`` (if 0 the root of the number of rows, 4096 at most), from about ``sample`` rows chosen by a hash of the vector.

    Sums of a round are made on Spark; the driver holds the centroids. Null and zero vectors teach nothing; without others there is no centroid.
    """
    total = rows.count()
    n_cells = n_cells or min(4096, max(1, round(total**0.5)))
    share = min(1.0, sample / max(1, total))
    mine = _stored(rows.select(F.col(vector_col).alias("v")).where((F.xxhash64("v").cast("double") / 2.0**64 + 0.5 < share) | F.lit(share == 1.0)), "cells-sample")
    begun = mine.where(F.col("v").isNotNull()).dropDuplicates(["v"]).orderBy(F.xxhash64("v"), "v").limit(n_cells).toArrow()
    centroids = _units(begun.column(0).combine_chunks())[1]
    for _ in range(rounds if len(centroids) else 0):
        shared = rows.sparkSession.sparkContext.broadcast(centroids)

        def summed(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            size, sums = np.zeros(len(shared.value), np.int64), np.zeros_like(shared.value)
            for batch in batches:
                _, units = _units(batch.column(0))
                for start in range(0, len(units), ROWS):
                    part = units[start : start + ROWS]
                    cell = (part @ shared.value.T).argmax(1)
                    size += np.bincount(cell, minlength=len(size))
                    np.add.at(sums, cell, part)
            at = np.flatnonzero(size)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(size[at]), pa.array(list(sums[at]), pa.list_(pa.float64()))], names=["cell", "n", "sums"])

        dims = range(centroids.shape[1])
        told = mine.mapInArrow(summed, "cell long, n long, sums array<double>").groupBy("cell").agg(F.array(*[F.sum(F.col("sums")[i]) for i in dims]).alias("sums")).orderBy("cell").toArrow()
        moved = np.array(told.column("sums").to_pylist(), np.float64)
        length = np.linalg.norm(moved, axis=1)
        centroids[told.column("cell").to_numpy()[length > 0]] = moved[length > 0] / length[length > 0, None]
        shared.destroy()
    return centroids


def build(rows: DataFrame, centroids: np.ndarray, vector_col: str, path: str) -> None:
    """Write ``rows``, all their columns, with ``cell`` and ``angle`` (to its centroid) to ``path``, in the order of cells. A large cell is several ranges.
    Null and zero vectors are left out, as no search finds them. A column ``cell`` or ``angle`` of before is replaced."""
    rows = rows.drop("cell", "angle")
    at = rows.columns.index(vector_col)
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, units = _units(batch.column(at))
            if not kept.size:
                continue
            cell, cosine = np.zeros(len(units), np.int64), np.zeros(len(units))
            for start in range(0, len(units), ROWS):
                near = units[start : start + ROWS] @ shared.value.T
                cell[start : start + ROWS] = near.argmax(1)
                cosine[start : start + ROWS] = near.max(1)
            angle = np.arccos(np.clip(cosine, -1, 1))
            out = batch.take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cell), pa.array(angle)], names=[*out.schema.names, "cell", "angle"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    out = rows.mapInArrow(placed, f"{types}, cell long, angle double")
    out.repartitionByRange("cell", "angle").sortWithinPartitions("cell", "angle").write.mode("overwrite").parquet(path)


def _blocks(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """(cell, ids, vectors) blocks of rows (cell, id, unit or raw vector), at most ``CHUNK`` a block."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def out(cell: int) -> pa.RecordBatch:
        ids, units = (np.concatenate(x) for x in zip(*held.pop(cell)))
        return pa.RecordBatch.from_arrays([pa.array([cell]), pa.array([ids], pa.list_(pa.int64())), pa.array([units.tobytes()], pa.binary())], names=["cell", f"{name}_ids", f"{name}_units"])

    for batch in batches:
        at, units = _units(batch.column(2))
        cells, ids = batch.column(0).to_numpy(zero_copy_only=False)[at], batch.column(1).to_numpy(zero_copy_only=False)[at]
        order = np.argsort(cells, kind="stable")
        cells, ids, units = cells[order], ids[order], units[order]
        for start, end in zip(*_runs(cells)):
            for k in range(start, end, CHUNK):
                cell = int(cells[start])
                held.setdefault(cell, []).append((ids[k : min(end, k + CHUNK)], units[k : min(end, k + CHUNK)]))
                if sum(len(i) for i, _ in held[cell]) >= CHUNK:
                    yield out(cell)
        while sum(len(i) for parts in held.values() for i, _ in parts) > 16 * CHUNK:  # rows come in the order of cells, so the first is over
            yield out(next(iter(held)))
    for cell in list(held):
        yield out(cell)


def _runs(values: np.ndarray) -> tuple[list[int], list[int]]:
    edges = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)] if len(values) else [0]
    return edges[:-1], edges[1:]


def _met(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The ``k`` nearest rows of each query in a block of rows and a block of queries."""
    for batch in batches:
        for i in range(batch.num_rows):
            _, ids, units, query, asked = (batch.column(c)[i].as_py() for c in range(5))
            ids, query = np.array(ids, np.int64), np.array(query, np.int64)
            distance = 1.0 - np.frombuffer(asked).reshape(len(query), -1) @ np.frombuffer(units).reshape(len(ids), -1).T
            if len(ids) > k:  # all that are as near as the k-th stay, then ids decide
                far = np.partition(distance, k - 1, axis=1)[:, k - 1 : k]
                row, column = np.nonzero(distance <= far)
            else:
                row, column = np.nonzero(np.ones_like(distance, bool))
            value = distance[row, column]
            order = np.lexsort((ids[column], value, row))
            row, column, value = row[order], column[order], value[order]
            first = np.searchsorted(row, np.arange(len(query)))
            kept = np.arange(len(row)) - first[row] < k
            yield pa.RecordBatch.from_arrays([pa.array(query[row[kept]]), pa.array(ids[column[kept]]), pa.array(value[kept])], names=["query_id", "id", "distance"])


def _in_cells(indexed: DataFrame, wanted: DataFrame, k: int, id_col: str, vector_col: str) -> DataFrame:
    rows = indexed.select("cell", F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    chunks = rows.mapInArrow(lambda b: _blocks(b, "row"), "cell long, row_ids array<long>, row_units binary")
    asked = wanted.select("cell", "query_id", "v").repartition("cell").sortWithinPartitions("cell").mapInArrow(lambda b: _blocks(b, "query"), "cell long, query_ids array<long>, query_units binary")
    return chunks.join(asked, "cell").mapInArrow(lambda b: _met(b, k), "query_id long, id long, distance double")


def probes_for(indexed: DataFrame, centroids: np.ndarray, k: int, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = 0.95, sample: int = 64) -> int:
    """How many cells a query must read to find ``recall`` of its ``k`` nearest rows, measured: ``sample`` rows, chosen by a hash, are searched for in
    all rows, and their true neighbours' cells stand at some place in the order of the query's cells."""
    asked = indexed.orderBy(F.xxhash64(id_col), id_col).limit(sample)
    true = dense_topk(indexed, asked, k, id_col, vector_col).select("query_id", F.col("id").alias(id_col))
    found = true.join(indexed.select(F.col(id_col).cast("long").alias(id_col), "cell"), id_col).join(asked.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).alias("v")), "query_id").select("cell", "v").toArrow()  # at most sample x k rows
    if not found.num_rows:
        return 1
    _, units = _units(found.column("v").combine_chunks())
    near = units @ centroids.T
    own = near[np.arange(len(near)), found.column("cell").to_numpy()][:, None]
    return int(np.quantile((near > own).sum(1), recall, method="higher")) + 1


def nearest(indexed: DataFrame, queries: DataFrame, centroids: np.ndarray, k: int, id_col: str = "vec_id", vector_col: str = "embedding", probes: int = 8, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(``query_id``, ``id``, ``distance``, ``rank``) of the ``k`` nearest rows of each query in the index, and ``query_id``, ``cells_read``.

    The ``probes`` nearest cells of each query are read; then, if ``exact``, all that the k-th distance does not exclude, and else, for queries
    with fewer than ``k`` rows, all others. ``indexed`` may be filtered: filters hold inside the cells, and a query has ``k`` rows if that many fulfil
    them. Ties go to the smaller id. Null and zero vectors find nothing. Runs jobs at once: cells of queries and first finds are written to scratch.
    """
    shared = indexed.sparkSession.sparkContext.broadcast(centroids)
    asked = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).alias("v"))
    radius = _stored(indexed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")), "cells-radius")  # a row for each centroid

    def aimed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, units = _units(batch.column(1))
            for start in range(0, len(at), AIMED):
                angle = np.arccos(np.clip(units[start : start + AIMED] @ shared.value.T, -1, 1)) if len(shared.value) else np.zeros((len(at[start : start + AIMED]), 0))
                place = angle.argsort(1).argsort(1)
                row, cell = np.indices(angle.shape).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[start + row])), pa.array(cell), pa.array(angle.reshape(-1)), pa.array(place.reshape(-1))], names=["query_id", "cell", "angle", "place"])

    cells = _stored(asked.mapInArrow(aimed, "query_id long, cell long, angle double, place long").join(F.broadcast(radius), "cell"), "cells-aimed")  # at most a row for each centroid
    vectors = asked.where(F.col("v").isNotNull())
    first = cells.where(F.col("place") < probes)
    found = _stored(_in_cells(indexed, first.join(vectors, "query_id"), k, id_col, vector_col), "cells-first")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")).cast("long")
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    kth = best.where(F.col("rank") == k).select("query_id", F.acos(F.greatest(F.lit(-1.0), 1 - F.col("distance"))).alias("kth"))
    rest = cells.where(F.col("place") >= probes).join(kth, "query_id", "left")
    rest = rest.where(F.col("kth").isNull() | (F.col("angle") - F.col("radius") <= F.col("kth") + TINY) if exact else F.col("kth").isNull())
    rest = _stored(rest.select("query_id", "cell"), "cells-rest")
    more = _in_cells(indexed, rest.join(vectors, "query_id"), k, id_col, vector_col)
    out = best.drop("rank").unionByName(more).withColumn("rank", rank).where(F.col("rank") <= k)
    return out, first.select("query_id").unionByName(rest.select("query_id")).groupBy("query_id").agg(F.count("*").alias("cells_read"))
