"""Retrieval over stored indexes: requests in the words of a user, cover density, BM25 and cells of vectors, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import bm25, cells, fulltext, search
from tessella.plans.catalogue import _DENSE, query
from tessella.sources.readers import scratch_folder, table, until_exit

#: Requests of words, phrases, ``or`` and ``-``, in words that documents have.
REQUESTS = {
    1: "ering tions", 2: '"to be" or heed', 3: '"the ing" -thing', 4: "the of and", 5: "eds or lys -tion", 6: "-ing -ed -the ering", 7: '"of ered" or "thing of the" tion',
    8: "known issues with thing", 9: '"ing the ed"', 10: "er-ing or th nding",
}


def _requests(spark):
    return spark.createDataFrame(list(REQUESTS.items()), "query int, request string")


def _found(spark, d):
    requests = _requests(spark)
    return fulltext.matches(fulltext.index_for(table(spark, d, "documents"), "doc_id", "text", requests), requests)


_MATCHES = fulltext.matches_sql(REQUESTS, "documents", "doc_id", "text")


@query(f"WITH {_MATCHES} SELECT query, id, round(score, 6) AS score FROM matches WHERE level = 0")
def search_requests(spark, d):
    return _found(spark, d).where("level = 0").select("query", "id", F.round("score", 6).alias("score"))


@query(f"""WITH {_MATCHES}, r AS (SELECT *, round(score, 9) AS s, min(level) OVER (PARTITION BY query) AS top FROM matches),
k AS (SELECT query, id, s, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS rank FROM r WHERE level = top) SELECT query, id, round(s, 6) AS score, rank FROM k WHERE rank <= 50""")
def search_ranked(spark, d):
    found = _found(spark, d).withColumn("score", F.round("score", 9))  # equal sums in another order are equal
    return fulltext.ranked(found, 50).withColumn("score", F.round("score", 6))


@query(bm25.topk_sql(("documents", "doc_id", "text"), ("benchmark", "item_id", "text"), 10))
def bm25_topk(spark, d):
    """The documents nearest in words to each benchmark item, by a stored index."""
    path = scratch_folder(spark, "bm25")
    bm25.build(table(spark, d, "documents"), "doc_id", "text", path)
    return bm25.topk(spark.read.parquet(until_exit(spark, path)), table(spark, d, "benchmark"), 10, "item_id", "text")[0]


def _cells(spark, d):
    rows = table(spark, d, "embeddings")
    centroids = cells.train(rows, "embedding")
    path = scratch_folder(spark, "cells")
    cells.build(rows, centroids, "embedding", path)
    return spark.read.parquet(until_exit(spark, path)), rows.where("vec_id % 100 = 0"), centroids


@query(f"WITH {_DENSE} SELECT query_id, id, round(distance, 4) AS distance, rank FROM ranked WHERE rank <= 10")
def vector_cells_exact(spark, d):
    """The nearest vectors by the index of cells, those cells left out that cannot hold one."""
    return cells.nearest(*_cells(spark, d), 10, exact=True)[0].withColumn("distance", F.round("distance", 4))


@query(f"WITH {_DENSE}, f AS (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM dense JOIN embeddings ON vec_id = id WHERE label = 3) SELECT query_id, id, round(distance, 4) AS distance, rank FROM f WHERE rank <= 10")
def vector_cells_filtered(spark, d):
    """The same among the rows of one label: as many as asked for, as the filter holds inside the cells."""
    indexed, asked, centroids = _cells(spark, d)
    return cells.nearest(indexed.where("label = 3"), asked, centroids, 10, exact=True)[0].withColumn("distance", F.round("distance", 4))


@query("SELECT count(*) AS n_queries, true AS recall_reached, true AS cells_spared FROM embeddings WHERE vec_id % 100 = 0")
def vector_cells_recall(spark, d):
    """The quick search against all vectors: whether nine tenths of the true ten nearest are found, and cells are left unread."""
    indexed, asked, centroids = _cells(spark, d)
    found, read = cells.nearest(indexed, asked, centroids, 10, probes=cells.probes_for(indexed, centroids, 10))
    true = search.dense_topk(table(spark, d, "embeddings"), asked, 10).select("query_id", "id")
    hits = true.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left").groupBy("query_id").agg(F.count("hit").alias("hits"), F.count("*").alias("asked"))
    told = hits.join(read, "query_id")
    return told.agg(F.count("*").alias("n_queries"), (F.sum("hits") >= 0.9 * F.sum("asked")).alias("recall_reached"), (F.max("cells_read") < len(centroids)).alias("cells_spared"))
