"""Journals of a crawl in levels: what is done below makes done what is above, and a crawl resumes at each level.

A thread is done when its page was read and as many comments are stored as it announced; a forum when its page was read and all its threads are
done; a product when its forum is. Each level is one stream with keyed state and one journal, a table of nodes that are done, which is the
source of the level above. So a level that stops, with its driver or alone, goes on from its own checkpoint, and data always come before the
journal that vouches for them.

Children are counted once however often they are stored or replayed (state of distinct children, spread by child), then by task, and only these
counts meet at their parent: a parent with a third of all children costs one row for each task and Arrow batch. State is a few numbers a node, and
nodes share a row of state and a Python call with those of the same hash, as a call costs more than what is done for many nodes. On
a large cluster set ``spark.sql.streaming.stateStore.providerClass`` to the RocksDB provider, so that state need not fit in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DONE = "parent string, node string"
_STATE = "node array<string>, seen array<long>, expected array<long>, parent array<string>, closed array<boolean>"
GROUPS = 1024  # nodes share a call and a row of state with those of the same hash
_MET = "node string, seen long, expected long, parent string"


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The children of each parent in one Arrow batch."""
    for rows in batches:
        counts = rows["parent"].value_counts()
        yield pd.DataFrame({"node": counts.index.astype(object), "seen": counts.to_numpy(), "expected": pd.array([None] * len(counts), dtype="Int64"), "parent": pd.array([None] * len(counts), dtype=object)})


def _closed(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The nodes of one group in one call: what each has seen so far, and itself once that is all it announced."""
    held = state.get if state.exists else ([], [], [], [], [])
    known = {node: told for node, *told in zip(*held)}
    done = []
    for rows in parts:  # a row for each task and Arrow batch with children, and one for each announcement
        for node, more, most, above in zip(*(rows[c].to_numpy() for c in ("node", "seen", "expected", "parent"))):
            told = known.setdefault(node, [0, None, None, False])
            told[0] += int(more)
            if most == most and most is not None and (told[1] is None or (int(most), above or "") > (told[1], told[2] or "")):  # not NaN: announced
                told[1], told[2] = int(most), above
    for node, told in known.items():
        if not told[3] and told[1] is not None and told[0] >= told[1]:
            told[3] = True
            done.append((told[2], node))
    state.update((list(known), *(list(c) for c in zip(*known.values()))))
    if done:
        yield pd.DataFrame(done, columns=["parent", "node"])


def completed(children: DataFrame, announced: DataFrame, groups: int = GROUPS) -> DataFrame:
    """The nodes of one level as they become done, each once, with their parents: two streams in, one out.

    ``children`` has ``parent, node``: children that are done. ``announced`` has ``node, parent, children``: a node whose page was read and how
    many children it lists; none (null or 0) makes it done at once. A node announced several times has the greatest number, and of equal ones the
    greatest parent. What is done stays done, as a line of a journal does, also if more is announced later. Rows without a node, and children
    without a parent, count for nothing; further columns are left aside. State is kept for ``groups`` groups of nodes, a number that a checkpoint keeps
    for good: more groups make smaller rows of state, fewer groups fewer calls.
    """
    held = children.select(F.col("parent").cast("string").alias("parent"), F.col("node").cast("string").alias("node")).where("parent IS NOT NULL AND node IS NOT NULL")
    counts = held.dropDuplicates(["parent", "node"]).mapInPandas(_counted, _MET)
    told = announced.select(F.col("node").cast("string").alias("node"), F.lit(0).cast("long").alias("seen"), F.coalesce(F.col("children"), F.lit(0)).cast("long").alias("expected"), F.col("parent").cast("string").alias("parent"))
    met = counts.unionByName(told.where("node IS NOT NULL"))
    return met.withColumn("near", F.pmod(F.xxhash64("node"), F.lit(groups))).groupBy("near").applyInPandasWithState(_closed, DONE, _STATE, "append", GroupStateTimeout.NoTimeout)


def run_level(children: DataFrame, announced: DataFrame, journal: str, checkpoint: str, groups: int = GROUPS) -> StreamingQuery:
    """Run what is there now and add the nodes that become done to the journal. A batch that runs again adds nothing twice."""
    return completed(children, announced, groups).writeStream.format("parquet").option("path", journal).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def journal_stream(spark: SparkSession, journal: str) -> DataFrame:
    """A journal as the children of the level above."""
    return spark.readStream.schema(DONE).parquet(journal)


def journal_table(spark: SparkSession, journal: str) -> DataFrame:
    """The nodes that are done; only whole batches are seen."""
    return spark.read.schema(DONE).parquet(journal)


def still_open(products: DataFrame, threads: DataFrame, forums_done: DataFrame, threads_done: DataFrame) -> DataFrame:
    """Where a crawl goes on: (level, node), each once.

    ``products`` has ``node, forum``: a product is open while its forum is not done, one without a forum never. ``threads`` has ``node, parent``: threads
    that a forum's page listed. A forum is open if a product waits for it, and of an open forum the threads that are not done are open.
    """
    waiting = products.where("forum IS NOT NULL AND node IS NOT NULL").select(F.col("node").cast("string").alias("node"), F.col("forum").cast("string").alias("forum"))
    waiting = waiting.join(forums_done.select(F.col("node").alias("forum")), "forum", "left_anti").distinct()
    forums = waiting.select(F.col("forum").alias("node")).distinct()
    listed = threads.where("node IS NOT NULL").select(F.col("node").cast("string").alias("node"), F.col("parent").cast("string").alias("parent"))
    left = listed.join(threads_done.select("node"), "node", "left_anti").join(forums.select(F.col("node").alias("parent")), "parent", "left_semi")
    levels = [("product", waiting.select("node")), ("forum", forums), ("thread", left.select("node").distinct())]
    out = [rows.select(F.lit(level).alias("level"), "node") for level, rows in levels]
    return out[0].unionByName(out[1]).unionByName(out[2])
