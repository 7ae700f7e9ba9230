"""Incremental ingest: new files become idempotent merges, batch by batch.

The checkpoint says what was read. A batch writes a whole new version of the table into a folder of its own, beside the old
ones. It merges into the last version of an earlier batch, so a batch that runs again starts from the same rows as before,
whatever it had written. A lost driver leaves whole tables only.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

_VERSION = re.compile(r"v(\d+)-")


def _versions(spark: SparkSession, path: str) -> tuple[object, list[tuple[int, int, object]]]:
    """The file system, and (batch, when it ended, folder) of every whole version, in that order."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in fs.listStatus(place) if fs.exists(place) else ():
        folder = status.getPath()
        ended = spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")
        if (told := _VERSION.match(folder.getName())) and fs.exists(ended):
            found.append((int(told[1]), fs.getFileStatus(ended).getModificationTime(), folder))
    return fs, sorted(found, key=lambda v: v[:2])


def current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The last whole version of a table, of batches before ``before`` if given; None without one."""
    whole = [v for v in _versions(spark, path)[1] if before is None or v[0] < before]
    return spark.read.parquet(whole[-1][2].toString()) if whole else None


def ingest(source: DataFrame, path: str, checkpoint: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> StreamingQuery:
    """Run what is there now: each batch of ``source`` is merged into the table at ``path`` by ``merge(old or None, batch)``."""
    return source.writeStream.foreachBatch(lambda rows, number: merge_batch(rows, number, path, merge)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_batch(rows: DataFrame, number: int, path: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> None:
    """One batch. Kept are its version and that of the batch before, from which it would start again; older ones go."""
    spark = rows.sparkSession
    merge(current(spark, path, number), rows).write.parquet(f"{path}/v{number}-{uuid.uuid4().hex}")
    fs, versions = _versions(spark, path)
    last = max((v[0] for v in versions if v[0] < number), default=number)
    for batch, _, folder in versions:
        if batch < last:
            fs.delete(folder, True)


def json_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)
