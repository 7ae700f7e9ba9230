"""Merges that rewrite only what a batch touches.

A table is a number of buckets by a hash of its key, and a manifest for each batch that says which folder holds each bucket. A batch reads the
buckets of its keys, merges, writes these buckets to a new folder and publishes all by renaming one manifest into place. So the bytes read and
written grow with the buckets that a batch touches, a reader sees whole batches only, and a batch that runs again starts from the manifest of
the batch before it, whatever it had written. What no kept manifest names is deleted.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

BUCKETS = 256
_MANIFEST = re.compile(r"m(\d+)-[0-9a-f]{32}\.json")


def _fs(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _manifests(spark: SparkSession, path: str) -> list[tuple[int, int, str]]:
    """(batch, when it was published, file) of every manifest, in that order."""
    fs, place = _fs(spark, f"{path}/manifests")
    found = [(s.getPath().getName(), s.getModificationTime(), s.getPath().toString()) for s in (fs.listStatus(place) if fs.exists(place) else ())]
    return sorted((int(m[1]), at, file) for name, at, file in found if (m := _MANIFEST.fullmatch(name)))


def _read(spark: SparkSession, file: str) -> dict:
    return json.loads("".join(r[0] for r in spark.read.text(file, wholetext=True).collect()))  # a line for each bucket


def _publish(spark: SparkSession, path: str, number: int, manifest: dict) -> None:
    name = f"m{number}-{uuid.uuid4().hex}.json"
    fs, draft = _fs(spark, f"{path}/drafts/{name}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/{name}")
    fs.mkdirs(place.getParent())
    if not fs.rename(draft, place):
        raise OSError(f"{name} could not be published")


def _whole(spark: SparkSession, path: str, manifest: dict, wanted: set[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(manifest["schema"])
    folders = sorted({f"{path}/{f}" for b, f in manifest["folders"].items() if wanted is None or int(b) in wanted})
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The table as the last batch, or the last one before ``before``, left it; None if there is none."""
    found = [m for m in _manifests(spark, path) if before is None or m[0] < before]
    return _whole(spark, path, _read(spark, found[-1][2])) if found else None


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def merge_batch(rows: DataFrame, number: int, path: str, keys: list[str], merge: Callable[[DataFrame | None, DataFrame], DataFrame], buckets: int = BUCKETS) -> dict[str, int]:
    """One batch; returns how many ``buckets`` it touched and how many ``bytes`` it wrote.

    ``merge(old or None, batch)`` gets the old rows of the touched buckets alone, so what it makes of a key must depend on that key's rows
    only, and it must keep keys as they are. The number of buckets is set by a table's first batch. Null keys are keys like others. A batch
    without rows publishes the table as it was. Kept are the last batch and the one before it.
    """
    spark = rows.sparkSession
    before = [m for m in _manifests(spark, path) if m[0] < number]
    base = _read(spark, before[-1][2]) if before else None
    buckets = base["buckets"] if base else buckets
    touched = {r[0] for r in rows.select(bucket_of(keys, buckets).alias("b")).distinct().collect()}  # at most ``buckets`` numbers
    folder, size, held = f"data/v{number}-{uuid.uuid4().hex}", 0, {}
    schema = base["schema"] if base else None
    if touched or not base:
        out = merge(_whole(spark, path, base, touched) if base else None, rows)
        schema = json.loads(out.schema.json())
        out.withColumn("_bucket", bucket_of(keys, buckets)).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{path}/{folder}")
        fs, place = _fs(spark, f"{path}/{folder}")
        for status in fs.listStatus(place):
            if status.isDirectory():
                name = status.getPath().getName()
                held[name.partition("=")[2]] = f"{folder}/{name}"
        size = fs.getContentSummary(place).getLength()
    kept = {b: f for b, f in base["folders"].items() if int(b) not in touched} if base else {}
    _publish(spark, path, number, {"buckets": buckets, "schema": schema, "folders": kept | held})
    _tidy(spark, path, number)
    return {"buckets": len(touched), "bytes": size}


def _tidy(spark: SparkSession, path: str, number: int) -> None:
    """Delete the manifests of batches before the last but one, repeats that a later run of their batch replaced, and the folders that none names."""
    found = _manifests(spark, path)
    last = max((m[0] for m in found if m[0] < number), default=number)
    newest = {batch: file for batch, _, file in found}  # the latest of each batch
    named = set()
    for batch, _, file in found:
        if batch < last or newest[batch] != file:
            fs, place = _fs(spark, file)
            fs.delete(place, False)
        else:
            named |= set(_read(spark, file)["folders"].values())
    fs, place = _fs(spark, f"{path}/data")
    for version in fs.listStatus(place) if fs.exists(place) else ():
        name = f"data/{version.getPath().getName()}"
        if not any(f.startswith(f"{name}/") for f in named):
            fs.delete(version.getPath(), True)


def ingest(source: DataFrame, path: str, checkpoint: str, keys: list[str], merge: Callable[[DataFrame | None, DataFrame], DataFrame], buckets: int = BUCKETS) -> StreamingQuery:
    """Run what is there now: each batch of ``source`` is merged into the table at ``path``."""
    run = lambda rows, number: merge_batch(rows, number, path, keys, merge, buckets) and None
    return source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
