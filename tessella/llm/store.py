"""Shared scratch storage and small helpers used by every operator of this subpackage.

Intermediate results that are read more than once go to Parquet under ``spark.checkpoint.dir``: they
survive lost executors, cut the lineage, and keep Python stages from running twice. What is written so is
deleted when it is no longer needed (``scratch``, ``dropped``), at the latest when the driver ends.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[str] = []  # scratch folders of this driver that may still exist


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster shares; where none is set, one beside the tables of the warehouse, which is shared too."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext._jsc.sc().getCheckpointDir()
        if context.isDefined():
            return context.get()
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tessella-scratch"
        spark.sparkContext.setCheckpointDir(root)
    return root


def _path(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder's path, to be written once and then told to ``until_exit``."""
    path = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def until_exit(spark: SparkSession, path: str) -> None:
    """The written folder goes when the driver ends, if not before with ``dropped`` or ``scratch``."""
    fs, place = _path(spark, path)
    fs.deleteOnExit(place)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder now; nothing may read it any more."""
    fs, place = _path(spark, path)
    fs.delete(place, True)
    fs.cancelDeleteOnExit(place)
    if path in _written:
        _written.remove(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """All scratch folders made inside are deleted at the end. What the block computes must be written or collected in it."""
    before = set(_written)
    try:
        yield
    finally:
        for path in [p for p in _written if p not in before]:
            dropped(spark, path)


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    df.write.parquet(path)
    until_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % F.lit(modulus)


def joined_in_parts(rows: DataFrame, table: DataFrame, key: str, counts: str, total: int, share: int = 1000) -> DataFrame:
    """``rows`` joined to ``table`` (one row a key, with ``counts``: how many of the ``total`` rows have that key; dropped).

    Keys of over one in ``share`` rows are at most ``share`` in number, so these are broadcast and their rows stay where
    they are; all other rows are shuffled by a key that none of them shares with many.
    """
    most = max(1, total // share)
    hot = F.broadcast(table.where(F.col(counts) > most).drop(counts).limit(share))
    names = [*rows.columns, *(c for c in table.columns if c not in (key, counts))]
    few = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(F.col(counts) <= most).drop(counts), key)
    return rows.join(hot, key).select(*names).unionByName(few.select(*names))
