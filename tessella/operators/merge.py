"""Loads that can run again: upserts with a rule for each column, inserts of absent rows, first and last writers.

All are a union or join on the key; every choice between rows follows an explicit position, never the order of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """``old`` with ``new`` merged by key. A column's rule: ``new`` (the new value where the key is new or repeated), ``keep``
    (the first value stays), ``fill`` (a null new value leaves the old), ``least``, ``greatest``. Keys are unique on each side
    and match null to null."""
    a = old.select(*[F.col(k).alias(f"old_{k}") for k in keys], *[F.col(c).alias(f"old_{c}") for c in rules], F.lit(True).alias("in_old"))
    b = new.select(*[F.col(k).alias(f"new_{k}") for k in keys], *[F.col(c).alias(f"new_{c}") for c in rules], F.lit(True).alias("in_new"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"old_{k}").eqNullSafe(F.col(f"new_{k}"))
    both = a.join(b, on, "full_outer")

    def merged(c: str, rule: str) -> Column:
        before, after = F.col(f"old_{c}"), F.col(f"new_{c}")
        return {
            "new": F.when(F.col("in_new"), after).otherwise(before), "keep": F.when(F.col("in_old"), before).otherwise(after),
            "fill": F.coalesce(after, before), "least": F.least(before, after), "greatest": F.greatest(before, after),
        }[rule].alias(c)

    return both.select(*[F.coalesce(f"old_{k}", f"new_{k}").alias(k) for k in keys], *[merged(c, r) for c, r in rules.items()])


def first_wins(df: DataFrame, keys: list[str], position: list[Column]) -> DataFrame:
    """The first row of each key; null keys are keys like others."""
    return df.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*position))).where("_at = 1").drop("_at")


def insert_absent(target: DataFrame, new: DataFrame, keys: list[str], position: list[Column], null_safe: bool) -> DataFrame:
    """The rows of ``new`` to insert: the first of each key that the target lacks. ``null_safe``: a null key equals a null key
    of the target; otherwise a row with a null key is always absent."""
    fresh = first_wins(new, keys, position)
    held = target.select(*[F.col(k).alias(f"_held_{k}") for k in keys]).distinct()
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(k).eqNullSafe(F.col(f"_held_{k}")) if null_safe else F.col(k) == F.col(f"_held_{k}"))
    return fresh.join(held, on, "left_anti")


def last_writer(updates: DataFrame, keys: list[str], values: list[str], position: Column) -> DataFrame:
    """For each key and column the last value that says something (not null, not empty, not zero). A partial aggregate on
    each side of the shuffle; a hot key costs one row a task."""
    said = lambda c: F.col(c).isNotNull() & ~F.col(c).cast("string").isin("", "0", "0.0", "false")
    return updates.groupBy(*keys).agg(*[F.max_by(F.when(said(c), F.col(c)), F.when(said(c), position)).alias(c) for c in values])


def apply_updates(target: DataFrame, updates: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The target with the updates' values where they have one."""
    named = updates.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in values])
    out = target.join(named, keys, "left")
    return out.withColumns({c: F.coalesce(f"_new_{c}", c) for c in values}).select(*target.columns)


def min_group(df: DataFrame, group: list[str], least: int = 3) -> DataFrame:
    """Rows of groups that have ``least`` rows or more: counted before the shuffle, then joined, so a hot group is not gathered."""
    large = df.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
    return df.join(large, group, "left_semi")


def frontier(urls: DataFrame, done: DataFrame, url: str) -> DataFrame:
    """What is still to do: distinct URLs that no journal lists."""
    return urls.select(url).distinct().join(done.select(url), url, "left_anti")


def answered(attempts: DataFrame, url: str, status: str) -> DataFrame:
    """URLs that need not be asked again: those that some attempt got an answer for, be it an error page. An attempt
    without a status, as after a network error, leaves its URL to do."""
    return attempts.where(F.col(status).isNotNull()).select(url).distinct()


def looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``table`` (one row a key) where it has the key; others stay, with nulls."""
    return rows.join(table, key, "left")
