"""Typed attribute filters: a request object becomes one conjunction, a whitelisted order and a limit."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import all_words, norm, norm_contains, norm_value

DEFAULT_LIMIT = 10
# Kilowatts in a horsepower; limits of the licence rule.
KW_PER_HP, LICENCE_KW, LICENCE_KW_PER_KG, BRIDLED_KW = 0.7355, 35.0, 0.2, 70.0


@dataclass(frozen=True)
class SpecFilter:
    """What a caller asks for. ``bounds`` maps a column to (least, most), inclusive; None leaves a side open, 0 counts."""

    brand: str | None = None
    category: str | None = None
    bounds: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    order_by: str | None = None
    count_only: bool = False
    eligible_only: bool = False
    limit: int | None = None


@dataclass(frozen=True)
class SpecTable:
    """Which columns of a table play which part."""

    key: str
    brand: str
    categories: tuple[str, ...]
    numeric: tuple[str, ...]
    default_order: str
    power: str | None = None
    weight: str | None = None


def licence(power_hp: Column, weight_kg: Column) -> tuple[Column, Column]:
    """(eligible, label): within the limits, or strong enough to be bridled. Unknown power is never eligible; unknown or
    zero weight only as one to bridle."""
    kw = power_hp * KW_PER_HP
    direct = (kw <= LICENCE_KW) & (F.try_divide(kw, weight_kg) <= LICENCE_KW_PER_KG)
    bridled = (kw > LICENCE_KW) & (kw <= BRIDLED_KW)
    label = F.when(direct, "direct").when(bridled, "bridled")
    return F.coalesce(direct, F.lit(False)) | F.coalesce(bridled, F.lit(False)), label


def category_included(category: Column, size: Column, excluded: str, conditional: str, least: float) -> Column:
    """False for the excluded category; the conditional one only from a known size of ``least``; all others true."""
    name = F.lower(F.trim(category))
    return F.when(name == excluded, False).when(name == conditional, F.coalesce(size >= least, F.lit(False))).otherwise(True)


def conditions(request: SpecFilter, table: SpecTable) -> list[Column]:
    out = []
    if request.brand is not None:
        out.append(norm_contains(F.col(table.brand), request.brand))
    if request.category is not None:
        value = norm_value(request.category)
        first, *others = (F.col(c) for c in table.categories)
        either = norm(first).contains(value)
        for c in others:
            either = either | norm(F.coalesce(c, F.lit(""))).contains(value)
        out.append(either)
    for name, (least, most) in request.bounds.items():
        if name not in table.numeric:
            raise ValueError(f"no bound on {name}: one of {', '.join(table.numeric)} is needed")
        if least is not None:
            out.append(F.col(name) >= least)
        if most is not None:
            out.append(F.col(name) <= most)
    if request.eligible_only:
        out.append(licence(F.col(table.power), F.col(table.weight))[0])
    return out


def order_of(order_by: str | None, table: SpecTable) -> list[Column]:
    """The whitelisted column, nulls last in both directions, then the key; unknown names fall back to the default, descending."""
    wanted = order_by or f"-{table.default_order}"
    name, down = wanted.lstrip("-"), wanted.startswith("-")
    if name not in table.numeric:
        name, down = table.default_order, True
    return [F.col(name).desc_nulls_last() if down else F.col(name).asc_nulls_last(), F.col(table.key)]


def spec_filter(df: DataFrame, request: SpecFilter, table: SpecTable) -> DataFrame:
    """The rows that meet every condition: their number, or the first of them in order."""
    for condition in conditions(request, table):
        df = df.where(condition)
    if request.count_only:
        return df.agg(F.count("*").alias("matching"))
    return df.orderBy(*order_of(request.order_by, table)).limit(request.limit or DEFAULT_LIMIT)


def word_match_members(owners: DataFrame, members: DataFrame, key: str, text: Column, value: str) -> DataFrame:
    """Owners with at least one member that holds every word."""
    return owners.join(members.where(all_words(text, value)).select(key), key, "left_semi")


def label_members(owners: DataFrame, members: DataFrame, key: str, label: Column, value: str) -> DataFrame:
    """Owners with at least one member whose label contains the value."""
    return owners.join(members.where(norm_contains(label, value)).select(key), key, "left_semi")


def map_without(entries: Column, noise: tuple[str, ...]) -> Column:
    """The map without noise keys, blank values and placeholders."""
    return F.map_filter(entries, lambda k, v: ~k.isin(*noise) & ~F.trim(v).isin("", "Loading..."))


def detail_context(rows: DataFrame, group: list[str], latest: list[Column], best: Column, top: int = 5) -> DataFrame:
    """Per group: its number of rows, its ``top`` latest as an array, and the row with the greatest ``best``. The latest are ranked and
    cut in each task before a group meets, so an array never holds more than ``top``."""
    shown = F.struct(*latest)
    facts = rows.groupBy(*group).agg(F.count("*").alias("n_rows"), F.max_by(shown, best).alias("best"))
    at = F.row_number().over(Window.partitionBy(*group).orderBy(*[c.desc() for c in latest]))
    first = rows.select(*[F.col(g).alias(f"of_{g}") for g in group], shown.alias("shown"), at.alias("at")).where(F.col("at") <= top)
    first = first.groupBy(*[f"of_{g}" for g in group]).agg(F.sort_array(F.collect_list("shown"), asc=False).alias("latest"))
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"of_{g}"))
    return facts.join(first, same).select(*group, "n_rows", "latest", "best")
