"""The catalogue's tools: filter by attributes, search what owners write, look a product up.

A tool is a plan over the catalogue's tables; ``requests.run_tool`` checks its arguments. Text comes in, so the catalogue
carries the embedder, and a reranker if there is one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import all_words, norm_contains
from tessella.operators import filters, fulltext, search
from tessella.plans.requests import Tool

SIZES = ("displacement_ccm", "weight_kg", "power_hp", "torque_nm", "seat_height_mm")
SHEET = ("brand", "model", "year", "category", "category_fr", *SIZES, "msrp_eur", "url")
PRODUCTS = filters.SpecTable("id", "brand", ("category", "category_fr"), ("year", *SIZES, "msrp_eur"), "year", power="power_hp", weight="weight_kg")
# The arguments that bound a column; rows of a sheet that say nothing; labels of the licence rule; sizes of answers.
LEAST = {f"min_{c}": c for c in ("year", "displacement_ccm", "weight_kg", "power_hp", "seat_height_mm")}
MOST = {f"max_{c}": c for c in ("year", "displacement_ccm", "weight_kg", "power_hp", "seat_height_mm", "msrp_eur")}
NOISE = ("Rating", "Ask questions", "Update specs", "Related bikes", "Maintenance", "Insurance costs")
LICENCE_LABELS = {"direct": "A2", "bridled": "A2 bridable"}
SEARCH_LIMIT, DETAIL_ROWS, RECENT_RECALLS, DEFECT_CHARS = 5, 3, 5, 180


@dataclass(frozen=True)
class Catalogue:
    """products: id, the columns of ``SHEET``, family_id, raw_specs. families: id, brand, family_name, year_min, year_max. comments:
    id, family_id, comment_text, author, posted_at, embedding. recalls and prices: as ``plans.loads`` makes them.

    ``rerank`` adds ``rerank_score`` to a pool of at most 50 rows, given the query.
    """

    products: DataFrame
    families: DataFrame
    comments: DataFrame
    recalls: DataFrame
    prices: DataFrame
    embed: Callable[[Column], Column]
    rerank: Callable[[DataFrame, str], DataFrame] | None = None


def filter_specs(c: Catalogue, brand: str | None = None, category: str | None = None, order_by: str | None = None, a2_only: bool = False,
                 count_only: bool = False, limit: int | None = None, **bounds: float | None) -> DataFrame:
    """Products that meet every condition, with the licence label, in order; or their number, which goes before order and limit."""
    wanted: dict[str, tuple[float | None, float | None]] = {}
    for name, value in bounds.items():
        if name not in LEAST and name not in MOST:
            raise TypeError(f"filter_specs takes no argument '{name}'")
        column = LEAST.get(name) or MOST[name]
        least, most = wanted.get(column, (None, None))
        wanted[column] = (value, most) if name in LEAST else (least, value)
    request = filters.SpecFilter(brand or None, category or None, wanted, order_by, count_only, a2_only, int(limit) if limit else None)
    out = filters.spec_filter(c.products, request, PRODUCTS)
    if count_only:
        return out
    label = filters.licence(F.col("power_hp"), F.col("weight_kg"))[1]
    return out.select(*SHEET, F.coalesce(*[F.when(label == k, v) for k, v in LICENCE_LABELS.items()]).alias("a2"))


def search_reviews(c: Catalogue, query: str, brand: str | None = None, model: str | None = None, category: str | None = None, limit: int | None = None) -> DataFrame:
    """Comments near the query: the nearest vectors and the densest matches of its stemmed words and phrases, fused by rank and, if there is a reranker and more than
    ``limit`` are found, reranked. The filters go by family: its brand, the words and the category of any of its products."""
    limit = int(limit or SEARCH_LIMIT)
    fetch = search.fetch_size(limit, c.rerank is not None)
    families = c.families.select(F.col("id").alias("family_id"), "brand", F.col("family_name").alias("model_family"), F.col("year_min").alias("family_year_min"), F.col("year_max").alias("family_year_max"))
    if brand:
        families = families.where(norm_contains(F.col("brand"), brand))
    members = c.products.where(F.col("family_id").isNotNull())
    if model:
        families = filters.word_match_members(families, members, "family_id", F.concat("brand", F.lit(" "), "model"), model)
    if category:
        families = filters.label_members(families, members, "family_id", F.col("category"), category)
    rows = c.comments.join(families, "family_id") if not (brand or model or category) else c.comments.join(families.select("family_id"), "family_id", "left_semi").join(families, "family_id")
    asked = c.comments.sparkSession.range(1).select(F.col("id"), c.embed(F.lit(query)).alias("embedding"))
    dense = search.dense_topk(rows, asked, fetch, "id", "embedding").drop("query_id")
    sparse = fulltext.search_texts(rows, query, fetch, "id", "comment_text").select("id", "rank")
    order = search.fused_order()
    pool = search.rrf(dense, sparse, ["id"]).orderBy(*order).limit(fetch)
    found = rows.drop("embedding", "family_id").join(F.broadcast(pool), "id")  # at most 50 rows
    names = ["brand", "model_family", "family_year_min", "family_year_max", "comment_text", "author", "posted_at", "distance", "rrf"]
    if c.rerank is None:
        return found.orderBy(*order).limit(limit).select(*names)
    many = F.count("*").over(Window.partitionBy(F.lit(0))) > limit
    scored = c.rerank(found, query).withColumn("rerank_score", F.when(many, F.round("rerank_score", 4)))
    return scored.orderBy(F.desc_nulls_last("rerank_score"), *order).limit(limit).select(*names, "rerank_score")


def product_details(c: Catalogue, model: str, brand: str | None = None, year: int | None = None) -> DataFrame:
    """The newest products that hold every word, with their sheets, and a last row with the ``context`` of their families."""
    found = c.products.where(all_words(F.concat("brand", F.lit(" "), "model"), model))
    if brand:
        found = found.where(norm_contains(F.col("brand"), brand))
    if year is not None:
        found = found.where(F.col("year") == int(year))
    found = found.orderBy(F.desc("year"), "id").limit(DETAIL_ROWS)
    specs = F.coalesce(filters.map_without(F.col("raw_specs"), NOISE), F.create_map().cast("map<string,string>"))
    rows = found.select(*SHEET, specs.alias("specs"))
    families = sorted({r[0] for r in found.select("family_id").collect()} - {None})  # of three rows at most
    return rows.unionByName(family_context(c, families), allowMissingColumns=True) if families else rows


def family_context(c: Catalogue, families: list[int]) -> DataFrame:
    """``families_context`` of the families of a few products."""
    return families_context(c, c.products.sparkSession.createDataFrame([(f,) for f in families], "id long"))


def families_context(c: Catalogue, families: DataFrame) -> DataFrame:
    """One row, ``context``, for families (id): how many recalls there are, the latest of them, and the price estimate from most listings."""
    mine = families.select(F.col("id").alias("family_id")).distinct()
    recalls = c.recalls.join(mine, "family_id", "left_semi")
    total = recalls.agg(F.count("*").alias("known_recalls_total"))
    recent = recalls.orderBy(F.desc_nulls_last("model_year"), "campno", "family_id").limit(RECENT_RECALLS)
    shown = F.struct(F.coalesce("model_year", F.lit(-1)).alias("at"), "campno", "model_year", "component", F.left("defect", F.lit(DEFECT_CHARS)).alias("defect"), "units_affected")
    recent = recent.agg(F.sort_array(F.collect_list(shown), False).alias("r"))  # of at most RECENT_RECALLS rows
    recent = recent.select(F.transform("r", lambda x: F.struct(*[x[n].alias(n) for n in ("model_year", "component", "defect", "units_affected")])).alias("recent_recalls"))
    estimate = F.struct("n_listings", "price_median", "price_p25", "price_p75", "mileage_median", "snapshot_year")
    price = c.prices.join(mine, "family_id", "left_semi").where(F.col("reg_year").isNull()).agg(F.max_by(estimate, F.struct(F.col("n_listings"), -F.col("family_id"))).alias("used_price_estimate"))
    return total.crossJoin(recent).crossJoin(price).select(F.struct("known_recalls_total", "recent_recalls", "used_price_estimate").alias("context"))  # three rows of one


def tools(c: Catalogue) -> dict[str, Tool]:
    """The tools by name, for ``requests.run_tool``."""
    asked = lambda a: " ".join(["what owners like and complain about", *(str(a[k]) for k in ("brand", "model", "category") if a.get(k))])
    return {
        "filter_specs": Tool(lambda **a: filter_specs(c, **a), ("brand", "category", *LEAST, *MOST, "order_by", "a2_only", "count_only", "limit")),
        "search_reviews": Tool(lambda **a: search_reviews(c, **a), ("query", "brand", "model", "category", "limit"), ("query",), {"query": asked}),
        "get_bike_details": Tool(lambda **a: product_details(c, **a), ("model", "brand", "year"), ("model",)),
    }
