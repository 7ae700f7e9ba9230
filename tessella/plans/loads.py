"""Whole loads: scraped rows, price pages, recall files and listings become the tables that the tools read.

Each load is a plan over the operators and can run again: keys are hashes of natural keys, every choice between rows
goes by an explicit ``position``, and nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import date_or_null, norm, number_with_unit, straight_quotes, tokens, words
from tessella.operators import analytics, matching, merge

# Labels of a specification sheet, by field and unit.
SPEC_LABELS = {
    "displacement_ccm": ("ccm", ("displacement", "engine size")),
    "weight_kg": ("kg", ("weight incl. oil, gas, etc", "weight", "dry weight")),
    "power_hp": ("HP", ("power output", "power", "output", "effect")),
    "torque_nm": ("Nm", ("torque",)),
    "seat_height_mm": ("mm", ("seat height",)),
}
# Brands whose names differ between sources.
BRAND_ALIASES = {"cfmoto": "cf moto", "victory usa": "victory", "zero motorcycles": "zero", "royal enfield": "enfield", "mz  muz": "mz"}
# Positions of a recall file's fields, its number of fields, and the year that means none.
RECALL_FIELDS = {"campno": 1, "make": 2, "model": 3, "model_year": 4, "component": 6, "units_affected": 11, "report_date": 15, "defect": 19, "consequence": 20, "corrective": 21}
RECALL_LEAST_FIELDS, NO_YEAR = 23, 9999
# Plausible asking prices and years; year offsets of listings; comments a family needs.
ASKING_PRICES, PAGE_YEARS, LISTING_OFFSETS, LEAST_COMMENTS = (200, 80_000), (1894, 2027), (0, -1, -2, -3, 1), 3


def typed_field(specs: Column, field: str) -> Column:
    """The number of the first label, in the sheet's order, that stands for ``field`` and has one before its unit.

    Maps read from JSON, and those of ``sources.extract``, keep the order of the sheet.
    """
    unit, labels = SPEC_LABELS[field]
    mine = F.filter(F.map_entries(specs), lambda e: F.lower(F.trim(e["key"])).isin(*labels))
    return F.get(F.filter(F.transform(mine, lambda e: number_with_unit(e["value"], unit)), lambda v: v.isNotNull()), F.lit(0))


def family_id(url: Column) -> Column:
    return F.when(F.nullif(url, F.lit("")).isNotNull(), F.xxhash64(url))


def families_of(products: DataFrame) -> DataFrame:
    """One family for each discussion page: ``discussion_url``, ``brand`` (the most frequent, of equals the first),
    ``family_name``, ``year_min``, ``year_max``. products: url, brand, model, year, discussion_url, position."""
    rows = products.where(F.col("discussion_url") != "")
    years = rows.groupBy("discussion_url").agg(F.min("year").alias("year_min"), F.max("year").alias("year_max"))
    brand = analytics.mode_first_seen(rows, ["discussion_url"], "brand", F.col("position")).withColumnRenamed("mode_brand", "brand")
    name = analytics.common_name(rows, "discussion_url", "model", F.col("position")).withColumnRenamed("display_name", "family_name")
    return years.join(brand, "discussion_url").join(name, "discussion_url")


def load_families(old: DataFrame, products: DataFrame) -> DataFrame:
    """Names follow the new batch; the years only widen."""
    out = merge.upsert(old, families_of(products), ["discussion_url"], {"brand": "new", "family_name": "new", "year_min": "least", "year_max": "greatest"})
    return out.withColumn("id", family_id(F.col("discussion_url")))


def load_products(old: DataFrame, rows: DataFrame) -> DataFrame:
    """Products by url. Names, year, category and price of a known product stay; family, sizes and sheet follow the new row.

    A size is the scraped one, or else what the sheet says; of the displacement zero counts as unknown, and the listing's
    stands in. rows: url, brand, model, year, category, discussion_url, listed_ccm, raw_specs, position, and the sizes.
    """
    sizes = {f: F.coalesce(F.col(f).cast("double"), typed_field(F.col("raw_specs"), f)) for f in SPEC_LABELS}
    sizes["displacement_ccm"] = F.coalesce(F.nullif(sizes["displacement_ccm"], F.lit(0.0)), F.col("listed_ccm").cast("double"))
    kept = ("brand", "model", "year", "category", "category_fr", "msrp_eur")
    first = F.struct("brand", "model", "year", "category", F.lit(None).cast("string").alias("category_fr"), F.lit(None).cast("double").alias("msrp_eur"))
    last = F.struct(family_id(F.col("discussion_url")).alias("family_id"), *[c.alias(f) for f, c in sizes.items()], "raw_specs")
    new = rows.groupBy("url").agg(F.min_by(first, "position").alias("first"), F.max_by(last, "position").alias("last")).select("url", "first.*", "last.*")
    out = merge.upsert(old, new, ["url"], {c: "keep" for c in kept} | {c: "new" for c in ("family_id", *SPEC_LABELS, "raw_specs")})
    return out.withColumn("id", F.xxhash64("url"))


def new_comments(old: DataFrame, scraped: DataFrame, products: DataFrame, families: DataFrame, embed: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(comments to insert, one row with ``skipped_no_family``). scraped: product_url, author, posted_at, text, position.

    A comment finds its family by way of its product. Equal comments of a family count once; families with fewer than
    ``LEAST_COMMENTS`` are left out; what the table holds already is not inserted, where author and date are known.
    """
    found = merge.looked_up(scraped, products.select(F.col("url").alias("product_url"), "family_id"), "product_url")
    found = merge.looked_up(found, families.select(F.col("id").alias("family_id"), F.lit(True).alias("known")), "family_id")
    skipped = found.agg(F.count_if(F.col("known").isNull()).alias("skipped_no_family"))
    rows = found.where("known").withColumn("comment_text", straight_quotes(F.col("text"))).withColumn("digest", F.md5("comment_text"))
    unique = merge.first_wins(rows, ["family_id", "author", "posted_at", "digest"], [F.col("position")])
    kept = merge.min_group(unique, ["family_id"], LEAST_COMMENTS)
    held = old.select("family_id", "author", "posted_at", F.md5("comment_text").alias("digest"))
    fresh = merge.insert_absent(held, kept, ["family_id", "author", "posted_at", "digest"], [F.col("position")], null_safe=False)
    out = fresh.select(F.xxhash64("family_id", "author", "posted_at", "digest").alias("id"), "family_id", "comment_text", "author", "posted_at", embed(F.col("comment_text")).alias("embedding"))
    return out, skipped


def load_list_prices(products: DataFrame, pages: DataFrame) -> DataFrame:
    """Products with list prices and local categories of the pages that match them; the last page that says something wins.

    pages: brand, model, year, price_eur, category_fr, position (unique). All products that tie for a page get its price.
    """
    pages = pages.where(F.col("year").between(*PAGE_YEARS))
    brand = reduce(lambda c, a: F.when(F.col("brand") == a[0], a[1]).otherwise(c), BRAND_ALIASES.items(), F.col("brand"))
    source = pages.select(F.col("position").alias("source_id"), tokens(F.concat_ws(" ", brand, "model")).alias("source_tokens"), F.col("year").alias("source_year"))
    matches = matching.match_by_tokens(source, _product_tokens(products))
    said = pages.select("position", F.col("price_eur").cast("double").alias("msrp_eur"), "category_fr")
    updates = matches.select(F.col("source_id").alias("position"), F.col("row_id").alias("id")).hint("merge").join(said.hint("merge"), "position")
    return merge.apply_updates(products, merge.last_writer(updates, ["id"], ["msrp_eur", "category_fr"], F.col("position")), ["id"], ["msrp_eur", "category_fr"])


def _product_tokens(products: DataFrame, *more: str) -> DataFrame:
    return products.select(F.col("id").alias("row_id"), tokens(F.concat_ws(" ", "brand", "model")).alias("row_tokens"), F.col("year").alias("row_year"), *more)


def new_recalls(old: DataFrame, records: DataFrame, families: DataFrame) -> DataFrame:
    """Recalls to insert: (campaign, family, year) that the table lacks, a null year equal to a null year, the first record of each.

    records: the fields of ``RECALL_FIELDS`` as text, and position. A family takes the records of its brand whose model holds
    all its words and whose year is within one of its own; families of fewer than three characters take none.
    """
    year = F.nullif(F.when(F.col("model_year").rlike("^[0-9]{4}$"), F.col("model_year")).try_cast("int"), F.lit(NO_YEAR))
    blank = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    units = F.when(F.col("units_affected").rlike("^[0-9]+$"), F.col("units_affected")).try_cast("int")
    record = F.struct(
        "position", "campno", F.col("make").alias("source_make"), F.col("model").alias("source_model"), year.alias("model_year"), blank("component"), blank("defect"), blank("consequence"), blank("corrective"),
        units.alias("units_affected"), date_or_null(F.col("report_date")).alias("report_date"),
    )
    source = records.select(record.alias("source_id"), norm(F.col("make")).alias("brand_key"), norm(F.col("model")).alias("name_key"), year.alias("year"))
    named = words(F.regexp_replace(F.lower("family_name"), "[^a-z0-9 ]", ""))
    rows = families.select(F.col("id").alias("row_id"), norm(F.col("brand")).alias("brand_key"), named.alias("row_words"), F.col("year_min").alias("low"), F.col("year_max").alias("high"))
    found = matching.interval_match(source, rows.where(F.length(F.array_join("row_words", "")) >= 3))
    fresh = found.select(F.col("row_id").alias("family_id"), "source_id.*")
    return merge.insert_absent(old, fresh, ["campno", "family_id", "model_year"], [F.col("position")], null_safe=True).drop("position")


def used_prices(listings: DataFrame, products: DataFrame, snapshot_year: int) -> DataFrame:
    """Quartiles of asking prices by family and registration year, and by family alone (null year), of three listings or more.

    listings: link, make_model, version, date (.../YYYY), price, mileage, offer_type, position. A link counts once; a listing that
    matches several families is dropped.
    """
    rows = merge.first_wins(listings, ["link"], [F.col("position")])
    reg_year = F.nullif(F.regexp_extract("date", r"/(\d{4})", 1), F.lit("")).try_cast("int")
    rows = rows.withColumn("reg_year", reg_year).where(F.col("price").between(*ASKING_PRICES) & (F.col("offer_type") == "Used") & F.col("reg_year").isNotNull())
    owned = products.where(F.col("family_id").isNotNull())
    name = F.concat_ws(" ", "make_model", "version")
    source = rows.select(F.col("position").alias("source_id"), tokens(name).alias("source_tokens"), F.col("reg_year").alias("source_year"))
    found = matching.match_unambiguous(source, _product_tokens(owned, "family_id"), "family_id", LISTING_OFFSETS)
    placed = found.select(F.col("source_id").alias("position"), "family_id").hint("merge").join(rows.hint("merge"), "position")
    cells = analytics.quantile_cells(placed, "family_id", "reg_year", "price", "mileage")
    return cells.select("family_id", "reg_year", F.col("n").alias("n_listings"), F.col("median").alias("price_median"), F.col("p25").alias("price_p25"), F.col("p75").alias("price_p75"), F.col("median_extra").alias("mileage_median"), F.lit(snapshot_year).alias("snapshot_year"))
