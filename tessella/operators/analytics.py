"""Aggregates over a catalogue: families, quantile cells, coverage, integrity, and what a retrieval is worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import half_up, words


def mode_first_seen(df: DataFrame, group: list[str], value: str, position: Column) -> DataFrame:
    """The most frequent value of each group; of equally frequent ones, the first seen."""
    counted = df.groupBy(*group, value).agg(F.count("*").alias("_n"), F.min(position).alias("_first"))
    return counted.groupBy(*group).agg(F.max_by(value, F.struct(F.col("_n"), -F.col("_first"))).alias(f"mode_{value}"))


def common_name(df: DataFrame, group: str, name: str, position: Column) -> DataFrame:
    """One name for each group: the words that all members share, in the first member's order; without any, the shortest of the
    most frequent names, the first seen of equals. Words are counted by distinct name, so a large group of few names is small."""
    seen = df.where(F.col(name).isNotNull()).groupBy(F.col(group).alias("_g"), F.col(name).alias("_name")).agg(F.count("*").alias("_n"), F.min(position).alias("_first"))
    facts = seen.groupBy("_g").agg(F.count("*").alias("_names"), F.min_by("_name", "_first").alias("_lead"), F.max("_n").alias("_most"))
    shared = seen.select("_g", F.explode(F.array_distinct(words(F.col("_name")))).alias("_word")).groupBy("_g", "_word").agg(F.count("*").alias("_having"))
    shared = shared.join(facts.select("_g", "_names"), "_g").where("_having = _names").groupBy("_g").agg(F.collect_set("_word").alias("_shared"))
    short = seen.join(facts.select("_g", "_most"), "_g").where("_n = _most").groupBy("_g").agg(F.min_by("_name", F.struct(F.length("_name"), F.col("_first"))).alias("_short"))
    out = facts.join(shared, "_g", "left").join(short, "_g")
    kept = F.array_join(F.filter(words(F.col("_lead")), lambda w: F.array_contains(F.coalesce("_shared", F.array().cast("array<string>")), w)), " ")
    return out.select(F.col("_g").alias(group), F.when(kept != "", kept).otherwise(F.col("_short")).alias("display_name"))


def quantile_cells(df: DataFrame, outer: str, inner: str, value: str, extra: str, least: int = 3) -> DataFrame:
    """Exact quartiles by (outer, inner) and by outer alone (``level`` 1), of cells with ``least`` rows or more, cut to whole numbers.

    Equal values of a cell are counted before they meet. A running count along the sorted values then says which of them
    stand at a quantile's two ranks, so no task holds a cell's values: they pass by in order, one row for each distinct value.
    Between two values the lower one's share is added before it is rounded, as the SQL does: a quartile that is a whole number is not
    cut to the one below.
    """
    each = df.where(F.col(inner).isNotNull()).select(F.col(outer).alias("o"), F.col(inner).alias("i"), F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col(value).cast("double").alias("v")), F.struct(F.lit(1).alias("kind"), F.col(extra).cast("double").alias("v")))).alias("x"))
    counted = each.select("o", "i", "x.*").groupingSets([["o", "i", "kind", "v"], ["o", "kind", "v"]], "o", "i", "kind", "v").agg(F.grouping("i").cast("int").alias("level"), F.count("*").alias("n"))
    cell = Window.partitionBy("o", "i", "level", "kind")
    known = F.col("n") * F.col("v").isNotNull().cast("long")
    counted = counted.withColumns({"upto": F.sum(known).over(cell.orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum(known).over(cell)})

    def at(kind: int, share: float) -> Column:
        place = F.lit(share) * (F.col("total") - 1)
        rank = lambda r: F.min(F.when((F.col("kind") == kind) & (F.col("upto") > r), F.col("v")))
        low, high, part = rank(F.floor(place)), rank(F.ceil(place)), F.max(F.when(F.col("kind") == kind, place - F.floor(place)))
        told = [F.coalesce(c, F.lit(0.0)) for c in (low, 1 - part, part * high)]  # a call takes no nulls
        between = F.java_method(F.lit("java.lang.Math"), F.lit("fma"), *told).cast("double")
        return F.when(low.isNotNull(), F.when((part == 0) | (low == high), low).otherwise(between)).cast("long")

    out = counted.groupBy("o", "i", "level").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("n"), at(0, 0.25).alias("p25"), at(0, 0.5).alias("median"), at(0, 0.75).alias("p75"), at(1, 0.5).alias("median_extra")
    )
    return out.where(F.col("n") >= least).withColumnsRenamed({"o": outer, "i": inner})


def coverage(df: DataFrame, group: str, fields: list[str], key: str) -> DataFrame:
    """Rows, missing values and missing percentages of each group."""
    missing = [F.count_if(F.col(f).isNull()).alias(f"miss_{f}") for f in fields]
    out = df.groupBy(group).agg(F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_keys"), *missing)
    return out.withColumns({f"pct_{f}": half_up(100.0 * F.col(f"miss_{f}") / F.col("n_rows")).cast("long") for f in fields})


NO_FAMILY = "no family"


def _missing(fields: list[str]) -> list[Column]:
    return [F.count_if(F.col(f).isNull()).alias(f"miss_{f}") for f in fields]


def brand_coverage(products: DataFrame, comments: DataFrame, fields: list[str]) -> DataFrame:
    """Each brand's products, years, families, families with comments and missing values, the largest brand first. A product counts once."""
    reviewed = comments.where(F.col("family_id").isNotNull()).select("family_id").distinct().withColumn("reviewed", F.col("family_id"))
    out = products.join(reviewed, "family_id", "left").groupBy("brand").agg(
        F.count("*").alias("n_products"), F.min("year").alias("year_min"), F.max("year").alias("year_max"), F.countDistinct("family_id").alias("n_families"), F.countDistinct("reviewed").alias("n_families_reviewed"), *_missing(fields)
    )
    return out.orderBy(F.desc("n_products"), "brand")


def family_coverage(products: DataFrame, families: DataFrame, comments: DataFrame, fields: list[str]) -> DataFrame:
    """Each family that has products, with its products, comments and missing values, and each brand's products of no family as one more row."""
    said = comments.groupBy(F.col("family_id").alias("id")).agg(F.count("*").alias("n_comments"))
    counted = products.where(F.col("family_id").isNotNull()).groupBy(F.col("family_id").alias("id")).agg(F.countDistinct(products["id"]).alias("n_products"), *_missing(fields))
    held = families.select("id", "brand", "family_name", "year_min", "year_max").join(counted, "id").join(said, "id", "left").withColumn("n_comments", F.coalesce("n_comments", F.lit(0))).drop("id")
    orphans = products.where(F.col("family_id").isNull()).groupBy("brand").agg(F.min("year").alias("year_min"), F.max("year").alias("year_max"), F.count("*").alias("n_products"), *_missing(fields))
    return held.unionByName(orphans.withColumns({"family_name": F.lit(NO_FAMILY), "n_comments": F.lit(0).cast("long")}))


def catalogue_totals(products: DataFrame, families: DataFrame, comments: DataFrame, fields: list[str]) -> DataFrame:
    """One row: products, families, comments, families with comments, and products that miss a value."""
    mine = products.agg(F.count("*").alias("n_products"), *_missing(fields))
    said = comments.agg(F.count("*").alias("n_comments"), F.countDistinct("family_id").alias("n_families_reviewed"))
    return mine.crossJoin(said).crossJoin(families.agg(F.count("*").alias("n_families")))  # three rows of one


def integrity(texts: DataFrame, parents: DataFrame, key: str, text: str, group: list[str], short: int = 15) -> DataFrame:
    """One row: rows, rows without a parent, groups of equal rows, short texts, null texts, mean length (rounded)."""
    totals = texts.agg(
        F.count("*").alias("n_rows"), F.count_if(F.length(text) < short).alias("n_short"), F.count_if(F.col(text).isNull()).alias("n_null"), half_up(F.avg(F.length(text))).cast("long").alias("mean_length")
    )
    orphans = texts.join(parents.select(key), key, "left_anti").agg(F.count("*").alias("n_orphans"))
    equal = texts.groupBy(*group).count().where("count > 1").agg(F.count("*").alias("n_equal_groups"))
    return totals.crossJoin(orphans).crossJoin(equal)  # three rows of one


def keyword_lift(df: DataFrame, top: Column, pattern: str, text: str) -> DataFrame:
    """How much more often a pattern occurs in the top rows than in all. One pass; null where the pattern never occurs."""
    hit = F.col(text).rlike(f"(?i){pattern}")
    rates = df.agg(F.avg(hit.cast("double")).alias("base_rate"), F.avg(F.when(top, hit.cast("double"))).alias("top_rate"), F.count_if(top & hit).alias("top_hits"))
    return rates.withColumn("lift", F.try_divide("top_rate", "base_rate"))


def list_overlap(a: DataFrame, b: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Shared items and Jaccard similarity of two lists for each key, by counting: nothing is collected."""
    both = a.select(*keys, item, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(*keys, item, F.lit(0).alias("a"), F.lit(1).alias("b")))
    each = both.groupBy(*keys, item).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return each.groupBy(*keys).agg(F.count_if(F.col("a") + F.col("b") == 2).alias("n_shared"), F.count("*").alias("n_all")).withColumn("jaccard", F.col("n_shared") / F.col("n_all"))


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks; an unknown value breaks none."""
    return F.filter(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]), lambda x: x.isNotNull())


def cleanest(df: DataFrame, key: list[str], broken: str, position: Column) -> DataFrame:
    """Of each key, the row with the fewest violations, the first of equals."""
    return df.groupBy(*key).agg(F.min_by(broken, F.struct(F.size(broken), position)).alias(broken))


def verdict_rates(df: DataFrame, group: list[str], status: str) -> DataFrame:
    """ok, bad and unverifiable rows of each group, with the rates; null where nothing counts."""
    n = lambda s: F.count_if(F.col(status) == s)
    out = df.groupBy(*group).agg(n("ok").alias("n_ok"), n("bad").alias("n_bad"), n("unknown").alias("n_unknown"))
    return out.withColumns({"precision": F.try_divide("n_ok", F.col("n_ok") + F.col("n_bad")), "unknown_rate": F.try_divide("n_unknown", F.col("n_ok") + F.col("n_bad") + F.col("n_unknown"))})


def stratified(df: DataFrame, stratum: str, once: str, position: list[Column], most: int = 3) -> DataFrame:
    """The first ``most`` rows of each stratum, at most one for each ``once``. Rows are cut by (stratum, once) before the stratum meets."""
    first = F.row_number().over(Window.partitionBy(stratum, once).orderBy(*position))
    rows = df.withColumn("_first", first).where("_first = 1").drop("_first")
    at = F.row_number().over(Window.partitionBy(stratum).orderBy(*position))
    return rows.withColumn("_at", at).where(F.col("_at") <= most).drop("_at")


def call_used(calls: Column, name: str) -> Column:
    """Whether some call of the list (struct name, args map) is of ``name``."""
    return F.exists(calls, lambda c: c["name"] == name)


def calls_mention(calls: Column, name: str, pattern: str, together: bool = False) -> Column:
    """Whether one call of ``name`` mentions a pattern; ``together``: all its calls taken as one text."""
    mine = F.filter(calls, lambda c: c["name"] == name)
    texts = F.transform(mine, lambda c: F.array_join(F.map_values(c["args"]), " "))
    return F.array_join(texts, " ").rlike(f"(?i){pattern}") if together else F.exists(texts, lambda t: t.rlike(f"(?i){pattern}"))


def call_between(calls: Column, name: str, key: str, least: float, most: float) -> Column:
    """Whether some call of ``name`` has a numeric argument within the bounds."""
    return F.exists(calls, lambda c: (c["name"] == name) & F.coalesce(F.element_at(c["args"], key).try_cast("double").between(least, most), F.lit(False)))


def call_sets(calls: Column, name: str, key: str) -> Column:
    """Whether some call of ``name`` sets an argument to something that counts: not blank, zero, false or none."""
    said = lambda v: v.isNotNull() & ~F.lower(F.trim(v)).isin("", "0", "0.0", "false", "none", "null", "[]", "{}")
    return F.exists(calls, lambda c: (c["name"] == name) & said(F.element_at(c["args"], key)))


def trajectories(answers: DataFrame, expectations: DataFrame, checks: dict[str, Column], known: tuple[str, ...]) -> DataFrame:
    """Each answered question (id, calls, stopped) with the checks that its id expects (expectations: id, label): ``n_checks``, ``n_ok``,
    ``failed`` (labels, in order) and ``all_ok``, which also needs calls of known tools only and an answer that was not stopped.
    ``checks`` gives each label its condition on ``calls``."""
    passed = F.map_from_arrays(F.array(*map(F.lit, checks)), F.array(*[F.coalesce(c, F.lit(False)) for c in checks.values()]))
    stray = F.exists("calls", lambda c: ~c["name"].isin(*known))
    judged = answers.select("id", "stopped", stray.alias("stray"), passed.alias("passed")).join(expectations.select("id", "label").distinct(), "id")
    judged = judged.withColumn("ok", F.element_at("passed", F.col("label")))
    out = judged.groupBy("id").agg(F.count("*").alias("n_checks"), F.count_if("ok").alias("n_ok"), F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("label")))).alias("failed"), F.bool_or(F.col("stray") | F.col("stopped")).alias("bad"))
    return out.select("id", "n_checks", "n_ok", "failed", ((F.col("n_ok") == F.col("n_checks")) & ~F.col("bad")).alias("all_ok"))


def trajectory_totals(judged: DataFrame) -> DataFrame:
    """One row: questions and checks that are right, and how many there are."""
    return judged.agg(F.count_if("all_ok").alias("questions_ok"), F.count("*").alias("questions_total"), F.coalesce(F.sum("n_ok"), F.lit(0)).alias("checks_ok"), F.coalesce(F.sum("n_checks"), F.lit(0)).alias("checks_total"))


def priority(n: Column, missing: list[Column]) -> tuple[Column, Column]:
    """(how many fields miss values, the score: rows times that share, to one decimal, halves upwards)."""
    lacking = sum(F.coalesce(m > 0, F.lit(False)).cast("int") for m in missing)
    return lacking, half_up(n * lacking / len(missing) * 10) / 10


def share_without(part: Column, whole: Column) -> Column:
    """Percentage of ``whole`` that is not ``part``, rounded, halves upwards; 100 where there is nothing."""
    return F.coalesce(half_up(100 * (1 - F.try_divide(part, whole))), F.lit(100)).cast("long")


def metric_means(df: DataFrame, group: list[str], metrics: list[str]) -> DataFrame:
    """Means to four decimals; nulls and NaN are left out."""
    return df.groupBy(*group).agg(*[F.round(F.avg(F.when(~F.isnan(m), F.col(m))), 4).alias(m) for m in metrics])


def topic_hits(ranked: DataFrame, group: list[str], text: str, pattern: str, rank: str, k: int) -> DataFrame:
    """Rows among the first ``k`` of each ranked list whose text a pattern matches."""
    on = (F.col(rank) <= k) & F.col(text).rlike(f"(?i){pattern}")
    return ranked.groupBy(*group).agg(F.count_if(on).alias("n_on_topic"), F.count_if(F.col(rank) <= k).alias("n_listed"))


def seeded_sample(df: DataFrame, stratum: str, key: str, sizes: dict[str, int], seed: int = 0) -> DataFrame:
    """Exactly ``sizes[stratum]`` rows of each stratum, fewer if it has fewer, in an order that the seed fixes. Ranks are cut
    in each task before the strata meet."""
    size = F.coalesce(*[F.when(F.col(stratum) == s, F.lit(n)) for s, n in sizes.items()])
    at = F.row_number().over(Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key))
    rows = df.where(F.col(stratum).isin(*sizes)).withColumn("_at", at).where(F.col("_at") <= max(sizes.values()))
    return rows.where(F.col("_at") <= size).drop("_at")
