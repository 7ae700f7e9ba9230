"""Loads from scraped rows to tables, and the tools over these, against results worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from tessella.functions.text import newest_first, starts_with_any, straight_quotes, without_suffix, year_in
from tessella.operators import analytics
from tessella.operators.search import hashing_embedder
from tessella.plans import loads, requests, tools

SIZES = ", ".join(f"{f} double" for f in loads.SPEC_LABELS)
SCRAPED = f"url string, brand string, model string, year int, category string, discussion_url string, listed_ccm double, raw_specs string, position int, {SIZES}"
TABLE = f"url string, brand string, model string, year int, category string, category_fr string, msrp_eur double, family_id long, {SIZES}, raw_specs map<string,string>"
NONE = (None,) * 5


@pytest.fixture(scope="module")
def world(spark):
    rows = [
        ("u1", "Acme", "Rex 650 S", 2001, "Sport", "d1", None, {"Displacement": "649.5 ccm", "Dry weight": "180 kg", "Weight": "190 kg", "Power": "47 HP", "Rating": "5", "Colour": " "}, 1, *NONE),
        ("u2", "Acme", "Rex 650 N", 2002, "Naked", "d1", None, {"Power output": "no HP", "Effect": "95.1 HP (70 kW)", "Brakes": "Loading..."}, 2, *NONE),
        ("u3", "Bolt", "Zip", 2002, "Scooter", "d2", 125.0, {}, 3, *NONE),
        ("u4", "Bolt", "Lone", 2003, "Scooter", None, 50.0, {"Displacement": "0 ccm"}, 4, *NONE),
        ("u4", "Bolt X", "Lone", 2003, "Scooter", None, 60.0, {}, 5, *NONE),
    ]
    rows = [(*r[:7], json.dumps(r[7]), *r[8:]) for r in rows]  # a map out of JSON keeps its order
    scraped = spark.createDataFrame(rows, SCRAPED).withColumn("raw_specs", F.from_json("raw_specs", "map<string,string>"))
    families = loads.load_families(spark.createDataFrame([], "discussion_url string, brand string, family_name string, year_min int, year_max int"), scraped)
    products = loads.load_products(spark.createDataFrame([], TABLE), scraped)
    return scraped, families.cache(), products.cache()


def test_families_and_products(spark, world):
    scraped, families, products = world
    assert {r[:] for r in families.select("discussion_url", "brand", "family_name", "year_min", "year_max").collect()} == {("d1", "Acme", "Rex 650", 2001, 2002), ("d2", "Bolt", "Zip", 2002, 2002)}
    got = {r.url: r for r in products.collect()}
    assert len(got) == 4 and (got["u1"].displacement_ccm, got["u1"].weight_kg, got["u1"].power_hp) == (649.5, 180.0, 47.0)
    assert got["u2"].power_hp == 95.1 and got["u3"].displacement_ccm == 125.0
    assert (got["u4"].brand, got["u4"].displacement_ccm, got["u4"].family_id) == ("Bolt", 60.0, None)
    later = scraped.where("url = 'u1'").withColumns({"brand": F.lit("Other"), "year": F.lit(1999), "raw_specs": F.create_map(F.lit("Power"), F.lit("50 HP"))})
    again = {r.url: r for r in loads.load_products(products, later).collect()}
    assert (again["u1"].brand, again["u1"].year, again["u1"].power_hp, again["u1"].weight_kg, again["u2"].power_hp) == ("Acme", 2001, 50.0, None, 95.1)
    wider = {r.discussion_url: r for r in loads.load_families(families, later).collect()}
    assert (wider["d1"].brand, wider["d1"].year_min, wider["d1"].year_max) == ("Other", 1999, 2002)


def comments(spark, world):
    rows = [("u1", "a", "2001", "it´s great brakes", 1), ("u2", "a", "2001", "it's great brakes", 2), ("u2", "b", None, "poor brakes", 3), ("u2", "b", "x", "fine seat", 4), ("u3", "c", "y", "thin family", 5), ("u9", "d", "z", "no family", 6), ("u4", "d", "z", "no forum", 7)]
    return spark.createDataFrame(rows, "product_url string, author string, posted_at string, text string, position int")


def test_comments(spark, world):
    _, families, products = world
    empty = spark.createDataFrame([], "family_id long, author string, posted_at string, comment_text string")
    out, skipped = loads.new_comments(empty, comments(spark, world), products, families, hashing_embedder(8))
    assert {r.comment_text for r in out.collect()} == {"it's great brakes", "poor brakes", "fine seat"} and skipped.first()[0] == 2
    again, _ = loads.new_comments(out, comments(spark, world), products, families, hashing_embedder(8))
    assert [r.comment_text for r in again.collect()] == ["poor brakes"]  # an unknown date equals none


def test_list_prices(spark, world):
    _, _, products = world
    pages = spark.createDataFrame(
        [("acme", "rex 650 s", 2001, 5000, "Sportive", 1), ("acme", "rex 650 s", 2001, 5500, None, 2), ("acme", "rex 650 s", 2001, None, "", 3), ("bolt", "zip", 2001, 900, None, 4), ("bolt", "zip", 1800, 1, None, 5)],
        "brand string, model string, year int, price_eur int, category_fr string, position int",
    )
    got = {r.url: (r.msrp_eur, r.category_fr) for r in loads.load_list_prices(products, pages).collect()}
    assert got == {"u1": (5500.0, "Sportive"), "u2": (None, None), "u3": (900.0, None), "u4": (None, None)}


def recalls(spark):
    rows = [("c1", "ACME", "REX650 SPORT", "2003", "BRAKES", "12", "20030230", "x" * 300, "", "", 1), ("c1", "ACME", "REX-650", "2003", "OTHER", "1", "20030201", "d", "", "", 2), ("c2", "Acme", "Rex 650", "9999", "", "n", "20030201", "d", "", "", 3),
            ("c3", "Acme", "Rex 650", "2004", "", "", "", "", "", "", 4), ("c4", "Acme", "Rex", "2001", "", "", "", "", "", "", 5)]
    return spark.createDataFrame(rows, "campno string, make string, model string, model_year string, component string, units_affected string, report_date string, defect string, consequence string, corrective string, position int")


def test_recalls(spark, world):
    _, families, _ = world
    empty = spark.createDataFrame([], "campno string, family_id long, model_year int")
    out = loads.new_recalls(empty, recalls(spark), families)
    assert {(r.campno, r.model_year, r.component, r.units_affected, str(r.report_date)) for r in out.collect()} == {("c1", 2003, "BRAKES", 12, "None"), ("c2", None, None, None, "2003-02-01")}
    assert loads.new_recalls(out, recalls(spark), families).count() == 0


def listings(spark):
    rows = [(f"l{k}", "Acme Rex", "650 S", f"03/{2001 + k % 2}", 1000 + 100 * k, None, "Used", k) for k in range(4)]
    rows += [("l0", "Acme Rex", "650 S", "03/2001", 70000, None, "Used", 9), ("m", "Acme Rex", "650 S", "03/2001", 100, 5, "Used", 10), ("n", "Acme Rex", "650 S", "03/2001", 1000, 5, "New", 11), ("o", "Acme Rex", "650 S", "soon", 1000, 5, "Used", 12)]
    return spark.createDataFrame(rows, "link string, make_model string, version string, date string, price int, mileage int, offer_type string, position int")


def test_used_prices(spark, world):
    _, _, products = world
    out = loads.used_prices(listings(spark), products, 2022).collect()
    assert [(r.reg_year, r.n_listings, r.price_median, r.price_p25, r.price_p75, r.mileage_median, r.snapshot_year) for r in out] == [(None, 4, 1150, 1075, 1225, None, 2022)]


@pytest.fixture(scope="module")
def catalogue(spark, world):
    _, families, products = world
    embed = hashing_embedder(32)
    text, _ = loads.new_comments(spark.createDataFrame([], "family_id long, author string, posted_at string, comment_text string"), comments(spark, world), products, families, embed)
    found = loads.new_recalls(spark.createDataFrame([], "campno string, family_id long, model_year int"), recalls(spark), families)
    return tools.Catalogue(products, families, text.cache(), found.cache(), loads.used_prices(listings(spark), products, 2022).cache(), embed)


def test_filter_tool(catalogue):
    run = lambda **a: requests.run_tool(tools.tools(catalogue), "filter_specs", a)
    df, notes = run(brands="acme", min_power_hp=40, max_power_hp=95.1, order_by="power_hp")
    assert [(r.model, r.a2) for r in df.collect()] == [("Rex 650 S", "A2"), ("Rex 650 N", "A2 bridable")]
    assert len(notes) == 1
    assert run(count_only=True, limit=1)[0].first()[0] == 4
    assert [r.model for r in run(a2_only=True)[0].collect()] == ["Rex 650 N", "Rex 650 S"]
    with pytest.raises(requests.RequestError):
        requests.run_tool(tools.tools(catalogue), "filter_everything", {})


def test_search_tool(spark, catalogue):
    run = lambda c=catalogue, **a: requests.run_tool(tools.tools(c), "search_reviews", a)
    out = run(query="great brakes")[0].collect()
    assert [r.comment_text for r in out][0] == "it's great brakes" and len(out) == 3 and out[0].rrf == pytest.approx(2 / 60)
    assert run(query="brakes", model="rex 650", category="naked", limit=1)[0].count() == 1
    assert run(query="brakes", brand="bolt")[0].count() == 0
    df, notes = run(brand="Acme")
    assert df.count() == 3 and len(notes) == 1
    longest = tools.Catalogue(**{**vars(catalogue), "rerank": lambda pool, query: pool.withColumn("rerank_score", -F.length("comment_text").cast("double"))})
    assert [r.comment_text for r in run(longest, query="great brakes", limit=2)[0].collect()] == ["fine seat", "poor brakes"]
    assert [r.rerank_score for r in run(longest, query="great brakes", limit=3)[0].collect()] == [None] * 3  # no more than asked for


def test_details_tool(catalogue):
    df, _ = requests.run_tool(tools.tools(catalogue), "get_bike_details", {"bike": "650 acme"})
    rows = df.collect()
    assert [r.model for r in rows] == ["Rex 650 N", "Rex 650 S", None]
    assert rows[0].specs == {"Power output": "no HP", "Effect": "95.1 HP (70 kW)"} and "Rating" not in rows[1].specs and "Colour" not in rows[1].specs
    context = rows[2].context
    assert context.known_recalls_total == 2 and [len(r.defect) for r in context.recent_recalls] == [180, 1] and context.used_price_estimate.n_listings == 4
    lone, _ = requests.run_tool(tools.tools(catalogue), "get_bike_details", {"model": "lone", "year": 2003})
    assert [r.model for r in lone.collect()] == ["Lone"]


def test_small_functions(spark):
    row = spark.createDataFrame([("Rex 2003", "Acme Rex, built 1998 not 18999", 2001, 2003)], "a string, b string, lo int, hi int")
    got = row.select(
        without_suffix(F.col("a"), F.lit(" 2003")), year_in(F.col("b")), newest_first(F.col("lo"), F.col("hi")), newest_first(F.col("hi"), F.col("lo")), starts_with_any(F.col("b"), ("Bolt", "Acme")), straight_quotes(F.lit("a´b"))
    ).first()
    assert got[:] == ("Rex", 1998, [2003, 2002, 2001], [], True, "a'b")


def test_measures(spark):
    row = spark.createDataFrame([(7, 1, 0, 3, 3)], "n int, a int, b int, part int, all int")
    lacking, score = analytics.priority(F.col("n"), [F.col("a"), F.col("b"), F.lit(None).cast("int")])
    assert row.select(lacking, score, analytics.share_without(F.lit(1), F.lit(8)), analytics.share_without(F.lit(0), F.lit(0))).first()[:] == (1, 2.3, 88, 100)
    means = analytics.metric_means(spark.createDataFrame([("x", 0.25, float("nan")), ("x", None, 0.5)], "g string, p double, q double"), ["g"], ["p", "q"])
    assert means.first()[:] == ("x", 0.25, 0.5)
    rows = spark.range(100).withColumn("s", F.when(F.col("id") < 60, "a").when(F.col("id") < 98, "b").otherwise("c"))
    picked = analytics.seeded_sample(rows, "s", "id", {"a": 20, "b": 15, "c": 5}, 7)
    assert {r.s: r["count"] for r in picked.groupBy("s").count().collect()} == {"a": 20, "b": 15, "c": 2}
    assert {r.id for r in picked.collect()} == {r.id for r in analytics.seeded_sample(rows.repartition(5), "s", "id", {"a": 20, "b": 15, "c": 5}, 7).collect()}
