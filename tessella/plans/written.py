"""Queries over what the engine writes itself, each beside its SQL: files that are written and read back, pages that are put together from
rows and taken apart again, and whole loads. Tables are read whole; files go to the shared scratch space and are deleted at the driver's end.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from tessella.functions.text import norm, rot13
from tessella.operators import analytics, matching, merge
from tessella.operators.filters import SpecFilter, spec_filter
from tessella.plans import loads, tools
from tessella.plans.catalogue import PART_COLUMNS, PARTS, query
from tessella.plans.requests import Tool, run_tool
from tessella.sources import extract, readers
from tessella.sources.readers import scratch_folder, spread, table, until_exit
from tessella.streaming import buckets, ingest, journals

# Files


@query("SELECT event_id, user_id, event_type, value FROM events")
def json_lines_appended(spark, d):
    """Two appends to JSON lines, read back."""
    events, path = table(spark, d, "events").select("event_id", "user_id", "event_type", "value"), scratch_folder(spark, "lines")
    for part in (0, 1):
        readers.append_lines(events.where(F.col("event_id") % 2 == part), path)
    return readers.json_lines(spark, until_exit(spark, path), "event_id long, user_id long, event_type string, value double")


_LINES = "CASE WHEN p_partkey % 7 = 0 THEN 'short' || chr(9) || p_name ELSE 'x' || chr(9) || p_partkey || chr(9) || p_name || ' é' || chr(9) || p_brand END"


def _lines(spark, d):
    part, tab = spread(table(spark, d, "part"), "p_partkey"), F.lit("\t")
    whole = F.concat(F.lit("x"), tab, F.col("p_partkey").cast("string"), tab, F.concat("p_name", F.lit(" é")), tab, "p_brand")
    return part.select(F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("short"), tab, "p_name")).otherwise(whole).alias("line"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS key, p_name || ' é' AS name FROM part WHERE p_partkey % 7 <> 0")
def flat_file_rows(spark, d):
    """Tab-separated latin-1 lines; those with too few fields are skipped."""
    path = scratch_folder(spark, "flat")
    _lines(spark, d).select(F.encode("line", "ISO-8859-1").cast("string").alias("value")).write.text(path)
    return readers.flat_file(spark, until_exit(spark, path), {"key": 1, "name": 2}, 4)


@query("SELECT CAST(p_partkey AS VARCHAR) AS key, p_name || ' é' AS name FROM part WHERE p_partkey % 7 <> 0")
def zipped_rows(spark, d):
    """The same lines as members of ZIP archives, one for each line."""

    @F.pandas_udf("binary")
    def zipped(lines: pd.Series) -> pd.Series:
        def one(line: str) -> bytes:
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w") as z:
                z.writestr("flat.txt", f"{line}\r\n".encode("latin-1"))
            return held.getvalue()

        return lines.map(one)

    archives = _lines(spark, d).select(F.lit("a.zip").alias("path"), zipped("line").alias("content"))
    return readers.fields_of(readers.archive_lines(archives), {"key": 1, "name": 2}, 4)


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def csv_rows(spark, d):
    path = scratch_folder(spark, "csv")
    table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal").write.option("header", True).csv(path)
    return readers.csv_table(spark, until_exit(spark, path), "s_suppkey long, s_name string, s_acctbal double")


@query("SELECT DISTINCT url FROM pages WHERE page_id % 3 <> 2 OR page_id % 2 = 0")
def journals_union(spark, d):
    """Lines of two journals, each once."""
    pages, paths = table(spark, d, "pages"), [scratch_folder(spark, "done") for _ in range(2)]
    for path, which in zip(paths, ("page_id % 3 <> 2", "page_id % 2 = 0")):
        pages.where(which).select(F.concat(F.lit(" "), "url")).write.text(path)
        until_exit(spark, path)
    return readers.journal(spark, paths)


@query("SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey % 3 = 1 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer")
def snapshot_replaced(spark, d):
    """A snapshot by nation of which a later write replaces some parts."""
    rows, path = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), scratch_folder(spark, "snapshot")
    readers.replace_snapshot(rows, path, "c_nationkey")
    readers.replace_snapshot(rows.where("c_nationkey % 3 = 1").withColumn("c_acctbal", F.col("c_acctbal") + 1), path, "c_nationkey")
    return spark.read.parquet(until_exit(spark, path)).select("c_custkey", "c_nationkey", "c_acctbal")


@query("SELECT r_regionkey, r_name, count(*) AS n_nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL")
def json_report(spark, d):
    counts = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("n_nations"))
    path = scratch_folder(spark, "report")
    readers.write_report(table(spark, d, "region").join(counts, "r_regionkey").select("r_regionkey", "r_name", "n_nations"), path)
    return spark.read.schema("r_regionkey int, r_name string, n_nations long").json(until_exit(spark, path))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS \"key\", n_name || '|' || n_regionkey AS name, '' AS verdict FROM nation")
def sheet_round_trip(spark, d):
    """A Markdown sheet with bars inside its cells, written and read back."""
    path = scratch_folder(spark, "sheet")
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.concat("n_name", F.lit("|"), F.col("n_regionkey").cast("string")).alias("name"), F.lit(None).cast("string").alias("verdict"))
    readers.write_sheet(rows, path, ["key", "name", "verdict"])
    return readers.marked_sheet(spark, until_exit(spark, path), ["key", "name", "verdict"])


@query("SELECT user_id, max(value) AS value, max(event_id) AS event_id FROM events GROUP BY user_id")
def stream_merged(spark, d):
    """Files that come as a stream, merged batch by batch; the last batch runs twice."""
    events, path = table(spark, d, "events").select("user_id", "value", "event_id"), scratch_folder(spark, "stream")
    events.repartition(3, "event_id").write.json(f"{path}/in")
    rules = {"value": "greatest", "event_id": "greatest"}

    def merged(old, new):
        new = new.groupBy("user_id").agg(F.max("value").alias("value"), F.max("event_id").alias("event_id"))
        return new if old is None else merge.upsert(old, new, ["user_id"], rules)

    def twice(rows, number):
        for _ in range(2):
            ingest.merge_batch(rows, number, f"{path}/table", merged)

    source = ingest.json_stream(spark, f"{path}/in", "user_id long, value double, event_id long", 1)
    source.writeStream.foreachBatch(twice).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    until_exit(spark, path)
    return ingest.current(spark, f"{path}/table").select("user_id", "value", "event_id")


@query("SELECT user_id, max(value) AS value, max(event_id) AS event_id FROM events GROUP BY user_id")
def stream_touched(spark, d):
    """The same stream into a table of buckets, of which a batch rewrites those of its keys; the last batch runs twice."""
    events, path = table(spark, d, "events").select("user_id", "value", "event_id"), scratch_folder(spark, "buckets")
    events.repartition(3, "event_id").write.json(f"{path}/in")

    def merged(old, new):
        new = new.groupBy("user_id").agg(F.max("value").alias("value"), F.max("event_id").alias("event_id"))
        return new if old is None else merge.upsert(old, new, ["user_id"], {"value": "greatest", "event_id": "greatest"})

    def twice(rows, number):
        for _ in range(2):
            buckets.merge_batch(rows, number, f"{path}/table", ["user_id"], merged, 16)

    source = ingest.json_stream(spark, f"{path}/in", "user_id long, value double, event_id long", 1)
    source.writeStream.foreachBatch(twice).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    until_exit(spark, path)
    return buckets.current(spark, f"{path}/table").select("user_id", "value", "event_id")


_FORUM = "CAST(CAST(floor({} / 5) AS BIGINT) AS VARCHAR)"
_STORED = "o_orderdate < TIMESTAMP '2001-07-01 00:00:00'"


@query(f"""WITH threads AS (SELECT CAST(c_custkey AS VARCHAR) AS node, {_FORUM.format("c_custkey")} AS parent, count(o_orderkey) AS expected, count(o_orderkey) FILTER (WHERE {_STORED}) AS seen
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2), forums AS (SELECT parent AS node, bool_and(seen = expected) AS done FROM threads GROUP BY 1),
waiting AS (SELECT CAST(p_partkey AS VARCHAR) AS node, {_FORUM.format("p_partkey")} AS forum FROM part WHERE p_size < 45 AND {_FORUM.format("p_partkey")} NOT IN (SELECT node FROM forums WHERE done))
SELECT 'product' AS level, node FROM waiting UNION ALL SELECT DISTINCT 'forum' AS level, forum AS node FROM waiting
UNION ALL SELECT 'thread' AS level, node FROM threads WHERE seen < expected AND parent IN (SELECT forum FROM waiting)""")
def journals_resumed(spark, d):
    """Where a crawl of three levels goes on. Orders are comments of their customers' threads, five customers are a forum, parts are products. The last
    month's comments are not stored yet, some are stored twice, and the streams stop and start again between the halves."""
    path, forum = scratch_folder(spark, "journals"), lambda key: F.floor(F.col(key) / 5).cast("string")
    orders = table(spark, d, "orders")
    stored = orders.where(F.col("o_orderdate") < F.lit("2001-07-01").cast("timestamp")).select(F.col("o_custkey").cast("string").alias("parent"), F.col("o_orderkey").cast("string").alias("node"), "o_orderstatus")
    sizes = orders.groupBy("o_custkey").agg(F.count("*").alias("children"))
    customers = table(spark, d, "customer")
    threads = customers.join(sizes, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").cast("string").alias("node"), forum("c_custkey").alias("parent"), F.coalesce("children", F.lit(0)).alias("children"))
    threads.write.parquet(f"{path}/threads")
    threads = spark.read.parquet(f"{path}/threads")
    threads.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children")).withColumn("parent", F.lit(None).cast("string")).write.parquet(f"{path}/forums")
    stream = lambda name, schema: spark.readStream.schema(schema).parquet(f"{path}/{name}")
    for half in (F.col("o_orderstatus") != "O", F.lit(True)):  # the second holds all, so the first half's rows come twice
        stored.where(half).select("parent", "node").write.mode("append").parquet(f"{path}/comments")
        levels = (("threads", stream("comments", journals.DONE)), ("forums", None))
        for name, children in levels:
            children = children or journals.journal_stream(spark, f"{path}/threads_done")
            journals.run_level(children, stream(name, "node string, parent string, children long"), f"{path}/{name}_done", f"{path}/{name}_checkpoint").awaitTermination()
    until_exit(spark, path)
    products = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.when(F.col("p_size") < 45, forum("p_partkey")).alias("forum"))
    return journals.still_open(products, threads, journals.journal_table(spark, f"{path}/forums_done"), journals.journal_table(spark, f"{path}/threads_done"))


# Pages

_YEAR = "1950 + p_size"


@query(f"SELECT split_part(p_name, ' ', 1) AS brand, substr(p_name, strpos(p_name, ' ') + 1) AS model, CAST({_YEAR} AS INT) AS \"year\", p_type AS category, p_size || ' ccm' AS engine_text, '/p/' || p_partkey AS url FROM part")
def listing_pages(spark, d):
    part = spread(table(spark, d, "part"), "p_partkey")
    cells = F.concat(F.lit("<td><a href='/p/"), "p_partkey", F.lit("'>"), "p_name", F.lit("</a></td><td>"), "p_type", F.lit("</td><td>?</td><td>"), "p_size", F.lit(" ccm</td>"))
    html = F.concat(F.lit("<table><tr><td>menu</td></tr></table><table><tr><th>Name</th></tr><tr>"), cells, F.lit("</tr><tr><td>no link</td><td>a</td><td>b</td><td>c</td></tr></table>"))
    return extract.extract_listings(part.select((F.col("p_size") + 1950).alias("year"), html.alias("html")))


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS displacement_ccm, CAST(p_size + 1 AS DOUBLE) AS weight_kg, CASE WHEN p_size % 2 = 0 THEN p_size / 2 END AS power_hp, p_name AS colour FROM part")
def spec_pages(spark, d):
    """Sheets with a plain cell, an encoded one, an entity and a repeated label."""
    part = spread(table(spark, d, "part"), "p_partkey")
    coded = F.base64(F.encode(rot13(F.concat(F.lit('"'), "p_size", F.lit(' <span style=\\"display: none\\">no</span>ccm<!-- no -->"'))), "utf-8"))
    code = F.regexp_replace(coded, r"\s", "")
    row = lambda label, value: F.concat(F.lit(f"<tr><td><b>{label}</b></td><td>"), value, F.lit("</td></tr>"))
    html = F.concat(
        F.lit('<script>var dataArray = [{"c1": "'), code, F.lit('"}];</script><table class="Grid">'), row("Displacement:", F.lit('<span class="c1">Loading...</span>')), row("Dry weight", F.lit("? kg")),
        row("Dry weight", F.concat((F.col("p_size") + 1).cast("string"), F.lit("&nbsp;kg"))), row("Power", F.when(F.col("p_size") % 2 == 0, F.concat((F.col("p_size") / 2).cast("string"), F.lit(" HP"))).otherwise("none")),
        row("Colour", F.col("p_name")), F.lit("<tr><td>plain</td><td>row</td></tr></table>"),
    )
    specs = extract.extract_specs(part.select("p_partkey", html.alias("html")), "p_partkey")
    return specs.select("p_partkey", *[loads.typed_field(F.col("raw_specs"), f).alias(f) for f in ("displacement_ccm", "weight_kg", "power_hp")], F.col("raw_specs")["Colour"].alias("colour"))


@query("""SELECT 'f' || n_nationkey AS forum, 't' || n_nationkey || '-' || (5 - t) AS thread, CAST(t AS INT) AS thread_no, CAST(m AS INT) AS position, n_name || m AS author, '2020-01-0' || (m + 1) || ' 10:00' AS posted_at, 'Text ' || t || ' & more' AS text
FROM nation, range(3) AS t(t), range(2) AS m(m)""")
def forum_pages(spark, d):
    """Forums with five threads each, of which the newest three are read; a thread has advertisements, links and a message without text."""
    nation = table(spark, d, "nation")
    links = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda t: F.concat(F.lit('<a class="x" href="t'), F.col("n_nationkey").cast("string"), F.lit("-"), (5 - t).cast("string"), F.lit('">thread</a>'))), " ")
    forums = nation.select(F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("url"), F.concat(F.lit('<a href="other">no</a>'), links, links).alias("html"))
    threads = nation.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(4))))

    def message(m):
        head = F.concat(F.lit("<tr><td><b>"), "n_name", m.cast("string"), F.lit("</b> said 2020-01-0"), (m + 1).cast("string"), F.lit(" 10:00</td></tr>"))
        return F.concat(head, F.lit("<tr><td><ins>buy</ins></td></tr><tr><td> &nbsp; </td></tr><tr><td>Text "), F.col("t").cast("string"), F.lit(" &amp; more</td></tr>"))

    body = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(1)), message), "")
    html = F.concat(F.lit('<table class="Form"><tr><td>A said 2020-01-01</td></tr></table><table class="Grid"><tr><td>Topic</td></tr>'), body, F.lit("<tr><td>Z said 2021-01-01</td></tr><tr><td>&lt;&lt; Previous</td></tr><tr><td>no</td></tr></table>"))
    pages = threads.select(F.concat(F.lit("t"), F.col("n_nationkey").cast("string"), F.lit("-"), (5 - F.col("t")).cast("string")).alias("url"), html.alias("html"))
    return extract.forum_comments(forums, pages, "^t[0-9]", 3)


@query("SELECT url, CAST(n_regionkey AS INT) AS nth FROM (SELECT n_regionkey, n_regionkey || '/' || n_nationkey || '/x.html' AS url FROM nation)")
def sitemap_pages(spark, d):
    """An index of one sitemap for each region, which list its nations' pages twice and a page of another kind."""
    nation = table(spark, d, "nation")
    loc = lambda c: F.concat(F.lit("<loc> "), c, F.lit(" </loc>"))
    page = F.concat_ws("/", F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string"), F.lit("x.html"))
    maps = nation.groupBy(F.concat(F.lit("s"), F.col("n_regionkey").cast("string")).alias("url")).agg(F.array_join(F.sort_array(F.collect_list(loc(page))), "").alias("xml"))  # five nations a region
    maps = maps.select("url", F.concat("xml", "xml", F.lit("<loc>about.html</loc>")).alias("xml"))
    index = spark.createDataFrame([("root", "".join(f"<loc>s{k}</loc>" for k in range(5)))], "url string, xml string")
    return extract.sitemap_targets(maps.unionByName(index), "root", r"/x\.html$").select("url", F.col("position.nth").alias("nth"))


@query("""SELECT p_partkey, replace(lower(p_brand), '#', ' ') AS brand, CASE WHEN p_size % 3 = 0 THEN replace(p_name, ' ', ' ') ELSE 'Le ' || p_name || ' & Co' END AS model, CAST(1950 + p_size AS INT) AS "year",
CASE WHEN p_size % 4 > 0 THEN p_size * 1000 + 5 END AS price_eur, CASE WHEN p_size % 5 > 0 THEN p_type || ' é' END AS category_fr FROM part""")
def priced_pages(spark, d):
    """Pages with and without a shown name, a price and a badge."""
    part = spread(table(spark, d, "part"), "p_partkey")
    size, year = F.col("p_size"), (F.col("p_size") + 1950).cast("string")
    url = F.concat(F.lit("https://shop.example/"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("-")), F.lit("/"), F.col("p_partkey").cast("string"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), year, F.lit("/contact.html"))
    name = F.when(size % 3 == 0, "").otherwise(F.concat(F.lit("<h2>Quel est le prix de la Le "), "p_name", F.lit(" &amp; Co "), year, F.lit(" ?</h2>")))
    price = F.when(size % 4 == 0, "<p>Le prix de la X n'est pas connu.</p> 7 €").otherwise(F.concat(F.lit("<p>Le prix de la X 2020 est de <b><i>"), size.cast("string"), F.lit("&nbsp;005 €</i></b>")))
    badge = F.when(size % 5 == 0, "").otherwise(F.concat(F.lit('<em class="icon-a-b"></em> '), "p_type", F.lit(" &eacute; </p>")))
    pages = part.select("p_partkey", url.alias("url"), F.concat(badge, name, price).alias("html"))
    return pages.select("p_partkey", *extract.priced_page(F.col("url"), F.col("html")))


@query("""WITH n AS (SELECT min(p_partkey) AS name_id, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS name, 1950 + p_size AS y FROM part GROUP BY 2, 3),
m AS (SELECT p_partkey AS mention_id, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') || CASE WHEN p_partkey % 3 = 2 THEN 'pro' ELSE '' END AS mention, CASE WHEN p_partkey % 3 > 0 THEN 1950 + p_size END AS y FROM part)
SELECT mention_id, name_id FROM (SELECT mention_id, name_id, rank() OVER (PARTITION BY mention_id ORDER BY abs(length(name) - length(mention))) AS k FROM m JOIN n ON (m.y IS NULL OR m.y = n.y) AND (contains(name, mention) OR contains(mention, name))) WHERE k = 1""")
def mention_resolution(spark, d):
    """What answers name, in bold or as list items, with or without a year, and the products that come closest."""
    part = spread(table(spark, d, "part"), "p_partkey")
    year = (F.col("p_size") + 1950).cast("string")
    item = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("take the **"), "p_name", F.lit("**: fine"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("1. "), "p_name", F.lit(" "), year, F.lit("."))).otherwise(F.concat(F.lit("- "), "p_name", F.lit(" Pro ("), year, F.lit(")")))
    answers = part.select("p_partkey", F.concat(F.lit("Well,\n"), item, F.lit("\n- Weight: 100 kg\n- Price 5 000\n**Note**")).alias("text"))
    named = extract.extract_mentions(answers, "p_partkey").select(F.col("p_partkey").alias("mention_id"), extract.mention_key(F.col("mention")).alias("mention"), "year")
    names = part.groupBy(norm(F.col("p_name")).alias("name"), (F.col("p_size") + 1950).alias("year")).agg(F.min("p_partkey").alias("name_id"))
    return matching.closest_length(named, names, "year")


@query("""WITH a AS (SELECT url, CASE page_id % 4 WHEN 0 THEN 200 WHEN 1 THEN 404 END AS status FROM pages)
SELECT DISTINCT url FROM pages WHERE url NOT IN (SELECT url FROM a WHERE status IS NOT NULL)""")
def pages_to_ask_again(spark, d):
    """Pages that no attempt got an answer for; an error page is an answer, a network error is none."""
    pages = table(spark, d, "pages")
    attempts = pages.select("url", F.when(F.col("page_id") % 4 == 0, 200).when(F.col("page_id") % 4 == 1, 404).alias("status"))
    return merge.frontier(pages, merge.answered(attempts, "url", "status"), "url")


# Loads and tools

_WORLD = """prod AS (SELECT p_partkey AS id, p_brand AS brand, p_name AS model, 1950 + p_size AS year, CASE WHEN p_size % 5 > 0 THEN p_brand || ' ' || (p_size % 3) END AS f, nullif(p_type, 'PROMO') AS category, nullif(p_size, 7) AS weight FROM part),
said AS (SELECT p_brand || ' ' || (p_size % 3) AS f FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size % 5 > 0 AND l_linenumber = 1 AND p_brand <> 'Brand#11'),
fam AS (SELECT f, min(brand) AS brand, min(year) AS low, max(year) AS high FROM prod WHERE f IS NOT NULL GROUP BY f)"""


def _world(spark, d):
    part = table(spark, d, "part")
    family = F.concat_ws(" ", "p_brand", (F.col("p_size") % 3).cast("string"))
    products = part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_name").alias("model"), (F.col("p_size") + 1950).alias("year"), F.when(F.col("p_size") % 5 > 0, family).alias("family_id"), F.nullif("p_type", F.lit("PROMO")).alias("category"), F.nullif("p_size", F.lit(7)).alias("weight"))
    families = products.where(F.col("family_id").isNotNull()).groupBy(F.col("family_id").alias("id")).agg(F.min("brand").alias("brand"), F.min("year").alias("year_min"), F.max("year").alias("year_max")).withColumn("family_name", F.col("id"))
    sold = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("p_partkey"))
    comments = sold.join(part, "p_partkey").where("p_size % 5 > 0 and p_brand <> 'Brand#11'").select(family.alias("family_id"))
    return products, families, comments


@query(f"""WITH {_WORLD} SELECT brand, count(*) AS n_products, CAST(min(year) AS INT) AS year_min, CAST(max(year) AS INT) AS year_max, count(DISTINCT f) AS n_families, count(DISTINCT CASE WHEN f IN (SELECT f FROM said) THEN f END) AS n_families_reviewed,
count(*) FILTER (category IS NULL) AS miss_category, count(*) FILTER (weight IS NULL) AS miss_weight FROM prod GROUP BY brand ORDER BY n_products DESC, brand""")
def brand_coverage(spark, d):
    products, _, comments = _world(spark, d)
    return analytics.brand_coverage(products, comments, ["category", "weight"])


@query(f"""WITH {_WORLD} SELECT fam.brand, f AS family_name, CAST(low AS INT) AS year_min, CAST(high AS INT) AS year_max, count(DISTINCT id) AS n_products, (SELECT count(*) FROM said WHERE said.f = fam.f) AS n_comments, count(*) FILTER (category IS NULL) AS miss_category, count(*) FILTER (weight IS NULL) AS miss_weight
FROM fam JOIN prod USING (f) GROUP BY fam.brand, f, low, high UNION ALL
SELECT brand, 'no family', CAST(min(year) AS INT), CAST(max(year) AS INT), count(*), 0, count(*) FILTER (category IS NULL), count(*) FILTER (weight IS NULL) FROM prod WHERE f IS NULL GROUP BY brand""")
def family_coverage(spark, d):
    return analytics.family_coverage(*_world(spark, d), ["category", "weight"])


@query(f"""WITH {_WORLD} SELECT count(*) AS n_products, count(*) FILTER (category IS NULL) AS miss_category, count(*) FILTER (weight IS NULL) AS miss_weight,
(SELECT count(*) FROM said) AS n_comments, (SELECT count(DISTINCT f) FROM said) AS n_families_reviewed, (SELECT count(*) FROM fam) AS n_families FROM prod""")
def catalogue_totals(spark, d):
    return analytics.catalogue_totals(*_world(spark, d), ["category", "weight"])


_RECALLS = """rec AS (SELECT p_partkey AS position, p_partkey % 50 AS campno, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS b, regexp_replace(lower(p_name || p_type), '[^a-z0-9]', '', 'g') AS m,
CASE WHEN p_size % 10 > 1 THEN 1950 + p_size END AS y, CASE WHEN p_size % 4 > 0 THEN p_size END AS units, CASE WHEN p_size % 3 = 0 THEN DATE '2020-02-29' END AS day FROM part),
fams AS (SELECT p_brand AS brand, CASE WHEN min(p_size) = 1 AND p_name LIKE 'small%' THEN 'a!' ELSE p_name END AS name, min(1950 + p_size) + 5 AS low, max(1950 + p_size) - 5 AS high, min(p_partkey) AS id FROM part GROUP BY p_brand, p_name),
hit AS (SELECT position, campno, id, y, units, day FROM rec JOIN fams ON b = regexp_replace(lower(brand), '[^a-z0-9]', '', 'g') AND len(list_filter(string_split(name, ' '), lambda w: NOT contains(m, w))) = 0 AND (y IS NULL OR y BETWEEN low - 1 AND high + 1)
WHERE length(regexp_replace(name, '[^a-z0-9]', '', 'g')) >= 3),
one AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY campno, id, y ORDER BY position) = 1)"""


def _recalls(spark, d):
    part = table(spark, d, "part")
    year = F.when(F.col("p_size") % 10 == 0, "9999").when(F.col("p_size") % 10 == 1, "99").otherwise((F.col("p_size") + 1950).cast("string"))
    text = F.lit("").alias
    records = part.select(
        F.col("p_partkey").alias("position"), (F.col("p_partkey") % 50).cast("string").alias("campno"), F.upper("p_brand").alias("make"), F.concat_ws("-", "p_name", "p_type").alias("model"), year.alias("model_year"), text("component"), text("defect"), text("consequence"), text("corrective"),
        F.when(F.col("p_size") % 4 > 0, F.col("p_size").cast("string")).otherwise("n/a").alias("units_affected"), F.when(F.col("p_size") % 3 == 0, "20200229").otherwise("20230229").alias("report_date"),
    )
    families = part.groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("id"), (F.min("p_size") + 1955).alias("year_min"), (F.max("p_size") + 1945).alias("year_max"), F.min("p_size").alias("least"))
    families = families.select("id", F.col("p_brand").alias("brand"), F.when((F.col("least") == 1) & F.col("p_name").startswith("small"), "a!").otherwise(F.col("p_name")).alias("family_name"), "year_min", "year_max")
    return records, families


@query(f"WITH {_RECALLS} SELECT CAST(campno AS VARCHAR) AS campno, id AS family_id, CAST(y AS INT) AS model_year, CAST(units AS INT) AS units_affected, day AS report_date FROM one WHERE NOT EXISTS (SELECT 1 FROM one o WHERE o.campno = one.campno AND o.id = one.id AND o.y IS NOT DISTINCT FROM one.y AND o.campno % 2 = 0)")
def recalls_inserted(spark, d):
    """Recalls of families, those with even numbers loaded before; a null year equals a null year."""
    records, families = _recalls(spark, d)
    empty = spark.createDataFrame([], "campno string, family_id long, model_year int")
    old = loads.new_recalls(empty, records.where("campno % 2 = 0"), families)
    return loads.new_recalls(old, records, families).select("campno", "family_id", "model_year", "units_affected", "report_date")


@query(f"WITH {_RECALLS} SELECT (SELECT count(*) FROM one WHERE id <= 40) AS known_recalls_total, (SELECT string_agg(coalesce(CAST(y AS VARCHAR), '?') || ':' || coalesce(CAST(units AS VARCHAR), '?'), ',' ORDER BY y DESC NULLS LAST, c DESC, units DESC) FROM (SELECT y, units, CAST(campno AS VARCHAR) AS c FROM one WHERE id <= 40 ORDER BY y DESC NULLS LAST, CAST(campno AS VARCHAR), id LIMIT 5)) AS recent, 1040 AS price_median, 40 AS n_listings")
def family_context(spark, d):
    """What is known of some families: their recalls, the latest of them, and the estimate from most listings."""
    records, families = _recalls(spark, d)
    recalls = loads.new_recalls(spark.createDataFrame([], "campno string, family_id long, model_year int"), records, families)
    prices = spark.range(1, 41).select(F.col("id").alias("family_id"), F.col("id").alias("n_listings"), (F.col("id") + 1000).alias("price_median"), F.lit(1).alias("price_p25"), F.lit(2).alias("price_p75"), F.lit(3).alias("mileage_median"), F.lit(2022).alias("snapshot_year"), F.lit(None).cast("int").alias("reg_year"))
    held = tools.Catalogue(products=families, families=families, comments=families, recalls=recalls, prices=prices, embed=lambda c: c)
    wanted = families.where("id < 40").select("id")
    context = tools.families_context(held, wanted.unionByName(spark.createDataFrame([(40,)], "id long"))).select("context.*")
    recent = F.array_join(F.transform("recent_recalls", lambda r: F.concat_ws(":", F.coalesce(r["model_year"].cast("string"), F.lit("?")), F.coalesce(r["units_affected"].cast("string"), F.lit("?")))), ",")
    return context.select("known_recalls_total", recent.alias("recent"), F.col("used_price_estimate.price_median").cast("int").alias("price_median"), F.col("used_price_estimate.n_listings").cast("int").alias("n_listings"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS url, CASE WHEN p_size <= 25 THEN p_brand ELSE p_brand || ' new' END AS brand, CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS DOUBLE) ELSE p_retailprice END AS displacement_ccm,
CASE WHEN p_size < 10 THEN 100 + p_size END AS weight_kg, p_type <> 'ECONOMY' AS in_family FROM part""")
def products_loaded(spark, d):
    """Two loads of products: brands of the first stay, sizes follow the second. A displacement of zero gives way to the listing's; weights come from the sheet."""
    part, nothing = table(spark, d, "part"), F.lit(None)
    sheet = F.create_map(F.lit("Dry weight"), F.when(F.col("p_size") < 10, F.concat((F.col("p_size") + 100).cast("string"), F.lit(".0 kg (x pounds)"))).otherwise("?"))
    sizes = {f: nothing.cast("double").alias(f) for f in loads.SPEC_LABELS if f != "displacement_ccm"}
    page = F.when(F.col("p_type") != "ECONOMY", F.concat(F.lit("/d/"), "p_brand"))

    def rows(brand, displacement):
        named = (F.col("p_partkey").cast("string").alias("url"), brand.alias("brand"), F.col("p_name").alias("model"), (F.col("p_size") + 1950).alias("year"), F.col("p_type").alias("category"))
        return part.select(*named, page.alias("discussion_url"), F.col("p_size").alias("listed_ccm"), sheet.alias("raw_specs"), F.col("p_partkey").alias("position"), displacement.alias("displacement_ccm"), *sizes.values())

    fields = ", ".join(f"{f} double" for f in loads.SPEC_LABELS)
    empty = spark.createDataFrame([], f"url string, brand string, model string, year int, category string, category_fr string, msrp_eur double, family_id long, {fields}, raw_specs map<string,string>")
    old = loads.load_products(empty, rows(F.col("p_brand"), F.col("p_retailprice") * 2).where("listed_ccm <= 25"))
    new = loads.load_products(old, rows(F.concat("p_brand", F.lit(" new")), F.when(F.col("p_size") % 3 == 0, F.lit(0.0)).otherwise(F.col("p_retailprice"))))
    return new.select("url", "brand", "displacement_ccm", F.col("weight_kg").cast("int").alias("weight_kg"), F.col("family_id").isNotNull().alias("in_family"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, p_brand AS f, replace(p_name, 'e', '''') AS t, CASE WHEN l_linenumber < 5 THEN CAST(l_linenumber AS VARCHAR) END AS day, l_suppkey % 3 AS a, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand <> 'Brand#11'),
u AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY f, a, day, t ORDER BY pos) = 1),
o AS (SELECT f, t FROM u WHERE a = 0 AND day = '1' QUALIFY count(*) OVER (PARTITION BY f) >= 3), k AS (SELECT * FROM u QUALIFY count(*) OVER (PARTITION BY f) >= 3)
SELECT f AS brand, t AS comment_text, CAST(a AS VARCHAR) AS author, day AS posted_at FROM k WHERE NOT (coalesce(day = '1', false) AND a = 0 AND EXISTS (SELECT 1 FROM o WHERE o.f = k.f AND o.t = k.t))""")
def comments_inserted(spark, d):
    """Comments by way of product and family, each once; those of the first author and day are there already, an unknown day equals none."""
    part = table(spark, d, "part")
    products = part.select(F.col("p_partkey").cast("string").alias("url"), F.when(F.col("p_brand") != "Brand#11", F.xxhash64("p_brand")).alias("family_id"))
    families = part.groupBy("p_brand").agg(F.first(F.xxhash64("p_brand")).alias("id"))
    line = table(spark, d, "lineitem").withColumn("position", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    scraped = line.join(part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey").select(
        F.col("l_partkey").cast("string").alias("product_url"), (F.col("l_suppkey") % 3).cast("string").alias("author"), F.when(F.col("l_linenumber") < 5, F.col("l_linenumber").cast("string")).alias("posted_at"), F.replace("p_name", F.lit("e"), F.lit("´")).alias("text"), "position"
    )
    empty = spark.createDataFrame([], "family_id long, author string, posted_at string, comment_text string")
    none = lambda c: F.lit(None).cast("array<float>")
    old, _ = loads.new_comments(empty, scraped.where("author = '0' and posted_at = '1'"), products, families, none)
    fresh, _ = loads.new_comments(old, scraped, products, families, none)
    return fresh.join(families.select(F.col("id").alias("family_id"), F.col("p_brand").alias("brand")), "family_id").select("brand", "comment_text", "author", "posted_at")


@query("""WITH p AS (SELECT p_brand AS b, p_name AS n, 1900 + p_size AS y, min(p_partkey) AS id FROM part GROUP BY ALL),
l AS (SELECT p_brand AS b, p_name AS n, 1900 + p_size - 10 * (p_size % 2) AS y, arg_max(nullif(p_partkey % 9, 0), p_partkey) FILTER (p_partkey % 9 > 0) AS price, arg_max(nullif(p_type, 'PROMO'), p_partkey) FILTER (p_type <> 'PROMO') AS c FROM part WHERE 1900 + p_size - 10 * (p_size % 2) >= 1894 GROUP BY 1, 2, 3)
SELECT p.id, CAST(price AS DOUBLE) AS msrp_eur, c AS category_fr FROM p LEFT JOIN l USING (b, n, y)""")
def list_prices_loaded(spark, d):
    """List prices of pages that name a product exactly; of several pages the last that says something counts, and implausible years none."""
    part = table(spark, d, "part")
    products = part.groupBy(F.col("p_brand").alias("brand"), F.col("p_name").alias("model"), (F.col("p_size") + 1900).alias("year")).agg(F.min("p_partkey").alias("id"))
    every = products.withColumns({"msrp_eur": F.lit(None).cast("double"), "category_fr": F.lit(None).cast("string")})
    pages = part.select(F.col("p_brand").alias("brand"), F.col("p_name").alias("model"), (F.col("p_size") + 1900 - 10 * (F.col("p_size") % 2)).alias("year"), F.nullif(F.col("p_partkey") % 9, F.lit(0)).alias("price_eur"), F.when(F.col("p_type") != "PROMO", F.col("p_type")).otherwise("").alias("category_fr"), F.col("p_partkey").alias("position"))
    exact = pages.hint("merge").join(products.select("brand", "model", "year").hint("merge"), ["brand", "model", "year"], "left_semi")
    return loads.load_list_prices(every, exact).select("id", "msrp_eur", "category_fr")


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY p_partkey // 2 ORDER BY p_partkey) AS k FROM part),
r AS (SELECT p_brand || ' ' || p_name AS f, 1990 + p_size % 3 AS y, p_retailprice * (CASE WHEN p_size % 11 = 0 THEN 0.1 ELSE 1.5 END) AS price, CASE WHEN p_size % 2 = 0 THEN p_size END AS km FROM l WHERE k = 1 AND p_size % 7 > 0 AND p_size % 13 > 0),
g AS (SELECT f, CAST(y AS INT) AS y, count(*) AS n, CAST(trunc(quantile_cont(price, 0.5)) AS BIGINT) AS med, CAST(trunc(quantile_cont(price, 0.25)) AS BIGINT) AS p25, CAST(trunc(quantile_cont(price, 0.75)) AS BIGINT) AS p75, CAST(trunc(quantile_cont(km, 0.5)) AS BIGINT) AS km FROM r WHERE price BETWEEN 200 AND 80000 GROUP BY GROUPING SETS ((f, y), (f)) HAVING count(*) >= 3)
SELECT f AS family, y AS reg_year, n AS n_listings, med AS price_median, p25 AS price_p25, p75 AS price_p75, km AS mileage_median FROM g""")
def used_prices_loaded(spark, d):
    """Quartiles of plausible asking prices by family and year; a link counts once, new offers and undated ones do not."""
    part = table(spark, d, "part")
    size, full = F.col("p_size"), F.concat_ws(" ", "p_brand", "p_name")
    named = part.select(full.alias("name"), "p_brand", "p_name").distinct()
    products = named.withColumn("year", F.explode(F.sequence(F.lit(1990), F.lit(1992)))).select(F.xxhash64("name", "year").alias("id"), F.xxhash64("name").alias("family_id"), F.col("p_brand").alias("brand"), F.col("p_name").alias("model"), "year")
    listings = part.select(
        F.floor(F.col("p_partkey") / 2).cast("string").alias("link"), F.col("p_brand").alias("make_model"), F.col("p_name").alias("version"), F.when(size % 13 == 0, "soon").otherwise(F.concat(F.lit("03/"), (size % 3 + 1990).cast("string"))).alias("date"),
        (F.col("p_retailprice") * F.when(size % 11 == 0, 0.1).otherwise(1.5)).alias("price"), F.when(size % 2 == 0, size).alias("mileage"), F.when(size % 7 == 0, "New").otherwise("Used").alias("offer_type"), F.col("p_partkey").alias("position"),
    )
    cells = loads.used_prices(listings, products, 2022)
    return cells.join(named.select(F.xxhash64("name").alias("family_id"), F.col("name").alias("family")), "family_id").drop("family_id", "snapshot_year")


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part WHERE regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') LIKE '%brand12%' ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 4")
def renamed_request(spark, d):
    """A call with another name of an argument and one that does not exist."""
    search = Tool(lambda **a: spec_filter(table(spark, d, "part"), SpecFilter(brand=a["brand"], limit=a.get("limit")), PARTS), ("brand", "limit"), ("brand",))
    return run_tool({"search": search}, "search", {"brands": "Brand 12", "limit": 4, "colour": "red"})[0].select(*PART_COLUMNS)
