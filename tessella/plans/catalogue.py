"""The engine's queries over the driver's tables, each beside the SQL it is held against.

The tables stand in for a catalogue: parts are products, their size a model year, suppliers and customers are owners,
documents are what people write about them. Every query reads whole tables; searches take the rows whose id is divisible
by 100 as queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import all_words, cosine, newest_first, norm, number_with_unit, rot13, starts_with_any, tokens, words
from tessella.operators import analytics, filters, matching, merge, search
from tessella.sources import extract
from tessella.sources.readers import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

PARTS = filters.SpecTable("p_partkey", "p_brand", ("p_type", "p_name"), ("p_size", "p_retailprice"), "p_retailprice", power="p_retailprice", weight="p_size")
PART_COLUMNS = ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
TERMS = ("the", "and", "der")


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Filters


@query("SELECT * FROM part WHERE p_size BETWEEN 10 AND 30 AND regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') LIKE '%economy%' ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 10")
def spec_filter_range(spark, d):
    return filters.spec_filter(table(spark, d, "part"), filters.SpecFilter(category="Economy", bounds={"p_size": (10, 30)}), PARTS)


@query("SELECT * FROM part WHERE regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') LIKE '%brand1%' ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 10")
def spec_filter_norm_brand(spark, d):
    return filters.spec_filter(table(spark, d, "part"), filters.SpecFilter(brand="BRAND 1"), PARTS)


@query("SELECT p_partkey, p_type, p_name FROM part WHERE regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') LIKE '%small%' OR regexp_replace(lower(coalesce(p_name, '')), '[^a-z0-9]', '', 'g') LIKE '%small%'")
def spec_filter_dual_label(spark, d):
    df = table(spark, d, "part")
    for c in filters.conditions(filters.SpecFilter(category="small"), PARTS):
        df = df.where(c)
    return df.select("p_partkey", "p_type", "p_name")


@query("""SELECT p_partkey, CASE WHEN kw <= 35 AND kw / nullif(p_size - 1, 0) <= 0.2 THEN 'direct' WHEN kw > 35 AND kw <= 70 THEN 'bridled' END AS label,
coalesce(kw <= 35 AND kw / nullif(p_size - 1, 0) <= 0.2, false) OR coalesce(kw > 35 AND kw <= 70, false) AS eligible
FROM (SELECT p_partkey, p_size, nullif(p_size % 40, 7) * 3 * 0.7355::DOUBLE AS kw FROM part)""")
def spec_filter_licence_case(spark, d):
    power = F.nullif(F.col("p_size") % 40, F.lit(7)) * 3
    eligible, label = filters.licence(power, F.col("p_size") - 1)
    return table(spark, d, "part").select("p_partkey", label.alias("label"), eligible.alias("eligible"))


@query("SELECT count(*) AS matching FROM part WHERE p_size >= 0 AND p_retailprice <= 950 AND regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') LIKE '%brand2%'")
def spec_filter_count(spark, d):
    return filters.spec_filter(table(spark, d, "part"), filters.SpecFilter(brand="brand#2", bounds={"p_size": (0, None), "p_retailprice": (None, 950)}, count_only=True, limit=3), PARTS)


@query("SELECT c_custkey, nullif(c_nationkey, 3) AS c_nationkey FROM customer ORDER BY nullif(c_nationkey, 3) ASC NULLS LAST, c_custkey DESC NULLS LAST LIMIT 25")
def spec_filter_sort_whitelist(spark, d):
    df = table(spark, d, "customer").select((-F.col("c_custkey")).alias("k"), F.nullif(F.col("c_nationkey"), F.lit(3)).alias("c_nationkey"))
    out = filters.spec_filter(df, filters.SpecFilter(order_by="c_nationkey", limit=25), filters.SpecTable("k", "k", (), ("c_nationkey",), "c_nationkey"))
    return out.select((-F.col("k")).alias("c_custkey"), "c_nationkey")


@query("SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey = s_suppkey AND p_brand || ' ' || p_name ILIKE '%ring%' AND p_brand || ' ' || p_name ILIKE '%small%')")
def word_match_semi_join(spark, d):
    sold = table(spark, d, "part").join(table(spark, d, "lineitem").select("l_partkey", F.col("l_suppkey").alias("s_suppkey")), F.col("l_partkey") == F.col("p_partkey"))
    return filters.word_match_members(table(spark, d, "supplier"), sold, "s_suppkey", F.concat("p_brand", F.lit(" "), "p_name"), "ring small").select("s_suppkey", "s_name")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND regexp_replace(lower(o_orderpriority), '[^a-z0-9]', '', 'g') LIKE '%1urgent%')")
def label_semi_join(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return filters.label_members(table(spark, d, "customer"), orders, "c_custkey", F.col("o_orderpriority"), "1-Urgent").select("c_custkey", "c_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def membership_in(spark, d):
    sold = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").join(sold, "p_partkey", "left_semi").select("p_partkey", "p_name")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def detail_lookup_topn(spark, d):
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    return table(spark, d, "orders").withColumn("n", at).where("n <= 3").select("o_custkey", "o_orderkey", "o_orderdate")


@query("""SELECT c_mktsegment, count(*) AS n_rows, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS best_key,
array_to_string(list_slice(list_reverse(list_sort(list(o_orderkey))), 1, 5), ',') AS latest_keys
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""")
def detail_context(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    out = filters.detail_context(rows, ["c_mktsegment"], [F.col("o_orderkey")], F.struct("o_totalprice", "o_orderkey"))
    return out.select("c_mktsegment", "n_rows", F.col("best.o_orderkey").alias("best_key"), F.array_join(F.transform("latest", lambda x: x["o_orderkey"].cast("string")), ",").alias("latest_keys"))


@query("SELECT event_id, CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 10 = 0 THEN NULL ELSE json_extract_string(props, '$.k') END AS k, CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 10 = 0 THEN 0 ELSE 1 END AS n_left FROM events")
def spec_map_filter(spark, d):
    entries = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("Rating"), F.lit("5"), F.lit("blank"), F.lit(" ")))
    wiped = F.transform_values(entries, lambda k, v: F.when((k == "k") & (v.cast("int") % 10 == 0), F.lit("Loading...")).otherwise(v))
    kept = filters.map_without(wiped, ("Rating", "Ask questions"))
    return table(spark, d, "events").select("event_id", kept["k"].alias("k"), F.size(kept).alias("n_left"))


@query("SELECT p_partkey, CASE WHEN lower(trim(p_type)) = 'promo' THEN false WHEN lower(trim(p_type)) = 'small' THEN coalesce(nullif(p_size, 49) >= 25, false) ELSE true END AS included FROM part")
def category_rule(spark, d):
    size = F.nullif(F.col("p_size"), F.lit(49))
    return table(spark, d, "part").select("p_partkey", filters.category_included(F.col("p_type"), size, "promo", "small", 25).alias("included"))


# Retrieval

_DENSE = """dense AS (SELECT q.vec_id AS query_id, e.vec_id AS id, 1 - list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS distance
FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM dense)"""


def _dense(spark, d, k):
    rows = table(spark, d, "embeddings")
    return search.dense_topk(rows, rows.where("vec_id % 100 = 0"), k)


@query(f"WITH {_DENSE} SELECT query_id, id, round(distance, 4) AS distance, rank FROM ranked WHERE rank <= 10")
def dense_topk(spark, d):
    return _dense(spark, d, 10).withColumn("distance", F.round("distance", 4))


@query(f"WITH {_DENSE} SELECT avg(CASE WHEN id = query_id THEN 1.0::DOUBLE ELSE 0 END) AS hit_rate, round(avg(CASE WHEN id = query_id THEN distance END), 4) AS self_distance FROM ranked WHERE rank = 1")
def dense_self_retrieval(spark, d):
    same = F.col("id") == F.col("query_id")
    return _dense(spark, d, 1).agg(F.avg(same.cast("double")).alias("hit_rate"), F.round(F.avg(F.when(same, F.col("distance"))), 4).alias("self_distance"))


@query(f"WITH {_DENSE}, s AS (SELECT avg(distance) + 0.3 AS threshold FROM ranked WHERE id = query_id AND rank <= 2) SELECT query_id, distance > threshold AS off_topic FROM ranked, s WHERE rank = 2")
def dense_negative_control(spark, d):
    near = _dense(spark, d, 2)
    threshold = near.where("id = query_id").agg((F.avg("distance") + 0.3).alias("threshold"))
    return near.where("rank = 2").join(F.broadcast(threshold)).select("query_id", (F.col("distance") > F.col("threshold")).alias("off_topic"))  # a single row


_SPARSE = """words AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w IN ('the', 'and', 'der')) AS found FROM documents),
hits AS (SELECT doc_id AS id, CASE WHEN len(list_distinct(found)) >= 3 THEN 0 ELSE 1 END AS level, len(found) AS score FROM words WHERE len(found) > 0)"""


@query(f"WITH {_SPARSE} SELECT id, score FROM hits WHERE level = 0")
def sparse_and(spark, d):
    return search.sparse_hits(table(spark, d, "documents"), list(TERMS), "doc_id", "text")


@query(f"WITH {_SPARSE}, best AS (SELECT * FROM hits WHERE level = (SELECT min(level) FROM hits)) SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM best QUALIFY rank <= 50")
def sparse_or_fallback(spark, d):
    return search.sparse_topk(table(spark, d, "documents"), list(TERMS), 50, "doc_id", "text")


_FUSED = f"""WITH {_DENSE}, {_SPARSE}, s AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS sparse_rank FROM hits WHERE level = (SELECT min(level) FROM hits) QUALIFY sparse_rank <= 50),
q AS (SELECT DISTINCT query_id FROM ranked), t AS (SELECT query_id, id, sparse_rank FROM s, q), e AS (SELECT query_id, id, distance, rank AS dense_rank FROM ranked WHERE rank <= 50),
f AS (SELECT query_id, id, dense_rank, sparse_rank, coalesce(1.0::DOUBLE / (59 + dense_rank), 0) + coalesce(1.0::DOUBLE / (59 + sparse_rank), 0) AS rrf FROM e FULL JOIN t USING (query_id, id))"""


def _fused(spark, d, digits=None):
    dense = _dense(spark, d, 50)
    asked = table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"))
    found = search.sparse_topk(table(spark, d, "documents"), list(TERMS), 50, "doc_id", "text")
    return search.rrf(dense, asked.join(F.broadcast(found)), ["query_id", "id"], digits=digits)  # 50 rows for each query


@query(f"{_FUSED} SELECT query_id, id, dense_rank, sparse_rank, round(rrf, 8) AS rrf FROM f")
def rrf_fusion(spark, d):
    return _fused(spark, d).select("query_id", "id", "dense_rank", "sparse_rank", F.round("rrf", 8).alias("rrf"))


_EXACT = "(SELECT CASE WHEN 2 * r > u OR (2 * r = u AND q % 2 = 1) THEN q + 1 ELSE q END / 100000.0::DOUBLE FROM (SELECT t // u AS q, t % u AS r, u FROM (SELECT CAST(({x}) * 1152921504606846976 AS HUGEINT) * 100000 AS t, 1152921504606846976::HUGEINT AS u)))"
_FIRST = _EXACT.format(x="coalesce(1.0::DOUBLE / (59 + dense_rank), 0)")


@query(f"{_FUSED}, g AS (SELECT *, {_FIRST} AS first FROM f) SELECT query_id, id, dense_rank, sparse_rank, {_EXACT.format(x='first + coalesce(1.0::DOUBLE / (59 + sparse_rank), 0)')} AS rrf FROM g")
def rrf_rounded(spark, d):
    """Ranks fused with five digits kept after each addition, halves by the exact binary value."""
    return _fused(spark, d, 5).select("query_id", "id", "dense_rank", "sparse_rank", "rrf")


@query("""WITH w AS (SELECT doc_id, len(list_intersect(list_distinct(regexp_split_to_array(lower(text), '\\s+')), ['the', 'and', 'of', 'with', 'by'])) AS rerank_score, n_chars FROM documents),
pool AS (SELECT * FROM w ORDER BY n_chars DESC, doc_id LIMIT 50) SELECT doc_id, rerank_score FROM pool ORDER BY rerank_score DESC, doc_id LIMIT 8""")
def rerank_pool(spark, d):
    pool = table(spark, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(search.fetch_size(9, True))
    overlap = F.size(F.array_intersect(words(F.lower("text")), F.array(*[F.lit(w) for w in ("the", "and", "of", "with", "by")]))).cast("long")
    return search.rerank(pool, overlap, 8, [F.col("doc_id")]).select("doc_id", "rerank_score")


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), r AS (SELECT q.vec_id AS query_id, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY 1 - list_cosine_similarity(q.v, e.v), e.vec_id) AS rank FROM e, e q WHERE q.vec_id % 100 = 0),
a AS (SELECT query_id AS pair, id FROM r WHERE rank <= 10), b AS (SELECT query_id + 100 AS pair, id FROM r WHERE rank <= 10)
SELECT pair, count(*) FILTER (n = 2) AS n_shared, count(*) AS n_all, (count(*) FILTER (n = 2)) / count(*) AS jaccard FROM (SELECT pair, id, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL) GROUP BY pair""")
def topk_jaccard(spark, d):
    near = _dense(spark, d, 10)
    return analytics.list_overlap(near.select(F.col("query_id").alias("pair"), "id"), near.select((F.col("query_id") + 100).alias("pair"), "id"), ["pair"], "id")


@query("""WITH b AS (SELECT regexp_matches(text, '(?i)licen[cs]ed|copyright') AS hit, n_chars >= 2000 AS top FROM documents)
SELECT avg(hit::INT) AS base_rate, avg(CASE WHEN top THEN hit::INT END) AS top_rate, count(*) FILTER (top AND hit) AS top_hits, avg(CASE WHEN top THEN hit::INT END) / nullif(avg(hit::INT), 0) AS lift FROM b""")
def keyword_lift(spark, d):
    return analytics.keyword_lift(table(spark, d, "documents"), F.col("n_chars") >= 2000, "licen[cs]ed|copyright", "text")


@query("SELECT a.vec_id AS vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def neighbour_similarity(spark, d):
    e = table(spark, d, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 4).alias("similarity"))


@query(f"{_FUSED} SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, dense_rank ASC NULLS LAST, sparse_rank ASC NULLS LAST, id) AS place FROM f QUALIFY place <= 10")
def hybrid_topk(spark, d):
    return search.fused_topk(_fused(spark, d), ["query_id"], 10).select("query_id", "id", "place")


@query(f"WITH {_DENSE} SELECT query_id, count(*) FILTER (regexp_matches(text, '(?i)licen[cs]ed|copyright|the ')) AS n_on_topic, count(*) AS n_listed FROM ranked JOIN documents ON doc_id = id WHERE rank <= 10 GROUP BY query_id")
def on_topic_hits(spark, d):
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return analytics.topic_hits(_dense(spark, d, 15).join(texts, "id"), ["query_id"], "text", "licen[cs]ed|copyright|the ", "rank", 10)


# Entity resolution

_MATCH_SOURCE = """src AS (SELECT p_partkey AS source_id, p_size + (p_partkey % 3) - 1 AS y, list_distinct(regexp_extract_all(lower(CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' ' || p_brand WHEN 2 THEN p_name || ' 650' ELSE p_name || ' deluxe ' || p_brand || ' 7' END), '[a-z]+|[0-9]+')) AS r FROM part),
s2 AS (SELECT *, list_filter(r, lambda t: NOT (regexp_matches(t, '^[0-9]+$') AND TRY_CAST(t AS BIGINT) >= 50)) AS r2 FROM src),
rws AS (SELECT p_partkey AS row_id, p_size AS ry, p_type, list_distinct(regexp_extract_all(lower(p_brand || ' ' || p_name), '[a-z]+|[0-9]+')) AS t FROM part),
cand AS (SELECT source_id, row_id, p_type, o, r, r2, t FROM s2, (SELECT unnest([1, 2, 3]) AS o), rws WHERE ry = y + CASE o WHEN 1 THEN 0 WHEN 2 THEN -1 ELSE 1 END),
pass AS (SELECT source_id, row_id, p_type, o, 1 AS p, len(list_filter(t, lambda x: NOT list_contains(r, x))) AS sc FROM cand WHERE len(r) > 0 AND list_has_all(t, r)
UNION ALL SELECT source_id, row_id, p_type, o, 2, len(list_filter(t, lambda x: NOT list_contains(r2, x))) FROM cand WHERE len(r2) > 0 AND list_has_all(t, r2)
UNION ALL SELECT source_id, row_id, p_type, o, 3, -len(t) FROM cand WHERE len(t) >= 3 AND list_has_all(r, t)),
best AS (SELECT *, rank() OVER (PARTITION BY source_id ORDER BY o, p, sc) AS k FROM pass)"""


def _match_sides(spark, d):
    part = table(spark, d, "part")
    name = F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).when(F.col("p_partkey") % 4 == 1, F.concat_ws(" ", "p_name", "p_brand"))
    name = name.when(F.col("p_partkey") % 4 == 2, F.concat("p_name", F.lit(" 650"))).otherwise(F.concat("p_name", F.lit(" deluxe "), "p_brand", F.lit(" 7")))
    source = part.select(F.col("p_partkey").alias("source_id"), tokens(name).alias("source_tokens"), (F.col("p_size") + F.col("p_partkey") % 3 - 1).alias("source_year"))
    rows = part.select(F.col("p_partkey").alias("row_id"), tokens(F.concat_ws(" ", "p_brand", "p_name")).alias("row_tokens"), F.col("p_size").alias("row_year"), "p_type")
    return source, rows


def _matches(spark, d, offsets=(0, -1, 1)):
    return matching.match_by_tokens(*_match_sides(spark, d), offsets)


for _number, _name in ((1, "match_forward"), (2, "match_no_suffix"), (3, "match_reverse")):
    QUERIES[_name] = lambda spark, d, n=_number: _matches(spark, d, (0,)).where(F.col("pass_no") == n).select("source_id", "row_id")
    ORACLE_SQL[_name] = f"WITH {_MATCH_SOURCE}, b0 AS (SELECT *, rank() OVER (PARTITION BY source_id ORDER BY p, sc) AS k0 FROM pass WHERE o = 1) SELECT source_id, row_id FROM b0 WHERE k0 = 1 AND p = {_number}"


@query(f"WITH {_MATCH_SOURCE} SELECT source_id, row_id, CASE o WHEN 1 THEN 0 WHEN 2 THEN -1 ELSE 1 END AS \"offset\", p AS pass_no FROM best WHERE k = 1")
def match_year_offset(spark, d):
    return _matches(spark, d)


@query(f"WITH {_MATCH_SOURCE} SELECT source_id, min(p_type) AS p_type FROM best WHERE k = 1 GROUP BY source_id HAVING count(DISTINCT p_type) = 1")
def match_ambiguity(spark, d):
    return matching.match_unambiguous(*_match_sides(spark, d), "p_type")


@query("""SELECT a.p_partkey AS source_id, b.p_partkey AS row_id FROM part a JOIN part b ON a.p_brand = b.p_brand WHERE contains(regexp_replace(lower(a.p_name || a.p_type), '[^a-z0-9]', '', 'g'), split_part(lower(b.p_name), ' ', 1))
AND contains(regexp_replace(lower(a.p_name || a.p_type), '[^a-z0-9]', '', 'g'), split_part(lower(b.p_name), ' ', 2)) AND (nullif(a.p_size, 5) IS NULL OR a.p_size BETWEEN b.p_size - 1 AND b.p_size + 3)""")
def substring_interval_join(spark, d):
    part = table(spark, d, "part")
    source = part.select(F.col("p_partkey").alias("source_id"), F.col("p_brand").alias("brand_key"), norm(F.concat("p_name", "p_type")).alias("name_key"), F.nullif(F.col("p_size"), F.lit(5)).alias("year"))
    rows = part.select(F.col("p_partkey").alias("row_id"), F.col("p_brand").alias("brand_key"), F.split(F.lower("p_name"), " ").alias("row_words"), F.col("p_size").alias("low"), (F.col("p_size") + 2).alias("high"))
    return matching.interval_match(source, rows)


@query("""WITH m AS (SELECT p_partkey AS mention_id, p_size, substr(p_name, 1, 4) AS mention FROM part), n AS (SELECT p_partkey AS name_id, p_size, p_name AS name FROM part)
SELECT mention_id, name_id FROM (SELECT mention_id, name_id, rank() OVER (PARTITION BY mention_id ORDER BY abs(length(name) - length(mention))) AS k FROM m JOIN n USING (p_size) WHERE contains(name, mention) OR contains(mention, name)) WHERE k = 1""")
def closest_length_resolve(spark, d):
    part = table(spark, d, "part")
    return matching.closest_length(part.select(F.col("p_partkey").alias("mention_id"), "p_size", F.substring("p_name", 1, 4).alias("mention")), part.select(F.col("p_partkey").alias("name_id"), "p_size", F.col("p_name").alias("name")), "p_size")


# Loads


@query("""WITH c AS (SELECT source, lang, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY ALL)
SELECT source, min(n_chars) AS least, max(n_chars) AS most, (SELECT arg_max(lang, (n, -f)) FROM c WHERE c.source = documents.source) AS mode_lang FROM documents GROUP BY source""")
def family_rollup(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupBy("source").agg(F.min("n_chars").alias("least"), F.max("n_chars").alias("most")).join(analytics.mode_first_seen(docs, ["source"], "lang", F.col("doc_id")), "source")


@query("""WITH s AS (SELECT p_type, p_name, count(*) AS n, min(p_partkey) AS f FROM (SELECT p_type || ' ' || (p_size % 5) AS p_type, CASE WHEN p_size % 5 < 2 THEN p_name || ' ' || (p_size % 5) ELSE p_name END AS p_name, p_partkey FROM part) GROUP BY ALL),
a AS (SELECT p_type, arg_min(p_name, f) AS lead, max(n) AS most, list(regexp_split_to_array(p_name, '\\s+')) AS every FROM s GROUP BY p_type),
k AS (SELECT p_type, array_to_string(list_filter(regexp_split_to_array(lead, '\\s+'), lambda w: len(list_filter(every, lambda e: list_contains(e, w))) = len(every)), ' ') AS shared, most FROM a)
SELECT p_type, CASE WHEN shared <> '' THEN shared ELSE (SELECT arg_min(p_name, (length(p_name), f)) FROM s WHERE s.p_type = k.p_type AND s.n = k.most) END AS display_name FROM k""")
def family_display_name(spark, d):
    part = table(spark, d, "part").select(F.concat_ws(" ", "p_type", F.col("p_size") % 5).alias("p_type"), F.when(F.col("p_size") % 5 < 2, F.concat_ws(" ", "p_name", F.col("p_size") % 5)).otherwise(F.col("p_name")).alias("p_name"), "p_partkey")
    return analytics.common_name(part, "p_type", "p_name", F.col("p_partkey"))


@query("SELECT min(doc_id) AS doc_id, source FROM documents GROUP BY source, lower(trim(text))")
def dedupe_first_wins(spark, d):
    docs = table(spark, d, "documents").withColumn("key", F.sha2(F.lower(F.trim("text")), 256))
    return merge.first_wins(docs.select("doc_id", "source", "key"), ["source", "key"], [F.col("doc_id")]).select("doc_id", "source")


@query("SELECT source, count(DISTINCT text) AS n_unique FROM documents GROUP BY source HAVING count(DISTINCT text) >= 3")
def min_group_threshold(spark, d):
    unique = table(spark, d, "documents").select("source", F.sha2("text", 256).alias("key")).distinct()
    return merge.min_group(unique, ["source"]).groupBy("source").agg(F.count("*").alias("n_unique"))


_BATCHES = """WITH o AS (SELECT o_custkey AS k, min(o_totalprice) AS low, max(o_totalprice) AS high, min(o_orderpriority) AS name FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1),
n AS (SELECT o_custkey AS k, min(o_totalprice) AS low, max(o_totalprice) AS high, min(o_orderpriority) AS name FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)"""


def _batches(spark, d):
    orders = table(spark, d, "orders")
    return [orders.where(F.col("o_orderkey") % 2 == p).groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.min("o_orderpriority").alias("name")) for p in (0, 1)]


@query(f"{_BATCHES} SELECT k, least(o.low, n.low) AS low, greatest(o.high, n.high) AS high, coalesce(n.name, o.name) AS name FROM o FULL JOIN n USING (k)")
def upsert_least_greatest(spark, d):
    return merge.upsert(*_batches(spark, d), ["k"], {"low": "least", "high": "greatest", "name": "new"})


@query(f"{_BATCHES} SELECT k, coalesce(n.low, o.low) AS low, coalesce(o.high, n.high) AS high, coalesce(nullif(n.name, '1-URGENT'), o.name) AS name FROM o FULL JOIN n USING (k)")
def upsert_keep_first(spark, d):
    old, new = _batches(spark, d)
    return merge.upsert(old, new.withColumn("name", F.nullif("name", F.lit("1-URGENT"))), ["k"], {"low": "new", "high": "keep", "name": "fill"})


@query("""WITH t AS (SELECT source, md5(text) AS h FROM documents WHERE doc_id % 3 = 0), n AS (SELECT source, md5(text) AS h, min(doc_id) AS doc_id FROM documents WHERE doc_id % 3 <> 0 GROUP BY ALL)
SELECT doc_id, source FROM n WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.source = n.source AND t.h = n.h)""")
def insert_if_absent(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.md5("text").alias("h"))
    return merge.insert_absent(docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 <> 0"), ["source", "h"], [F.col("doc_id")], null_safe=False).select("doc_id", "source")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) FILTER (value <> 0) AS value FROM events GROUP BY user_id")
def last_writer_wins(spark, d):
    return merge.last_writer(table(spark, d, "events"), ["user_id"], ["event_type", "value"], F.col("event_id"))


@query("""WITH u AS (SELECT l_partkey AS k, arg_max(l_extendedprice, (l_orderkey, l_linenumber)) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT p_partkey, coalesce(v, p_retailprice) AS p_retailprice FROM part LEFT JOIN u ON k = p_partkey""")
def keyed_update(spark, d):
    sold = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"), F.col("l_extendedprice").alias("p_retailprice"), "l_orderkey", "l_linenumber")
    last = merge.last_writer(sold, ["p_partkey"], ["p_retailprice"], F.struct("l_orderkey", "l_linenumber"))
    return merge.apply_updates(table(spark, d, "part").select("p_partkey", "p_retailprice"), last, ["p_partkey"], ["p_retailprice"])


_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"


@query(f"SELECT DISTINCT {_HOST} AS host FROM pages WHERE {_HOST} NOT IN (SELECT {_HOST} FROM pages WHERE page_id % 5 = 0)")
def frontier_antijoin(spark, d):
    hosts = table(spark, d, "pages").select("page_id", extract.url_parts(F.col("url"))[0])
    return merge.frontier(hosts, hosts.where("page_id % 5 = 0"), "host")


# Aggregates


@query("""SELECT c_nationkey, CAST(y AS INT) AS order_year, CAST(grouping(y) AS INT) AS level, count(*) AS n, CAST(trunc(quantile_cont(o_totalprice, 0.25)) AS BIGINT) AS p25, CAST(trunc(quantile_cont(o_totalprice, 0.5)) AS BIGINT) AS median,
CAST(trunc(quantile_cont(o_totalprice, 0.75)) AS BIGINT) AS p75, CAST(trunc(quantile_cont(m, 0.5)) AS BIGINT) AS median_extra FROM (SELECT c_nationkey, year(o_orderdate) AS y, o_totalprice, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS m FROM orders JOIN customer ON o_custkey = c_custkey)
GROUP BY GROUPING SETS ((c_nationkey, y), (c_nationkey)) HAVING count(*) >= 3""")
def quantile_cells(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    rows = rows.select("c_nationkey", F.year("o_orderdate").alias("order_year"), "o_totalprice", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("m"))
    return analytics.quantile_cells(rows, "c_nationkey", "order_year", "o_totalprice", "m")


@query("""WITH l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1)
SELECT source, count(*) AS n_rows, count(DISTINCT doc_id) AS n_keys, count(*) FILTER (quality IS NULL) AS miss_quality, count(*) FILTER (toxic IS NULL) AS miss_toxic,
CAST(floor(100.0 * count(*) FILTER (quality IS NULL) / count(*) + 0.5) AS BIGINT) AS pct_quality, CAST(floor(100.0 * count(*) FILTER (toxic IS NULL) / count(*) + 0.5) AS BIGINT) AS pct_toxic FROM documents LEFT JOIN l USING (doc_id) GROUP BY source""")
def coverage_by_group(spark, d):
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return analytics.coverage(table(spark, d, "documents").select("doc_id", "source").join(labels, "doc_id", "left"), "source", ["quality", "toxic"], "doc_id")


@query("""SELECT count(*) AS n_rows, count(*) FILTER (length(text) < 15) AS n_short, count(*) FILTER (text IS NULL) AS n_null, CAST(floor(avg(length(text)) + 0.5) AS BIGINT) AS mean_length,
(SELECT count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) AS n_orphans, (SELECT count(*) FROM (SELECT 1 FROM documents GROUP BY source, text HAVING count(*) > 1)) AS n_equal_groups FROM documents""")
def integrity_totals(spark, d):
    docs = table(spark, d, "documents").withColumn("h", F.sha2("text", 256))
    return analytics.integrity(docs, table(spark, d, "labels"), "doc_id", "text", ["source", "h"])


@query("""SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN l_quantity > 45 THEN 'max_quantity' END, CASE WHEN nullif(l_discount, 0.05) > 0.08 THEN 'max_discount' END, CASE WHEN l_shipdate < TIMESTAMP '1996-01-01' THEN 'min_date' END], lambda x: x IS NOT NULL), ',') AS violations FROM lineitem""")
def constraint_violations(spark, d):
    broken = analytics.violations({"max_quantity": F.col("l_quantity") > 45, "max_discount": F.nullif(F.col("l_discount"), F.lit(0.05)) > 0.08, "min_date": F.col("l_shipdate") < "1996-01-01"})
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(broken, ",").alias("violations"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, list_filter([CASE WHEN l_quantity > 25 THEN 'quantity' END, CASE WHEN l_discount > 0.05 THEN 'discount' END], lambda x: x IS NOT NULL) AS b FROM lineitem)
SELECT l_orderkey, array_to_string(arg_min(b, (len(b), l_linenumber, l_partkey, l_quantity)), ',') AS cleanest FROM v GROUP BY l_orderkey""")
def constraint_cleanest(spark, d):
    broken = analytics.violations({"quantity": F.col("l_quantity") > 25, "discount": F.col("l_discount") > 0.05})
    rows = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_quantity").alias("at"), broken.alias("b"))
    return analytics.cleanest(rows, ["l_orderkey"], "b", F.col("at")).select("l_orderkey", F.array_join("b", ",").alias("cleanest"))


# The lines of an order stand for the calls that answered a question: at most seven, so an order's list is bounded.
_CALLS = """calls AS (SELECT o_orderkey AS id, o_orderpriority AS kind, o_orderstatus = 'P' AS stopped,
bool_or(l_returnflag = 'R') AS used_r, bool_or(l_returnflag = 'A' AND l_quantity BETWEEN 10 AND 20) AS a_between, bool_or(l_returnflag = 'N' AND l_discount <> 0) AS n_discount,
bool_or(l_returnflag = 'N' AND regexp_matches(CAST(l_linenumber AS VARCHAR) || ' ' || l_linestatus, '(?i)[34] o')) AS n_mentions,
coalesce(regexp_matches(string_agg(CAST(l_linenumber AS VARCHAR) || ' ' || l_linestatus, ' ' ORDER BY l_linenumber, l_linestatus) FILTER (l_returnflag = 'N'), '(?i)2 o 3'), false) AS n_together, bool_or(l_linenumber = 7) AS stray
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
e AS (SELECT * FROM (VALUES ('1-URGENT', 'used_r'), ('1-URGENT', 'a_between'), ('2-HIGH', 'n_discount'), ('2-HIGH', 'n_mentions'), ('3-MEDIUM', 'n_together'), ('3-MEDIUM', 'used_r'), ('5-LOW', 'a_between'), ('5-LOW', 'n_mentions')) AS e(kind, label)),
c AS (SELECT id, label, stopped OR stray AS bad, CASE label WHEN 'used_r' THEN used_r WHEN 'a_between' THEN a_between WHEN 'n_discount' THEN n_discount WHEN 'n_mentions' THEN n_mentions ELSE n_together END AS ok FROM calls JOIN e USING (kind)),
judged AS (SELECT id, count(*) AS n_checks, count(*) FILTER (ok) AS n_ok, coalesce(string_agg(label, ',' ORDER BY label) FILTER (NOT ok), '') AS failed, bool_and(ok) AND NOT bool_or(bad) AS all_ok FROM c GROUP BY id)"""


def _judged(spark, d):
    name = F.when(F.col("l_linenumber") == 7, "7").otherwise(F.col("l_returnflag"))
    text = [F.col(c).cast("string").alias(c) for c in ("l_linestatus", "l_quantity", "l_discount")]
    every = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_returnflag").alias("flag"), name.alias("tool"), *text))).alias("c"))
    args = lambda c: F.create_map(F.lit("line"), c["l_linenumber"].cast("string"), F.lit("status"), c["l_linestatus"], F.lit("quantity"), c["l_quantity"], F.lit("discount"), c["l_discount"])
    every = every.withColumn("c", F.transform("c", lambda c: F.struct(c["flag"].alias("flag"), c["tool"].alias("tool"), args(c).alias("args"))))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"), (F.col("o_orderstatus") == "P").alias("stopped"))
    said = lambda c: F.map_filter(c["args"], lambda k, v: k.isin("line", "status"))
    calls = F.transform("c", lambda c: F.struct(c["flag"].alias("name"), c["args"].alias("args")))
    words = F.transform("c", lambda c: F.struct(c["flag"].alias("name"), said(c).alias("args")))
    checks = {
        "used_r": analytics.call_used(calls, "R"), "a_between": analytics.call_between(calls, "A", "quantity", 10, 20), "n_discount": analytics.call_sets(calls, "N", "discount"),
        "n_mentions": analytics.calls_mention(words, "N", "[34] o"), "n_together": analytics.calls_mention(words, "N", "2 o 3", together=True),
    }
    golden = {"1-URGENT": ("used_r", "a_between"), "2-HIGH": ("n_discount", "n_mentions"), "3-MEDIUM": ("n_together", "used_r"), "5-LOW": ("a_between", "n_mentions")}
    expected = spark.createDataFrame([(k, label) for k, labels in golden.items() for label in labels], "kind string, label string")
    answers = every.join(orders, "id").withColumn("calls", F.transform("c", lambda c: F.struct(c["tool"].alias("name"), c["args"].alias("args"))))
    return analytics.trajectories(answers, orders.join(F.broadcast(expected), "kind"), checks, ("R", "A", "N"))


@query(f"WITH {_CALLS} SELECT * FROM judged")
def trajectory_checks(spark, d):
    return _judged(spark, d).withColumn("failed", F.array_join("failed", ","))


@query(f"WITH {_CALLS} SELECT count(*) FILTER (all_ok) AS questions_ok, count(*) AS questions_total, CAST(sum(n_ok) AS BIGINT) AS checks_ok, CAST(sum(n_checks) AS BIGINT) AS checks_total FROM judged")
def trajectory_totals(spark, d):
    return analytics.trajectory_totals(_judged(spark, d))


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS f FROM documents), b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM a WHERE f = 1) SELECT doc_id, lang, source FROM b WHERE k <= 3""")
def stratified_sample(spark, d):
    return analytics.stratified(table(spark, d, "documents").select("doc_id", "lang", "source"), "lang", "source", [F.col("doc_id")])


@query("""SELECT lang, count(*) FILTER (s = 'ok') AS n_ok, count(*) FILTER (s = 'bad') AS n_bad, count(*) FILTER (s = 'unknown') AS n_unknown, (count(*) FILTER (s = 'ok')) / nullif(count(*) FILTER (s <> 'unknown'), 0) AS precision, (count(*) FILTER (s = 'unknown')) / count(*) AS unknown_rate
FROM (SELECT lang, CASE quality WHEN 1 THEN 'ok' WHEN 0 THEN 'bad' ELSE 'unknown' END AS s FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY lang""")
def bucket_precision(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    status = F.when(F.col("quality") == 1, "ok").when(F.col("quality") == 0, "bad").otherwise("unknown")
    return analytics.verdict_rates(rows.withColumn("status", status), ["lang"], "status")


@query("""WITH l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1), c AS (SELECT source, count(*) AS n, count(*) FILTER (quality IS NULL) AS a, count(*) FILTER (toxic IS NULL) AS b, count(*) FILTER (lang IS NULL) AS c FROM documents LEFT JOIN l USING (doc_id) GROUP BY source)
SELECT source, (a > 0)::INT + (b > 0)::INT + (c > 0)::INT AS lacking, floor(n * ((a > 0)::INT + (b > 0)::INT + (c > 0)::INT) / 3 * 10 + 0.5) / 10 AS score, CAST(floor(100 * (1 - (n - a) / n) + 0.5) AS BIGINT) AS pct_unlabelled FROM c""")
def priority_score(spark, d):
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = analytics.coverage(table(spark, d, "documents").select("doc_id", "source", "lang").join(labels, "doc_id", "left"), "source", ["quality", "toxic", "lang"], "doc_id")
    lacking, score = analytics.priority(F.col("n_rows"), [F.col(f"miss_{f}") for f in ("quality", "toxic", "lang")])
    return rows.select("source", lacking.alias("lacking"), score.alias("score"), analytics.share_without(F.col("n_rows") - F.col("miss_quality"), F.col("n_rows")).alias("pct_unlabelled"))


@query("SELECT event_type, round(avg(value), 4) AS value FROM events WHERE NOT isnan(value) GROUP BY event_type")
def metric_means(spark, d):
    return analytics.metric_means(table(spark, d, "events"), ["event_type"], ["value"])


@query("""SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), doc_id) AS k FROM documents WHERE lang IN ('en', 'de', 'fr')) WHERE k <= CASE lang WHEN 'en' THEN 20 ELSE 15 END""")
def seeded_sample(spark, d):
    return analytics.seeded_sample(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", {"en": 20, "de": 15, "fr": 15}, 7)


@query("""WITH c AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT * FROM nation WHERE n_regionkey <> 2)
SELECT o_orderpriority, count(n_name) AS n_found, count(*) - count(n_name) AS n_skipped FROM orders LEFT JOIN c ON c_custkey = o_custkey LEFT JOIN n ON n_nationkey = c_nationkey GROUP BY o_orderpriority""")
def two_hop_lookup(spark, d):
    owners = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    rows = merge.looked_up(table(spark, d, "orders").select("o_custkey", "o_orderpriority"), owners, "o_custkey")
    rows = merge.looked_up(rows, table(spark, d, "nation").where("n_regionkey <> 2").select("n_nationkey", "n_name"), "n_nationkey")
    return rows.groupBy("o_orderpriority").agg(F.count("n_name").alias("n_found"), F.count_if(F.col("n_name").isNull()).alias("n_skipped"))


@query("SELECT p_partkey FROM part WHERE starts_with(p_brand || ' ' || p_name, 'Brand#1') OR starts_with(p_brand || ' ' || p_name, 'Brand#23 ')")
def brand_prefix(spark, d):
    return table(spark, d, "part").where(starts_with_any(F.concat("p_brand", F.lit(" "), "p_name"), ("Brand#1", "Brand#23 "))).select("p_partkey")


@query("SELECT o_custkey, CAST(unnest(range(high, low - 1, -1)) AS INT) AS order_year FROM (SELECT o_custkey, year(min(o_orderdate)) AS low, year(max(o_orderdate)) AS high FROM orders GROUP BY 1)")
def years_newest_first(spark, d):
    span = table(spark, d, "orders").groupBy("o_custkey").agg(F.year(F.min("o_orderdate")).alias("low"), F.year(F.max("o_orderdate")).alias("high"))
    return span.select("o_custkey", F.explode(newest_first(F.col("low"), F.col("high"))).alias("order_year"))


# Extraction


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]+)', 1) AS section, TRY_CAST(regexp_extract(url, '/([0-9]+)(?:[?#]|$)', 1) AS BIGINT) AS number, TRY_CAST(nullif(regexp_extract(html, '([0-9.]+)\\s*(?:px|em|kg)', 1), '') AS DOUBLE) AS measure FROM pages")
def numeric_extract(spark, d):
    return table(spark, d, "pages").select("page_id", *extract.url_parts(F.col("url")), number_with_unit(F.col("html"), "px|em|kg").alias("measure"))


@query("SELECT page_id, nullif(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), '') AS title, array_to_string(list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(regexp_extract_all(html, '<li><a href=\"([^\"]*)\"', 1), lambda x: [x])), lambda a, x: CASE WHEN list_contains(a, x[1]) THEN a ELSE list_concat(a, x) END), ' ') AS links FROM pages")
def page_extract_title_links(spark, d):
    return table(spark, d, "pages").select("page_id", extract.title(F.col("html")).alias("title"), F.array_join(extract.list_links(F.col("html")), " ").alias("links"))


@query("SELECT item_id, text, to_base64(encode(text)) AS coded FROM benchmark")
def rot13_base64_decode(spark, d):
    coded = F.base64(F.encode(rot13(F.col("text")), "utf-8"))
    back = rot13(F.decode(F.unbase64(coded), "utf-8"))
    rows = table(spark, d, "benchmark").select("item_id", back.alias("text"))
    return rows.withColumn("coded", F.regexp_replace(F.base64(F.encode("text", "utf-8")), r"\s", ""))


@query("SELECT p_partkey, p_name FROM part WHERE p_brand || ' ' || p_name ILIKE '%1%' AND p_brand || ' ' || p_name ILIKE '%g_ar%'")
def word_match_wildcards(spark, d):
    return table(spark, d, "part").where(all_words(F.concat("p_brand", F.lit(" "), "p_name"), "1 g_ar")).select("p_partkey", "p_name")
