"""Requests, stems, cover density, BM25 and cells of vectors against plain programmes."""

import itertools
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import stem
from tessella.operators import bm25, cells, fulltext, search
from tessella.plans import catalogue, retrieval  # noqa: F401  retrieval adds its queries

SF = "/root/testdata/sf0.01"
# Words and their published stems.
STEMS = dict(zip(*[iter("""consign consign consigned consign consistency consist consolatory consolatori console consol constance constanc knackeries knackeri kneaded knead
knightly knight knitting knit knives knive brakes brake braking brake problems problem breakdowns breakdown reliability reliabl issues issu generously generous communism
communism hopping hop hoping hope happy happi say say cries cri ties tie gas gas gaps gap this this fizzed fizz relational relat conditional condit vietnamization vietnam
skies sky dying die news news innings inning proceeding proceed agreed agre feed feed sized size controlling control analogies analog adjustment adjust adoption adopt
electricity electr decisiveness decis roll roll bled bled at at""".split())] * 2))


def test_stems_of_known_words():
    assert {w: stem.stem(w) for w in STEMS} == STEMS


def test_the_stemmer_and_its_sql_agree():
    rnd = random.Random(1)
    endings = "s es ed ing ly ation ational ness ful ize izer al ive y e ll ion ement li ogi ic ical ative eed ies".split() + [""] * 5
    words = {"".join(rnd.choice("abcdeiouystlnäß7") for _ in range(rnd.randrange(1, 6))) + rnd.choice(endings) + rnd.choice(endings) for _ in range(8000)} | {*STEMS, *stem.OWN_STEMS}
    con = duckdb.connect()
    con.execute("CREATE TABLE words AS SELECT unnest(?) AS w", [sorted(words)])
    assert dict(con.execute(f"WITH {stem.stems_sql('words')} SELECT w, stem FROM stems").fetchall()) == {w: stem.stem(w) for w in words}


def test_requests_become_clauses():
    word = lambda *t: (False, tuple(t))
    assert fulltext.parse('brake noise or "known issues" -Engines') == ((word(("brake", 0)), word(("nois", 0))), (word(("known", 0), ("issu", 1)), (True, (("engin", 0),))))
    assert fulltext.parse('"cat of the hats"') == ((word(("cat", 0), ("hat", 3)),),)
    assert fulltext.parse("wi-fi") == ((word(("wi", 0), ("fi", 1)),),)
    assert fulltext.parse("the of and") == fulltext.parse("") == fulltext.parse("or OR - \"") == ()
    assert fulltext.parse("or brakes or") == ((word(("brake", 0)),),) and fulltext.parse('"unclosed word')[0][0][1] == (("unclos", 0), ("word", 1))


def brute_covers(clauses, found, n):
    """All intervals of places that fulfil a clause and hold no other such interval."""

    def holds(a, b):
        def has(terms):
            return any(all(s + d in found.get(t, ()) for t, d in terms) and a <= s and s + terms[-1][1] <= b for s in range(1, n + 1))

        return any(any(not x for x, _ in c) and all(has(t) for denied, t in c if not denied) for c in clauses)

    good = [(a, b) for a in range(1, n + 1) for b in range(a, n + 1) if holds(a, b)]
    return sorted(i for i in good if not any(o != i and i[0] <= o[0] and o[1] <= i[1] for o in good))


def test_covers_are_those_of_all_intervals():
    rnd = random.Random(7)
    for _ in range(400):
        text = [rnd.choice("abcdx") for _ in range(rnd.randrange(1, 14))]
        found = {t: [k for k, w in enumerate(text, 1) if w == t] for t in "abcd"}
        literal = lambda: (rnd.random() < 0.2, tuple((rnd.choice("abcd"), k) for k in range(rnd.choice([1, 1, 2]))))
        clauses = tuple(tuple(literal() for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(1, 3)))
        want = brute_covers(clauses, found, len(text))
        assert fulltext.covers(clauses, found) == want, (text, clauses)
        asked = {t for c in clauses for denied, terms in c if not denied for t, _ in terms}
        noise = [sum(text[k - 1] not in asked for k in range(a, b + 1)) for a, b in want]
        assert fulltext.density(clauses, found) == pytest.approx(sum(0.1 / (1 + x) for x in noise))


def test_searches_of_odd_rows(spark):
    rows = [(1, "The brakes are noisy. Braking is loud"), (2, "Known issue: none"), (3, None), (4, ""), (5, "noise of the brake, known ISSUES"), (6, "known good issues")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "id int, text string, term int")
    ask = lambda r: {x.id: x.rank for x in fulltext.search_texts(docs, r, 10, "id", "text").collect()}
    assert ask('"known issues"') == {2: 1, 5: 2}
    assert set(ask("brake")) == {1, 5} and ask("brake")[1] == 1  # twice in the first
    assert set(ask("brake -noise")) == {1} and set(ask("-brake")) == {2, 3, 4, 6}
    assert set(ask("brakes known or good")) == {5, 6}
    assert set(ask("noisy issues")) == {1, 2, 5, 6}  # no row has both stems, so any will do
    assert ask("the of") == ask("") == {} and set(ask('brake "good issues"')) == {1, 5}  # quotes go on over the or between pieces
    requests = spark.createDataFrame([(1, None), (2, "brake"), (3, "zebra")], "query int, request string")
    assert {(r.query, r.id) for r in fulltext.matches(fulltext.index(docs, "id", "text"), requests).where("level = 0").collect()} == {(2, 1), (2, 5)}
    assert fulltext.matches(fulltext.index(docs.limit(0), "id", "text"), requests).count() == 0


def test_lists_in_blocks_equal_a_full_scan(spark, tmp_path):
    rnd = random.Random(3)
    topics = [[f"w{t}x{k}" for k in range(30)] for t in range(12)]
    rows = [(k, " ".join(rnd.choice(topics[k % 12] if rnd.random() < 0.9 else rnd.choice(topics)) for _ in range(rnd.randrange(1, 60)))) for k in range(1500)]
    rows += [(2000, None), (2001, "the of"), (2002, rows[5][1])]
    docs, asked = spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame([(1, " ".join(topics[3][:4])), (2, "w1x1"), (3, None), (4, "nowhere"), (5, rows[5][1])], "q long, text string")
    bm25.build(docs, "id", "text", str(tmp_path / "lists"), block_rows=16)
    found, report = bm25.topk(spark.read.parquet(str(tmp_path / "lists")), asked, 7, "q", "text", seeds=6)
    con = duckdb.connect()
    con.register("docs", docs.toPandas())
    con.register("asked", asked.toPandas())
    want = con.execute(bm25.topk_sql(("docs", "id", "text"), ("asked", "q", "text"), 7)).fetchall()
    assert sorted(map(tuple, found.select("query", "id", "score", "rank").collect())) == sorted(want)
    assert {r[0] for r in want} == {1, 2, 5}
    told = {r.query: (r.blocks, r.blocks_read) for r in report.collect()}
    assert all(read <= n for n, read in told.values()) and sum(r for _, r in told.values()) < 0.8 * sum(n for n, _ in told.values())
    assert {r.id for r in found.where("query = 5 and rank <= 2").collect()} == {5, 2002}


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16))
    rows = [(k, (centres[k % 20] + 0.3 * rng.normal(size=16)).tolist(), k % 7) for k in range(2000)] + [(3000 + k, [1.0] * 16, 3) for k in range(1200)]
    rows += [(9000, None, 1), (9001, [0.0] * 16, 1)]
    return spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, cell int").repartition(6)


def test_cells_find_the_nearest(spark, clustered, tmp_path, monkeypatch):
    monkeypatch.setattr(cells, "CHUNK", 100)
    centroids = cells.train(clustered, "embedding", 24)
    cells.build(clustered, centroids, "embedding", str(tmp_path / "cells"))
    indexed = spark.read.parquet(str(tmp_path / "cells"))
    assert indexed.count() == 3200 and set(indexed.columns) == {"vec_id", "embedding", "label", "cell", "angle"}
    asked = clustered.where("vec_id % 100 = 0 or vec_id >= 9000")
    true = {(r.query_id, r.id, r["rank"]) for r in search.dense_topk(clustered, asked, 10).collect()}
    found, read = cells.nearest(indexed, asked, centroids, 10, probes=2, exact=True)
    assert {(r.query_id, r.id, r["rank"]) for r in found.collect()} == true
    assert read.agg(F.avg("cells_read")).first()[0] < len(centroids)
    quick, few = cells.nearest(indexed, asked, centroids, 10, probes=cells.probes_for(indexed, centroids, 10))
    near = {(r.query_id, r.id) for r in quick.collect()}
    assert len(near & {t[:2] for t in true}) >= 0.9 * len(true) and few.agg(F.max("cells_read")).first()[0] < len(centroids)
    filtered, _ = cells.nearest(indexed.where("label = 5"), asked, centroids, 10, probes=1)
    assert {r[1] for r in filtered.groupBy("query_id").count().collect()} == {10}
    want = {(r.query_id, r.id) for r in search.dense_topk(clustered.where("label = 5"), asked, 10).collect()}
    exact, _ = cells.nearest(indexed.where("label = 5"), asked, centroids, 10, probes=1, exact=True)
    assert {(r.query_id, r.id) for r in exact.collect()} == want


def test_cells_of_no_rows(spark, clustered, tmp_path):
    none = clustered.limit(0)
    centroids = cells.train(none, "embedding")
    assert len(centroids) == 0
    cells.build(none, centroids, "embedding", str(tmp_path / "none"))
    assert cells.nearest(spark.read.parquet(str(tmp_path / "none")), clustered.limit(3), centroids, 5)[0].count() == 0


@pytest.mark.parametrize("name", ["search_requests", "search_ranked", "bm25_topk", "vector_cells_exact", "vector_cells_filtered", "vector_cells_recall"])
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    found = catalogue.QUERIES[name](spark, SF).select(*columns).collect()
    near = lambda rows: sorted(tuple(round(x, 4) if isinstance(x, float) else x for x in r) for r in rows)
    assert near(found) == near(want.fetchall())


def test_requests_of_the_query_show_every_form(spark):
    found = fulltext.matches(fulltext.index(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text"), retrieval._requests(spark))
    levels = {r[0]: r[1] for r in found.groupBy("query").agg(F.min("level")).collect()}
    assert set(levels.values()) == {0, 1} and set(retrieval.REQUESTS) - set(levels) == {4}  # stop words alone match nothing
    assert any(re.search('"', r) for r in retrieval.REQUESTS.values()) and len(list(itertools.chain(retrieval.REQUESTS))) == 10


def test_rounding_is_that_of_python(spark):
    from tessella.functions.text import round_exact

    rnd = random.Random(2)
    pairs = [(a, b) for a in range(51) for b in range(51)]
    ranks = spark.createDataFrame(pairs, "a int, b int")
    first = ranks.withColumn("x", round_exact(1.0 / (F.col("a") + 60), 5)).withColumn("y", round_exact(F.col("x") + 1.0 / (F.col("b") + 60), 5))
    for r in first.collect():
        x = round(1.0 / (60 + r.a), 5)
        assert (r.x, r.y) == (x, round(x + 1.0 / (60 + r.b), 5)), (r.a, r.b)
    values = [rnd.uniform(-8, 8) for _ in range(500)] + [rnd.uniform(-1, 1) * 10 ** -rnd.randrange(3, 30) for _ in range(300)] + [k / 64 for k in range(-512, 512)] + [0.0, 2.5e-5, 5e-6, 1.5e-5, 2.675]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", *[round_exact(F.col("v"), d).alias(f"r{d}") for d in (0, 2, 5, 9)]).collect()
    for r in got:
        assert [r.r0, r.r2, r.r5, r.r9] == ([round(r.v, d) for d in (0, 2, 5, 9)] if abs(r.v) < 8 else [None] * 4), r.v


def test_a_posting_is_never_a_stored_row_and_blocks_are_whole(spark, tmp_path, monkeypatch):
    rnd, sizes, plain = random.Random(9), {}, bm25._stored

    def counted(df, name):
        out = plain(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(bm25, "_stored", counted)
    rows = [(f"d{k}", " ".join(f"w{rnd.randrange(40)}" for _ in range(30)) + " everywhere") for k in range(700)]
    docs = spark.createDataFrame(rows, "id string, text string").repartition(3)
    bm25.build(docs, "id", "text", str(tmp_path / "lists"), block_rows=8)
    assert sizes and max(sizes.values()) <= len(rows)
    lists = spark.read.parquet(str(tmp_path / "lists"))
    blocks = lists.where("term = 'everywher'").agg(F.sum("n"), F.max("n"), F.count("*"), F.countDistinct("block")).first()
    assert blocks[0] == len(rows) and blocks[1] == 8 and blocks[2] == blocks[3]
    monkeypatch.setattr(bm25, "PAIRS", 2)  # requests go out in several parts
    asked = spark.createDataFrame([("a", "everywhere"), ("b", "w1 w2 w3"), ("c", "w4 everywhere")], "q string, text string")
    found, _ = bm25.topk(lists, asked, 9, "q", "text", seeds=2)
    con = duckdb.connect()
    con.register("docs", docs.toPandas())
    con.register("asked", asked.toPandas())
    want = con.execute(bm25.topk_sql(("docs", "id", "text"), ("asked", "q", "text"), 9)).fetchall()
    assert sorted(map(tuple, found.select("query", "id", "score", "rank").collect())) == sorted(want) and len(want) == 27


def test_what_a_task_holds_does_not_grow_with_queries_cells_or_rows():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    rows = rng.integers(-2, 3, size=(3000, 8)).astype(np.float32)  # many ties
    rows[0] = 0
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(3000)), pa.array(list(rows), pa.list_(pa.float32()))], names=["id", "v"])
    queries = rng.normal(size=(4096, 8))
    tracemalloc.start()
    found = list(search._best_of_partition(iter([batch.slice(0, 5), batch.slice(5)]), np.arange(4096), queries, 5))
    assert tracemalloc.get_traced_memory()[1] < 60e6  # all distances of 2048 rows at once are 67 MB alone
    tracemalloc.stop()
    got = {}
    for part in found:
        for query, id_, distance in zip(*(c.to_pylist() for c in part.columns)):
            got.setdefault(query, []).append((distance, id_))
    units = rows[1:].astype(float) / np.linalg.norm(rows[1:].astype(float), axis=1)[:, None]
    for q in range(0, 4096, 97):
        want = sorted(zip((1.0 - units @ queries[q]).round(9), range(1, 3000)))[:5]
        assert [d for d, _ in want] == [round(d, 9) for d, _ in sorted(got[q])] and len(got[q]) == 5


def test_what_is_judged_does_not_become_objects_all_at_once():
    import tracemalloc

    import pyarrow as pa

    hits = [{"term": t, "at": list(range(1, 400))} for t in ("ing", "er")]
    kinds = [pa.int32(), pa.int64(), pa.string(), pa.list_(pa.struct([("term", pa.string()), ("at", pa.list_(pa.int32()))]))]
    columns = [[1] * 2000, list(range(2000)), ['"ing er"'] * 2000, [hits] * 2000]
    batch = pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=["query", "id", "request", "hits"])
    tracemalloc.start()
    found = list(fulltext._judged(iter([batch])))
    assert tracemalloc.get_traced_memory()[1] < 5e6 and sum(b.num_rows for b in found) == 4000  # 1.6 million places as objects are over 12 MB
    tracemalloc.stop()
