"""Operators on small rows: nulls, ties, repeated rows, and rules restated in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import analytics, filters, matching, merge, search
from tessella.plans import requests

TABLE = filters.SpecTable("id", "brand", ("category", "other"), ("year", "hp", "kg"), "year", power="hp", weight="kg")
ROWS = [
    (1, "Moto-Alpha", "Naked bike", None, 2001, 47.0, 180.0), (2, "moto alpha", "Sport", "naked BIKE", 2005, 60.0, None), (3, "Beta", None, "Touring", None, 120.0, 220.0),
    (4, None, "Naked bike", None, 2003, None, 150.0), (5, "Beta", "Scooter", "", 0, 30.0, 0.0),
]


@pytest.fixture(scope="module")
def specs(spark):
    return spark.createDataFrame(ROWS, "id int, brand string, category string, other string, year int, hp double, kg double")


def ids(df):
    return [r.id for r in df.collect()]


def test_filters(specs):
    ask = lambda **k: ids(filters.spec_filter(specs, filters.SpecFilter(**k), TABLE))
    assert ask(brand="MOTO alpha!") == [2, 1]
    assert ask(category="naked-bike") == [2, 4, 1]
    assert ask(brand="--") == [2, 1, 5, 3]  # punctuation alone matches every known brand
    assert ask(bounds={"year": (0, 2003)}) == [4, 1, 5] and ask(bounds={"year": (0, 0)}) == [5]
    assert ask(order_by="year") == [5, 1, 4, 2, 3] and ask(order_by="--hp", limit=2) == [3, 2]
    assert ask(order_by="nonsense", limit=0) == [2, 4, 1, 5, 3]
    assert ask(eligible_only=True) == [2, 1]  # unknown or zero weight: only as one to bridle
    assert filters.spec_filter(specs, filters.SpecFilter(count_only=True, limit=1), TABLE).first().matching == 5
    with pytest.raises(ValueError):
        ask(bounds={"brand": (1, 2)})


def test_category_rule(spark):
    rows = [("ATV", 900.0, False), (" scooter ", 125.0, False), ("Scooter", None, False), ("Scooter", 500.0, True), ("Minibike", 50.0, True), ("Prototype", None, True)]
    df = spark.createDataFrame(rows, "c string, s double, want boolean")
    assert df.where(filters.category_included(F.col("c"), F.col("s"), "atv", "scooter", 500) != F.col("want")).count() == 0


def test_text_functions(spark):
    one = spark.createDataFrame([("745 ccm, 1.2.3 kg, 57.8 HP", "20230230", "20240229", "Moto Guzzi V7", "CB1000R 5Four")], "a string, b string, c string, d string, e string")
    got = one.select(
        text.number_with_unit(F.col("a"), "ccm"), text.number_with_unit(F.col("a"), "kg"), text.number_with_unit(F.col("a"), "mm"), text.date_or_null(F.col("b")), text.date_or_null(F.col("c")).cast("string"),
        *text.split_first(F.col("d")), text.tokens(F.col("e")), text.rot13(F.lit("Uryyb")), text.half_up(F.lit(2.5)), text.digits(F.lit("5&nbsp;700 €")),
    ).first()
    assert list(got) == [745.0, None, None, None, "2024-02-29", "Moto", "Guzzi V7", ["cb", "1000", "r", "5", "four"], "Hello", 3, 5700]
    assert spark.range(1).select(text.all_words(F.lit("GSX R"), "gsx_r"), text.all_words(F.lit("x"), "")).first()[:] == (True, True)


def matched_by_hand(source, rows, offsets):
    out = set()
    for sid, r, year in source:
        short = [t for t in r if not (t.isdigit() and int(t) >= 50)]
        found = []
        for dy in offsets:
            here = [(k, set(t)) for k, t, y in rows if y == year + dy]
            for asked in (r, short):
                fits = [(len(t - set(asked)), k) for k, t in here if asked and set(asked) <= t]
                if fits and not found:
                    found = [k for n, k in fits if n == min(fits)[0]]
            fits = [(len(t), k) for k, t in here if len(t) >= 3 and t <= set(r)]
            if fits and not found:
                found = [k for n, k in fits if n == max(fits)[0]]
            if found:
                break
        out |= {(sid, k) for k in found}
    return out


def test_matching_restated(spark):
    rng = random.Random(3)
    names = ["cb", "r", "gs", "600", "1200", "7", "rally", "pro", "x"]
    rows = [(k, rng.choices(names, k=rng.randint(1, 5)), rng.randint(2000, 2004)) for k in range(150)]
    source = [(k, rng.choices(names, k=rng.randint(0, 5)), rng.randint(1999, 2005)) for k in range(200)]
    s = spark.createDataFrame(source, "source_id int, source_tokens array<string>, source_year int")
    r = spark.createDataFrame(rows, "row_id int, row_tokens array<string>, row_year int")
    for offsets in ((0, -1, 1), (0, -1, -2, -3, 1)):
        got = matching.match_by_tokens(s, r, offsets).collect()
        assert {(m.source_id, m.row_id) for m in got} == matched_by_hand(source, rows, offsets) and len(got) == len({(m.source_id, m.row_id) for m in got})
        assert {m.pass_no for m in got} == {1, 2, 3}
    assert matching.match_by_tokens(s.limit(0), r).count() == matching.match_by_tokens(s, r.limit(0)).count() == 0


def test_matches_of_copies_meet_once(spark, tmp_path):
    spark.range(600).selectExpr("id AS source_id", "array(concat('n', id % 3), 'cb') AS source_tokens", "cast(2000 + id % 2 AS int) AS source_year").write.parquet(f"{tmp_path}/s")
    spark.range(900).selectExpr("id AS row_id", "array('cb', concat('n', id % 3), concat('v', id % 5)) AS row_tokens", "cast(2000 + id % 2 AS int) AS row_year", "if(id % 3 = 0, 'a', concat('p', id % 5)) AS kind").write.parquet(f"{tmp_path}/r")
    s, r = spark.read.parquet(f"{tmp_path}/s"), spark.read.parquet(f"{tmp_path}/r")
    matches = matching.match_by_tokens(s, r)
    assert "Broadcast" not in matches._jdf.queryExecution().executedPlan().toString()  # long tables of few columns look small
    assert matches.count() == 600 * 150  # by name and year
    one = sorted(map(tuple, matching.match_unambiguous(s, r, "kind").collect()))
    assert one == sorted(map(tuple, matching.unambiguous(matches.join(r.select("row_id", "kind"), "row_id"), "kind").collect())) == [(k, "a") for k in range(0, 600, 3)]


def test_merges(spark):
    old = spark.createDataFrame([(1, 5, "a"), (None, 1, "n")], "k int, v int, w string")
    new = spark.createDataFrame([(1, 3, None), (2, 9, "b"), (None, 2, "m")], "k int, v int, w string")
    got = {r.k: (r.v, r.w) for r in merge.upsert(old, new, ["k"], {"v": "least", "w": "fill"}).collect()}
    assert got == {1: (3, "a"), 2: (9, "b"), None: (1, "m")}
    again = merge.upsert(merge.upsert(old, new, ["k"], {"v": "new", "w": "keep"}), new, ["k"], {"v": "new", "w": "keep"})
    assert {r.k: (r.v, r.w) for r in again.collect()} == {1: (3, "a"), 2: (9, "b"), None: (2, "n")}
    fresh = spark.createDataFrame([(1, 0, "x"), (None, 1, "y"), (None, 2, "z"), (7, 3, "p"), (7, 4, "q")], "k int, at int, w string")
    names = lambda safe: sorted(r.w for r in merge.insert_absent(old, fresh, ["k"], [F.col("at")], safe).collect())
    assert names(True) == ["p"] and names(False) == ["p", "y"]
    updates = spark.createDataFrame([(1, 0, "", 5), (1, 1, "x", 0), (1, 2, None, None)], "k int, at int, s string, n int")
    assert merge.last_writer(updates, ["k"], ["s", "n"], F.col("at")).first()[:] == (1, "x", 5)


def test_common_name(spark):
    rows = [("a", "FLHR Road King", 1), ("a", "Road King Special", 2), ("b", "CB 250", 1), ("b", "XL", 2), ("b", "XL", 3), ("c", "x x y", 1), ("c", None, 0)]
    got = analytics.common_name(spark.createDataFrame(rows, "g string, n string, at int"), "g", "n", F.col("at"))
    assert {r.g: r.display_name for r in got.collect()} == {"a": "Road King", "b": "XL", "c": "x x y"}


def test_dense_search_blocks_and_ties(spark):
    rows = spark.createDataFrame([(k, [float(k % 3), 1.0]) for k in range(30)] + [(100, None), (101, [0.0, 0.0])], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(0, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [0.0, 0.0]), (3, None)], "vec_id long, embedding array<float>")
    for block in (1, 4096):
        got = search.dense_topk(rows, asked, 4, block=block)
        assert {(r.query_id, r["rank"], r.id) for r in got.collect()} == {(q, n + 1, q + 3 * n) for q in (0, 1) for n in range(4)}
    assert search.dense_topk(rows.limit(0), asked, 4).count() == search.dense_topk(rows, asked.limit(0), 4).count() == 0


def test_sparse_fallback_and_fusion(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a a"), (3, "B"), (4, None), (5, "")], "id int, t string")
    assert [r.id for r in search.sparse_topk(docs, ["a", "b"], 9, "id", "t").collect()] == [1]
    assert [r.id for r in search.sparse_topk(docs.where("id <> 1"), ["a", "b"], 9, "id", "t").collect()] == [2, 3]
    a = spark.createDataFrame([(1, 1, 0.1), (2, 2, 0.2)], "id int, rank int, distance double")
    b = spark.createDataFrame([(2, 1), (3, 2)], "id int, rank int")
    got = {r.id: (r.distance, r.rrf) for r in search.rrf(a, b, ["id"]).collect()}
    assert got == {1: (0.1, 1 / 60), 2: (0.2, 1 / 61 + 1 / 60), 3: (None, 1 / 61)}
    assert search.fetch_size(5, True) == 30 and search.fetch_size(1, True) == 20 and search.fetch_size(20, True) == 50 and search.fetch_size(5, False) == 15


def test_embedder_hook(spark):
    embed = search.hashing_embedder(16)
    got = spark.createDataFrame([("a b",), ("a b",), (None,)], "t string").select(embed("t").alias("v")).collect()
    assert got[0].v == got[1].v and len(got[0].v) == 16 and sum(x * x for x in got[0].v) == pytest.approx(1) and not any(got[2].v)


def test_checks_on_calls(spark):
    calls = [{"name": "find", "args": {"model": "Bandit 1200", "limit": "5"}}, {"name": "find", "args": {"model": "CBR"}}]
    df = spark.createDataFrame([(calls,)], "calls array<struct<name:string,args:map<string,string>>>")
    c = F.col("calls")
    got = df.select(analytics.call_between(c, "find", "limit", 1, 5), analytics.calls_mention(c, "find", "bandit.*cbr"), analytics.calls_mention(c, "find", "bandit.*cbr", together=True), analytics.calls_mention(c, "look", "bandit")).first()
    assert list(got) == [True, False, True, False]


def test_requests(spark):
    tool = requests.Tool(lambda model, brand=None: spark.createDataFrame([(model, brand)], "m string, b string"), ("model", "brand"), ("model",), {"model": lambda a: f"all of {a.get('brand')}"})
    df, notes = requests.run_tool({"look": tool}, "look", {"bike": "V7", "min_year": 3})
    assert df.first()[:] == ("V7", None) and len(notes) == 2  # one renamed, one unknown
    df, notes = requests.run_tool({"look": tool}, "look", {"brands": "Beta"})
    assert df.first()[:] == ("all of Beta", "Beta") and len(notes) == 2  # one renamed, one filled in
    df, notes = requests.run_tool({"look": tool}, "look", {"bike": "V7", "model": "V9"})
    assert df.first()[:] == ("V9", None) and len(notes) == 1  # an argument's own name goes before another one
    with pytest.raises(requests.RequestError):
        requests.run_tool({"look": tool}, "find", {})


def test_detail_context_is_bounded(spark):
    rows = spark.createDataFrame([("a", k, k % 7) for k in range(50)] + [(None, 3, 1)], "g string, at int, w int")
    got = {r.g: r for r in filters.detail_context(rows, ["g"], [F.col("at")], F.struct("w", "at"), 3).collect()}
    assert [x.at for x in got["a"].latest] == [49, 48, 47] and got["a"].n_rows == 50 and got["a"].best.at == 48 and got[None].n_rows == 1


def test_containment_restated(spark):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abc1") for _ in range(rng.randint(0, n)))
    parts, wholes = [(rng.randint(0, 2), text(5)) for _ in range(80)] + [(None, "a"), (0, None)], [(rng.randint(0, 2), text(9)) for _ in range(80)] + [(None, "a"), (0, None)]
    p, w = spark.createDataFrame(parts, "k int, part string"), spark.createDataFrame(wholes, "k int, whole string")
    want = {(k, a, b) for k, a in parts for j, b in wholes if k is not None and k == j and a and b is not None and a in b}
    got = matching.contained(p, w, ["k"]).collect()
    assert set(map(tuple, got)) == want and len(got) == len(want) > 20

    source = [(n, rng.randint(0, 2), text(9), rng.choice([None, 1990, 1995, 2000])) for n in range(120)]
    rows = [(n, rng.randint(0, 2), [text(3) for _ in range(rng.randint(0, 2))], rng.choice([None, 1989, 1996]), rng.choice([None, 1991, 1999])) for n in range(60)]
    s = spark.createDataFrame(source, "source_id int, brand_key int, name_key string, year int")
    r = spark.createDataFrame(rows, "row_id int, brand_key int, row_words array<string>, low int, high int")
    found = {(i, j) for i, b, name, y in source for j, c, ws, lo, hi in rows if b == c and any(ws) and all(x in name for x in ws) and (y is None or (lo is not None and hi is not None and lo - 1 <= y <= hi + 1))}
    got = matching.interval_match(s, r).collect()
    assert {(m.source_id, m.row_id) for m in got} == found and len(got) == len(found) > 20

    mentions, names = [(n, text(6), rng.choice([None, 1, 2])) for n in range(60)], [(n, text(8), rng.choice([None, 1, 2])) for n in range(60)]
    want = set()
    for n, m, k in mentions:
        fits = [(abs(len(x) - len(m)), i) for i, x, j in names if m and x and (k is None or k == j) and (m in x or x in m)]
        want |= {(n, i) for away, i in fits if away == min(fits)[0]}
    got = matching.closest_length(spark.createDataFrame(mentions, "mention_id int, mention string, y int"), spark.createDataFrame(names, "name_id int, name string, y int"), "y").collect()
    assert {(m.mention_id, m.name_id) for m in got} == want and len(got) == len(want) > 20


def test_quantiles_restated(spark):
    import numpy as np

    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2, None]), rng.choice([None, 1.0, 2.0, 7.5, 1000.0]), rng.choice([None, None, 5.0, 9.0])) for _ in range(200)] + [("c", 1, 1.0, None)] * 2 + [("d", 1, None, None)] * 3
    df = spark.createDataFrame(rows, "o string, i int, v double, e double")
    cells = {}
    for o, i, v, e in rows:
        if i is not None:
            for key in ((o, i, 0), (o, None, 1)):
                cells.setdefault(key, []).append((v, e))
    cut = lambda xs, q: int(np.quantile([x for x in xs if x is not None], q)) if any(x is not None for x in xs) else None
    want = {k: (len(c), *(cut([v for v, _ in c], q) for q in (0.25, 0.5, 0.75)), cut([e for _, e in c], 0.5)) for k, c in cells.items() if len(c) >= 3}
    got = {(r.o, r.i, r.level): (r.n, r.p25, r.median, r.p75, r.median_extra) for r in analytics.quantile_cells(df, "o", "i", "v", "e").collect()}
    assert got == want


def test_quantiles_that_are_whole_numbers_are_not_cut_below(spark):
    import duckdb

    values = [1.0, 2.0, 1365.6, 1375.1999999999998]
    df = spark.createDataFrame([("a", 1, v, v) for v in values], "o string, i int, v double, e double")
    want = duckdb.execute("SELECT CAST(trunc(quantile_cont(v, 0.75)) AS BIGINT) FROM unnest(?) t(v)", [values]).fetchall()[0][0]
    assert {r.p75 for r in analytics.quantile_cells(df, "o", "i", "v", "e").collect()} == {want} == {1368}


def test_truthy_arguments_and_used_calls(spark):
    calls = [{"name": "find", "args": {"a": "0", "b": "True", "c": " ", "d": "none"}}]
    df = spark.createDataFrame([(calls,), ([],)], "calls array<struct<name:string,args:map<string,string>>>")
    c = F.col("calls")
    got = df.select(*[F.coalesce(analytics.call_sets(c, "find", k), F.lit(False)) for k in "abcde"], analytics.call_used(c, "find"), analytics.call_used(c, "look")).collect()
    assert [list(r) for r in got] == [[False, True, False, False, False, True, False], [False] * 7]


def test_answered_pages_are_done(spark):
    attempts = spark.createDataFrame([("a", None), ("a", 404), ("b", None), ("c", 200)], "url string, status int")
    assert sorted(r.url for r in merge.answered(attempts, "url", "status").collect()) == ["a", "c"]
