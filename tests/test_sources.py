"""Readers, sinks, extraction from written pages, and incremental ingest."""

import base64
import codecs
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessella.operators import merge
from tessella.sources import extract, readers
from tessella.streaming import buckets, ingest

THREAD = """<p>forum</p><table class="menu"><tr><td>a form</td></tr></table><table id="t" class="wide Grid">
<tr><td>Chain noise when cold</td></tr>
<tr><td><b>Ida</b>&nbsp;said 2019-11-02 08:15</td></tr><tr><td><script>var s = "<b>no</b>";</script></td></tr><tr><td><p> &nbsp; </p></td></tr><tr><td>Mine too,<br>since &#128640; spring</td></tr>
<tr><td><b>Jon</b> said 2019-11-03</td></tr><tr><td>&lt;&lt; Previous 1 2</td></tr><tr><td>a footer</td></tr>
<tr><td><b>Kim said so</b> said 2019-12-01</td></tr><tr><td><ins>buy</ins></td></tr><tr><td></td></tr><tr><td><ins>more</ins></td></tr><tr><td>too late</td></tr>
<tr><td><b>Lou</b> said 2020-01-01</td></tr><tr><td><b>Max</b> said 2020-01-02 23:59</td></tr><tr><td>He said 2 litres</td></tr></table>
<table class="Grid"><tr><td><b>Ned</b> said 2020-01-01</td></tr><tr><td>another table</td></tr></table>"""


def test_comments(spark):
    want = [("Ida", "2019-11-02 08:15", "Mine too, since \U0001f680 spring"), ("Max", "2020-01-02 23:59", "He said 2 litres")]
    assert extract.comments_of(THREAD) == want
    pages = spark.createDataFrame([(1, THREAD), (2, None), (3, "<p>")], "page_id long, html string")
    assert [tuple(r)[2:] for r in extract.extract_comments(pages, "page_id").orderBy("position").collect()] == want
    assert extract.message_head("Kim said so said 2019-12-01") == ("Kim said so", "2019-12-01") and extract.message_head("said 2019-12-01") is None and extract.message_head("a said tomorrow") is None


def test_forums_are_cut_to_their_newest_threads(spark):
    forums = spark.createDataFrame([("f", '<a href="m?t=3">c</a><a href="m?t=2">b</a><a href="m?t=3">c</a><a href="x">x</a><a href="m?t=1">a</a>'), ("g", None)], "url string, html string")
    pages = spark.createDataFrame([(f"m?t={k}", THREAD) for k in (1, 2, 3, 4)], "url string, html string")
    found = lambda most: sorted({(r.forum, r.thread_no, r.thread) for r in extract.forum_comments(forums, pages, "^m", most).collect()})
    assert found(2) == [("f", 0, "m?t=3"), ("f", 1, "m?t=2")] and len(found(None)) == 3
    assert extract.forum_comments(forums, pages, "^m").count() == 6


def test_specs_and_encoded_cells(spark):
    code = base64.b64encode(json.dumps(codecs.encode('745 <i style="color:red; display : none;">x<b>y</b></i>ccm<!-- z --> &lt; 1', "rot13")).encode()).decode()
    page = f'<script>var dataArray = [{{"k7": "{code}"}}, {{"k8": ""}}];</script><table class="Grid"><tr><td><b>Displacement:</b></td><td><span class="k7">wait</span></td></tr>' \
           '<tr><td><b>Power</b></td><td>old</td></tr><tr><td><b>Power</b></td><td>57.8 HP</td></tr><tr><td>plain</td><td>no</td></tr></table>'  # fmt: skip
    got = extract.extract_specs(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string"), "page_id").orderBy("page_id").collect()
    assert got[0].raw_specs == {"Displacement": "745 ccm < 1", "Power": "57.8 HP"} and got[1].raw_specs == {}
    assert extract.revealed("var dataArray = [oops];") == "var dataArray = [oops];"


def test_listing_rows(spark):
    page = "<table><tr><td>x</td></tr></table><table><tr><td>Name</td></tr><tr><td><a href='/m/1'>Corvo Due Tre</a></td><td>Scooter</td><td>?</td><td>745 ccm</td></tr><tr><td>short</td></tr></table><table><tr></tr></table>"
    want = {"brand": "Corvo", "model": "Due Tre", "year": 2020, "category": "Scooter", "engine_text": "745 ccm", "url": "/m/1"}
    assert extract.listing_rows(page, 2020) == [want] and extract.listing_rows("<table></table>", 2020) == []
    with pytest.raises(ValueError):
        extract.listing_rows(page, 1800)
    got = extract.extract_listings(spark.createDataFrame([(2020, page), (1999, None)], "year int, html string")).collect()
    assert [r.asDict() for r in got] == [want]


def test_expressions_over_pages(spark):
    shown = '<em class="icon-x"></em> Trail &amp; Co</div><h3>Quel est le prix de l\'Ibis 400 R 2021 ?</h3><p>Le prix de l\'Ibis est de <u>\n12&nbsp;900</u> €</p>'
    rows = [("https://a.example/corvo-uno/12/ibis-400-r-2021/contact.html", shown), ("https://a.example/corvo-uno/12/ibis-400-r-2021/contact.html", "12 €"), ("https://a.example/corvo-uno/x/ibis-2021/contact.html", shown), ("https://a.example/", None)]
    got = spark.createDataFrame(rows, "url string, html string").select(*extract.priced_page(F.col("url"), F.col("html"))).collect()
    assert list(map(tuple, got)) == [("corvo uno", "Ibis 400 R", 2021, 12900, "Trail & Co"), ("corvo uno", "ibis 400 r", 2021, None, None), (None, None, None, 12900, "Trail & Co"), (None,) * 5]
    page = '<a class="l" href="t?id=3"><a href="x"><a href="t?id=3">'
    got = spark.range(1).select(extract.links_matching(F.lit(page), r"^t\?id="), extract.unescaped(F.lit("a &amp; b &#233;")), extract.sitemap_locations(F.lit("<loc> a </loc><loc>b</loc><loc>a</loc>"))).first()
    assert list(got) == [["t?id=3"], "a & b é", ["a", "b"]]


def test_mentions():
    answer = "I like the **Corvo Ibis 400** (2019) and **Note**.\n1. Tern GT 2001, fast\n2) no\n- Weight: 100 kg\n- Poids 5 kg\n• Corvo ibis-400 (1999)\n- **Rex 7**: red (built 2018)\n- Colour of it: red\n**a*b**"
    assert extract.mentions_of(answer) == [("Corvo Ibis 400", 2019), ("Tern GT 2001, fast", 2001), ("**Rex 7**: red", 2018)]
    assert extract.mentions_of("") == []


def test_readers(spark, tmp_path):
    lines = ["\t".join(str(k) for k in range(23)), "short\tline", "\t".join(["é\"x"] * 24)]
    (tmp_path / "flat.txt").write_bytes("\n".join(lines).encode("latin-1"))
    got = readers.flat_file(spark, f"{tmp_path}/flat.txt", {"campno": 1, "make": 2}, 23).collect()
    assert sorted(map(tuple, got)) == [("1", "2"), ('é"x', 'é"x')]
    with zipfile.ZipFile(tmp_path / "flat.zip", "w") as z:
        z.writestr("a.txt", "é\tb\r\nc".encode("latin-1"))
    assert [r.line for r in readers.unzipped(spark, f"{tmp_path}/flat.zip").collect()] == ["é\tb", "c"]
    (tmp_path / "a.jsonl").write_text('{"k": 1}\nnot json\n{"k": 2}\n')
    assert sorted(r.k for r in readers.json_lines(spark, f"{tmp_path}/a.jsonl", "k int").collect()) == [1, 2]
    (tmp_path / "done.txt").write_text("u1\n u1 \n\nu2\n")
    urls = spark.createDataFrame([("u1",), ("u3",), ("u3",)], "url string")
    assert [r.url for r in merge.frontier(urls, readers.journal(spark, f"{tmp_path}/done.txt"), "url").collect()] == ["u3"]
    (tmp_path / "sheet.md").write_text("# x\n| id | verdict |\n|---|:-:|\n| 1 | ok |\n| 2 | |\n")
    assert [tuple(r) for r in readers.marked_sheet(spark, f"{tmp_path}/sheet.md", ["id", "verdict"]).collect()] == [("1", "ok"), ("2", "")]


def test_sinks(spark, tmp_path):
    path = f"{tmp_path}/snap"
    readers.replace_snapshot(spark.createDataFrame([(1, 2021), (2, 2022)], "v int, year int"), path, "year")
    readers.replace_snapshot(spark.createDataFrame([(3, 2022)], "v int, year int"), path, "year")
    assert sorted(map(tuple, spark.read.parquet(path).select("v", "year").collect())) == [(1, 2021), (3, 2022)]
    readers.write_sheet(spark.createDataFrame([(1, None), (2, "x|y\nz")], "a int, b string"), f"{tmp_path}/sheet", ["a", "b"])
    assert [r.value for r in spark.read.text(f"{tmp_path}/sheet").collect()] == ["| a | b |", "|---|---|", "| 1 |  |", "| 2 | x\\|y z |"]
    assert [tuple(r) for r in readers.marked_sheet(spark, f"{tmp_path}/sheet", ["a", "b"]).collect()] == [("1", ""), ("2", "x|y z")]
    readers.write_report(spark.createDataFrame([(1, "x")], "a int, b string"), f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").first()[:] == (1, "x")


def test_ingest_is_idempotent(spark, tmp_path):
    source, target = tmp_path / "in", f"{tmp_path}/table"
    source.mkdir()

    def merged(old, new):
        new = merge.first_wins(new, ["k"], [F.desc("v")])
        return new if old is None else merge.upsert(old, new, ["k"], {"v": "greatest"})

    def run(checkpoint):
        ingest.ingest(ingest.json_stream(spark, str(source), "k int, v int", 1), target, f"{tmp_path}/{checkpoint}", merged).awaitTermination()
        return sorted(map(tuple, ingest.current(spark, target).collect()))

    assert ingest.current(spark, target) is None
    (source / "a.json").write_text('{"k": 1, "v": 1}\n{"k": 2, "v": 5}\n{"k": 2, "v": 5}\n')
    assert run("c") == [(1, 1), (2, 5)]
    (source / "b.json").write_text('{"k": 1, "v": 7}\n{"k": 3, "v": 0}\n')
    assert run("c") == [(1, 7), (2, 5), (3, 0)]
    assert run("c") == [(1, 7), (2, 5), (3, 0)]


@pytest.mark.parametrize("kind", ["map", "upsert"])
def test_a_batch_that_runs_twice_starts_from_the_same_rows(spark, tmp_path, kind):
    path = f"{tmp_path}/table"
    union = lambda old, new: new if old is None else old.withColumn("v", F.col("v") + 1).unionByName(new)  # noqa: E731  no shuffle between reading and writing
    upsert = lambda old, new: new if old is None else merge.upsert(old, new, ["k"], {"v": "greatest"})
    rows = [spark.createDataFrame([(k, k)], "k int, v int") for k in range(4)]
    want = {"map": [[(0, 0)], [(0, 1), (1, 1)], [(0, 2), (1, 2), (2, 2)], [(0, 3), (1, 3), (2, 3), (3, 3)]], "upsert": [[(j, j) for j in range(k + 1)] for k in range(4)]}[kind]
    for number, batch in enumerate(rows):
        for _ in range(3):
            ingest.merge_batch(batch, number, path, union if kind == "map" else upsert)
            assert sorted(map(tuple, ingest.current(spark, path).collect())) == want[number]
    assert {p.name.split("-")[0] for p in (tmp_path / "table").iterdir()} == {"v2", "v3"}  # older versions went
    assert sorted(map(tuple, ingest.current(spark, path, 3).collect())) == want[2] and ingest.current(spark, path, 2) is None


def test_a_batch_rewrites_the_buckets_it_touches(spark, tmp_path):
    path = f"{tmp_path}/table"

    def merged(old, new):
        return new if old is None else merge.upsert(old, new, ["k"], {"v": "greatest", "t": "new"})

    whole = spark.range(20_000).selectExpr("id as k", "id % 7 as v", "sha2(string(id), 256) as t")
    first = buckets.merge_batch(whole, 0, path, ["k"], merged, 64)
    small = spark.createDataFrame([(3, 100, "x"), (50_000, 1, "y"), (None, 5, "z")], "k long, v long, t string")
    told = [buckets.merge_batch(small, 1, path, ["k"], merged) for _ in range(3)]
    assert first["buckets"] == 64 and all(t["buckets"] <= 3 and 0 < t["bytes"] < first["bytes"] / 10 for t in told)
    rows = {r.k: (r.v, r.t) for r in buckets.current(spark, path).collect()}
    assert len(rows) == 20_002 and rows[3] == (100, "x") and rows[50_000] == (1, "y") and rows[None] == (5, "z")
    assert buckets.current(spark, path, 1).count() == 20_000 and buckets.current(spark, path, 0) is None
    assert len(list((tmp_path / "table/manifests").glob("m*.json"))) == 2 and len(list((tmp_path / "table/data").iterdir())) == 2
    assert buckets.merge_batch(small.limit(0), 2, path, ["k"], merged) == {"buckets": 0, "bytes": 0}
    assert buckets.current(spark, path).count() == 20_002


def test_a_batch_without_its_manifest_never_was(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/table"
    union = lambda old, new: new if old is None else old.withColumn("v", F.col("v") + 1).unionByName(new)
    one = spark.createDataFrame([(1, 0)], "k int, v int")
    buckets.merge_batch(one, 0, path, ["k"], union, 4)
    with monkeypatch.context() as lost:
        lost.setattr(buckets, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            buckets.merge_batch(one, 1, path, ["k"], union)
    assert [tuple(r) for r in buckets.current(spark, path).collect()] == [(1, 0)]
    buckets.merge_batch(one, 1, path, ["k"], union)
    assert sorted(map(tuple, buckets.current(spark, path).collect())) == [(1, 0), (1, 1)]
    assert len(list((tmp_path / "table/data").iterdir())) == 2  # what the lost run wrote is gone
    none = spark.createDataFrame([], "k int, v int")
    buckets.merge_batch(none, 0, f"{tmp_path}/empty", ["k"], union)
    assert buckets.current(spark, f"{tmp_path}/empty").count() == 0
