"""Cases that break simple operators: cuts, repeats, malformed input, hot keys, clashing names, lost settings."""

import gzip
import hashlib
import itertools
import os
import random
import re
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import chat, decontaminate, packing, secrets, simhash, store, warc

SF = "/root/testdata/sf0.001"
HERE = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


# Chat

TURNS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", ""]), st.text(alphabet="a1'#<>/\\ \n\t é漢😀.s", max_size=24)), min_size=1, max_size=6)


@given(TURNS)
@settings(max_examples=300, deadline=None)
def test_cuts_between_turns_change_nothing(turns):
    encoder = ENCODERS["ranks"]
    text, spans = chat.render(turns)
    ids, mask, shared = chat.encoded_with_mask(encoder, text, spans)
    whole = ENCODERS["tokenizer"].encode(text, add_special_tokens=False)
    assert ids.tolist() == whole.ids
    assert mask.tolist() == [any(a < e and s < b for s, e in spans) for a, b in whole.offsets]
    assert shared == spans
    parts = [chat.encoded_with_mask(encoder, *chat.render([turn])) for turn in turns]
    assert ids.tolist() == [i for p in parts for i in p[0].tolist()] and mask.tolist() == [m for p in parts for m in p[1].tolist()]


def _encoders():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(chat.default_tokenizer())
    whole.encode_special_tokens = True
    return {"ranks": chat.RankEncoder(chat.default_ranks()), "tokenizer": whole}


ENCODERS = _encoders()


def test_conversations_over_many_ranges(spark):
    rng = random.Random(4)
    said = lambda: "".join(rng.choice("ab \n#é</turn>") for _ in range(rng.randint(0, 40)))
    rows = [(1, k, rng.choice(["user", "assistant"]), said()) for k in range(900)] + [(None, k, "assistant", said()) for k in range(300)] + [(c, k, "user", said()) for c in range(2, 40) for k in range(3)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("block", F.lit(1)).repartition(5)
    want = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1], r[2].encode(), r[3].encode()))
        text, _ = chat.render([r[2:] for r in mine])
        loss = "".join(r[3] for r in mine if r[2] == "assistant")
        want[conv] = (len(mine), hashlib.sha256("".join(f"{r[2]}\n{r[3]}\n" for r in mine).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)), ENCODERS["tokenizer"].encode(text, add_special_tokens=False).ids
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    for size in (1 << 20, 200):
        done = store.stored(chat.format_conversations(turns, block_chars=size), "formatted")
        assert done.where("conv_id = 1").count() > 1  # shared by several ranges
        blocks = done.orderBy("block").collect()
        for conv, (digests, ids) in want.items():
            assert [i for b in blocks if b.conv_id == conv for i in b.ids] == ids
        got = {r[0]: tuple(r[1:]) for r in chat.conversation_digests(done.repartition(7, "formatted")).collect()}
        assert got == {conv: d for conv, (d, _) in want.items()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# WARC


def test_repeated_rows_have_identifiers_of_their_own(spark):
    rows = [(7, "u", "x")] * 1500 + [(3, "u", "x")] * 3 + [(7, "other", "x"), (None, "n", "x"), (8, "d", "y")]
    path = warc.write_warc(warc.pages_as_arc(spark.createDataFrame(rows, "page_id long, url string, html string")))
    got = warc.read_warc(spark, path).collect()
    assert len(got) == len(rows) == len({r.record_id for r in got})
    responses = {r.record_id for r in got if r.record_type == "response"}
    assert Counter((r.source_key, r.record_type) for r in got) == Counter({("7", "response"): 1501, ("3", "revisit"): 3, ("", "revisit"): 1, ("8", "response"): 1})
    assert all(r.refers_to in responses and r.refers_to_key == "7" for r in got if r.record_type == "revisit")


def test_malformed_arc_records(spark, tmp_path):
    good = b"http://a 1.2.3.4 20010203040506 text/html 3\nabc\n"
    files = [("p", good + b"no header line\nrest"), ("q", b"junk"), ("r", b""), ("s", good + b"http://b 1.2.3.4 20010203040506 text/html 99\ncut"), ("t", b"filedesc://x 0 0 text/plain 3\n9 9\n")]
    out = warc.split_archives(spark.createDataFrame([(k, bytearray(v), 1) for k, v in files], "path string, content binary, key int"))
    got = {r.key.split(":")[0] + str(int(r.key.split(":")[1])): (r.version, bytes(r.record), r.error is None) for r in out.collect()}
    assert got["p0"] == (1, good[:-1], True) and got["p48"] == (None, b"no header line\nrest", False) and got["q0"] == (None, b"junk", False) and len(got) == 6 and not got["t0"][2]
    back = {r.source_key: r for r in warc.read_warc(spark, warc.write_warc(out, f"{tmp_path}/w")).collect()}
    assert len(back) == 6 and {k.split(":")[0] for k, r in back.items() if r.error} == {"p", "q", "t"} and all(r.record_type == "metadata" for r in back.values() if r.error)
    assert back["p:000000000048"].payload_bytes == len(b"no header line\nrest")


def test_archives_of_other_writers(spark, tmp_path):
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\na: b\r\n\r\n"
    page = b"WARC/1.0\r\nWARC-Type:response\r\nWARC-Target-URI: http://x\r\nContent-Length: 25\r\n\r\nHTTP/1.1 200 OK\r\n\r\nhello!\r\n\r\n"
    none, cut = b"WARC/1.0\r\nWARC-Type: resource\r\n\r\n", b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 50\r\n\r\nshort"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(page) + gzip.compress(none + cut))
    (tmp_path / "b.warc").write_bytes(info + page)
    got = [(r.record_type, r.url, r.payload_bytes, r.error is None) for r in warc.read_warc(spark, str(tmp_path)).collect()]
    assert Counter(got) == Counter([("warcinfo", None, 4, True), ("response", "http://x", 6, True)] * 2 + [("resource", None, 0, False), ("resource", None, 5, False)])


def test_blocks_of_line_ends_survive(spark):
    rng = random.Random(1)
    pages = [(k, "u", "".join(rng.choice(["\r", "\n", "\r\n", "\r\n\r\n", "a", "WARC/1.0\r\n"]) for _ in range(n))) for k, n in enumerate([1, 2, 5, 20, 100, 3000, 60_000, 60_000])]
    got = {int(r.source_key): (r.payload_bytes, r.error) for r in warc.read_warc(spark, warc.write_warc(warc.pages_as_arc(spark.createDataFrame(pages, "page_id long, url string, html string")))).collect()}
    assert got == {k: (len(h), None) for k, _, h in pages}
    digests = {int(r.source_key): r.payload_digest for r in warc.read_warc(spark, warc.write_warc(warc.pages_as_arc(spark.createDataFrame(pages, "page_id long, url string, html string")))).collect()}
    assert digests == {k: warc.base32_sha1(h.encode()) for k, _, h in pages}


# Packing


def test_other_tokenizers_encode_whole_texts():
    from tokenizers import Tokenizer

    path = chat.default_tokenizer()
    words, whole = packing.WordTokenizer(path), Tokenizer.from_file(path)
    assert not words.by_word and packing.WordTokenizer(packing.default_tokenizer()).by_word
    for text in ("Hello  world's\n\nend ", "", " é漢😀"):
        assert np.frombuffer(words.ids(text.encode()), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_repeated_documents_are_dealt_to_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "_BUCKET_ROWS", 50)
    docs = spark.createDataFrame([(1, "same words again and again")] * 700 + [(k, f"other {k}") for k in range(2, 40)], "doc_id long, text string").withColumns({"row": F.lit(1), "class": F.lit("x")})
    rows = packing.pack(docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter({1: 700} | {k: 1 for k in range(2, 40)})
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        ends = list(itertools.accumulate(n for _, n in sorted(parts)))
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048


# Decontamination


@pytest.mark.parametrize("block_words", [2_000_000, 30])
def test_item_ids_of_any_type(spark, block_words):
    items = [("b-2", "w1 w2 w3"), ("b-10", "w1 w2 w3 w4"), ("b-10", "w1 w2 w3 w4"), (None, "q r"), ("é", " ".join(f"p{i}" for i in range(200)))]
    docs = [(1, "x w1 w2 w3 w4 y"), (2, "q r"), (3, " ".join(f"P{i}" for i in range(50, 80))), (4, None), (4, "none of it")]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id string, text string"), block_words=block_words).collect()
    sha = lambda *x: hashlib.sha256(",".join(sorted(x)).encode()).hexdigest()
    want = Counter([(1, 6, 4, 2, sha("b-2", "b-10")), (2, 2, 2, 0, sha()), (3, 30, 30, 1, sha("é")), (4, 0, 0, 0, sha()), (4, 3, 0, 0, sha())])
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got) == want


def test_a_stage_holds_one_pass(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    many = decontaminate.contamination(docs, bench, block_words=3000).drop("spans")
    assert many._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, decontaminate.contamination(docs, bench).drop("spans").collect()))


# SimHash


def test_hot_fingerprints_and_clashing_names(spark):
    rows = [(k, "") for k in range(400)] + [(1000 + k, f"a text of its own number {k} with words {k * 7} and {k * 13}") for k in range(60)] + [(5, "")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("_row_a", "_kept_a", "a", "b", "row", "fp", "class", "n")})
    got = simhash.near_duplicates(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    assert {r.component_id for r in got if r.doc_id < 1000} == {0}
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and {r._row_a + r.row + r["class"] for r in kept.collect()} == {"_row_arowclass"}
    assert sum(r.doc_id < 1000 for r in kept.collect()) == 1


@pytest.mark.parametrize("most", [1, 4096])
def test_bitmaps_never_miss_a_key(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "_MAPS", most)
    keys = spark.range(5000).select(F.xxhash64("id").alias("a"), F.xxhash64("id", "id").alias("b"))
    others = spark.range(10_000, 30_000).select(F.xxhash64("id").alias("a"), F.xxhash64("id", "id").alias("b"))
    maps, slot, held = simhash._maybe_in(keys, 5000)
    share = lambda df: df.withColumn("slot", slot).join(maps, "slot", "left").agg(F.avg(held(F.col("map")).cast("int"))).first()[0]
    assert maps.count() <= most and share(keys) == 1 and share(others) < (0.3 if most == 1 else 0.1)


@pytest.mark.parametrize("share", [2, 1000])
def test_joins_in_parts(spark, share):
    rows = spark.createDataFrame([("h", k) for k in range(500)] + [(f"k{k % 40}", k) for k in range(100)], "key string, v int")
    table = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("v").alias("most"))
    got = store.joined_in_parts(rows, table, "key", "n", 600, share)
    assert got.columns == ["key", "v", "most"] and Counter(map(tuple, got.collect())) == Counter((r.key, r.v, r.most) for r in rows.join(table, "key").collect())


# Storage and pipeline


def test_scratch_folders_go(spark):
    root = store.shared_root(spark).removeprefix("file://").removeprefix("file:")
    with store.scratch(spark):
        inside = store.stored(spark.range(3).toDF("x"), "mine")
        path = inside.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert inside.count() == 3 and os.path.isdir(path) and path.startswith(root)
    assert not os.path.exists(path)


def test_storage_without_a_setting(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {HERE!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", "{tmp_path}/warehouse").config("spark.local.dir", "{tmp_path}/local").getOrCreate()
from tessella.llm import store
print(store.stored(spark.range(3).toDF("x"), "mine").inputFiles()[0])
spark.stop()
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, env=os.environ | {"SPARK_CONF_DIR": str(tmp_path)})
    assert f"{tmp_path}/warehouse/tessella-scratch/" in out.stdout, out.stderr[-800:]
    assert not re.findall("mine-", "".join(os.listdir(f"{tmp_path}/warehouse/tessella-scratch")))  # gone with the driver


def test_each_stage_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing columns through every stage, each on rows of its own."""
    names = "doc_id long, text string, lang string, source string, n_chars long, row string, found string, fp long, a string, b string, class string"
    long = "Lang und der Text ist " * 20_000
    texts = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (4, long), (None, "the null id"), (None, "the null id"), (5, "password: x7#Kq9v!R2mZ4pL8"), (6, "w1 w2 w3")]
    docs = spark.createDataFrame([(i, t, None, "s", None, "x", "y", 1, "p", "q", "z") for i, t in texts], names)
    spark.createDataFrame([("i", "w1 w2 w3"), (None, "zzz")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    taught = docs.unionByName(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("*", *[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes[5:]]))
    kept = stages["language"](spark, taught, str(tmp_path))
    assert kept.columns == docs.columns and {1, 2} & {r.doc_id for r in kept.where("source = 's'").collect()} == set()
    kept = stages["near_dedup"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter([1, 3, 4, 5, 6, None])
    kept = stages["decontamination"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 3, 4, 5, None, None])
    kept = stages["secrets"](spark, docs, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter((i, "password: [SECRET]" if i == 5 else t) for i, t in texts)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in kept)
    packed = stages["packing"](spark, docs, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == Counter(i for i, _ in texts)


def test_masked_texts_hold_no_secret(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before = {r.doc_id: r for r in secrets.find_secrets(docs).collect()}
    found = {d for d, r in before.items() if r.spans}
    clean = secrets.redact_secrets(docs)
    after = {r.doc_id: r for r in secrets.find_secrets(clean).collect()}
    assert found and not any(r.spans for r in after.values())
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all((r.text == texts[r.doc_id]) == (r.doc_id not in found) for r in clean.collect())
