"""WARC, chat, packing, decontamination, near-dedup and the pipeline against brute force."""

import hashlib
import struct
import zlib
from base64 import b32encode
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from xxhash import xxh64_intdigest

import corpus_pipeline
from tessella.llm import chat, components, cutting_stock, decontaminate, fm_index, packing, simhash, warc
from tessella.llm.queries import ORACLE_SQL, op1_warc, op2_chat, op4_packing, op5_quality_rules, op9_decontamination, op10_simhash

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, component_id string, fp long, class string"


@pytest.fixture(scope="module")
def odd(spark):
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (4, "a b"), (5, "w%d " * 3), (None, "the null id"), (None, "the null id"), (6, "Long " * 30_000), (7, "ſ É <|endoftext|> don't 12,5")]
    return spark.createDataFrame([(i, t, None, None, None, "x", "y", 1, "z") for i, t in texts], DOCS)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_oracles(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    query = {f.__name__: f for f in (op1_warc, op2_chat, op5_quality_rules, op9_decontamination)}[name]
    found = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    df = query(spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert Counter(map(tuple, df.select(*names).collect())) == Counter(found.fetchall())


# WARC


def test_arc_versions_and_lengths():
    v1 = b"filedesc://a.arc 0.0.0.0 20010101000000 text/plain 13\n1 0 Internet\n\n\n"
    one = b"http://a/x y 1.2.3.4 20010203040506 text/html 21\nHTTP/1.0 200 OK\n\nab\n\n"
    two = b"dns:a 1.2.3.4 2001 text/dns 3\nabc"
    found = list(warc.parse_archive(v1 + one + two))
    assert [(v, r) for _, v, r in found] == [(1, one[: one.index(b"\n") + 22]), (1, two)]
    record, _ = warc.parse_record(one, 1)
    assert (record.url, record.ip, record.date) == ("http://a/x y", "1.2.3.4", b"20010203040506")
    out = warc.to_warc(record, "k")
    assert b"WARC-Target-URI: http://a/x%20y" in out and b"WARC-Date: 2001-02-03T04:05:06Z" in out and b"WARC-Type: response" in out
    v2 = b"http://a 1.2.3.4 20010203040506 text/html 200 - - 0 f.arc 9\nabc"
    short, _ = warc.parse_record(v2, 2)
    assert short.truncated and short.block == b"abc" and b"WARC-Type: resource" in warc.to_warc(short, "k")
    with pytest.raises(warc.ArcError):
        warc.parse_record(b"http://a 1.2.3.4 text/html 3\nabc", 1)
    with pytest.raises(warc.ArcError):
        warc.parse_record(b"x", 3)


def test_warc_round_trip_of_odd_pages(spark):
    hard = "WARC/1.0\r\nContent-Length: 5\r\n\r\n\r\n\r\n é\r\n"
    rows = [(1, "http://a", "x"), (2, None, "x"), (3, "a b\nc", None), (4, "u", ""), (5, "u", hard), (6, "u", "z" * 3_000_000), (7, "v", "x"), (7, "v", "x"), (None, "n", "x"), (8, "d", "p"), (8, "d", "q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = Counter(map(tuple, warc_rows(spark, pages)))
    largest = {}
    for i, _, html in rows:
        largest[html or ""] = max(largest.get(html or "", -1), -1 if i is None else i)
    want = Counter()
    for i, _, html in rows:
        h = (html or "").encode()
        to = largest[html or ""]
        want[(i, len(h), b32encode(hashlib.sha1(h).digest()).decode(), "response" if to == i else "revisit", None if to == i else to)] += 1
    assert got == want
    assert warc_rows(spark, pages.limit(0)) == []


def warc_rows(spark, pages):
    found = warc.read_warc(spark, warc.write_warc(warc.pages_as_arc(pages)))
    return [(int(r.source_key) if r.source_key else None, r.payload_bytes, r.payload_digest, r.record_type, None if r.refers_to_key is None else int(r.refers_to_key)) for r in found.collect()]


def test_split_archives(spark):
    data = b"http://a 1.2.3.4 20010203040506 text/html 3\nabc\nhttp://b 1.2.3.4 20010203040506 text/html 0\n\n"
    out = warc.split_archives(spark.createDataFrame([("p", bytearray(data)), ("q", None)], "path string, content binary"))
    assert [r.key for r in out.orderBy("key").collect()] == ["p:000000000000", "p:000000000048"]


# Chat


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb"]), st.text(alphabet="a\\#<>/turnh\n é漢😀", max_size=30)), max_size=6))
@settings(max_examples=300, deadline=None)
def test_chat_round_trip(turns):
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    assert [chat.unescape(text[s:e]) for s, e in spans] == [t for r, t in turns if r == "assistant" and t]


def test_chat_masks_match_brute_force():
    from tokenizers import Tokenizer

    turns = [("user", "\\### Assistant: </turn> ok"), ("assistant", "é😀 end.\n\n"), ("assistant", ""), ("assistant", "\n x")] * 3
    text, spans = chat.render(turns)
    offsets = np.array(Tokenizer.from_file(chat.default_tokenizer()).encode(text, add_special_tokens=False).offsets)
    mask, shared = chat.loss_mask(offsets, spans)
    assert mask.tolist() == [any(a < e and s < b for s, e in spans) for a, b in offsets]
    assert "".join(text[s:e] for s, e in shared) == "".join(text[s:e] for s, e in spans)


def test_chat_blocks_and_odd_rows(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "hi"), (1, 0, "user", "hi"), (None, 0, None, "x"), (2, None, "assistant", "y" * 500), (2, 1, "assistant", "z" * 700), (2, 2, "user", "w")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    for block in (1 << 20, 600):
        out = {r.conv_id: r for r in chat.conversation_digests(chat.format_conversations(turns, block_chars=block)).collect()}
        assert {k: r.n_turns for k, r in out.items()} == {1: 3, None: 1, 2: 3}
        assert out[2].loss_chars == 1200 and out[2].loss_sha256 == hashlib.sha256(b"y" * 500 + b"z" * 700).hexdigest()
        assert out[1].turns_sha256 == hashlib.sha256(b"user\nhi\nuser\nhi\nassistant\n\n").hexdigest()
    assert chat.conversation_digests(chat.format_conversations(turns.limit(0))).count() == 0


# Packing


def test_tokens_equal_the_tokenizer(spark, odd):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    whole.encode_special_tokens = True
    words = packing.WordTokenizer(packing.default_tokenizer(), keep=50)
    for r in [*spark.read.parquet(f"{SF}/documents.parquet").collect(), *odd.collect()]:
        assert np.frombuffer(words.ids((r.text or "").encode()), "<u4").tolist() == whole.encode(r.text or "", add_special_tokens=False).ids


@given(st.text(max_size=60))
@settings(max_examples=400, deadline=None)
def test_tokens_of_any_text(text):
    ids = WORDS.ids(text.encode("utf-8", "ignore"))
    assert np.frombuffer(ids, "<u4").tolist() == WORDS.whole.encode(text.encode("utf-8", "ignore").decode(), add_special_tokens=False).ids


WORDS = packing.WordTokenizer(packing.default_tokenizer())


def check_packed(rows, docs):
    words = packing.WordTokenizer(packing.default_tokenizer())
    whole = Counter()
    for r in docs:
        whole[(r.doc_id, words.ids((r.text or "").encode()) + struct.pack("<I", 1))] += 1
    cover = defaultdict(list)
    for r in rows:
        cover[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for (doc, ids), n in whole.items():
        for at in range(0, len(ids) // 4, 2048):
            piece = ids[4 * at : 4 * (at + 2048)]
            assert cover[doc].count((at, len(piece) // 4, zlib.crc32(piece), len(ids) // 4)) >= n
    assert sum(map(len, cover.values())) == sum(n * -(-len(ids) // 8192) for (_, ids), n in whole.items())
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding / max(1, sum(r.length for r in rows))


def test_packing_is_whole_and_tight(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert check_packed(op4_packing(spark, "/root/testdata/sf0.01").collect(), docs.collect()) < 0.02
    check_packed(packing.pack(odd).collect(), odd.collect())
    assert packing.pack(odd.limit(0)).count() == 0


@given(st.lists(st.integers(1, 16), min_size=1, max_size=60))
@settings(max_examples=100, deadline=None)
def test_patterns_hold_the_demand(lengths):
    sizes, demand = np.unique(np.array(lengths), return_counts=True)
    patterns = cutting_stock.solve(sizes, demand, 16)
    assert (sum(c * n for c, n in patterns) == demand).all()
    assert all((c * sizes).sum() <= 16 for c, _ in patterns)
    assert sum(n for _, n in patterns) <= -(-sum(lengths) // 16) + sum(x > 8 for x in lengths) + 2


# Decontamination


@given(st.lists(st.integers(1, 3), min_size=1, max_size=80), st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=5), min_size=1, max_size=8))
@settings(max_examples=100, deadline=None)
def test_fm_index_finds_every_occurrence(text, patterns):
    symbols = np.array([0, *text, 0])
    index = fm_index.FMIndex(symbols, 4, sample=3)
    width = max(map(len, patterns))
    padded = np.array([[0] * (width - len(p)) + p for p in patterns])
    lo, hi = index.search(padded, np.array([len(p) for p in patterns]))
    for p, a, b in zip(patterns, lo, hi):
        want = [i + 1 for i in range(len(text) - len(p) + 1) if text[i : i + len(p)] == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def contaminated_by_hand(doc, items, window=13):
    words = decontaminate.words_of((doc or "").encode())
    hit, found = set(), set()
    for item, text in items:
        own = decontaminate.words_of((text or "").encode())
        for at in range(max(1, len(own) - window + 1) if own else 0):
            g = own[at : at + window]
            for i in range(len(words) - len(g) + 1):
                if words[i : i + len(g)] == g:
                    hit.update(range(i, i + len(g)))
                    found.add(item)
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()


def test_decontamination_cases(spark, odd):
    items = [(1, "w1 w2 w3"), (2, None), (3, "..."), (4, " ".join(f"p{i}" for i in range(15))), (10, "W1 W2, w3!"), (5, "x x")]
    docs = [(1, "w1 w2 w3 w1 w2 w3"), (2, " ".join(f"P{i}" for i in range(1, 15))), (3, "x x x x"), (4, "w1 w2"), (5, None), (6, ""), (7, "q " * 100 + "w1-w2-w3"), (7, "q"), (8, " ".join(f"p{i}" for i in range(12)))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter((i, *contaminated_by_hand(t, items)) for i, t in docs)
    for options in ({}, {"block_words": 1}, {"shard_symbols": 1}):
        got = decontaminate.contamination(frame, bench, **options).collect()
        assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got) == want
        clean = decontaminate.drop_contaminated(frame, bench, **options)
        assert clean.columns == frame.columns and sorted(r.doc_id for r in clean.collect()) == [4, 5, 6, 7, 7, 8]
    assert decontaminate.drop_contaminated(odd, bench).columns == odd.columns
    assert decontaminate.drop_contaminated(odd, bench.limit(0)).count() == odd.count()
    assert decontaminate.contamination(odd.limit(0), bench).count() == 0


def test_items_without_an_id_are_hit(spark, tmp_path):
    import duckdb

    items = [(None, "w1 w2 w3"), (None, "x y"), (7, "x y"), (None, None), (None, "..."), (3, " ".join(f"p{i}" for i in range(15))), (None, " ".join(f"p{i}" for i in range(2, 20)))]
    docs = [(1, "w1 w2 w3 a"), (2, "x y b"), (3, " ".join(f"p{i}" for i in range(18))), (4, "a b"), (5, None), (6, "q " * 100 + "w1 w2 w3")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    con = duckdb.connect()
    for name, df in (("documents", frame), ("benchmark", bench)):
        df.write.parquet(f"{tmp_path}/{name}")
        con.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}/*.parquet')")
    found = con.execute(ORACLE_SQL["op9_decontamination"])
    names, want = [d[0] for d in found.description], Counter(found.fetchall())
    for options in ({}, {"block_words": 10}):
        got = decontaminate.contamination(frame, bench, **options)
        assert Counter(map(tuple, got.select(*names).collect())) == want
        assert {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in got.collect()} == {1: (3, 0, True), 2: (2, 1, True), 3: (18, 1, True), 4: (0, 0, False), 5: (0, 0, False), 6: (3, 0, False)}
        assert sorted(r.doc_id for r in decontaminate.drop_contaminated(frame, bench, **options).collect()) == [4, 5, 6]


# SimHash


def print_by_hand(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_by_hand(prints):
    """Smallest id of each row's component by linking all pairs."""
    value = np.array([p for _, p in prints], np.uint64)
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(value[i + 1 :] ^ value[i]) <= 3) + i + 1:
            parent[find(i)] = find(int(j))
    least = {}
    for i, (doc, _) in enumerate(prints):
        r = find(i)
        ids = [x for x in (least.get(r), doc) if x is not None]
        least[r] = min(ids) if ids else None
    return [least[find(i)] for i in range(len(prints))]


def test_simhash_like_brute_force(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rows = docs.collect()
    prints = [(r.doc_id, print_by_hand(r.text)) for r in rows]
    want = Counter((d, f"{p:016x}", c) for (d, p), c in zip(prints, classes_by_hand(prints)))
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_one_of_each_class_stays(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    classes = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert sorted(r.doc_id for r in simhash.keep_one_of_each(docs).collect()) == sorted(classes)
    kept = simhash.keep_one_of_each(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 4, 5, 6, 7, None])
    assert simhash.keep_one_of_each(odd.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [4, 1024])
def test_links_keep_components_in_hot_buckets(spark, chunk):
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 2**63))
    values = {centre}
    for _ in range(300):
        v = int(rng.choice(list(values)))
        for bit in rng.choice(64, 2, replace=False):
            v ^= 1 << int(bit)
        values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long"), chunk=chunk)
    got = {r.node: r.component for r in components.connected_components(links).collect()}
    want = dict(zip(signed, classes_by_hand([(s, v) for s, v in zip(signed, values)])))
    assert {v: got.get(v, v) for v in signed} == want


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(links).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


# Pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        before, after = docs.collect(), out.collect()
        if name == "near_dedup":
            prints = [(r.doc_id, print_by_hand(r.text)) for r in before]
            assert sorted(r.doc_id for r in after) == sorted(set(classes_by_hand(prints)))
        if name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            judged = {r.doc_id: contaminated_by_hand(r.text, items) for r in before}
            assert sorted(r.doc_id for r in after) == sorted(d for d, (n, h, _, _) in judged.items() if not (h and 20 * h >= n))
        if name == "secrets":
            assert len(after) == len(before) and all(r.n_chars == len(r.text) for r in after)
        docs = out
    check_packed(corpus_pipeline.run(spark, SF).collect(), docs.collect())


def test_pipeline_on_odd_rows(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0  # no row has a language to learn from
