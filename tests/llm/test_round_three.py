"""The tree encoder against the library, repairs against all edit sequences, the source audit against plain Python and SQL."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import decontaminate, divergence, language, queries, repair, secrets, toxicity, tree_bpe

SF = "/root/testdata/sf0.01"


# Tree encoder


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def both(request):
    import public_tokenizers
    import tiktoken

    ranks = tree_bpe.read_ranks(public_tokenizers.path(request.param))
    return tree_bpe.TreeBPE(ranks), tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_texts_encode_as_the_library_does(both):
    tree, library = both
    rnd = random.Random(3)
    syllables = ["ab", "aaaa", "ing", "é", "漢字", "😀", " ", "\n", "　", "12", "'s", "=", "\x00", "<|endoftext|>", "ё"]
    for _ in range(1500):
        text = "".join(rnd.choice(syllables) for _ in range(rnd.choice([0, 1, 5, 40, 300])))
        assert tree.encode(text).tolist() == library.encode_ordinary(text), text
        assert tree.decode(tree.encode(text).tolist()) == text.encode()
    for text in ("a" * 30_001, "ab" * 20_000 + "c", "漢" * 10_000, " " * 20_001 + "x"):
        assert tree.encode(text).tolist() == library.encode_ordinary(text)


def test_windows_have_the_same_tokens_by_heap_and_by_scan(both):
    tree, _ = both
    rnd = random.Random(5)
    for _ in range(400):
        data = bytes(rnd.choice(b"abcethin aaaa\xc3\xa9") for _ in range(rnd.randrange(1, 90)))
        assert tree._by_scan(data) == tree._by_heap(data)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"ab", b"aa", b"ba", b"aab", b"abab", b"bb", b"aaaa", b"bab"]), unique=True, max_size=10), st.text("abc", max_size=60), st.text("abc", max_size=60), st.text("abc", max_size=60))
def test_joins_are_a_monoid_under_any_ranks(merges, a, b, c):
    ranks = {bytes([x]): 1000 + x for x in range(256)} | {m: k for k, m in enumerate(merges) if len(m) > 1}
    tree = tree_bpe.TreeBPE(ranks)
    x, y, z = (tree._by_heap(t.encode()) for t in (a, b, c))
    whole = tree._by_heap((a + b + c).encode())
    assert tree.join(tree.join(x, y), z) == tree.join(x, tree.join(y, z)) == whole == tree.tokens((a + b + c).encode())
    assert tree.join([], x) == tree.join(x, []) == x


def test_encoded_rows_of_odd_tables(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "a b" * 9000, 5), (3, "a b" * 9000, 5), (None, "<|endoftext|>", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = tree_bpe.decode_ids(tree_bpe.encode_texts(docs)).collect()
    assert sorted((r.doc_id or 0, len(r.ids), bytes(r.decoded).decode()) for r in out)[1:3] == [(1, 0, ""), (2, 0, "")]
    assert [bytes(r.decoded).decode() for r in out if r.doc_id == 3] == ["a b" * 9000] * 2
    assert [r.ids for r in out if r.doc_id is None][0] != [50256]
    assert tree_bpe.decode_ids(tree_bpe.encode_texts(docs.limit(0))).collect() == []


def test_query_of_the_encoder_against_the_library(spark, both):
    if len(both[0].ranks) != 50_256 or b" the" not in both[0].ranks:
        pytest.skip("another vocabulary")
    import public_tokenizers

    if both[0].ranks != tree_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")):
        pytest.skip("another vocabulary")
    found = {r.doc_id: r for r in queries.op11_bpe(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(rows)
    for r in rows:
        ids, mine = both[1].encode_ordinary(r.text or ""), found[r.doc_id]
        assert mine.n_tokens == len(ids)
        assert mine.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert mine.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


# Repair of conversations


def cheapest(symbols):
    """The least (cost, audit, initials) over all edit sequences with up to two insertions at each place."""
    best = None
    inserts = [""] + ["u", "a", "ua", "au"]

    def options(initial, fault):
        yield 3, "D", ""
        if fault != "d":
            more = 1 if fault == "t" else 0
            yield more, "K", initial
            yield 2 + more, "R", "u"
            yield 2 + more, "R", "a"

    for edits in itertools.product(*[list(options(*s)) for s in symbols]):
        if best and sum(e[0] for e in edits) > best[0]:
            continue
        for extra in itertools.product(inserts, repeat=len(symbols) + 1):
            cost = sum(e[0] for e in edits) + 2 * sum(map(len, extra))
            if best and cost > best[0]:
                continue
            said = extra[0] + "".join(e[2] + x for e, x in zip(edits, extra[1:]))
            audit = "I" * len(extra[0]) + "".join(e[1] + "I" * len(x) for e, x in zip(edits, extra[1:]))
            if re.fullmatch("(s?(ua)+)?", said) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, said)
    return best


def test_repairs_are_the_cheapest_of_all_edit_sequences():
    rnd, parser = random.Random(11), repair.Parser()
    for n in (0, 1, 2, 3, 4):
        for _ in range({0: 1, 1: 12}.get(n, 60 if n < 4 else 25)):
            symbols = [(rnd.choice("suatsua"), rnd.choice(["", "", "", "t", "d"])) for _ in range(n)]
            cost, audit = repair.least(parser.parse(symbols))
            want = cheapest(symbols)
            assert (cost, audit) == want[:2], symbols
            said = [r for r, _ in repair.repaired([(i, "x") for i, _ in symbols], audit)]
            assert "".join(r[0] for r in said) == want[2]


def plainly(rows):
    """One conversation's report by a plain programme; rows of (turn, role, text, times)."""
    rows = sorted([(t is not None, t or 0, r, x) for t, r, x, n in rows for _ in range(n)])
    said, symbols, counts = set(), [], Counter()
    for _, _, role, text in rows:
        end = re.sub(r"[\x20\x09-\x0d]", "", text)[-1:]
        fault = "blank" if not end else "duplicate" if (role, text) in said else "truncated" if end not in ".!?" else ""
        said.add((role, text))
        counts[fault] += 1
        symbols.append((role[:1], {"blank": "d", "duplicate": "d", "truncated": "t"}.get(fault, "")))
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:]))
    turns = [t for known, t, _, _ in rows if known]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit = repair.least(repair.Parser().parse(symbols))
    text = "\n".join(f"{r}:{x}" for r, x in repair.repaired([(r, x) for _, _, r, x in rows], audit))
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def reports(spark, rows, conv="long"):
    turns = spark.createDataFrame(rows, f"conv {conv}, turn long, role string, text string, n long")
    out = repair.conversation_reports(repair.repair_conversations(turns)).collect()
    return {r.conv: tuple(r)[1:] for r in out}


@pytest.mark.parametrize("block_rows", [3, 4096])
def test_blocks_give_what_the_whole_gives(spark, monkeypatch, block_rows):
    monkeypatch.setattr(repair, "BLOCK_ROWS", block_rows)
    rnd = random.Random(2)
    rows = [(0, None if rnd.random() < 0.05 else rnd.randrange(400), rnd.choice(["system", "user", "assistant", "tool", ""]), rnd.choice(["Yes.", "No", "", " \t", "Ok!", "x" * 50 + "?", "a.\n"]) + ("" if rnd.random() < 0.5 else str(rnd.randrange(99)) + "."), 1) for _ in range(900)]
    rows += [(k % 40, t, rnd.choice(["user", "assistant"]), rnd.choice(["Hm", "So."]) + str(rnd.randrange(5)) + ".", rnd.choice([0, 1, 1, 2])) for k in range(1, 40) for t in range(6)]
    rows += [(None, 1, "user", "Hi.", 1), (None, None, "assistant", "Hello.", 1), (77, 4, "user", "Gone.", 0), (78, 1, "user", "Same.", 9000)]
    found, by = reports(spark, rows), defaultdict(list)
    for conv, *row in rows:
        by[conv].append(tuple(row))
    assert found.keys() == by.keys()
    for conv, mine in by.items():
        assert found[conv] == plainly(mine), conv
    assert found[77] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_rows_and_odd_tables(spark):
    rows = [("a", 1, None, None, 1), ("a", 2, "user", "Hi.", 1), ("b", 0, "user", "One.", 1), ("b", 0, "user", "One.", 1)]
    turns = spark.createDataFrame([(*r, 7) for r in rows], "conv string, turn long, role string, text string, n long, rows int")
    out = repair.repair_conversations(turns)
    said = {r.conv: [(x.role, x.text) for x in r.rows] for r in out.where("whole").collect()}
    said |= {r.conv: [(x.role, x.text) for x in r.rows] for r in out.where("not whole").collect()}
    assert said == {"a": [("user", "Hi."), ("assistant", "")], "b": [("user", "One."), ("assistant", "")]}
    assert repair.conversation_reports(repair.repair_conversations(turns.limit(0))).collect() == []


def test_damage_follows_the_checksum(spark):
    rows = [(c, t, "assistant", "A! b. c?") for c in range(9) for t in range(9)] + [(None, None, None, None)]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, kind int")
    found = sorted([tuple(r) for r in repair.damage(turns).collect()], key=repr)
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want.append((c, t, "user" if kind == 4 else role, text, 0 if kind == 0 else 2 if kind == 3 else 1))
    assert found == sorted(want, key=repr)


# Source audit


def audited(rows, least=10, ranks=10):
    words = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    out = []
    for lang in {w[0] for w in words}:
        df, counts = Counter(), defaultdict(Counter)
        for la, source, found in words:
            if la == lang:
                df.update(set(found))
                counts[source].update(found)
        kept = sorted((t for t in df if df[t] >= least), key=str.encode)
        whole = Counter()
        for c in counts.values():
            whole.update(c)

        def p(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + int(Fraction(10**9 * (c[t] + 2), n + 2 * len(kept))) for t in kept}

        q = p(whole)
        ps = {s: p(c) for s, c in counts.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = sorted(((-sum(f(ps[s][t], ps[o][t]) for t in kept), o) for o in counts if o != s), key=lambda x: (x[0], x[1].encode()))
            terms = sorted(((-f(ps[s][t], q[t]), t) for t in kept if counts[s][t] and ps[s][t] > q[t]), key=lambda x: (x[0], x[1].encode()))[:ranks]
            out += [(lang, s, part, item, -v, k) for part, found in (("pair", pairs), ("term", terms)) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("chunk", [3, 4096])
def test_audit_against_plain_python(spark, chunk):
    rnd = random.Random(4)
    terms = ["Alpha", "beta", "ÄÖ", "äö", "字", "😀x", "e", "f", "ﬁ", "zz", "rare"]
    rows = [(rnd.choice(["en", "de", None, ""]), rnd.choice(["s1", "s2", None, "Ü", "😀"]), " ".join(rnd.choice(terms[: rnd.choice([3, 8, 11])]) + rnd.choice(["", "1", "-"]) for _ in range(rnd.randrange(12)))) for _ in range(260)]
    rows += [("lonely", "s1", "one two"), ("lonely", "s2", None), ("en", "empty", "")] + [("many", "s1", "same same")] * 12 + [("many", "s2", "")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "lang string, source string, text string, counts int")
    found = sorted(tuple(r) for r in divergence.audit(docs, chunk_terms=chunk).select("lang", "source", "part", "item", "value", "rank").collect())
    assert found == audited(rows)
    assert divergence.audit(docs.limit(0)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**13), st.integers(1, 10**14))
def test_shares_are_exact(count, more):
    import numpy as np

    of = count + more
    assert divergence.shares(np.array([count]), np.array([of])).tolist() == [1 + 10**9 * (count + 2) // of]


@pytest.mark.parametrize("name", ["op12_repair", "op13_divergence"])
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).df()
    found = queries.QUERIES[name](spark, SF)
    names = sorted(found.columns)
    assert sorted(want.columns) == names
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(map(tuple, want[names].values.tolist()))


# Languages that nothing teaches


def test_texts_of_no_learned_language_score_low(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train_language_model(docs)
    other = {
        "zh": "这是一个关于今天新闻的普通文本，明天会下雨，大家要带伞。", "ru": "Вчера вечером мы пошли в кино посмотреть новый фильм, который все советовали.",
        "th": "เมื่อวานนี้เราไปดูหนังเรื่องใหม่", "fi": "Tämä on tavallinen suomenkielinen teksti, jossa kerrotaan päivän uutisista ja säästä koko maassa.",
        "rnd": "xqzv wkjp lmrtq bvcxz pqwk jhgfd zxcvb qwrtp mnbvc lkjhg fdsqw",
    }
    rows = spark.createDataFrame([(k, t) for k, t in other.items()], "doc_id string, text string")
    got = language.identify_languages(rows, model).collect()
    assert len(got) == 5 and all(r.lang_pred in model.languages and r.score < 0.35 for r in got)
    assert language.keep_identified(rows, model).collect() == []
    clean = docs.where("length(text) > 200")
    assert language.keep_identified(clean, model).count() == clean.count()
    inside = docs.where("lang = 'en' and length(text) > 900").first().text
    words, labels = language.Identifier(model).label([inside[:400] + " " + other["zh"] + " " + other["ru"] + " " + inside[400:800]])[0]
    assert [x[2] for x in language.spans(words, labels, model.languages)] == ["en", "und", "en"]


def test_a_share_of_any_smallness_keeps_rows(spark):
    rows = spark.range(3000).selectExpr("id as doc_id", "'alpha beta gamma' as text", "if(id < 2990, 'big', 'small') as lang")
    model = language.train_language_model(rows, per_language=1)
    assert model.languages == ["big", "small"] and language.train_language_model(rows, most_languages=1).languages == ["big"]
    assert language.identify_languages(rows.limit(3), model).count() == 3


# Secrets in quotes and other contexts


@pytest.mark.parametrize("before, value, after", [
    ('password = "', "K9#v Q!x2Lm8Zt#4Rw7 pL0uY7#e", '"\nnext'), ('password = "', "K9#vQ!x2Lm8Ztüü#4Rw7pL0uY7#e", '" x'), ("password:\t", "x7Kq9vR2mZ4pL8", "\n"),
    ('password := "', "x7Kq9vR2mZ4pL8", '"'), ("token:\n  ", "x7Kq9vR2mZ4pL8", "\n"), ("token:\r\n\t", "x7Kq9vR2mZ4pL8", " x"), ("run --password ", "x7Kq9vR2mZ4pL8", " -v"),
    ("<password>", "x7Kq 9vR2mZ4pL8", "</password>"), ("api-key: ", "x7Kq9vR2mZ4pL8", ", x"), ("api key: ", "x7Kq9vR2mZ4pL8", " x"), ("secret=", "пароль9#Q!x2Lm8Zt", " x"),
    ("access key => '", "x7Kq9vR2mZ4pL8", "'"),
])
def test_values_in_every_context_are_whole(before, value, after):
    text = before + value + after
    assert [text[s:e] for s, e, k in secrets.guessed_spans(text) if k == "guess"] == [value]
    assert secrets.redacted(text) == before + "[SECRET]" + after


def whole_cost(value):
    """The least cost over all segmentations of a long value: a table by place and number of spans, with no shortcut but the counted repeats."""
    import math

    import numpy as np

    value = re.sub(r"(.{1,8}?)\1{32,}", lambda m: m[1] * 32, value)
    n, each = len(value), secrets._letters(value)
    best, brute = np.full((n + 1, n + 2), np.inf), np.full((n + 1, n + 2), np.inf)
    best[0, 0] = 0
    into = defaultdict(list)
    for i in range(n):
        for j, cost in secrets.spans_from(value, i, None):
            into[j].append((i, cost))
    for j in range(1, n + 1):
        brute[j, 1:] = np.minimum(brute[j - 1, 1:], best[j - 1, :-1]) + each
        best[j] = brute[j]
        for i, cost in into[j]:
            np.minimum(best[j, 1:], best[i, :-1] + cost, out=best[j, 1:])
    return min(best[n, k] + math.lgamma(k + 1) / math.log(10) for k in range(n + 1))


@pytest.mark.parametrize("n", [255, 256, 257, 300, 1000])
def test_guess_cost_of_long_values_is_the_minimum(n):
    rnd = random.Random(n)
    parts = [*secrets.COMMON_WORDS[:20], "qwerty", "20240131", "aaaa", "abcdef", "xyxyxy", "K9#", "Zt", "7"]
    value = ""
    while len(value) < n:
        value += rnd.choice(parts)
    assert secrets.guess_cost(value[:n], None) == pytest.approx(whole_cost(value[:n]), abs=1e-6)
    assert not secrets._takes(value[:n], secrets.guess_cost(value[:n]) + 1e-6) and secrets._takes(value[:n], 12.0)


def test_longer_repeats_do_not_cost_less():
    costs = [secrets.guess_cost("xq" * k) for k in (4, 32, 33, 127, 128, 129, 500, 5000)]
    assert costs == sorted(costs) and costs[-1] == costs[1]


# Toxic features of either side


@pytest.mark.parametrize("toxic", [50, 75])
def test_frequent_features_of_either_label_tell(spark, toxic):
    docs = spark.range(400).selectExpr("id as doc_id", f"if(id % 100 < {toxic}, 'other stuff here', 'calm gentle note') as text")
    labels = spark.range(400).selectExpr("id as doc_id", f"cast(id % 100 < {toxic} as int) as toxic")
    got = {r.doc_id: r for r in toxicity.score_severity(docs, toxicity.train_severity_model(docs, labels)).collect()}
    assert all(r.toxic == (k % 100 < toxic) for k, r in got.items())
    same = docs.selectExpr("doc_id", "'the same' as text")
    model = toxicity.train_severity_model(same, labels)
    scores = {round(r.score, 6) for r in toxicity.score_severity(same, model).collect()}
    assert scores == {toxic / 100} and list(model.thresholds) == sorted(model.thresholds)


def test_a_shard_keeps_copies_of_its_rows_and_texts_go_once():
    text = "word " * 400
    found = pa.array([{"n_words": 0, "spans": [], "items": []}] * 2000, pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))]))
    rows = pa.array([{"doc_id": k, "text": text} for k in range(2000)])
    phrases = decontaminate.Phrases({(b"a", b"b"): {"1"}})
    schema = pa.schema([("row", pa.null()), ("found", found.type)])
    batches = iter([pa.RecordBatch.from_arrays([rows, found], names=["row", "found"])])
    first = next(decontaminate._pass(batches, phrases, schema, 1 << 17, 1))
    assert first.column("found")[0].as_py()["n_words"] == 400 and first.num_rows == 256
    assert first.column("row").field(1).buffers()[2].size < 2 * 256 * len(text)  # not the batch's
