"""One query for each operator over its whole table, and SQL for those that SQL can express.

A query derives its columns from what the operator returns. Without SQL: op3, op7 and op8 (trained models: held-out
accuracy), op4 (token ids: round trip), op6 (guess costs: brute force), op10 (XXH64: brute force), op11 (token ids: the library's).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import chat, decontaminate, divergence, language, packing, quality, quality_rules, repair, secrets, simhash, toxicity, tree_bpe, warc
from tessella.llm.store import id_remainder

#: The conversation that tests the escapes.
ESCAPE_TEST = "\\### Assistant: </turn> ok"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages become ARC records, these WARC archives, and the archives are read back."""
    pages = table(spark, sf_dir, "pages")
    found = warc.read_warc(spark, warc.write_warc(warc.pages_as_arc(pages)))
    kind = pages.schema["page_id"].dataType
    key = F.when(F.col("source_key") != "", F.col("source_key")).cast(kind)
    return found.select(key.alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_key").cast(kind).alias("refers_to"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    test = spark.createDataFrame([(-7, 0, "user", ESCAPE_TEST), (-7, 1, "assistant", ESCAPE_TEST)], turns.schema)
    return chat.conversation_digests(chat.format_conversations(turns.unionByName(test)))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_severity(docs, toxicity.train_severity_model(docs, table(spark, sf_dir, "labels")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.apply_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder("doc_id", 4) == 2
    model = language.train_language_model(docs.where(~held_out))
    return language.identify_languages(docs, model).withColumn("held_out", held_out)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder("doc_id", 3) == 1
    model = quality.train_quality_model(quality.labelled_sample(docs, table(spark, sf_dir, "labels").where(~held_out), "quality", "doc_id", "text", max_train=8000))
    return quality.score_quality(docs, model).withColumn("held_out", held_out)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tree_bpe.decode_ids(tree_bpe.encode_texts(table(spark, sf_dir, "documents")))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repair.conversation_reports(repair.repair_conversations(repair.damage(table(spark, sf_dir, "conversations"))))
    return out.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc, op2_chat, op3_toxicity, op4_packing, op5_quality_rules, op6_secrets, op7_language, op8_quality, op9_decontamination, op10_simhash,
        op11_bpe, op12_repair, op13_divergence,
    )
}

_OP1 = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, strlen(html) AS payload_bytes, sha1(html) AS x, max(page_id) OVER (PARTITION BY sha1(html)) AS w FROM p),
b AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(x, CAST(i AS INT) * 5 + 1, 5))::BIGINT) AS n FROM d)
SELECT page_id, payload_bytes,
       list_reduce(list_transform(n, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> 15) & 31 AS INT) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> 10) & 31 AS INT) + 1, 1)
           || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> 5) & 31 AS INT) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v & 31 AS INT) + 1, 1)), lambda a, c: a || c) AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM w THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM w THEN w END AS refers_to
FROM b
"""

_OP2 = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
e AS (SELECT *, length(replace(replace(replace(text, '\\', '\\\\'), '###', '\\h'), '</turn>', '\\t')) AS inside FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(5 + length(role) + inside + 9) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

_OP9 = """
WITH d AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w, coalesce(text, '') AS text FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, list_slice(w, b, b + least(13, len(w)) - 1) AS g FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS b FROM i WHERE len(w) > 0)),
n AS (SELECT DISTINCT len(g) AS n FROM g),
o AS (SELECT k, b, n, list_slice(w, b, b + n - 1) AS g FROM (SELECT k, w, n, unnest(generate_series(1, len(w) - n + 1)) AS b FROM d, n WHERE len(w) >= n)),
m AS (SELECT k, b, n, item_id FROM o JOIN g USING (g)),
h AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(generate_series(b, b + n - 1)) AS p FROM m) GROUP BY k),
s AS (SELECT k, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM m GROUP BY k)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (k) LEFT JOIN s USING (k)
"""

#: The least cost of each state (no row yet or all deleted, a system row kept, a user's turn last, an assistant's last) is a text of nine digits and the
#: audit, so the lesser text is the lesser cost, then audit. A step takes one row; insertions of a user and then an assistant may follow it.
_OP12 = """
WITH RECURSIVE k AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
h AS (SELECT *, CAST(xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(key) + 1), lambda i: list_concat([ascii(substr(key, i, 1))::BIGINT], list_transform(range(8), lambda j: -1::BIGINT))))),
           lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END)) AS BIGINT) % 20 AS kind FROM k),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
      CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
o AS (SELECT *, row_number() OVER w AS i, lag(substr(role, 1, 1)) OVER w AS before, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS said,
      regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ends FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
f AS (SELECT *, CASE WHEN ends = '' THEN 'blank' WHEN said > 1 THEN 'duplicate' WHEN ends NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, substr(role, 1, 1) AS r FROM o),
c AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
      count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
e AS (SELECT conv_id, i, r, fault IN ('blank', 'duplicate') AS gone, CASE fault WHEN 'truncated' THEN 1 ELSE 0 END AS more FROM f),
s AS (SELECT conv_id, 0::BIGINT AS i, '000000000' AS a, NULL::VARCHAR AS b, '000000002I' AS o, '000000004II' AS v FROM c
      UNION ALL
      SELECT conv_id, i, a, b, o, least(v, step(o, 2, 'I')) AS v FROM (SELECT conv_id, i, a, b, least(o, step(a, 2, 'I'), step(b, 2, 'I'), step(v, 2, 'I')) AS o, least(v, step(o, 2, 'I')) AS v FROM (
      SELECT e.conv_id, e.i, step(s.a, 3, 'D') AS a, least(step(s.b, 3, 'D'), CASE WHEN NOT gone AND r = 's' THEN step(s.a, more, 'K') END) AS b,
             least(step(s.o, 3, 'D'), CASE WHEN NOT gone THEN step(least(s.a, s.b, s.v), 2 + more, 'R') END, CASE WHEN NOT gone AND r = 'u' THEN step(least(s.a, s.b, s.v), more, 'K') END) AS o,
             least(step(s.v, 3, 'D'), CASE WHEN NOT gone THEN step(s.o, 2 + more, 'R') END, CASE WHEN NOT gone AND r = 'a' THEN step(s.o, more, 'K') END) AS v
      FROM s JOIN e ON e.conv_id IS NOT DISTINCT FROM s.conv_id AND e.i = s.i + 1))),
best AS (SELECT s.conv_id, CAST(substr(least(a, v), 1, 9) AS BIGINT) AS cost, substr(least(a, v), 10) AS audit FROM s JOIN c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.n = s.i),
t AS (SELECT conv_id, p, substr(audit, p, 1) AS edit, p - length(replace(substr(audit, 1, p), 'I', '')) AS new FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM best)),
u AS (SELECT t.conv_id, p, edit, role, text FROM t LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM t.conv_id AND edit <> 'I' AND f.i = p - new WHERE edit <> 'D'),
z AS (SELECT *, row_number() OVER w AS place, first_value(edit || coalesce(substr(role, 1, 1), '')) OVER w = 'Ks' AS headed FROM u WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
m AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - headed::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS said FROM z GROUP BY conv_id)
SELECT q.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM q.conv_id
"""


def _with_steps(sql: str) -> str:
    """``step(x, cost, edit)``: a state's text after one more edit."""
    while (m := re.search(r"step\(((?:[^()]|\([^()]*\))*?), ([^,()]*), '(\w)'\)", sql)):
        x, cost, edit = m.groups()
        sql = f"{sql[: m.start()]}lpad(CAST(CAST(substr({x}, 1, 9) AS INT) + {cost} AS VARCHAR), 9, '0') || substr({x}, 10) || '{edit}'{sql[m.end() :]}"
    return sql


ORACLE_SQL: dict[str, str] = {"op12_repair": _with_steps(_OP12), "op13_divergence": divergence.oracle_sql(), "op1_warc": _OP1, "op2_chat": _OP2, "op5_quality_rules": quality_rules.oracle_sql(), "op9_decontamination": _OP9}
