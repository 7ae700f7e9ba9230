"""Quality rules: a threshold table compiled into one projection of built-in functions.

Every count is an expression over the text of its own row, so the whole filter is a narrow projection: no
shuffle, no Python on the executors. Rules compare integers (``a * scale op b * limit``), so they mean the same in any engine.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
_SPACE = "\\x20\\x09-\\x0D"
_SYMBOLS = "[#*$%&|<>]"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "this", "are", "from", "or", "an", "at",
    "der", "die", "das", "und", "ist", "von", "zu", "den", "mit", "sich", "des", "auf", "für", "im", "dem", "nicht", "ein", "eine", "als",
    "le", "la", "les", "de", "et", "des", "du", "en", "un", "une", "que", "est", "pour", "dans", "qui", "par", "sur", "pas", "au",
    "el", "los", "las", "y", "del", "se", "por", "con", "no", "su", "al", "lo", "para", "como", "más", "una", "es",
)


@dataclass(frozen=True)
class Rule:
    """The document passes if ``left * left_scale op right * right_scale`` (op is >= or <=)."""

    name: str
    left: str
    op: str
    right: str
    left_scale: int = 100
    right_scale: int = 1

    def passes(self) -> Column:
        a, b = F.col(self.left) * F.lit(self.left_scale), F.col(self.right) * F.lit(self.right_scale)
        return a >= b if self.op == ">=" else a <= b


RULES = (
    Rule("words long enough", "word_chars", ">=", "n_words", 100, 200),
    Rule("words short enough", "word_chars", "<=", "n_words", 100, 1500),
    Rule("few symbols", "n_symbols", "<=", "n_words", 100, 20),
    Rule("few exclamations", "n_exclaims", "<=", "n_words", 100, 20),
    Rule("some stop words", "n_stop_words", ">=", "n_words", 100, 2),
    Rule("few repeated lines", "n_dup_lines", "<=", "n_lines", 100, 40),
)


def _repeat_words(words: Column) -> Column:
    """Words inside 8-word windows that occur twice or more in the same text.

    Equal windows have equal 64-bit hashes, so a text whose hashes are all distinct has no repeats, which settles
    most texts at once. In the others, windows are sorted by two independent 64-bit hashes, equal neighbours give the
    repeated positions, and the words they cover are summed over the sorted positions: n log n in the text's length.
    """
    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    quick = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    keyed = F.transform(starts, lambda i: F.struct(F.xxhash64(F.slice(words, i, WINDOW)).alias("a"), F.xxhash64(F.lit(1), F.slice(words, i, WINDOW)).alias("b"), i.alias("i")))
    n = F.size(words)
    return F.when(n <= WINDOW, 0).when(F.size(F.array_distinct(quick)) == n - (WINDOW - 1), 0).otherwise(_bound(F.sort_array(keyed), _covered)).cast("long")


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _covered(keyed: Column) -> Column:
    """How many words the windows cover that equal a neighbour among the sorted (a, b, i)."""
    nothing = F.array(F.lit(None).cast("struct<a:bigint,b:bigint,i:int>"))
    pairs = F.zip_with(keyed, F.concat(F.slice(keyed, 2, F.size(keyed)), nothing), lambda x, y: F.when((x["a"] == y["a"]) & (x["b"] == y["b"]), F.array(x["i"], y["i"])))
    at = F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))
    start = F.struct(F.lit(0).alias("n"), F.lit(1).alias("end"))
    step = lambda s, p: F.struct((s["n"] + p + WINDOW - F.greatest(p, s["end"])).alias("n"), (p + WINDOW).alias("end"))
    return F.aggregate(at, start, step, lambda s: s["n"])


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts that rules may use, one row per row of ``docs``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    split = base.select("id", "text", F.array_remove(F.split("text", f"[{_SPACE}]+"), "").alias("words"), F.split("text", "\n").alias("lines"))
    split = split.withColumn("lines", F.filter("lines", lambda x: x.rlike(f"[^{_SPACE}]")))
    stops = F.filter("words", lambda w: F.lower(F.rtrim(w, F.lit(".,!?;:"))).isin(*STOP_WORDS))
    return split.select(
        F.col("id").alias(id_col), F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), _repeat_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"), F.size(stops).cast("long").alias("n_stop_words"), (F.length("text") - F.length(F.replace("text", F.lit("!"), F.lit("")))).cast("long").alias("n_exclaims"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts of every row of ``docs`` with ``base_failed``, ``failed_rules`` (names) and ``kept``.

    A null text counts as empty: no words, so it fails the base. Repeated rows are judged alike; an empty table gives
    an empty one; only the id and the text are read. Windows are compared by 128 bits of hash.
    """
    failed = F.filter(F.array(*[F.when(~r.passes(), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull()) if rules else F.array().cast("array<string>")
    out = text_counts(docs, id_col, text_col).withColumns({"base_failed": base_failed(), "failed_rules": failed})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def rules_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The table as a SQL condition over the same counts."""
    return " AND ".join(f"({r.left} * {r.left_scale} {r.op} {r.right} * {r.right_scale})" for r in rules) or "true"


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for the same rows over a view ``documents``."""
    space, stops = r"[\x20\x09-\x0D]", ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    return rf"""
    WITH t AS (SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS text FROM documents),
    s AS (SELECT *, list_filter(regexp_split_to_array(text, '{space}+'), lambda w: w <> '') AS words,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
    w AS (SELECT k, i, list_slice(words, i, i + {WINDOW - 1}) AS g FROM (SELECT k, words, unnest(generate_series(1, len(words) - {WINDOW - 1})) AS i FROM s WHERE len(words) > {WINDOW - 1})),
    r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM w) WHERE n > 1),
    c AS (SELECT k, count(DISTINCT i + j) AS n_repeat_words FROM r, (SELECT unnest(range({WINDOW})) AS j) GROUP BY k),
    f AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
                 length(text) - length(regexp_replace(text, '{_SYMBOLS}', '', 'g')) AS n_symbols,
                 len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
                 len(list_filter(words, lambda w: lower(rtrim(w, '.,!?;:')) IN ({stops}))) AS n_stop_words,
                 length(text) - length(replace(text, '!', '')) AS n_exclaims
          FROM s LEFT JOIN c USING (k)),
    v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {rules_sql(rules)} AS kept FROM v
    """
