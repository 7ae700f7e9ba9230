"""Secret scans: fixed patterns, and a guess-cost estimate for values in a credential context.

The estimate is a dynamic programme over the value: the cheapest segmentation into dictionary words, dates,
repeats, keyboard walks and brute-force spans, where a span's cost is the log10 of the guesses it takes and k spans may stand in
k! orders. A value that stays expensive is a secret, whatever it is called; a value that is words or walks is not. One pass
over each text, no shuffle.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: A value: between quotes up to the closing one on its line, if a mark that ends a string or no letter or digit follows in the word; else all up to a blank.
_VALUE = re.compile(r"""(["'])((?:\\[^\r\n]|(?!\1|\\)[^\r\n])+)\1(?=[,;:)\]}>]|/>|[!-/:-@\[-`{-~]*(?:[^!-~]|\Z))|["']?(\S+)""")
_NAMES = r"(?:password|passwd|passphrase|pass|pwd|auth|bearer|credentials?|access[-_\x20]?key|private[-_\x20]?key|client[-_\x20]?secret|secret|token|api[-_\x20]?key)"
#: The names of ``assign`` and more, with a mark of assignment (the value may stand on the next line), as an option or as an element; and the
#: schemes of an authorization header. Their values must also be hard to guess.
_CONTEXT = re.compile(
    rf"""{_NAMES}["']?[\x20\t]*(?::=|=>|[:=])[\x20\t]*(?:\r?\n[\x20\t]*)?|(?<!\S)--{_NAMES}[\x20\t]+|<(?P<element>{_NAMES})>"""
    r"""|\bbearer\x20+|\bauthorization["']?\x20*[:=]\x20*["']?(?:basic|digest|token|apikey)\x20+""", re.I | re.A)  # fmt: skip
_INSIDE = re.compile(r"[^<\r\n]+")
#: What stands between the user's name and the host of a URL. It holds no slash, so no part of a text is tried for two URLs.
_URL = re.compile(r"://[^\s/:@]*:([!-.0-~]{8,})@")
_QUICK = re.compile(r"pass|pwd|auth|bearer|credential|key|secret|token|://", re.I | re.A)

# Common words of passwords and placeholders, most guessed first.
COMMON_WORDS = (
    "password", "secret", "admin", "welcome", "login", "letmein", "master", "user", "guest", "test", "example", "changeme", "default", "sample",
    "token", "access", "private", "public", "server", "database", "hello", "dragon", "monkey", "football", "baseball", "sunshine", "princess",
    "shadow", "summer", "winter", "spring", "autumn", "computer", "internet", "service", "system", "root", "demo", "true", "false", "null", "none",
    "your", "here", "this", "that", "with", "from", "key", "pass", "word", "love", "house", "green", "horse", "staple", "battery", "correct",
)
# Rows of a keyboard.
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_NEXT = {(r[i], r[i + s]) for r in KEY_ROWS for i in range(len(r)) for s in (-1, 1) if 0 <= i + s < len(r)}
_PLAIN = str.maketrans("@4301$5!7", "aaeoissit")
_DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d")
_LONG_RUN = re.compile(r"(.{1,8}?)\1{32,}", re.S)


def default_words() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=4)
def ranked_words(path: str | None) -> tuple[dict[str, int], int]:
    """Rank of each dictionary word from 1, and the longest word's length: ``COMMON_WORDS``, then the whole words of four letters or
    more in the vocabulary of a tokenizer with word ends, whose ids follow how often a word was met. Without a path the first alone."""
    words = list(COMMON_WORDS)
    if path:
        with open(path, encoding="utf-8") as f:
            ids = json.load(f)["model"]["vocab"]
        found = (t[:-4] for t in sorted(ids, key=ids.get) if t.endswith("</w>") and len(t) >= 8)
        words += [w for w in found if w.isascii() and w.isalpha()]
    ranks: dict[str, int] = {}
    for w in words:
        ranks.setdefault(w, len(ranks) + 1)
    return ranks, max(map(len, ranks))


def _letters(value: str) -> float:
    """log10 guesses for each further character by brute force: the size of all classes of characters that the value has."""
    classes = (any(map(str.islower, value)), 26), (any(map(str.isupper, value)), 26), (any(map(str.isdigit, value)), 10), (not value.isalnum(), 33), (not value.isascii(), 100)
    return math.log10(sum(size for held, size in classes if held) or 1)


def guess_cost(value: str, words: str | None = "") -> float:
    """log10 of the guesses that the cheapest segmentation of the whole value takes; ``words`` is the path of a vocabulary, the default one if empty.

    A block of up to eight characters that comes more than 32 times in a row counts as 32 times, in values of any length.
    """
    return _least(value, math.inf, words)


def _takes(value: str, least_cost: float, words: str | None = "") -> bool:
    """Whether ``guess_cost`` is at least ``least_cost``; ends where no beginning of a segmentation costs less."""
    return _least(value, least_cost, words) >= least_cost


def _front(states: list[tuple[int, float]], most: float) -> list[tuple[int, float]]:
    """Of (spans, cost) those that no other has both at most; what costs ``most`` already goes."""
    out: list[tuple[int, float]] = []
    for k, cost in sorted(states):
        if (not out or cost < out[-1][1]) and cost + _orders(k) < most:
            out.append((k, cost))
    return out


@lru_cache(maxsize=1 << 16)
def _orders(k: int) -> float:
    return math.lgamma(k + 1) / math.log(10)  # log10 of k!


def spans_from(value: str, i: int, words: str | None) -> Iterator[tuple[int, float]]:
    """(end, cost) of every word, date, repeat, walk and run of codes that begins at ``i``; brute force is left to the caller."""
    ranks, longest = ranked_words(words)
    n, low = len(value), value.lower()
    plain, each = low.translate(_PLAIN), _letters(value)
    for j in range(i + 3, min(n, i + longest) + 1):
        rank = ranks.get(low[i:j]) or ranks.get(plain[i:j])
        if rank:
            upper = 1 + sum(c.isupper() for c in value[i:j])
            yield j, math.log10(rank + 1) + math.log10(upper) + (0 if low[i:j] in ranks else math.log10(4))
    for length in (4, 8, 9, 10):
        match = _DATE.fullmatch(value, i, i + length)
        if match:
            yield match.end(), math.log10(119) if length == 4 else math.log10(365 * 119)
    j = i + 1
    while j < n and value[j] == value[i]:
        j += 1
        if j - i >= 3:
            yield j, each + math.log10(j - i)
    j = i + 1
    while j < n and (low[j - 1], low[j]) in _NEXT:
        j += 1
        if j - i >= 3:
            yield j, math.log10(47 * 2) + math.log10(j - i)
    j = i + 1
    step = ord(value[j]) - ord(value[i]) if j < n else 0
    while step in (1, -1) and j < n and ord(value[j]) - ord(value[j - 1]) == step:
        j += 1
        if j - i >= 3:
            yield j, math.log10(36 * 2) + math.log10(j - i)
    for period in range(2, 9):  # a block that comes again at once
        j = i + period
        while j + period <= n and value[j : j + period] == value[i : i + period]:
            j += period
            yield j, period * each + math.log10((j - i) // period)


@lru_cache(maxsize=10_000)
def _least(value: str, most: float, words: str | None) -> float:
    """The least cost over all segmentations, or infinity if it is ``most`` or more.

    Beginnings of a segmentation that end at the same place differ by how many spans they have and what these cost; one with more of both can
    never become the cheapest. ``brute`` are those that end in a brute-force span, which grows by a character without being one more span.
    """
    path = default_words() if words == "" else words
    value = _LONG_RUN.sub(lambda m: m[1] * 32, value)
    n, each = len(value), _letters(value)
    ending: dict[int, list[tuple[int, float]]] = {0: [(0, 0.0)]}
    brute: list[tuple[int, float]] = []
    for at in range(n):
        states = _front(ending.pop(at, []) + brute, most)
        if not states:
            if not ending:
                return math.inf
            brute = []
            continue
        for end, cost in spans_from(value, at, path):
            ending.setdefault(end, []).extend((k + 1, c + cost) for k, c in states)
        brute = _front([(k, c + each) for k, c in brute] + [(k + 1, c + each) for k, c in states], most)
    return min((c + _orders(k) for k, c in _front(ending.pop(n, []) + brute, most)), default=math.inf)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start, then kind as listed."""
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8] if _QUICK.search(text) else []
    out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)] if "AKIA" in text else []
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _value_at(text: str, at: int, element: bool = False) -> tuple[int, int]:
    """(start, end) of the value whose opening quote or first character is at ``at``; without quotes, closing marks are not part of it. The value of an
    element ends where its end mark begins."""
    m = (_INSIDE if element else _VALUE).match(text, at)
    if not m:
        return at, at
    if element:
        return m.span()
    return m.span(2) if m[2] else (m.start(3), m.start(3) + len(m[3].rstrip("\"',;.)]}>")))


def guessed_spans(text: str, least_cost: float = 12.0, words: str | None = "") -> list[tuple[int, int, str]]:
    """Values in a credential context that take 10**least_cost guesses or more; none lies inside another. Values have eight characters
    or more; eight letters of one case alone never take 10**12 guesses."""
    if not _QUICK.search(text):
        return []
    values, at = [], 0
    while m := _CONTEXT.search(text, at):
        start, end = _value_at(text, m.end(), bool(m["element"]))
        values.append((start, end))
        at = end if end - start >= 8 else m.end()
    values += [(m.start(2), m.start(2) + len(m[2].rstrip("."))) for m in _ASSIGN.finditer(text)]
    values += [m.span(1) for m in _URL.finditer(text)] if "://" in text else []
    out, last = [], 0
    for start, end in sorted(set(values), key=lambda v: (v[0], -v[1])):
        if end - start >= 8 and end > last and _takes(text[start:end], least_cost, words):
            out.append((start, end, "guess"))
            last = end
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_cost: float = 12.0, words: str | None = "") -> DataFrame:
    """``id_col``, ``n_assign``, ``n_access``, ``n_hex``, ``base_spans`` and ``spans`` (all, joined) for every row of ``docs``.

    A null text has no spans. Offsets are code points, ends exclusive. Texts of any length are scanned whole, one after another.
    Repeated rows are scanned alike; only the id and the text are read; an empty table gives an empty one. The vocabulary's
    path (``words``) must be readable on the executors; with None the dictionary is ``COMMON_WORDS`` alone.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                text = value.as_py() or ""
                base = base_spans(text)
                every = sorted([*base, *guessed_spans(text, least_cost, words)], key=lambda s: (s[0], KINDS.index(s[2])))
                rows.append((*(sum(s[2] == k for s in base) for k in KINDS[:3]), joined(base), joined(every)))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])], names=["id", "n_assign", "n_access", "n_hex", "base_spans", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, f"id {rows.schema['id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_spans string, spans string").withColumnRenamed("id", id_col)


def redacted(text: str, mark: str = "[SECRET]", least_cost: float = 12.0, words: str | None = "") -> str:
    """The text with every span of a secret replaced; of an assignment only the value goes, to its last printable character."""
    cuts, last = [], 0
    for m in _ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 8 and m.end(2) > last:
            quoted = text[m.start(2) - 1] in "\"'"
            last = max(m.end(2), _value_at(text, m.start(2) - quoted)[1])
            cuts.append((m.start(2), last))
    cuts += [(s, e) for s, e, k in [*base_spans(text), *guessed_spans(text, least_cost, words)] if k != "assign"]
    out, at = [], 0
    for s, e in sorted(cuts):
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text_col: str = "text", least_cost: float = 12.0, words: str | None = "") -> DataFrame:
    """``docs`` with secrets in ``text_col`` replaced by a mark; all other columns and rows as they were.

    Null stays null, texts of any length are masked whole, an empty table gives an empty one. Of overlapping spans the union goes.
    """
    schema, at = docs.schema, docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(k, 256) for batch in batches for k in range(0, batch.num_rows, 256)):
            texts = pa.array([t if t is None else redacted(t, least_cost=least_cost, words=words) for t in part.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if k == at else c for k, c in enumerate(part.columns)], names=part.schema.names)

    return docs.mapInArrow(clean, schema)
