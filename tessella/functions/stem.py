"""English words: stop words and the suffix stemmer published as Porter 2, as a helper for Arrow passes and as SQL."""

from __future__ import annotations

import re
from functools import lru_cache

# The stop words of English full-text search.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them
    their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an
    the and but if or because as until while of at by for with about against between into through during before after above below to from up down
    in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only
    own same so than too very s t can will just don should now""".split()
)
# Words with a stem of their own, and words that stay as they are, at once or after plural endings are gone.
OWN_STEMS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", **{w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")},
}
KEPT_LATER = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
# Suffixes of the later steps and what replaces them; of those that fit, the longest counts.
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate",
    "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = dict.fromkeys("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split(), "")
BEFORE = {"li": "cdeghkmnrt", "ogi": "l", "ion": "st"}  # letters of which one must stand before the suffix

_REGION = re.compile(r"(?:gener|commun|arsen|[^aeiouy]*[aeiouy]+[^aeiouy])")
_PLAIN_REGION = re.compile(r"[^aeiouy]*[aeiouy]+[^aeiouy]")
_VOWEL = re.compile("[aeiouy]")
_ENDING = re.compile(r"(eedly|eed|ingly|edly|ing|ed)$")
_DOUBLE = re.compile(r"(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _short_end(word: str) -> bool:
    """Ends in a short syllable: a vowel between others and a letter that is not w, x or a consonant y, or one of both at the start."""
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", word) or re.fullmatch(r"[aeiouy][^aeiouy]", word))


def _replaced(word: str, rules: dict[str, str], least: dict[str, int], otherwise: int) -> str:
    """The longest fitting suffix replaced, if it begins at its region or later and after a letter that it asks for."""
    if not word.endswith(tuple(rules)):  # most words, told at once
        return word
    for size in range(min(7, len(word)), 1, -1):
        suffix = word[-size:]
        if suffix in rules:
            rest = word[:-size]
            fits = len(rest) >= least.get(suffix, otherwise) and (suffix not in BEFORE or rest[-1:] != "" and rest[-1:] in BEFORE[suffix])
            return rest + rules[suffix] if fits else word
    return word


@lru_cache(maxsize=1 << 17)
def stem(word: str) -> str:
    """The stem of a word in lower case."""
    if len(word) <= 2:
        return word
    if word in OWN_STEMS:
        return OWN_STEMS[word]
    if "y" in word:
        word = re.sub("([aeiouy])y", r"\1Y", re.sub("^y", "Y", word))
    first = m.end() if (m := _REGION.match(word)) else len(word)
    second = m.end() if (m := _PLAIN_REGION.match(word, first)) else len(word)
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _VOWEL.search(word[:-2]):
        word = word[:-1]
    if word in KEPT_LATER:
        return word
    ending = _ENDING.search(word) if word.endswith(("ed", "ing", "ly")) else None
    if ending and ending[1] in ("eed", "eedly"):
        word = word[: ending.start()] + "ee" if ending.start() >= first else word
    elif ending and _VOWEL.search(word[: ending.start()]):
        word = word[: ending.start()]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _DOUBLE.search(word):
            word = word[:-1]
        elif len(word) <= first and _short_end(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    word = _replaced(word, STEP_2, {}, first)
    word = _replaced(word, STEP_3, {"ative": second}, first)
    word = _replaced(word, STEP_4, {}, second)
    if word.endswith("e") and (len(word) > second or len(word) > first and not _short_end(word[:-1])):
        word = word[:-1]
    elif word.endswith("ll") and len(word) > second:
        word = word[:-1]
    return word.lower()


def stems_sql(words: str) -> str:
    """CTEs for DuckDB that end in ``stems`` (w, stem), of the distinct words ``w`` of the table ``words``."""
    quoted = lambda names: ", ".join(f"'{n}'" for n in names)
    short_end = lambda x: f"regexp_matches({x}, '[^aeiouy][aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$')"

    def step(rules: dict[str, str], region: str, other: dict[str, str]) -> str:
        cases = []
        for suffix in sorted(rules, key=lambda s: -len(s)):
            rest = f"left(x, length(x) - {len(suffix)})"
            fits = f"length(x) - {len(suffix)} >= {other.get(suffix, region)}" + (f" AND regexp_matches({rest}, '[{BEFORE[suffix]}]$')" if suffix in BEFORE else "")
            cases.append(f"WHEN ends_with(x, '{suffix}') THEN CASE WHEN {fits} THEN {rest} || '{rules[suffix]}' ELSE x END")
        return f"CASE WHEN done THEN x {' '.join(cases)} ELSE x END"

    own = " ".join(f"WHEN '{w}' THEN '{s}'" for w, s in OWN_STEMS.items())
    ending = "regexp_extract(x, '(eedly|eed|ingly|edly|ing|ed)$', 1)"
    return f"""m0 AS (SELECT w, CASE WHEN length(w) <= 2 THEN w ELSE CASE w {own} END END AS own, regexp_replace(regexp_replace(w, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS x FROM (SELECT DISTINCT w FROM {words})),
m1 AS (SELECT *, own IS NOT NULL AS done, CASE WHEN regexp_matches(x, '^(gener|commun|arsen|[^aeiouy]*[aeiouy]+[^aeiouy])') THEN length(regexp_extract(x, '^(gener|commun|arsen|[^aeiouy]*[aeiouy]+[^aeiouy])')) ELSE length(x) END AS r1 FROM m0),
m2 AS (SELECT *, r1 + CASE WHEN regexp_matches(substr(x, r1 + 1), '^[^aeiouy]*[aeiouy]+[^aeiouy]') THEN length(regexp_extract(substr(x, r1 + 1), '^[^aeiouy]*[aeiouy]+[^aeiouy]')) ELSE length(x) - r1 END AS r2 FROM m1),
m3 AS (SELECT * REPLACE (CASE WHEN ends_with(x, 'sses') THEN left(x, length(x) - 2) WHEN ends_with(x, 'ied') OR ends_with(x, 'ies') THEN left(x, length(x) - CASE WHEN length(x) > 4 THEN 2 ELSE 1 END)
  WHEN ends_with(x, 's') AND NOT ends_with(x, 'us') AND NOT ends_with(x, 'ss') AND regexp_matches(left(x, length(x) - 2), '[aeiouy]') THEN left(x, length(x) - 1) ELSE x END AS x) FROM m2),
m4 AS (SELECT * REPLACE (done OR x IN ({quoted(KEPT_LATER)}) AS done), {ending} AS e FROM m3),
m5 AS (SELECT * REPLACE (CASE WHEN done OR e = '' THEN x WHEN e IN ('eed', 'eedly') THEN CASE WHEN length(x) - length(e) >= r1 THEN left(x, length(x) - length(e)) || 'ee' ELSE x END
  WHEN regexp_matches(left(x, length(x) - length(e)), '[aeiouy]') THEN left(x, length(x) - length(e)) ELSE x END AS x), x AS old FROM m4),
m6 AS (SELECT * REPLACE (CASE WHEN done OR x = old OR e IN ('eed', 'eedly') THEN x WHEN regexp_matches(x, '(at|bl|iz)$') THEN x || 'e' WHEN regexp_matches(x, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(x, length(x) - 1)
  WHEN length(x) <= r1 AND {short_end("x")} THEN x || 'e' ELSE x END AS x) FROM m5),
m7 AS (SELECT * REPLACE (CASE WHEN NOT done AND regexp_matches(x, '.[^aeiouy][yY]$') THEN left(x, length(x) - 1) || 'i' ELSE x END AS x) FROM m6),
m8 AS (SELECT * REPLACE ({step(STEP_2, "r1", {})} AS x) FROM m7),
m9 AS (SELECT * REPLACE ({step(STEP_3, "r1", {"ative": "r2"})} AS x) FROM m8),
m10 AS (SELECT * REPLACE ({step(STEP_4, "r2", {})} AS x) FROM m9),
m11 AS (SELECT * REPLACE (CASE WHEN done THEN x WHEN ends_with(x, 'e') AND (length(x) > r2 OR length(x) > r1 AND NOT {short_end("left(x, length(x) - 1)")}) THEN left(x, length(x) - 1)
  WHEN ends_with(x, 'll') AND length(x) > r2 THEN left(x, length(x) - 1) ELSE x END AS x) FROM m10),
stems AS (SELECT w, coalesce(own, lower(x)) AS stem FROM m11)"""
