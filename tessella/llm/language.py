"""Language identification of mixed texts.

The scripts of a word narrow its candidate languages, a character-gram model scores the word under each
candidate, and a Viterbi pass with a switching penalty labels the words of the text, so a passage in
another language becomes a span of its own. Words of no learned language have a label too: it gives every gram one probability, less
than grams of a learned language have in its texts and more than those that it lacks, and takes words of a script that none has.
The text's language is the one that labels most letters.

The model is a sparse table of gram buckets by languages, of any number of languages, fitted on a bounded sample of
labelled rows (``per_language`` rows of each of the ``most_languages`` commonest languages, chosen by a hash of the id); counting runs on Spark,
and the driver receives the counts of grams that a language has, at most one a bucket.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


UNDETERMINED = "und"
BUCKETS = 1 << 15
_LETTERS = re.compile(r"[^\W\d_]+")
_SCORES = 1 << 20  # scores of words that are kept at once

# First code points of script ranges, and the script from there on.
SCRIPT_RANGES = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3130, "hangul"), (0x31A0, "other"), (0x31F0, "kana"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0xFF21, "latin"),
    (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"),
)
_STARTS = np.array([s for s, _ in SCRIPT_RANGES])
SCRIPTS = sorted({name for _, name in SCRIPT_RANGES})
_SCRIPT_OF = np.array([SCRIPTS.index(name) for _, name in SCRIPT_RANGES])


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    return _LETTERS.findall(text.lower())


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each between two marks (1), and where each word begins."""
    codes = np.frombuffer(("\x01" + "\x01\x01".join(words) + "\x01").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    return codes, np.cumsum(lengths) - lengths


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 2- and 3-grams (with word marks) of all words, and the word of each."""
    codes, starts = _codes(words)
    word = np.zeros(codes.size, np.int64)
    word[starts[1:]] = 1
    word = np.cumsum(word)
    two = (codes[:-1] * 1_000_003 + codes[1:]) * 2_654_435_761
    three = ((codes[:-2] * 1_000_003 + codes[1:-1]) * 1_000_003 + codes[2:]) * 2_246_822_519
    in2, in3 = word[:-1] == word[1:], word[:-2] == word[2:]
    buckets = np.concatenate([(two[in2] >> 13) & (BUCKETS - 1), (three[in3] >> 13) & (BUCKETS - 1)])
    return buckets, np.concatenate([word[:-1][in2], word[:-2][in3]])


def scripts_of(words: list[str]) -> np.ndarray:
    """The script of each word's last letter of the highest code point."""
    codes, starts = _codes(words)
    return _SCRIPT_OF[np.searchsorted(_STARTS, np.maximum.reduceat(codes, starts), side="right") - 1]


@dataclass
class LanguageModel:
    """Log probabilities of grams by language: ``floor`` of a gram that the language lacks, and of those that it has, by bucket
    (those of bucket b are ``begin[b]`` to ``begin[b + 1]``), the language and how much more than the floor."""

    languages: list[str]
    prior: np.ndarray  # log share of each language
    floor: np.ndarray
    begin: np.ndarray
    language: np.ndarray
    more: np.ndarray
    allowed: np.ndarray  # scripts x languages
    penalty: float = 12.0
    unknown: float = -np.inf  # log probability of every gram under no learned language

    def gram_scores(self, words: list[str]) -> np.ndarray:
        """words x languages: the sums of the log probabilities of each word's grams."""
        buckets, word = grams(words)
        n = len(self.languages)
        size = self.begin[buckets + 1] - self.begin[buckets]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.begin[buckets], size)
        above = np.bincount(np.repeat(word, size) * n + self.language[at], self.more[at], len(words) * n).reshape(-1, n)
        return above + np.bincount(word, minlength=len(words))[:, None] * self.floor

    def word_scores(self, words: list[str]) -> np.ndarray:
        """words x (languages, then none of them): the grams' log probabilities over the best label's; a large loss outside the candidates."""
        if not words:
            return np.zeros((0, len(self.languages) + 1))
        step = max(1, _SCORES // (8 * len(self.languages)))
        scores = np.concatenate([self.gram_scores(words[k : k + step]) for k in range(0, len(words), step)])
        allowed = self.allowed[scripts_of(words)]
        scores = np.where(allowed, scores, -np.inf)
        none = self.unknown * np.array([2 * len(w) + 1 for w in words], np.float64)  # a word's grams
        top = np.maximum(scores.max(1, initial=-np.inf), none)
        lost = np.where(np.isfinite(top), top, 0.0)[:, None]
        scores = np.where(allowed, np.maximum(scores - lost, -30.0), np.where(allowed.any(1, keepdims=True), -60.0, -30.0))
        return np.column_stack([scores, np.where(allowed.any(1), np.maximum(none - lost[:, 0], -30.0), 0.0)])

    def start(self) -> np.ndarray:
        """The labels' log shares before any word: no learned language is as likely as the rarest of them."""
        return np.append(self.prior, self.prior.min(initial=0.0))


def viterbi(scores: np.ndarray, lengths: np.ndarray, prior: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word of many texts at once. scores: the words of all texts one after another."""
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    starts, sizes = starts[order], lengths[order]
    live = np.searchsorted(-sizes, -np.arange(1, int(sizes.max(initial=0)) + 1), side="right")  # texts with over t words
    back = np.zeros(scores.shape, np.uint8 if scores.shape[1] < 256 else np.int32)
    labels = np.zeros(scores.shape[0], np.int64)
    at = np.tile(prior, (lengths.size, 1))
    own = np.arange(scores.shape[1])
    for t, k in enumerate(live.tolist()):
        v = at[:k]
        if t:
            best = v.argmax(1)
            jump = v[np.arange(k), best][:, None] - penalty
            switch = v < jump
            back[starts[:k] + t] = np.where(switch, best[:, None], own)
            v = np.where(switch, jump, v)
        at[:k] = v + scores[starts[:k] + t]
    state = at.argmax(1)
    for t in range(live.size - 1, -1, -1):
        rows = starts[: live[t]] + t
        labels[rows] = state[: live[t]]
        if t:
            state[: live[t]] = back[rows, state[: live[t]]]
    return labels


class Identifier:
    """Labels texts; keeps the scores of words already met, about ``_SCORES`` of them."""

    def __init__(self, model: LanguageModel):
        self.model, self.rows, self.table = model, {}, np.zeros((0, len(model.languages) + 1), np.float32)

    def _labelled(self, texts: list[str]) -> list[tuple[list[str], np.ndarray, np.ndarray]]:
        split = [words_of(t) for t in texts]
        if len(self.rows) * len(self.model.languages) > _SCORES:
            self.rows, self.table = {}, self.table[:0]
        rows = self.rows
        fresh = list({w for words in split for w in words if w not in rows})
        if fresh:
            rows.update(zip(fresh, range(len(rows), len(rows) + len(fresh))))
            self.table = np.concatenate([self.table, self.model.word_scores(fresh).astype(np.float32)])
        lengths = np.array([len(w) for w in split], np.int64)
        index = np.fromiter((rows[w] for words in split for w in words), np.int64, int(lengths.sum()))
        labels = viterbi(self.table[index], lengths, self.model.start(), self.model.penalty)
        edges = np.cumsum(lengths)[:-1]
        return list(zip(split, np.split(labels, edges), np.split(index, edges)))

    def label(self, texts: list[str]) -> list[tuple[list[str], np.ndarray]]:
        """The words of each text and their labels; the label after the last language is that of none."""
        return [(words, labels) for words, labels, _ in self._labelled(texts)]

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """The language of each text, and how sure that is: its share of all letters, times its probability among all labels by the words
        that it labels. A text of no learned language has the one that its words are least unlike, with a score of 0."""
        known = len(self.model.languages)
        if not known:
            return [(UNDETERMINED, 0.0)] * len(texts)
        out = []
        for words, labels, index in self._labelled(texts):
            if not any(c.isalpha() for w in words for c in w):  # numerals like a superscript are no letters
                out.append((UNDETERMINED, 0.0))
                continue
            letters = np.bincount(labels, np.fromiter(map(len, words), np.int64, len(words)), known + 1)
            best = int(letters[:known].argmax())
            if not letters[best]:
                out.append((self.model.languages[int(self.table[index, :known].sum(0).argmax())], 0.0))
                continue
            sums = self.table[index[labels == best]].sum(0, dtype=np.float64)
            sure = 1 / np.exp(np.minimum(sums - sums[best], 700)).sum()
            out.append((self.model.languages[best], float(letters[best] / letters.sum() * sure)))
        return out


def spans(words: list[str], labels: np.ndarray, languages: list[str]) -> list[tuple[int, int, str]]:
    """(first word, end, language) of each run of one label; ``und`` where it is no learned language."""
    if not words:
        return []
    edges = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(words)]
    return [(s, e, [*languages, UNDETERMINED][labels[s]]) for s, e in zip(edges, edges[1:])]


def _count(batches: Iterator[pa.RecordBatch], held: int = 64) -> Iterator[pa.RecordBatch]:
    """(lang, kind, bucket, n): gram counts, and letters by script, of each language in this task; at most ``held`` languages are kept at once."""
    total: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for lang, counts in total.items():
            for kind, n in enumerate(counts):
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * at.size, pa.string()), pa.array([kind] * at.size, pa.int32()), pa.array(at, pa.int32()), pa.array(n[at])], names=["lang", "kind", "bucket", "n"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            words = words_of(text or "")
            if lang not in total:
                if len(total) >= held:
                    yield from told()
                    total.clear()
                total[lang] = (np.zeros(BUCKETS, np.int64), np.zeros(len(SCRIPTS), np.int64))
            for at in range(0, len(words), 1 << 16):
                part = words[at : at + (1 << 16)]
                total[lang][0][:] += np.bincount(grams(part)[0], minlength=BUCKETS)
                total[lang][1][:] += np.bincount(scripts_of(part), minlength=len(SCRIPTS))
    yield from told()


def train_language_model(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", per_language: int = 4000, penalty: float = 12.0,
                         most_languages: int = 1000, edge: float = 0.4) -> LanguageModel:
    """Fit on about ``per_language`` rows of each language, of the ``most_languages`` with the most rows. ``edge`` says where no learned language
    begins: so far down from the mean log probability of a language's own grams to that of a gram that it lacks.

    Rows with a null text or language teach nothing; without any labelled row, as with an empty table, the model has no
    language. Repeated ids are all in the sample or all not.
    """
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(key_col).cast("string"), F.lit("")).alias("key")).where("lang is not null and text is not null")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "lang").limit(most_languages).toPandas()
    languages, size = sizes["lang"].tolist(), sizes["size"].to_numpy(np.int64)
    if not languages:
        return LanguageModel([], np.zeros(0), np.zeros(0), np.zeros(BUCKETS + 1, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros((len(SCRIPTS), 0), bool), penalty)
    shares = labelled.sparkSession.createDataFrame(list(zip(languages, np.minimum(1.0, per_language / size).tolist())), "lang string, share double")
    part = F.xxhash64(F.lit("lang"), "key").cast("double") / 2.0**64 + 0.5  # even over 0 to 1, so a share of any smallness keeps its rows
    sample = rows.join(F.broadcast(shares), "lang").where((part < F.col("share")) | (F.col("share") == 1)).select("lang", "text")  # a row for each language, as in the model
    counts = sample.mapInArrow(_count, "lang string, kind int, bucket int, n long").groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    code = np.searchsorted(np.sort(languages), counts.column("lang").to_pylist()) if counts.num_rows else np.zeros(0, np.int64)
    code = np.argsort(languages)[code]  # the place of each row's language in ``languages``
    kind, bucket, n = (counts.column(c).to_numpy() for c in ("kind", "bucket", "n"))
    script = np.zeros((len(SCRIPTS), len(languages)))
    script[bucket[kind == 1], code[kind == 1]] = n[kind == 1]
    order = np.argsort(bucket[kind == 0], kind="stable")
    bucket, language, n = bucket[kind == 0][order], code[kind == 0][order], n[kind == 0][order]
    total = np.bincount(language, n, len(languages)) + 0.5 * BUCKETS
    begin = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=BUCKETS))]).astype(np.int64)
    floor, more, grams_of = np.log(0.5 / total), np.log((n + 0.5) / 0.5), np.bincount(language, n, len(languages))
    above = np.bincount(language, n * more, len(languages)) / grams_of.clip(1)  # of a language's own grams over its floor, on average
    taught = grams_of > 0
    unknown = float((floor + (1 - edge) * above)[taught].mean()) if taught.any() else -np.inf
    return LanguageModel(languages, np.log(size / size.sum()), floor, begin, language, more, script >= 0.01 * script.sum(0, keepdims=True).clip(1), penalty, unknown)


def parts_of(batch: pa.RecordBatch, column: int, most: int = 2_500_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """A batch in slices with their texts, of about ``most`` bytes of text or one row each, so only so much is held as Python strings."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), most, side="right")) + at)
        part = batch.slice(at, end - at)
        yield part, [t or "" for t in part.column(column).to_pylist()]
        at = end


def identify_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred``, ``score`` (the share of letters labelled so, times how sure that language is) for every row of ``docs``.

    A null text or one without letters is ``und`` with score 0, as is every text under a model of no language. A text of no learned language
    has the learned one that it is least unlike, with a score near 0.
    Equal shares go to the language with more training rows. Texts of any length are read whole, repeated rows are labelled
    alike, and an empty table gives an empty one. Only the id and the text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifier = Identifier(shared.value)
        for part, texts in (x for batch in batches for x in parts_of(batch, 1)):
            out = identifier.predict(texts)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([p for p, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], names=["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(label, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text", least: float = 0.35) -> DataFrame:
    """The rows of ``docs``, all their columns, whose language is known: not ``und``, and with a score of ``least`` or more. Texts in a script or in
    words of no learned language are rejected.

    Null texts and texts without letters are rejected; under a model of no language every row is. Texts of any length are read
    whole. Repeated rows are judged alike; an empty table gives an empty one. No shuffle.
    """
    shared, schema = docs.sparkSession.sparkContext.broadcast(model), docs.schema
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifier = Identifier(shared.value)
        for part, texts in (x for batch in batches for x in parts_of(batch, at)):
            kept = [lang != UNDETERMINED and share >= least for lang, share in identifier.predict(texts)]
            yield part.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(keep, schema)
