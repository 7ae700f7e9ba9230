"""How the sources of a language diverge in their words, audited exactly.

Terms of a language that enough documents have are its dictionary. It is cut, in UTF-8 order, into chunks of bounded size; inside
one, a term's id is its place in the chunk's sorted array, so (chunk, id) is the order of terms and ties need no strings.
Each (language, source) group has a dense vector of counts for each chunk. All measures are sums over chunks of whole numbers
computed from these vectors, so chunks are worked at side by side, and no task holds a language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.language import parts_of
from tessella.llm.store import stored

SCALE = 1_000_000_000
_TERM = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
_PART = 8_000_000  # bytes of text whose terms are held at once


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of slices of documents, and for each of their groups the empty term, which no document has."""
    for part, texts in (x for batch in batches for x in parts_of(batch, 2, _PART)):
        terms = [_TERM.findall(t.encode().lower()) for t in texts]
        size = np.fromiter(map(len, terms), np.int64, len(terms))
        encoded = pa.array([t for found in terms for t in found], pa.binary()).dictionary_encode()
        code, known = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(encoded.dictionary))
        names, group = np.unique(np.array(list(map(repr, zip(part.column(0).to_pylist(), part.column(1).to_pylist())))), return_inverse=True)
        first = np.zeros(names.size, np.int64)
        first[group[::-1]] = np.arange(len(texts))[::-1]
        held = np.unique(np.repeat(np.arange(len(texts)), size) * known + code)  # each document's terms once
        pair, n = np.unique(np.repeat(group, size) * known + code, return_counts=True)
        docs = np.unique(group[held // known] * known + held % known, return_counts=True)[1]
        at = np.concatenate([first, first[pair // known]])
        words = pa.concat_arrays([pa.array([b""] * names.size, pa.binary()), encoded.dictionary.take(pa.array(pair % known))]).cast(pa.string())
        none = np.zeros(names.size, np.int64)
        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at)), words, pa.array(np.concatenate([none, n])), pa.array(np.concatenate([none, docs]))], names=["lang", "source", "term", "n", "docs"])


def _chunks(batches: Iterator[pa.RecordBatch], least: int, size: int) -> Iterator[pa.RecordBatch]:
    """From rows in the order of (lang, term): each chunk's sorted terms, a row with them and a row with the counts of each source
    that has some; and a row of chunk -1 for each group."""
    task = TaskContext.get().partitionId() << 40  # ranges are in the order of partitions
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))

    def chunk(lang: str, number: int, terms: list[str], held: list[tuple[str, str, int]]) -> pa.RecordBatch:
        sources, source = np.unique(np.array([s for s, _, _ in held], object), return_inverse=True)
        ids = np.searchsorted(np.array(terms, object), np.array([t for _, t, _ in held], object))
        counts = np.bincount(source * len(terms) + ids, np.array([n for _, _, n in held], np.float64), sources.size * len(terms)).astype(np.int64).reshape(sources.size, -1)
        return _batch([(lang, task + number, None, terms, None, None, len(terms)), *((lang, task + number, s, None, c, int(c.sum()), None) for s, c in zip(sources, counts))])

    for lang, mine in groupby(rows, key=itemgetter(0)):
        number, terms, held = 0, [], []
        for term, found in groupby(mine, key=itemgetter(1)):
            each = list(found)  # one row a source
            if term == "":
                yield _batch([(lang, -1, source, None, None, 0, None) for _, _, source, _, _ in each])
            elif sum(docs for *_, docs in each) >= least:
                terms.append(term)
                held += [(source, term, n) for _, _, source, n, _ in each]
            if len(terms) == size:
                yield chunk(lang, number, terms, held)
                number, terms, held = number + 1, [], []
        if terms:
            yield chunk(lang, number, terms, held)


_CHUNK = "lang string, chunk long, source string, terms array<string>, counts array<long>, total long, size long"
_KINDS = (pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64(), pa.int64())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=["lang", "chunk", "source", "terms", "counts", "total", "size"])


def shares(counts: np.ndarray, of: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (counts + 2) / of), by long division in steps of a thousand: exact while ``of`` is under 9 * 10^15."""
    rest, out = counts + 2, np.zeros(counts.shape, np.int64)
    whole, rest = rest // of, rest % of
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // of
        rest = rest % of
    return 1 + whole * SCALE + out


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _measured(key: tuple, rows: pa.Table, ranks: int) -> pa.Table:
    """Of one chunk, with a row for each group of its language: the sum of every pair of sources, and each source's best terms."""
    order = np.argsort(np.array(rows.column("source").to_pylist(), object), kind="stable")
    rows = rows.take(pa.array(order))
    lang, chunk, size = key[0].as_py(), key[1].as_py(), rows.column("size")[0].as_py() or 0
    sources, totals, known = rows.column("source").to_pylist(), rows.column("total").to_numpy(), rows.column("kept").to_numpy()
    counts = np.zeros((len(sources), size), np.int64)
    having = np.flatnonzero(rows.column("counts").is_valid().to_numpy())
    if having.size:
        counts[having] = pc.list_flatten(rows.column("counts")).to_numpy().reshape(having.size, size)
    p = shares(counts, (totals + 2 * known)[:, None]) if size else counts
    found: list[tuple] = []
    for k in range(len(sources) - 1):
        sums = distances(p[k], p[k + 1 :]).sum(1)
        found += [(lang, "pair", sources[k], other, None, None, value) for other, value in zip(sources[k + 1 :], sums.tolist())]
    if size:
        all_counts, all_total = counts.sum(0), totals.sum()
        q = shares(all_counts, np.full(size, all_total + 2 * known[0]))
        for k, source in enumerate(sources):
            at = np.flatnonzero((counts[k] > 0) & (p[k] > q))
            value = distances(p[k, at], q[at])
            best = np.lexsort((at, -value))[:ranks]
            found += [(lang, "term", source, None, chunk, i, v) for i, v in zip(at[best].tolist(), value[best].tolist())]
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    return pa.table([pa.array(c, k) for c, k in zip(zip(*found) if found else [()] * 7, kinds)], names=["lang", "part", "source", "other", "chunk", "id", "value"])


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 10, ranks: int = 10, chunk_terms: int = 4096) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank`` for every (lang, source) group of ``docs``.

    Part ``pair``: the other sources of the language, by how far their shares of the kept terms are from the group's; all of them,
    with 0 where the language keeps no term. Part ``term``: the ``ranks`` kept terms that the group has and uses more than its
    language, by the same measure. Equal values are in UTF-8 order of the item. Null texts, languages and sources are empty
    texts; repeated rows are documents of their own; texts are read whole; an empty table gives an empty one; other columns are not read.
    Runs jobs at once: term counts of groups and the chunks' vectors are written to scratch.

    A task holds ``chunk_terms`` counts of each source of one language. The result has a row for each two sources of a language,
    so their number is bounded by the result's size.
    """
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    found = docs.select(*text).mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    terms = stored(found.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-terms")
    order = ("lang", "term", "source")
    vectors = stored(terms.repartitionByRange("lang", "term").sortWithinPartitions(*order).mapInArrow(lambda batches: _chunks(batches, least_docs, chunk_terms), _CHUNK), "divergence-chunks")
    totals = vectors.where("source is not null").groupBy("lang", "source").agg(F.sum("total").alias("total"))
    known = vectors.groupBy("lang").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("kept"))
    groups = totals.join(known, "lang")
    places = vectors.where("terms is not null").select("lang", "chunk", "size")
    none = known.select("lang", F.lit(-1).cast("long").alias("chunk"), F.lit(0).cast("long").alias("size"))  # where pairs of no term are made
    each = places.unionByName(none).join(groups, "lang").join(vectors.where("counts is not null").select("lang", "chunk", "source", "counts"), ["lang", "chunk", "source"], "left")
    measured = each.groupBy("lang", "chunk").applyInArrow(lambda key, rows: _measured(key, rows, ranks), "lang string, part string, source string, other string, chunk long, id long, value long")
    measured = stored(measured, "divergence-measured")
    sums = measured.where("part = 'pair'").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("source").alias("source"), F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item"))))
    pairs = sums.select("lang", both.alias("s"), "value").select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    best = measured.where("part = 'term'").withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "chunk", "id"))).where(F.col("rank") <= ranks)
    names = vectors.where("terms is not null").select("lang", "chunk", "terms")
    best = best.join(names, ["lang", "chunk"]).select("lang", "source", "part", F.col("terms")[F.col("id").cast("int")].alias("item"), "value", "rank")
    return pairs.unionByName(best)


def oracle_sql(least_docs: int = 10, ranks: int = 10) -> str:
    """The same over the table ``documents``, for DuckDB."""
    measure = "(p - q) * (p - q) // (p + q)"
    share = "1 + (1000000000 * ({c} + 2)::HUGEINT) // ({n} + 2 * v)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
o AS (SELECT k, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT k) >= {least_docs}),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(term) AS v FROM (SELECT DISTINCT lang FROM g) LEFT JOIN kept USING (lang) GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM o JOIN kept USING (lang, term) GROUP BY ALL),
a AS (SELECT g.lang, g.source, kept.term, coalesce(c, 0) AS c FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
n AS (SELECT *, sum(c) OVER (PARTITION BY lang, source) AS n, sum(c) OVER (PARTITION BY lang) AS all_n, sum(c) OVER (PARTITION BY lang, term) AS all_c FROM a),
p AS (SELECT lang, source, term, c, {share.format(c="c", n="n")} AS p, {share.format(c="all_c", n="all_n")} AS q FROM n JOIN v USING (lang)),
pair AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY ALL),
every_pair AS (SELECT g.lang, g.source, h.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g JOIN g h ON h.lang = g.lang AND h.source <> g.source
               LEFT JOIN pair ON pair.lang = g.lang AND pair.source = g.source AND pair.item = h.source),
term AS (SELECT lang, source, term AS item, CAST({measure} AS BIGINT) AS value FROM p WHERE c > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS INT) AS rank FROM every_pair
UNION ALL
SELECT lang, source, 'term', item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS INT) AS rank FROM term QUALIFY rank <= {ranks}
"""
