"""Full-text search: stemmed words with their places, requests of words, "phrases", ``or`` and ``-not``, and cover-density rank.

An index is a table of (term, id, at): a stem, a row and the places of the stem among the row's words, stop words counted as places.
Requests are a table too. They are parsed into clauses (``or`` of ``and``), their stems are joined to the index, what was found is brought together
for each (request, row), and a small function says whether the row matches and how densely. So any number of requests is one plan: a join on
the stem and one shuffle by (request, row); no row without a stem of a request leaves the index, and no request sees a whole text.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.stem import STOP_WORDS, stem

Term = tuple[str, int]  # a stem, and its distance from the first of its phrase
Literal = tuple[bool, tuple[Term, ...]]  # whether it is denied, and its terms
Clause = tuple[Literal, ...]

ANY_ROW = ""  # the term that every row has; its place is the number of the row's words
#: Fixed value: what one cover of neighbouring terms counts.
WEIGHT = 0.1
_WORD = re.compile(r"[^\W_]+")
_PIECE = re.compile(r'(-*)(?:"([^"]*)"?|([^\s"]+))')
SLICE = 4_000_000  # bytes of text whose words are held at once
JUDGED = 1000  # (request, row)s that are told at once


def words(text: str) -> list[str]:
    """Runs of letters and digits, in lower case."""
    return _WORD.findall(text.lower())


def phrase(text: str) -> tuple[Term, ...]:
    """The stems of a text with their distances from the first; stop words are left out but keep their place."""
    found = [(stem(w), k) for k, w in enumerate(words(text)) if w not in STOP_WORDS]
    return tuple((s, k - found[0][1]) for s, k in found)


def parse(request: str) -> tuple[Clause, ...]:
    """The clauses of a request, any of which a row must fulfil. Words beside each other are all asked for; what stands in quotes, or is one piece of
    several words, is a phrase; ``-`` before either denies it; ``or`` outside quotes begins another clause. Pieces of stop words alone ask for nothing; a
    request of nothing else has no clause and matches no row."""
    clauses: list[list[Literal]] = [[]]
    for minus, quoted, plain in _PIECE.findall(request):
        if plain.lower() == "or" and not minus:
            clauses.append([])
        elif terms := phrase(quoted or plain):
            clauses[-1].append((bool(minus), terms))
    return tuple(dict.fromkeys(tuple(dict.fromkeys(c)) for c in clauses if c))


def fallback(request: str) -> str:
    """The request that any of its pieces fulfils."""
    return " or ".join(request.split())


def occurrences(terms: tuple[Term, ...], found: dict[str, list[int]]) -> list[tuple[int, int]]:
    """(first, last place) of every occurrence of a phrase, in order."""
    starts = None
    for term, distance in terms:
        mine = {p - distance for p in found.get(term, ())}
        starts = mine if starts is None else starts & mine
        if not starts:
            return []
    return [(s, s + terms[-1][1]) for s in sorted(starts or ())]


def covers(clauses: tuple[Clause, ...], found: dict[str, list[int]]) -> list[tuple[int, int]]:
    """The least intervals of places that fulfil a clause, in order: none holds another. What is denied plays no part."""
    intervals: list[tuple[int, int]] = []
    for clause in clauses:
        asked = [occurrences(terms, found) for denied, terms in clause if not denied]
        if not asked or not all(asked):
            continue
        for last in sorted({e for hits in asked for _, e in hits}):
            firsts = []
            for hits in asked:  # of one phrase, firsts and lasts are in the same order
                at = bisect_right(hits, last, key=lambda h: h[1])
                if not at:
                    break
                firsts.append(hits[at - 1][0])
            else:
                intervals.append((min(firsts), last))
    least: list[tuple[int, int]] = []
    for first, last in sorted(set(intervals), key=lambda i: (i[1], -i[0])):
        if not least or first > least[-1][0]:
            least.append((first, last))
    return least


def density(clauses: tuple[Clause, ...], found: dict[str, list[int]]) -> float:
    """The covers' weights, each divided by one more than the places in it that no asked term takes."""
    asked = {t for clause in clauses for denied, terms in clause if not denied for t, _ in terms}
    places = sorted({p for t in asked for p in found.get(t, ())})
    score = 0.0
    for first, last in covers(clauses, found):
        taken = bisect_right(places, last) - bisect_left(places, first)
        score += WEIGHT / (1 + last - first + 1 - taken)
    return score


def fulfilled(clauses: tuple[Clause, ...], found: dict[str, list[int]]) -> bool:
    return any(all(denied != bool(occurrences(terms, found)) for denied, terms in clause) for clause in clauses)


def slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """The ids and texts of a batch, in parts of ``SLICE`` bytes of text or one row."""
    size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).cumsum()
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(size.searchsorted((size[at - 1] if at else 0) + SLICE, side="right")))
        part = batch.slice(at, end - at)
        yield part.column(0), part.column(1).to_pylist()
        at = end


def index(docs: DataFrame, id_col: str, text_col: str, wanted: frozenset[str] | None = None) -> DataFrame:
    """``term``, ``id``, ``at`` (sorted places from 1) of every stem of every row and the term ``ANY_ROW`` of every row, or of those terms that are ``wanted``.

    A null text has no words. Texts are read whole. Ids are unique: of repeated ids each row is told, as if one row held the texts of
    all side by side. Stays where the rows are: no shuffle.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in slices(batch):
                row, term, places = [], [], []
                for k, text in enumerate(texts):
                    found: dict[str, list[int]] = {}
                    place = 0
                    for place, word in enumerate(words(text or ""), 1):
                        if word not in STOP_WORDS:
                            found.setdefault(stem(word), []).append(place)
                    if wanted is not None:
                        found = {t: p for t, p in found.items() if t in wanted}
                    if wanted is None or ANY_ROW in wanted:
                        found[ANY_ROW] = [place]
                    row += [k] * len(found)
                    term += found
                    places += found.values()
                yield pa.RecordBatch.from_arrays([pa.array(term, pa.string()), ids.take(pa.array(row, pa.int64())), pa.array(places, pa.list_(pa.int32()))], names=["term", "id", "at"])

    return rows.mapInArrow(told, f"term string, id {rows.schema['id'].dataType.simpleString()}, at array<int>")


def asked_terms(requests: DataFrame, query_col: str, request_col: str) -> DataFrame:
    """``query``, ``request``, ``term``: the stems that a request, or its fallback, asks for or denies; and ``ANY_ROW`` where rows with none of them may match."""
    rows = requests.select(F.col(query_col).alias("query"), F.col(request_col).cast("string").alias("request"))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, found = [], []
            for k, request in enumerate(batch.column(1).to_pylist()):
                clauses = parse(request or "") + parse(fallback(request or ""))
                mine = {t for clause in clauses for _, terms in clause for t, _ in terms}
                mine |= {ANY_ROW for clause in clauses if all(denied for denied, _ in clause)}
                row += [k] * len(mine)
                found += sorted(mine)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(found, pa.string())], names=["query", "request", "term"])

    return rows.mapInArrow(terms, f"query {rows.schema['query'].dataType.simpleString()}, request string, term string")


_SCORES = "level int, score double"


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query, id, level, score) of rows that fulfil their request (level 0) or its fallback (1)."""
    parsed: dict[str, tuple] = {}
    for whole in batches:
        for start in range(0, whole.num_rows, JUDGED):
            batch = whole.slice(start, JUDGED)
            kept, level, score = [], [], []
            for k, (request, hits) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3))):
                if request not in parsed:
                    if len(parsed) > 10_000:
                        parsed.clear()
                    parsed[request] = (parse(request), parse(fallback(request)))
                found: dict[str, list[int]] = {}
                for h in hits.as_py():  # of one row at a time
                    found[h["term"]] = h["at"] if h["term"] not in found else sorted({*found[h["term"]], *h["at"]})
                for number, clauses in enumerate(parsed[request]):
                    if fulfilled(clauses, found):
                        kept.append(k)
                        level.append(number)
                        score.append(density(clauses, found))
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(level, pa.int32()), pa.array(score, pa.float64())], names=["query", "id", "level", "score"])


def matches(indexed: DataFrame, requests: DataFrame, query_col: str = "query", request_col: str = "request") -> DataFrame:
    """``query``, ``id``, ``level``, ``score`` of the rows that fulfil a request (level 0) and, as rows of their own, its fallback (level 1).

    ``score`` is the cover density. A null or empty request, and one of stop words alone, matches nothing. Query ids are unique. A
    request that only denies finds all other rows. Hits are joined on the stem; a frequent stem is split by adaptive execution.
    """
    asked = asked_terms(requests, query_col, request_col)
    hits = asked.join(indexed, "term")
    found = hits.groupBy("query", "id").agg(F.first("request").alias("request"), F.collect_list(F.struct("term", "at")).alias("hits"))  # a request's stems
    schema = f"query {found.schema['query'].dataType.simpleString()}, id {found.schema['id'].dataType.simpleString()}, {_SCORES}"
    return found.select("query", "id", "request", "hits").mapInArrow(_judged, schema)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """``query``, ``id``, ``score``, ``rank`` (from 1): the ``k`` densest rows of each request; where no row fulfils it, those of its fallback.

    Equal scores are in the order of ids. The better level and each level's ``k`` best come from one pass, so matches are found once.
    """
    best = Window.partitionBy("query", "level").orderBy(F.desc("score"), "id")
    first = found.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)
    return first.withColumn("top", F.min("level").over(Window.partitionBy("query"))).where(F.col("level") == F.col("top")).select("query", "id", "score", "rank")


def index_for(docs: DataFrame, id_col: str, text_col: str, requests: DataFrame, query_col: str = "query", request_col: str = "request", most: int = 100_000) -> DataFrame:
    """The part of an index that these requests need: of each text only their terms, if these are ``most`` or fewer, so little of a text leaves its
    scan; else the whole index. Runs a job on the requests at once."""
    terms = asked_terms(requests, query_col, request_col).select("term").distinct().limit(most + 1).collect()
    return index(docs, id_col, text_col, frozenset(r[0] for r in terms) if len(terms) <= most else None)


def search_texts(docs: DataFrame, request: str, k: int, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``score``, ``rank`` of the ``k`` densest rows for one request, or else for its fallback, without an index: of each text only the
    places of the request's stems are kept."""
    one = docs.sparkSession.createDataFrame([(0, request)], "query int, request string")
    return ranked(matches(index_for(docs, id_col, text_col, one), one), k).drop("query")


# The same in SQL, for DuckDB. Requests are given in parts: (query, clause, part, denied, words with their distances).


def _parts(requests: dict[int, str]) -> str:
    rows = []
    for query, request in requests.items():
        for level, text in enumerate((request, fallback(request))):
            for c, clause in enumerate(parse(text)):
                for p, (denied, terms) in enumerate(clause):
                    rows += [f"({query}, {level}, {c}, {p}, {denied}, {len(terms)}, {terms[-1][1]}, '{t}', {d})" for t, d in terms]
    return ", ".join(rows)


def matches_sql(requests: dict[int, str], table: str, id_col: str, text_col: str) -> str:
    """CTEs that end in ``matches`` (query, id, level, score)."""
    from tessella.functions.stem import stems_sql

    stop = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))
    return f"""parts(query, level, clause, part, denied, size, span, term, distance) AS (VALUES {_parts(requests)}),
texts AS (SELECT {id_col} AS id, regexp_extract_all(lower(coalesce({text_col}, '')), '[\\p{{L}}\\p{{N}}]+') AS ws FROM {table}),
places AS (SELECT id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS place FROM texts), {stems_sql("places")},
entries AS (SELECT id, stem AS term, place FROM places JOIN stems USING (w) WHERE w NOT IN ({stop}) AND stem IN (SELECT term FROM parts)),
occurs AS (SELECT query, level, clause, part, id, place - distance AS s, place - distance + any_value(span) AS e FROM entries JOIN parts USING (term)
  GROUP BY query, level, clause, part, id, place - distance HAVING count(*) = any_value(size)),
asked AS (SELECT DISTINCT query, level, clause, part, denied FROM parts),
clauses AS (SELECT query, level, clause, count(*) FILTER (NOT denied) AS n FROM asked GROUP BY ALL),
hit AS (SELECT DISTINCT query, level, clause, part, id, denied FROM occurs JOIN asked USING (query, level, clause, part)),
held AS (SELECT query, level, clause, id, count(*) FILTER (NOT denied) AS has, count(*) FILTER (denied) AS bad FROM hit GROUP BY ALL),
good AS (SELECT DISTINCT c.query, c.level, d.id FROM clauses c CROSS JOIN texts d LEFT JOIN held h ON h.query = c.query AND h.level = c.level AND h.clause = c.clause AND h.id = d.id WHERE coalesce(has, 0) = n AND coalesce(bad, 0) = 0),
wanted AS (SELECT o.* FROM occurs o JOIN asked USING (query, level, clause, part) WHERE NOT denied),
ends AS (SELECT DISTINCT query, level, clause, id, e AS r FROM wanted),
lefts AS (SELECT n.query, n.level, n.clause, n.id, n.r, w.part, max(s) AS s FROM ends n JOIN wanted w ON w.query = n.query AND w.level = n.level AND w.clause = n.clause AND w.id = n.id AND w.e <= n.r GROUP BY ALL),
spans AS (SELECT query, level, id, min(s) AS l, r FROM lefts JOIN clauses USING (query, level, clause) GROUP BY query, level, clause, id, r HAVING count(*) = any_value(n)),
tight AS (SELECT query, level, id, l, min(r) AS r FROM spans GROUP BY ALL),
least AS (SELECT * FROM tight t WHERE NOT EXISTS (SELECT 1 FROM tight u WHERE u.query = t.query AND u.level = t.level AND u.id = t.id AND u.l > t.l AND u.r <= t.r)),
taken AS (SELECT DISTINCT query, level, id, place FROM entries JOIN (SELECT DISTINCT query, level, term FROM parts WHERE NOT denied) USING (term)),
noise AS (SELECT t.query, t.level, t.id, t.l, t.r, count(*) AS n FROM least t JOIN taken k ON k.query = t.query AND k.level = t.level AND k.id = t.id AND k.place BETWEEN t.l AND t.r GROUP BY ALL),
dense AS (SELECT query, level, id, sum({WEIGHT}::DOUBLE / (1 + r - l + 1 - n)) AS score FROM noise GROUP BY ALL),
matches AS (SELECT query, level, id, coalesce(score, 0) AS score FROM good LEFT JOIN dense USING (query, level, id))"""
