"""Repair of conversation structure by error-correcting Earley parsing.

The roles of a conversation shall read ``(s?(ua)+)?``. The grammar below is left-linear: a nonterminal stands for what the rows so far
have become. Its productions take a lexical symbol, and those may err: a row can be kept, be given another role or be deleted,
and an empty user or assistant row can be inserted, each at a cost. A chart item holds the least (cost, audit) of its production; an
audit is the initials of the edits in order. Two audits of one item and one cost never begin with each other, as one more edit at the
same row is an insertion and costs more; so the least stays the least whatever follows, and items need hold no other.

As all productions recur on the left, items begin at the start or at the last row, and a set of the chart needs only the set before it.
A conversation's rows can so be parsed in blocks: a block is parsed from each nonterminal that may stand before it, and blocks are joined
in order. Conversations are dealt by ranges of (id, turn, role, text); only those over the edge of a range come in several blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.store import stored

EMPTY, SYSTEM, ODD, EVEN = "empty", "system", "odd", "even"
STATES = (EMPTY, SYSTEM, ODD, EVEN)
FINAL = (EMPTY, EVEN)
JUNK = "junk"
# left side: its productions, each (what stands before, symbol)
GRAMMAR = {
    EMPTY: ((EMPTY, JUNK),),
    SYSTEM: ((EMPTY, "s"), (SYSTEM, JUNK)),
    ODD: ((EMPTY, "u"), (SYSTEM, "u"), (EVEN, "u"), (ODD, JUNK)),
    EVEN: ((ODD, "a"), (EVEN, JUNK)),
}
# Costs of the edits, and the roles that an edit can give.
RE_ROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NAMES = {"u": "user", "a": "assistant"}
BLOCK_ROWS, BLOCK_CHARS = 4096, 1 << 20
KEPT, KEPT_ROWS = 1 << 16, 64

Item = tuple[int, tuple]  # cost, and (audit before, edits at this row) down to None


def _less(a: Item, b: Item) -> bool:
    """Whether ``a`` is the lesser of two items of one set and one left side."""
    if a[0] != b[0]:
        return a[0] < b[0]
    x, y, left, right = a[1], b[1], [], []
    while x is not y:  # both have a link for each row
        left.append(x[1])
        right.append(y[1])
        x, y = x[0], y[0]
    return "".join(reversed(left)) < "".join(reversed(right))


def _offered(chart: dict[str, Item], state: str, item: Item) -> bool:
    if state in chart and not _less(item, chart[state]):
        return False
    chart[state] = item
    return True


def inserted(chart: dict[str, Item]) -> dict[str, Item]:
    """The set with what insertions complete: productions whose symbol derives an inserted row."""
    todo = list(chart)
    while todo:
        before = todo.pop()
        for state, productions in GRAMMAR.items():
            for left, symbol in productions:
                if left == before and symbol in NAMES and before in chart:
                    cost, (past, edits) = chart[before]
                    if _offered(chart, state, (cost + INSERT, (past, edits + "I"))):
                        todo.append(state)
    return chart


def scanned(chart: dict[str, Item], initial: str, fault: str) -> dict[str, Item]:
    """The set after one more row: its role's initial, and its fault ('' for none, 'd' for one that only a deletion mends, 't' for a truncated text)."""
    out: dict[str, Item] = {}
    extra = TRUNCATED if fault == "t" else 0
    for state, productions in GRAMMAR.items():
        for left, symbol in productions:
            if left not in chart:
                continue
            cost, past = chart[left]
            if symbol == JUNK:
                _offered(out, state, (cost + DELETE, (past, "D")))
                continue
            if fault == "d":
                continue
            if symbol == initial:
                _offered(out, state, (cost + extra, (past, "K")))
            if symbol in NAMES:
                _offered(out, state, (cost + RE_ROLE + extra, (past, "R")))
    return inserted(out)


def audit_of(item: Item) -> str:
    parts, at = [], item[1]
    while at is not None:
        parts.append(at[1])
        at = at[0]
    return "".join(reversed(parts))


class Parser:
    """Parses rows from each state; keeps the results of short runs."""

    def __init__(self) -> None:
        self.kept: dict[tuple, dict[str, tuple[int, str]]] = {}

    def parse(self, rows: list[tuple[str, str]], start: str = EMPTY) -> dict[str, tuple[int, str]]:
        """(cost, audit) of each state that rows of (initial, fault) can end in."""
        key = (start, tuple(rows)) if len(rows) <= KEPT_ROWS else None
        if key in self.kept:
            return self.kept[key]
        chart = inserted({start: (0, (None, ""))})
        for initial, fault in rows:
            chart = scanned(chart, initial, fault)
        found = {state: (item[0], audit_of(item)) for state, item in chart.items()}
        if key is not None:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            self.kept[key] = found
        return found


def least(found: dict[str, tuple[int, str]]) -> tuple[int, str]:
    """The completed parse: every row can be deleted, so there is always one."""
    return min(found[s] for s in FINAL if s in found)


def repaired(rows: list[tuple[str, str]], audit: str, last: str = "a") -> Iterator[tuple[str, str]]:
    """(role, text) of rows of (role, text) after the edits. ``last``: the initial that stands before; an assistant's or none is 'a'."""
    at = iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(at)
        if edit == "D":
            continue
        if edit != "K":
            role = NAMES["a" if last == "u" else "u"]
        last = role[:1]
        yield role, text


_BEFORE = {EMPTY: "a", SYSTEM: "s", ODD: "u", EVEN: "a"}


def damage(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv``, ``turn``, ``role``, ``text``, ``n`` (how many times the row stands there, 0 for a dropped one): rows damaged by a checksum of conversation and turn.

    Of 20 remainders 0 drops the row, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it a user's. A null is one
    blank in the checksum, as a role and as a text.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown(conv), F.lit(":"), shown(turn)).cast("binary")) % 20
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), shown(role).alias("role"), shown(text).alias("text"), kind.alias("kind"))
    said = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    n = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long")
    return rows.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), n.alias("n"))


def faults(rows: DataFrame) -> DataFrame:
    """Each different row of (conv, turn, role, text) once, with ``n`` and ``fault``: 'd' blank, 'e' said before by the same role, 't' truncated, or ''.

    Whether the role has said a text in an earlier turn comes from an aggregate, a row for each conversation, role and text, which marks the
    first of its turns. Equal rows of a turn are then counted together with that mark. Both are partial aggregates, and nothing gathers a
    conversation.
    """
    key = ["conv", "turn", "role", "text"]
    first = rows.where("n > 0").groupBy("conv", "role", "text").agg(F.min("turn").alias("turn"), F.max(F.col("turn").isNull().cast("int")).alias("unknown"))
    marks = first.select("conv", F.when(F.col("unknown") == 0, F.col("turn")).alias("turn"), "role", "text", F.lit(0).cast("long").alias("n"), F.lit(1).alias("mark"))
    both = rows.select(*key, "n", F.lit(0).alias("mark")).unionByName(marks).groupBy(*key).agg(F.sum("n").alias("n"), F.max("mark").alias("mark"))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(last == "", "d").when(F.col("mark") == 0, "e").when(~last.isin(".", "!", "?"), "t").otherwise("")
    return both.select(*key, "n", fault.alias("fault"))


# neighbours' initials that follow the rule.
_ALLOWED = frozenset({"su", "ua", "au"})
_COUNTS = ("low", "high", "turns", "blank", "duplicate", "truncated", "illegal")
_PARSED = pa.list_(pa.struct([("start", pa.string()), ("end", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))
_ROWS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_FIELDS = {"block": pa.int64(), "whole": pa.bool_(), **dict.fromkeys(_COUNTS, pa.int64()), "first": pa.string(), "last": pa.string(), "cost": pa.int64(), "audit": pa.string(), "rows": _ROWS, "parsed": _PARSED}
_BLOCK = (
    "block long, whole boolean, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, first string, last string, cost long, audit string, "
    "rows array<struct<role:string,text:string>>, parsed array<struct<start:string,end:string,cost:long,audit:string>>"
)


class _Block:
    """Rows of one conversation, one after another, and what is counted of them."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, str]] = []
        self.symbols: list[tuple[str, str]] = []
        self.chars = self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.high = None

    def add(self, turn: int | None, role: str, text: str, fault: str, again: bool) -> None:
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = (turn if self.low is None else self.low), turn, self.turns + 1
        fault = "e" if again and fault != "d" else fault
        self.blank += fault == "d"
        self.duplicate += fault == "e"
        self.truncated += fault == "t"
        self.illegal += bool(self.symbols) and self.symbols[-1][0] + role[:1] not in _ALLOWED
        self.symbols.append((role[:1], "d" if fault == "e" else fault))
        self.rows.append((role, text))
        self.chars += len(text)

    def full(self) -> bool:
        return len(self.rows) >= BLOCK_ROWS or self.chars >= BLOCK_CHARS

    def told(self, parser: Parser, number: int, whole: bool) -> dict:
        """The block as a row: repaired if it is a whole conversation, else with its parses from every state."""
        out = {n: getattr(self, n) for n in _COUNTS} | {"block": number, "whole": whole, "first": self.symbols[0][0] if self.symbols else None, "last": self.symbols[-1][0] if self.symbols else None}
        if whole:
            cost, audit = least(parser.parse(self.symbols))
            return out | {"cost": cost, "audit": audit, "rows": _named(repaired(self.rows, audit)), "parsed": None}
        parsed = [{"start": s, "end": e, "cost": c, "audit": a} for s in STATES for e, (c, a) in parser.parse(self.symbols, s).items()]
        return out | {"cost": None, "audit": None, "rows": _named(self.rows), "parsed": parsed}


def _named(rows) -> list[dict]:
    return [{"role": r, "text": t} for r, t in rows]


def _batch(convs: list, kind: pa.DataType, rows: list[dict], fields: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(convs, kind), *(pa.array([r[n] for r in rows], k) for n, k in fields.items())], names=["conv", *fields])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order become repaired conversations, or blocks of those that are long or may go on in another range."""
    parser, task = Parser(), TaskContext.get().partitionId() << 40  # ranges are in the order of partitions
    convs, rows, size, kind = [], [], 0, pa.null()
    this, block, number, first, begun = None, _Block(), 0, True, False

    def closed(whole: bool) -> None:
        nonlocal size
        convs.append(this)
        rows.append(block.told(parser, task + number, whole))
        size += block.chars + 64 * len(block.rows)

    for batch in batches:
        kind = batch.column(0).type
        for conv, turn, role, text, n, fault in zip(*(c.to_pylist() for c in batch.columns)):
            if begun and conv != this:
                closed(not first and number == 0)
                first, number, block = False, 0, _Block()
            this, begun = conv, True
            for k in range(n):
                if block.full():
                    closed(False)
                    number, block = number + 1, _Block()
                block.add(turn, role, text, fault, k > 0)
            if size > BLOCK_CHARS or len(rows) >= 2000:
                yield _batch(convs, kind, rows, _FIELDS)
                convs, rows, size = [], [], 0
    if begun:
        closed(False)  # it may go on in the next range
        yield _batch(convs, kind, rows, _FIELDS)


_PATH = {"block": pa.int64(), "start": pa.string(), "end": pa.string()}


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the blocks of conversations in order, without texts: the states between which the least parse passes each block."""
    kind, this, begun, live, links = pa.null(), None, False, {}, []

    def ended() -> pa.RecordBatch:
        best: dict[str, Item] = {}
        at = ""
        for state in FINAL:
            if state in live and _offered(best, "", live[state]):
                at = state
        found = []
        for number, came in reversed(links):
            found.append({"block": number, "start": came[at], "end": at})
            at = came[at]
        return _batch([this] * len(found), kind, found, _PATH)

    for batch in batches:
        kind = batch.column(0).type
        for conv, number, parses in zip(*(c.to_pylist() for c in batch.columns)):
            if not begun or conv != this:
                if begun:
                    yield ended()
                this, begun, live, links = conv, True, {EMPTY: (0, (None, ""))}, []
            best: dict[str, Item] = {}
            came: dict[str, str] = {}
            for p in parses:
                if p["start"] in live:
                    cost, past = live[p["start"]]
                    if _offered(best, p["end"], (cost + p["cost"], (past, p["audit"]))):
                        came[p["end"]] = p["start"]
            live = best
            links.append((number, came))
    if begun:
        yield ended()


def _mended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their states become blocks of repaired rows."""
    for batch in batches:
        start, end = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("start", "end"))
        rows, parses = (batch.column(batch.schema.get_field_index(n)) for n in ("rows", "parsed"))
        out = []
        for k, (s, e) in enumerate(zip(start, end)):
            parse = next(p for p in parses[k].as_py() if p["start"] == s and p["end"] == e)
            mended = repaired([(r["role"], r["text"]) for r in rows[k].as_py()], parse["audit"], _BEFORE[s])
            out.append({"cost": parse["cost"], "audit": parse["audit"], "rows": _named(mended)})
        new = {n: pa.array([r[n] for r in out], _FIELDS[n]) for n in ("cost", "audit", "rows")}
        names = ["conv", *(n for n in _FIELDS if n != "parsed")]
        yield pa.RecordBatch.from_arrays([new[n] if n in new else batch.column(batch.schema.get_field_index(n)) for n in names], names=names)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """Repaired conversations from ``conv``, ``turn``, ``role``, ``text``, ``n`` (as ``damage`` gives; n: how often the row stands there).

    A row for each conversation with ``whole`` true, or, for one that is long or lies over the edge of a range, one for each of its blocks, in the
    order of ``block``: ``rows`` (role, text) after the edits, ``audit`` and ``cost`` of the edits, the counts of faults before them, and
    what is needed to add the counts of blocks up (``conversation_reports``).

    Rows are in the order of turn, role and text; null turns come first, equal rows stay. A null role or text is empty, a null conversation is one
    conversation. A conversation whose rows all have ``n`` 0 has no rows and an empty audit. An empty table gives an empty one; other columns
    are not read. Runs jobs at once; blocks are written to scratch, and only their parses pass from one to the next, without texts.
    """
    rows = rows.select("conv", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")], "n")
    kind = rows.schema["conv"].dataType.simpleString()
    dealt = faults(rows).repartitionByRange("conv", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv", "turn", "role", "text")
    blocks = stored(dealt.mapInArrow(_blocks, f"conv {kind}, {_BLOCK}"), "repair-blocks")
    split = blocks.where("not whole")
    paths = split.select("conv", "block", "parsed").repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(_paths, f"of {kind}, block long, start string, end string")
    paths = paths.select("block", F.struct("of").alias("of"), "start", "end")
    names = ["conv", *(n for n in _FIELDS if n != "parsed")]
    mended = split.withColumn("of", F.struct(F.col("conv").alias("of"))).join(paths, ["block", "of"]).drop("of")
    schema = f"conv {kind}, {_BLOCK.partition(', parsed')[0]}"
    return blocks.where("whole").select(*names).unionByName(mended.mapInArrow(_mended, schema))


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the blocks of conversations in order: one report each; texts pass through one hash state."""
    kind, this, begun, total, audit, digest, lines = pa.null(), None, False, {}, [], hashlib.sha256(), 0

    def ended() -> pa.RecordBatch:
        gaps = 0 if total["low"] is None else total["high"] - total["low"] + 1 - total["turns"]
        return _batch([this], kind, [total | {"gaps": gaps, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], _REPORT)

    for batch in batches:
        kind = batch.column(0).type
        for k in range(batch.num_rows):
            b = {n: batch.column(i)[k].as_py() for i, n in enumerate(batch.schema.names)}
            if not begun or b["conv"] != this:
                if begun:
                    yield ended()
                this, begun, audit, digest, lines = b["conv"], True, [], hashlib.sha256(), 0
                total = {"low": None, "high": None, "turns": 0, "last": None} | dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
            if b["low"] is not None:
                total["turns"] += b["turns"] - (b["low"] == total["high"])
                total["low"], total["high"] = (b["low"] if total["low"] is None else total["low"]), b["high"]
            for n in ("blank", "duplicate", "truncated", "illegal", "cost"):
                total[n] += b[n]
            if b["first"] is not None:
                total["illegal"] += total["last"] is not None and total["last"] + b["first"] not in _ALLOWED
                total["last"] = b["last"]
            audit.append(b["audit"])
            for r in b["rows"]:
                digest.update(f"{chr(10) if lines else ''}{r['role']}:{r['text']}".encode())
                lines += 1
    if begun:
        yield ended()


_REPORT = {**dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), pa.int64()), "audit": pa.string(), "repaired_sha256": pa.string()}


def conversation_reports(repaired_blocks: DataFrame) -> DataFrame:
    """``conv``, ``gaps``, the counts of faults, ``cost``, ``audit`` and ``repaired_sha256`` (of ``role:text``, one a line) of each conversation.

    Whole conversations are digested where they lie, by built-in functions. The blocks of the others come together in order and pass through
    one hash state, as the digest of a whole can only be made in order.
    """
    kind = repaired_blocks.schema["conv"].dataType.simpleString()
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns")).cast("long")
    lines = F.array_join(F.transform("rows", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    named = ["conv", *_REPORT]
    whole = repaired_blocks.where("whole").withColumns({"gaps": gaps, "repaired_sha256": F.sha2(lines.cast("binary"), 256)}).select(*named)
    rest = repaired_blocks.where("not whole").repartition("conv").sortWithinPartitions("conv", "block")
    schema = f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return whole.unionByName(rest.mapInArrow(_reports, schema))
