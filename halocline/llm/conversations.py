r"""Repair of conversation structure by weighted CYK parsing.

A conversation should read ``(s?(ua)+)?``: nothing, or an optional system turn and pairs of user and assistant.  Rows may be
kept, given another role or deleted, and empty turns may be inserted, each at a price.  The repair grammar is in Chomsky normal form: a nonterminal
is the shape of what a span of rows becomes, by its first and last role (or empty), and a binary rule joins
two shapes that may stand side by side.  A cell of the chart holds, for each nonterminal, the least (cost, audit), where the audit spells the
edits in order.  Unary rules that insert a turn before or after a shape are closed once for each row.  Spans are filled by length.

Two audits of the same span, shape and cost are never prefixes of each other (they have the same number of rows, and a further
insertion costs), so the least of them stays least whatever is joined to it.  For the same reason a long span may be parsed in
pieces: any division of it reaches every parse.  Up to ``WIDTH`` rows are one chart; longer spans join neighbouring charts,
doubling in length.

Rows are brought into order by one range exchange, so that a conversation of any size is spread over partitions.  A task parses its
piece of a conversation on its own.  Whole conversations are done there; of those that may go on in the
next partition, at most two for each, the tables of cells are joined afterwards.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halocline.llm.frames import crc32_sql, pick
from halocline.operators.keys import lookup_join
from halocline.storage import materialise

# Prices of the edits, and what the damage does by remainder.
RECOLOUR, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5
DAMAGES = 20
DROPPED, EMPTIED, UNSTOPPED, REPEATED, MISNAMED = range(5)
BLANKS = " \t\n\x0b\f\r"
ROLES = {"u": "user", "a": "assistant"}
MAY_FOLLOW = frozenset(("su", "ua", "au"))

WIDTH = 16  # rows of one chart
ROWS_PER_BATCH = 256

# Nonterminals: nothing, or the first and last role of what a span becomes.
SHAPES = ("", "uu", "ua", "au", "aa", "ss", "su", "sa")
WHOLE = tuple(SHAPES.index(s) for s in ("", "ua", "sa"))


def _joined(x: str, y: str) -> str | None:
    if not x or not y:
        return x or y
    return x[0] + y[1] if x[1] + y[0] in MAY_FOLLOW else None


#: Binary rules by left side: (right, result).
RULES = tuple(tuple((j, SHAPES.index(z)) for j, y in enumerate(SHAPES) if (z := _joined(x, y)) is not None) for x in SHAPES)

Cells = tuple["tuple[int, str] | None", ...]


def join(left: Cells, right: Cells, into: list | None = None) -> list:
    """Cells of two neighbouring spans together, or the better of these and ``into``."""
    out = into if into is not None else [None] * len(SHAPES)
    for i, a in enumerate(left):
        if a is None:
            continue
        cost, audit = a
        for j, k in RULES[i]:
            b = right[j]
            if b is None:
                continue
            new = (cost + b[0], audit + b[1])
            if out[k] is None or new < out[k]:
                out[k] = new
    return out


_INSERTED = tuple((INSERT, "I") if s in ("uu", "aa") else None for s in SHAPES)


def closed(cells: Cells) -> Cells:
    """Cells with turns inserted before and after wherever that makes a better or another shape."""
    while True:
        new = join(cells, _INSERTED, join(_INSERTED, cells, list(cells)))
        if tuple(new) == tuple(cells):
            return tuple(new)
        cells = tuple(new)


@lru_cache(maxsize=None)
def row_cells(code: str) -> Cells:
    """A row's cells: ``x`` has to go, the others are its role (``o``: any other), in capitals if the text is cut short."""
    out: dict[str, tuple[int, str]] = {"": (DELETE, "D")}
    if code != "x":
        more, role = (UNFINISHED if code.isupper() else 0), code.lower()
        for r in "ua":
            out[r + r] = (RECOLOUR + more, "R")
        if role in "uas":
            out[role + role] = (more, "K")
    return closed(tuple(out.get(s) for s in SHAPES))


NOTHING = closed(tuple((0, "") if s == "" else None for s in SHAPES))


@lru_cache(maxsize=1 << 14)
def chart(codes: str) -> Cells:
    """Cells of a span of rows, by all its shorter spans."""
    n = len(codes)
    table = {(i, i + 1): row_cells(c) for i, c in enumerate(codes)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            cell: list = [None] * len(SHAPES)
            for k in range(i + 1, i + length):
                join(table[i, k], table[k, i + length], cell)
            table[i, i + length] = tuple(cell)
    return table[0, n]


def span_cells(codes: str) -> Cells:
    """Cells of a span of any length; of no rows at all, insertions only."""
    if not codes:
        return NOTHING
    spans = [chart(codes[i : i + WIDTH]) for i in range(0, len(codes), WIDTH)]
    return join_all(spans)


def join_all(spans: list[Cells]) -> Cells:
    while len(spans) > 1:
        pairs = [tuple(join(a, b)) for a, b in zip(spans[::2], spans[1::2])]
        spans = pairs + spans[len(pairs) * 2 :]
    return spans[0]


def cheapest(cells: Cells) -> tuple[int, str]:
    """Least (cost, audit) that makes a whole conversation."""
    return min(cells[k] for k in WHOLE if cells[k] is not None)


class Repair:
    """Streams the repaired turns of a conversation into a digest, row by row."""

    def __init__(self, audit: str):
        self.audit, self.at, self.made = audit, 0, 0
        # an odd number of turns begins with a system turn that was kept
        self.odd = (len(audit) - audit.count("D")) % 2
        self.sha, self.started = hashlib.sha256(), False

    def _add(self, role: str, text: str) -> None:
        self.sha.update(("\n" if self.started else "").encode() + f"{role}:{text}".encode())
        self.started, self.made = True, self.made + 1

    def _role(self) -> str:
        return ROLES["ua"[(self.made - self.odd) % 2]]

    def _inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._add(self._role(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self._add(role if edit == "K" else self._role(), text)

    def digest(self) -> str:
        self._inserted()
        return self.sha.hexdigest()


class Piece:
    """What one task has seen of a conversation."""

    def __init__(self, conv_id, held: bool):
        self.conv_id, self.codes = conv_id, []
        self.rows: list[tuple[str, str]] | None = [] if held else None
        self.faults = [0, 0, 0]
        self.illegal = self.turns = 0
        self.first = self.last = None  # initials
        self.low = self.high = None  # turns

    def add(self, turn, code: str, fault: int, role: str, text: str) -> None:
        if not code:  # a row that the damage dropped
            return
        initial = role[:1]
        if self.codes:
            self.illegal += self.last + initial not in MAY_FOLLOW
        else:
            self.first = initial
        self.last = initial
        self.codes.append(code)
        if fault:
            self.faults[fault - 1] += 1
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if self.rows is not None:
            self.rows.append((role, text))

    def state(self) -> dict:
        cells = span_cells("".join(self.codes)) if self.codes else None
        return {"n": len(self.codes), "faults": self.faults, "illegal": self.illegal, "turns": self.turns, "first": self.first, "last": self.last, "low": self.low, "high": self.high, "cells": cells}


def merged(states: Iterable[dict]) -> dict:
    """One state of pieces that follow each other."""
    out: dict | None = None
    spans = []
    for s in states:
        if not s["n"]:
            continue
        spans.append(tuple(c and tuple(c) for c in s["cells"]))
        if out is None:
            out = dict(s)
            continue
        out["illegal"] += s["illegal"] + (out["last"] + s["first"] not in MAY_FOLLOW)
        out["faults"] = [a + b for a, b in zip(out["faults"], s["faults"])]
        # turns ascend, so two pieces share one at most
        out["turns"] += s["turns"] - (out["high"] is not None and out["high"] == s["low"])
        out["low"] = s["low"] if out["low"] is None else out["low"]
        out["high"] = s["high"] if s["high"] is not None else out["high"]
        out["n"], out["last"] = out["n"] + s["n"], s["last"]
    if out is None:
        return Piece(None, False).state()
    return out | {"cells": join_all(spans)}


def _figures(state: dict) -> tuple[list[int], str]:
    """(gaps, blank, duplicate, truncated, illegal, cost) and the audit."""
    gaps = state["high"] - state["low"] + 1 - state["turns"] if state["low"] is not None else 0
    cost, audit = cheapest(state["cells"] or NOTHING)
    return [gaps, *state["faults"], state["illegal"], cost], audit


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, live) after the damage that the checksum of ``conv_id:turn`` picks.

    Nulls become one space, in the key, in roles and in texts.  A dropped row stays as one that isn't live, without role and text,
    so that its conversation isn't forgotten.
    """
    rows = pick(conversations, "conv_id", "turn", "role", "text")
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    role, text, d = F.coalesce("role", blank), F.coalesce("text", blank), F.col("d")
    rows = rows.withColumn("d", (F.crc32(key.cast("binary")) % DAMAGES).cast("int"))
    gone = d == DROPPED
    return rows.select(
        "conv_id",
        "turn",
        F.when(gone, "").when(d == MISNAMED, "user").otherwise(role).alias("role"),
        F.when(gone | (d == EMPTIED), "").when(d == UNSTOPPED, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (~gone).alias("live"),
        F.explode(F.when(d == REPEATED, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def _judged(rows: DataFrame) -> DataFrame:
    """Rows with ``code`` and ``fault`` (0 none, 1 blank, 2 duplicate, 3 truncated) and a stable place.

    A row is a duplicate if its role and text came earlier in the conversation, by turn and, within a turn, by place; only repeated ones are
    gathered, after being counted where they are read.
    """
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = rows.withColumns({"digest": F.unhex(digest), "place": F.monotonically_increasing_id()})
    rows = materialise(rows, "conversations")
    at = F.struct("turn", "place")
    firsts = rows.where("live").groupBy("conv_id", "digest").agg(F.min(at).alias("at"), F.count("*").alias("n"))
    firsts = firsts.where("n > 1").select("conv_id", "digest", "at")
    rows = lookup_join(rows, firsts, ["conv_id", "digest"], "left")
    text = F.rtrim("text", F.lit(BLANKS))
    fault = (
        F.when(F.octet_length(text) == 0, 1)
        .when(F.col("at").isNotNull() & ~F.col("at").eqNullSafe(at), 2)
        .when(~F.right(text, F.lit(1)).isin(".", "!", "?"), 3)
        .otherwise(0)
    )
    rows = rows.withColumn("fault", F.when(F.col("live"), fault).otherwise(0))
    initial = F.left("role", F.lit(1))
    code = F.when(initial.isin("u", "a", "s"), initial).otherwise("o")
    code = F.when(F.col("fault").isin(1, 2), "x").when(F.col("fault") == 3, F.upper(code)).otherwise(code)
    return rows.withColumn("code", F.when(F.col("live"), code).otherwise("")).drop("at")


ORDER = ("conv_id", "turn", "digest", "place")
FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_PER_BATCH):
            piece = batch.slice(at, ROWS_PER_BATCH)
            yield from zip(*[piece.column(n).to_pylist() for n in names])


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """Faults, the cheapest repair and the digest of the repaired text of every conversation, after the damage.

    One row for each conv_id of the input, null included: gaps, blank, duplicate, truncated, illegal and cost (longs), audit and
    repaired_sha256.  Rows are taken by turn (null first); those of one turn by the SHA-256 of role length, role and text, so repeated rows
    stand together and all but the first are duplicates.  A role is judged by its first character; one without any, or with another than
    s, u or a, can only be changed or deleted.  A conversation all of whose rows were dropped has zeros, an empty audit and the digest of an empty text; an
    empty table gives no rows.  Further columns don't matter.

    Partitions are cut by the order, so a conversation with a third of all rows is parsed by many tasks.  Only its digest is made in one,
    which streams the rows and holds one batch of them and the audit: SHA-256 can't be divided.
    """
    id_type = pick(conversations, "conv_id").schema["conv_id"].dataType.simpleString()
    rows = _judged(damaged(conversations))
    figures = ", ".join(f"{n} long" for n in FIGURES)
    schema = f"conv_id {id_type}, {figures}, audit string, repaired_sha256 string, part int, state string"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, out, piece, first = TaskContext.get().partitionId(), [], None, True

        def opened(p: Piece) -> list:
            return [p.conv_id, *[None] * len(FIGURES), None, None, part, json.dumps(p.state())]

        def done(p: Piece) -> list:
            numbers, audit = _figures(p.state())
            repair = Repair(audit)
            for role, text in p.rows:
                repair.row(role, text)
            return [p.conv_id, *numbers, audit, repair.digest(), None, None]

        for conv_id, turn, code, fault, role, text in _rows(batches, "conv_id", "turn", "code", "fault", "role", "text"):
            if piece is None or conv_id != piece.conv_id:
                if piece is not None:
                    # the first conversation of a partition may have begun in the one before
                    out.append(opened(piece) if first else done(piece))
                    first = False
                piece = Piece(conv_id, held=not first)
                if len(out) >= ROWS_PER_BATCH:
                    yield _batch(out, names, types)
                    out = []
            piece.add(turn, code, fault, role, text)
        if piece is not None:
            out.append(opened(piece))  # and the last may go on in the next
        yield _batch(out, names, types)

    ordered = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    empty = ordered.sparkSession.createDataFrame([], schema)
    names, types = empty.columns, _arrow_types(empty)
    parsed = materialise(ordered.mapInArrow(parse, schema), "conversations-parsed")

    def combine(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        state = merged(json.loads(s) for s in table.column("state").to_pylist())
        numbers, audit = _figures(state)
        return pa.Table.from_batches([_batch([[table.column("conv_id")[0].as_py(), *numbers, audit]], names[:8], types[:8])])

    edges = parsed.where("state IS NOT NULL").select("conv_id", "part", "state")
    edges = materialise(edges.groupBy("conv_id").applyInArrow(combine, f"conv_id {id_type}, {figures}, audit string"), "conversations-edges")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, repair, out = None, None, []
        for conv_id, kind, role, text in _rows(batches, "conv_id", "kind", "role", "text"):
            if kind == 0:  # the audit comes before the rows
                if repair is not None:
                    out.append([current, repair.digest()])
                current, repair = conv_id, Repair(text)
            else:
                repair.row(role, text)
        if repair is not None:
            out.append([current, repair.digest()])
        yield _batch(out, ["conv_id", "repaired_sha256"], [types[0], pa.string()])

    columns = ["conv_id", "kind", "turn", "digest", "place", "role", "text"]
    open_rows = rows.where("live").join(edges.select(F.col("conv_id").alias("id")), F.col("conv_id").eqNullSafe(F.col("id")), "left_semi")
    open_rows = open_rows.withColumn("kind", F.lit(1)).select(*columns)
    heads = edges.select("conv_id", F.lit(0).alias("kind"), F.col("audit").alias("text"))
    stream = open_rows.unionByName(heads, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "digest", "place")
    digests = stream.mapInArrow(digest, f"conv_id {id_type}, repaired_sha256 string")
    return parsed.where("state IS NULL").drop("part", "state").unionByName(lookup_join(edges, digests, ["conv_id"]))


def _arrow_types(df: DataFrame) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in df.schema.fields]


def _batch(rows: list[list], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=list(names))


def _sql_edit(state: str, cost: str, letter: str, turn: str | None) -> str:
    """The state after one edit; a state is null where it can't be reached."""
    body = f"{state}.body" if turn is None else f"list_append({state}.body, {turn})"
    return f"CASE WHEN {state} IS NULL THEN NULL ELSE {{'cost': {state}.cost + {cost}, 'audit': {state}.audit || '{letter}', 'body': {body}}} END"


def _sql_inserted(source: str) -> str:
    """Two rounds of insertions over the columns e, s, u, a of ``source``."""
    once = (
        "SELECT * REPLACE ("
        f"least(u, {_sql_edit('e', '5', 'I', "'user:'")}, {_sql_edit('s', '5', 'I', "'user:'")}, {_sql_edit('a', '5', 'I', "'user:'")}) AS u, "
        f"least(a, {_sql_edit('u', '5', 'I', "'assistant:'")}) AS a) FROM "
    )
    return f"{once} ({once} ({source}))"


def _sql_step() -> str:
    kept, user, assistant = "r.role || ':' || r.text", "'user:' || r.text", "'assistant:' || r.text"
    to = lambda p, c, letter, turn, when: f"CASE WHEN {when} THEN {_sql_edit('p.' + p, c, letter, turn)} END"
    gone = lambda p: _sql_edit("p." + p, "2", "D", None)
    u = [to(p, "r.more", "K", kept, "r.stays AND r.c = 'u'") for p in "esa"] + [to(p, "r.more + 1", "R", user, "r.stays") for p in "esa"]
    a = [to("u", "r.more", "K", kept, "r.stays AND r.c = 'a'"), to("u", "r.more + 1", "R", assistant, "r.stays")]
    s = [to("e", "r.more", "K", kept, "r.stays AND r.c = 's'")]
    return (
        f"SELECT p.conv_id, r.i, {gone('e')} AS e, least({', '.join([gone('s'), *s])}) AS s, least({', '.join([gone('u'), *u])}) AS u, "
        f"least({', '.join([gone('a'), *a])}) AS a FROM parse p JOIN judged r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1"
    )


CONVERSATION_SQL = rf"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hit AS (SELECT conv_id, turn, role, text, {crc32_sql("k")} % {DAMAGES} AS d FROM keyed),
damaged AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM hit, unnest(CASE WHEN d = 3 THEN [1, 2] ELSE [1] END) copies(copy) WHERE d <> 0),
placed AS (SELECT *, left(role, 1) AS c,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS i FROM damaged),
counted AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM placed),
named AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
    lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair FROM counted),
judged AS (SELECT *, fault NOT IN ('blank', 'duplicate') AS stays, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more FROM named),
start AS (SELECT conv_id, 0::BIGINT AS i, {{'cost': 0, 'audit': '', 'body': []::VARCHAR[]}} AS e,
    NULL::STRUCT(cost INTEGER, audit VARCHAR, body VARCHAR[]) AS s, NULL::STRUCT(cost INTEGER, audit VARCHAR, body VARCHAR[]) AS u,
    NULL::STRUCT(cost INTEGER, audit VARCHAR, body VARCHAR[]) AS a FROM (SELECT DISTINCT conv_id FROM conversations)),
parse AS ({_sql_inserted("SELECT * FROM start")} UNION ALL {_sql_inserted(_sql_step())}),
ends AS (SELECT conv_id, least(e, a) AS best FROM parse QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
    CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(best.cost AS BIGINT) AS cost, best.audit AS audit,
    sha256(array_to_string(best.body, chr(10))) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
