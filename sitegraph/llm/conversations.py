"""Operator 13: conversation structure repair by Hirschberg's divide and conquer.

A conversation's rows are edited at least cost so that their roles read
``(s?(ua)+)?`` by initials: keep 0, rerole to user or assistant 3, delete 4 (blank and
repeated rows must go), insert an empty turn 3; a truncated row that stays adds 3.
Of the cheapest edits the ASCII-least list of initials counts.

* After any row only four states matter (nothing yet, after s, after u, after a), and a
  state fixes the role that may come next.  A forward pass over some rows keeps
  the cost of each state, and the order of the least edit lists leading to them
  (two such lists are never one the beginning of the other, since both end with the
  edit of the same row).  A backward pass keeps the cost to the end.
* The two vectors meet at the middle row; of the cheapest crossings the one whose
  edit list comes first is taken, and both halves are solved alike, between fixed
  states.  So memory is linear in the rows, a byte each.
* Rows are range-partitioned by conversation and order without their texts, and
  become a byte each (initial and fault).  A conversation that spans several
  partitions is solved in segments: the costs from every state to every state
  of each segment fix the states at their borders first (the same choice on a larger
  scale), then each segment is solved where it lies.  Texts are shuffled once, to be
  read in order beside the edits; they are streamed, not held.

Faults: a row is blank (no character but white space), else duplicate (role and text
seen earlier), else truncated (its last character but white space is not one of .!?).

Defined results: null roles and texts are one space (so a null text is blank, and a null
role can only be changed); rows come by turn, nulls first, rows of one turn by role, then
by digest of role and text; rows without a conversation id are one conversation; a role
counts by its first letter, so one that starts with none of s, u, a can only be changed
or deleted; repeated rows are duplicates; an empty table gives no rows; other columns are
left aside.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.llm.common import Scratch, read, slices

START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)                       # the role that may follow, as a state
ROLE = {USER: "user", ASSISTANT: "assistant"}
TAIL = ("", "II", "I", "")                                 # what completes a conversation in each state
REROLE, DELETE, INSERT, TRUNCATED_STAYS = 3, 4, 3, 3
INITIALS = "sua"                                           # others: 3
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
_FAR = 1 << 60
_SPACE = " \t\n\x0b\x0c\r"


# --- the four-state program over classes (4 * initial + fault) -------------------------------

@functools.cache
def options(kind: int) -> tuple[tuple[int, int, int, str], ...]:
    """(from, to, cost, edits) of a row of this class: the best for each pair of states."""
    initial, fault = divmod(kind, 4)
    best: dict[tuple[int, int], tuple[int, str]] = {}

    def offer(s: int, t: int, cost: int, edits: str) -> None:
        best[s, t] = min(best.get((s, t), (_FAR, "")), (cost, edits))

    for s in range(4):
        offer(s, s, DELETE, "D")  # inserting before a deleted row can wait
        if fault in (BLANK, DUPLICATE):
            continue
        stays, at = TRUNCATED_STAYS * (fault == TRUNCATED), s
        for n in range(3):
            if at == START and initial == 0:
                offer(s, SYSTEM, n * INSERT + stays, "I" * n + "K")
            if initial == (None, None, 1, 2)[NEXT[at]]:
                offer(s, NEXT[at], n * INSERT + stays, "I" * n + "K")
            offer(s, NEXT[at], n * INSERT + REROLE + stays, "I" * n + "R")
            at = NEXT[at]
    return tuple((s, t, *b) for (s, t), b in sorted(best.items()))


Vector = tuple[tuple[int, ...], tuple[int, ...]]  # by state: cost, place of its least edit list among the four


def at_state(s: int) -> Vector:
    return tuple(0 if t == s else _FAR for t in range(4)), (0, 0, 0, 0)


@functools.cache
def _step(kind: int, costs: tuple[int, ...], places: tuple[int, ...]) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    best: dict[int, tuple[int, int, str]] = {}
    for s, t, cost, edits in options(kind):
        if costs[s] < _FAR:
            best[t] = min(best.get(t, (_FAR, 0, "")), (costs[s] + cost, places[s], edits))
    least = min(b[0] for b in best.values())
    order = sorted(best, key=lambda t: best[t][1:])
    return (least, tuple(best[t][0] - least if t in best else _FAR for t in range(4)),
            tuple(order.index(t) if t in best else 0 for t in range(4)))


def forward(kinds: bytes, vector: Vector) -> Vector:
    costs, places = vector
    base = 0
    for kind in kinds:
        more, costs, places = _step(kind, costs, places)
        base += more
    return tuple(c if c >= _FAR else c + base for c in costs), places


@functools.cache
def _back(kind: int, costs: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    out = [_FAR] * 4
    for s, t, cost, _ in options(kind):
        if costs[t] < _FAR:
            out[s] = min(out[s], costs[t] + cost)
    least = min(out)
    return least, tuple(c - least if c < _FAR else _FAR for c in out)


def backward(kinds: bytes, end: int) -> tuple[int, ...]:
    costs, base = at_state(end)[0], 0
    for kind in reversed(kinds):
        more, costs = _back(kind, costs)
        base += more
    return tuple(c if c >= _FAR else c + base for c in costs)


def crossing(vector: Vector, ahead) -> int:
    """The state on the cheapest way; of several the one whose edit list comes first."""
    costs, places = vector
    return min((s for s in range(4) if costs[s] < _FAR and ahead[s] < _FAR),
               key=lambda s: (costs[s] + ahead[s], places[s]))


def ending(vector: Vector) -> int:
    return crossing(vector, [INSERT * len(t) for t in TAIL])


def edits_between(kinds: bytes, start: int, end: int) -> str:
    """The least of the cheapest edit lists that lead from one state to the other."""
    if not kinds:
        return ""
    if len(kinds) == 1:
        return next(e for s, t, _, e in options(kinds[0]) if (s, t) == (start, end))
    half = len(kinds) // 2
    middle = crossing(forward(kinds[:half], at_state(start)), backward(kinds[half:], end))
    return edits_between(kinds[:half], start, middle) + edits_between(kinds[half:], middle, end)


# --- rows, order and classes -------------------------------------------------------------

def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): each row lost, emptied, cut, repeated or given the role
    user, as crc32 of ``conv_id:turn`` modulo 20 says (0 to 4; the others stay)."""
    blank = F.lit(" ")
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                                F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), blank))
    rows = rows.withColumn("what", F.crc32(F.encode(key, "UTF-8")) % 20).where("what <> 0")
    text = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("what") == 3, 2).otherwise(1)))
    role = F.when(F.col("what") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _with_digest(rows: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    digest = F.unhex(F.sha2(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "UTF-8"), 256))
    return rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                       role.alias("role"), text.alias("text"), digest.alias("digest"))


ORDER = ["conv_id", "turn", "role", "digest"]


def marks(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, n, initial, blank, truncated, first): the rows without
    their texts, equal ones as one with their number; ``first``: this role and text were
    not seen earlier."""
    text = F.rtrim(F.col("text"), F.lit(_SPACE))
    initial = F.instr(F.lit(INITIALS), F.substring("role", 1, 1))
    initial = F.when((F.col("role") == "") | (initial == 0), 3).otherwise(initial - 1).cast("int")
    groups = _with_digest(rows).select(*ORDER, initial.alias("initial"), (text == "").alias("blank"),
                                       (~F.substring(text, -1, 1).isin(".", "!", "?")).alias("truncated"))
    groups = groups.groupBy(groups.columns).agg(F.count("*").alias("n"))
    again = groups.groupBy("conv_id", "digest").agg(
        F.count("*").alias("turns"), F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("bare"))
    again = again.where("turns > 1").select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "least", "bare")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d"))
    first = F.when(F.col("d").isNull(), True).when(F.col("bare"), F.col("turn").isNull()).otherwise(
        F.col("turn") == F.col("least"))
    return groups.join(again, same, "left").select(*groups.columns, first.alias("first"))


def segments(marked: DataFrame) -> DataFrame:
    """(conv_id, piece, kinds): the classes of a conversation's rows in order, a byte each,
    for each range partition that has some of them (``piece`` numbers them)."""
    ordered = marked.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    fault = F.when(F.col("blank"), BLANK).when(~F.col("first"), DUPLICATE).when(F.col("truncated"), TRUNCATED).otherwise(FINE)
    others = F.when(F.col("blank"), BLANK).otherwise(DUPLICATE)
    ordered = ordered.select("conv_id", F.spark_partition_id().alias("piece"), "n",
                             (F.col("initial") * 4 + fault).cast("tinyint").alias("one"),
                             (F.col("initial") * 4 + others).cast("tinyint").alias("rest"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # conversation, piece
        kinds: list[bytes] = []
        for part in parts:
            if not part.num_rows:
                continue
            ids, pieces = part.column(0).to_pylist(), part.column(1).to_pylist()
            n, one, rest = (part.column(k).to_numpy() for k in (2, 3, 4))
            every = np.repeat(rest, n).astype(np.uint8)
            at = np.append(0, np.cumsum(n))
            every[at[:-1]] = one
            done: list[tuple] = []
            for k, (c, p) in enumerate(zip(ids, pieces)):
                if held != (c, p):
                    if held is not None:
                        done.append((*held, b"".join(kinds)))
                    held, kinds = (c, p), []
                kinds.append(every[at[k]:at[k + 1]].tobytes())
            if done:
                yield _batch(done, SEGMENT)
        if held is not None:
            yield _batch([(*held, b"".join(kinds))], SEGMENT)

    return ordered.mapInArrow(run, "conv_id bigint, piece int, kinds binary")


SEGMENT = pa.schema([("conv_id", pa.int64()), ("piece", pa.int32()), ("kinds", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)],
                                      schema=schema)


# --- borders of segments, and their solution -----------------------------------------------

CROSSING = pa.schema([("conv_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int32()), ("end", pa.int32()),
                      ("last", pa.bool_()), ("before", pa.int32())])


def border_states(pieces: list[tuple[list[Vector], int]]) -> list[tuple[int, int, bool, int]]:
    """(start, end, last, class of the row before) of each segment of a conversation, from the
    forward vectors of every state over each segment and the class of its last row."""
    vectors = [at_state(START)]
    for table, _ in pieces:
        costs, places = vectors[-1]
        best: dict[int, tuple[int, int, int]] = {}
        for s in range(4):
            for t in range(4):
                if costs[s] < _FAR and table[s][0][t] < _FAR:
                    best[t] = min(best.get(t, (_FAR, 0, 0)), (costs[s] + table[s][0][t], places[s], table[s][1][t]))
        order = sorted(best, key=lambda t: best[t][1:])
        vectors.append((tuple(best[t][0] if t in best else _FAR for t in range(4)),
                        tuple(order.index(t) if t in best else 0 for t in range(4))))
    end, out = ending(vectors[-1]), []
    for k in reversed(range(len(pieces))):
        start = crossing(vectors[k], [pieces[k][0][s][0][end] for s in range(4)])
        out.append((start, end, k == len(pieces) - 1, pieces[k - 1][1] if k else -1))
        end = start
    return out[::-1]


def _crossings(parts: DataFrame) -> DataFrame:
    """Border states of the segments of conversations that have several."""
    several = parts.groupBy("conv_id").count().where("count > 1").select(F.col("conv_id").alias("c"))
    some = parts.join(several, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            costs, places, last = [], [], []
            for kinds in part.column(2).to_pylist():
                table = [forward(kinds, at_state(s)) for s in range(4)]
                costs.append([c for v in table for c in v[0]])
                places.append([p for v in table for p in v[1]])
                last.append(kinds[-1])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(costs, type=pa.list_(pa.int64())),
                 pa.array(places, type=pa.list_(pa.int32())), pa.array(last, type=pa.int32())],
                names=["conv_id", "piece", "costs", "places", "last_kind"])

    def choose(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["piece"])  # one for each partition at most
        found = border_states([([(tuple(r["costs"][4 * s:4 * s + 4]), tuple(r["places"][4 * s:4 * s + 4])) for s in range(4)],
                                r["last_kind"]) for r in rows])
        return pa.Table.from_batches([_batch([(r["conv_id"], r["piece"], *f) for r, f in zip(rows, found)], CROSSING)])

    return some.mapInArrow(tables, "conv_id bigint, piece int, costs array<bigint>, places array<int>, last_kind int") \
        .groupBy("conv_id").applyInArrow(choose, "conv_id bigint, piece int, start int, end int, last boolean, before int")


SOLVED = pa.schema([("conv_id", pa.int64()), ("piece", pa.int32()), ("audit", pa.string()), ("cost", pa.int64()),
                    ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64())])
_LEGAL = np.zeros((4, 4), dtype=bool)
_LEGAL[[0, 1, 2], [1, 2, 1]] = True  # su, ua, au


def solved_segment(kinds: bytes, start: int, end: int | None, last: bool, before: int) -> tuple:
    """(audit, cost, blank, duplicate, truncated, illegal) of a segment; ``end`` None: the
    cheapest one.  The pair with the row before counts here."""
    vector = forward(kinds, at_state(start))
    end = ending(vector) if end is None else end
    tail = TAIL[end] if last else ""
    classes = np.frombuffer((bytes([before]) if before >= 0 else b"") + kinds, dtype=np.uint8)
    initial, fault = classes // 4, (classes % 4)[before >= 0:]
    counts = [int((fault == f).sum()) for f in (BLANK, DUPLICATE, TRUNCATED)]
    illegal = int((~_LEGAL[initial[:-1], initial[1:]]).sum())
    return edits_between(kinds, start, end) + tail, vector[0][end] + INSERT * len(tail), *counts, illegal


def audits(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, audit, cost, blank, duplicate, truncated, illegal) of each conversation of the
    rows (conv_id, turn, role, text)."""
    parts = scratch.save(segments(marks(rows)), "segments")
    border = _crossings(parts).select(F.col("conv_id").alias("c"), F.col("piece").alias("p"), "start", "end", "last", "before")
    whole = parts.join(border, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("piece") == F.col("p")), "left")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (s for b in batches for s in slices(b)):
            out = []
            for c, p, kinds, start, end, last, before in zip(*(col.to_pylist() for col in part.columns)):
                own = start is None
                out.append((c, p, *solved_segment(kinds, START if own else start, end, own or last, -1 if own else before)))
            yield _batch(out, SOLVED)

    done = whole.select("conv_id", "piece", "kinds", "start", "end", "last", "before").mapInArrow(
        solve, "conv_id bigint, piece int, audit string, cost bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint")
    counts = [F.sum(c).alias(c) for c in ("cost", "blank", "duplicate", "truncated", "illegal")]
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "audit"))), lambda x: x["audit"]), "")
    return scratch.save(done.groupBy("conv_id").agg(joined.alias("audit"), *counts), "audits")  # a piece for each partition


# --- repaired texts ------------------------------------------------------------------------

def _repaired(rows: DataFrame, audit: DataFrame, turns: Callable, schema: str) -> DataFrame:
    """Streams the rows of each conversation beside its edits; ``turns(conv_id, iterator)`` gets
    (edit, role, text) of each repaired turn and returns the rows to put out."""
    nothing = {c: F.lit(None) for c in ("audit", "turn", "role", "digest", "text")}
    texts = _with_digest(rows)
    texts = texts.select("conv_id", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("audit"), "turn", "role", "digest", "text")
    lists = audit.select("conv_id", F.lit(0).alias("kind"), "audit", *[
        nothing[c].cast(texts.schema[c].dataType).alias(c) for c in ("turn", "role", "digest", "text")])
    both = lists.unionAll(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat():
            for part in (s for b in parts for s in slices(b)):
                yield from zip(*(part.column(k).to_pylist() for k in range(5)))

        stream = flat()
        head = next(stream, None)
        while head is not None:
            conv, _, edits, _, _ = head
            ahead: list = [None]

            def repaired() -> Iterator[tuple[str, str, str]]:
                state = START
                for edit in edits:
                    if edit == "I":
                        state = NEXT[state]
                        yield edit, ROLE[state], ""
                        continue
                    _, _, _, role, text = next(stream)
                    if edit == "K":
                        state = SYSTEM if state == START and role[0] == "s" else NEXT[state]
                        yield edit, role, text
                    elif edit == "R":
                        state = NEXT[state]
                        yield edit, ROLE[state], text

            yield from turns(conv, repaired())
            head = next(stream, None)

    return both.select("conv_id", "kind", "audit", "role", "text").mapInArrow(run, schema)


def repaired_turns(rows: DataFrame, audit: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of each repaired conversation, from 0."""
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def turns(conv, found) -> Iterator[pa.RecordBatch]:
        held = []
        for place, (edit, role, text) in enumerate(found):
            held.append((conv, place, edit, role, text))
            if len(held) == 1024:
                yield _batch(held, schema)
                held = []
        if held:
            yield _batch(held, schema)

    return _repaired(rows, audit, turns, "conv_id bigint, place bigint, edit string, role string, text string")


def repaired_digests(rows: DataFrame, audit: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): digest of the turns as ``role:text``, newline-joined.  A
    digest is serial: one task reads a conversation's turns, one after the other."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def turns(conv, found) -> Iterator[pa.RecordBatch]:
        digest, glue = hashlib.sha256(), b""
        for _, role, text in found:
            digest.update(glue + f"{role}:{text}".encode())
            glue = b"\n"
        yield _batch([(conv, digest.hexdigest())], schema)

    return _repaired(rows, audit, turns, "conv_id bigint, repaired_sha256 string")


def turn_gaps(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps): turn numbers missing between the first and the last one."""
    turns = rows.select("conv_id", "turn").distinct().groupBy("conv_id").agg(
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.count("turn").alias("n"))
    return turns.select("conv_id", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("n"), F.lit(0)).alias("gaps"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "conversations")
    given = read(spark, sf_dir, "conversations")
    rows = damage(given)
    audit = audits(rows, scratch)
    out = given.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    for more in (turn_gaps(rows), audit, repaired_digests(rows, audit)):
        more = more.withColumnRenamed("conv_id", "c")
        out = out.join(more, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


SQL = r"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
hashed AS (
  SELECT *, xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda c, b: list_reduce([xor(c, b)] || CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[]),
      lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 20 AS what FROM given),
damaged AS (
  SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN what = 1 THEN '' WHEN what = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN what = 3 THEN 2 ELSE 1 END)) AS copy FROM hashed WHERE what <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank FROM damaged),
seen AS (
  SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate,
    left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS earlier FROM numbered),
faults AS (
  SELECT *, NOT blank AND NOT duplicate AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS truncated FROM seen),
counts AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) AS n,
    count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id),
inserts(s, s2, letters, lines) AS (VALUES
  (0, 0, '', ''), (0, 2, 'I', 'user:' || chr(10)), (0, 3, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)),
  (1, 1, '', ''), (1, 2, 'I', 'user:' || chr(10)), (1, 3, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)),
  (2, 2, '', ''), (2, 3, 'I', 'assistant:' || chr(10)), (2, 2, 'II', 'assistant:' || chr(10) || 'user:' || chr(10)),
  (3, 3, '', ''), (3, 2, 'I', 'user:' || chr(10)), (3, 3, 'II', 'user:' || chr(10) || 'assistant:' || chr(10))),
moves(s2, what, initial, t) AS (VALUES
  (0, 'K', 's', 1), (0, 'K', 'u', 2), (0, 'R', NULL, 2), (1, 'K', 'u', 2), (1, 'R', NULL, 2),
  (2, 'K', 'a', 3), (2, 'R', NULL, 3), (3, 'K', 'u', 2), (3, 'R', NULL, 2)),
steps AS (
  SELECT s, t, what, initial, letters || what AS letters, lines, 3 * length(letters) + CASE what WHEN 'R' THEN 3 ELSE 0 END AS cost
  FROM inserts JOIN moves USING (s2)
  UNION ALL SELECT s, s, 'D', NULL, 'D', '', 4 FROM (VALUES (0), (1), (2), (3)) v(s)),
chain(conv_id, i, s, cost, audit, fixed) AS (
  SELECT conv_id, CAST(0 AS BIGINT), 0, CAST(0 AS BIGINT), CAST('' AS VARCHAR), CAST('' AS VARCHAR) FROM counts
  UNION ALL
  SELECT conv_id, i, t, min(cost), arg_min(audit, (cost, audit)), arg_min(fixed, (cost, audit)) FROM (
    SELECT c.conv_id, r.i, x.t, c.cost + x.cost + CASE WHEN r.truncated AND x.what <> 'D' THEN 3 ELSE 0 END AS cost,
      c.audit || x.letters AS audit,
      c.fixed || x.lines || CASE x.what WHEN 'K' THEN r.role || ':' || r.text || chr(10) WHEN 'D' THEN ''
        ELSE CASE x.t WHEN 2 THEN 'user:' ELSE 'assistant:' END || r.text || chr(10) END AS fixed
    FROM chain c JOIN faults r ON r.conv_id IS NOT DISTINCT FROM c.conv_id AND r.i = c.i + 1
    JOIN steps x ON x.s = c.s AND (x.what = 'D' OR NOT (r.blank OR r.duplicate)) AND (x.initial IS NULL OR x.initial = r.initial))
  GROUP BY conv_id, i, t),
tails(s, letters, lines) AS (VALUES (0, '', ''), (1, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)),
  (2, 'I', 'assistant:' || chr(10)), (3, '', '')),
ended AS (
  SELECT c.conv_id, c.cost + 3 * length(letters) AS cost, c.audit || letters AS audit, c.fixed || lines AS fixed
  FROM chain c JOIN counts n ON n.conv_id IS NOT DISTINCT FROM c.conv_id AND n.n = c.i JOIN tails USING (s)),
best AS (SELECT conv_id, min(cost) AS cost, arg_min(audit, (cost, audit)) AS audit, arg_min(fixed, (cost, audit)) AS fixed
  FROM ended GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(n.gaps, 0) AS BIGINT) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate,
  coalesce(n.truncated, 0) AS truncated, coalesce(n.illegal, 0) AS illegal, CAST(coalesce(b.cost, 0) AS BIGINT) AS cost,
  coalesce(b.audit, '') AS audit, sha256(left(coalesce(b.fixed, ''), greatest(length(coalesce(b.fixed, '')) - 1, 0))) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
"""
