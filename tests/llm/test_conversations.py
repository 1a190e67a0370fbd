import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sitegraph.llm import conversations as C
from sitegraph.llm.common import Scratch

GOOD = re.compile("(s?(ua)+)?")


def damaged(rows):
    """The rule of the query, row by row."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if what == 0:
            continue
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        out += [(conv, turn, "user" if what == 4 else role, text)] * (2 if what == 3 else 1)
    return out


def faults(rows):
    """Fault of each row of one conversation, in order: b, d, t or none."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(" \t\n\v\f\r")
        out.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def every_repair(rows, fault, most):
    """All edit lists of a cost up to ``most``: (cost, audit, repaired rows)."""
    def grow(k, cost, audit, done):
        if cost > most:
            return
        if k == len(rows):
            if GOOD.fullmatch("".join(r[:1] or "?" for r, _ in done)):
                yield cost, audit, done
        for role in ("user", "assistant"):
            if audit[-2:] != "II" and cost + 3 <= most:
                yield from grow(k, cost + 3, audit + "I", done + [(role, "")])
        if k < len(rows):
            role, text = rows[k]
            yield from grow(k + 1, cost + 4, audit + "D", done)
            if fault[k] not in ("b", "d"):
                more = cost + 3 * (fault[k] == "t")
                yield from grow(k + 1, more, audit + "K", done + [(role, text)])
                for other in ("user", "assistant"):
                    yield from grow(k + 1, more + 3, audit + "R", done + [(other, text)])
    yield from grow(0, 0, "", [])


def brute(rows):
    fault = faults(rows)
    for most in itertools.count(0):
        found = list(every_repair(rows, fault, most))
        if found:
            return min(found, key=lambda x: x[:2])


ROLES = ["system", "user", "assistant", "user", "assistant", "tool", ""]


def short_rows(r, most=5):
    texts = ["Yes.", "No", "Well!", "", " \n", "a?  ", "b\t"]
    return [(r.choice(ROLES), r.choice(texts)) for _ in range(r.randint(1, most))]


def kinds_of(rows):
    code = {"": C.FINE, "t": C.TRUNCATED, "b": C.BLANK, "d": C.DUPLICATE}
    return bytes((C.INITIALS.find(role[0]) % 4 if role else 3) * 4 + code[f] for (role, _), f in zip(rows, faults(rows)))


@pytest.mark.parametrize("seed", range(8))
def test_divide_and_conquer_equals_all_edit_lists(seed):
    r = random.Random(seed)
    for _ in range(12):
        rows = short_rows(r)
        cost, audit, _ = brute(rows)
        assert C.solved_segment(kinds_of(rows), C.START, None, True, -1)[:2] == (audit, cost)


def test_segments_meet_like_the_whole():
    r = random.Random(5)
    for _ in range(200):
        kinds = bytes(r.randrange(16) for _ in range(r.randint(2, 60)))
        whole = C.solved_segment(kinds, C.START, None, True, -1)
        cuts = sorted({0, len(kinds), *(r.randrange(1, len(kinds)) for _ in range(r.randint(1, 5)))})
        pieces = [kinds[a:b] for a, b in zip(cuts, cuts[1:])]
        borders = C.border_states([([C.forward(p, C.at_state(s)) for s in range(4)], p[-1]) for p in pieces])
        parts = [C.solved_segment(p, *b) for p, b in zip(pieces, borders)]
        assert ("".join(p[0] for p in parts), *(sum(p[k] for p in parts) for k in range(1, 6))) == whole


def expected(given):
    out = []
    rows = damaged(given)
    for conv in {g[0] for g in given}:
        own = sorted((r for r in rows if r[0] == conv),
                     key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))
        turns = {r[1] for r in own} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        pairs = [(r[2], r[3]) for r in own]
        fault = faults(pairs)
        initials = [role[:1] for role, _ in pairs]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, fixed = brute(pairs) if pairs else (0, "", [])
        text = "\n".join(f"{a}:{b}" for a, b in fixed)
        out.append((conv, gaps, fault.count("b"), fault.count("d"), fault.count("t"), illegal, cost, audit,
                    hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_query_equals_brute_force(spark, tmp_path):
    r = random.Random(2)
    given = []
    for conv in range(60):
        turn = 0
        for role, text in short_rows(r, 4):
            turn += r.choice([1, 1, 1, 2])
            given.append((conv, turn, role, text))
    given += [(None, 1, "user", "Hi."), (None, 2, "assistant", None), (None, None, None, "Odd."), (70, None, "user", "x."),
              (70, None, "assistant", "y!"), (71, 4, None, None), (72, 1, "system", "z."), (73, 5, "user", "Ünï ✓."),
              (74, 1, "user", "q."), (74, 1, "user", "q."), (74, 2, "assistant", "q.")]
    spark.createDataFrame(given, SCHEMA).selectExpr("*", "1 AS kind", "'p' AS piece", "0 AS digest").write.parquet(
        f"{tmp_path}/conversations.parquet")
    got = C.op13_conversation_repair(spark, str(tmp_path)).collect()
    assert sorted([tuple(x[c] for c in COLUMNS) for x in got], key=repr) == expected(given)


def test_a_hot_conversation_spans_partitions(spark):
    """One conversation has most rows; its edits are those of the undivided program."""
    r = random.Random(7)
    rows = [(1, k, r.choice(ROLES[:5]), f"text {k}" + r.choice(["", "."])) for k in range(3000)]
    rows += [(c, k, "user", f"t{k}.") for c in range(2, 30) for k in range(5)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    scratch = Scratch(spark, "test-conversations")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert C.segments(C.marks(df)).where("conv_id = 1").count() > 1
        got = {x.conv_id: x for x in C.audits(df, scratch).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    own = [(role, text) for c, _, role, text in rows if c == 1]
    audit, cost, *_ = C.solved_segment(kinds_of(own), C.START, None, True, -1)
    assert (got[1].audit, got[1].cost) == (audit, cost)
    turns = C.repaired_turns(df, C.audits(df, scratch)).where("conv_id = 1").orderBy("place").collect()
    assert GOOD.fullmatch("".join(t.role[0] for t in turns))
    kept = [t.text for t in turns if t.edit == "K"]
    assert kept == [x[1] for x, e in zip(own, audit.replace("I", "")) if e == "K"]


def test_long_texts_and_empty_table(spark, tmp_path):
    long = "word " * 200_000
    df = spark.createDataFrame([(1, 1, "user", long + "end."), (1, 2, "assistant", long)], SCHEMA)
    turns = C.repaired_turns(df, C.audits(df, Scratch(spark, "test-long"))).collect()
    assert sorted((t.place, t.edit, len(t.text)) for t in turns) == [(0, "K", 1_000_004), (1, "K", 1_000_000)]
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert C.op13_conversation_repair(spark, str(tmp_path)).collect() == []
