import hashlib
import random
import re

import numpy as np
import pytest
from cases import CLASHES, documents, frame, prose

from sitegraph.llm import suffix_dedup as S


def brute(rows, length):
    """One entry for each row; rows of one id share their places."""
    order = sorted({(S.LAST_ID if d is None else d, t or "") for d, t in rows})
    first = {}
    for d, t in order:
        b = t.encode()
        for p in range(len(b) - length + 1):
            w = b[p:p + length]
            first[w] = min(first.get(w, (d, p)), (d, p))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p:p + length]] != (S.LAST_ID if d is None else d, p):
                gone[p:p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r)[:5] for r in df.drop("spans").collect()), key=repr)


@pytest.mark.parametrize("chunk", [S.CHUNK_BYTES, 3000])
def test_equals_brute_force(spark, chunk):
    r = random.Random(5)
    passage = prose(50, 40)
    rows = documents() + [(100 + k, prose(k, r.randint(5, 60)) + " " + passage[r.randint(0, 30):] + prose(200 + k, 20))
                          for k in range(25)]
    rows += [(200, passage[:100]), (201, passage[3:103]), (202, passage[3:102]), (203, "ab" * 400), (204, "é" * 90 + passage)]
    rows = [(d, t if t is None else t[:9000]) for d, t in rows]
    df = frame(spark, rows, CLASHES)
    assert got(S.suffix_dedup(df, chunk_bytes=chunk, bucket_names=50)) == brute(rows, 100)


def test_every_pair_of_residues_meets_in_the_cover():
    assert {(a - b) % S.PERIOD for a in S.COVER for b in S.COVER} == set(range(S.PERIOD))


def test_packing_is_lossless():
    for values in ([], [0], [5, 5, 9], [0, 1 << 40, (1 << 64) - 1]):
        v = np.array(values, dtype=np.uint64)
        assert (S.unpacked(S.packed(v)) == v).all()


def test_anchor_follows_the_bytes():
    data = np.frombuffer((prose(1, 200) + prose(2, 30) + prose(1, 200)).encode(), dtype=np.uint8)
    at = S.anchors(data, 100) - np.arange(len(data) - 99)
    text = data.tobytes()
    places = {}
    for p in range(len(data) - 99):
        assert places.setdefault(text[p:p + 100], at[p]) == at[p]


def test_empty_table_and_spans(spark):
    assert S.suffix_dedup(frame(spark).limit(0)).count() == 0
    rows = [(1, "x" * 150), (2, "y" + "x" * 120)]
    out = {r.doc_id: [tuple(s) for s in r.spans] for r in S.suffix_dedup(frame(spark, rows)).collect()}
    assert out == {1: [(1, 150)], 2: [(1, 121)]}


def hot_rows():
    """A passage in many documents, each time between other words: its edges share their anchors."""
    passage = prose(70, 30)
    rows = [(k, f"{prose(300 + k, 25)} {passage} {prose(600 + k, 25)}") for k in range(60)]
    return rows + [(5, rows[5][1]), (7, rows[8][1]), (7, prose(9, 3) + rows[8][1]), (None, rows[9][1][40:]), (90, None)]


@pytest.mark.parametrize("chunk", [S.CHUNK_BYTES, 2500])
def test_heavy_buckets_dealt_again_equal_brute_force(spark, chunk):
    rows = hot_rows()
    assert got(S.suffix_dedup(frame(spark, rows), chunk_bytes=chunk, bucket_names=50, heavy_bytes=3000, part_bytes=1000)) == brute(rows, 100)


def test_no_task_gets_a_heavy_bucket(spark, tmp_path, monkeypatch):
    """However many edges a passage has, what one task compares is bounded (the log is of the workers)."""
    from pyspark.sql import functions as F
    sizes = {}
    save = S.Scratch.save
    monkeypatch.setattr(S.Scratch, "save", lambda self, df, name: sizes.setdefault(name, save(self, df, name)))
    S.suffix_dedup(frame(spark, hot_rows()), chunk_bytes=2500, heavy_bytes=6000, part_bytes=2000).count()
    loads = {r.bucket: r.load for r in sizes["stretches"].where("bucket >= 0").groupBy("bucket").agg(F.sum("bytes").alias("load")).collect()}
    assert max(loads.values()) > 20000 and sizes["heavy"].count() == sum(x > 6000 for x in loads.values())
    parts = [r.n for r in sizes["parts"].where("part >= 0").groupBy("bucket", "part").agg(F.sum(F.octet_length("suffixes")).alias("n")).collect()]
    assert len(parts) >= 10 and max(parts) < 3 * sum(parts) / len(parts)


def test_hashes_and_anchors_by_slices_are_those_of_the_whole(monkeypatch):
    data = np.frombuffer(prose(3, 600).encode(), dtype=np.uint8)
    at = np.flatnonzero(np.arange(len(data) - 150) % 7 < 3)
    sizes = 100 + at % 50
    whole = S.window_hashes(data, at, 100), S.window_hashes(data, at, sizes, 2), S.anchors_at(data, at, 100)
    monkeypatch.setattr(S, "SLICE", 64)
    for a, b in zip(whole, (S.window_hashes(data, at, 100), S.window_hashes(data, at, sizes, 2), S.anchors_at(data, at, 100))):
        assert (a == b).all()
    assert (whole[0] == S.Hashes(data).windows(at, 100)).all() and (whole[2] == S.anchors(data, 100)[at]).all()
