import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from cases import CLASHES, documents, frame
from pyspark.sql import functions as F

from sitegraph.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "a", " a", "a ", "a  b", "\n a", "x\n\n y \tz", "don't I'll we've 's", "<|endoftext|> a", "  b", "  ",
       "a b", "é è́ x", "日本 語 、", "a\x1c b", "tok<|endoftext|>", "A!! b%%% c** d| (e) [f] {g}~", "ǅ ʼn ×a ÷b", "a​ b"]


def test_ids_equal_the_tokenizer():
    encoder, _ = P.encoder(PATH)
    texts = ODD + [t or "" for _, t in documents()]
    for _ in range(2):  # the second time from memory
        for text, own, ids in zip(texts, encoder.encode(texts), encoder._whole(texts)):
            assert own == ids, text


def test_pieces(spark):
    rows = documents() + [(100 + k, t) for k, t in enumerate(ODD)]
    encoder, _ = P.encoder(PATH)
    out = P.pack(frame(spark, rows, CLASHES).coalesce(2), PATH, block=5000).collect()
    ids = defaultdict(list)
    for (d, t) in rows:
        ids[d].append(np.append(np.frombuffer(encoder._whole([t or ""])[0], dtype="<u4"), np.uint32(0)).astype("<u4"))
    covered, sequences = defaultdict(int), defaultdict(list)
    for r in out:
        assert r.length > 0
        own = next(x for x in ids[r.doc_id] if len(x) == r.doc_tokens
                   and zlib.crc32(x[r.start:r.start + r.length].tobytes()) == r.ids_crc32)
        assert r.start + r.length <= len(own)
        covered[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert covered == {d: sum(map(len, x)) for d, x in ids.items()}
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024


def brute(at, cost, length):
    """Least cost of cutting, by trying every earlier cut."""
    best = [0]
    for j in range(1, len(at)):
        options = []
        for i in range(j):
            size = at[j] - at[i]
            if size <= length:
                power = size >= 32 and size & (size - 1) == 0
                options.append(best[i] + (0 if power else length - size))
        best.append(min(options) + cost[j] + P.SEQUENCE_COST)
    return best[-1]


def test_cuts_are_optimal():
    r = random.Random(2)
    for _ in range(60):
        at = np.cumsum([0] + [r.randint(1, 90) for _ in range(r.randint(1, 120))])
        cost = np.array([0] + [r.choice([0, 4, 32]) for _ in at[1:]])
        cuts = P.best_cuts(at, cost, 256)
        where = {p: i for i, p in enumerate(at.tolist())}
        total = 0
        for a, b in zip(cuts, cuts[1:]):
            size = b - a
            assert size <= 256
            total += (0 if size >= 32 and size & (size - 1) == 0 else 256 - size) + cost[where[b]] + P.SEQUENCE_COST
        assert cuts[0] == 0 and cuts[-1] == at[-1] and total == brute(at.tolist(), cost.tolist(), 256)


@pytest.mark.parametrize("sizes", [[5], [3000], [1024, 1, 1023], [700]])
def test_every_gap_can_be_cut(sizes):
    ends = np.cumsum(sizes)
    at, cost = P.cut_positions(ends, np.array([], dtype=np.int64))
    assert np.diff(at).max() <= P.GRID and set(ends) <= set(at) and at[0] == 0
    assert P.best_cuts(at, cost)[-1] == ends[-1]


def test_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    size = P.pack(docs, PATH).groupBy("sequence_id").agg(F.sum("length").alias("n"))
    power = (F.col("n") >= 1) & (F.col("n").bitwiseAND(F.col("n") - 1) == 0)
    padding, tokens = size.agg(F.sum(F.when(power, 0).otherwise(1024 - F.col("n"))), F.sum("n")).first()
    assert padding < 0.03 * tokens


def test_empty_table(spark):
    assert P.pack(frame(spark).limit(0), PATH).count() == 0
