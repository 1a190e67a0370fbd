import hashlib
import re

import pytest
from cases import CLASHES, documents, frame, prose, rows_of
from pyspark.sql import functions as F

from sitegraph.llm import decontaminate as D


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items, n=10):
    own, hit, found = words(text), set(), set()
    for item, body in items:
        w = words(body)
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            for i in range(len(own) - size + 1):
                if own[i:i + size] == w[k:k + size]:
                    hit |= set(range(i, i + size))
                    found.add(item)
    listed = sorted(str(i) for i in found if i is not None)
    return len(own), len(hit), listed


ITEMS = [(1, prose(1, 30)), (2, "SHORT Item"), (2, "short item!"), (3, None), (4, "..."), (None, "Ünïcødé text"),
         (11, prose(2, 12)), (100, " ".join(prose(17, 50).split()[3:14])), (12, "word7 word8 word9")]


def corpus(spark, extra=None):
    rows = documents()[:7] + [(7, " ".join(f"word{k}" for k in range(300)))] + documents()[8:14] + [
        (30, prose(17, 50) + " tail"), (31, "a SHORT,item b. Short item"), (32, prose(2, 12).upper()), (33, "ÜNÏCØDÉ text Ünïcødé text")]
    return frame(spark, rows, extra), spark.createDataFrame(ITEMS, "item_id bigint, text string")


@pytest.mark.parametrize("block", [D.BLOCK_BYTES, 100])
def test_equals_brute_force(spark, block):
    docs, items = corpus(spark, CLASHES)
    found, name = D.find_hits(docs, items, block_bytes=block)
    assert found.columns == [*docs.columns, name]
    for r in found.collect():
        h = r[name]
        assert (h.n_words, h.n_hit, h["items"]) == brute(r.text, ITEMS), r.doc_id
        assert sum(s.end - s.start for s in h.hits) == h.n_hit


def test_removal(spark):
    docs, items = corpus(spark, CLASHES)
    clean = D.decontaminate(docs, items)
    assert clean.columns == docs.columns
    assert rows_of(clean, "doc_id", "text") == sorted(
        ((r.doc_id, r.text) for r in docs.collect() if not brute(r.text, ITEMS)[1]), key=repr)
    spans = D.decontaminate(docs, items, remove="spans")
    assert spans.columns == docs.columns and spans.count() == docs.count()
    left = {r.doc_id: r.text for r in spans.where("doc_id >= 30").collect()}
    assert left[31] == "a  b. " and left[4] is None if 4 in left else left[31] == "a  b. "
    with pytest.raises(ValueError):
        D.decontaminate(docs, items, remove="lines")


def test_empty_tables(spark):
    docs, items = corpus(spark)
    found, name = D.find_hits(docs, items.limit(0))
    assert found.where(F.col(f"{name}.n_hit") > 0).count() == 0 and found.count() == docs.count()
    assert D.decontaminate(docs.limit(0), items).count() == 0


def test_digest_column(spark, tmp_path):
    docs, items = corpus(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    for r in D.op5_decontaminate(spark, str(tmp_path)).join(docs.dropDuplicates(["doc_id"]), "doc_id").collect():
        listed = brute(r.text, ITEMS)[2]
        assert (r.n_items, r.items_sha256) == (len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest())
