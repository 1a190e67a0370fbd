import random
import re

import numpy as np
import pytest
from cases import CLASHES, documents, frame, prose, rows_of
from pyspark.sql import functions as F

from sitegraph.llm import ngram_join as J
from sitegraph.llm.common import Scratch
from sitegraph.llm.components import connected_components


def grams(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [grams(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        own = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(own, default=None)))
    return sorted(out, key=repr)


def edited(text, r, edits):
    w = text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"e{r.randrange(10 ** 6)}"
    return " ".join(w)


@pytest.mark.parametrize("options", [{}, {"block_rows": 6}, {"frequent": 3, "block_rows": 2}])
def test_equals_brute_force(spark, options):
    r = random.Random(3)
    base, passage = prose(90, 120), prose(91, 60)
    rows = documents() + [(100 + k, edited(base, r, r.randrange(6))) for k in range(40)]
    rows += [(200 + k, prose(k, 10) + " " + passage) for k in range(15)] + [(300 + k, passage) for k in range(3)]
    rows += [(400, "P Q R s"), (401, "p q r S"), (402, "p q r s t"), (403, prose(92, 30)), (404, prose(92, 36))]
    docs = frame(spark, rows, CLASHES).repartition(3)
    assert rows_of(J.jaccard_components(docs, **options), "doc_id", "n_shingles", "component_id") == brute(rows)


def test_parities_never_differ_in_more_places_than_the_sets(spark):
    r = random.Random(5)
    for size in (0, 1, 7, 60, 900):
        for _ in range(30):
            x = np.unique(np.array([r.getrandbits(64) for _ in range(size)], dtype=np.uint64))
            y = np.unique(np.append(x[r.randrange(size + 1):], np.array([r.getrandbits(64) for _ in range(9)], dtype=np.uint64)))
            k, differ = J.apart(J.parities(x)[None], J.parities(y)[None])[0], len(np.setxor1d(x, y))
            assert k <= differ and (differ - k) % 2 == 0


def near_copies(n, centre):
    """Copies of one text of 60 words with one word changed each, with or without that text."""
    r, base = random.Random(11), prose(95, 60).split()
    rows = [(0, " ".join(base))] if centre else []
    for k in range(n):
        w = list(base)
        w[r.randrange(60)] = f"x{k}"
        rows.append((k + 1, " ".join(w)))
    return rows


@pytest.mark.parametrize("centre", [True, False])
def test_groups_of_near_copies_with_and_without_a_centre(spark, centre, monkeypatch):
    """What the products pass on grows with the rows, not with the square of a group."""
    made = {}

    def counted(name):
        plain = getattr(J, name)

        def run(*args):
            out = Scratch(spark, "t").save(plain(*args), "t")
            made[name] = made.get(name, 0) + out.count()
            return out
        monkeypatch.setattr(J, name, run)

    counted("_products")
    rows = {}
    for n in (150, 600):
        made.clear()
        docs = near_copies(n, centre)
        assert rows_of(J.jaccard_components(frame(spark, docs).repartition(3)), "doc_id", "n_shingles", "component_id") == brute(docs)
        rows[n] = made["_products"]
    assert rows[600] <= 6 * rows[150] + 600


def test_long_texts_that_share_a_passage_make_no_pairs(spark, monkeypatch):
    """The parities of large sets too discard unlike pairs inside the product."""
    made = []

    def run(*args):
        out = Scratch(spark, "t").save(plain(*args), "t")
        made.append(out.count())
        return out
    plain = J._products
    monkeypatch.setattr(J, "_products", run)
    passage = prose(97, 60)
    docs = [(k, prose(2000 + k, 1500 + 40 * (k % 3)) + " " + passage) for k in range(60)]
    docs += [(100 + k, edited(docs[k][1], random.Random(k), 20)) for k in range(3)]
    out = rows_of(J.jaccard_components(frame(spark, docs).repartition(3), frequent=1), "doc_id", "n_shingles", "component_id")
    assert out == brute(docs)
    assert made and max(made) <= 2 * len(docs)


def test_folded_parities_never_differ_in_more_places_than_the_sets():
    import pyarrow as pa
    r = random.Random(6)
    sets = [np.unique(np.array([r.getrandbits(64) for _ in range(n)], dtype=np.uint64)) for n in (1, 700, 740, 2000, 3000, 6000)]
    sets += [np.unique(np.append(x[r.randrange(len(x) // 8 + 1):], np.array([r.getrandbits(64)], dtype=np.uint64))) for x in sets]
    words = [J.parity_words(len(x)) for x in sets]
    assert all(w == J.WORDS or w * 64 >= 0.7 * len(x) for w, x in zip(words, sets)) and len(set(words)) > 3
    assert J.parity_words(10 ** 7) == J.MOST_WORDS
    odd = J._word_rows(pa.chunked_array([pa.array([J.parities(x, w).tobytes() for x, w in zip(sets, words)], type=pa.binary())]))
    i, j = (x.ravel() for x in np.indices((len(sets), len(sets))))
    differ = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j)])
    k = J.differing(odd, i, j)
    assert (k <= differ).all() and ((differ - k) % 2 == 0).all() and (k[i == j] == 0).all()


def test_a_task_passes_a_pair_on_once_whatever_the_batches(spark):
    """The n-grams that two sets share in columns of several Arrow batches are counted together."""
    rows = [(h, 0, 1, node, 100, node, True, J.parities(np.array([], dtype=np.uint64)).tobytes())
            for h in range(40) for node in range(3 if h % 2 else 70)]
    columns = spark.createDataFrame(rows, "h bigint, block int, blocks int, node bigint, n bigint, root bigint, early boolean, "
                                    "odd binary")
    own = {"spark.sql.execution.arrow.maxRecordsPerBatch": "50", "spark.sql.shuffle.partitions": "1"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        made = J._products(columns, 75, lambda a, na, b, nb, k: J._counted(a, na, b, nb), J.PRODUCT)
        got = rows_of(made, "a", "b", "shared")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == sorted(((a, b, 40 if b < 3 else 20) for b in range(70) for a in range(b)), key=repr)


def test_one_of_each_stays(spark):
    docs = frame(spark, extra=CLASHES)
    out = J.one_of_each(docs)
    assert out.columns == docs.columns
    want = {d for d, _, c in brute(documents()) if d is not None and d == c}
    assert {d for d, in rows_of(out.where("doc_id IS NOT NULL"), "doc_id")} == want
    assert out.where("doc_id = 1").count() == 1 and out.where("doc_id = 2").count() == 0


def test_one_row_of_each_component_stays_whatever_the_ids(spark):
    """Ids on several texts, near copies under one id, null ids, empty texts."""
    a, b, c, d, e = (prose(k, 120) for k in range(300, 305))
    near = a.replace(a.split()[60], "changed", 1)
    rows = [(3, a), (7, a), (7, b), (7, c), (7, c), (8, near), (8, d), (3, near), (3, a + " "), (None, a), (None, d),
            (None, e), (None, e), (None, e + " "), (9, ""), (9, ""), (9, b), (None, None), (None, None), (10, None)]
    docs = frame(spark, rows, CLASHES).repartition(3)
    out = J.one_of_each(docs)
    assert out.columns == docs.columns
    first = min(a, near, key=lambda t: J.node_of(J.ngram_set(t.encode())))  # equal ids: the smaller node
    assert rows_of(out, "doc_id", "text") == sorted(
        [(3, first), (7, b), (7, c), (8, d), (None, e), (9, ""), (None, None), (10, None)], key=repr)


def test_empty_table(spark):
    assert J.jaccard_components(frame(spark).limit(0)).count() == 0
    assert J.one_of_each(frame(spark).limit(0)).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    path = [(k, k + 1) for k in range(0, 200)]
    random.Random(1).shuffle(path)
    star = [(1000, 1000 + k) for k in range(1, 50)] + [(5, 5)]
    edges = spark.createDataFrame(path + star, "a bigint, b bigint")
    roots = connected_components(edges, Scratch(spark, "t"), "t")
    assert roots.count() == 201 + 50
    assert roots.select("root").distinct().count() == 2
    assert roots.groupBy("node").count().where(F.col("count") > 1).count() == 0


def test_common_passages_make_no_pairs(spark):
    """A passage in every document must not bring all of them together."""
    passage = prose(7, 55)
    rows = [(k, prose(1000 + k, 400) + " " + passage) for k in range(300)]
    docs = frame(spark, rows)
    often = J.frequent_ngrams(docs, 5, 1000)
    table = J.shared_columns(J.prefixes(docs, often, 5, 75).select(
        "node", "n", F.posexplode("prefix").alias("pos", "h")).withColumn("early", J.early(75)), often, 50_000)
    assert table.count() < 300
    assert J.jaccard_components(docs).where("component_id != doc_id").count() == 0


def test_sets_of_a_column_are_those_of_its_texts():
    import pyarrow as pa
    texts = [None, "", " ", "a", " A b\tc\n", "\x0b a\x0cb c d e f g a b c d e", "é É x y z   w", "a b c d", "a " * 9,
             "x\x00y z\x1fq r s t u v", "one two three four five"]
    for column in (pa.array(texts), pa.array(texts).slice(3, 6), pa.array([], pa.string()), pa.array([None, None], pa.string())):
        for size in (1, 3, 5, 8):
            for most in (1, 9, 1 << 22):
                own = [J.ngram_set((t or "").encode(), size) for t in column.to_pylist()]
                got = list(J.ngram_sets(column, size, most))
                assert [g.tolist() for g in got] == [o.tolist() for o in own]
