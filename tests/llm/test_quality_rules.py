import math
import re
from collections import Counter

from cases import CLASHES, documents, frame, prose, rows_of
from pyspark.sql import functions as F

from sitegraph.llm import quality_rules as Q


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    many = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if many[w] > 1 for j in range(5)}
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")) if words else 0, dups, len(inside))


def test_counts_equal_brute_force(spark):
    df = frame(spark).select("doc_id", "text", Q.counts(F.col("text")).alias("c"))
    for r in df.collect():
        assert tuple(r.c)[:5] == base_counts(r.text)


def test_binomial_tail_is_exact():
    for n, k, p in ((10, 3, 0.2), (50, 0, 0.05), (200, 12, 0.05), (7, 7, 0.5), (5, -1, 0.1)):
        want = sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(Q.binomial_tail(k, n, p) - want) < 1e-12


def labelled(spark, good, bad):
    """good clean texts and bad ones full of symbols, in two strata."""
    rows = [(k, prose(k, 30), "en" if k % 2 else "fr") for k in range(good)]
    rows += [(good + k, " ".join(w + "%%%" for w in prose(k, 30).split()), "en" if k % 2 else None) for k in range(bad)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(k, int(k < good)) for k in range(good + bad)] + [(10 ** 9, 1), (None, 0)],
                                   "doc_id bigint, quality int")
    return docs, labels


def test_cutoffs_keep_their_promise(spark):
    docs, labels = labelled(spark, 3000, 200)
    chosen = Q.fit(docs, labels)
    kept = Q.keep_good(docs, chosen)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns
    assert sum(k < 3000 for k in ids) >= 0.95 * 3000
    assert sum(k >= 3000 for k in ids) == 0


def test_few_labels_reject_nothing_but_the_base(spark):
    docs, labels = labelled(spark, 40, 10)
    chosen = Q.fit(docs, labels)
    assert not [k for k in chosen if k[1]]
    assert Q.keep_good(docs, chosen).count() == 50
    assert Q.keep_good(docs, Q.fit(docs, labels.limit(0))).count() == 50


def test_no_stratum_gets_the_cutoffs_of_others(spark):
    """202 strata with cutoffs of their own, also the smallest; a stratum without labels,
    whose clean texts look like the others' bad ones, loses nothing to the rules."""
    names = [f"l{k:03d}" for k in range(202)]
    features = spark.range(202 * 1500).select(
        F.col("id").alias("key"), F.format_string("l%03d", (F.col("id") % 202).cast("int")).alias("s"),
        (F.col("id") >= 202 * 1400).alias("bad"))
    # fewer labels by 100 for the last stratum
    features = features.where("s <> 'l201' OR bad OR key >= 202 * 100")
    zero = F.lit(0).cast("bigint")
    features = features.withColumn("c", F.struct(*[
        {"n_words": F.lit(100), "word_chars": F.lit(500), "n_lines": F.lit(10),
         "n_symbols": F.when(F.col("bad"), 50).otherwise(0)}.get(n, zero).cast("bigint").alias(n) for n in Q.COUNTS]))
    labels = features.select(F.col("key").alias("doc_id"), (~F.col("bad")).cast("int").alias("quality"))
    chosen = Q.cutoffs(features, labels, "key", "s", "c")
    assert {s for s, r in chosen if r == "symbol_ratio"} == {*names, None}
    symbols = " ".join(w + "%%%" for w in prose(1, 30).split())
    docs = spark.createDataFrame([(1, symbols, "l201"), (2, symbols, "rare"), (3, prose(1, 30), "rare"), (4, symbols, None)],
                                 "doc_id bigint, text string, lang string")
    assert rows_of(Q.keep_good(docs, chosen), "doc_id") == [(2,), (3,)]


def test_a_text_is_one_trial_however_often_it_comes(spark):
    """Copies prove nothing: one good text on 3,000 rows, under one id or many, certifies no
    cutoff; 3,000 different texts do, and copies of them change nothing."""
    text, schema = prose(1, 30), "doc_id bigint, text string, lang string"
    labels = spark.createDataFrame([(k, 1) for k in range(3000)], "doc_id bigint, quality int")
    for ids in (lambda k: 0, lambda k: k):
        copies = spark.createDataFrame([(ids(k), text, "en") for k in range(3000)], schema)
        assert not dict(Q.fit(copies, labels))
    docs = spark.createDataFrame([(k, prose(k, 12), "en") for k in range(3000)], schema)
    once = dict(Q.fit(docs, labels))
    assert once and dict(Q.fit(docs.unionAll(docs.where("doc_id < 50")).unionAll(docs), labels)) == once


def test_best_cutoff_is_certified_and_useful():
    import numpy as np
    bins, good = np.array([0, 40, 150]), np.array([5000, 60, 2])
    # bin 40 could go by the risk, but nothing bad lies there
    assert Q.best_cutoff(bins, good, np.array([0, 0, 90]), 0.05, 0.01, 200) == 149 / 200
    assert Q.best_cutoff(bins, good, np.array([0, 80, 90]), 0.05, 0.01, 200) == 39 / 200
    # the walk ends at the first cutoff that cannot be certified
    assert Q.best_cutoff(np.array([0, 150]), np.array([5000, 500]), np.array([90, 90]), 0.05, 0.01, 200) == 1.0
    assert Q.best_cutoff(np.array([0]), np.array([10]), np.array([5]), 0.05, 0.01, 200) is None


def test_awkward_rows_and_columns(spark):
    docs = frame(spark, extra={**CLASHES, "lang": None})
    out = Q.keep_good(docs, {})
    assert out.columns == docs.columns
    want = sorted((d, t) for d, t in documents() if not failed(t) and d is not None)
    assert sorted(x for x in rows_of(out, "doc_id", "text") if x[0] is not None) == want
    assert Q.keep_good(docs.limit(0), {}).count() == 0


def failed(text):
    n, _, _, _, repeated = base_counts(text)
    return n < 10 or 100 * repeated > 20 * n
