import zlib

from cases import CLASHES, frame, prose
from pyspark.sql import functions as F

from sitegraph.llm import compress_classifier as C


def corpus(spark):
    rows = [(k, prose(k, 80) if k % 3 else " | ".join(w + "!!" for w in prose(k, 80).upper().split())) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return docs, spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(900)], "doc_id bigint, quality int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    out = C.score_documents(docs, C.fit(docs, labels)).collect()
    assert len(out) == 900
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)


def test_only_training_rows_are_learnt_from(spark):
    docs, labels = corpus(spark)
    held = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert C.fit(docs, labels) == C.fit(docs, turned)


def test_awkward_rows_and_columns(spark):
    docs, labels = corpus(spark)
    model = C.fit(docs, labels)
    out = C.score_documents(frame(spark, extra=CLASHES), model).collect()
    assert len(out) == frame(spark).count() and all(0 <= r.score <= 1 for r in out)
    assert C.score_documents(docs.limit(0), model).count() == 0


def test_without_labels_of_both_classes(spark):
    docs, labels = corpus(spark)
    for some, low, high in ((labels.limit(0), 0.4, 0.6), (labels.where("quality = 1"), 0.9, 1.0)):
        scores = {r.score for r in C.score_documents(docs, C.fit(docs, some)).collect()}
        assert len(scores) == 1 and low <= scores.pop() <= high


def test_too_few_samples_are_the_dictionary():
    assert C.dictionary([b"abc", b"def"]) == b"abcdef"
    assert C.dictionary([]) == b""
