"""Small documents with the awkward cases that every operator has to stand."""

from __future__ import annotations

import random

LONG = " ".join(f"word{k}" for k in range(30_000))
SYLLABLES = ["the", "ka", "lo", "mi", "ta", "re", "és", "ün", "so", "pa", "qui", "zen"]


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices(SYLLABLES, k=r.randint(1, 4))) for _ in range(words))


def documents() -> list[tuple[int | None, str | None]]:
    """(doc_id, text): nulls, empty and long texts, ties, repeated rows, near copies."""
    base = prose(1, 220)
    near = base.split()
    near[100] = "changed"
    return [
        (1, base), (2, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, LONG),
        (None, base), (None, None), (8, prose(2, 60)), (9, prose(2, 60) + "\n" + prose(3, 80)),
        (10, "Ünïcødé   text here 日本語 " + prose(4, 40)), (11, "a b c"), (12, "A  B\tc"), (13, "!!!! ????"),
        (14, "line one\nline one\n\nline two\nline one"), (15, "x" * 5000), (16, prose(5, 12) + " " + prose(5, 12)),
        (17, prose(6, 400)), (18, prose(6, 390) + " " + prose(7, 10)), (19, "tail  "), (20, "  head"),
    ]


def frame(spark, rows=None, extra: dict[str, object] | None = None):
    """Documents as a DataFrame, with extra columns if asked."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(documents() if rows is None else rows, "doc_id bigint, text string")
    for name, value in (extra or {}).items():
        df = df.withColumn(name, F.lit(value))
    return df


#: names that operators use inside
CLASHES = {"hits": 1, "counts": 2, "key": 3, "node": "x", "low": 5, "id": 6, "body": "b", "digest": "d", "chunk": 9,
           "n": 10, "h": 11, "first": 12, "copy": 13, "secret_spans": 14, "candidate_key": 15, "gone_id": 16,
           "shard": 17, "rank": 18, "size": 19, "component_id": 20, "lang_": "z"}


def rows_of(df, *columns) -> list[tuple]:
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
