"""Operator 4: language-model scores by prediction by partial matching (PPM).

The model is a trie of byte contexts of 0 to ``ORDER`` bytes, pretrained on the
training documents.  In a context the next byte has probability
``(count - 1/2) / n`` (n occurrences, d different bytes seen after it) and the
escape to the next shorter context ``d / (2 n)`` (method D).  After an escape the bytes
seen in the longer context are excluded: they cannot come, so n and d of the
shorter context are taken without them.  Below order 0 the bytes not yet excluded
are equally likely.  The score is the sum of log10 probabilities of the bytes of
the lower-cased text and of one end symbol; a text starts in a context of start
symbols.

A (context, byte) pair has one probability under a pretrained model, so the trie
is computed as tables:

1. Documents are dealt into chunks of about ``CHUNK_BYTES``.  A task counts the
   distinct (context, byte) pairs and words of a chunk; the counts of all chunks
   are added up by key.
2. Shorter contexts are sums over the longest ones.  Joins of each order with
   the next shorter one give n and d without the excluded bytes, and the
   probability of every pair that any document holds.
3. The probabilities go back to the chunks that hold the keys, so each chunk meets
   the part of the trie that it needs: a table that follows the chunk's size, not
   the corpus.  Nothing that grows with the corpus is collected or broadcast.

The base score is a unigram model of words with additive smoothing, by the same
route.  Words are keyed by 62-bit hashes, contexts by their bytes.

Defined results: a null or empty text is one end symbol; a null id counts as the
empty text when the folds are dealt (held out); without training documents every
byte is equally likely and the base score is 0 per token; repeated rows are scored
and counted once per row; an empty table gives an empty result; other columns are
left aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.llm.common import LOWER, Scratch, crc_mod, read, release, utf8

ORDER = 4
CHUNK_BYTES, PART_BYTES = 12 << 20, 1 << 20
START, END, SYMBOLS = 0xFF, 0xFE, 255  # bytes that no UTF-8 text has; the start symbol is never predicted
FOLDS, SMOOTHING = 10, 0.1
WORD_BIT = 1 << 62
RESULT_DDL = ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
              "base_score double, score double")


class WordKeys(dict):
    """word -> key with WORD_BIT set, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = (xxhash.xxh3_64_intdigest(word) >> 2) | WORD_BIT
        if len(word) <= 32:
            if len(self) >= 400_000:
                self.clear()
            self[word] = value
        return value


_WORDS = WordKeys()
END_KEY = WordKeys()[b""]  # no word is empty


def tokens(text: bytes) -> np.ndarray:
    """Keys of the words of a lower-cased text and of the end."""
    words = text.split()
    return np.append(np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words)),
                     np.uint64(END_KEY))


def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the (context, byte) pairs of the texts, one after the other, and how
    many each text has (its bytes and the end)."""
    start = bytes([START]) * order
    data = np.frombuffer(b"".join(x for t in texts for x in (start, t, bytes([END]))), dtype=np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    keys = np.zeros(max(0, len(data) - order), dtype=np.uint64)
    for j in range(order + 1):
        keys <<= np.uint64(8)
        keys |= data[j:len(data) - order + j]
    ends = np.cumsum(sizes + order)
    wanted = np.ones(len(data) + 1, dtype=bool)  # by the position of the predicted byte
    for k in range(order):
        wanted[ends - sizes - order + k] = False
    return keys[wanted[order:len(data)]], sizes


def parts_of(texts: list[bytes]) -> Iterator[slice]:
    """Slices of the texts of about PART_BYTES."""
    first, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t) + 1
        if held >= PART_BYTES:
            yield slice(first, k + 1)
            first, held = k + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of their counts."""
    if not keys:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[:len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def chunk_counts(texts: list[bytes], trained: list[bool], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (pairs and words) of some texts, with their counts in training texts."""
    texts = [t.translate(LOWER) for t in texts]
    keys, counts = [], []
    for part in parts_of(texts):
        for learn in (True, False):
            some = [t for t, own in zip(texts[part], trained[part]) if own == learn]
            for found in (grams(some, order)[0], np.concatenate([tokens(t) for t in some])) if some else ():
                k, n = np.unique(found, return_counts=True)
                keys.append(k)
                counts.append(n if learn else np.zeros_like(n))
        if len(keys) >= 8:
            k, n = added(keys, counts)
            keys, counts = [k], [n]
    return added(keys, counts)


def chunk_scores(texts: list[bytes], known: np.ndarray, value: np.ndarray, seen: np.ndarray,
                 order: int) -> list[np.ndarray]:
    """n_tokens, n_known, base score and score of each text.  ``known`` holds the sorted keys."""
    texts = [t.translate(LOWER) for t in texts]
    out: list[list] = [[], [], [], []]
    for part in parts_of(texts):
        some = texts[part]
        keys, sizes = grams(some, order)
        doc = np.repeat(np.arange(len(some), dtype=np.uint64), sizes)
        packed = np.sort((doc << np.uint64(40)) | keys) if order <= 4 else None
        first = np.flatnonzero(np.append(True, packed[1:] != packed[:-1]))
        times = np.diff(np.append(first, len(packed)))
        packed = packed[first]
        at = np.searchsorted(known, packed & np.uint64((1 << 40) - 1))
        out[3].append(np.bincount((packed >> np.uint64(40)).astype(np.int64), value[at] * times, len(some)))
        words = [tokens(t) for t in some]
        n = np.array([len(w) for w in words])
        at = np.searchsorted(known, np.concatenate(words))
        starts = np.cumsum(n) - n
        out[0].append(n)
        out[1].append(np.add.reduceat(seen[at].astype(np.int64), starts))
        out[2].append(np.add.reduceat(value[at], starts))
    return [np.concatenate(x) if x else np.empty(0) for x in out]


def pair_scores(pairs: DataFrame, scratch: Scratch, order: int) -> DataFrame:
    """(key, value): log10 probability of every pair of (key, c), c its training count."""
    mask = [(1 << 8 * (k + 1)) - 1 for k in range(order + 1)]
    seen = scratch.save(pairs.where("c > 0").select("key", "c"), f"order{order}")
    counts, contexts = {order: seen}, {}
    for k in range(order - 1, -1, -1):
        counts[k] = scratch.save(counts[k + 1].groupBy(F.col("key").bitwiseAND(F.lit(mask[k])).alias("key"))
                                 .agg(F.sum("c").alias("c")), f"order{k}")
    for k in range(order, -1, -1):
        own = counts[k].select(F.shiftright("key", 8).alias("u"), "c", "key")
        if k:  # what the next shorter context counts for the bytes seen in this one
            shorter = counts[k - 1].select(F.col("key").alias("low"), F.col("c").alias("excluded"))
            own = own.join(shorter, F.col("key").bitwiseAND(F.lit(mask[k - 1])) == F.col("low"))
        else:
            own = own.withColumn("excluded", F.lit(0).cast("bigint"))
        contexts[k] = scratch.save(own.groupBy("u").agg(
            F.sum("c").alias("n"), F.count("*").alias("d"), F.sum("excluded").alias("a")), f"contexts{k}")

    # value: log10 of the escapes so far; nx and dx: counts that are excluded in the next shorter context
    rows = pairs.select("key", "c", F.lit(0.0).alias("value"), F.lit(0).cast("bigint").alias("nx"),
                        F.lit(0).cast("bigint").alias("dx"), F.lit(False).alias("done"))
    finished = []
    for k in range(order, -1, -1):
        low = F.col("key").bitwiseAND(F.lit(mask[k]))
        if k < order:
            own = counts[k].select(F.col("key").alias("low"), F.col("c").alias("own"))
            rows = rows.join(own, low == F.col("low"), "left").withColumn("c", F.coalesce("own", F.lit(0))).drop("low", "own")
        there = contexts[k].toDF("u", "n", "d", "a")
        rows = rows.join(there, F.shiftright(low, 8) == F.col("u"), "left")
        n, d = F.col("n") - F.col("nx"), F.col("d") - F.col("dx")
        found = F.col("c") > 0
        finished.append(rows.where(found).select("key", (F.col("value") + F.log10((F.col("c") - 0.5) / n)).alias("value")))
        escape = F.when(F.col("u").isNotNull() & (d > 0), F.log10(d / (2 * n))).otherwise(0.0)
        rows = rows.where(~found).select(
            "key", "c", (F.col("value") + escape).alias("value"),
            F.coalesce(F.col("a"), F.lit(0)).alias("nx"), F.coalesce(F.col("d"), F.lit(0)).alias("dx"))
        rows = scratch.save(rows, f"escaped{k}")
    finished.append(rows.select("key", (F.col("value") - F.log10(F.lit(SYMBOLS) - F.col("dx"))).alias("value")))
    out = finished[0]
    for f in finished[1:]:
        out = out.unionAll(f)
    return out


def ppm_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, folds: int = FOLDS,
               chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """RESULT_DDL for every document; the model learns from the rows whose crc32 of
    the id modulo ``folds`` is not 0.  ``order`` is at most 4 (a key has 40 bits)."""
    if not 1 <= order <= 4:
        raise ValueError("order must be 1 to 4")
    scratch = Scratch(docs.sparkSession, "ppm")
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), (crc_mod(F.col(key), folds) == 0).alias("held_out"),
                       F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))

    def count(group: pa.Table) -> pa.Table:
        bodies = [b for c in group.column("text").chunks for b in utf8(c)]
        trained = [not x for x in group.column("held_out").to_pylist()]
        found, counts = chunk_counts(bodies, trained, order)
        del bodies
        release()
        chunk = group.column("chunk")[0].as_py()
        return pa.table({"chunk": pa.array(np.full(len(found), chunk, dtype=np.int32)),
                         "key": pa.array(found.view(np.int64)), "c": pa.array(counts.astype(np.int64))})

    held = scratch.save(rows.groupBy("chunk").applyInArrow(count, "chunk int, key bigint, c bigint"), "counts")
    totals = scratch.save(held.groupBy("key").agg(F.sum("c").alias("c")), "totals")
    is_word = F.col("key") >= WORD_BIT
    n, v = totals.where(is_word).agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    words = totals.where(is_word).select(
        "key", F.log10((F.col("c") + SMOOTHING) / (n + SMOOTHING * (v + 1))).alias("value"), (F.col("c") > 0).alias("seen"))
    pairs = pair_scores(totals.where(~is_word), scratch, order).withColumn("seen", F.lit(False))
    values = scratch.save(words.unionAll(pairs), "values")
    needed = held.select("chunk", "key").join(values, "key")

    def score(docs_of: pa.Table, trie: pa.Table) -> pa.Table:
        known = trie.column("key").to_numpy().view(np.uint64)
        by = np.argsort(known)
        value, seen = trie.column("value").to_numpy()[by], trie.column("seen").to_numpy()[by]
        bodies = [b for c in docs_of.column("text").chunks for b in utf8(c)]
        known = known[by]
        del by
        n_tokens, n_known, base, own = chunk_scores(bodies, known, value, seen, order)
        del known, value, seen
        release()
        return pa.table({
            "doc_id": docs_of.column("doc_id"), "held_out": docs_of.column("held_out"),
            "n_tokens": pa.array(n_tokens.astype(np.int64)), "n_known": pa.array(n_known.astype(np.int64)),
            "train_tokens": pa.array(np.full(len(bodies), n, dtype=np.int64)), "base_score": pa.array(base),
            "score": pa.array(own)})

    return rows.groupBy("chunk").cogroup(needed.groupBy("chunk")).applyInArrow(score, RESULT_DDL)


def op4_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_scores(read(spark, sf_dir, "documents"))
