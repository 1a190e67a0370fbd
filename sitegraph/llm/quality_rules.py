"""Operator 2: quality rules whose cutoffs bound the false rejections.

Each rule is a ratio of a text (``RULES``); a document whose ratio exceeds the
rule's cutoff is rejected.  Cutoffs come from labelled documents.  For every
stratum and rule the grid of cutoffs is walked from lenient to strict, and a cutoff
is certified while the exact binomial test rejects "more than ``risk / number of
rules`` of the good documents exceed it" (the upper Clopper-Pearson bound of the
false rejection rate is then at most that share).  Walking a nested grid until the
first failure needs no correction along the grid; across strata and rules the level
``delta`` is divided by their number (Bonferroni).  So with probability
``1 - delta`` each stratum loses at most ``risk`` of its good documents to all rules
together.  All certified cutoffs hold at once, so any of them may be used: the one
that rejects most more bad than good labelled documents (of equals the most
lenient), which spends no risk where it gains nothing.  A stratum with too few good labels gets no
cutoff for a rule, which then rejects nothing there.

Strata are all values of a column, however many; their cutoffs are a table that the
documents are joined with.  A stratum whose labels certify nothing, or that has
none, is rejected by the base only.  Null is a stratum too where its own labels
certify a rule; else its documents may come from any stratum, so they get the most
useful cutoff that is certified in every labelled stratum (any mixture of these then
loses at most ``risk``), and none if some labelled stratum has none.

The base counts follow fixed definitions: words are runs of characters other
than space and U+0009-U+000D; ``n_symbols`` counts ``#*$%&|<>``; a duplicate line
has a word and equals an earlier line; repeated words lie in five-word windows
that the text holds twice or more.  ``base_failed`` documents (fewer than 10
words, or more than 20 % repeated words) are rejected whatever the cutoffs.

Defined results: a null or empty text has no words, so it fails the base; with
no labels (or none good) only the base rejects; a document labelled more than
once is good if any label says so; labels of unknown documents are ignored;
repeated documents get a row each; other columns stay as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.llm.common import Scratch, fresh, read, utf8

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
RISK, DELTA, GRID = 0.05, 0.05, 200
#: tables of cutoffs are broadcast up to this many strata (some 20 MB), joined by shuffle above it
BROADCAST_STRATA = 100_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
          "n_capitals", "n_shouts")
FEATURES = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">"
#: ratio -> (numerator, denominator)
RULES = {
    "symbol_ratio": ("n_symbols", "word_chars"),
    "duplicate_line_ratio": ("n_dup_lines", "n_lines"),
    "repeat_ratio": ("n_repeat_words", "n_words"),
    "capital_ratio": ("n_capitals", "word_chars"),
    "shout_ratio": ("n_shouts", "n_words"),
}
_CAPITALS = bytes(range(65, 91))


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """How many words lie in a window of ``size`` words that occurs twice or more."""
    count = len(words) - size + 1
    if count < 2:
        return 0
    windows = list(zip(*(words[i:] for i in range(size))))
    seen, twice = set(), set()
    for w in windows:
        if w in seen:
            twice.add(w)
        else:
            seen.add(w)
    if not twice:
        return 0
    hit = np.fromiter(map(twice.__contains__, windows), dtype=bool, count=count)
    marks = np.zeros(len(words), dtype=bool)
    for i in range(size):
        marks[i:i + count] |= hit
    return int(marks.sum())


def text_counts(text: bytes) -> tuple[int, ...]:
    """The values of COUNTS for one text in UTF-8."""
    words = text.split()  # of bytes: splits at exactly the six ASCII spaces
    if not words:
        return (0,) * len(COUNTS)
    joined = b"".join(words)
    lines = [x for x in text.split(b"\n") if x.split()]
    return (len(words), len(joined.decode()), len(text) - len(text.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words), len(lines),
            len(joined) - len(joined.translate(None, _CAPITALS)),
            sum(w.endswith(b"!") for w in words) if b"!" in joined else 0)


def counts(text: Column) -> Column:
    """Column of FEATURES (COUNTS of the text), evaluated once also under a filter."""
    @F.arrow_udf(FEATURES)
    def run(texts: pa.Array) -> pa.Array:
        rows = [text_counts(b) for b in utf8(texts)]
        columns = zip(*rows) if rows else [[] for _ in COUNTS]
        return pa.StructArray.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=list(COUNTS))

    return run.asNondeterministic()(text)


def base_failed(c: Column) -> Column:
    return (c["n_words"] < MIN_WORDS) | (c["n_repeat_words"] * 100 > c["n_words"] * MAX_REPEAT_PERCENT)


def ratio(c: Column, rule: str) -> Column:
    top, bottom = RULES[rule]
    return F.when(c[bottom] > 0, c[top] / c[bottom]).otherwise(0.0)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), exactly (sum of the probabilities)."""
    if k >= n:
        return 1.0
    if k < 0:
        return 0.0
    i = np.arange(k + 1)
    logs = np.concatenate([[0.0], np.cumsum(np.log(n - i[:-1]) - np.log(i[1:]))])
    logs += i * math.log(p) + (n - i) * math.log1p(-p)
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def _binned(bins: np.ndarray, values: np.ndarray, grid: int) -> np.ndarray:
    out = np.zeros(grid + 2, dtype=np.int64)
    np.add.at(out, np.minimum(bins, grid + 1), values)
    return out


def certified(bins: np.ndarray, good: np.ndarray, risk: float, level: float, grid: int) -> int | None:
    """The strictest bin that the walk from lenient to strict certifies, None if there
    is none; all more lenient ones are certified with it."""
    goods = _binned(bins, good, grid)
    above, total, last = 0, int(goods.sum()), None
    for b in range(grid, -1, -1):
        above += int(goods[b + 1])
        if above and above >= risk * total or binomial_tail(above, total, risk) > level:
            break
        last = b
    return last


def most_useful(bins: np.ndarray, good: np.ndarray, bad: np.ndarray, lowest: int | None, grid: int) -> float | None:
    """The cutoff of the bins from ``lowest`` on that rejects most more bad than good
    documents (of equals the most lenient); None if there is no ``lowest``."""
    if lowest is None:
        return None
    goods, bads = _binned(bins, good, grid), _binned(bins, bad, grid)
    gain, best, most = 0, None, -1
    for b in range(grid, lowest - 1, -1):
        gain += int(bads[b + 1]) - int(goods[b + 1])
        if gain > most:
            best, most = b / grid, gain
    return best


def best_cutoff(bins: np.ndarray, good: np.ndarray, bad: np.ndarray, risk: float, level: float,
                grid: int) -> float | None:
    """The most useful cutoff of the grid that the walk from lenient to strict
    certifies, None if there is none.  ``good[i]`` good and ``bad[i]`` bad documents
    have a ratio in bin ``bins[i]``: bin b holds ratios in (b-1, b] / grid, so cutoff
    b / grid rejects the bins above b."""
    return most_useful(bins, good, bad, certified(bins, good, risk, level, grid), grid)


class Cutoffs(Mapping):
    """(stratum, rule) -> cutoff.  ``table`` (s, cutoffs: map of rule to cutoff) is what
    documents are joined with; it is collected only if the mapping itself is asked."""

    def __init__(self, table: DataFrame):
        self.table = table

    def _collected(self) -> dict[tuple[str | None, str], float]:
        return {(r.s, rule): v for r in self.table.collect() for rule, v in r.cutoffs.items()}

    def __getitem__(self, key: tuple[str | None, str]) -> float:
        return self._collected()[key]

    def __iter__(self) -> Iterator[tuple[str | None, str]]:
        return iter(self._collected())

    def __len__(self) -> int:
        return len(self._collected())


def cutoffs(features: DataFrame, labels: DataFrame, key: str, stratum: str, feature: str,
            label_key: str = "doc_id", label: str = "quality", risk: float = RISK, delta: float = DELTA,
            grid: int = GRID, text_id: str | None = None) -> Cutoffs:
    """``features`` has the document key, the stratum, the struct of counts and, in
    ``text_id``, what tells texts apart (without it: the key).  The binomial bounds need
    independent trials, so a text counts once in a stratum however many rows and ids it
    stands on, as good if any label of it says so.  Labels are joined on narrow
    rows, then counted per (stratum, rule, bin); nothing that grows with the strata is
    gathered."""
    known = (labels.select(F.col(label_key).alias("k"), F.col(label).alias("q"))
             .where(F.col("k").isNotNull() & F.col("q").isNotNull()).groupBy("k").agg(F.max("q").alias("q")))
    labelled = (features.select(F.col(key).alias("k"), F.col(stratum).cast("string").alias("s"),
                            F.col(feature).alias("c"), F.col(text_id or key).alias("t"))
            .join(known, "k").where(~base_failed(F.col("c"))))
    labelled = labelled.groupBy("s", "t", "c").agg(F.max("q").alias("q"))
    bins = F.array(*[F.struct(F.lit(r).alias("rule"), F.ceil(ratio(F.col("c"), r) * grid).cast("int").alias("bin"))
                     for r in RULES])
    per_stratum = labelled.select("s", "q", F.explode(bins).alias("b")).groupBy("s", "b.rule", "b.bin").agg(
        F.count_if(F.col("q") == 1).alias("good"), F.count_if(F.col("q") != 1).alias("bad"))
    scratch = Scratch(features.sparkSession, "quality-cutoffs")
    histogram = scratch.save(per_stratum, "histogram")
    strata = histogram.where("good > 0").select("s").distinct().count()
    level = delta / (len(RULES) * max(1, strata))
    share = risk / len(RULES)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        b, good, bad = (pdf[c].to_numpy() for c in ("bin", "good", "bad"))
        low = certified(b, good, share, level, grid)
        return pd.DataFrame({"s": [pdf["s"].iloc[0]], "rule": [pdf["rule"].iloc[0]], "good": [int(good.sum())],
                             "low": pd.array([low], dtype="Int64"), "cutoff": [most_useful(b, good, bad, low, grid)]})

    def choose_unknown(pdf: pd.DataFrame) -> pd.DataFrame:
        best = most_useful(*(pdf[c].to_numpy() for c in ("bin", "good", "bad")), int(pdf["low"].iloc[0]), grid)
        return pd.DataFrame({"rule": [pdf["rule"].iloc[0]], "cutoff": [best]})

    usable = F.col("cutoff").isNotNull() & ~F.isnan("cutoff")
    # at most grid + 2 rows in a group
    own = scratch.save(histogram.groupBy("s", "rule").applyInPandas(
        choose, "s string, rule string, good bigint, low bigint, cutoff double"), "own")
    everywhere = own.where("s IS NOT NULL AND good > 0").groupBy("rule").agg(
        F.max("low").alias("low"), F.count_if(F.col("low").isNull()).alias("lacking")).where("lacking = 0").drop("lacking")
    everywhere = everywhere.join(own.where(F.col("s").isNull() & usable).select("rule"), "rule", "left_anti")
    pooled = histogram.groupBy("rule", "bin").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    unknown = pooled.join(everywhere, "rule").groupBy("rule").applyInPandas(choose_unknown, "rule string, cutoff double")
    chosen = own.select("s", "rule", "cutoff").unionByName(
        unknown.select(F.lit(None).cast("string").alias("s"), "rule", "cutoff")).where(usable)
    table = scratch.save(chosen.groupBy("s").agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs")), "chosen")
    scratch.drop("histogram", "own")
    return Cutoffs(table)


def rejected_by(c: Column, limits: Column) -> Column:
    """Column: array of the rules whose cutoff (``limits``: map of rule to cutoff, or
    null) the document exceeds."""
    return F.array_compact(F.array(*[F.when(ratio(c, rule) > limits[rule], F.lit(rule)) for rule in RULES]))


def with_cutoffs(docs: DataFrame, chosen: Mapping[tuple[str | None, str], float], stratum: str, name: str) -> DataFrame:
    """The rows with the cutoffs of their stratum in column ``name``, null if it has none."""
    if isinstance(chosen, Cutoffs):
        table = chosen.table
    else:
        rows = [(s, {r: v for (t, r), v in chosen.items() if t == s}) for s in {s for s, _ in chosen}]
        table = docs.sparkSession.createDataFrame(rows, "s string, cutoffs map<string,double>")
    few = table.count() <= BROADCAST_STRATA
    own = fresh(docs, "cutoff_stratum")
    table = table.select(F.col("s").alias(own), F.col("cutoffs").alias(name))
    return docs.join(F.broadcast(table) if few else table, F.col(stratum).cast("string").eqNullSafe(F.col(own)),
                     "left").drop(own)


def text_digest(text: Column) -> Column:
    """A number that tells texts apart (a clash would only make two trials one)."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang",
        **options) -> Cutoffs:
    """Cutoffs from the labelled ones among ``docs``."""
    features = docs.select(F.col(key).alias("key"), F.col(stratum).alias("stratum"),
                           counts(F.col(text)).alias("counts"), text_digest(F.col(text)).alias("digest"))
    return cutoffs(features, labels, "key", "stratum", "counts", text_id="digest", **options)


def keep_good(docs: DataFrame, chosen: Mapping[tuple[str | None, str], float], text: str = "text",
              stratum: str = "lang") -> DataFrame:
    """The documents that neither the base nor a rule rejects; columns of ``docs``."""
    name, limits = fresh(docs, "counts"), fresh(docs, "cutoffs")
    c = F.col(name)
    return (with_cutoffs(docs, chosen, stratum, limits).withColumn(name, counts(F.col(text)))
            .where(~base_failed(c) & (F.size(rejected_by(c, F.col(limits))) == 0))
            .select(*docs.columns))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scratch = Scratch(spark, "quality")
    # narrow rows (no text), read for the cutoffs and again for the verdicts
    features = scratch.save(docs.select("doc_id", "lang", counts(F.col("text")).alias("c"),
                                        text_digest(F.col("text")).alias("digest")), "features")
    chosen = cutoffs(features, read(spark, sf_dir, "labels"), "doc_id", "lang", "c", text_id="digest")
    c = F.col("c")
    features = with_cutoffs(features, chosen, "lang", "cutoffs")
    return features.select("doc_id", c["n_words"].alias("n_words"), c["word_chars"].alias("word_chars"),
                           c["n_symbols"].alias("n_symbols"), c["n_dup_lines"].alias("n_dup_lines"),
                           c["n_repeat_words"].alias("n_repeat_words"), base_failed(c).alias("base_failed"),
                           rejected_by(c, F.col("cutoffs")).alias("rejected_by")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"), "rejected_by")
