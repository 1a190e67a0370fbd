"""Operator 8: n-gram Jaccard join as a blocked sparse matrix product.

The incidence matrix has a row per distinct n-gram set (``node``) and a column
per n-gram.  Two documents link when ``100 * overlap >= percent * union`` of their
sets; the result is the component of the links.

* Equal sets are one node, so copies never meet each other.
* Size bounds: a set of size n links only with sets that share one of its first
  ``n - ceil(percent n / 100) + 1`` n-grams in a common order (rare n-grams first:
  the most frequent ones, counted over all documents, come last by their count).
  Only these columns enter the product, and columns of one node are discarded.  Of
  a linked pair the smaller set even has a shared one among its first
  ``n - ceil(2 percent n / (100 + percent)) + 1`` ("early") n-grams, since its partner
  is not smaller; the complete product takes only such entries.
* The columns are dealt out by n-gram; a task multiplies a block of columns,
  i.e. it counts the n-grams that two nodes share.  The counts of all blocks are
  added up, and a pair whose count cannot reach the overlap that its sizes demand
  is discarded.  What is left is verified on the whole sets.
* Large groups of near copies: first products pair each node only with two pivots
  of its columns (the best one is verified), and the components found are
  contracted; pivots are first the nodes that share most of their columns, such as
  the text that others were copied from, then hashed ones.
* What is left are the columns with several components.  A node takes along the
  parities of how many of its n-grams fall on each of some places: two
  nodes whose parities differ in k places have at least k n-grams that only one of
  them has, so a pair is discarded inside the product if that is more than the
  sizes allow.  A larger set has more places (about one for each n-gram), because sets
  of more n-grams than places may link and differ in all of them.  In rounds each node is first paired with the nearest node of another
  component (by parities) and links are contracted, while that finds many; the last,
  complete product leaves out pairs inside a component only.  No link between
  components can be lost, because it looks at every pair of different components.
  Columns of more than ``BLOCK_ROWS`` nodes are dealt in blocks of rows, a pair of
  blocks to a task.

N-grams are 64-bit hashes of word sequences; a set's identity is a 64-bit digest.

Defined results: a text without words, an empty or a null text has 0 n-grams and
is its own component; fewer than n words are one n-gram; repeated rows are equal
sets; a component's id is its smallest document id (nulls aside; null if it has
none); an empty table gives an empty result; other columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.llm.common import LOWER, Scratch, fresh, mix64, read, release, slices
from sitegraph.llm.components import connected_components

SIZE, PERCENT = 5, 75
FREQUENT, BLOCK_ROWS = 65_536, 50_000
#: words of parities that a set has: these at least, a power of two with 0.7 places for each n-gram, so
#: that unlike sets differ in more places than linked ones may; at most 2 KB, which bounds a task's memory
WORDS, MOST_WORDS = 8, 256
#: pairs that a task holds before it passes on what it has found
HELD = 1 << 18
#: rounds of nearest pairs go on while one finds a link for so large a share of the nodes left; it
#: decides the order of the work only
WORTH = 0.02
#: candidate ids are broadcast below this count (16 MB), joined by shuffle above it
BROADCAST_ROWS = 1_000_000
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.array([pow(_BASE, k, 1 << 64) for k in range(64)], dtype=np.uint64)


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 32:
            if len(self) >= 150_000:
                self.clear()
            self[word] = value
        return value


_WORDS = WordHashes()


def ngram_set(text: bytes, size: int = SIZE) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of a text (all its words if fewer)."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    ids = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(size, len(words))
    total = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for j in range(n):
        total += ids[j:len(words) - n + 1 + j] * _POWERS[n - j]
    return np.unique(mix64(total))


def ngram_sets(texts: pa.Array, size: int = SIZE, most: int = 4 << 20) -> Iterator[np.ndarray]:
    """``ngram_set`` of each text (a null text is empty), for a whole column: the words of texts of
    about ``most`` bytes together are found by Arrow, and each distinct one is hashed once."""
    length = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    piece = np.flatnonzero(np.diff(length // most, prepend=0))
    for low, high in zip([0, *piece], [*piece, len(texts)]):
        if low == high:
            continue
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.slice(low, high - low), "")))
        words = lists.flatten()
        real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)  # blanks at the ends give empty words
        end = np.append(0, np.cumsum(real))[np.cumsum(np.append(0, pc.list_value_length(lists).to_numpy()))]
        coded = words.dictionary_encode()
        known = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.cast(pa.binary()).to_pylist()),
                            dtype=np.uint64, count=len(coded.dictionary))
        ids = known[coded.indices.to_numpy()][real]
        total = np.full(max(len(ids) - size + 1, 0), size, dtype=np.uint64)
        for j in range(size if len(total) else 0):
            total += ids[j:len(ids) - size + 1 + j] * _POWERS[size - j]
        total = mix64(total)
        for start, stop in zip(end[:-1], end[1:]):
            if stop - start >= size:
                grams = np.sort(total[start:stop - size + 1])
            else:
                n = stop - start
                grams = mix64(np.array([n], dtype=np.uint64) + (ids[start:stop] * _POWERS[n:0:-1]).sum(dtype=np.uint64)) \
                    if n else ids[:0]
            again = grams[1:] == grams[:-1]
            yield grams[np.append(True, ~again)] if again.any() else grams


def demanded(n, percent: int = PERCENT):
    """Smallest overlap that a set of size n needs with any set (ceil of percent)."""
    return -(-n * percent // 100)


def early(percent: int):
    """Column: whether the n-gram at ``pos`` of a set of size ``n`` is an early one."""
    return F.expr(f"pos < n - ({2 * percent} * n + {99 + percent}) div {100 + percent} + 1")


def node_of(grams: np.ndarray) -> int:
    return int.from_bytes(blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def parity_words(n: int) -> int:
    """How many words of parities a set of n n-grams has."""
    return min(max(WORDS, 1 << (-(-7 * n // 640) - 1).bit_length()), MOST_WORDS)


def parities(grams: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Whether each of the places (by the n-gram's lower bits) has an odd number of n-grams, as
    words, a power of two; half as many words are those of both halves, one upon the other."""
    odd = np.bincount((grams & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many places the parities of each two rows differ: at most the number of
    n-grams that only one of the two sets has."""
    return np.bitwise_count((x ^ y).view(np.uint64)).sum(axis=1, dtype=np.int64)


def _word_rows(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words of a column of parities, where each row's begin and how many they are."""
    whole = column.cast(pa.large_binary()).combine_chunks()
    ends = np.frombuffer(whole.buffers()[1], dtype=np.int64)[whole.offset:whole.offset + len(whole) + 1]
    return np.frombuffer(whole.buffers()[2], dtype=np.uint8)[:ends[-1]].view(np.int64), ends[:-1] // 8, np.diff(ends) // 8


def _folded(odd: tuple[np.ndarray, np.ndarray, np.ndarray], at: np.ndarray, words: int) -> np.ndarray:
    """The parities of the rows ``at``, on so many words."""
    flat, start, width = odd
    out = flat[start[at][:, None] + np.arange(words)]
    for k in range(1, int(width[at].max()) // words):
        more = np.flatnonzero(width[at] > k * words)
        out[more] ^= flat[start[at[more]][:, None] + np.arange(k * words, (k + 1) * words)]
    return out


def differing(odd: tuple[np.ndarray, np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many places the parities of each pair of rows (i, j) differ, on the words that the smaller set has."""
    k = np.empty(len(i), dtype=np.int64)
    common = np.minimum(odd[2][i], odd[2][j])
    for words in np.unique(common).tolist():
        rows = np.flatnonzero(common == words)
        for part in np.array_split(rows, (len(rows) * words >> 17) + 1):  # about 1 MB at a time
            if len(part):
                k[part] = apart(_folded(odd, i[part], words), _folded(odd, j[part], words))
    return k


def frequent_ngrams(docs: DataFrame, size: int, most: int) -> dict[int, int]:
    """The most frequent n-grams with their document counts (an order for the
    prefixes; results do not depend on it).  A task sends on what it saw in
    several documents of a batch; at most ``most`` rows are gathered."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in (s for part in parts for s in slices(part)):
            grams = np.sort(np.concatenate(list(ngram_sets(some.column(0), size))))
            first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])[:len(grams)])
            n = np.diff(np.append(first, len(grams)))
            first, n = first[n >= 3], n[n >= 3]
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams[first].view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])
        release()

    counted = docs.select("text").mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    return {r.h: r.n for r in counted.orderBy(F.desc("n"), "h").limit(most).collect()}


def prefixes(docs: DataFrame, frequent: dict[int, int], size: int, percent: int) -> DataFrame:
    """(doc_id, n, node, prefix, odd): the n-grams of the row that enter the product, and
    its parities; none where the partition had this node before."""
    hot = np.array(sorted(frequent), dtype=np.int64)
    df = np.array([frequent[int(h)] for h in hot], dtype=np.int64)
    sent = docs.sparkSession.sparkContext.broadcast((hot, df))  # at most FREQUENT rows

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, df = sent.value
        seen: set[int] = set()
        for part in (s for whole in parts for s in slices(whole)):
            sizes, nodes, offsets, values, odd = [], [], [0], [], []
            for grams in ngram_sets(part.column(1), size):
                n, node = len(grams), node_of(grams)
                sizes.append(n)
                nodes.append(node)
                first, own = grams.view(np.int64)[:0], None
                if n and node not in seen:
                    seen.add(node)
                    own = parities(grams, parity_words(n)).tobytes()
                    grams = grams.view(np.int64)
                    count = n - int(demanded(n, percent)) + 1
                    if len(hot):
                        at = np.minimum(np.searchsorted(hot, grams), len(hot) - 1)
                        often = np.where(hot[at] == grams, df[at], 0)
                        grams = grams[np.argsort(often, kind="stable")]
                    first = grams[:count]
                odd.append(own)
                values.append(first)
                offsets.append(offsets[-1] + len(first))
            lists = pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()),
                                             pa.array(np.concatenate(values) if values else [], type=pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, type=pa.int64()), pa.array(nodes, type=pa.int64()), lists,
                 pa.array(odd, type=pa.binary())], names=["doc_id", "n", "node", "prefix", "odd"])
        release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, node bigint, "
                                                    "prefix array<bigint>, odd binary")


def shared_columns(postings: DataFrame, frequent: dict[int, int], block_rows: int) -> DataFrame:
    """(h, block, blocks, node, n, early) without repeated entries and without columns of one
    node.  ``blocks`` is how many blocks of rows a frequent column is dealt in."""
    large = [(h, -(-n // block_rows)) for h, n in frequent.items() if n > block_rows]
    if large:
        table = postings.sparkSession.createDataFrame(large, "h bigint, blocks int")
        postings = postings.join(F.broadcast(table), "h", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    else:
        postings = postings.withColumn("blocks", F.lit(1))
    postings = postings.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, joined = None, False  # the last row so far, and whether the row before it has its column
        for part in parts:
            rows = pa.Table.from_batches([part])
            if held is not None:
                rows = pa.concat_tables([held, rows])
            h, block, _, node = (rows.column(k).to_numpy() for k in range(4))
            same = (h[1:] == h[:-1]) & (block[1:] == block[:-1])
            fresh = np.append(True, ~(same & (node[1:] == node[:-1])))
            rows, h, block = rows.filter(pa.array(fresh)), h[fresh], block[fresh]
            same = (h[1:] == h[:-1]) & (block[1:] == block[:-1])
            keep = np.append(False, same) | np.append(same, False) | (rows.column(2).to_numpy() > 1)
            keep[0] |= joined
            joined = bool(same[-1]) if len(same) else joined
            held = rows.slice(len(h) - 1)
            for out in rows.slice(0, len(h) - 1).filter(pa.array(keep[:-1])).to_batches():
                yield out
        if held is not None and (joined or held.column(2)[0].as_py() > 1):
            yield from held.to_batches()

    return (postings.select("h", "block", "blocks", "node", "n", "early").repartition("h", "block")
            .sortWithinPartitions("h", "block", "node")
            .mapInArrow(run, "h bigint, block int, blocks int, node bigint, n bigint, early boolean"))


PRODUCT = "a bigint, b bigint, na bigint, nb bigint, shared bigint"


def _counted(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> pa.RecordBatch:
    """Distinct pairs (a < b) with their set sizes and how often they come."""
    turn = a > b
    a, b, na, nb = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, nb, na), np.where(turn, na, nb)
    order = np.lexsort((b, a))
    a, b, na, nb = a[order], b[order], na[order], nb[order]
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[:len(a)])
    times = np.diff(np.append(first, len(a))).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (a[first], b[first], na[first], nb[first], times)],
                                      names=["a", "b", "na", "nb", "shared"])


def _summed(products: DataFrame) -> DataFrame:
    """The counts of all blocks, with the overlap that the sizes demand of the prefixes."""
    return products.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.first("na").alias("na"), F.first("nb").alias("nb"))


def needed(percent: int, early_only: bool = False):
    """Column: shared prefix n-grams that a link needs: the overlap that the sizes
    demand, less what may lie outside the prefixes (the smaller set's early ones, if
    ``early_only``): the common n-grams beyond the prefix that ends first."""
    outside = F.ceil(F.greatest("na", "nb") * percent / 100) - 1
    if early_only:
        outside = F.greatest(outside, F.ceil(F.least("na", "nb") * 2 * percent / (100 + percent)) - 1)
    return F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent)) - outside


def pivot_products(columns: DataFrame, percent: int, turn) -> DataFrame:
    """Pairs of each node with the first two nodes of its column in the order ``turn``, if
    they are in different components (``root``) and their sizes permit a link."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # of the last column: its key and its first two rows
        for part in parts:
            if not part.num_rows:
                continue
            rows = pa.Table.from_batches([part])
            if held is not None:
                rows = pa.concat_tables([held, rows])
            fresh = 0 if held is None else len(held)
            h, block, node, n, root = (rows.column(k).to_numpy() for k in range(5))
            new = np.append(True, (h[1:] != h[:-1]) | (block[1:] != block[:-1]))
            start = np.flatnonzero(new)
            of = np.cumsum(new) - 1
            out: list[list[np.ndarray]] = [[], [], [], []]
            for k in range(2):
                pivot = np.minimum(start + k, np.append(start[1:], len(h)) - 1)[of]
                good = (root[pivot] != root) & (np.arange(len(h)) >= max(fresh, 1))
                good &= np.minimum(n[pivot], n) * 100 >= np.maximum(n[pivot], n) * percent
                for x, y in zip(out, (node[pivot][good], n[pivot][good], node[good], n[good])):
                    x.append(y)
            held = rows.slice(start[-1], 2)
            yield _counted(*[np.concatenate(x) for x in out])

    ordered = columns.withColumn("turn", turn)
    return _summed(ordered.select("h", "block", "node", "n", "root", "turn").repartition("h", "block")
                   .sortWithinPartitions("h", "block", "turn", "node").mapInArrow(run, PRODUCT))


def _early_of_smaller(node, n, early, node2, n2, early2) -> np.ndarray:
    """Whether the entry of the smaller set (of equal sizes: the smaller node) is early."""
    return np.where((n < n2) | ((n == n2) & (node < node2)), early, early2)


def _block_pairs(node: np.ndarray, n: np.ndarray, root: np.ndarray, early: np.ndarray, percent: int):
    """Pairs (i, j) of a column's rows in different components that may link by their sizes."""
    roots, counts = np.unique(root, return_counts=True)
    largest = roots[np.argmax(counts)]
    rest = np.flatnonzero(root != largest)
    rank = np.full(len(node), -1)
    rank[rest] = np.arange(len(rest))  # a pair of two of the rest is taken once
    for k, i in enumerate(rest):
        good = (root != root[i]) & (rank < k) & (np.minimum(n, n[i]) * 100 >= np.maximum(n, n[i]) * percent)
        good &= _early_of_smaller(node, n, early, node[i], n[i], early[i])
        j = np.flatnonzero(good)
        if len(j):
            yield np.full(len(j), i), j


def _near(i: np.ndarray, j: np.ndarray, node: np.ndarray, n: np.ndarray, odd: tuple, percent: int):
    """node, n, node, n and the differing places of the pairs of rows (i, j) whose
    parities permit a link: linked sets differ in a (100 - percent) / (100 + percent)
    of the sum of their sizes at most."""
    k = differing(odd, i, j)
    good = k * (100 + percent) <= (n[i] + n[j]) * (100 - percent)
    i, j = i[good], j[good]
    return node[i], n[i], node[j], n[j], k[good]


def _nearest(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, k: np.ndarray) -> pa.RecordBatch:
    """Of the pairs of each node the one with the fewest differing places."""
    x, y, k = np.append(a, b), np.append(b, a), np.append(k, k)
    order = np.lexsort((y, k, x))
    x, y, k = x[order], y[order], k[order]
    first = np.append(True, x[1:] != x[:-1])[:len(x)]
    return pa.RecordBatch.from_arrays([pa.array(v[first]) for v in (x, y, k)], names=["x", "y", "apart"])


def mixed_columns(columns: DataFrame) -> DataFrame:
    """The columns (with ``root``) of several components that have an early entry."""
    mixed = columns.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("early").alias("any"))
    return columns.join(mixed.where("low != high AND any").select("h"), "h").drop("root")


def _products(columns: DataFrame, percent: int, emit, ddl: str) -> DataFrame:
    """``emit`` of all pairs in different components (column ``root``) whose sizes and parities
    permit a link.  A task holds one block of a column (or a pair of blocks), and what it has found
    in its columns up to ``HELD`` pairs, so that ``emit`` sees the columns of a pair together."""
    dealt = columns.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "h", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "node", "n", "root", "early",
        "odd")

    def sized(h, one, two, node, n, root, early) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs of rows that differ in their components and may link by their sizes."""
        new = np.append(True, (h[1:] != h[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1]))
        start = np.flatnonzero(new)
        ends = np.append(start[1:], len(h))
        mixed = np.minimum.reduceat(root, start) != np.maximum.reduceat(root, start)
        mixed &= np.logical_or.reduceat(early, start)
        size = ends - start
        small = np.repeat(mixed & (size <= 64), size)
        column = np.cumsum(new) - 1
        for lag in range(1, min(64, size.max())):
            good = small[lag:] & (column[lag:] == column[:-lag]) & (root[lag:] != root[:-lag])
            good &= np.minimum(n[lag:], n[:-lag]) * 100 >= np.maximum(n[lag:], n[:-lag]) * percent
            good &= _early_of_smaller(node[lag:], n[lag:], early[lag:], node[:-lag], n[:-lag], early[:-lag])
            at = np.flatnonzero(good)
            yield at + lag, at
        for k in np.flatnonzero(mixed & (size > 64)):
            at = slice(start[k], ends[k])
            for i, j in _block_pairs(node[at], n[at], root[at], early[at], percent):
                yield start[k] + i, start[k] + j

    def products(rows: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
        *plain, odd = rows.columns
        plain, odd = [c.to_numpy() for c in plain], _word_rows(odd)
        found, n_found = [], 0
        for pairs in sized(*plain):
            found.append(pairs)
            n_found += len(pairs[0])
            if n_found >= HELD:
                yield _near(*map(np.concatenate, zip(*found)), plain[3], plain[4], odd, percent)
                found, n_found = [], 0
        if n_found:
            yield _near(*map(np.concatenate, zip(*found)), plain[3], plain[4], odd, percent)

    def columns_of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """The rows, whole columns (or pairs of blocks) together."""
        held: list[pa.RecordBatch] = []
        for part in parts:
            if not part.num_rows:
                continue
            key = [part.column(k).to_numpy() for k in range(3)]
            last = np.flatnonzero(np.logical_or.reduce([x != x[-1] for x in key]))
            cut = last[-1] + 1 if len(last) else 0
            if held and (cut or any(x[0] != held[-1].column(k)[-1].as_py() for k, x in enumerate(key))):
                yield pa.Table.from_batches([*held, part.slice(0, cut)])
                held = []
            elif cut:
                yield pa.Table.from_batches([part.slice(0, cut)])
            held.append(part.slice(cut))
        if held:
            yield pa.Table.from_batches(held)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []
        n_found = 0
        for pairs in (p for rows in columns_of(parts) for p in products(rows)):
            found.append(pairs)
            n_found += len(pairs[0])
            if n_found >= HELD:
                yield emit(*map(np.concatenate, zip(*found)))
                found, n_found = [], 0
        if n_found:
            yield emit(*map(np.concatenate, zip(*found)))
        release()

    return (dealt.repartition("h", "one", "two").sortWithinPartitions("h", "one", "two", "node").mapInArrow(run, ddl))


def nearest_pairs(columns: DataFrame, percent: int) -> DataFrame:
    """(a, b): of each node the pair with the nearest node of another component."""
    rows = _products(columns, percent, _nearest, "x bigint, y bigint, apart bigint")
    best = rows.groupBy("x").agg(F.min_by("y", F.struct("apart", "y")).alias("y"))
    return best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def complete_products(columns: DataFrame, percent: int) -> DataFrame:
    """All pairs in different components that may link, and the n-grams that they share."""
    return _summed(_products(columns, percent, lambda a, na, b, nb, k: _counted(a, na, b, nb), PRODUCT))


def whole_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, grams): the whole sets of the wanted nodes, from one document of each."""
    reps = nodes.join(wanted, "node").select("node", "doc_id")
    few = reps.count() <= BROADCAST_ROWS
    reps = reps.select("node", F.col("doc_id").alias("rep"))
    rows = docs.select("doc_id", "text").join(F.broadcast(reps) if few else reps, F.col("doc_id").eqNullSafe(F.col("rep")))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (s for whole in parts for s in slices(whole, 512)):
            nodes, grams = [], []
            for node, own in zip(part.column(0).to_pylist(), ngram_sets(part.column(1), size)):
                if node_of(own) == node:  # an id may stand on several rows
                    nodes.append(node)
                    grams.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, type=pa.int64()), pa.array(grams, type=pa.binary())],
                                             names=["node", "grams"])
        release()

    return rows.select("node", "text").mapInArrow(run, "node bigint, grams binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link (a pair may come twice, if an id does)."""
    @F.arrow_udf("boolean")
    def link(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for one, two in zip(x.to_pylist(), y.to_pylist()):
            one, two = np.frombuffer(one, dtype=np.uint64), np.frombuffer(two, dtype=np.uint64)
            both = len(np.intersect1d(one, two, assume_unique=True))
            out.append(100 * both >= percent * (len(one) + len(two) - both))
        return pa.array(out, type=pa.bool_())

    x, y = sets.toDF("a", "x"), sets.toDF("b", "y")
    return pairs.select("a", "b").join(y, "b").join(x, "a").where(link("x", "y")).select("a", "b")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE,
                       percent: int = PERCENT, frequent: int = FREQUENT, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per document."""
    members, placed = _placed(docs, key, text, size, percent, frequent, block_rows)
    smallest = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    component = placed.join(smallest, "root").select("node", "component_id")
    full = members.where("n > 0").join(component, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = members.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionAll(empty)


def _placed(docs: DataFrame, key: str, text: str, size: int = SIZE, percent: int = PERCENT, frequent: int = FREQUENT,
            block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, n) of each document, and (node, doc_id, n, root) of each distinct
    set with its smallest id and the root of its component."""
    scratch = Scratch(docs.sparkSession, "ngram-join")
    docs = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    often = frequent_ngrams(docs, size, frequent)
    rows = scratch.save(prefixes(docs, often, size, percent), "rows")
    members = scratch.save(rows.select("doc_id", "node", "n"), "members")
    nodes = scratch.save(rows.where("n > 0").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.max("odd").alias("odd")), "nodes")
    postings = rows.select("node", "n", F.posexplode("prefix").alias("pos", "h")).withColumn("early", early(percent))
    columns = scratch.save(shared_columns(postings, often, block_rows), "columns")
    scratch.drop("rows")

    # how much of a node's prefix other nodes have too
    degree = columns.groupBy("node").agg((-F.count("*") / F.first("n")).alias("degree"))
    edges, roots = None, None
    turns = (F.col("degree"), F.xxhash64("node", F.pmod("h", F.lit(2))))
    for k, turn in enumerate(turns):
        placed = _with_root(columns, roots)
        placed = placed.join(degree, "node") if k == 0 else placed
        stars = scratch.save(pivot_products(placed, percent, turn), f"stars{k}")
        # most links are found here; what is passed over here is left to the complete product
        stars = stars.where(F.col("shared") * 2 >= needed(percent))
        ends = stars.select(F.col("a").alias("x"), F.col("b").alias("y"), "shared").unionAll(
            stars.select(F.col("b").alias("x"), F.col("a").alias("y"), "shared"))
        best = ends.groupBy("x").agg(F.max(F.struct("shared", "y")).alias("best"))
        pairs = scratch.save(best.select(F.least("x", "best.y").alias("a"), F.greatest("x", "best.y").alias("b"))
                             .distinct(), f"star-pairs{k}")
        found = scratch.save(linked(docs, nodes, pairs, size, percent), f"star-links{k}")
        edges = found if edges is None else edges.unionAll(found)
        roots = connected_components(edges, scratch, f"star{k}")

    left = scratch.save(mixed_columns(_with_root(columns, roots)), "mixed")
    scratch.drop("columns", "stars0", "stars1", "star-pairs0", "star-pairs1")
    own = nodes.select("node", "odd")
    n_left = left.select("node").distinct().count()
    k = 0
    while True:  # every round but the last joins components, so it ends
        near = scratch.save(nearest_pairs(_with_root(left.join(own, "node"), roots), percent), f"near-pairs{k}")
        found = scratch.save(linked(docs, nodes, near, size, percent), f"near-links{k}")
        n_found = found.count()
        if n_found:
            edges = edges.unionAll(found)
            roots = connected_components(edges, scratch, f"near{k}")
        k += 1
        if n_found <= WORTH * n_left:
            break

    pairs = complete_products(_with_root(left.join(own, "node"), roots), percent).where(
        F.col("shared") >= needed(percent, early_only=True))
    pairs = scratch.save(pairs.select("a", "b"), "pairs")
    more = scratch.save(linked(docs, nodes, pairs, size, percent), "links")
    if not more.isEmpty():
        roots = connected_components(edges.unionAll(more), scratch, "all")

    return members, nodes.select("node", "doc_id", "n").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))


def _with_root(columns: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return columns.withColumn("root", F.col("node"))
    return columns.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def linked(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    wanted = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    return verified(pairs, whole_sets(docs, nodes, wanted, size), percent)


def set_node(text, size: int = SIZE):
    """Column: the node of the text's set, null if it is empty."""
    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([node_of(own) if len(own) else None for own in ngram_sets(texts, size)], type=pa.int64())

    return run.asNondeterministic()(text)  # evaluated once, also under a filter


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without near copies: of each component one row stays, the first by
    id (null ids last), node and text; rows that equal it in id and text count as one,
    and so do repeated rows without words.  Columns are those of ``docs``."""
    members, placed = _placed(docs, key, text, **options)
    scratch = Scratch(docs.sparkSession, "ngram-keep")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), "node")).alias("first")
    keepers = scratch.save(placed.groupBy("root").agg(first).select(
        F.col("first.id").alias("kept_id"), F.col("first.node").alias("node")), "keepers")
    full = members.where("n > 0").join(keepers.withColumn("keeper", F.lit(True)), "node", "left").select(
        "doc_id", (F.col("keeper").isNotNull() & F.col("doc_id").eqNullSafe(F.col("kept_id"))).alias("kept"))
    rows = full.unionAll(members.where("n = 0").select("doc_id", F.lit(True).alias("kept")))
    ids = scratch.save(rows.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "ids")

    def by_id(rows: DataFrame, some: DataFrame, how: str) -> DataFrame:
        few = some.count() <= BROADCAST_ROWS
        own = fresh(docs, "gone_id")
        some = some.select(F.col("doc_id").alias(own))
        return rows.join(F.broadcast(some) if few else some, docs[key].cast("bigint").eqNullSafe(F.col(own)), how)

    left = by_id(docs, ids.where("NOT kept"), "left_anti")
    several = ids.where("kept AND n > 1")
    if several.isEmpty():
        return left
    # an id on several rows does not say which of them stays: their sets do
    node, kept_id, kept_node, bare, row = (fresh(docs, x) for x in ("node", "kept_id", "kept_node", "bare", "row"))
    unsure = by_id(docs, several, "left_semi").withColumn(node, set_node(F.col(text), options.get("size", SIZE)))
    wanted = keepers.join(several, F.col("kept_id").eqNullSafe(F.col("doc_id")), "left_semi").select(
        F.col("kept_id").alias(kept_id), F.col("node").alias(kept_node))
    few = wanted.count() <= BROADCAST_ROWS
    unsure = unsure.join(F.broadcast(wanted) if few else wanted, (F.col(node) == F.col(kept_node))
                         & F.col(key).cast("bigint").eqNullSafe(F.col(kept_id)), "left")
    unsure = unsure.where(F.col(node).isNull() | F.col(kept_node).isNotNull()).withColumn(
        bare, F.when(F.col(node).isNull(), F.col(text)))
    picked = unsure.groupBy(F.col(key).alias("k"), F.col(node).alias("s"), F.col(bare).alias("t")).agg(
        F.min_by(F.struct(*[F.col(c) for c in docs.columns]), F.struct(text)).alias(row)).select(f"{row}.*")
    return by_id(left, several, "left_anti").unionAll(picked)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
grams AS (
  SELECT doc_id, len(w) AS k,
    CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[][])
         WHEN len(w) < 5 THEN [w]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: list_slice(w, i, i + 4))) END AS g
  FROM words),
incidence AS (SELECT doc_id, unnest(g) AS gram FROM grams),
counted AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both
  FROM incidence x JOIN incidence y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM counted JOIN grams p ON p.doc_id = a JOIN grams q ON q.doc_id = b
  WHERE 100 * n_both >= 75 * (len(p.g) + len(q.g) - n_both)),
ends AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM grams
  UNION SELECT reach.doc_id, ends.b FROM reach JOIN ends ON ends.a = reach.other)
SELECT g.doc_id, CAST(len(any_value(g.g)) AS BIGINT) AS n_shingles, min(r.other) AS component_id
FROM grams g JOIN reach r USING (doc_id) GROUP BY g.doc_id
"""
