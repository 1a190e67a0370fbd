"""Operator 12: exact top-k search by inner product with a vector-approximation file.

Components become integers floor(256 x).  The file holds a cell number (one byte) for
each component of each distinct vector, and the distance of the vector from the
middle of its cell.  A search has three steps:

1. The file is scanned in blocks of bounded size.  The middle of a cell and its half
   width give every (query, vector) a lower and an upper bound of the score, as
   does the distance from the middle (Cauchy-Schwarz); only vectors whose upper
   bound reaches the block's k-th best lower bound go on.
2. Of these, vectors below the k-th best lower bound of all blocks are dropped.
3. Exact vectors are read in the order of their bounds: first the best few of each
   query; then all whose bound still reaches the k-th exact score so far.  The rest
   lies below it, so the k-th result is certain.

Equal vectors are one entry of the file, with their smallest ids, as many as a result
can name; so a group of copies of any size is one candidate.  Cell borders are
quantiles of a sample of at most ``SAMPLE`` distinct vectors (a documented bound);
the outer cells reach to the least and largest value of all vectors, and every
vector is in the file, so the borders decide the work only, never the result.
Queries meet each block of the file once; blocks are as many as the cluster has
cores, or more where a block would exceed ``BLOCK_BYTES``.

Defined results: vectors that are null, or hold null or non-finite components (or
ones of 2^40 or more in size), or have another length than the most frequent one (of
equally frequent ones the longest), take no part, neither do queries without an id;
a candidate without an id comes after all others of its score; of several rows with
one id each is a query and, for the others, a candidate; an empty table gives no rows;
a score outside of a long is held at its end; other columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from sitegraph.llm.common import Scratch, read, release, slices
from sitegraph.llm.vectors import fits, integers, largest, of_one_length, usable

SCALE, K = 256.0, 5
CELLS, SAMPLE = 64, 4096
BLOCK_BYTES, LEAST_ROWS = 64 << 20, 4096
#: rows of the file and queries that are compared at a time
_ROWS, _QUERIES = 2048, 256


def distinct_vectors(rows: DataFrame, d: int, k: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(node, v, ids): the distinct integer vectors, each with its k + 1 smallest ids (null
    ids last); and (id, node, n): how many rows of this id have this vector, for ids in
    the query set's form."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (s for whole in parts for s in slices(whole)):
            x = integers(part.column(1), d, SCALE)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in x], type=pa.binary())],
                                             names=["id", "v"])

    as_bytes = rows.select("id", "v").mapInArrow(run, "id bigint, v binary")
    # equal rows are counted first; the limit of ranks is applied before and after the shuffle
    counted = as_bytes.groupBy("v", "id").agg(F.count("*").alias("n"))
    first = counted.withColumn("rank", F.row_number().over(Window.partitionBy("v").orderBy(F.col("id").asc_nulls_last())))
    first = first.where(F.col("rank") <= k + 1)
    ids = F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "id", "n"))),
        lambda x: F.array_repeat(x["id"], F.least(x["n"], F.lit(k + 1)).cast("int"))))
    nodes = first.groupBy("v").agg(F.slice(ids, 1, k + 1).alias("ids"))
    return scratch.save(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes"), counted


def borders(nodes: DataFrame, d: int) -> np.ndarray:
    """(d, CELLS + 1): cell c of a dimension holds border[c] <= x < border[c + 1]."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for part in parts:
            x = _vectors(part.column(0), d)
            if len(x):
                low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
                high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), type=pa.int32()), pa.array(low), pa.array(high)],
                                             names=["dim", "low", "high"])

    ends = {r.dim: (r.low, r.high) for r in nodes.select("v").mapInArrow(run, "dim int, low bigint, high bigint").groupBy(
        "dim").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()}  # a row for each dimension
    some = nodes.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()  # at most SAMPLE rows
    sample = np.sort(np.stack([np.frombuffer(r.v, dtype=np.int64) for r in some]), axis=0)
    inner = sample[np.linspace(0, len(sample) - 1, CELLS + 1).round().astype(int)[1:-1]].T
    low, high = (np.array([[ends[k][j]] for k in range(d)], dtype=np.int64) for j in range(2))
    return np.concatenate([low, np.clip(inner, low, high), high + 1], axis=1)


def _vectors(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.int64).reshape(-1, d)


def _middles(edges: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Middle and half width of the cells of each row."""
    dim = np.arange(code.shape[1])
    low, high = edges[dim, code].astype(float), (edges[dim, code.astype(np.int64) + 1] - 1).astype(float)
    return (low + high) / 2, (high - low) / 2


def approximations(nodes: DataFrame, edges: np.ndarray) -> DataFrame:
    """The file: (node, code, far), ``far`` no less than the distance from the cell's middle."""
    d = len(edges)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (s for whole in parts for s in slices(whole)):
            x = _vectors(part.column(1), d)
            code = np.stack([np.searchsorted(edges[k, 1:-1], x[:, k], side="right") for k in range(d)], axis=1).astype(np.uint8)
            far = np.sqrt(((x - _middles(edges, code)[0]) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-9
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([r.tobytes() for r in code], type=pa.binary()), pa.array(far)],
                names=["node", "code", "far"])

    return nodes.select("node", "v").mapInArrow(run, "node bigint, code binary, far double")


class _Block:
    """A block of the file in memory: bounds of all its scores with some queries."""

    def __init__(self, edges: np.ndarray, node: np.ndarray, code: np.ndarray, far: np.ndarray):
        self.edges, self.node, self.code, self.far = edges, node, code, far

    def bounds(self, q: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        size, absolute = np.sqrt((q * q).sum(axis=1)), np.abs(q)
        for at in range(0, len(self.node), _ROWS):
            rows = slice(at, at + _ROWS)
            middle, half = _middles(self.edges, self.code[rows])
            mid = q @ middle.T
            spread = np.minimum(absolute @ half.T, np.outer(size, self.far[rows]))
            # what rounding may have taken away
            spread += np.outer(size, (np.sqrt((middle ** 2).sum(axis=1)) + self.far[rows]) * (q.shape[1] + 4) * 2.0 ** -50)
            yield rows, mid - spread, mid + spread

    def search(self, q: np.ndarray, k: int):
        """The best k lower bounds of each query, and (query, node, upper bound) of what reaches the last of them."""
        best = np.full((len(q), 0), -np.inf)
        found = []
        for rows, low, high in self.bounds(q):
            best = np.concatenate([best, low], axis=1)
            if best.shape[1] > k:
                best = -np.partition(-best, k - 1, axis=1)[:, :k]
            least = best.min(axis=1) if best.shape[1] == k else np.full(len(q), -np.inf)
            i, j = np.nonzero(high >= least[:, None])
            found.append((i, self.node[rows][j], high[i, j]))
        i, node, high = map(np.concatenate, zip(*found))
        keep = high >= (best.min(axis=1)[i] if best.shape[1] == k else -np.inf)
        return best, i[keep], node[keep], high[keep]


def scan(file: DataFrame, queries: DataFrame, edges: np.ndarray, k: int, blocks: int) -> DataFrame:
    """(query, node, high, best): candidates of each block with their upper bounds, and a row
    without a node for each query and block that has the block's best k lower bounds."""
    d = len(edges)
    rows = file.select((F.pmod(F.xxhash64("node"), F.lit(blocks))).cast("int").alias("block"), F.lit(0).alias("kind"),
                       F.col("node").alias("one"), F.col("code").alias("bytes"), "far")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asked = queries.select(every.alias("block"), F.lit(1).alias("kind"), F.col("node").alias("one"),
                           F.col("v").alias("bytes"), F.lit(0.0).alias("far"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number, held = None, None, []  # rows of the file come first, then the queries
        for part in (s for whole in parts for s in slices(whole, _QUERIES)):
            if not part.num_rows:
                continue
            blocks_of, kinds = (part.column(c).to_numpy() for c in (0, 1))
            cuts = np.flatnonzero((blocks_of[1:] != blocks_of[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for at, end in zip([0, *cuts], [*cuts, part.num_rows]):
                some = part.slice(at, end - at)
                if blocks_of[at] != number:
                    block, number, held = None, blocks_of[at], []
                if kinds[at] == 0:
                    held.append((some.column(2).to_numpy(), np.frombuffer(b"".join(some.column(3).to_pylist()), dtype=np.uint8)
                                 .reshape(-1, d), some.column(4).to_numpy()))
                    continue
                if block is None:
                    if not held:
                        continue  # no vector in this block
                    block, held = _Block(edges, *map(np.concatenate, zip(*held))), []
                names = some.column(2).to_numpy()
                best, i, node, high = block.search(_vectors(some.column(3), d).astype(float), k)
                none = pa.nulls(len(names), pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, best.size + 1, best.shape[1]), type=pa.int32()),
                                                 pa.array(best.ravel()))
                for arrays in ([pa.array(names[i]), pa.array(node), pa.array(high), pa.nulls(len(i), lists.type)],
                               [pa.array(names), none, none.cast(pa.float64()), lists]):
                    yield pa.RecordBatch.from_arrays(arrays, names=["query", "node", "high", "best"])
        release()

    return (rows.unionAll(asked).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "kind")
            .mapInArrow(run, "query bigint, node bigint, high double, best array<double>"))


@F.arrow_udf(LongType())
def _score(x: pa.Array, y: pa.Array) -> pa.Array:
    """Inner products of vectors in bytes, exactly."""
    if not len(x):
        return pa.array([], type=pa.int64())
    d = len(x[0].as_py()) // 8
    a, b = _vectors(x, d), _vectors(y, d)
    if fits(d, largest(a), largest(b)):
        return pa.array((a * b).sum(axis=1))
    exact = (a.astype(object) * b.astype(object)).sum(axis=1)
    return pa.array([int(max(min(v, (1 << 63) - 1), -1 << 63)) for v in exact], type=pa.int64())


def exact_scores(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query, node, ids, score) of the pairs (query, node): the exact vectors are read."""
    asked = nodes.select(F.col("node").alias("query"), F.col("v").alias("x"))
    own = nodes.select("node", F.col("v").alias("y"), "ids")
    return pairs.select("query", "node").join(own, "node").join(asked, "query").select(
        "query", "node", "ids", _score("x", "y").alias("score"))


def _best(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query; of equal scores those with the smallest id."""
    first = F.element_at("ids", 1)
    order = Window.partitionBy("query").orderBy(F.desc("score"), first.asc_nulls_last(), "node")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def nearest(nodes: DataFrame, queries: DataFrame, d: int, k: int, scratch: Scratch) -> DataFrame:
    """(query, node, ids, score): for each query node the k nodes with the highest scores."""
    edges = borders(nodes, d)
    n = nodes.count()
    cores = nodes.sparkSession.sparkContext.defaultParallelism
    blocks = max(-(-n * d // BLOCK_BYTES), min(-(-n // LEAST_ROWS), 2 * cores))
    file = scratch.save(approximations(nodes, edges), "file")
    found = scratch.save(scan(file, queries, edges, k, blocks), "found")
    lists = found.where("best IS NOT NULL").groupBy("query").agg(
        F.reverse(F.sort_array(F.flatten(F.collect_list("best")))).alias("best"))  # k numbers for each block
    reach = lists.select("query", F.coalesce(F.get("best", F.lit(k - 1)), F.lit(float("-inf"))).alias("reach"))
    order = Window.partitionBy("query").orderBy(F.desc("high"), "node")
    open_ = found.where("node IS NOT NULL").join(reach, "query").where("high >= reach")
    open_ = scratch.save(open_.select("query", "node", "high", F.row_number().over(order).alias("turn")), "open")
    early = scratch.save(exact_scores(open_.where(F.col("turn") <= 2 * k), nodes), "early")
    certain = _best(early, k).where(F.col("place") == k).select("query", F.col("score").alias("kth"))
    late = open_.where(F.col("turn") > 2 * k).join(certain, "query", "left").where("kth IS NULL OR high >= kth")
    return _best(early.unionAll(exact_scores(late, nodes)), k).drop("place")


def top_k(rows: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """(query_id, rank, id, score): the k best other rows of each row whose ``id`` fulfils
    the condition ``is_query`` (a Column over ``id``)."""
    kinds = "query_id bigint, rank int, id bigint, score bigint"
    scratch = Scratch(rows.sparkSession, "top-k")
    vectors, d = of_one_length(usable(rows, key, vector))
    if not d:
        return rows.sparkSession.createDataFrame([], kinds)
    nodes, counted = distinct_vectors(vectors, d, k, scratch)
    asked = scratch.save(counted.where(F.col("id").isNotNull() & is_query).join(nodes.select("v", "node"), "v")
                         .select("id", "node", "n"), "asked")
    queries = scratch.save(nodes.select("node", "v").join(asked.select("node").distinct(), "node"), "queries")
    # a result names at most k + 1 rows, the query's own among them
    near = nearest(nodes, queries, d, k + 1, scratch)
    rows_of = near.select("query", F.explode(F.transform("ids", lambda i: F.struct(
        (-F.col("score").cast("decimal(20,0)")).alias("low"), i.isNull().alias("bare"), i.alias("id"),
        F.col("node").alias("node")))).alias("x"))
    order = Window.partitionBy("query").orderBy("x")
    rows_of = rows_of.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    lists = rows_of.groupBy("query").agg(F.sort_array(F.collect_list("x")).alias("best"))  # at most k + 1
    joined = asked.join(lists.withColumnRenamed("query", "node"), "node").withColumn("own", F.array_position(
        F.transform("best", lambda x: (x["node"] == F.col("node")) & x["id"].eqNullSafe(F.col("id"))), F.lit(True)))
    others = F.slice(F.filter("best", lambda x, i: i + 1 != F.col("own")), 1, k)
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n")))
    each = joined.select(F.col("id").alias("query_id"), others.alias("best"), copies.alias("copy"))
    each = each.select("query_id", F.posexplode("best").alias("pos", "x"))
    return each.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.id").alias("id"),
                       (-F.col("x.low")).cast("bigint").alias("score"))


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = top_k(read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
    return found.withColumnRenamed("id", "vec_id")


SQL = r"""
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
