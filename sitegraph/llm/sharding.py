"""Operator 7: sharding by balanced label propagation.

Every document starts in a shard by the rank of its id's hash, so the counts are at
most one apart.  Linked documents share a hub (for the query: equal texts); a round
counts the hub's documents by shard, and every hub wishes its documents into the
shard that holds most of them.  Wishes become moves under quotas that keep each
shard's count: as many documents leave a shard as enter it.  Documents without
links fill what linked ones leave (they have no neighbours, so moving them cuts
nothing), and where those do not suffice the wishes into a shard are cut back.
Rounds end when no document wishes to move, no move is possible or ``rounds`` are
over.

A hub with more documents than a shard holds is split into blocks of that size by
hash, since it must be cut anyway.  What the driver sees is one number for each
pair of shards.  Moves are chosen by ranks over range partitions, so no hub, shard
or pair of shards has to fit into one task; every round is a table in the shared
folder.

Defined results: law ``rows`` holds for any input; a null text has size 16 and the
checksum of no bytes and is linked with the other null and empty texts; repeated
rows are documents of their own; null ids come first in a shard; an empty table
gives an empty result; other columns are left aside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.llm.common import Scratch, read
from sitegraph.llm.ranks import ranked

SHARDS, ROUNDS, OVERHEAD = 40, 8, 16


def plan_moves(demand: dict[tuple[int, int], int], free: dict[int, int], shards: int) -> tuple[
        dict[tuple[int, int], int], list[tuple[int, int, int, int]]]:
    """Granted moves between shards, and how unlinked documents fill up: (shard, first
    rank, end rank, new shard).  Every shard's count stays as it is."""
    granted = {k: v for k, v in demand.items() if k[0] != k[1] and v > 0}

    def net(b: int) -> int:
        return sum(v for (_, y), v in granted.items() if y == b) - sum(v for (x, _), v in granted.items() if x == b)

    while True:
        over = [(net(b) - free.get(b, 0), b) for b in range(shards)]
        excess, b = max(over)
        if excess <= 0:
            break
        for k in sorted((k for k in granted if k[1] == b), key=lambda k: (granted[k], k)):
            cut = min(granted[k], excess)
            granted[k] -= cut
            excess -= cut
            if not excess:
                break
        granted = {k: v for k, v in granted.items() if v}
    fills, givers = [], [[b, net(b), 0] for b in range(shards) if net(b) > 0]
    for b in range(shards):
        need = -net(b)
        while need > 0:
            giver = givers[-1]
            some = min(need, giver[1])
            fills.append((giver[0], giver[2], giver[2] + some, b))
            giver[1] -= some
            giver[2] += some
            need -= some
            if not giver[1]:
                givers.pop()
    return granted, fills


def propagate(nodes: DataFrame, links: DataFrame, scratch: Scratch, shards: int = SHARDS,
              rounds: int = ROUNDS) -> DataFrame:
    """(id, shard) for every node; counts are at most one apart.  ``nodes`` has unique
    ids (``id``, long), ``links`` the pairs (id, hub)."""
    spark = nodes.sparkSession
    hashed = nodes.select("id", F.xxhash64("id").alias("h"), F.lit(0).alias("all"))
    labels = scratch.save(ranked(hashed, ["all"], ["h", "id"], scratch, "order").select(
        "id", F.pmod("rank", F.lit(shards)).cast("int").alias("shard")), "labels0")
    linked = scratch.save(links.select("id").distinct().withColumn("linked", F.lit(True)), "linked")
    for k in range(1, rounds + 1):
        held = links.join(labels, "id").groupBy("hub", "shard").agg(F.count("*").alias("n"))
        best = held.groupBy("hub").agg(F.max(F.struct("n", F.xxhash64("hub", "shard").alias("tie"), "shard")).alias("best"))
        wishes = (links.join(best, "hub").groupBy("id").agg(F.max(F.struct("best.n", "best.tie", "best.shard", "hub")).alias("w"))
                  .select("id", F.col("w.shard").alias("wish"), F.col("w.hub").alias("hub")))
        now = labels.join(linked, "id", "left").join(wishes, "id", "left").select(
            "id", "shard", F.coalesce("linked", F.lit(False)).alias("linked"),
            F.coalesce("wish", F.when(F.col("linked").isNull(), F.lit(-1)), "shard").cast("int").alias("wish"),
            F.when(F.col("wish").isNull(), F.xxhash64("id")).otherwise(F.xxhash64("hub")).alias("turn"))
        now = scratch.save(now, f"wishes{k}")
        counted = now.groupBy("shard", "wish").count().collect()  # at most shards * (shards + 1) rows
        demand = {(r.shard, r.wish): r["count"] for r in counted if r.wish not in (-1, r.shard)}
        granted, fills = plan_moves(demand, {r.shard: r["count"] for r in counted if r.wish == -1}, shards)
        if not granted:
            break
        # stayers need no rank: only movers and unlinked documents are sorted
        movable = ranked(now.where("wish != shard"), ["shard", "wish"], ["turn", "id"], scratch, f"ranks{k}")
        grants = [(a, b, 0, n, b) for (a, b), n in sorted(granted.items())] + [
            (a, -1, lo, hi, b) for a, lo, hi, b in fills]
        table = F.broadcast(spark.createDataFrame(grants, "shard int, wish int, lo bigint, hi bigint, to int"))
        moved = movable.join(table, ["shard", "wish"]).where("rank >= lo AND rank < hi").select("id", "to")
        labels = scratch.save(labels.join(moved, "id", "left").select(
            "id", F.coalesce("to", "shard").alias("shard")), f"labels{k}")
        scratch.drop(f"labels{k - 1}", f"wishes{k}", f"ranks{k}")
    return labels


def shard_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS,
                    rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every document; equal texts are linked."""
    scratch = Scratch(docs.sparkSession, "sharding")
    body = F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))
    rows = scratch.save(docs.select(
        F.monotonically_increasing_id().alias("id"), F.col(key).cast("bigint").alias("doc_id"),
        (F.octet_length(body) + OVERHEAD).cast("bigint").alias("size"), F.crc32(body).alias("text_crc32"),
        F.unhex(F.sha2(body, 256)).alias("digest")), "rows")
    capacity = max(1, rows.count() * 4 // (shards * 5))  # blocks are dealt by hash, so their sizes vary
    groups = rows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    block = F.pmod(F.xxhash64("id", "digest"), F.ceil(F.col("n") / capacity))
    links = scratch.save(rows.join(groups, "digest").select("id", F.xxhash64("digest", block).alias("hub")), "links")
    labels = propagate(rows.select("id"), links, scratch, shards, rounds)
    placed = rows.drop("digest").join(labels, "id")
    return ranked(placed, ["shard"], ["doc_id", "id"], scratch, "placed", "slot").select(
        "doc_id", "size", "text_crc32", "shard", "slot")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
