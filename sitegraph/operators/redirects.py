"""Redirect resolution by pointer doubling (JN4).

The redirect graph is functional (a URL has at most one Location), so where a
chain of any length ends is found by doubling: each round joins the redirects that
have not come to an end with all redirects, and doubles the steps.  URLs that are no
redirects take no part, and a redirect whose end is known is not joined again.
A chain of length d is settled after log2(d) rounds, and once a round settles nothing
the rest can only lead into loops: a chain of any remaining length would have held a
URL at just the distance that this round settles.  Loops stop at the URL whose Location
comes back to a URL of the chain.  There is no limit on the length.  Every round
is a reliable checkpoint of a few narrow columns (it is read twice by the next one).

A checkpoint keeps the planner's estimate of its size, which for a join is the product of the
sides: each round squares it, and after log2(n) rounds it has as many digits as there are
URLs, in every node of every later plan.  So some rounds, and the result, are tables written
to the shared folder and read again, whose estimate is the size of their files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegraph.session import Scratch


FRESH_EVERY = 4  # rounds from one written table to the next


def _made(table: DataFrame, k: int, scratch: Scratch, name: str) -> DataFrame:
    """Round ``k``, counted from 1."""
    return table.checkpoint(eager=True) if k % FRESH_EVERY else scratch.save(table, f"{name}{k}")


def _settled(moves: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(settled, loose): where each redirect (url, to, hops, done) ends, and those that never end."""
    before, k = moves.where("NOT done").count(), 0
    while before:
        ahead = moves.select(F.col("url").alias("to"), F.col("to").alias("to2"), F.col("hops").alias("hops2"),
                             F.col("done").alias("done2"))
        further = moves.where("NOT done").join(ahead, "to").select(
            "url", F.col("to2").alias("to"), (F.col("hops") + F.col("hops2")).alias("hops"), F.col("done2").alias("done"))
        k += 1
        moves = _made(moves.where("done").unionByName(further), k, scratch, "settled")
        left = moves.where("NOT done").count()
        if left == before:
            break
        before = left
    return moves.where("done").drop("done"), moves.where("NOT done").drop("done")


def _doubled(table: DataFrame, rounds: int, scratch: Scratch, name: str, more=(), while_moving: bool = False) -> DataFrame:
    """(url, to, ...) after 2^rounds steps; ``more`` combines a column of both halves.  With
    ``while_moving`` it ends as soon as every row stands still (hops of a step is 0)."""
    for k in range(1, rounds + 1):
        ahead = table.select(F.col("url").alias("to"), F.col("to").alias("to2"), *[F.col(c).alias(c + "2") for c, _ in more])
        further = table.join(ahead, "to").select("url", F.col("to2").alias("to"), *[f(F.col(c), F.col(c + "2")).alias(c) for c, f in more],
                                                 *([(F.col("hops2") > 0).alias("moved")] if while_moving else []))
        table = _made(further, k, scratch, name)
        if while_moving:
            stands = table.where("moved").isEmpty()
            table = table.drop("moved")
            if stands:
                break
    return table


def resolve_redirects(parsed: DataFrame, url_col: str = "request_url", ts_col: str = "ts") -> DataFrame:
    """(url, effective_url, hops, outcome) for every request URL of ``parsed``
    (columns request_url, outcome, location and, if there, ts: the newest
    capture of a URL counts).

    outcome: the final response's outcome (ok / error / throttled /
    parse_error), ``error`` for a redirect without Location, ``loop`` when a
    Location comes back to a URL of the chain, ``unknown`` when no response
    exists for the URL reached.
    """
    scratch = Scratch(parsed.sparkSession, "redirects")
    # narrow columns only, so the newest capture is one small aggregate over the responses
    capture = F.struct(*[F.col(c) for c in (ts_col,) if c in parsed.columns], "outcome", "location")
    r = parsed.groupBy(F.col(url_col).alias("url")).agg(F.max(capture).alias("r")) \
        .select("url", "r.outcome", F.col("r.location").cast("string").alias("location")).checkpoint(eager=True)
    redirect = (F.col("outcome") == "redirect") & F.col("location").isNotNull()
    moves = r.where(redirect).select("url", F.col("location").alias("to"))
    ends = moves.select(F.col("url").alias("to"), F.lit(False).alias("done"))
    moves = moves.join(ends, "to", "left").select(
        "url", "to", F.lit(1).cast("bigint").alias("hops"), F.coalesce("done", F.lit(True)).alias("done")).checkpoint(eager=True)
    still = r.where(~redirect | redirect.isNull()).select("url", F.col("url").alias("to"), F.lit(0).cast("bigint").alias("hops"))
    settled, loose = _settled(moves, scratch)
    out = still.unionByName(settled).join(r.select(F.col("url").alias("to"), "outcome"), "to", "left").select(
        "url", F.col("to").alias("effective_url"), "hops",
        F.when(F.col("outcome") == "redirect", "error").otherwise(F.coalesce("outcome", F.lit("unknown"))).alias("outcome"))

    # the rest leads into loops; what they reach after as many steps as they are is on a loop
    n = loose.count()
    if n:
        step = moves.join(loose.select("url"), "url", "left_semi").select("url", "to").checkpoint(eager=True)
        ring = _doubled(step, n.bit_length(), scratch, "ahead").select(F.col("to").alias("url")).distinct().checkpoint(eager=True)
        around = step.join(ring, "url", "left_semi")
        # size of each loop: its URLs with the smallest URL seen on the way round
        least = _doubled(around.withColumn("least", F.least("url", "to")), ring.count().bit_length(), scratch, "least",
                         [("least", F.least)])
        size = least.groupBy("least").agg(F.count("*").alias("n"))
        before = around.select(F.col("to").alias("entry"), F.col("url").alias("effective_url"))
        entries = least.select(F.col("url").alias("entry"), "least").join(size, "least").join(before, "entry") \
            .select("entry", "n", "effective_url")
        # the way from each URL to its loop: a URL of the loop stands still
        on_ring = F.col("on_ring").isNotNull()
        tails = step.join(ring.withColumn("on_ring", F.lit(True)), "url", "left").select(
            "url", F.when(on_ring, F.col("url")).otherwise(F.col("to")).alias("to"),
            F.when(on_ring, 0).otherwise(1).cast("bigint").alias("hops"))
        loops = _doubled(tails, n.bit_length(), scratch, "tails", [("hops", lambda a, b: a + b)], while_moving=True).select(
            "url", F.col("to").alias("entry"), "hops").join(entries, "entry").select(
            "url", "effective_url", (F.col("hops") + F.col("n") - 1).alias("hops"), F.lit("loop").alias("outcome"))
        out = out.unionByName(loops)
    out = Scratch(parsed.sparkSession, "resolved").save(
        out.select("url", "effective_url", F.col("hops").cast("int").alias("hops"), "outcome"), "resolved")
    scratch.purge()
    return out


def with_effective_url(rows: DataFrame, resolved: DataFrame, url_col: str = "url") -> DataFrame:
    """Rows with ``effective_url``: where the URL leads after redirects (itself,
    if nothing is known of it)."""
    to = resolved.select(F.col("url").alias(url_col), "effective_url")
    return rows.join(to, url_col, "left").withColumn("effective_url", F.coalesce("effective_url", F.col(url_col)))
