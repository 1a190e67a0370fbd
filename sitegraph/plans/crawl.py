"""Bounded crawl over the link graph of a page corpus (CRL1, CRL2).

The HTML of each page is scanned once (``page_link_table``); every crawl
level is then a join of the frontier with that table, so the expensive
regex work does not repeat per visit.  Every level is persisted; every
``checkpoint_every`` levels (default 2) the frontier is written as a reliable
checkpoint in ``spark.checkpoint.dir``, and the final result is one too, so a
lost executor recomputes at most a couple of levels and the lineage never
grows with the depth.  Whether the frontier ran empty is tested right after
each checkpoint; in between, levels cost no extra job.

With ``resolved`` (JN4: url, effective_url) redirects are followed: a URL is
expanded as the page it leads to, whose URL is the base of the links and of the
scope.  Where only the requested URL's page is held, that page stands for it.
Links, seeds and levels keep the URLs as found.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegraph.functions import html as H
from sitegraph.functions import rfc as RFC
from sitegraph.functions import urls as U
from sitegraph.operators import links as L
from sitegraph.operators.redirects import with_effective_url
from sitegraph.session import ensure_checkpoint_dir


WALKS = "decimal(38,0)"


def _co_partition(table: DataFrame) -> DataFrame:
    """Keep the link table as it comes out of the per-key dedupe: already
    hash-partitioned by page_key (and sized by AQE), so every level's join
    exchanges only the frontier side."""
    return table.persist(StorageLevel.MEMORY_AND_DISK)


def page_link_table(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_key, links array<struct<pos, tag, raw_link, type_attr, link_type>>):
    the links of each distinct page, extracted once.  Resolution waits for
    the URL the page is reached by.  Only link arrays -- not HTML -- are shuffled."""
    def typed(r, i):
        return F.struct(i.alias("pos"), r["tag"].alias("tag"), r["raw_link"].alias("raw_link"),
                        r["type_attr"].alias("type_attr"),
                        U.link_type(r["tag"], r["raw_link"], r["type_attr"]).alias("link_type"))
    return first_pages(pages, U.page_key(url_col)).select(
        "page_key", F.transform(H.lexical_links(html_col), typed).alias("links")).repartition("page_key")


def first_pages(pages: DataFrame, key) -> DataFrame:
    """The pages with ``page_key``, one for each key (the lowest page_id).  Winners are
    found on (key, page_id) alone by a hash aggregate; the losers, which are few,
    are taken out before any HTML is read."""
    ids = pages.select("page_id", key.alias("page_key"))
    first = ids.groupBy("page_key").agg(F.min("page_id").alias("first"))
    losers = ids.join(first, "page_key").where("page_id <> first").select("page_id")
    return pages.withColumn("page_key", key).join(losers, "page_id", "left_anti")


def _reached(frontier: DataFrame, resolved: DataFrame | None) -> DataFrame:
    """The frontier with ``base`` (the URL it leads to), its page key and that of
    the URL itself."""
    f = frontier.withColumn("base", F.col("url")) if resolved is None else \
        with_effective_url(frontier, resolved).withColumnRenamed("effective_url", "base")
    return f.withColumn("page_key", U.page_key("base")).withColumn("own_key", U.page_key("url"))


def _held_links(bases: DataFrame, link_table: DataFrame, redirects: bool) -> DataFrame:
    """``bases`` with the links of the page under the effective URL, or else of
    the page captured under the requested URL."""
    found = bases.join(link_table, "page_key").drop("own_key")
    if not redirects:
        return found
    left = bases.where("own_key <> page_key").join(link_table.select("page_key"), "page_key", "left_anti")
    own = left.drop("page_key").withColumnRenamed("own_key", "page_key").join(link_table, "page_key")
    return found.unionByName(own)


def _expand(frontier: DataFrame, link_table: DataFrame, scope: str, scope_base: str, redirects: bool) -> DataFrame:
    """Links found on the frontier pages, resolved against the effective URL
    and filtered by scope, as rows (seed, url, [visits], dst, link_type).
    Each distinct frontier URL is expanded once and the result joined back
    to the seeds that reached it."""
    by_seed = scope_base == "seed"
    keys = ["url", "seed"] if by_seed else ["url"]
    bases = frontier.select(*keys, "base", "page_key", "own_key").dropDuplicates(keys)
    found = _held_links(bases, link_table, redirects)
    scope_ref = F.col("seed") if by_seed else F.col("base")

    def resolved(pb):
        return F.transform("links", lambda l: F.struct(l["link_type"].alias("link_type"),
                                                       U.resolve_with_base(l["raw_link"], pb).alias("dst")))
    arr = U.bind(U.page_base(F.col("base")), resolved)       # page half once per frontier URL
    if scope != "none":
        arr = U.bind(U.url_host(scope_ref),
                     lambda ph: F.filter(arr, lambda x: L._host_ok(U.url_host(x["dst"]), ph, scope, False)))
    found = found.select(*keys, F.explode(arr).alias("x")).select(*keys, "x.dst", "x.link_type")
    extra = ["visits"] if "visits" in frontier.columns else []
    return frontier.select("seed", "url", *extra).join(found, keys)


def _found_links(bases: DataFrame, link_table: DataFrame, scope: str, redirects: bool) -> DataFrame:
    """(url, dst, link_type): the in-scope links of the pages of distinct URLs, resolved against
    the effective URL."""
    found = _held_links(bases, link_table, redirects)

    def resolved(pb):
        return F.transform("links", lambda l: F.struct(l["link_type"].alias("link_type"),
                                                       U.resolve_with_base(l["raw_link"], pb).alias("dst")))
    arr = U.bind(U.page_base(F.col("base")), resolved)       # page half once per frontier URL
    if scope != "none":
        arr = U.bind(U.url_host(F.col("base")),
                     lambda ph: F.filter(arr, lambda x: L._host_ok(U.url_host(x["dst"]), ph, scope, False)))
    return found.select("url", F.explode(arr).alias("x")).select("url", "x.dst", "x.link_type")


def numbered_seeds(urls: DataFrame) -> DataFrame:
    """(seed, word, place): every distinct seed with a bit of its own, 64 to a word.  Seeds are
    numbered in the order of their URLs, so that those of one site share words."""
    ordered = urls.select(F.col("url").alias("seed")).distinct().repartitionByRange("seed").sortWithinPartitions("seed")
    number = F.monotonically_increasing_id()
    return ordered.withColumn("number", number).select(
        "seed", F.shiftright("number", 6).alias("word"), F.col("number").bitwiseAND(63).cast("int").alias("place")).checkpoint(eager=True)


def _crawl_bits(seeds: DataFrame, table: DataFrame, depth: int, scope: str, resolved: DataFrame | None, every: int,
                held: list[DataFrame]) -> DataFrame:
    """(url, word, bits, level): which seeds reach a URL first at which level, all seeds at once.

    A row stands for a URL and a word of 64 seeds; the seeds that have reached it are the bits
    of a number, which a level ORs together.  So a URL that many seeds of a site reach is
    one row in every join and aggregate, not one for each seed."""
    bit = F.expr("shiftleft(1L, place)")
    start = seeds.select(F.col("seed").alias("url"), "word", bit.alias("bits"))
    seen = start.select("url", "word", F.col("bits").alias("reached"), F.col("bits").alias("expanded"))
    frontier, levels = start, [start.withColumn("level", F.lit(0))]
    nothing = F.lit(0).cast("bigint")
    for level in range(1, depth + 1):
        bases = _reached(frontier.select("url").distinct(), resolved)
        found = _found_links(bases, table, scope, resolved is not None)
        hits = frontier.join(found, "url").groupBy(F.col("dst").alias("url"), "word").agg(
            F.bit_or("bits").alias("any"), F.bit_or(F.when(F.col("link_type") == "HTML", F.col("bits")).otherwise(nothing)).alias("html"))
        both = seen.withColumn("any", nothing).withColumn("html", nothing).unionByName(
            hits.withColumn("reached", nothing).withColumn("expanded", nothing))
        state = both.groupBy("url", "word").agg(*[F.bit_or(c).alias(c) for c in ("reached", "expanded", "any", "html")])
        state = state.select(
            "url", "word", F.col("reached").bitwiseOR(F.col("any")).alias("reached"),
            F.col("expanded").bitwiseOR(F.col("html")).alias("expanded"),
            F.col("any").bitwiseAND(F.bitwise_not("reached")).alias("fresh"),
            F.col("html").bitwiseAND(F.bitwise_not("expanded")).alias("go"))
        state = _cut(state, level, every, last=level == depth)
        held.append(state)
        levels.append(state.where("fresh <> 0").select("url", "word", F.col("fresh").alias("bits"), F.lit(level).alias("level")))
        if level == depth:
            break
        frontier = state.where("go <> 0").select("url", "word", F.col("go").alias("bits"))
        if every and level % every == 0 and frontier.isEmpty():
            break
        seen = state.select("url", "word", "reached", "expanded")
    out = levels[0]
    for rows in levels[1:]:
        out = out.unionByName(rows)
    return out


def _cut(df: DataFrame, level: int, every: int, last: bool = False) -> DataFrame:
    """Materialise a level: a reliable checkpoint every ``every`` levels (the
    lineage never grows past that), a persisted copy otherwise.  The last
    level is only persisted: the final result is checkpointed anyway."""
    if every and level % every == 0 and not last:
        return df.checkpoint(eager=True)
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def _empty(df: DataFrame) -> bool:
    """Fill the whole cache of a persisted level (``isEmpty`` would compute
    only the first partitions and leave the rest to be recomputed later) and
    say whether it holds any row."""
    return df.count() == 0


def crawl(seeds: DataFrame, pages: DataFrame, depth: int, scope: str = "same",
          scope_base: str = "page", link_table: DataFrame | None = None,
          checkpoint_every: int = 2, on_links=None, together: bool = False,
          resolved: DataFrame | None = None, pack_seeds: bool = False) -> DataFrame:
    """CRL1: every URL within ``depth`` hops of each seed, with its level.

    ``seeds`` has a ``url`` column.  Pages reached through an HTML link (or
    seeds) at a level below ``depth`` are expanded; every in-scope link they
    hold is reported.  Output: (seed, url, level) with the smallest level;
    the seed itself is level 0.  ``depth`` 0 gives nothing.

    ``on_links`` (UDF2) is a DataFrame -> DataFrame function applied to each
    level's found links (columns seed, url, dst, link_type) before they are
    reported and followed: the user's replacement for the per-link callback.

    ``together`` crawls from all seeds as one set, as a run over a list of URLs
    does: the result is (url, level) with the distance from the nearest seed, and
    the state has a row per URL, not per seed and URL.

    ``resolved`` (JN4's table) follows redirects.

    ``pack_seeds`` keeps 64 seeds in a number (``_crawl_bits``): the state has a row for each
    URL and word of seeds instead of each URL and seed.  It pays where the seeds of a site
    reach the same URLs; where hardly any URL has several seeds the plain rows are
    cheaper.  The rows are the same.  Not with a hook, or a scope that looks at single seeds.
    """
    spark = seeds.sparkSession
    if together and scope_base == "seed":
        raise ValueError("a crawl from all seeds together has no seed to measure the scope by")
    if pack_seeds and (together or scope_base == "seed" or on_links is not None):
        raise ValueError("packed seeds go with neither a hook, a scope by seed nor a crawl of all seeds together")
    if depth <= 0:
        return spark.createDataFrame([], "url string, level int" if together else "seed string, url string, level int")
    ensure_checkpoint_dir(spark)
    table = link_table if link_table is not None else _co_partition(page_link_table(pages))
    held = [] if link_table is not None else [table]
    if pack_seeds:
        ids = numbered_seeds(seeds)
        places = F.explode(F.expr("filter(sequence(0, 63), k -> shiftright(bits, k) & 1 = 1)"))
        out = _crawl_bits(ids, table, depth, scope, resolved, checkpoint_every, held)
        out = out.select("url", "level", "word", places.alias("place")).join(ids, ["word", "place"]).select(
            "seed", "url", "level").checkpoint(eager=True)
        for h in held:
            h.unpersist()
        return out
    s = seeds.select((F.lit("") if together else F.col("url")).alias("seed"), "url").distinct()
    frontier = _reached(s.select("seed", "url"), resolved)
    frontier = frontier.persist(StorageLevel.MEMORY_AND_DISK)
    held.append(frontier)
    expanded = frontier.select("seed", "url")
    found_all = [frontier.select("seed", "url", F.lit(0).alias("level"))]
    for level in range(1, depth + 1):
        hits = _expand(frontier, table, scope, scope_base, resolved is not None)
        if on_links is not None:
            hits = on_links(hits)
        step = hits.groupBy("seed", F.col("dst").alias("url")) \
            .agg(F.max(F.col("link_type") == "HTML").alias("is_html")).withColumn("level", F.lit(level))
        step = step.persist(StorageLevel.MEMORY_AND_DISK)     # one step from the frontier checkpoint
        held.append(step)
        found_all.append(step.select("seed", "url", "level"))
        if level == depth:
            break
        nxt = step.filter("is_html").select("seed", "url").join(expanded, ["seed", "url"], "left_anti")
        frontier = _cut(_reached(nxt, resolved), level, checkpoint_every)
        held.append(frontier)
        if checkpoint_every and level % checkpoint_every == 0 and _empty(frontier):
            break
        expanded = expanded.unionByName(frontier.select("seed", "url"))
    out = found_all[0]
    for f in found_all[1:]:
        out = out.unionByName(f)
    out = out.groupBy("seed", "url").agg(F.min("level").alias("level")).checkpoint(eager=True)
    for h in held:
        h.unpersist()
    return out.drop("seed") if together else out


def crawl_manifest(seeds: DataFrame, pages: DataFrame, depth: int, scope: str = "same",
                   scope_base: str = "page", link_table: DataFrame | None = None,
                   checkpoint_every: int = 2, resolved: DataFrame | None = None) -> DataFrame:
    """CRL2: the manifest the reference prints, multiplicities included.

    It keeps no visited set, so a page is expanded once per walk reaching
    it.  Walks are counted instead of enumerated: ``visits`` of a (seed,
    url) at a level is the number of walks arriving there.  Output:
    (seed, level, link_type, url, n) where n is the number of lines, exact in DECIMAL(38,0).
    ``resolved`` (JN4's table) follows redirects.
    """
    spark = seeds.sparkSession
    if depth <= 0:
        return spark.createDataFrame([], f"seed string, level int, link_type string, url string, n {WALKS}")
    ensure_checkpoint_dir(spark)
    table = link_table if link_table is not None else _co_partition(page_link_table(pages))
    held = [] if link_table is not None else [table]
    s = seeds.select(F.col("url").alias("seed")).distinct()
    # walk counts grow like out-degree ** depth: counted exactly in DECIMAL(38,0)
    frontier = _reached(s.select("seed", F.col("seed").alias("url"), F.lit(1).cast(WALKS).alias("visits")),
                        resolved).persist(StorageLevel.MEMORY_AND_DISK)
    held.append(frontier)
    lines = []
    for level in range(1, depth + 1):
        hits = _expand(frontier, table, scope, scope_base, resolved is not None)
        step = hits.groupBy("seed", F.col("dst").alias("url"), "link_type").agg(F.sum("visits").alias("n"))
        step = step.persist(StorageLevel.MEMORY_AND_DISK)     # one step from the frontier checkpoint
        held.append(step)
        lines.append(step.select("seed", F.lit(level).alias("level"), "link_type", "url", F.col("n").cast(WALKS).alias("n")))
        if level == depth:
            break
        nxt = step.filter(F.col("link_type") == "HTML").groupBy("seed", "url").agg(F.sum("n").alias("visits"))
        frontier = _cut(_reached(nxt, resolved), level, checkpoint_every)
        held.append(frontier)
        if checkpoint_every and level % checkpoint_every == 0 and _empty(frontier):
            break
    out = lines[0]
    for l in lines[1:]:
        out = out.unionByName(l)
    out = out.checkpoint(eager=True)
    for h in held:
        h.unpersist()
    return out


# --- page-crawler mode: DOM page links, RFC join, regex scope --------------------------------

def rfc_key(url) -> F.Column:
    """Identity of a page in this mode: network location + path."""
    return U.bind(RFC.split_url(url), lambda p: F.concat(p["netloc"], p["path"]))


def rfc_link_table(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_key, links array<struct<tag, raw_link, type_attr>>): iframe then a
    links of each page (lowest page_id per key), extracted before the dedupe."""
    ordered = U.bind(H.dom_links(html_col), lambda recs: F.concat(
        F.filter(recs, lambda r: r["tag"] == "iframe"), F.filter(recs, lambda r: r["tag"] == "a")))
    return first_pages(pages, rfc_key(url_col)).select("page_key", ordered.alias("links")).repartition("page_key")


def crawl_rfc(seeds: DataFrame, pages: DataFrame, depth: int, host_preserve: bool = False,
              host_regex: str | None = None, path_regex: str | None = None,
              checkpoint_every: int = 2, resolved: DataFrame | None = None) -> DataFrame:
    """CRL1 as the page crawler does it: iframe/a links, RFC 3986 join with
    params/query/fragment dropped, FLT2 scope (host of the page being
    expanded, or a host regex; a path regex), pages identified by
    netloc+path.  Output (seed, url, level); the seed is level 0.

    ``resolved`` (JN4's table) follows redirects: the links are those of the page a URL
    leads to (or else of the page held under the URL itself), but they are resolved, and
    measured by the scope, against the URL that was asked for, as this crawler does."""
    spark = seeds.sparkSession
    if depth <= 0:
        return spark.createDataFrame([], "seed string, url string, level int")
    ensure_checkpoint_dir(spark)
    table = _co_partition(rfc_link_table(pages))
    held = [table]
    s = seeds.select(F.col("url").alias("seed")).distinct()

    def reached(some: DataFrame) -> DataFrame:
        if resolved is None:
            return some.withColumn("page_key", rfc_key("url"))
        return with_effective_url(some, resolved).withColumn("page_key", rfc_key("effective_url")) \
            .withColumn("own_key", rfc_key("url")).drop("effective_url")

    frontier = reached(s.select("seed", F.col("seed").alias("url"))).persist(StorageLevel.MEMORY_AND_DISK)
    held.append(frontier)
    expanded = frontier.select("seed", "url")
    found_all = [frontier.select("seed", "url", F.lit(0).alias("level"))]

    def ok(x, base_netloc):
        cond = F.lit(True)
        if host_preserve:
            cond = cond & (x["netloc"] == base_netloc)
        elif host_regex is not None:
            cond = cond & x["netloc"].rlike(host_regex)
        if path_regex is not None:
            cond = cond & F.when(x["path"] == "", F.lit("/")).otherwise(x["path"]).rlike(path_regex)
        return cond

    for level in range(1, depth + 1):
        bases = frontier.drop("seed").dropDuplicates(["url"])
        found = _held_links(bases, table, resolved is not None)
        arr = U.bind(RFC.split_url(F.col("url")), lambda b: F.filter(
            F.transform("links", lambda l: U.bind(RFC.split_url(l["raw_link"]), lambda h: RFC.join_split(h, b))),
            lambda x: ok(x, b["netloc"])))
        arr = F.transform(arr, lambda x: RFC.unsplit(x["scheme"], x["netloc"], x["path"]))
        found = found.select("url", F.explode(arr).alias("dst"))
        step = frontier.select("seed", "url").join(found, "url") \
            .select("seed", F.col("dst").alias("url")).distinct().withColumn("level", F.lit(level))
        step = step.persist(StorageLevel.MEMORY_AND_DISK)     # one step from the frontier checkpoint
        held.append(step)
        found_all.append(step)
        if level == depth:
            break
        nxt = step.select("seed", "url").join(expanded, ["seed", "url"], "left_anti")
        frontier = _cut(reached(nxt), level, checkpoint_every)
        held.append(frontier)
        if checkpoint_every and level % checkpoint_every == 0 and _empty(frontier):
            break
        expanded = expanded.unionByName(frontier.select("seed", "url"))
    out = found_all[0]
    for f in found_all[1:]:
        out = out.unionByName(f)
    out = out.groupBy("seed", "url").agg(F.min("level").alias("level")).checkpoint(eager=True)
    for h in held:
        h.unpersist()
    return out
