"""Iterative and windowed jobs against brute force on small fixtures."""

from collections import defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sitegraph.functions import urls as U
from sitegraph.operators import aggs as A
from sitegraph.operators import joins as J
from sitegraph.operators import redirects as R
from sitegraph.plans.crawl import crawl, crawl_manifest

# a small site: page -> links (all absolute, same host), with a cycle and a diamond
GRAPH = {
    "https://s.org/a": ["/b", "/c", "/img.png", "https://o.org/x"],
    "https://s.org/b": ["/d", "/c"],
    "https://s.org/c": ["/d", "/a"],
    "https://s.org/d": ["/e"],
    "https://s.org/e": [],
}


def _pages(spark):
    rows = []
    for i, (url, links) in enumerate(GRAPH.items()):
        html = "".join(f'<img src="{l}">' if l.endswith(".png") else f'<a href="{l}">x</a>' for l in links)
        rows.append((i, url, html))
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def _abs(l):
    return l if l.startswith("http") else "https://s.org" + l


def _bfs(seed, depth, same_host):
    level = {seed: 0}
    frontier = [seed]
    for d in range(1, depth + 1):
        nxt = []
        for u in frontier:
            for l in GRAPH.get(u, []):
                v = _abs(l)
                if same_host and not v.startswith("https://s.org"):
                    continue
                if v not in level:
                    level[v] = d
                    if not v.endswith(".png"):
                        nxt.append(v)
        frontier = nxt
    return level


def _walks(seed, depth, same_host):
    lines = defaultdict(int)
    def go(u, d, lev):
        if d == 0:
            return
        for l in GRAPH.get(u, []):
            v = _abs(l)
            if same_host and not v.startswith("https://s.org"):
                continue
            t = "IMAGE" if v.endswith(".png") else "HTML"
            lines[(lev, t, v)] += 1
            if t == "HTML":
                go(v, d - 1, lev + 1)
    go(seed, depth, 1)
    return lines


def test_crawl_levels_match_bfs(spark):
    p = _pages(spark)
    for depth in (0, 1, 2, 3, 4):
        got = {(r.seed, r.url): r.level for r in crawl(p.select("url"), p, depth, scope="same").collect()}
        exp = {}
        if depth > 0:
            for seed in GRAPH:
                for u, lv in _bfs(seed, depth, True).items():
                    exp[(seed, u)] = lv
        assert got == exp, depth


def test_crawl_from_all_seeds_together(spark):
    p = _pages(spark)
    seeds = p.filter(F.col("page_id").isin(1, 2)).select("url")
    got = {r.url: r.level for r in crawl(seeds, p, 2, scope="same", together=True).collect()}
    exp: dict = {}
    for r in seeds.collect():
        for u, lv in _bfs(r.url, 2, True).items():
            exp[u] = min(lv, exp.get(u, lv))
    assert got == exp


def test_crawl_manifest_matches_walks(spark):
    p = _pages(spark)
    for depth in (1, 2, 3):
        got = {(r.seed, r.level, r.link_type, r.url): r.n
               for r in crawl_manifest(p.select("url"), p, depth, scope="none").collect()}
        exp = {}
        for seed in GRAPH:
            for (lev, t, v), n in _walks(seed, depth, False).items():
                exp[(seed, lev, t, v)] = n
        assert got == exp, depth


def test_crawls_follow_redirects(spark):
    """A moved page is expanded under its Location, one captured under the old URL only too."""
    from sitegraph.plans.archive import archive_site
    pages = spark.createDataFrame([
        (0, "https://s.org/", '<a href="/old">x</a><a href="/gone/p">x</a>'),
        (1, "https://t.org/new/", '<a href="in">x</a>'),
        (2, "https://t.org/new/in", ""),
        (3, "https://s.org/gone/p", '<a href="/rel">x</a><a href="https://s.org/far">x</a>'),
    ], "page_id bigint, url string, html string")
    resolved = spark.createDataFrame([
        ("https://s.org/old", "https://t.org/new/", 1, "ok"), ("https://s.org/gone/p", "https://t.org/to/p", 1, "ok"),
    ], "url string, effective_url string, hops int, outcome string")
    seed = pages.where("page_id = 0").select("url")
    links = {"https://s.org/": 0, "https://s.org/old": 1, "https://s.org/gone/p": 1, "https://t.org/new/in": 2,
             "https://t.org/rel": 2, "https://s.org/far": 2}
    got = crawl(seed, pages, 3, scope="none", resolved=resolved)
    assert {r.url: r.level for r in got.collect()} == links
    got = crawl(seed, pages, 3, scope="same", resolved=resolved)  # the host is that of the Location
    assert {r.url for r in got.collect()} == set(links) - {"https://s.org/far"}
    lines = crawl_manifest(seed, pages, 3, scope="none", resolved=resolved)
    assert {(r.level, r.url, int(r.n)) for r in lines.collect()} == {(v, u, 1) for u, v in links.items() if v}
    empty = spark.createDataFrame([], "save_path string, fetched_at timestamp_ntz")
    saved = archive_site(seed, pages, empty, depth=2, scope="none", as_of="2024-01-01 00:00:00", resolved=resolved)
    assert {(r.save_path, r.host) for r in saved.collect()} == {
        (r.k, r.h) for r in spark.createDataFrame([(u,) for u in (
            "https://s.org/", "https://t.org/new/", "https://t.org/to/p", "https://t.org/new/in")], "u string").select(
            U.save_path("u", F.lit("HTML")).alias("k"), U.url_host("u").alias("h")).collect()}


def test_crawl_user_hook(spark):
    p = _pages(spark)
    got = crawl(p.filter(F.col("page_id") == 0).select("url"), p, 3, scope="same",
                on_links=lambda df: df.filter(~F.col("dst").endswith("/c")))
    urls = {r.url for r in got.collect()}
    assert "https://s.org/c" not in urls and "https://s.org/e" in urls


def test_redirect_chains(spark):
    rows = [("u1", "redirect", "u2"), ("u2", "redirect", "u3"), ("u3", "ok", None),
            ("l1", "redirect", "l2"), ("l2", "redirect", "l1"), ("m1", "redirect", None),
            ("x1", "redirect", "nowhere"), ("e1", "error", None)]
    df = spark.createDataFrame(rows, "request_url string, outcome string, location string")
    got = {r.url: (r.effective_url, r.hops, r.outcome) for r in R.resolve_redirects(df).collect()}
    assert got["u1"] == ("u3", 2, "ok")
    assert got["l1"] == ("l2", 1, "loop")
    assert got["m1"] == ("m1", 0, "error")
    assert got["x1"] == ("nowhere", 1, "unknown")
    assert got["e1"] == ("e1", 0, "error")


def _follow(table, url):
    """One step after the other, stopping before a URL of the chain comes again."""
    chain = [url]
    while True:
        outcome, to = table.get(chain[-1], (None, None))
        if outcome is None:
            return chain[-1], len(chain) - 1, "unknown"
        if outcome != "redirect":
            return chain[-1], len(chain) - 1, outcome
        if to is None:
            return chain[-1], len(chain) - 1, "error"
        if to in chain:
            return chain[-1], len(chain) - 1, "loop"
        chain.append(to)


def test_redirects_of_any_shape(spark):
    import random
    r = random.Random(7)
    table = {f"c{k}": ("redirect", f"c{k + 1}") for k in range(60)} | {"c60": ("ok", None)}
    for k in range(150):
        kind = r.random()
        table[f"n{k}"] = ("redirect", f"n{r.randrange(170)}") if kind < 0.8 else (("redirect", None) if kind < 0.9 else ("ok", None))
    table |= {"self": ("redirect", "self")} | {f"r{k}": ("redirect", f"r{(k + 1) % 9}") for k in range(9)} | {"t": ("redirect", "r4")}
    df = spark.createDataFrame([(u, *v) for u, v in table.items()], "request_url string, outcome string, location string")
    got = {x.url: (x.effective_url, x.hops, x.outcome) for x in R.resolve_redirects(df).collect()}
    assert got == {u: _follow(table, u) for u in table}


def test_the_newest_capture_of_a_redirect_counts(spark):
    rows = [("u", "redirect", "a", 1), ("u", "redirect", "b", 3), ("u", "ok", None, 2), ("a", "ok", None, 1), ("b", "ok", None, 1)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "request_url string, outcome string, location string, ts int")
        found = R.resolve_redirects(df)
        assert found.where("url = 'u'").first().effective_url == "b"
        mapped = R.with_effective_url(df.select(F.col("request_url").alias("url")).union(
            spark.createDataFrame([("z",)], "url string")).distinct(), found)
        assert {r.url: r.effective_url for r in mapped.collect()} == {"u": "b", "a": "a", "b": "b", "z": "z"}


def test_crawl_without_checkpoints_between_levels(spark):
    p = _pages(spark)
    assert crawl(p.select("url"), p, 3, checkpoint_every=0).count() == crawl(p.select("url"), p, 3).count()
    assert crawl_manifest(p.select("url"), p, 2, checkpoint_every=0).count() > 0


def test_attempts_are_numbered_in_time(spark):
    df = spark.createDataFrame([(k, "hot" if k % 3 else f"u{k}", 1000 - k) for k in range(300)], "request_id int, url string, ts int")
    seen: dict = {}
    for k, url, ts in sorted(((r.request_id, r.url, r.ts) for r in df.collect()), key=lambda r: r[2]):
        seen.setdefault(url, []).append(k)
    got = {r.request_id: r.attempt for r in A.number_attempts(df).collect()}
    assert got == {k: i + 1 for ids in seen.values() for i, k in enumerate(ids)}


def test_archive_run_defaults_and_failures(spark):
    from sitegraph.plans import archive as AR
    p = spark.createDataFrame([(1, "https://s.org/a", '<a href="/b">b</a><img src="/i.png"><a href="/gone">g</a>'),
                               (2, "https://s.org/b", "<p>b</p>"), (3, "https://s.org/i.png", "PNG")],
                              "page_id long, url string, html string")
    old = spark.createDataFrame([("s.org/b/index.html", "2020-01-01 00:00:00")], "save_path string, t string").select(
        "save_path", F.to_timestamp_ntz("t").alias("fetched_at"))
    seeds = p.where("page_id = 1").select("url")
    rows = {r.save_path: r.body for r in AR.archive_site(seeds, p, old).collect()}  # now: the copy is stale
    assert set(rows) == {"s.org/a/index.html", "s.org/b/index.html", "s.org/i.png"} and rows["s.org/i.png"] == "PNG"
    assert AR.archive_site(seeds, p, old, as_of="2020-01-01 00:05:00").count() == 2
    missing = AR.missing_fetches(AR.fetch_plan(seeds, p, old)).collect()
    assert [(r.save_path, r.url) for r in missing] == [("s.org/gone/index.html", "https://s.org/gone")]
    saved = AR.crawl_and_save(seeds, p.withColumn("html", F.regexp_replace("html", "gone", "b")), old, 1)
    assert sorted(r.save_path for r in saved.collect()) == ["s.org/a/index.html", "s.org/i.png"]


def test_no_html_in_the_shuffle_of_keys(spark):
    from sitegraph.plans import archive as AR
    p, old = _pages(spark), spark.createDataFrame([], "save_path string, fetched_at timestamp_ntz")
    plan = AR.fetch_plan(p.select("url"), p, old, as_of="2024-01-01 00:00:00")._jdf.queryExecution().executedPlan().toString()
    assert "html" not in "".join(x for x in plan.splitlines() if "Exchange" in x)


def test_pacing_plan_matches_sequential(spark):
    t0 = datetime(2024, 1, 1)
    rows = []
    for i in range(300):
        host = "hot.org" if i % 3 else f"h{i % 7}.org"
        rows.append((i, host, t0 + timedelta(minutes=7 * i), i % 4 != 0))
    df = spark.createDataFrame(rows, "request_id long, host string, ts timestamp, is_fetch boolean")
    got = {r.request_id: r.offset_ms for r in A.pacing_plan(df, 1000).collect()}
    seen = defaultdict(int)
    for rid, host, ts, fetch in sorted(rows, key=lambda r: (r[2], r[0])):
        assert got[rid] == seen[host] * 1000
        seen[host] += int(fetch)


def test_cache_lookup_ttl_boundary(spark):
    t = datetime(2024, 1, 2, 12, 0, 0)
    req = spark.createDataFrame([(1, "https://a.org/x", "HTML", t), (2, "https://a.org/y/", "HTML", t),
                                 (3, "https://a.org/z", "HTML", t)],
                                "request_id long, url string, link_type string, ts timestamp")
    arc = spark.createDataFrame([("a.org/x/index.html", t - timedelta(minutes=10)),
                                 ("a.org/y/index.html", t - timedelta(minutes=10, seconds=1))],
                                "save_path string, fetched_at timestamp")
    got = {r.request_id: r.cache_status for r in J.cache_lookup(req, arc, ttl_min=10).collect()}
    assert got == {1: "hit", 2: "stale", 3: "miss"}


def test_first_per_key_hot_key(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i}", 1000 - i) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, k string, ord long")
    got = {r.k: (r.id, r.n) for r in A.first_per_key(df, "k", "ord", count_as="n").collect()}
    assert got["hot"] == (2997, 1000)


def test_page_crawler_and_saver_follow_redirects(spark):
    """Content comes from where a URL leads, links are read from the URL that was asked for."""
    from sitegraph.plans import archive as AR
    from sitegraph.plans.crawl import crawl_rfc
    pages = spark.createDataFrame([
        (0, "https://s.org/", '<a href="/old/p">x</a><img src="/i.png"><img src="/j.png">'),
        (1, "https://t.org/new/", '<a href="in">x</a><a href="/abs">y</a>'),
        (2, "https://s.org/old/in", "in"), (3, "https://cdn.org/i", "PNG"), (4, "https://s.org/j.png", "own"),
    ], "page_id bigint, url string, html string")
    resolved = spark.createDataFrame([
        ("https://s.org/old/p", "https://t.org/new/", 1, "ok"), ("https://s.org/i.png", "https://cdn.org/i", 1, "ok"),
        ("https://s.org/j.png", "https://cdn.org/none", 1, "unknown"),
    ], "url string, effective_url string, hops int, outcome string")
    seed = pages.where("page_id = 0").select("url")
    got = {r.url: r.level for r in crawl_rfc(seed, pages, 2, resolved=resolved).collect()}
    assert got == {"https://s.org/": 0, "https://s.org/old/p": 1, "https://s.org/old/in": 2, "https://s.org/abs": 2}
    assert {r.url for r in crawl_rfc(seed, pages, 2).collect()} == {"https://s.org/", "https://s.org/old/p"}
    empty = spark.createDataFrame([], "save_path string, fetched_at timestamp_ntz")
    rows = AR.crawl_and_save(seed, pages, empty, 2, "2024-01-01 00:00:00", resolved, host_preserve=True)
    saved = {r.save_path: (r.host, r.body) for r in rows.collect()}
    assert saved == {
        "s.org/index.html": ("s.org", '<a href="old/p/index.html">x</a><img src="i.png"><img src="j.png">'),
        "s.org/old/p/index.html": ("s.org", '<a href="../in/index.html">x</a><a href="../../abs/index.html">y</a>'),
        "s.org/old/in/index.html": ("s.org", "in"), "s.org/i.png": ("s.org", "PNG"), "s.org/j.png": ("s.org", "own")}


def test_packed_seeds_reach_the_same_and_share_rows(spark):
    """150 seeds of one site: the same levels as seed by seed, in a fraction of the rows."""
    from sitegraph.plans import crawl as C
    n = 150
    rows = [(k, f"https://s.org/{k:03d}", f'<a href="/{(k * 7 + 1) % n:03d}">x</a><a href="/home">h</a><img src="/i{k % 3}.png">')
            for k in range(n)]
    rows += [(n, "https://s.org/home", '<a href="/000">x</a><a href="https://o.org/">y</a>'),
             (n + 1, "https://o.org/", '<a href="https://s.org/001">x</a>')]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    seeds = pages.where("page_id < 150").select("url")
    resolved = spark.createDataFrame([("https://s.org/home", "https://o.org/", 1, "ok")],
                                     "url string, effective_url string, hops int, outcome string")
    for scope, lead in (("none", None), ("same", None), ("none", resolved)):
        plain, packed = (sorted(map(tuple, crawl(seeds, pages, 4, scope=scope, resolved=lead, pack_seeds=p).collect()))
                         for p in (False, True))
        assert packed == plain and len(plain) > 3 * n
    held = []
    bits = C._crawl_bits(C.numbered_seeds(seeds), C.page_link_table(pages), 4, "none", None, 2, held).where("url LIKE '%home'")
    assert bits.where("level = 1").count() <= 150 // 64 + 2 < n


def test_planner_estimates_of_redirects_stay_small(spark):
    """A join is estimated as the product of its sides.  Squared by every round of doubling, the
    estimate would have as many digits as there are URLs, in every plan that reads the result."""
    rows = [(f"r{k}", "redirect", f"r{(k + 1) % 300}") for k in range(300)] + [("t", "redirect", "r7"), ("a", "redirect", "b"), ("b", "ok", None)]
    df = spark.createDataFrame(rows, "request_url string, outcome string, location string")
    found = R.resolve_redirects(df)
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 40
    assert {r.url: (r.effective_url, r.hops, r.outcome) for r in found.where("url IN ('r0', 't', 'a', 'b')").collect()} == {
        "r0": ("r299", 299, "loop"), "t": ("r6", 300, "loop"), "a": ("b", 1, "ok"), "b": ("b", 0, "ok")}
