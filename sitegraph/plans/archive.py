"""Archiving jobs composed from the operators (JN5, PIP1, PIP2)."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegraph.functions import rfc as RFC
from sitegraph.functions import urls as U
from sitegraph.operators import joins as J
from sitegraph.operators import links as L
from sitegraph.operators import rewrite as RW
from sitegraph.operators.redirects import with_effective_url
from sitegraph.plans.crawl import crawl_manifest, crawl_rfc
from sitegraph.plans.ledger import Ledger, content_digest


def page_bundle(pages: DataFrame, archive: DataFrame, resources_only: bool = False) -> DataFrame:
    """JN5: every DOM-mode link of each page with its local path and whether
    the archive already holds it (left join on the local path; a missing
    resource is kept with ``found = false``).  ``resources_only`` leaves out
    links to other pages (iframe, a)."""
    d = L.extract_links_dom(pages, resolve=True, resources_only=resources_only)
    d = d.withColumn("local_path", RFC.local_path("url"))
    a = archive.select(F.col("save_path").alias("local_path"), F.lit(True).alias("_hit"))
    return d.join(a, "local_path", "left").withColumn("found", F.coalesce("_hit", F.lit(False))).drop("_hit")


def _now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")


def fetch_plan(seeds: DataFrame, corpus: DataFrame, archive: DataFrame, depth: int = 1, scope: str = "same",
               ttl_min: int | None = 1000, as_of: str | None = None, force: bool = False,
               resolved: DataFrame | None = None, manifest: DataFrame | None = None) -> DataFrame:
    """(save_path, url, link_type, page_id): the save paths that the crawl's manifest
    names and no fresh copy covers, with the corpus page that holds each (lowest
    page_id; NULL if none).  Pages are matched by their page key, other resources
    by host and path.  Only keys and ids are shuffled, no HTML.  With ``resolved``
    (JN4) url and save path are those that redirects lead to; a page held only under
    a URL that leads there stands for it.  ``manifest``: that of an earlier crawl of
    the same seeds, instead of a new one."""
    man = crawl_manifest(seeds, corpus, depth, scope, resolved=resolved) if manifest is None else manifest
    man = man.select("link_type", "url")
    man = man.unionByName(seeds.select(F.lit("HTML").alias("link_type"), "url"))
    if resolved is not None:
        man = with_effective_url(man.distinct(), resolved).select("link_type", F.col("effective_url").alias("url"),
                                                                  F.col("url").alias("asked"))
    todo = J.fetch_list(man, archive, ttl_min, as_of or _now(), force)
    keys = F.explode(F.array_distinct(F.array(U.page_key("url"), U.host_path("url"))))
    held = corpus.select("page_id", keys.alias("save_path")).groupBy("save_path").agg(F.min("page_id").alias("page_id"))
    plan = todo.join(held, "save_path", "left")
    if resolved is None:
        return plan
    asked = man.where("asked <> url").select(U.save_path("url", F.col("link_type")).alias("to"),
                                             U.save_path("asked", F.col("link_type")).alias("save_path"))
    under = asked.distinct().join(held, "save_path").groupBy(F.col("to").alias("save_path")).agg(
        F.min("page_id").alias("asked_id"))
    return plan.join(under, "save_path", "left").withColumn("page_id", F.coalesce("page_id", "asked_id")).drop("asked_id")


def archive_site(seeds: DataFrame, corpus: DataFrame, archive: DataFrame, depth: int = 1,
                 scope: str = "same", ttl_min: int | None = 1000, as_of: str | None = None,
                 force: bool = False, resolved: DataFrame | None = None) -> DataFrame:
    """PIP1: crawl -> manifest -> fetch list -> fetch (join with the corpus)
    -> archive rows, links of pages rewritten.  Returns the new archive rows
    (page_key, save_path, host, body, fetched_at), which
    ``sinks.writers.write_archive`` merges into an archive; every line of the
    manifest counts, resources too.  ``as_of`` (default: now) is the time that
    copies are held against.  What the corpus lacks: ``missing_fetches``.
    ``resolved`` (JN4's table) follows redirects."""
    as_of = as_of or _now()
    return fetched_rows(fetch_plan(seeds, corpus, archive, depth, scope, ttl_min, as_of, force, resolved), corpus, as_of)


def fetched_rows(plan: DataFrame, corpus: DataFrame, as_of: str) -> DataFrame:
    """PIP1: the archive rows of a ``fetch_plan``, links of pages rewritten."""
    # the narrow plan meets the pages once, by page id
    fetched = plan.where("page_id IS NOT NULL").join(corpus.select("page_id", "html"), "page_id")
    hint = F.concat(F.lit("./"), F.col("save_path"))
    body = F.when(F.col("link_type").isin("HTML", "NO"), RW.rewrite_html(F.col("html"), hint)).otherwise(F.col("html"))
    return fetched.select(F.col("save_path").alias("page_key"), "save_path", U.url_host("url").alias("host"),
                          body.alias("body"), F.to_timestamp_ntz(F.lit(as_of)).alias("fetched_at"))


def archive_run(ledger: Ledger, seeds: DataFrame, corpus: DataFrame, archive: DataFrame, as_of: str, depth: int = 1,
                scope: str = "same", ttl_min: int | None = 1000, force: bool = False,
                resolved: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """PIP1 as a run that can be taken up again: (archive rows, missing fetches), those of
    ``archive_site`` and ``missing_fetches``.  The manifest, the fetch plan and the fetched rows are
    stages of the ledger: a stage that finished for the same tables and parameters is
    read, also by a later run; a new archive needs a new plan, but not a new crawl.
    The tables are digested once a run, by one pass over each."""
    pages = content_digest(corpus.select("page_id", "url", "html"))
    led = None if resolved is None else content_digest(resolved)
    start = content_digest(seeds)
    manifest = ledger.stage("manifest", lambda: crawl_manifest(seeds, corpus, depth, scope, resolved=resolved),
                            {"seeds": start, "corpus": pages, "resolved": led}, depth=depth, scope=scope)
    held = content_digest(archive.select("save_path", "fetched_at"))
    plan = ledger.stage(
        "plan", lambda manifest: fetch_plan(seeds, corpus, archive, depth, scope, ttl_min, as_of, force, resolved, manifest),
        {"manifest": manifest, "seeds": start, "corpus": pages, "archive": held, "resolved": led},
        ttl_min=ttl_min, as_of=as_of, force=force)
    rows = ledger.stage("rows", lambda plan: fetched_rows(plan, corpus, as_of), {"plan": plan, "corpus": pages}, as_of=as_of)
    return rows.table, missing_fetches(plan.table)


def missing_fetches(plan: DataFrame) -> DataFrame:
    """PIP1: the lines of a ``fetch_plan`` that the corpus could not serve (save_path,
    url, link_type): the run's failure table."""
    return plan.where("page_id IS NULL").select("save_path", "url", "link_type")


def rewrite_archive(archive: DataFrame) -> DataFrame:
    """PIP1, last step: the links of every archived page rewritten (pages are the
    rows whose path ends in .html; rewritten links stay as they are)."""
    hint = F.concat(F.lit("./"), F.col("save_path"))
    body = F.when(F.col("save_path").endswith(".html"), RW.rewrite_html(F.col("body"), hint)).otherwise(F.col("body"))
    return archive.withColumn("body", body)


def archive_pages(pages: DataFrame, archive: DataFrame | None = None, force: bool = False) -> DataFrame:
    """PIP2: save pages with their links rewritten (DOM mode); a page whose
    local path is already archived is skipped unless ``force``.
    Output: (local_path, url, body)."""
    p = pages.withColumn("local_path", RFC.local_path("url"))
    if archive is not None and not force:
        p = p.join(archive.select(F.col("save_path").alias("local_path")), "local_path", "left_anti")
    return p.select("local_path", "url", RW.rewrite_html_dom("html", "url").alias("body"))


def save_page_rows(pages: DataFrame, corpus: DataFrame, archive: DataFrame, as_of: str | None = None,
                   resolved: DataFrame | None = None) -> DataFrame:
    """PIP2 with resources: archive rows of the pages (links rewritten) and of the
    resources they name that are in the corpus and not yet archived, each once.  With
    ``resolved`` (JN4) a resource is what its URL leads to, saved under its own path."""
    at = F.to_timestamp_ntz(F.lit(as_of or _now()))
    saved = archive_pages(pages, archive).select("local_path", "url", "body")
    wanted = page_bundle(pages, archive, resources_only=True).where("NOT found").select("local_path", "url").distinct()
    own = F.col("local_path")
    if resolved is not None:
        wanted = with_effective_url(wanted, resolved)
        own = F.explode(F.array_distinct(F.array(RFC.local_path("effective_url"), F.col("local_path"))))
    asked = wanted.groupBy("local_path").agg(F.min("url").alias("url"))
    wanted = wanted.select("local_path", own.alias("held_path")).distinct()
    held = corpus.select("page_id", RFC.local_path("url").alias("held_path")).groupBy("held_path").agg(
        F.min("page_id").alias("page_id"))
    # what a URL leads to comes before what is held under its own path
    found = wanted.join(held, "held_path").groupBy("local_path").agg(
        F.min(F.when(F.col("held_path") != F.col("local_path"), F.col("page_id"))).alias("led"), F.min(
            F.when(F.col("held_path") == F.col("local_path"), F.col("page_id"))).alias("own"))
    found = found.select("local_path", F.coalesce("led", "own").alias("page_id"))
    resources = found.join(asked, "local_path").join(
        corpus.select("page_id", F.col("html").alias("body")), "page_id").select("local_path", "url", "body")
    resources = resources.join(saved.select("local_path"), "local_path", "left_anti")
    return saved.unionByName(resources).select(
        F.col("local_path").alias("page_key"), F.col("local_path").alias("save_path"),
        RFC.split_url("url")["netloc"].alias("host"), "body", at.alias("fetched_at"))


def reached_pages(urls: DataFrame, corpus: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """(page_id, url, html): the page of each URL, under the URL that was asked for.  With
    ``resolved`` it is the page the URL leads to, or else the one held under the URL itself."""
    if resolved is None:
        return corpus.select("page_id", "url", "html").join(urls, "url", "left_semi")
    ids = corpus.select("page_id", F.col("url").alias("held"))
    first = ids.groupBy("held").agg(F.min("page_id").alias("page_id"))
    asked = with_effective_url(urls.distinct(), resolved)
    led = asked.join(first, F.col("effective_url") == F.col("held"), "left").select("url", F.col("page_id").alias("led"))
    both = led.join(first, F.col("url") == F.col("held"), "left").select("url", F.coalesce("led", "page_id").alias("page_id"))
    return both.where("page_id IS NOT NULL").join(corpus.select("page_id", "html"), "page_id").select("page_id", "url", "html")


def crawl_and_save(seeds: DataFrame, corpus: DataFrame, archive: DataFrame, depth: int, as_of: str | None = None,
                   resolved: DataFrame | None = None, **scope) -> DataFrame:
    """The page crawler's list, then every listed page saved with its resources; both follow
    redirects with ``resolved`` (JN4's table)."""
    found = crawl_rfc(seeds, corpus, depth, resolved=resolved, **scope).select("url").distinct()
    return save_page_rows(reached_pages(found, corpus, resolved), corpus, archive, as_of, resolved)
