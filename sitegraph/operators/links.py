"""Link extraction, typing, resolution and manifests (LNK1-4, AGG1).

All steps are narrow transformations of the ``pages`` scan (regex, generate,
project, filter): no shuffle until a manifest is aggregated, and the HTML
column is dropped right after the tag tokens are generated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegraph.functions import html as H
from sitegraph.functions import rfc as RFC
from sitegraph.functions import urls as U

def extract_links(pages: DataFrame, url_col: str = "url", html_col: str = "html",
                  keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """LNK1: one row per link-bearing tag, lexical rules.

    Output: keep columns, src_url, pos (ordinal of the tag in the page), tag,
    raw_link, type_attr.
    """
    keep = tuple(k for k in keep if k in pages.columns)
    recs = pages.select(*keep, F.col(url_col).alias("src_url"),
                        F.posexplode(H.lexical_links(html_col)).alias("pos", "rec"))
    return recs.select(*keep, "src_url", "pos", "rec.tag", "rec.raw_link", "rec.type_attr")


def extract_links_dom(pages: DataFrame, url_col: str = "url", html_col: str = "html",
                      keep: tuple[str, ...] = ("page_id",), pages_only: bool = False,
                      resolve: bool = False, resources_only: bool = False) -> DataFrame:
    """LNK2: DOM tag set (iframe, a, img, script, stylesheet/icon link).

    Comments and script/style bodies are skipped; names are case-insensitive;
    values may use any quoting; a repeated attribute keeps its last value.
    Rows are ordered per page by tag group (iframe, a, img, script, link),
    then document order, and ``pos`` numbers them in that order (computed in
    the page's own row, no shuffle).  ``pages_only`` keeps iframe and a only,
    ``resources_only`` leaves them out; positions are those among all links.
    ``resolve`` adds the RFC-joined target (scheme, netloc, path, url), with
    the page URL split once per page rather than once per link.
    """
    keep = tuple(k for k in keep if k in pages.columns)
    groups = ("iframe", "a", "img", "script", "link")
    if pages_only:
        groups = groups[:2]
    def of_tag(g):
        return lambda r: r["tag"] == g
    # the scan is bound: one filter a group over the bare expression would scan the page for each of them
    ordered = U.bind(H.dom_links(html_col),
                     lambda recs: F.flatten(F.array(*[F.filter(recs, of_tag(g)) for g in groups])))
    if resources_only:  # left out before any link is resolved
        ordered = F.transform(ordered, lambda r, i: F.struct(r["tag"].alias("tag"), r["raw_link"].alias("raw_link"),
                                                             r["type_attr"].alias("type_attr"), i.alias("pos")))
        ordered = F.filter(ordered, lambda r: ~r["tag"].isin("iframe", "a"))
    if resolve:
        def with_target(b):
            def one(r):
                j = U.bind(RFC.split_url(r["raw_link"]), lambda h: RFC.join_split(h, b))
                own = [r[c].alias(c) for c in ("tag", "raw_link", "type_attr", *(["pos"] if resources_only else []))]
                return F.struct(*own, j.alias("target"))
            return F.transform(ordered, one)
        ordered = U.bind(RFC.split_url(F.col(url_col)), with_target)
    out = pages.select(*keep, F.col(url_col).alias("src_url"), F.posexplode(ordered).alias("pos", "rec"))
    lt = F.col("rec.tag")
    link_type = F.when(lt == "iframe", "IFRAME").when(lt == "a", "HTML").when(lt == "img", "IMAGE") \
        .when(lt == "script", "SCRIPT").otherwise("STYLE")
    pos = F.col("rec.pos" if resources_only else "pos")
    cols = [*keep, "src_url", pos, "rec.tag", "rec.raw_link", "rec.type_attr", link_type.alias("link_type")]
    if resolve:
        cols += [F.col("rec.target.scheme").alias("scheme"), F.col("rec.target.netloc").alias("netloc"),
                 F.col("rec.target.path").alias("path")]
        out = out.select(*cols)
        return out.withColumn("url", RFC.unsplit(F.col("scheme"), F.col("netloc"), F.col("path")))
    return out.select(*cols)


def classify_links(links: DataFrame) -> DataFrame:
    """LNK3: add link_type (HTML / IMAGE / STYLE / SCRIPT / NO)."""
    return links.withColumn("link_type", U.link_type("tag", "raw_link", "type_attr"))


def resolve_links(links: DataFrame, base_col: str = "src_url", out: str = "url") -> DataFrame:
    """URL8 on every link: full URL against the page it sits on."""
    return links.withColumn(out, U.resolve_link("raw_link", base_col))


def scope_filter(links: DataFrame, scope: str = "same", base_col: str = "src_url",
                 url_col: str = "url", dot_boundary: bool = False) -> DataFrame:
    """FLT1: keep links whose host is in scope of the page they sit on."""
    if scope == "none":
        return links
    return links.filter(U.in_scope(url_col, base_col, scope, dot_boundary))


def scope_filter_regex(links: DataFrame, host_preserve: bool = False, host_regex: str | None = None,
                       path_regex: str | None = None, host_col: str = "netloc",
                       base_host_col: str = "src_netloc", path_col: str = "path") -> DataFrame:
    """FLT2: host filter AND path filter; ``host_preserve`` wins over ``host_regex``;
    an empty path is tested as ``/``.  Regexes are searched, not anchored."""
    cond = F.lit(True)
    if host_preserve:
        cond = cond & (F.col(host_col) == F.col(base_host_col))
    elif host_regex is not None:
        cond = cond & F.col(host_col).rlike(host_regex)
    if path_regex is not None:
        p = F.when(F.col(path_col) == "", F.lit("/")).otherwise(F.col(path_col))
        cond = cond & p.rlike(path_regex)
    return links.filter(cond)


def split_pages_resources(links: DataFrame, type_col: str = "link_type") -> tuple[DataFrame, DataFrame]:
    """LNK4: (page links: HTML/IFRAME, resources: the rest)."""
    is_page = F.col(type_col).isin("HTML", "IFRAME")
    return links.filter(is_page), links.filter(~is_page)


def resolved_link_array(links, base_url, scope: str = "none", dot_boundary: bool = False,
                        with_type: bool = True):
    """Resolve, scope-filter and type an array of link structs inside one
    expression.  Kept per page on purpose: as separate project/filter steps
    the optimizer would copy the resolution into the filter and compute it
    twice.  The page-dependent half of the resolution and the page host are
    computed once per page, not once per link.  Each element keeps its
    original position ``pos``."""
    base_url = F.col(base_url) if isinstance(base_url, str) else base_url

    def per_page(pb):
        def enrich(r, i):
            fields = [i.alias("pos"), r["tag"].alias("tag"), r["raw_link"].alias("raw_link"),
                      r["type_attr"].alias("type_attr"), U.resolve_with_base(r["raw_link"], pb).alias("url")]
            if with_type:
                fields.append(U.link_type(r["tag"], r["raw_link"], r["type_attr"]).alias("link_type"))
            return F.struct(*fields)
        arr = F.transform(links, enrich)
        if scope == "none":
            return arr
        # scope compares with the host of the page URL as given
        return U.bind(U.url_host(base_url), lambda ph: F.filter(
            arr, lambda x: _host_ok(U.url_host(x["url"]), ph, scope, dot_boundary)))

    return U.bind(U.page_base(base_url), per_page)


def _host_ok(h, ph, scope, dot_boundary):
    if scope == "same":
        return h == ph
    if scope == "subdomain":
        return ((h == ph) | h.endswith(F.concat(F.lit("."), ph))) if dot_boundary else h.endswith(ph)
    raise ValueError(f"unknown scope {scope!r}")


def page_links(pages: DataFrame, scope: str = "same", url_col: str = "url",
               html_col: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """LNK1 -> URL8 -> FLT1 -> LNK3 over every page: what the crawler prints
    for a page at depth one, one row per link occurrence.  All per-link work
    happens inside the page's row (one generator, no shuffle)."""
    keep = tuple(k for k in keep if k in pages.columns)
    arr = resolved_link_array(H.lexical_links(html_col), F.col(url_col), scope)
    out = pages.select(*keep, F.col(url_col).alias("src_url"), F.explode(arr).alias("l"))
    return out.select(*keep, "src_url", "l.pos", "l.tag", "l.raw_link", "l.type_attr", "l.url", "l.link_type")


def manifest(links: DataFrame) -> DataFrame:
    """AGG1 (bag): ``link_type, url`` per link occurrence, duplicates kept."""
    return links.select("link_type", "url")


def manifest_counts(links: DataFrame) -> DataFrame:
    """AGG1: ``link_type, url, n`` -- occurrences per manifest line.

    A partial (map-side) count runs before the shuffle, so a URL linked from
    a third of all pages costs one row per task, not one per link.
    """
    return links.groupBy("link_type", "url").agg(F.count(F.lit(1)).alias("n"))


def with_page_key(df: DataFrame, url_col: str = "url", out: str = "page_key") -> DataFrame:
    return df.withColumn(out, U.page_key(url_col))
