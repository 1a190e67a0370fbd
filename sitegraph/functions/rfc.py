"""URL functions of the page-saving tool ("Py mode"): RFC 3986 style parsing
and joining, local archive paths and shortest relative paths (URL9, URL11,
URL13).  Built from Spark built-ins only, like ``urls``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegraph.functions.urls import bind

# ---------------------------------------------------------------------------
# Fixed values of the standard URL library being matched.
# Schemes whose relative references are joined against a base.
USES_RELATIVE = ("", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms",
                 "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss")
# Schemes that carry a network location.
USES_NETLOC = ("", "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms", "https", "shttp",
               "snews", "prospero", "rtsp", "rtsps", "rtspu", "rsync", "svn", "svn+ssh", "sftp", "nfs", "git",
               "git+ssh", "ws", "wss", "itms-services")
# Schemes whose last path segment may carry ";params".
USES_PARAMS = ("", "ftp", "hdl", "prospero", "http", "imap", "https", "shttp", "rtsp", "rtsps", "rtspu", "sip",
               "sips", "mms", "sftp", "tel")
INDEX_FILE = "index.html"
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(url) -> Column:
    """Leading control characters and spaces dropped; tab, CR, LF removed."""
    return F.regexp_replace(F.regexp_replace(_c(url), r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def split_url(url) -> Column:
    """struct(scheme, netloc, path, params, query, fragment)."""
    def parts(u):
        scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
        rest = F.when(scheme != "", F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.\-]*:", "")).otherwise(u)
        return F.struct(scheme.alias("scheme"), rest.alias("rest"))

    def pieces(sr):
        rest = sr["rest"]
        has_netloc = rest.startswith("//")
        netloc = F.when(has_netloc, F.regexp_extract(rest, r"^//([^/?#]*)", 1)).otherwise(F.lit(""))
        rest2 = F.when(has_netloc, F.regexp_replace(rest, r"^//[^/?#]*", "")).otherwise(rest)
        return F.struct(sr["scheme"].alias("scheme"), netloc.alias("netloc"), rest2.alias("rest2"))

    def finish(x):
        rest2 = x["rest2"]
        fragment = F.regexp_extract(rest2, r"(?s)#(.*)$", 1)
        no_frag = F.regexp_replace(rest2, r"(?s)#.*$", "")
        query = F.regexp_extract(no_frag, r"(?s)\?(.*)$", 1)
        path_full = F.regexp_replace(no_frag, r"(?s)\?.*$", "")
        return bind(path_full, lambda pf: _with_params(x["scheme"], x["netloc"], pf, query, fragment))

    return bind(bind(bind(clean(url), parts), pieces), finish)


def _with_params(scheme, netloc, path_full, query, fragment) -> Column:
    # params: from the first ';' of the last segment (schemes that use them)
    has_params = scheme.isin(*USES_PARAMS) & F.regexp_extract(path_full, r"(?s)[^/]*$", 0).contains(";")
    cut = F.length(F.regexp_extract(path_full, r"(?s)^(.*/)?[^/;]*;", 0))
    path = F.when(has_params, F.substring(path_full, F.lit(1), cut - 1)).otherwise(path_full)
    params = F.when(has_params, F.substring(path_full, cut + 1, F.length(path_full))).otherwise(F.lit(""))
    return F.struct(scheme.alias("scheme"), netloc.alias("netloc"), path.alias("path"), params.alias("params"),
                    query.alias("query"), fragment.alias("fragment"))


def _resolve_segments(base_path: Column, path: Column) -> Column:
    """Path part of a join: merge with the base directory, drop '.', pop on '..'."""
    base_parts = F.split(base_path, "/", -1)
    base_dir = F.when(F.element_at(base_parts, -1) != "", F.slice(base_parts, 1, F.size(base_parts) - 1)) \
        .otherwise(base_parts)
    rel = F.concat(base_dir, F.split(path, "/", -1))
    n = F.size(rel)
    # empty segments strictly inside the merged list are dropped
    rel = F.filter(rel, lambda s, i: (s != "") | (i == 0) | (i == n - 1))
    segs = F.when(path.startswith("/"), F.split(path, "/", -1)).otherwise(rel)
    stack = F.aggregate(
        segs, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc).otherwise(F.array_append(acc, s)))
    stack = F.when(F.element_at(segs, -1).isin(".", ".."), F.array_append(stack, F.lit(""))).otherwise(stack)
    joined = F.array_join(stack, "/")
    return F.when(joined == "", F.lit("/")).otherwise(joined)


def join_split(h: Column, b: Column) -> Column:
    """URL9 on already split link ``h`` and base ``b`` (``split_url`` structs):
    struct(scheme, netloc, path).  Lets a page split its own URL once for
    all its links."""
    eff_scheme = F.when(h["scheme"] != "", h["scheme"]).otherwise(b["scheme"])
    own = (h["netloc"] != "") | (eff_scheme != b["scheme"]) | ~eff_scheme.isin(*USES_RELATIVE)
    netloc = F.when(eff_scheme.isin(*USES_NETLOC), b["netloc"]).otherwise(h["netloc"])
    same_path = (h["path"] == "") & (h["params"] == "")
    path = F.when(same_path, b["path"]).otherwise(_resolve_segments(b["path"], h["path"]))
    # the joined URL is written out and read again: a path under a netloc gets its '/'
    path = bind(path, lambda p: F.when((netloc != "") & (p != "") & ~p.startswith("/"),
                                       F.concat(F.lit("/"), p)).otherwise(p))
    return (F.when(own, F.struct(h["scheme"].alias("scheme"), h["netloc"].alias("netloc"),
                                 h["path"].alias("path")))
            .otherwise(F.struct(eff_scheme.alias("scheme"), netloc.alias("netloc"), path.alias("path"))))


def resolve_link_rfc(link, page_url) -> Column:
    """URL9: struct(scheme, netloc, path) of a link on a page, RFC 3986 join
    when the link has no network location, then params, query and fragment
    dropped."""
    return bind(split_url(link), lambda h: bind(split_url(page_url), lambda b: join_split(h, b)))


def unsplit(scheme: Column, netloc: Column, path: Column) -> Column:
    """URL text of (scheme, netloc, path) the way the URL library writes it."""
    p = F.when((netloc != "") & (path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    body = (F.when(netloc != "", F.concat(F.lit("//"), netloc, p))
            .when(path.startswith("//"), F.concat(F.lit("//"), path))
            .when((scheme != "") & scheme.isin(*USES_NETLOC) & ((path == "") | path.startswith("/")),
                  F.concat(F.lit("//"), path))
            .otherwise(path))
    return F.when(scheme != "", F.concat(scheme, F.lit(":"), body)).otherwise(body)


def resolve_link_rfc_url(link, page_url) -> Column:
    """URL9 as text (``scheme://netloc/path``)."""
    return bind(resolve_link_rfc(link, page_url), lambda r: unsplit(r["scheme"], r["netloc"], r["path"]))


def local_path(url) -> Column:
    """URL13: ``netloc/path`` as a relative file path; ``index.html`` appended
    when the last path segment has no dot."""
    def build(s):
        netloc, path = s["netloc"], s["path"]
        stripped = F.regexp_replace(path, r"^/+", "")
        joined = (F.when(netloc == "", stripped)
                  .when(netloc.endswith("/"), F.concat(netloc, stripped))
                  .otherwise(F.concat(netloc, F.lit("/"), stripped)))
        last = F.regexp_extract(path, r"(?s)(/[^/]*|^[^/]*)$", 0)
        return bind(joined, lambda j: F.when(last.contains("."), j)
                    .when(j == "", F.lit(INDEX_FILE))
                    .when(j.endswith("/"), F.concat(j, F.lit(INDEX_FILE)))
                    .otherwise(F.concat(j, F.lit("/" + INDEX_FILE))))
    return bind(split_url(url), build)


def _norm_segments(p: Column) -> Column:
    segs = F.filter(F.split(p, "/", -1), lambda s: (s != "") & (s != "."))
    return F.aggregate(
        segs, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, s)))


def file_dir(p) -> Column:
    """Directory of a file path: trailing '/' removed, then up to the last '/'
    (NULL when there is none)."""
    t = F.regexp_replace(_c(p), r"/+$", "")
    return F.when(t.contains("/"), F.regexp_extract(t, r"(?s)^(.*)/", 1))


def relative_path_min(from_page, to_path) -> Column:
    """URL11: shortest relative path from the directory of the local file
    ``from_page`` to the local path ``to_path`` (common prefix removed,
    '.' when equal); NULL when ``from_page`` has no directory."""
    def rel(s, p):
        m = F.least(F.size(s), F.size(p))
        eq = F.transform(F.sequence(F.lit(0), F.greatest(m - 1, F.lit(0))), lambda i: F.get(s, i) == F.get(p, i))
        first_diff = F.array_position(eq, False).cast("int")        # 1-based, 0 when none
        k = F.when(m == 0, F.lit(0)).when(first_diff == 0, m).otherwise(first_diff - 1)
        return bind(k, lambda kk: F.array_join(F.concat(
            F.array_repeat(F.lit(".."), F.size(s) - kk),
            F.slice(p, kk + 1, F.greatest(F.size(p) - kk, F.lit(0)))), "/"))

    def go(d):
        out = bind(_norm_segments(d), lambda s: bind(_norm_segments(_c(to_path)), lambda p: rel(s, p)))
        return F.when(d.isNull(), F.lit(None)).otherwise(bind(out, lambda o: F.when(o == "", F.lit(".")).otherwise(o)))
    return bind(file_dir(from_page), go)
