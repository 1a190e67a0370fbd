"""URL column functions (lexical "C mode" rules).

Each function takes Columns (or column names) and returns a Column built only
from Spark built-ins, so it stays inside Catalyst: it can be pushed, pruned,
code-generated and reused from SQL (see ``sql_udfs``).

A URL is read as ``protocol host path``: the protocol keeps its ``://``, the
host stops at ``/`` or ``:`` (no port), the path runs to the first of the end
characters below.  Query and fragment are never part of any piece.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the reference behaviour for equal results.
# Characters that end the main part of a URL: dollar, question mark, hash,
# newline, carriage return, space.
URL_END_CLASS = r"$?#\r\n "
# Printed link type names, in the order of the enumeration.
LINK_TYPES = ("NO", "HTML", "IMAGE", "STYLE", "SCRIPT")
# Types saved as plain files (never get an index.html appended).
RESOURCE_TYPES = ("IMAGE", "STYLE", "SCRIPT")
# Types saved as directory pages.
PAGE_TYPES = ("HTML", "NO")
INDEX_SUFFIX = "/index.html"
# Path suffixes that decide a link type when tag and type attribute do not.
IMAGE_SUFFIXES = (".png", ".jpg", ".svg")
STYLE_SUFFIXES = (".css",)
SCRIPT_SUFFIXES = (".js",)
# ---------------------------------------------------------------------------

_MAIN_RE = rf"^[^{URL_END_CLASS}]*"
_PROTO_RE = rf"^([^{URL_END_CLASS}]*?://)"
_REST_RE = rf"^(?:[^{URL_END_CLASS}]*?://)?([^{URL_END_CLASS}]*)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def url_main(url) -> Column:
    """The URL up to the first end character."""
    return F.regexp_extract(_c(url), _MAIN_RE, 0)


def url_protocol(url) -> Column:
    """``scheme://`` of the first ``://`` before any end character, else ''."""
    return F.regexp_extract(_c(url), _PROTO_RE, 1)


def url_rest(url) -> Column:
    """Main part of the URL after the protocol: host[:port][/path]."""
    return F.regexp_extract(_c(url), _REST_RE, 1)


def url_host(url) -> Column:
    """Host: up to ``/`` or ``:``; a URL with neither protocol nor ``/`` is all host."""
    url = _c(url)
    rest = url_rest(url)
    return (F.when((url_protocol(url) != "") | (F.instr(rest, "/") > 0),
                   F.regexp_extract(rest, r"^[^/:]*", 0))
            .otherwise(rest))


def url_path(url) -> Column:
    """Path from the first ``/`` after the host to the first end character."""
    return F.regexp_extract(url_rest(url), r"(?s)^[^/]*(/.*)$", 1)


def url_parts(url) -> Column:
    """URL1: struct(protocol, host, path)."""
    url = _c(url)
    return F.struct(url_protocol(url).alias("protocol"),
                    url_host(url).alias("host"),
                    url_path(url).alias("path"))


def link_form(link) -> Column:
    """URL2: 'http' (starts with http), 'absolute' (starts with /) or 'relative'."""
    link = _c(link)
    return (F.when(link.startswith("http"), F.lit("http"))
            .when(link.startswith("/"), F.lit("absolute"))
            .otherwise(F.lit("relative")))


def last_segment(url) -> Column:
    """Everything after the last ``/`` of the raw string (query included)."""
    return F.regexp_extract(_c(url), r"(?s)[^/]*\z", 0)


def is_file_url(url, link_type="HTML") -> Column:
    """URL3: does the URL name a file rather than a directory page."""
    url = _c(url)
    lt = _lit(link_type)
    return (F.when(url.endswith("/"), F.lit(False))
            .when(lt.isin(*RESOURCE_TYPES), F.lit(True))
            .when(url_path(url) == "", F.lit(False))
            .otherwise(last_segment(url).rlike(r"\.[A-Za-z]")))


def rstrip_slash(x) -> Column:
    """Remove one trailing ``/``."""
    return F.regexp_replace(_c(x), r"/\z", "")


def host_path(url) -> Column:
    """URL4: host and path without protocol, query, fragment and one trailing ``/``."""
    url = _c(url)
    return rstrip_slash(F.when(url_path(url) == "", url_host(url)).otherwise(url_rest(url)))


def dirname(path) -> Column:
    """URL5: prefix up to and including the last ``/`` (a ``/`` at index 0 alone gives '')."""
    path = _c(path)
    return (F.when(path.endswith("/"), path)
            .otherwise(F.regexp_extract(path, r"(?s)^(.+/)", 1)))


def url_dirname(url) -> Column:
    """URL5: dirname of the raw URL when it has a path, else the URL itself."""
    url = _c(url)
    return F.when(url_path(url) != "", dirname(url)).otherwise(url)


def dir_count(path) -> Column:
    """URL6: number of directory levels a relative path descends.

    Every ``/`` after the first character counts one, except a ``/`` closing a
    ``.`` segment (not counted) or a ``..`` segment (counts minus one); a final
    file name counts one.
    """
    p = _c(path)
    slashes = F.length(p) - F.length(F.regexp_replace(p, "/", ""))
    first = F.when(p.startswith("/"), 1).otherwise(0)
    dot_dirs = F.regexp_count(p, F.lit(r"(?<=/\.)/"))
    lead_dot = F.when(p.startswith("./"), 1).otherwise(0)
    up_dirs = F.regexp_count(p, F.lit(r"(?<=\.\.)/"))
    file_part = F.when(p.endswith("/"), 0).otherwise(1)
    n = slashes - first - dot_dirs - lead_dot - 2 * up_dirs + file_part
    return F.when(p == "", F.lit(0)).otherwise(n)


def normalize_path(path) -> Column:
    """URL7: split on ``/`` and ``\\``, drop empty and ``.``, ``..`` pops, keep
    a leading and a trailing ``/``."""
    p = _c(path)
    segs = F.filter(F.split(p, r"[/\\]"), lambda s: (s != "") & (s != "."))
    stack = F.aggregate(
        segs, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, s)))
    body = F.concat(F.when(p.startswith("/"), F.lit("/")).otherwise(F.lit("")),
                    F.array_join(stack, "/"),
                    F.when(p.endswith("/"), F.lit("/")).otherwise(F.lit("")))
    return F.when(p == "/", F.lit("/")).otherwise(body)


def page_base(page_url) -> Column:
    """The page-dependent half of URL8, computed once per page:
    struct(proto, host, base_proto, base_hp) where base is the page's
    directory when the page is a file URL, else the page itself."""
    def with_page(page):
        base = F.when(is_file_url(page, "HTML"), url_dirname(page)).otherwise(page)
        return bind(base, lambda b: F.struct(
            url_protocol(page).alias("proto"), url_host(page).alias("host"),
            url_protocol(b).alias("base_proto"), F.concat(url_host(b), url_path(b)).alias("base_hp")))
    return bind(F.regexp_replace(_c(page_url), r"^\./", ""), with_page)


def resolve_with_base(link, pb: Column) -> Column:
    """The link-dependent half of URL8, given ``page_base`` of the page."""
    link = _c(link)
    hp = pb["base_hp"]
    rel_full = F.concat(hp, F.when(hp.endswith("/"), F.lit("")).otherwise(F.lit("/")), link)
    abs_full = F.concat(pb["host"], link)
    is_abs = link.startswith("/")
    full = F.when(is_abs, abs_full).otherwise(rel_full)
    proto = F.when(is_abs, pb["proto"]).otherwise(pb["base_proto"])
    return F.when(link.startswith("http"), link).otherwise(F.concat(proto, normalize_path(full)))


def resolve_link(link, page_url) -> Column:
    """URL8: full URL a link on ``page_url`` points to.

    http links are kept verbatim; ``/x`` is joined to the page's host;
    anything else to the page's directory (the page itself when it is not a
    file URL).  The joined host+path is normalized (URL7) and the page's
    protocol put in front.  For many links of one page, bind ``page_base``
    once and call ``resolve_with_base`` per link.
    """
    return bind(page_base(page_url), lambda pb: resolve_with_base(link, pb))


def relative_path(path_from, path_to) -> Column:
    """URL10: ``'../' * dir_count(from) + to`` (always climbs to the root)."""
    f = _c(path_from)
    n = F.when(f == "", F.lit(0)).otherwise(dir_count(f))
    return F.concat(F.repeat(F.lit("../"), n), _c(path_to))


def save_path(url, link_type="HTML") -> Column:
    """URL12: archive path; page types get ``/index.html`` unless already there."""
    hp = host_path(url)
    lt = _lit(link_type)
    return (F.when(lt.isin(*PAGE_TYPES) & ~hp.endswith(INDEX_SUFFIX), F.concat(hp, F.lit(INDEX_SUFFIX)))
            .otherwise(hp))


def page_key(url) -> Column:
    """URL14 (C mode): identity of a page = its save path as an HTML page."""
    return save_path(url, "HTML")


def link_type(tag, link, type_attr) -> Column:
    """LNK3: HTML / IMAGE / STYLE / SCRIPT / NO from tag, type attribute, path suffix."""
    tag, link, ty = _c(tag), _c(link), _c(type_attr)
    main = F.when(url_path(link) != "", url_main(link)).otherwise(
        F.concat(url_protocol(link), url_host(link)))

    def ends(*sfx):
        cond = F.lit(False)
        for s in sfx:
            cond = cond | main.endswith(s)
        return cond

    return (F.when(tag.startswith("a"), F.lit("HTML"))
            .when(tag.startswith("img"), F.lit("IMAGE"))
            .when(tag.startswith("script"), F.lit("SCRIPT"))
            .when(F.coalesce(ty.startswith("text/css"), F.lit(False)), F.lit("STYLE"))
            .when(F.coalesce(ty.startswith("image/"), F.lit(False)), F.lit("IMAGE"))
            .when(F.coalesce(ty.startswith("text/javascript"), F.lit(False)), F.lit("SCRIPT"))
            .when(ends(*IMAGE_SUFFIXES), F.lit("IMAGE"))
            .when(ends(*STYLE_SUFFIXES), F.lit("STYLE"))
            .when(ends(*SCRIPT_SUFFIXES), F.lit("SCRIPT"))
            .otherwise(F.lit("NO")))


def in_scope(url, page_url, scope: str = "same", dot_boundary: bool = False) -> Column:
    """FLT1: 'none' keeps all; 'same' needs equal hosts; 'subdomain' needs the
    link host to end with the page host (no dot boundary unless asked)."""
    if scope == "none":
        return F.lit(True)
    h, ph = url_host(url), url_host(page_url)
    if scope == "same":
        return h == ph
    if scope == "subdomain":
        if dot_boundary:
            return (h == ph) | h.endswith(F.concat(F.lit("."), ph))
        return h.endswith(ph)
    raise ValueError(f"unknown scope {scope!r}")


# --- HTTP header columns (URL15, URL16) -------------------------------------

def http_status(headers) -> Column:
    """URL16: status number of ``HTTP/x.y N``; NULL when it cannot be read."""
    code = F.regexp_extract(_c(headers), r"^HTTP/\s*[-+]?[0-9]+\.\s*[-+]?[0-9]+\s*([-+]?[0-9]+)", 1)
    return code.try_cast("int")  # none, or one too large to be a status: NULL


def outcome(status) -> Column:
    """URL16: ok / redirect / throttled / parse_error / error."""
    s = _c(status)
    return (F.when(s.isNull() | (s == 0), F.lit("parse_error"))
            .when(s == 200, F.lit("ok"))
            .when(s.isin(301, 302), F.lit("redirect"))
            .when(s == 429, F.lit("throttled"))
            .otherwise(F.lit("error")))


def is_ok(status) -> Column:
    """URL16, the rule of the page-saving tool: any status below 400 is usable."""
    s = _c(status)
    return F.coalesce((s > 0) & (s < 400), F.lit(False))


def fetch_outcome(cache_status, response_outcome) -> Column:
    """URL16 of a request: ``cached`` when a fresh copy served it, else the response's
    outcome (``unknown`` if there is none)."""
    return F.when(_c(cache_status) == "hit", F.lit("cached")).otherwise(F.coalesce(_c(response_outcome), F.lit("unknown")))


def location_value(headers) -> Column:
    """Raw value of the first ``Location: `` header (else ``location: ``), NULL if none."""
    h = _c(headers)
    return (F.when(h.contains("Location: "), F.regexp_extract(h, r"Location: ([^\r\n ]*)", 1))
            .when(h.contains("location: "), F.regexp_extract(h, r"location: ([^\r\n ]*)", 1)))


def location_url(headers, request_url) -> Column:
    """URL15: Location header resolved against the request URL (URL8)."""
    v = location_value(headers)
    return F.when(v.isNotNull(), resolve_link(v, request_url))


def bind(value: Column, fn) -> Column:
    """Evaluate ``value`` once and pass it to ``fn`` as a lambda variable.

    Large URL rules refer to the same sub-expression many times; binding it
    keeps the expression tree linear in size instead of exponential (Catalyst
    would otherwise analyse every copy).
    """
    return F.transform(F.array(value), fn).getItem(0)
