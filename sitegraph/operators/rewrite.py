"""Link rewriting for offline archives (RW1, RW2).

One scan cuts the page into tags and the text before each ("gaps"); only the link
value inside a tag changes, every other byte is kept.  The pieces are joined
again in the same projection: no shuffle, no row leaves its partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegraph.functions import html as H
from sitegraph.functions import rfc as RFC
from sitegraph.functions import urls as U
from sitegraph.functions.urls import bind


def _rewrite_token(t: Column, hp: Column) -> Column:
    """``hp``: struct(pb = page_base(hint), up = '../' * dir_count(dirname(hint)))."""
    def with_link(tag, link):
        prefix = F.when(tag.isin(*H.HREF_TAGS), F.regexp_extract(t, r'(?s)^(.*href=")[^"]+"', 1)) \
            .otherwise(F.regexp_extract(t, r'(?s)^(.*src=")[^"]+"', 1))
        target = F.concat(hp["up"], U.host_path(U.resolve_with_base(link, hp["pb"])))
        new = bind(prefix, lambda pre: F.concat(pre, target,
                                                F.substring(t, F.length(pre) + F.length(link) + 1, F.length(t))))
        return F.when(link.isNull() | link.startswith("../"), t).otherwise(new)

    return bind(H.token_tag(t), lambda tag: bind(H.token_link(t, tag), lambda link: with_link(tag, link)))


def rewrite_html(html, hint) -> Column:
    """RW1 as a column: every link value -> ``relative_path(dirname(hint),
    host_path(resolve_link(link, hint)))``; values starting ``../`` untouched.
    Everything that depends on the hint only is computed once per page."""
    h = F.col(html) if isinstance(html, str) else html
    hint = F.col(hint) if isinstance(hint, str) else hint
    per_page = F.struct(U.page_base(hint).alias("pb"), U.relative_path(U.dirname(hint), F.lit("")).alias("up"))
    def piece(hp):
        return lambda x: F.concat(x["gap"], F.when(x["token"].endswith(">"), _rewrite_token(x["token"], hp))
                                  .otherwise(x["token"]))
    return F.array_join(bind(per_page, lambda hp: F.transform(H.lexical_pieces(h), piece(hp))), "")


def archive_hint(url) -> Column:
    """Path hint of a saved page, as the archiving run passes it: ``./`` + save path."""
    return F.concat(F.lit("./"), U.save_path(url, "HTML"))


def rewrite_links(pages: DataFrame, html_col: str = "html", hint_col: str | None = None,
                  url_col: str = "url", out: str = "html") -> DataFrame:
    """RW1 over a table of pages; the hint defaults to the page's archive path."""
    hint = F.col(hint_col) if hint_col else archive_hint(url_col)
    return pages.withColumn(out, rewrite_html(F.col(html_col), hint))


# --- DOM mode ---------------------------------------------------------------

def _dom_rewrite_token(t: Column, page: Column) -> Column:
    """``page``: struct(split = split_url(page_url), local = local_path(page_url))."""
    def with_rec(rec, cut):
        tag, value = rec["tag"], rec["raw_link"]

        def with_target(target):
            place = F.when(tag.isin("a", "link"), H.dom_around(cut, "href")).otherwise(H.dom_around(cut, "src"))
            quoted = F.concat(F.lit('"'), F.replace(F.replace(target, F.lit("&"), F.lit("&amp;")),
                                                    F.lit('"'), F.lit("&quot;")), F.lit('"'))
            new = bind(place, lambda x: F.concat(x["before"], quoted, F.substring(
                t, F.length(x["before"]) + F.length(x["old"]) + 1, F.length(t))))
            return F.when(value.isNotNull() & target.isNotNull(), new).otherwise(t)

        joined = bind(RFC.split_url(value), lambda hh: RFC.join_split(hh, page["split"]))
        tgt_url = bind(joined, lambda r: RFC.unsplit(r["scheme"], r["netloc"], r["path"]))
        new = bind(RFC.relative_path_min(page["local"], RFC.local_path(tgt_url)), with_target)
        return F.when(value.isNull(), t).otherwise(new)

    new = bind(H.dom_pieces(H.dom_start_tag(t)),
               lambda cut: bind(H.dom_link_of(H.dom_tag_name(t), cut), lambda rec: with_rec(rec, cut)))
    return F.when(H.dom_tag_name(t).isin(*H.DOM_TAGS), new).otherwise(t)  # other tags are not taken apart


def rewrite_html_dom(html, page_url) -> Column:
    """RW2 as a column: every DOM-mode link value -> shortest relative path
    between the local paths of the page and of its target.  Only attribute
    values change; the markup is not re-serialised.  The page URL is split
    and its local path computed once per page."""
    h = F.col(html) if isinstance(html, str) else html
    u = F.col(page_url) if isinstance(page_url, str) else page_url
    page = F.struct(RFC.split_url(u).alias("split"), RFC.local_path(u).alias("local"))
    def piece(pg):
        return lambda x: F.concat(x["gap"], _dom_rewrite_token(x["token"], pg))
    return F.array_join(bind(page, lambda pg: F.transform(H.dom_cut(h), piece(pg))), "")


def rewrite_links_dom(pages: DataFrame, html_col: str = "html", url_col: str = "url",
                      out: str = "html") -> DataFrame:
    """RW2 over a table of pages."""
    return pages.withColumn(out, rewrite_html_dom(html_col, url_col))
