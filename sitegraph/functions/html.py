"""HTML tag tokens and attribute columns.

Lexical mode (LNK1) follows the byte scanner of the reference: a tag whose
name *starts with* ``a``/``link`` (attribute ``href="…"``) or ``img``/``script``
(attribute ``src="…"``); double quotes only; case-sensitive; empty values are
ignored and the last non-empty value wins; ``type="…"`` is captured the same
way.  A tag with no link value gives no row.  Tags may be of any length.

DOM mode (LNK2) is the tag set of the page-saving tool: ``iframe[src]``,
``a[href]``, ``img[src]``, ``script[src]`` and stylesheet/icon ``link[href]``,
case-insensitive, any quoting, with comments and ``script``/``style`` bodies
removed first.
"""

from __future__ import annotations

import functools
import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values of the lexical scanner.
HREF_TAGS = ("a", "link")
# ---------------------------------------------------------------------------

# A tag that holds its link attribute, by class of tags.  Possessive groups iterate, they
# do not recurse.
def _tag_with(names: str, attr: str) -> str:
    return (f'<(?:{names})(?:type="[^"]*+"|(?!{attr}=")[^>])*+{attr}="[^"]*+"'
            f'(?:{attr}="[^"]*+"|type="[^"]*+"|[^>])*+>')


_HREF_TAG, _SRC_TAG = _tag_with("a|link", "href"), _tag_with("img|script", "src")


def _tag_without(names: str, other_names: str, other_tag: str) -> str:
    """What a tag without its link attribute makes it needless to look at: no tag of its
    class that starts before the next ``>`` has one either.  It ends before a tag of
    the other class that has, and before a quoted value in which a tag starts, so each part
    of a page is looked at a fixed number of times, however many tags start there."""
    return (f'<(?:{names})(?:type="[^"<]*+"|(?!type="|<(?:{other_names}))[^>])*+'
            f'(?:(?={other_tag})|(?:type="[^"<]*+"|(?!type=")[^>])*+)')


_LEXICAL_START = "<(?:a|link|img|script)"
# Never ends with ">" unless the tag holds its link attribute.
LEXICAL_TOKEN = (f"(?:{_HREF_TAG}|{_SRC_TAG}|{_tag_without('a|link', 'img|script', _SRC_TAG)}"
                 f"|{_tag_without('img|script', 'a|link', _HREF_TAG)})")
_LEXICAL_GAP = "(?:[^<]++|<(?!a|link|img|script))*+"
_HREF_ATTRS = r'(href|type)="([^"]*)"'
_SRC_ATTRS = r'(src|type)="([^"]*)"'


def lexical_tokens(html) -> Column:
    """All link-bearing tags of a page, in document order."""
    h = F.col(html) if isinstance(html, str) else html
    return F.filter(F.regexp_extract_all(h, F.lit(LEXICAL_TOKEN), 0), lambda t: t.endswith(">"))


def lexical_pieces(html) -> Column:
    """The page cut up by one scan: array<struct<gap, token>>, each the text up to a tag and
    the tag ('' at the end).  A token that does not end with ``>`` bears no link."""
    return _cut_up(html, _LEXICAL_GAP, LEXICAL_TOKEN)


def _cut_up(html, gap: str, token: str) -> Column:
    from sitegraph.functions.urls import bind
    h = F.col(html) if isinstance(html, str) else html

    def cut(piece):
        return bind(F.regexp_extract(piece, f"(?is)^{gap}" if token == DOM_TOKEN else f"(?s)^{gap}", 0), lambda g: F.struct(
            g.alias("gap"), F.substring(piece, F.length(g) + 1, F.length(piece)).alias("token")))
    flags = "(?is)" if token == DOM_TOKEN else "(?s)"
    return F.transform(F.regexp_extract_all(h, F.lit(f"{flags}{gap}{token}?+"), 0), cut)


def token_tag(token) -> Column:
    """Normalized tag name: the first of a/link/img/script the tag starts with."""
    return F.regexp_extract(token, r"^<(a|link|img|script)", 1)


def _last_value(token: Column, tag: Column, want_type: bool) -> Column:
    is_href = tag.isin(*HREF_TAGS)
    names = F.when(is_href, F.regexp_extract_all(token, F.lit(_HREF_ATTRS), 1)) \
        .otherwise(F.regexp_extract_all(token, F.lit(_SRC_ATTRS), 1))
    vals = F.when(is_href, F.regexp_extract_all(token, F.lit(_HREF_ATTRS), 2)) \
        .otherwise(F.regexp_extract_all(token, F.lit(_SRC_ATTRS), 2))
    if want_type:
        keep = F.filter(vals, lambda v, i: (F.get(names, i) == "type") & (v != ""))
    else:
        keep = F.filter(vals, lambda v, i: (F.get(names, i) != "type") & (v != ""))
    return F.try_element_at(keep, F.lit(-1))


def token_link(token, tag) -> Column:
    """Last non-empty href/src value of a token, NULL if none."""
    return _last_value(token, tag, want_type=False)


def token_type(token, tag) -> Column:
    """Last non-empty type value of a token, NULL if none."""
    return _last_value(token, tag, want_type=True)


def lexical_links(html) -> Column:
    """array<struct<tag, raw_link, type_attr>> of the link-bearing tags of a
    page in document order; tags without a non-empty link are left out."""
    def rec(t):
        tag = token_tag(t)
        return F.struct(tag.alias("tag"), token_link(t, tag).alias("raw_link"),
                        token_type(t, tag).alias("type_attr"))
    return F.filter(F.transform(lexical_tokens(html), rec), lambda r: r["raw_link"].isNotNull())


# --- DOM mode ---------------------------------------------------------------

# Quoted text and the rest of a tag; groups are possessive: they iterate and never come
# back, so a long tag cannot exhaust the stack.
_QUOTED = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
# The same, up to the end of the tag or of the page: what never ends takes the rest of the
# page (as HTML has it), so nothing is looked at twice.
_TO_END = r"""(?:[^>"']++|"[^"]*+(?:"|\z)|'[^']*+(?:'|\z))*+(?:>|\z)"""
# One scan of the page: comments and script/style elements are consumed whole (their
# bodies hold no tags, and only their own end tag ends them), the link-bearing start
# tags are tokens.
_DOM_START = r"<(?=!--|(?:script|style)\b|(?:iframe|a|img|link)[\s/>])"
DOM_TOKEN = (r"(?:<!--(?:.*?-->|.*+)"
             r"|<script\b" + _TO_END + r"(?:.*?</script\s*+>|.*+)"
             r"|<style\b" + _TO_END + r"(?:.*?</style\s*+>|.*+)"
             r"|<(?:iframe|a|img|link)(?=[\s/>])" + _TO_END + ")")
DOM_SCAN = "(?is)" + DOM_TOKEN
_DOM_GAP = "(?:[^<]++|<(?!" + _DOM_START[4:] + ")*+"
_START_TAG = r"(?is)^<\w++" + _QUOTED + r">"
# What follows the tag name, cut into attributes with what stands before them; the
# pieces make up the whole.
_PIECE = r"""(?is)[\s/="'>]*+(?:([^\s=>"'/]++)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"']*+)|[^\s=>"'/]++)|[\s/="'>]++"""
_ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def dom_scan(html) -> Column:
    h = F.col(html) if isinstance(html, str) else html
    return F.regexp_extract_all(h, F.lit(DOM_SCAN), 0)


def dom_cut(html) -> Column:
    """The page cut up by one scan: array<struct<gap, token>>."""
    return _cut_up(html, _DOM_GAP, DOM_TOKEN)


def dom_start_tag(token: Column) -> Column:
    """The start tag of a token ('' for comments)."""
    return F.when(token.startswith("<!--"), F.lit("")).otherwise(F.regexp_extract(token, _START_TAG, 0))


def dom_tag_name(token: Column) -> Column:
    return F.when(token.startswith("<!--"), F.lit("")).otherwise(F.lower(F.regexp_extract(token, r"^<(\w+)", 1)))


_ENTITY_BUCKETS = 1024


def _bucket(name):
    """A number for a name of at least two letters, the same in Python and in Spark."""
    if isinstance(name, str):
        return (ord(name[0]) * 37 + ord(name[1]) * 11 + ord(name[-1]) * 5 + len(name)) % _ENTITY_BUCKETS
    codes = [F.ascii(F.substring(name, k, 1)) for k in (1, 2, -1)]
    return (codes[0] * 37 + codes[1] * 11 + codes[2] * 5 + F.length(name)) % _ENTITY_BUCKETS


@functools.cache
def _entity_table() -> str:
    buckets: list[dict[str, str]] = [{} for _ in range(_ENTITY_BUCKETS)]
    for k, v in html5.items():
        if k.endswith(";"):
            buckets[_bucket(k[:-1])][k[:-1]] = v
    return json.dumps(buckets)


def _named_entities() -> Column:
    """Text of the named character references of HTML, from the standard library: small maps
    by name, in an array by number, so that a lookup compares a few names only."""
    return F.from_json(F.lit(_entity_table()), "array<map<string,string>>")


def decode_entities(value: Column) -> Column:
    """Character references of an attribute value decoded in one pass: decimal,
    hexadecimal and named ones (unknown names stay; numbers that are no character
    become U+FFFD)."""
    from sitegraph.functions.urls import bind

    def number(text):
        code = F.when(F.lower(F.substring(text, 3, 1)) == "x",
                      F.conv(F.substring(text, 4, F.length(text) - 4), 16, 10)) \
            .otherwise(F.substring(text, 3, F.length(text) - 3)).try_cast("bigint")
        valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")

    def one(text):
        name = F.substring(text, 2, F.length(text) - 2)
        named = F.try_element_at(F.get(_named_entities(), _bucket(name)), name)
        return F.when(F.substring(text, 2, 1) == "#", number(text)).otherwise(F.coalesce(named, text))

    pieces = F.split(value, _ENTITY, -1)
    decoded = F.transform(F.regexp_extract_all(value, F.lit(_ENTITY), 0), one)
    joined = F.array_join(F.zip_with(pieces, decoded, lambda p, d: F.concat(p, F.coalesce(d, F.lit("")))), "")
    return F.when(F.contains(value, F.lit("&")), joined).otherwise(value)


def dom_pieces(start_tag: Column) -> Column:
    """struct(head, pieces, names, written, values): the tag cut up; ``names`` has the
    lower-cased attribute name of each piece with a value ('' for others), ``written`` the
    value as it stands there, ``values`` without quotes and with character references decoded."""
    from sitegraph.functions.urls import bind

    def value(raw):
        quoted = raw.startswith('"') | raw.startswith("'")
        return decode_entities(F.when(quoted, F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw))

    def cut(rest):
        written = F.regexp_extract_all(rest, F.lit(_PIECE), 2)
        return F.struct(F.regexp_extract(start_tag, r"^<\w+", 0).alias("head"),
                        F.regexp_extract_all(rest, F.lit(_PIECE), 0).alias("pieces"),
                        F.transform(F.regexp_extract_all(rest, F.lit(_PIECE), 1), F.lower).alias("names"),
                        written.alias("written"), F.transform(written, value).alias("values"))
    return bind(F.regexp_replace(start_tag, r"^<\w+", ""), cut)


def _last_place(cut: Column, name: str) -> Column:
    """1-based place of the last piece with this attribute, 0 if none."""
    from_end = F.array_position(F.reverse(cut["names"]), name)
    return F.when(from_end > 0, F.size(cut["names"]) + 1 - from_end).otherwise(0).cast("int")


def dom_attr(cut: Column, name: str) -> Column:
    """Value of the last attribute ``name`` (any quoting) of a tag cut up by
    ``dom_pieces``, character references decoded; NULL if absent."""
    return F.get(cut["values"], _last_place(cut, name) - 1)


def dom_around(cut: Column, name: str) -> Column:
    """struct(before, old): the tag up to the value of its last attribute ``name``,
    and that value as it is written, quotes included."""
    from sitegraph.functions.urls import bind

    def at(place):
        piece, old = F.element_at(cut["pieces"], place), F.element_at(cut["written"], place)
        lead = F.substring(piece, F.lit(1), F.length(piece) - F.length(old))
        return F.struct(F.concat(cut["head"], F.array_join(F.slice(cut["pieces"], 1, place - 1), ""), lead).alias("before"),
                        old.alias("old"))
    return bind(_last_place(cut, name), lambda place: F.when(place > 0, at(F.greatest(place, F.lit(1)))))


def dom_link(token: Column) -> Column:
    """struct(tag, raw_link, type_attr) of a scan token; raw_link NULL when
    the token holds no link of the DOM tag set."""
    from sitegraph.functions.urls import bind
    return bind(dom_pieces(dom_start_tag(token)), lambda cut: dom_link_of(dom_tag_name(token), cut))


#: the tags that can hold a link
DOM_TAGS = ("iframe", "a", "img", "script", "link")


def dom_links(html) -> Column:
    """array<struct(tag, raw_link, type_attr)>: the links of the DOM tag set in document order.
    Only tags that can hold one are taken apart.  Bind it, if it is used more than once."""
    tokens = F.filter(dom_scan(html), lambda t: dom_tag_name(t).isin(*DOM_TAGS))
    return F.filter(F.transform(tokens, dom_link), lambda r: r["raw_link"].isNotNull())


def dom_link_of(tag_name: Column, cut: Column) -> Column:
    from sitegraph.functions.urls import bind

    def from_tag(tag):
        attr = F.when(tag.isin("a", "link"), dom_attr(cut, "href")) \
            .when(tag.isin("iframe", "img", "script"), dom_attr(cut, "src"))

        def decide(a, ty):
            rel = dom_attr(cut, "rel")
            css_ok = (F.coalesce(ty == "text/css", F.lit(False)) | F.coalesce(a.endswith(".css"), F.lit(False))
                      | F.coalesce(F.trim(rel) == "icon", F.lit(False)))
            ok = a.isNotNull() & (a != "") & tag.isin("iframe", "a", "img", "script", "link") \
                & ((tag != "link") | css_ok)
            return F.struct(tag.alias("tag"), F.when(ok, a).alias("raw_link"), ty.alias("type_attr"))
        return bind(F.struct(attr.alias("a"), dom_attr(cut, "type").alias("t")), lambda x: decide(x["a"], x["t"]))

    return bind(tag_name, from_tag)
