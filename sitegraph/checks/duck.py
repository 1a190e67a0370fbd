"""DuckDB SQL pieces used by the correctness oracles in ``__spark_entry__``.

They state the same URL rules as ``sitegraph.functions.urls`` in DuckDB's
dialect (RE2 regexes, list lambdas).  Multi-step rules are emitted as lists of
``expr AS alias`` items: DuckDB lets a select list refer to aliases defined
earlier in the same list, so every step is computed once.
"""

from __future__ import annotations

END = r"$?#\r\n "


def protocol(u: str) -> str:
    return f"regexp_extract({u}, '^([^{END}]*?://)', 1)"


def rest(u: str) -> str:
    return f"regexp_extract({u}, '^(?:[^{END}]*?://)?([^{END}]*)', 1)"


def parts(u: str, pre: str) -> list[str]:
    """protocol, rest, host, path of column ``u`` as ``{pre}proto`` etc."""
    return [
        f"{protocol(u)} AS {pre}proto",
        f"{rest(u)} AS {pre}rest",
        f"CASE WHEN {pre}proto <> '' OR strpos({pre}rest, '/') > 0 "
        f"THEN regexp_extract({pre}rest, '^[^/:]*', 0) ELSE {pre}rest END AS {pre}host",
        f"regexp_extract({pre}rest, '(?s)^[^/]*(/.*)$', 1) AS {pre}path",
    ]


def host_path_expr(pre: str) -> str:
    """URL4 from the parts of a URL."""
    return (f"regexp_replace(CASE WHEN {pre}path = '' THEN {pre}host ELSE {pre}rest END, '/\\z', '')")


def save_path_expr(pre: str, link_type: str) -> str:
    hp = host_path_expr(pre)
    return (f"CASE WHEN {link_type} IN ('HTML', 'NO') AND NOT suffix({hp}, '/index.html') "
            f"THEN {hp} || '/index.html' ELSE {hp} END")


def dirname(p: str) -> str:
    return f"CASE WHEN suffix({p}, '/') THEN {p} ELSE regexp_extract({p}, '(?s)^(.+/)', 1) END"


def normalize(p: str) -> str:
    segs = f"list_filter(string_split_regex({p}, '[/\\\\]'), lambda s: s <> '' AND s <> '.')"
    stack = (f"list_reduce({segs}, lambda acc, s: CASE WHEN s = '..' THEN acc[1:len(acc) - 1] "
             f"ELSE list_append(acc, s) END, []::VARCHAR[])")
    return (f"CASE WHEN {p} = '/' THEN '/' ELSE "
            f"(CASE WHEN starts_with({p}, '/') THEN '/' ELSE '' END) || array_to_string({stack}, '/') "
            f"|| (CASE WHEN suffix({p}, '/') THEN '/' ELSE '' END) END")


def dir_count(p: str) -> str:
    """URL6 by looking at every '/' of the string (1-based positions)."""
    per_pos = (f"[CASE WHEN substr({p}, i, 1) <> '/' OR i = 1 THEN 0 "
               f"WHEN i >= 3 AND substr({p}, i - 2, 2) = '/.' THEN 0 "
               f"WHEN i = 2 AND substr({p}, 1, 1) = '.' THEN 0 "
               f"WHEN i >= 3 AND substr({p}, i - 2, 2) = '..' THEN -1 ELSE 1 END "
               f"for i in range(1, length({p}) + 1)]")
    return (f"(CASE WHEN {p} = '' THEN 0 ELSE coalesce(list_sum({per_pos}), 0) "
            f"+ (CASE WHEN suffix({p}, '/') THEN 0 ELSE 1 END) END)::INTEGER")


def relative_path(frm: str, to: str) -> str:
    return f"repeat('../', greatest({dir_count(frm)}, 0)::BIGINT) || {to}"


def resolve(link: str, page: str, out: str, pre: str) -> list[str]:
    """URL8 as select items; the final item is aliased ``out``."""
    return [
        f"regexp_replace({page}, '^\\./', '') AS {pre}page",
        *parts(f"{pre}page", f"{pre}pg_"),
        f"CASE WHEN suffix({pre}page, '/') THEN false WHEN {pre}pg_path = '' THEN false "
        f"ELSE regexp_matches(regexp_extract({pre}page, '(?s)[^/]*\\z', 0), '\\.[A-Za-z]') END AS {pre}isfile",
        f"CASE WHEN {pre}isfile THEN (CASE WHEN {pre}pg_path <> '' THEN {dirname(pre + 'page')} "
        f"ELSE {pre}page END) ELSE {pre}page END AS {pre}base",
        *parts(f"{pre}base", f"{pre}b_"),
        f"CASE WHEN starts_with({link}, '/') THEN {pre}pg_host || {link} "
        f"ELSE {pre}b_host || {pre}b_path || (CASE WHEN suffix({pre}b_host || {pre}b_path, '/') "
        f"THEN '' ELSE '/' END) || {link} END AS {pre}full",
        f"CASE WHEN starts_with({link}, 'http') THEN {link} ELSE "
        f"(CASE WHEN starts_with({link}, '/') THEN {pre}pg_proto ELSE {pre}b_proto END) "
        f"|| {normalize(pre + 'full')} END AS {out}",
    ]


def link_type(tag: str, link: str, ty: str, pre: str) -> list[str]:
    """LNK3 as select items; the final item is ``{pre}type``."""
    main = (f"CASE WHEN {pre}path <> '' THEN regexp_extract({link}, '^[^{END}]*', 0) "
            f"ELSE {pre}proto || {pre}host END")
    return [
        *parts(link, pre),
        f"{main} AS {pre}main",
        f"CASE WHEN starts_with({tag}, 'a') THEN 'HTML' WHEN starts_with({tag}, 'img') THEN 'IMAGE' "
        f"WHEN starts_with({tag}, 'script') THEN 'SCRIPT' "
        f"WHEN coalesce(starts_with({ty}, 'text/css'), false) THEN 'STYLE' "
        f"WHEN coalesce(starts_with({ty}, 'image/'), false) THEN 'IMAGE' "
        f"WHEN coalesce(starts_with({ty}, 'text/javascript'), false) THEN 'SCRIPT' "
        f"WHEN suffix({pre}main, '.png') OR suffix({pre}main, '.jpg') OR suffix({pre}main, '.svg') THEN 'IMAGE' "
        f"WHEN suffix({pre}main, '.css') THEN 'STYLE' WHEN suffix({pre}main, '.js') THEN 'SCRIPT' "
        f"ELSE 'NO' END AS {pre}type",
    ]


def lexical_links(pages: str = "pages", extra: str = "") -> str:
    """LNK1 for well-formed tags (no '>' inside attribute values).

    RE2 has no look-ahead, so a tag is any ``<a…>``, ``<link…>``, ``<img…>``,
    ``<script…>`` and the attribute scan picks the last non-empty value.
    Output columns: page_id, src_url, pos (0-based), tag, raw_link, type_attr.
    """
    return f"""
    SELECT page_id, src_url, (pos - 1)::INTEGER AS pos, rec.tag AS tag, rec.raw_link AS raw_link, rec.type_attr AS type_attr
    FROM (
      SELECT page_id, src_url, unnest(recs) AS rec, generate_subscripts(recs, 1) AS pos
      FROM (
        SELECT page_id, url AS src_url,
          list_filter(list_transform(
            regexp_extract_all(html, '<(?:a|link|img|script)[^>]*>', 0),
            lambda t: {{'tag': regexp_extract(t, '^<(a|link|img|script)', 1),
              'raw_link': list_filter(
                 regexp_extract_all(t, CASE WHEN regexp_matches(t, '^<(a|link)') THEN '(href|type)="([^"]*)"'
                                            ELSE '(src|type)="([^"]*)"' END, 2),
                 lambda v, i: regexp_extract_all(t, CASE WHEN regexp_matches(t, '^<(a|link)')
                                   THEN '(href|type)="([^"]*)"' ELSE '(src|type)="([^"]*)"' END, 1)[i] <> 'type'
                              AND v <> '')[-1],
              'type_attr': list_filter(
                 regexp_extract_all(t, '(?:href|src|type)="([^"]*)"', 1),
                 lambda v, i: regexp_extract_all(t, '(href|src|type)="([^"]*)"', 1)[i] = 'type' AND v <> '')[-1]}}),
            lambda r: r.raw_link IS NOT NULL) AS recs
        FROM {pages} {extra}
      )
    )
    """


def page_links(pages: str = "pages", scope: str = "same") -> str:
    """LNK1 -> URL8 -> FLT1 -> LNK3 (columns page_id, src_url, pos, tag, raw_link,
    type_attr, url, link_type)."""
    sel = ",\n      ".join(resolve("raw_link", "src_url", "url", "r_")
                           + parts("url", "u_") + parts("src_url", "s_")
                           + link_type("tag", "raw_link", "type_attr", "t_"))
    cond = {"none": "true", "same": "u_host = s_host", "subdomain": "suffix(u_host, s_host)"}[scope]
    return f"""
    SELECT page_id, src_url, pos, tag, raw_link, type_attr, url, t_type AS link_type FROM (
      SELECT *,
      {sel}
      FROM ({lexical_links(pages)})
    ) WHERE {cond}
    """


# --- derived tables (same rules as sitegraph.sources.derived) -------------------

def _n(pages: str = "pages") -> str:
    return f"(SELECT count(*) FROM {pages})"


def pages_rich(pages: str = "pages") -> str:
    from sitegraph.sources.derived import RICH_PREFIXES
    k = len(RICH_PREFIXES)
    case = " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(RICH_PREFIXES))
    return (f"SELECT page_id, url, replace(CASE page_id % {k} {case} END, '{{host}}', "
            f"regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) || html AS html FROM {pages}")


def edges(pages: str = "pages") -> str:
    from sitegraph.sources.derived import EDGE_RULES
    arms = " UNION ALL ".join(
        f"SELECT page_id AS src, {i} AS rule, ({a} * page_id + {b}) % {_n(pages)} AS dst FROM {pages}"
        for i, (a, b) in enumerate(EDGE_RULES))
    return (f"SELECT e.src, e.dst, e.rule, s.url AS src_url, d.url AS dst_url FROM ({arms}) e "
            f"JOIN {pages} s ON s.page_id = e.src JOIN {pages} d ON d.page_id = e.dst")


def pages_linked(pages: str = "pages") -> str:
    return (f"SELECT p.page_id, p.url, '<nav>' || '<a href=\"' || e0.dst_url || '\">go</a>' "
            f"|| '<a href=\"' || e1.dst_url || '\">go</a>' || '</nav>' || p.html AS html "
            f"FROM {pages} p JOIN ({edges(pages)}) e0 ON e0.src = p.page_id AND e0.rule = 0 "
            f"JOIN ({edges(pages)}) e1 ON e1.src = p.page_id AND e1.rule = 1")


def archive(pages: str = "pages") -> str:
    from sitegraph.sources.derived import AGE_FACTOR, AGE_SPREAD_MIN, AS_OF
    items = ", ".join(parts("url", "a_"))
    return f"""
    SELECT save_path AS page_key, save_path, arg_max(host, (fetched_at, page_id)) AS host,
           arg_max(body, (fetched_at, page_id)) AS body, max(fetched_at) AS fetched_at
    FROM (
      SELECT page_id, {items}, {save_path_expr('a_', "'HTML'")} AS save_path, a_host AS host, html AS body,
             TIMESTAMP '{AS_OF}' - to_minutes((page_id * {AGE_FACTOR}) % {AGE_SPREAD_MIN}) AS fetched_at
      FROM {pages} WHERE starts_with(url, 'https://')
    ) GROUP BY save_path
    """


def copy_version(pages: str, version: int) -> str:
    from sitegraph.sources.derived import AGE_FACTOR, AGE_SPREAD_MIN, AS_OF
    where = "" if version == 0 else f"WHERE page_id % 3 = {version}"
    return f"""
    SELECT {save_path_expr('a_', "'HTML'")} AS page_key, {save_path_expr('a_', "'HTML'")} AS save_path, a_host AS host,
           'v{version} ' || html AS body,
           TIMESTAMP '{AS_OF}' - to_minutes((page_id * {AGE_FACTOR}) % {AGE_SPREAD_MIN})
             + to_days({(0, 3, -3)[version]}) AS fetched_at
    FROM (SELECT *, {', '.join(parts('url', 'a_'))} FROM {pages} {where})
    """


def merged_archive(pages: str = "pages") -> str:
    """The newest copy per save path of the versions written one after the other."""
    both = " UNION ALL ".join(copy_version(pages, v) for v in range(3))
    newest = "max({'t': fetched_at, 'k': page_key, 'h': host, 'b': body})"
    return (f"SELECT {newest}.k AS page_key, save_path, {newest}.h AS host, {newest}.b AS body, "
            f"{newest}.t AS fetched_at FROM ({both}) GROUP BY save_path")


def requests(pages: str = "pages", events: str = "events") -> str:
    return (f"SELECT e.event_id AS request_id, p.url, CASE WHEN e.event_type = 'error' THEN 'NO' ELSE 'HTML' END "
            f"AS link_type, e.ts::TIMESTAMP AS ts FROM {events} e JOIN {pages} p "
            f"ON p.page_id = e.event_id % {_n(pages)}")


def responses(pages: str = "pages") -> str:
    from sitegraph.sources.derived import AS_OF, BINARY_DIGIT, BINARY_END, BINARY_START, REASONS, STATUS_BY_DIGIT
    st = " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(STATUS_BY_DIGIT))
    rs = " ".join(f"WHEN {c} THEN '{t}'" for c, t in REASONS.items())
    n = _n(pages)
    return f"""
    SELECT b.page_id AS response_id, b.url AS request_url,
           TIMESTAMP '{AS_OF}' - to_minutes(b.page_id) AS ts,
           encode('HTTP/1.1 ' || b.status || ' ' || (CASE b.status {rs} END)
             || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)
             || CASE WHEN t.url IS NOT NULL THEN 'Location: ' || t.url || chr(13) || chr(10) ELSE '' END
             || chr(13) || chr(10))
           || CASE WHEN b.page_id % 10 = {BINARY_DIGIT} THEN unhex('{BINARY_START}') || encode(b.html) || unhex('{BINARY_END}')
                   ELSE encode(b.html) END AS raw
    FROM (
      SELECT page_id, url, html, CASE page_id % 10 {st} END AS status,
             CASE WHEN page_id % 10 = 6 THEN (page_id + 1) % {n}
                  WHEN page_id % 10 = 7 AND page_id % 40 = 7 THEN NULL
                  WHEN page_id % 10 = 7 AND page_id % 20 = 17 THEN (page_id - 1 + {n}) % {n}
                  WHEN page_id % 10 = 7 THEN (page_id + 3) % {n} END AS target
      FROM {pages}
    ) b LEFT JOIN {pages} t ON t.page_id = b.target
    """


# --- helpers for the URL-function oracles -------------------------------------------

def url_inputs(pages: str = "pages") -> str:
    """Every page URL and every raw link of the rich pages, with their page."""
    return (f"SELECT page_id, url AS s FROM {pages} UNION ALL "
            f"SELECT page_id, raw_link AS s FROM ({lexical_links('(' + pages_rich(pages) + ')')})")


def page_resources(pages: str = "pages") -> str:
    """Rich pages and the resources captured beside them."""
    from sitegraph.sources.derived import RESOURCES
    rows = [f"SELECT -page_id - 1 AS page_id, regexp_extract(url, '^[a-z]+://[^/?#:]+', 0) || '{path}' AS url, '{body}' || "
            f"regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS html FROM {pages} WHERE page_id % 6 = {k}"
            for k, (path, body) in RESOURCES.items()]
    return " UNION ALL ".join([f"SELECT page_id, url, html FROM ({pages_rich(pages)})", *rows])


def parsed_responses(pages: str = "pages") -> str:
    """(response_id, request_url, head, body, status, outcome, location)."""
    res = ", ".join(resolve("loc_raw", "request_url", "loc_resolved", "l_"))
    return f"""
    SELECT response_id, request_url, head, body, status, outcome,
           CASE WHEN outcome = 'redirect' AND loc_raw IS NOT NULL THEN loc_resolved END AS location
    FROM (
      SELECT *, {res} FROM (
        SELECT *, CASE WHEN status IS NULL OR status = 0 THEN 'parse_error' WHEN status = 200 THEN 'ok'
                       WHEN status IN (301, 302) THEN 'redirect' WHEN status = 429 THEN 'throttled'
                       ELSE 'error' END AS outcome,
               CASE WHEN strpos(head, 'Location: ') > 0 THEN regexp_extract(head, 'Location: ([^\\r\\n ]*)', 1)
                    WHEN strpos(head, 'location: ') > 0 THEN regexp_extract(head, 'location: ([^\\r\\n ]*)', 1)
                    END AS loc_raw
        FROM (
          SELECT *, TRY_CAST(nullif(regexp_extract(head,
                    '^HTTP/\\s*[-+]?[0-9]+\\.\\s*[-+]?[0-9]+\\s*([-+]?[0-9]+)', 1), '') AS INTEGER) AS status
          FROM (
            SELECT response_id, request_url,
                   decode(unhex(substr(hx, 1, strpos(hx, '0D0A0D0A') - 1))) AS head,
                   unhex(substr(hx, strpos(hx, '0D0A0D0A') + 8)) AS body
            FROM (SELECT response_id, request_url, hex(raw) AS hx FROM ({responses(pages)}))
          )
        )
      )
    )
    """


# --- crawl oracles ---------------------------------------------------------------------

def keyed_link_table(pages: str) -> str:
    """(page_key, raw_link, link_type) of the distinct pages (lowest page_id per key)."""
    keyed = (f"SELECT page_key, arg_min(page_id, page_id) AS page_id, arg_min(url, page_id) AS url, "
             f"arg_min(html, page_id) AS html FROM (SELECT *, {save_path_expr('k_', chr(39) + 'HTML' + chr(39))} "
             f"AS page_key FROM (SELECT *, {', '.join(parts('url', 'k_'))} FROM {pages})) GROUP BY page_key")
    return f"""
    SELECT k.page_key, l.pos, l.raw_link, t_type AS link_type FROM (
      SELECT *, {', '.join(link_type('tag', 'raw_link', 'type_attr', 't_'))} FROM ({lexical_links('(' + keyed + ')')})
    ) l JOIN ({keyed}) k ON k.page_id = l.page_id
    """


def _scope_cond(scope: str, dst_host: str, base_host: str) -> str:
    return {"none": "true", "same": f"{dst_host} = {base_host}",
            "subdomain": f"suffix({dst_host}, {base_host})",
            "subdomain_dot": f"({dst_host} = {base_host} OR suffix({dst_host}, '.' || {base_host}))"}[scope]


def crawl_levels(pages: str, depth: int, scope: str, scope_base: str = "page") -> str:
    """CRL1 oracle: min level of every (seed, url) reachable in ``depth`` hops."""
    lt = keyed_link_table(pages)
    base_col = "seed" if scope_base == "seed" else "url"
    step = f"""
      SELECT seed, dst AS url, level + 1 AS level, link_type = 'HTML' AS is_html FROM (
        SELECT *, {', '.join(resolve('raw_link', 'url', 'dst', 'r_') + parts('dst', 'd_') + parts(base_col, 'b_'))}
        FROM (SELECT w.seed, w.url, w.level, l.raw_link, l.link_type
              FROM (SELECT *, {save_path_expr('w_', chr(39) + 'HTML' + chr(39))} AS pk
                    FROM (SELECT *, {', '.join(parts('url', 'w_'))} FROM walk WHERE is_html AND level < {depth})) w
              JOIN lt l ON l.page_key = w.pk))
      WHERE {_scope_cond(scope, 'd_host', 'b_host')}"""
    return f"""
    WITH RECURSIVE lt AS ({lt}),
    walk(seed, url, level, is_html) AS (
      SELECT url, url, 0, true FROM {pages}
      UNION
      {step}
    )
    SELECT seed, url, min(level) AS level FROM walk GROUP BY seed, url
    """


def crawl_redirected(pages: str, resolved: str, depth: int, scope: str) -> str:
    """CRL1 oracle with redirects: ``crawl_levels``, pages found and links resolved by
    the effective URL of the ``resolved`` statement (every one is a page's)."""
    return f"""
    WITH RECURSIVE lt AS ({keyed_link_table(pages)}),
    eff AS (SELECT url, effective_url FROM ({resolved})),
    walk(seed, url, level, is_html) AS (
      SELECT url, url, 0, true FROM {pages}
      UNION
      SELECT seed, dst AS url, level + 1 AS level, link_type = 'HTML' AS is_html FROM (
        SELECT *, {', '.join(resolve('raw_link', 'base', 'dst', 'r_') + parts('dst', 'd_') + parts('base', 'b_'))}
        FROM (SELECT w.seed, w.base, w.level, l.raw_link, l.link_type
              FROM (SELECT *, {save_path_expr('w_', chr(39) + 'HTML' + chr(39))} AS pk
                    FROM (SELECT *, {', '.join(parts('base', 'w_'))}
                          FROM (SELECT k.seed, k.level, coalesce(e.effective_url, k.url) AS base
                                FROM walk k LEFT JOIN eff e ON e.url = k.url WHERE k.is_html AND k.level < {depth}))) w
              JOIN lt l ON l.page_key = w.pk))
      WHERE {_scope_cond(scope, 'd_host', 'b_host')}
    )
    SELECT seed, url, min(level) AS level FROM walk GROUP BY seed, url
    """


def _based(walk: str, resolved: str | None) -> str:
    """Rows of a walk with ``base``, the URL each leads to."""
    if resolved is None:
        return f"SELECT *, url AS base FROM ({walk})"
    return f"SELECT k.*, coalesce(e.effective_url, k.url) AS base FROM ({walk}) k LEFT JOIN eff e ON e.url = k.url"


def _eff(resolved: str | None) -> str:
    return f"eff AS (SELECT url, effective_url FROM ({resolved}))," if resolved else ""


def crawl_lines(pages: str, depth: int, scope: str, resolved: str | None = None) -> str:
    """CRL2 oracle: walks enumerated (UNION ALL), lines counted per level; with a ``resolved``
    statement pages are found and links resolved by the effective URL (always a page's)."""
    lt = keyed_link_table(pages)

    def expand(where: str) -> str:
        return f"""
        SELECT * FROM (
          SELECT *, {', '.join(resolve('raw_link', 'base', 'dst', 'r_') + parts('dst', 'd_') + parts('base', 'b_'))}
          FROM (SELECT w.seed, w.base, w.level, l.raw_link, l.link_type
                FROM (SELECT *, {save_path_expr('w_', chr(39) + 'HTML' + chr(39))} AS pk
                      FROM (SELECT *, {', '.join(parts('base', 'w_'))}
                            FROM ({_based(f'SELECT * FROM walk {where}', resolved)}))) w
                JOIN lt l ON l.page_key = w.pk))
        WHERE {_scope_cond(scope, 'd_host', 'b_host')}"""
    return f"""
    WITH RECURSIVE lt AS ({lt}), {_eff(resolved)}
    walk(seed, url, level) AS (
      SELECT url, url, 0 FROM {pages}
      UNION ALL
      SELECT seed, dst, level + 1 FROM ({expand(f'WHERE level < {depth - 1}')}) WHERE link_type = 'HTML'
    )
    SELECT seed, level + 1 AS level, link_type, dst AS url, count(*) AS n
    FROM ({expand(f'WHERE level < {depth}')}) GROUP BY seed, level, link_type, dst
    """


# --- RFC mode (URL9, URL11, URL13) ------------------------------------------------------

def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def split_rfc(u: str, p: str) -> list[str]:
    from sitegraph.functions.rfc import USES_PARAMS
    return [
        f"regexp_replace(regexp_replace({u}, '^[\\x00-\\x20]+', ''), '[\\t\\r\\n]', '', 'g') AS {p}u",
        f"lower(regexp_extract({p}u, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)) AS {p}scheme",
        f"CASE WHEN {p}scheme <> '' THEN regexp_replace({p}u, '^[A-Za-z][A-Za-z0-9+.\\-]*:', '') ELSE {p}u END AS {p}rest",
        f"starts_with({p}rest, '//') AS {p}hasnet",
        f"CASE WHEN {p}hasnet THEN regexp_extract({p}rest, '^//([^/?#]*)', 1) ELSE '' END AS {p}netloc",
        f"CASE WHEN {p}hasnet THEN regexp_replace({p}rest, '^//[^/?#]*', '') ELSE {p}rest END AS {p}rest2",
        f"regexp_replace(regexp_replace({p}rest2, '(?s)#.*$', ''), '(?s)\\?.*$', '') AS {p}pathfull",
        f"{p}scheme IN {_in(USES_PARAMS)} AND strpos(regexp_extract({p}pathfull, '(?s)[^/]*$', 0), ';') > 0 "
        f"AS {p}hasparams",
        f"length(regexp_extract({p}pathfull, '(?s)^(.*/)?[^/;]*;', 0)) AS {p}cut",
        f"CASE WHEN {p}hasparams THEN substr({p}pathfull, 1, {p}cut - 1) ELSE {p}pathfull END AS {p}path",
        f"CASE WHEN {p}hasparams THEN substr({p}pathfull, {p}cut + 1) ELSE '' END AS {p}params",
    ]


def resolve_rfc(link: str, page: str, r: str) -> list[str]:
    """URL9 select items: {r}scheme, {r}netloc, {r}path, {r}url."""
    from sitegraph.functions.rfc import USES_NETLOC, USES_RELATIVE
    h, b = r + "h_", r + "b_"
    return [
        *split_rfc(link, h), *split_rfc(page, b),
        f"CASE WHEN {h}scheme <> '' THEN {h}scheme ELSE {b}scheme END AS {r}eff",
        f"{h}netloc <> '' OR {r}eff <> {b}scheme OR {r}eff NOT IN {_in(USES_RELATIVE)} AS {r}own",
        f"CASE WHEN {r}eff IN {_in(USES_NETLOC)} THEN {b}netloc ELSE {h}netloc END AS {r}net",
        f"string_split({b}path, '/') AS {r}bparts",
        f"CASE WHEN {r}bparts[-1] <> '' THEN {r}bparts[1:len({r}bparts) - 1] ELSE {r}bparts END AS {r}bdir",
        f"list_concat({r}bdir, string_split({h}path, '/')) AS {r}rel0",
        f"list_filter({r}rel0, lambda s, i: s <> '' OR i = 1 OR i = len({r}rel0)) AS {r}rel",
        f"CASE WHEN starts_with({h}path, '/') THEN string_split({h}path, '/') ELSE {r}rel END AS {r}segs",
        f"list_reduce({r}segs, lambda acc, s: CASE WHEN s = '..' THEN acc[1:len(acc) - 1] WHEN s = '.' THEN acc "
        f"ELSE list_append(acc, s) END, []::VARCHAR[]) AS {r}stack0",
        f"CASE WHEN {r}segs[-1] IN ('.', '..') THEN list_append({r}stack0, '') ELSE {r}stack0 END AS {r}stack",
        f"CASE WHEN array_to_string({r}stack, '/') = '' THEN '/' ELSE array_to_string({r}stack, '/') END AS {r}joined",
        f"CASE WHEN {h}path = '' AND {h}params = '' THEN {b}path ELSE {r}joined END AS {r}path0",
        f"CASE WHEN {r}net <> '' AND {r}path0 <> '' AND NOT starts_with({r}path0, '/') THEN '/' || {r}path0 "
        f"ELSE {r}path0 END AS {r}path1",
        f"CASE WHEN {r}own THEN {h}scheme ELSE {r}eff END AS {r}scheme",
        f"CASE WHEN {r}own THEN {h}netloc ELSE {r}net END AS {r}netloc",
        f"CASE WHEN {r}own THEN {h}path ELSE {r}path1 END AS {r}path",
        *unsplit(f"{r}scheme", f"{r}netloc", f"{r}path", f"{r}url"),
    ]


def unsplit(s: str, n: str, p: str, out: str) -> list[str]:
    from sitegraph.functions.rfc import USES_NETLOC
    return [
        f"CASE WHEN {n} <> '' AND {p} <> '' AND NOT starts_with({p}, '/') THEN '/' || {p} ELSE {p} END AS {out}_p",
        f"CASE WHEN {n} <> '' THEN '//' || {n} || {out}_p WHEN starts_with({p}, '//') THEN '//' || {p} "
        f"WHEN {s} <> '' AND {s} IN {_in(USES_NETLOC)} AND ({p} = '' OR starts_with({p}, '/')) THEN '//' || {p} "
        f"ELSE {p} END AS {out}_body",
        f"CASE WHEN {s} <> '' THEN {s} || ':' || {out}_body ELSE {out}_body END AS {out}",
    ]


def local_path(u: str, p: str) -> list[str]:
    """URL13 select items; final alias ``{p}local``."""
    return [
        *split_rfc(u, p + "s_"),
        f"regexp_replace({p}s_path, '^/+', '') AS {p}stripped",
        f"CASE WHEN {p}s_netloc = '' THEN {p}stripped WHEN suffix({p}s_netloc, '/') THEN {p}s_netloc || {p}stripped "
        f"ELSE {p}s_netloc || '/' || {p}stripped END AS {p}joined",
        f"CASE WHEN strpos(regexp_extract({p}s_path, '(?s)(/[^/]*|^[^/]*)$', 0), '.') > 0 THEN {p}joined "
        f"WHEN {p}joined = '' THEN 'index.html' WHEN suffix({p}joined, '/') THEN {p}joined || 'index.html' "
        f"ELSE {p}joined || '/index.html' END AS {p}local",
    ]


def _norm_segs(x: str) -> str:
    return (f"list_reduce(list_filter(string_split({x}, '/'), lambda s: s <> '' AND s <> '.'), "
            f"lambda acc, s: CASE WHEN s = '..' THEN acc[1:len(acc) - 1] ELSE list_append(acc, s) END, "
            f"[]::VARCHAR[])")


def relative_path_min(frm: str, to: str, p: str) -> list[str]:
    """URL11 select items; final alias ``{p}rel``."""
    return [
        f"regexp_replace({frm}, '/+$', '') AS {p}t",
        f"CASE WHEN strpos({p}t, '/') > 0 THEN regexp_extract({p}t, '(?s)^(.*)/', 1) END AS {p}dir",
        f"{_norm_segs(p + 'dir')} AS {p}s",
        f"{_norm_segs(to)} AS {p}q",
        f"least(len({p}s), len({p}q)) AS {p}m",
        f"coalesce(list_position(list_transform(range(1, {p}m + 1), lambda i: {p}s[i] = {p}q[i]), false) - 1, {p}m)"
        f" AS {p}k",
        f"array_to_string(list_concat(list_transform(range(len({p}s) - {p}k), lambda x: '..'), "
        f"{p}q[{p}k + 1:]), '/') AS {p}r0",
        f"CASE WHEN {p}dir IS NULL THEN NULL WHEN {p}r0 = '' THEN '.' ELSE {p}r0 END AS {p}rel",
    ]


# --- DOM mode (LNK2), for double-quoted markup --------------------------------------------

def dom_links(pages: str) -> str:
    """LNK2 oracle: comments and script/style bodies removed, then start tags
    of iframe/a/img/script/link; last double-quoted value of an attribute."""
    def attr(name):
        return f"regexp_extract(t, '(?is)^.*\\s{name}\\s*=\\s*\"([^\"]*)\"', 1)"

    def has(name):
        return f"regexp_matches(t, '(?is)\\s{name}\\s*=')"
    link = (f"CASE WHEN lower(regexp_extract(t, '^<(\\w+)', 1)) IN ('a', 'link') AND {has('href')} THEN {attr('href')} "
            f"WHEN lower(regexp_extract(t, '^<(\\w+)', 1)) IN ('iframe', 'img', 'script') AND {has('src')} "
            f"THEN {attr('src')} END")
    ty = f"CASE WHEN {has('type')} THEN {attr('type')} END"
    rec = (f"{{'tag': lower(regexp_extract(t, '^<(\\w+)', 1)), 'raw_link': {link}, 'type_attr': {ty}, "
           f"'rel': CASE WHEN {has('rel')} THEN {attr('rel')} END}}")
    groups = ", ".join(f"list_filter(ok, lambda r: r.tag = '{g}')" for g in ("iframe", "a", "img", "script", "link"))
    return f"""
    SELECT page_id, src_url, (pos - 1)::INTEGER AS pos, rec.tag AS tag, rec.raw_link AS raw_link, rec.type_attr AS type_attr,
           CASE rec.tag WHEN 'iframe' THEN 'IFRAME' WHEN 'a' THEN 'HTML' WHEN 'img' THEN 'IMAGE'
                        WHEN 'script' THEN 'SCRIPT' ELSE 'STYLE' END AS link_type
    FROM (
      SELECT page_id, src_url, unnest(ordered) AS rec, generate_subscripts(ordered, 1) AS pos FROM (
        SELECT page_id, src_url, list_concat({groups}) AS ordered FROM (
          SELECT page_id, src_url, list_filter(recs, lambda r: r.raw_link IS NOT NULL AND r.raw_link <> ''
                   AND (r.tag <> 'link' OR coalesce(r.type_attr = 'text/css', false) OR suffix(r.raw_link, '.css')
                        OR coalesce(trim(r.rel) = 'icon', false))) AS ok
          FROM (
            SELECT page_id, url AS src_url,
                   list_transform(regexp_extract_all(
                     regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
                                    '(?is)(<(?:script|style)\\b[^>]*>).*?</(?:script|style)\\s*>', '\\1', 'g'),
                     '(?i)<(?:iframe|a|img|script|link)(?:\\s[^>]*)?/?>', 0), lambda t: {rec}) AS recs
            FROM {pages}))))
    """


def rewrite_lexical(pages: str, hint_expr: str) -> str:
    """RW1 oracle: tokens are <a|link|img|script …> tags; the last non-empty
    link value of a tag is replaced; gaps are kept byte for byte."""
    tok_re = "<(?:a|link|img|script)[^>]*>"
    items = (resolve("link", "hint", "resolved", "r_") + parts("resolved", "f_")
             + [f"{host_path_expr('f_')} AS target",
                f"{dirname('hint')} AS hint_dir",
                f"{relative_path('hint_dir', 'target')} AS newval",
                "CASE WHEN tag IN ('a', 'link') THEN regexp_extract(t, '(?s)^(.*href=\")[^\"]+\"', 1) "
                "ELSE regexp_extract(t, '(?s)^(.*src=\")[^\"]+\"', 1) END AS pre"])
    return f"""
    WITH base AS (
      SELECT page_id, html, {hint_expr} AS hint,
             regexp_split_to_array(html, '{tok_re}') AS gaps,
             regexp_extract_all(html, '{tok_re}') AS toks FROM {pages}),
    tokens AS (
      SELECT page_id, hint, i, t, regexp_extract(t, '^<(a|link|img|script)', 1) AS tag FROM (
        SELECT page_id, hint, unnest(toks) AS t, generate_subscripts(toks, 1) AS i FROM base)),
    linked AS (
      SELECT *, list_filter(vals, lambda v, j: names[j] <> 'type' AND v <> '')[-1] AS link FROM (
        SELECT *,
          CASE WHEN tag IN ('a', 'link') THEN regexp_extract_all(t, '(href|type)="([^"]*)"', 1)
               ELSE regexp_extract_all(t, '(src|type)="([^"]*)"', 1) END AS names,
          CASE WHEN tag IN ('a', 'link') THEN regexp_extract_all(t, '(href|type)="([^"]*)"', 2)
               ELSE regexp_extract_all(t, '(src|type)="([^"]*)"', 2) END AS vals
        FROM tokens)),
    rewritten AS (
      SELECT page_id, i, CASE WHEN link IS NULL OR starts_with(link, '../') THEN t
                              ELSE pre || newval || substr(t, length(pre) + length(link) + 1) END AS nt
      FROM ({chain('linked', items)})),
    pieces AS (
      SELECT b.page_id, g.i, g.gap || coalesce(r.nt, '') AS piece FROM (
        SELECT page_id, unnest(gaps) AS gap, generate_subscripts(gaps, 1) AS i FROM base) g
      JOIN base b ON b.page_id = g.page_id
      LEFT JOIN rewritten r ON r.page_id = g.page_id AND r.i = g.i)
    SELECT page_id, string_agg(piece, '' ORDER BY i) AS html FROM pieces GROUP BY page_id
    """


def chain(src: str, items: list[str]) -> str:
    """``SELECT *, item`` nested once per item: later items see earlier
    aliases as plain columns, so no expression is ever copied (DuckDB expands
    same-level alias references by substitution, which explodes on long chains)."""
    q = src if src.lstrip().upper().startswith("SELECT") else f"SELECT * FROM {src}"
    for it in items:
        q = f"SELECT *, {it} FROM ({q})"
    return q


def crawl_rfc_levels(pages: str, depth: int, host_preserve: bool = False, host_regex: str | None = None,
                     path_regex: str | None = None, resolved: str | None = None) -> str:
    """Oracle of the page-crawler mode (DOM iframe/a links, RFC join, FLT2); with ``resolved``
    a URL has the links of the page it leads to, resolved against the URL itself."""
    keyed = chain(f"SELECT page_id, url, html FROM {pages}", split_rfc("url", "k_") + ["k_netloc || k_path AS pk"])
    keyed = (f"SELECT pk AS page_key, arg_min(page_id, page_id) AS page_id FROM ({keyed}) GROUP BY pk")
    links = (f"SELECT k.page_key, d.raw_link FROM ({dom_links(pages)}) d JOIN ({keyed}) k ON k.page_id = d.page_id "
             f"WHERE d.link_type IN ('HTML', 'IFRAME')")
    conds = ["true"]
    if host_preserve:
        conds.append("x_netloc = w_netloc")
    elif host_regex is not None:
        conds.append(f"regexp_matches(x_netloc, '{host_regex}')")
    if path_regex is not None:
        conds.append(f"regexp_matches(CASE WHEN x_path = '' THEN '/' ELSE x_path END, '{path_regex}')")
    walk_keyed = chain(_based("SELECT * FROM walk WHERE level < " + str(depth), resolved), split_rfc("url", "w_")
                       + split_rfc("base", "v_") + ["v_netloc || v_path AS pk"])
    step = chain(f"SELECT w.seed, w.url, w.level, w.w_netloc, l.raw_link FROM ({walk_keyed}) w "
                 f"JOIN lt l ON l.page_key = w.pk", resolve_rfc("raw_link", "url", "x_"))
    return f"""
    WITH RECURSIVE lt AS ({links}), {_eff(resolved)}
    walk(seed, url, level) AS (
      SELECT url, url, 0 FROM {pages}
      UNION
      SELECT seed, x_url, level + 1 FROM ({step}) WHERE {' AND '.join(conds)}
    )
    SELECT seed, url, min(level) AS level FROM walk GROUP BY seed, url
    """


def rewrite_dom(pages: str) -> str:
    """RW2 oracle for double-quoted markup: comments and script/style
    elements are kept whole; in iframe/a/img/script/link start tags the last
    href/src value becomes the shortest relative path between the local paths
    of the page and of its target."""
    scan = ("(?is)<!--.*?-->|<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>"
            "|<(?:iframe|a|img|script|link)(?:\\s[^>]*)?/?>")
    items = (resolve_rfc("value", "url", "x_") + local_path("url", "pg_") + local_path("x_url", "tg_")
             + relative_path_min("pg_local", "tg_local", "rp_"))
    return f"""
    WITH base AS (
      SELECT page_id, url, regexp_split_to_array(html, '{scan}') AS gaps, regexp_extract_all(html, '{scan}') AS toks
      FROM {pages}),
    tokens AS (
      SELECT page_id, url, i, t, lower(regexp_extract(t, '^<(\\w+)', 1)) AS tag,
             regexp_extract(t, '(?is)^<\\w+[^>]*>', 0) AS st
      FROM (SELECT page_id, url, unnest(toks) AS t, generate_subscripts(toks, 1) AS i FROM base)),
    valued AS (
      SELECT *,
        CASE WHEN starts_with(t, '<!--') THEN NULL
             WHEN tag IN ('a', 'link') AND regexp_matches(st, '(?is)\\shref\\s*=') THEN regexp_extract(st, '(?is)^.*\\shref\\s*=\\s*"([^"]*)"', 1)
             WHEN tag IN ('iframe', 'img', 'script') AND regexp_matches(st, '(?is)\\ssrc\\s*=') THEN regexp_extract(st, '(?is)^.*\\ssrc\\s*=\\s*"([^"]*)"', 1)
             END AS value,
        CASE WHEN regexp_matches(st, '(?is)\\stype\\s*=') THEN regexp_extract(st, '(?is)^.*\\stype\\s*=\\s*"([^"]*)"', 1) END AS ty,
        CASE WHEN regexp_matches(st, '(?is)\\srel\\s*=') THEN regexp_extract(st, '(?is)^.*\\srel\\s*=\\s*"([^"]*)"', 1) END AS rel,
        CASE WHEN tag IN ('a', 'link') THEN regexp_extract(st, '(?is)^(.*\\shref\\s*=\\s*)"[^"]*"', 1)
             ELSE regexp_extract(st, '(?is)^(.*\\ssrc\\s*=\\s*)"[^"]*"', 1) END AS pre
      FROM tokens),
    kept AS (
      SELECT * FROM valued WHERE value IS NOT NULL AND value <> ''
        AND tag IN ('iframe', 'a', 'img', 'script', 'link')
        AND (tag <> 'link' OR coalesce(ty = 'text/css', false) OR suffix(value, '.css') OR coalesce(trim(rel) = 'icon', false))),
    rewritten AS (
      SELECT page_id, i, pre || '"' || replace(replace(rp_rel, '&', '&amp;'), '"', '&quot;') || '"'
             || substr(t, length(pre) + length(value) + 3) AS nt
      FROM ({chain('kept', items)}) WHERE rp_rel IS NOT NULL),
    pieces AS (
      SELECT g.page_id, g.i, g.gap || coalesce(r.nt, tk.t, '') AS piece FROM (
        SELECT page_id, unnest(gaps) AS gap, generate_subscripts(gaps, 1) AS i FROM base) g
      LEFT JOIN rewritten r ON r.page_id = g.page_id AND r.i = g.i
      LEFT JOIN tokens tk ON tk.page_id = g.page_id AND tk.i = g.i)
    SELECT page_id, string_agg(piece, '' ORDER BY i) AS html FROM pieces GROUP BY page_id
    """
