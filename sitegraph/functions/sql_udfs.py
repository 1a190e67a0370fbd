"""URL rules as SQL functions (UDF4).

``register(spark)`` creates temporary SQL functions whose bodies are plain
Spark SQL; the analyzer inlines them, so a SQL user gets the same
optimisable expressions as the DataFrame API in ``urls``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_E = r"$?#\r\n "

# name -> (signature, return type, body)
FUNCTIONS = {
    "sg_url_protocol": ("u STRING", "STRING", rf"regexp_extract(u, r'^([^{_E}]*?://)', 1)"),
    "sg_url_rest": ("u STRING", "STRING", rf"regexp_extract(u, r'^(?:[^{_E}]*?://)?([^{_E}]*)', 1)"),
    "sg_url_host": ("u STRING", "STRING",
                    "CASE WHEN sg_url_protocol(u) <> '' OR instr(sg_url_rest(u), '/') > 0 "
                    "THEN regexp_extract(sg_url_rest(u), r'^[^/:]*', 0) ELSE sg_url_rest(u) END"),
    "sg_url_path": ("u STRING", "STRING", r"regexp_extract(sg_url_rest(u), r'(?s)^[^/]*(/.*)$', 1)"),
    "sg_host_path": ("u STRING", "STRING",
                     r"regexp_replace(CASE WHEN sg_url_path(u) = '' THEN sg_url_host(u) ELSE sg_url_rest(u) END, "
                     r"r'/\z', '')"),
    "sg_save_path": ("u STRING, t STRING", "STRING",
                     "CASE WHEN t IN ('HTML', 'NO') AND NOT endswith(sg_host_path(u), '/index.html') "
                     "THEN sg_host_path(u) || '/index.html' ELSE sg_host_path(u) END"),
    "sg_is_file_url": ("u STRING, t STRING", "BOOLEAN",
                       "CASE WHEN endswith(u, '/') THEN false WHEN t IN ('IMAGE', 'STYLE', 'SCRIPT') THEN true "
                       "WHEN sg_url_path(u) = '' THEN false "
                       r"ELSE regexp_extract(u, r'(?s)[^/]*\z', 0) RLIKE r'\.[A-Za-z]' END"),
    "sg_dirname": ("p STRING", "STRING", r"CASE WHEN endswith(p, '/') THEN p ELSE regexp_extract(p, r'(?s)^(.+/)', 1) END"),
    "sg_url_dirname": ("u STRING", "STRING", "CASE WHEN sg_url_path(u) <> '' THEN sg_dirname(u) ELSE u END"),
    "sg_dir_count": ("p STRING", "INT",
                     "CASE WHEN p = '' THEN 0 ELSE length(p) - length(replace(p, '/', '')) "
                     "- (CASE WHEN startswith(p, '/') THEN 1 ELSE 0 END) "
                     r"- regexp_count(p, r'(?<=/\.)/') - (CASE WHEN startswith(p, './') THEN 1 ELSE 0 END) "
                     r"- 2 * regexp_count(p, r'(?<=\.\.)/') + (CASE WHEN endswith(p, '/') THEN 0 ELSE 1 END) END"),
    "sg_relative_path": ("f STRING, t STRING", "STRING",
                         "repeat('../', CASE WHEN f = '' THEN 0 ELSE sg_dir_count(f) END) || t"),
    "sg_normalize_path": ("p STRING", "STRING",
                          "CASE WHEN p = '/' THEN '/' ELSE "
                          "(CASE WHEN startswith(p, '/') THEN '/' ELSE '' END) || array_join(aggregate("
                          r"filter(split(p, r'[/\\]'), s -> s <> '' AND s <> '.'), CAST(array() AS ARRAY<STRING>), "
                          "(acc, s) -> CASE WHEN s = '..' THEN slice(acc, 1, greatest(size(acc) - 1, 0)) "
                          "ELSE array_append(acc, s) END), '/') || (CASE WHEN endswith(p, '/') THEN '/' ELSE '' END) END"),
    "sg_resolve_base": ("page STRING", "STRING",
                        "CASE WHEN sg_is_file_url(page, 'HTML') THEN sg_url_dirname(page) ELSE page END"),
    # transform(array(x), v -> ...)[0] computes x once
    "sg_join_base": ("link STRING, base STRING", "STRING",
                     "sg_url_protocol(base) || sg_normalize_path(transform(array(sg_url_host(base) || sg_url_path(base)), "
                     "hp -> hp || (CASE WHEN endswith(hp, '/') THEN '' ELSE '/' END) || link)[0])"),
    "sg_resolve_link": ("link STRING, page_url STRING", "STRING",
                        "CASE WHEN startswith(link, 'http') THEN link "
                        r"WHEN startswith(link, '/') THEN sg_url_protocol(regexp_replace(page_url, r'^\./', '')) "
                        r"|| sg_normalize_path(sg_url_host(regexp_replace(page_url, r'^\./', '')) || link) "
                        r"ELSE sg_join_base(link, sg_resolve_base(regexp_replace(page_url, r'^\./', ''))) END"),
    "sg_link_type": ("tag STRING, link STRING, ty STRING", "STRING",
                     "CASE WHEN startswith(tag, 'a') THEN 'HTML' WHEN startswith(tag, 'img') THEN 'IMAGE' "
                     "WHEN startswith(tag, 'script') THEN 'SCRIPT' "
                     "WHEN coalesce(startswith(ty, 'text/css'), false) THEN 'STYLE' "
                     "WHEN coalesce(startswith(ty, 'image/'), false) THEN 'IMAGE' "
                     "WHEN coalesce(startswith(ty, 'text/javascript'), false) THEN 'SCRIPT' "
                     "WHEN endswith(sg_link_main(link), '.png') OR endswith(sg_link_main(link), '.jpg') "
                     "OR endswith(sg_link_main(link), '.svg') THEN 'IMAGE' "
                     "WHEN endswith(sg_link_main(link), '.css') THEN 'STYLE' "
                     "WHEN endswith(sg_link_main(link), '.js') THEN 'SCRIPT' ELSE 'NO' END"),
    "sg_link_main": ("link STRING", "STRING",
                     rf"CASE WHEN sg_url_path(link) <> '' THEN regexp_extract(link, r'^[^{_E}]*', 0) "
                     "ELSE sg_url_protocol(link) || sg_url_host(link) END"),
}

# creation order: a function is defined after the ones it calls
ORDER = ("sg_url_protocol", "sg_url_rest", "sg_url_host", "sg_url_path", "sg_host_path", "sg_save_path",
         "sg_is_file_url", "sg_dirname", "sg_url_dirname", "sg_dir_count", "sg_relative_path",
         "sg_normalize_path", "sg_resolve_base", "sg_join_base", "sg_resolve_link", "sg_link_main", "sg_link_type")


def register(spark: SparkSession) -> list[str]:
    for name in ORDER:
        sig, ret, body = FUNCTIONS[name]
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({sig}) RETURNS {ret} RETURN {body}")
    return list(ORDER)
