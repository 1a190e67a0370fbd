from pyspark.sql import functions as F

from sitegraph.functions import sql_udfs
from sitegraph.functions import urls as U

URLS = ["https://orchard.test/guide/trees/", "plum.test", "/fig/kiwi/", "http://orchard.test:81/lime.html?x=1",
        "./orchard.test/guide/index.html", "orchard.test/a/../b/./c", "ftp://seeds.test/en?kind=2#core", ""]
LINKS = ["/leaf.css", "../up/one.html", "near/by.js", "https://seeds.test/pip", "?page=3", "/", "", "..", "tree.svg#x"]


def test_sql_functions_equal_column_functions(spark):
    sql_udfs.register(spark)
    df = spark.createDataFrame([(u, l) for u in URLS for l in LINKS], "u string, l string")
    df.createOrReplaceTempView("udf_in")
    got = spark.sql("""SELECT u, l, sg_url_protocol(u) p, sg_url_host(u) h, sg_url_path(u) pa, sg_host_path(u) hp,
                              sg_save_path(u, 'HTML') sp, sg_is_file_url(u, 'HTML') f, sg_dir_count(sg_host_path(u)) dc,
                              sg_normalize_path(u) n, sg_resolve_link(l, u) r, sg_link_type('link', l, NULL) t,
                              sg_relative_path(sg_dirname(u), l) rp
                       FROM udf_in""")
    exp = df.select("u", "l", U.url_protocol("u").alias("p"), U.url_host("u").alias("h"), U.url_path("u").alias("pa"),
                    U.host_path("u").alias("hp"), U.save_path("u", "HTML").alias("sp"),
                    U.is_file_url("u", "HTML").alias("f"), U.dir_count(U.host_path("u")).alias("dc"),
                    U.normalize_path("u").alias("n"), U.resolve_link("l", "u").alias("r"),
                    U.link_type(F.lit("link"), F.col("l"), F.lit(None).cast("string")).alias("t"),
                    U.relative_path(U.dirname("u"), "l").alias("rp"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.collect()))
