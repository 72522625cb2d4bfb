import random
import re

from pyspark.sql import functions as F

from gleanery.llm import urls


def brute(url, rules, default="allow"):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) if m else ""
    path = m[2] if m else ""
    fits = [(-len(h) - len(p), h, p, v) for h, p, v in rules if host and (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = min(fits, default=None)
    return host, path, best and best[1] + best[2], best[3] if best else default


def make():
    r = random.Random(4)
    hosts = ["example.net", "a.example.net", "b.a.example.net", "xample.net", "net", "example.com", "Example.COM", "org", "x.org", "xorg", "localhost:80", "é.net", "", "net\x01evil", "x.net\x01evil", "evil\x01.net", "net\x02", "net\x02a", "\x01net", "a\x02.net", "net\x01"]
    paths = ["", "/", "/en/", "/en/1", "/de/x", "/fr/", "/EN/", "//"]
    out = [(i, f"{r.choice(['http', 'https', ''])}://{r.choice(hosts)}{r.choice(paths)}{r.choice(['', '?q=http://z.net/', '#f'])}") for i in range(600)]
    out += [(900, None), (901, ""), (902, "no scheme.net/en/"), (903, "://"), (904, "a://b://c.net/"), (905, "http://x.net/" + "y" * 100_000), (906, "http://a.net\n/en/"), (None, "http://z.net/"), (3, out[3][1]), (3, out[3][1])]
    return out


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.example.net", "/", "allow"), ("b.a.example.net", "/en/1", "block"), ("net", "/de/", "block")]


def test_like_brute_force(spark, monkeypatch):
    pages = make()
    df = spark.createDataFrame([(*p, "h", "v") for p in pages], "page_id long, url string, host string, verdict string")
    for rules in (RULES, [*RULES, ("", "/fr/", "block"), ("net", "/", "allow"), ("net\x01evil", "/", "block"), ("net\x02a", "/", "block")], []):
        for size in (100_000, 7):
            monkeypatch.setattr(urls, "RANGE_ROWS", size)
            table = spark.createDataFrame([*rules, (None, "/", "block"), ("x", None, "block")], "host string, path string, verdict string")
            got = sorted(map(tuple, urls.url_filter(df, table).collect()), key=repr)
            assert got == sorted(((i, *brute(u, rules)) for i, u in pages), key=repr)


def test_one_hot_url_goes_to_several_ranges(spark):
    df = spark.createDataFrame([(i, "http://hot.net/x") for i in range(5000)], "page_id long, url string")
    out = urls.url_filter(df, spark.createDataFrame(RULES, "host string, path string, verdict string"))
    assert {r["rule"] for r in out.collect()} == {"net/"}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert urls.url_filter(none, spark.createDataFrame(RULES, "host string, path string, verdict string")).count() == 0
