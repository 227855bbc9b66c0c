import itertools
import random

from pyspark.sql import functions as F

from vigilseries.llm import urls
from vigilseries.llm.queries import URL_RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [k for k, c in enumerate(rest) if c in "/?#"]
    host = rest[: ends[0]] if ends else rest
    path = rest[len(host) :]
    cut = [k for k, c in enumerate(path) if c in "?#"]
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return lower, path[: cut[0]] if cut else path


def brute(url, rules, default="allow"):
    host, path = parts(url)
    fits = [
        (len(h + p), len(h), v == "block", h + p, v)
        for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


def check(spark, addresses, rules, rows_per_partition, monkeypatch):
    monkeypatch.setattr(urls, "ROWS_PER_PARTITION", rows_per_partition)
    pages = spark.createDataFrame(list(enumerate(addresses)), "page_id long, url string").withColumn(
        "key", F.lit(1)
    ).withColumn("rule", F.lit("mine"))
    got = urls.judged(pages, urls.rule_table(spark, rules)).select("row.page_id", "host", "path", "rule", "verdict")
    wanted = [(i, *brute(u, rules)) for i, u in enumerate(addresses)]
    assert sorted(map(tuple, got.collect())) == wanted


HARD = [
    None, "", "nothing", "http://", "://a.com/x", "http://com/", "http://example.com", "HTTP://WWW.Example.COM/en/1",
    "http://example.com/en/?q#f", "http://example.com?x=/en/", "http://a.www.example.com/en/", "http://xexample.com/en/",
    "http://b.net/es/1", "http://net/fr/", "http://é.net/fr/x\ny", "x://y://z.com/en/", "http://a..com/", "http://com./",
    "http://a.com/" + "p" * 100_000,
]


def test_edges(spark, monkeypatch):
    check(spark, HARD + HARD, URL_RULES, 100_000, monkeypatch)


def test_hot_host_over_many_partitions(spark, monkeypatch):
    hosts = ["hot.example.net"] * 300 + ["a.com", "www.example.com", "x.org"] * 40
    addresses = [f"https://{h}/{('en', 'es', 'fr')[i % 3]}/{i}" for i, h in enumerate(hosts)]
    check(spark, addresses, URL_RULES, 10, monkeypatch)


def test_random_nested_rules(spark, monkeypatch):
    rng = random.Random(5)
    labels, folders = ["a", "b", "com", "net"], ["", "/", "/x", "/x/", "/x/y"]
    hosts = [".".join(h) for n in (1, 2, 3) for h in itertools.product(labels, repeat=n)]
    rules = list({(rng.choice(hosts), rng.choice(folders)) for _ in range(60)})
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in rules]
    addresses = [f"http://{rng.choice(hosts)}{rng.choice(folders)}{rng.choice(['', 'z', '/y/'])}" for _ in range(400)]
    check(spark, addresses, rules, 30, monkeypatch)


def test_empty_and_null_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    rules = urls.rule_table(spark, [(None, "/", "block"), ("com", None, "block"), ("com", "/", None)])
    assert urls.judged(pages, rules, default="block").first().verdict == "block"
    assert urls.judged(pages.limit(0), urls.rule_table(spark, URL_RULES)).count() == 0


def test_one_address_over_many_partitions(spark):
    """A single address on all rows: borders cut it evenly, from a sample of bounded size."""
    pages = spark.range(200_000).select(F.col("id").alias("page_id"), F.lit("http://www.example.com/en/a").alias("url"))
    keyed = pages.select(
        urls.key_of(urls.host_of(F.col("url"))).alias("key"),
        F.xxhash64("url", F.monotonically_increasing_id()).alias("spread"),
    )
    borders = urls._splitters(keyed)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert n - 2 <= len(borders) <= n and len(set(borders)) == len(borders)
    step = 200_000 // (n * urls.SAMPLED_PER_PARTITION)
    assert keyed.where(F.pmod("spread", F.lit(step)) == 0).count() < 3 * n * urls.SAMPLED_PER_PARTITION
    found = urls.judged(pages, urls.rule_table(spark, URL_RULES))
    got = found.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rule").alias("k"))
    sizes = [r.n for r in got.collect()]
    assert sum(sizes) == 200_000 and len(sizes) >= n // 2 and max(sizes) < 200_000 / 2
    assert found.select("rule", "verdict").distinct().collect() == [("www.example.com/en/", "allow")]
