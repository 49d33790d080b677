import re

import pytest
from pyspark.sql import functions as F

from episodica.llm import urls

from .helpers import rows_of

URLS = [
    "https://a.com/x", "https://A.Com", "http://example.com/en/1", "http://www.example.com/en/1", "http://b.www.example.com/en/?q", "https://x.net/es/1", "https://x.net/fr",
    "https://x.net/fr/#f", "no url", None, "", "ftp://u@h:80/p?x=/y#z", "https://acom/", "://", "https://q.org?a/b", "x://y://z/w", "https://ÄÖ.net/es/ü", "https://example.com.evil.net/es/",
]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    after = url.split("://", 1)[1]
    host = re.split(r"[/?#]", after, maxsplit=1)[0]
    path = re.split(r"[?#]", after[len(host) :], maxsplit=1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [h + p for h, p, _ in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=len) if fits else None


@pytest.fixture(scope="module")
def model(spark):
    return urls.train(urls.labelled_urls(spark))


def test_parts_and_rules(spark, model):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    verdicts = {h + p: v for h, p, v in urls.RULES}
    for r in rows_of(urls.judge(df, *model)):
        host, path, rule = brute(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdicts[rule] if rule else "block" if r["score"] > 0 else "allow")
    assert urls.judge(df.limit(0), *model).count() == 0


def test_scores_match_a_sum_by_hand(spark, model):
    weights, intercept = model
    df = spark.createDataFrame([(0, "https://free-bets.example.org/en/9")], "page_id long, url string")
    got = urls.judge(df, weights, intercept).first()["score"]
    parts = df.select(urls.buckets_of(urls.host_of(F.col("url")), urls.path_of(F.col("url"))).alias("b")).first()["b"]
    assert len(set(parts)) == len(parts) and abs(got - (intercept + sum(weights[b] for b in parts))) < 1e-9


BAD_HOSTS = ("free-bets", "cheap-pills", "adult-x", "spam-farm", "casino-win", "ads-track")


def test_labelled_words_are_none_of_the_judged_hosts(spark):
    """No label of three letters or more of a host that the pages name for something bad stands in the labelled table."""
    labels = [x for h in BAD_HOSTS for x in h.split("-") if len(x) > 2]
    table = " ".join(r["url"] for r in rows_of(urls.labelled_urls(spark)))
    assert [x for x in labels if x in table] == []
    assert urls.labelled_urls(spark).select(urls.host_of(F.col("url"))).distinct().count() >= 300


def right(spark, model, hosts):
    """The share of (host, label) that a model tells right, on a path that both classes have."""
    df = spark.createDataFrame([(int(y), f"https://www.{h}.example.com/17") for h, y in hosts], "page_id long, url string")
    got = rows_of(urls.judge(df, *model))
    return sum((r["score"] > 0) == bool(r["page_id"]) for r in got) / len(got)


def test_new_pairs_of_known_words(spark, model):
    hosts = [(w[i] + "-" + w[(i + 5) % len(w)], y) for y, words in ((1, urls.BLOCK_WORDS), (0, urls.ALLOW_WORDS)) for w in map(str.split, words.values()) for i in range(len(w))]
    assert right(spark, model, hosts) >= 0.95


def test_held_out_words(spark):
    """Words that the table lacks (a fifth, left out of every kind): measured 110 of 196 over all fifths, little above chance."""
    part = lambda words, out: {k: " ".join(w for i, w in enumerate(v.split()) if (i % 5 == 0) == out) for k, v in words.items()}
    model = urls.train(urls.labelled_urls(spark, part(urls.BLOCK_WORDS, False), part(urls.ALLOW_WORDS, False)))
    held = [(w, y) for y, words in ((1, urls.BLOCK_WORDS), (0, urls.ALLOW_WORDS)) for v in part(words, True).values() for w in v.split()]
    assert right(spark, model, held) >= 0.5


def test_paths_differ_by_class(spark, model):
    rows = [(int(y), f"https://www.qqqq.example.com{p}") for y, paths in ((1, urls.BLOCK_PATHS), (0, urls.ALLOW_PATHS)) for p in paths]
    got = rows_of(urls.judge(spark.createDataFrame(rows, "page_id long, url string"), *model))
    assert all((r["score"] > 0) == bool(r["page_id"]) for r in got)


def test_long_urls_and_clashing_names(spark, model):
    long = "https://a.org/" + "path/" * 50_000
    df = spark.createDataFrame([(1, long, "mine", "mine", "mine", 7.0, "mine", "kept")], "page_id long, url string, host string, path string, rule string, score double, verdict string, extra string")
    row = urls.judge(df, *model).first()
    assert row["host"] == "a.org" and row["path"] == long[len("https://a.org") :] and row["rule"] is None
    assert row["verdict"] in ("allow", "block") and row["extra"] == "kept" and len(row) == 8


def test_no_python_in_the_plan(spark):
    plan = urls.op6_url_filter(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExternalRDD", plan)
