import math
import random
import re
from collections import Counter

import duckdb
import pytest
from oracle import same
from pyspark.sql import functions as F

from vellum.llm import urls

URLS = [
    (1, "http://A.Example.NET/en/5?q", "a.example.net", "/en/5", "example.net/en/", "allow"),
    (2, "https://x.net", "x.net", "", None, "allow"),
    (3, "https://x.net/", "x.net", "/", "net/", "block"),
    (4, "https://example.com/de/1", "example.com", "/de/1", "example.com/de/", "block"),
    (5, "https://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"),
    (6, "ftp://u@b.org:21/fr/x#y", "u@b.org:21", "/fr/x", None, "allow"),
    (7, "https://b.org/fr/x#y?z", "b.org", "/fr/x", "org/fr/", "allow"),
    (8, None, "", "", None, "allow"),
    (9, "no scheme/x", "", "", None, "allow"),
    (10, "http://q?x://y.net/", "q", "", None, "allow"),
    (11, "://net/a\nb", "net", "/a\nb", "net/", "block"),
    (12, "http://ÀB.org/é", "Àb.org", "/é", None, "allow"),
    (13, "", "", "", None, "allow"),
    (13, "", "", "", None, "allow"),
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([u[:2] for u in URLS], "page_id long, url string").selectExpr("*", "'x' AS host", "'y' AS way", "1 AS rate")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = urls.judge(pages, urls.page_labels(pages, labels)).collect()
    key = lambda r: (r[0], str(r))
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in rows), key=key) == sorted(((u[0], *u[2:]) for u in URLS), key=key)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_its_sql(spark, sf):
    same(urls.op8_template_tree(spark, sf), urls.ORACLE_SQL, sf)


def test_tree_keeps_bad_branches_and_merges_the_rest(spark):
    rows = [("h.com", f"/shop/{w}/{k}.html", 1) for k in range(60) for w in ("a", "b")] + [("h.com", f"/blog/{k}-{'ab'[k % 2]}", int(k % 20 == 0)) for k in range(120)]
    rows += [("h.com", f"/news/{'xyz'[k % 3] * 3}{k}", int(k % 20 == 0)) for k in range(120)] + [("other.com", "/q", None)] * 3
    tree = urls.template_tree(spark.createDataFrame(rows, "host string, path string, bad int"))
    found = {(r.host, r.template): r.rate for r in tree.collect()}
    assert set(found) == {("h.com", "/shop/*/*"), ("h.com", "/blog/*"), ("h.com", "/news/*"), ("other.com", "/*")}
    assert found["h.com", "/shop/*/*"] > 0.5 > found["h.com", "/news/*"] and found["other.com", "/*"] < 0.5


def site(rng):
    """Pages of two hosts whose bad branches lie one, three and seven segments deep, and one url of 500 segments."""
    pages, labels = [], []
    for k in range(900):
        bad = k % 10 < 4
        if k % 3 == 0:
            path = f"/{'spam' if bad else rng.choice(['news', 'blog'])}/{rng.choice('abcdefgh') * 3}/{k}"
        elif k % 3 == 1:
            path = f"/shop/{rng.choice(['x', 'y'])}/{'casino' if bad else 'books'}/{k}.html"
        else:
            path = f"/a/b/c/d/e/f/{'junk' if bad else 'fine'}/{rng.choice('pq')}/{k}"
        pages.append((k, f"http://{'one' if k % 2 else 'two'}.example/{path[1:]}?x=1"))
        labels.append((k, int(not bad), 0))
    pages += [(1000 + k, f"http://one.example/spam/zzz/{10**18 + k}") for k in range(3)] + [(1100, "http://one.example" + "/s" * 500)]
    labels += [(10**18 + k, 0, 1) for k in range(3)]
    return pages, labels


def plain_tree(rows):
    """Templates and rates of (host, segments, bad or None) rows, by recursion over lists of rows."""
    out, totals = {}, Counter()

    def down(host, template, group, depth):
        ended = [r for r in group if len(r[1]) == depth]
        out.setdefault((host, template), []).extend(ended)
        rest = [r for r in group if len(r[1]) > depth]
        if not rest:
            return
        marked = [r[2] for r in rest if r[2] is not None]
        rate = sum(marked) / len(marked) if marked else 0.0
        branches = {}
        for r in rest:
            branches.setdefault(r[1][depth], []).append(r)
        merged = []
        for seg, own in branches.items():
            known = [r[2] for r in own if r[2] is not None]
            apart = 0 < rate < 1 and known and abs(sum(known) / len(known) - rate) > 1.96 * math.sqrt(rate * (1 - rate) / len(known))
            if len(own) >= 5 and len(own) >= 0.02 * len(rest) and apart:
                down(host, f"{template}/{seg}", own, depth + 1)
            else:
                merged += own
        if merged:
            down(host, f"{template}/*", merged, depth + 1)

    hosts = {}
    for r in rows:
        hosts.setdefault(r[0], []).append(r)
        if r[2] is not None:
            totals[r[0], "lab"] += 1
            totals[r[0], "bad"] += r[2]
    every = sum(v for k, v in totals.items() if k[1] == "bad") / max(1, sum(v for k, v in totals.items() if k[1] == "lab"))
    for host, group in hosts.items():
        down(host, "", group, 0)
    rates = {}
    for (host, template), group in out.items():
        marked = [r[2] for r in group if r[2] is not None]
        prior = (totals[host, "bad"] + 20 * every) / (totals[host, "lab"] + 20)
        rates[host, template] = (sum(marked) + 20 * prior) / (len(marked) + 20)
    return {r[3]: (template, rates[host, template]) for (host, template), group in out.items() for r in group}


def test_the_tree_rejects_deep_branches(spark):
    pages, labels = site(random.Random(6))
    truth = {d: int(q == 0 or t == 1) for d, q, t in labels}
    given = spark.createDataFrame(pages, "page_id long, url string").withColumn("a.b", F.lit(1))
    found = {r.page_id: r for r in urls.judge(given, urls.page_labels(given, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()}
    rows = []
    for k, url in pages:
        host, path = re.fullmatch(r"http://([^/]*)([^?]*).*", url, re.S).groups()
        number = re.search(r"([0-9]+)[^0-9]*$", path)
        rows.append((host, [re.sub("[0-9]+", "{n}", x) for x in path.split("/") if x], truth.get(int(number[1])) if number else None, k))
    expected = plain_tree(rows)
    assert {k: (r.template, round(r.rate, 9)) for k, r in found.items()} == {k: (t, round(x, 9)) for k, (t, x) in expected.items()}
    blocked = {k for k, r in found.items() if r.verdict == "block"}
    assert blocked == {k for k in range(900) if k % 10 < 4} | {1000, 1001, 1002}  # also ids of 19 digits
    assert any(r.template.startswith("/a/b/c/d/e/f/junk") or r.template.count("/") >= 7 for k, r in found.items() if k in blocked)


def test_sql_of_the_deep_tree(spark, tmp_path):
    pages, labels = site(random.Random(7))
    for name, rows, schema in (("pages", pages, "page_id long, url string"), ("labels", labels, "doc_id long, quality int, toxic int")):
        spark.createDataFrame(rows, schema).coalesce(1).toPandas().to_parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    done = con.execute(urls.ORACLE_SQL)
    names = [d[0] for d in done.description]
    expected = sorted(tuple(dict(zip(names, r, strict=True))[c] for c in ("page_id", "template", "verdict", "rate")) for r in done.fetchall())
    assert expected == sorted((r.page_id, r.template, r.verdict, r.rate) for r in urls.op8_template_tree(spark, str(tmp_path)).collect())


def test_segments(spark):
    given = ["", "/", "//a//", "/en/825.html", "/x1/2/3/4/5/6", "/" + "0a" * 10 + "/b"]
    df = spark.createDataFrame([(p,) for p in given], "p string")
    assert [r.s for r in df.select(urls.segments(F.col("p")).alias("s")).collect()] == [[], [], ["a"], ["en", "{n}.html"], ["x{n}", "{n}", "{n}", "{n}", "{n}", "{n}"], ["{h}", "b"]]
    assert re.match("^[A-Z]+$", urls._UPPER)


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    labels = spark.createDataFrame([(None, 1, None), (1, None, None)], "doc_id long, quality int, toxic int")
    assert urls.judge(pages, urls.page_labels(pages, labels)).count() == 0
