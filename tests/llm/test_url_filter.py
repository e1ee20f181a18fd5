"""Hosts, paths and rules against Python; the tree on made purities."""

import random

from shoplens.llm import url_filter as U


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:end]


def rule_of(host, path):
    best = (None, None)
    for v, h, p in U.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best[0] is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return best


def none(spark):
    return spark.createDataFrame([], "page_id long, good boolean")


def test_hosts_paths_rules(spark):
    rng = random.Random(1)
    urls = [None, "", "nothing", "http://", "http://NET/", "x://a.net", "http://a.Example.net/en/1?q=/de/", "http://example.com/de/x#y",
            "http://notexample.com/de/", "http://É.ORG/fr/", "http://a.org/fr", "a://b://c/d", "http://h?x/y", "http://h#a?b", "http://x.net/" + "a/" * 20_000]
    parts = ["http://", "example", ".net", ".com", "org", "/en/", "/de/", "/fr/", "?", "#", "A", "1", "/"]
    urls += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 8))) for _ in range(300)]
    rows = list(enumerate(urls)) + [(None, "http://a.net/"), (5, urls[5]), (5, urls[5])]
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in rows], "page_id long, url string, host string, path string")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in U.judge(pages, none(spark)).collect()]
    want = []
    for i, u in rows:
        h, p = plain(u)
        rule, v = rule_of(h, p)
        want.append((i, h, p, rule, v or "allow"))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert U.judge(pages.limit(0), none(spark)).count() == 0


def test_templates_by_purity(spark):
    urls, good = [], []
    for i in range(400):
        for path, bad in (("good", 0.05), ("fine", 0.06), ("spam", 0.95)):
            urls.append(f"http://h.test/{path}/{i}.html")
            good.append(i / 400 >= bad)
    urls += [f"http://h.test/rare{c}/x" for c in "abc"] + ["http://small.test/spam/1"]
    good += [None] * 3 + [False]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame(list(enumerate(good)), "page_id long, good boolean")
    rows = {r.page_id: r for r in U.judge(pages, labels).collect()}
    for i, u in enumerate(urls[:1200]):
        assert rows[i].verdict == ("block" if "/spam/" in u else "allow")
        assert rows[i].template == "/" + u.split("/")[3] + "/#.html"
    # the two good branches are alike and merge, the third stands apart
    assert rows[0].purity == rows[1].purity and abs(rows[0].purity - 0.94) < 0.02 and rows[2].purity < 0.1
    assert all(rows[1200 + i].template == "/*/*" for i in range(3))
    assert rows[1203].verdict == "allow"  # one bad page of a host is no evidence


def test_branches_at_any_depth(spark):
    urls, good = [], []
    deep = "http://h.test/" + "a/" * 40
    for i in range(300):
        for path, bad in (("http://h.test/2024/05/12/news/good", 0.05), ("http://h.test/2024/05/12/news/spam", 0.95),
                          (deep + "fine", 0.05), (deep + "junk", 0.95)):
            urls.append(f"{path}/{i}.html")
            good.append(i / 300 >= bad)
    urls += ["http://h.test/2024/05/12/news", deep + "rare/x", deep + "fine/1/" + "b/" * 20_000, deep + "junk/1.html/"]
    good += [None] * 4
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = {r.page_id: r for r in U.judge(pages, spark.createDataFrame(list(enumerate(good)), "page_id long, good boolean")).collect()}
    assert len(rows) == len(urls)
    for i, u in enumerate(urls[:1200]):
        assert rows[i].verdict == ("block" if "/spam/" in u or "/junk/" in u else "allow"), u
    assert rows[0].template.startswith("/#/#/#/news/good") and rows[1202].verdict == "allow" and rows[1203].verdict == "block"


def test_like_the_sql(spark, tmp_path):
    """Made pages of hosts with good, bad and mixed branches, and the given tables, against the SQL."""
    import duckdb
    from shoplens.llm.queries import op10_url_filter
    from shoplens.llm.url_filter_sql import oracle
    rng = random.Random(7)
    hosts = ["a.org", "B.org", "x.net", "y.example.com", "z.test", "w.test"]
    quality = {(h, s): rng.choice([0.02, 0.3, 0.5, 0.95]) for h in hosts for s in range(6)}
    urls, labels = [None, "x", "http://", "http://z.test"], []
    for d in range(3000):
        h, s = rng.choice(hosts), rng.randrange(6)
        urls.append(f"http://{h}/" + rng.choice(["", "k/"]) + f"s{'abcdef'[s]}/" + rng.choice([f"{d}", f"{d}.html", f"v{d}/?q=1"]))
        if rng.random() < 0.6:
            labels.append((d, int(rng.random() < quality[h, s]), rng.choice([0, 0, None])))
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    blocked = {}
    for folder, glob in ((str(tmp_path), "/*.parquet"), ("/root/testdata/sf0.1", "")):
        con = duckdb.connect()
        for t in ("pages", "labels"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{glob}')")
        got = [tuple(r) for r in op10_url_filter(spark, folder).select("page_id", "host", "path", "rule", "verdict").collect()]
        want = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({oracle()})").fetchall()
        assert sorted(got, key=str) == sorted(want, key=str)
        blocked[glob] = sum(r[4] == "block" and r[3] is None for r in want)
    assert blocked["/*.parquet"] > 100


def test_labels_by_url(spark):
    pages = spark.createDataFrame([(1, "http://a/en/7.html?x=9"), (2, "http://a/en/8/"), (3, "http://a/x"), (4, None), (5, "http://a/9#8")],
                                  "page_id long, url string")
    labels = spark.createDataFrame([(7, 1, 0), (8, 1, 1), (9, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert {(r.page_id, r.good) for r in U.labels_by_url(pages, labels).collect()} == {(1, True), (2, False), (5, False)}
