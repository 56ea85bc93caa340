import numpy as np
from llm_helpers import frame

from pricelens.llm import url_filter as U

PAGES = "page_id long, url string, html string"


def _rules(spark, rules=U.RULES):
    return spark.createDataFrame(rules, "action string, host string, path string")


def test_hosts_paths_and_rules(spark):
    rows = [(1, "http://A.example.NET/en/x?q", ""), (2, "https://example.net", None), (3, "ftp://x.org/fr/", ""), (4, "http://x.org/fr", ""), (5, None, ""), (6, "no scheme", ""),
            (7, "https://www.example.com/de/a#b", ""), (8, "x://y://z/w", ""), (9, "http://notexample.com/de/", ""), (9, "http://notexample.com/de/", ""), (10, "http://h?x/y", ""), (11, "http://net/", "")]
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in U.judge_pages(frame(spark, rows, PAGES), _rules(spark)).select("page_id", "host", "path", "rule", "verdict").collect())
    assert [g[:4] for g in got] == [
        (1, "a.example.net", "/en/x", "example.net/en/"), (2, "example.net", "", None), (3, "x.org", "/fr/", "org/fr/"), (4, "x.org", "/fr", None), (5, "", "", None), (6, "", "", None),
        (7, "www.example.com", "/de/a", "example.com/de/"), (8, "y:", "//z/w", None), (9, "notexample.com", "/de/", None), (9, "notexample.com", "/de/", None), (10, "h", "", None), (11, "net", "/", "net/")]
    verdicts = {g[0]: g[4] for g in got}
    assert verdicts[1] == verdicts[3] == verdicts[5] == verdicts[6] == "allow" and verdicts[7] == verdicts[11] == "block"
    assert U.judge_pages(frame(spark, [], PAGES), _rules(spark)).count() == 0


def _brute(n, edges, seeds):
    w = np.zeros((n, n))
    for a, b, k in edges:
        w[a, b] += k
    out = w.sum(axis=1, keepdims=True)
    step = np.divide(w, out, out=np.zeros_like(w), where=out > 0)
    s = np.array(seeds, dtype=float) / sum(seeds)
    r = s.copy()
    for _ in range(400):
        moved = U.DAMPING * r @ step
        r = moved + s * (1 - moved.sum())
    return r


def test_walk_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b), int(k)) for a, b, k in zip(rng.integers(0, 12, 40), rng.integers(0, 12, 40), rng.integers(1, 5, 40), strict=True) if a != b]
    seeds = [3, 0, 0, 1] + [0] * 8
    e = spark.createDataFrame([(str(a), str(b), k) for a, b, k in edges], "src string, dst string, n long").groupBy("src", "dst").sum("n").withColumnRenamed("sum(n)", "n")
    s = spark.createDataFrame([(str(i), w) for i, w in enumerate(seeds)], "host string, weight long")
    got = {r["host"]: r["rank"] for r in U.personalised_rank(s, e).collect()}
    want = _brute(12, edges, seeds)
    assert all(abs(got.get(str(i), 0.0) - want[i]) < 1e-4 for i in range(12))
    assert U.personalised_rank(s.where("weight > 9"), e).count() == 0


def test_walk_reaches_the_end_of_a_long_chain(spark):
    n = 62
    edges = [(k, k + 1, 1) for k in range(n - 1)]
    e = spark.createDataFrame([(str(a), str(b), k) for a, b, k in edges], "src string, dst string, n long")
    s = spark.createDataFrame([("0", 1)], "host string, weight long")
    got = {r["host"]: r["rank"] for r in U.personalised_rank(s, e, tolerance=1e-4).collect()}
    want = _brute(n, edges, [1] + [0] * (n - 1))
    assert len(got) == n and all(0 < got[str(i)] and abs(got[str(i)] - want[i]) < 1e-4 for i in range(n))
    assert U.most_steps(U.DAMPING, U.TOLERANCE) > 80


def test_links_carry_trust_and_distrust(spark):
    link = "<a href='https://{}/x'>t</a>".format
    rows = [(k, f"http://spam{k}.net/p", "") for k in range(6)] + [(10, "http://farm.xyz/a", link("Spam1.NET") + link("spam2.net") + '<a href="/local">l</a>')]
    rows += [(20 + k, "http://good.org/fr/1", link("friend.xyz") + '<img src="//friend.xyz/i.png">') for k in range(3)] + [(30, "http://friend.xyz/", "")] + [(40 + k, f"http://other{k}.xyz/", None) for k in range(30)]
    got = {r.host: r for r in U.judge_pages(frame(spark, rows, PAGES), _rules(spark)).collect()}
    assert got["farm.xyz"].verdict == "block" and got["farm.xyz"].rule is None
    assert got["friend.xyz"].verdict == "allow" and got["friend.xyz"].trust > 0 and got["other3.xyz"].verdict == "allow"


def test_main_path_is_native(spark):
    plan = U.judge_pages(frame(spark, [(1, "http://a.b/", "")], PAGES), _rules(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
