import math
import zlib
from collections import Counter

import numpy as np

from seamline.llm.url_filter import BINS, FOLDS, ORDER, SHARE, SPAN, judge, threshold
from tests.llm.helpers import read


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:end]


RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def rule(host, path):
    fits = [r for r in RULES if (host == r[: r.index("/")] or host.endswith("." + r[: r.index("/")])) and path.startswith(r[r.index("/") :])]
    return max(fits, key=len, default=None)


def test_hosts_paths_and_rules(spark):
    urls = ["http://Net/", "https://a.NET/x", "http://a.net", "http://example.net/en/1", "http://xexample.net/en/1", "x", None, "", "://", "http://é.ORG/fr/?q", "a://b://c/d", "http://org/fr", "http://org?/fr/", "http://www.example.com/de/#x", "http://h#/de/", "http://h\n/x\ny?z"]
    pages = spark.createDataFrame([(i, u, None, "r") for i, u in enumerate(urls)], "page_id long, url string, html string, rule string")
    for table in (pages, read(spark, "pages")):
        rows = {r["page_id"]: r for r in judge(table).collect()}
        for r in table.collect():
            got = rows[r["page_id"]]
            host, path = parts(r["url"])
            assert (got["host"], got["path"], got["rule"]) == (host, path, rule(host, path))
            assert got["verdict"] in ("allow", "block") and (got["rule"] is None or got["verdict"] == RULES[got["rule"]])
    assert judge(pages.limit(0)).count() == 0


def test_models_tell_kinds_of_urls_apart(spark):
    good = [f"http://news{i}.example/articles/story-{i * 37 % 91}" for i in range(300)]
    bad = [f"http://cheap-pills{i}.example/buy-now?ref={i * 53 % 97}" for i in range(300)]
    labelled = spark.createDataFrame([(u, True) for u in good] + [(u, False) for u in bad], "url string, accepted boolean")
    unseen = [f"http://news{i}.example/articles/story-{i}" for i in range(900, 950)] + [f"http://cheap-pills{i}.example/buy-now?ref={i}" for i in range(900, 950)]
    pages = spark.createDataFrame(list(enumerate(unseen)), "page_id long, url string")
    verdicts = {r["page_id"]: r["verdict"] for r in judge(pages, (), labelled).collect()}
    right = sum((verdicts[i] == "allow") == (i < 50) for i in verdicts)
    assert right >= 98


def test_threshold_is_the_middle_of_the_best_bins():
    h = np.zeros((2, BINS))
    h[0, 900], h[1, 1100] = 5, 5
    assert abs(threshold(h) - (1000.5 * 2 * SPAN / BINS - SPAN)) < 0.01
    assert threshold(np.zeros((2, BINS))) == 0


def windows(url):
    u = url or ""
    b = b"\x02" * ORDER + (u.partition("://")[2] or u).encode() + b"\x03"
    b = bytes(c + 32 if 65 <= c <= 90 else c for c in b)
    return [b[i - ORDER : i + 1] for i in range(ORDER, len(b))]


def brute(urls, labelled):
    """Verdicts without rules: models of plain dictionaries, one context after the other."""
    fold = lambda u: zlib.crc32((u or "").encode()) % FOLDS
    grams, contexts = [Counter(), Counter()], [Counter(), Counter()]
    for u, good in labelled:
        if fold(u):
            for w in windows(u):
                for k in range(ORDER + 1):
                    grams[good][w[ORDER - k :]] += 1
                    contexts[good][k, w[ORDER - k : ORDER]] += 1

    def difference(u):
        total = 0
        for w in windows(u):
            p = [1 / 256, 1 / 256]
            for k in range(ORDER + 1):
                for good in (0, 1):
                    p[good] = (grams[good][w[ORDER - k :]] + SHARE * p[good]) / (contexts[good][k, w[ORDER - k : ORDER]] + SHARE)
            total += math.log(p[1] / p[0])
        return total / len(windows(u))

    h = np.zeros((2, BINS))
    for u, good in labelled:
        if not fold(u):
            h[int(good), min(max(int((difference(u) + SPAN) * BINS / (2 * SPAN)), 0), BINS - 1)] += 1
    least = threshold(h)
    return {u: (difference(u), "allow" if difference(u) >= least else "block") for u in urls}


def test_verdicts_against_brute_force(spark):
    table = read(spark, "pages").select("page_id", "url").limit(120)
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "HTTP://É.x/" + "y" * 3000), (-4, "a://"), (-4, "a://")], "page_id long, url string")
    pages = table.unionAll(extra)
    rows = judge(pages).collect()
    labelled = [(r["url"], rule(*parts(r["url"]))) for r in pages.collect() if rule(*parts(r["url"]))]
    want = brute([r["url"] for r in pages.collect()], [(u, RULES[x] == "allow") for u, x in labelled])
    urls = {r["page_id"]: r["url"] for r in pages.collect()}
    assert len(rows) == pages.count()
    for r in rows:
        difference, verdict = want[urls[r["page_id"]]]
        assert abs(difference - r["log_likelihood_difference"]) < 1e-4
        assert r["rule"] is not None or r["verdict"] == verdict
