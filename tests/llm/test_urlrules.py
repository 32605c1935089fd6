import random

from sparkrules.llm import urlrules as u


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = []
    for h, p, v in rules:
        h, p = (h or "").lower(), p or ""
        if (host == h or h and host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h + p), len(h), v == "block", h + p, v))
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_against_brute_force(spark):
    random.seed(8)
    labels, parts = ["a", "b", "com", "net", "x-y"], ["en", "de", "fr", "p"]
    host = lambda: ".".join(random.choices(labels, k=random.randint(1, 4)))
    path = lambda: "/" * random.randint(0, 1) + "/".join(random.choices(parts, k=random.randint(0, 3)))
    rules = {(host(), path()): random.choice(["allow", "block"]) for _ in range(60)}
    rules = [(h, p, v) for (h, p), v in rules.items()] + [("net", "/", "block"), (None, None, "block"), ("A.com", "/en", "block"), ("a.com", "/en", "allow"), ("a.com", "/en", "allow")]
    urls = [f"http://{host().upper() if k % 5 else host()}{'/' if k % 3 else ''}{path()}{random.choice(['', '?q=/en', '#x', '?'])}" for k in range(1500)]
    urls += ["http://a.b.net/en/" + "p/" * 3000, None, "", "no-scheme/en", "http://", "ftp://a..com/en", "http://a.com/en://b", "http://user@a.com:80/en"] + ["http://b.net/hot"] * 500
    pages = spark.createDataFrame([(i, x, "h") for i, x in enumerate(urls)] + [(None, urls[0], "h"), (1, urls[1], "h")], "page_id long, url string, host string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = sorted((tuple(r) for r in u.judge(pages, table).collect()), key=str)
    seen = {r[0]: r for r in rules}
    assert seen
    want = sorted(((r.page_id, *brute(r.url, _merged(rules))) for r in pages.collect()), key=str)
    assert got == want


def _merged(rules):
    """``block`` wins among rules of one host and path."""
    out = {}
    for h, p, v in rules:
        key = ((h or "").lower(), p or "")
        out[key] = max(v, out.get(key, ""))
    return [(h, p, v) for (h, p), v in out.items()]


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [tuple(r) for r in u.judge(pages, none).collect()] == [(1, "a.net", "/x", None, "allow")]
    rules = spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string")
    assert u.judge(pages.limit(0), rules).collect() == []
