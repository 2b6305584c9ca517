import random

from claimlens.llm.url_filter import judge_urls

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(url, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:end].translate(LOWER), rest[end:]
        path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p) and host]
    if fits:
        return host, path, *max(fits)[1:]
    plain = host.removeprefix("www.") + path.rstrip("/")
    return host, path, None, "block" if host and plain in listed else "allow"


def test_against_brute_force(spark):
    rng = random.Random(1)
    hosts = ["example.org", "a.EXAMPLE.org", "org", "notexample.org", "x.com", "com", "www.spam.net", "spam.net", "b.net", "", "x.com:80", "ücom"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?x=1", "/en/2#f", "/fr/a", "/de/", "/page/", "/page", "?q=://x", "#://y/de/", "/a//"]
    urls = [None, "", "nothing", "x.com/fr/", "://", "a://b://c/de/"] + [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)]
    urls += ["https://hot.example.org/en/1"] * 300 + ["http://b.net/" + "y" * 20_000, "http://" + "a." * 200 + "org/z\nq"]
    listed = {"spam.net/page", "b.net", "x.com/fr/a"}
    rows = [(i if i % 50 else None, u, "x", "x") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, key string, rule string")
    rules = spark.createDataFrame(RULES * 2, "host string, path string, verdict string")
    names = spark.createDataFrame([(u,) for u in [*listed, None, *(f"other.net/{i}" for i in range(500))]], "url string")
    wanted = sorted(map(str, [(i, *brute(u, listed)) for i, u, *_ in rows]))
    # A filter of one block lets nearly everything through: the exact join alone decides.
    for blocks in (1, 1 << 17):
        assert sorted(str(tuple(r)) for r in judge_urls(pages, rules, names, max_blocks=blocks).collect()) == wanted


def test_empty_sides(spark):
    pages = spark.createDataFrame([(1, "http://x.com/de/")], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    names = spark.createDataFrame([], "url string")
    assert [tuple(r) for r in judge_urls(pages, rules, names).collect()] == [(1, "x.com", "/de/", None, "allow")]
    assert judge_urls(pages.limit(0), rules, names).collect() == []
