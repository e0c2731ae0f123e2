import random

from tillsight.llm import urls
from tillsight.llm.bloom import build

RULES = [("com", "/", "allow"), ("Example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), (None, "/", "block")]
OTHER = [("ads.org", "/", "block"), ("org", "/x", "block"), ("com", "/", "block")]
SCHEMA = "host string, path string, verdict string"


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    for level, rules in enumerate((RULES, OTHER)):
        fits = [(len(h + p), len(h), h.lower() + p, v) for h, p, v in rules if h and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
        if fits:
            best = max(fits)
            return host, path, best[2] if level == 0 else None, best[3]
    return host, path, None, "allow"


def test_against_brute_force(spark):
    rng = random.Random(1)
    made = [
        f"{s}{''.join(rng.sample(['www.', 'a.', ''], 1))}{h}{p}" for s in ("http://", "HTTPS://", "", "x://y://")
        for h in ("example.com", "EXAMPLE.com", "notexample.com", "com", "ads.org", "bads.org", "é.org", "")
        for p in ("", "/", "/en/", "/en", "/en/a?b#c", "?/en/", "#x", "/xy", "/a\n/b")
    ]
    pages = [(i, u) for i, u in enumerate([*made, None, "", "nothing", made[0]])] + [(None, "http://a.com/")] * 2
    table = spark.createDataFrame([(i, u, "x", "y") for i, u in pages], "page_id long, url string, row string, verdict string")
    got = urls.judge(table, spark.createDataFrame(RULES, SCHEMA), spark.createDataFrame(OTHER, SCHEMA)).collect()
    key = lambda r: tuple(("" if v is None else str(v)) for v in r)
    assert sorted(map(key, got)) == sorted(key((i, *brute(u))) for i, u in pages)


def test_empty_table_and_list(spark):
    none = spark.createDataFrame([], SCHEMA)
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert urls.judge(pages, none, none).first().verdict == "allow"
    assert urls.judge(pages.limit(0), none, none).collect() == []


def test_filter_has_no_false_negative_and_few_false_positives(spark):
    import numpy as np

    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 20_000)
    bloom = build(spark.createDataFrame([(int(k),) for k in keys], "hash long"), 1 << 19)
    assert bloom.maybe(keys.view(np.uint64)).all()
    other = np.random.default_rng(2).integers(0, 2**63, 100_000).astype(np.uint64)
    assert bloom.maybe(other).mean() < 0.01
