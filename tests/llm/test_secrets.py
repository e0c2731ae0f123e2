import random
import re
import zlib

from tests.llm.rows import EDGES, documents
from tillsight.llm import secret_scan

BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}


def brute(text):
    found = [(m.start(), k, m.end()) for k, (p, g, n) in enumerate(BASE.values()) for m in p.finditer(text or "") if len(m[g]) >= n]
    return [(list(BASE)[k], a, b) for a, k, b in sorted(found)]


def scanned(spark, texts):
    got = secret_scan.scan(documents(spark, list(enumerate(texts)))).collect()
    return {r.doc_id: [tuple(s) for s in r.spans] for r in got}


def test_base_rules_against_brute_force(spark):
    rng = random.Random(5)
    parts = [
        "password", "PassWD", "secret", "token", "api_key", "apikey", "API-key", "=", ":", " ", "  ", '"', "'", "AKIA", "akia", "AKIAABCDEFGHIJKLMN", "0123456789abcdef",
        "deadbeef" * 4, "hunter2hunter2", "short", "K", "ſecret", "İ", "é😀", "\n", "A/b+c_d.e=f-", "tokentoken",
    ]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(800)]
    got = scanned(spark, texts)
    for i, text in enumerate(texts):
        assert [s for s in got[i] if s[0] in BASE] == brute(text), text


def test_checksums(spark):
    body = "abcdefghijABCDEFGHIJ0123456789"
    good = "ghp_" + body + secret_scan.base62(zlib.crc32(body.encode()), 6)
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    got = scanned(spark, [f"x {good} y", f"x {bad} y", good.replace("ghp_", "npm_"), good + "a"])
    assert got[0] == [("github", 2, 42)] and got[1] == [] and got[2] == [("npm", 0, 40)] and got[3] == []


def test_edges(spark):
    got = secret_scan.scan(documents(spark)).collect()
    assert len(got) == len(EDGES) and all(r.spans == [] for r in got)
    assert secret_scan.scan(documents(spark, [])).collect() == []
