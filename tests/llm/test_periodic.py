import hashlib
import random
import zlib

from tests.llm.rows import documents
from tillsight.llm import periodic, queries


def brute_lyndon(ids, descending):
    signed = [-i for i in ids] if descending else ids

    def longest(i):
        return max(j - i for j in range(i + 1, len(ids) + 1) if all(signed[i:j] < signed[k:j] for k in range(i + 1, j)))

    return [longest(i) for i in range(len(ids))]


def brute_runs(w, min_length, min_periods):
    """Every period in turn: stretches of words that equal the word a period later; the smallest period of a stretch counts."""
    found = {}
    for q in range(1, len(w)):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - start >= q:
                found.setdefault((start, i - start + q), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items() if n >= min_length and n >= min_periods * q)


def test_lyndon_arrays_and_runs_of_small_strings():
    rng = random.Random(1)
    for _ in range(300):
        ids = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(22))]
        for descending in (False, True):
            assert periodic.lyndon_lengths(ids, descending) == brute_lyndon(ids, descending)
        for rule in ((2, 2), (6, 3), (5, 2)):
            assert periodic.runs_of(ids, *rule) == brute_runs(ids, *rule)


def made_texts(rng, count):
    for _ in range(count):
        parts = []
        while len(parts) < rng.randrange(1, 160):
            unit = [rng.choice(["a", "b", "c", "A", "é", "d."]) for _ in range(rng.randrange(1, 12))]
            parts += unit * rng.choice([1, 1, 2, 3, 4, 9])
        yield rng.choice([" ", "\n", " \t"]).join(parts)


def expected(text, min_length=24, min_periods=3):
    w = (text or "").encode().split()
    runs = brute_runs(w, min_length, min_periods)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return len(w), runs, b" ".join(w[i] for i in range(len(w)) if i not in gone).decode()


def test_operator_equals_brute_force_at_several_rules(spark):
    texts = [*made_texts(random.Random(2), 250), None, "", " \n", "x " * 30, "x " * 23, "a " * 24 + "b", "\0 \x1c   " * 12]
    table = documents(spark, list(enumerate(texts))).repartition(3)
    for rule in ((24, 3), (4, 2), (10, 4), (1, 2)):
        got = {r.doc_id: r for r in periodic.periodic_runs(table, *rule).collect()}
        assert len(got) == len(texts)
        for i, text in enumerate(texts):
            n_words, runs, collapsed = expected(text, *rule)
            assert (got[i].n_words, [tuple(r) for r in got[i].runs], got[i].collapsed) == (n_words, runs, collapsed), text


def test_null_ids_repeated_rows_long_texts_and_empty_table(spark):
    long = "lorem ipsum dolor sit amet " * 40_000
    got = periodic.periodic_runs(documents(spark, [(None, None), (1, long), (1, long), (2, "x " * 200_000)]))
    rows = sorted(got.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r.n_words for r in rows] == [0, 200_000, 200_000, 200_000]
    assert [[tuple(x) for x in r.runs] for r in rows] == [[], [(0, 200_000, 5)], [(0, 200_000, 5)], [(0, 200_000, 1)]]
    assert [r.collapsed for r in rows] == ["", "lorem ipsum dolor sit amet", "lorem ipsum dolor sit amet", "x"]
    assert periodic.periodic_runs(documents(spark, [])).count() == 0


def planted(doc_id, text):
    h = zlib.crc32(str(doc_id).encode())
    w = (text or "").encode().split()
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return b" ".join(w).decode()


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = [*enumerate(made_texts(rng, 150)), *((1000 + i, " ".join(rng.choices("abcdefgh", k=rng.randrange(300)))) for i in range(150)), (2000, None), (2001, "")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and sum(r.n_runs > 0 for r in got.values()) > 50

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    for doc_id, text in rows:
        _, runs, collapsed = expected(planted(doc_id, text))
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
        r = got[doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join("%d,%d,%d\n" % x for x in runs)) and r.collapsed_sha256 == sha(collapsed)
