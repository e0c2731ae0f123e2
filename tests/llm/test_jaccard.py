import collections
import random
import re

import numpy as np
import pytest

from tests.llm.rows import EDGES, documents, lower
from tillsight.llm import jaccard, texts
from tillsight.llm.components import components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if len(words) >= 3:
        return frozenset(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    return frozenset([tuple(words)] if words else [])


def brute(rows):
    """(n_shingles, component) by id, comparing all pairs of sets."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {i: (len(sets[i]), find(i)) for i in sets}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(rng.randint(0, edits)):
        i, kind = rng.randrange(len(words)), rng.random()
        if kind < 0.4:
            words[i] = f"w{rng.randrange(500)}"
        elif kind < 0.6 and len(words) > 1:
            del words[i]
        elif kind < 0.8:
            words.insert(i, f"w{rng.randrange(500)}")
        else:
            words[i : i + 2] = [f"x{rng.randrange(9)}"]
    return " ".join(words)


def family_rows(seed):
    """Families around the threshold, each with a second family grown from a changed base."""
    rng, texts = random.Random(seed), []
    for size in (5, 12, 20, 40, 90, 150):
        base = [f"b{rng.randrange(3000)}" for _ in range(size)]
        texts += [edited(rng, base, max(2, size // 25)) for _ in range(40)]
        other = [f"s{i}" if i % 13 == 5 else w for i, w in enumerate(base)]
        texts += [edited(rng, other, max(2, size // 40)) for _ in range(30)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(80)) for _ in range(60)]
    texts += ["", None, "one", "two words", "TWO words", "  ", "one"]
    rng.shuffle(texts)
    return list(enumerate(texts, 10))


def test_families_against_brute_force(spark):
    rows = family_rows(1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.component_labels(documents(spark, rows)).collect()}
    want = brute(rows)
    assert got == want
    assert collections.Counter(c for _, c in want.values()).most_common(1)[0][1] > 20


def test_large_id_tables_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(texts, "BROADCAST_ROWS", 0)
    rows = family_rows(3)[:200]
    want = brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.component_labels(documents(spark, rows)).collect()} == want
    assert sorted(r.doc_id for r in jaccard.representatives(documents(spark, rows)).collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_sets_that_agree_in_empty_parts_only_meet_in_another_cut():
    rng = np.random.default_rng(5)
    for n in (10, 14, 20, 40):
        h = (2 * n) // 19
        for _ in range(300):
            base = np.sort(rng.integers(0, 2**63, n).astype(np.uint64))
            other = base.copy()
            other[rng.choice(n, h // 2, replace=False)] = rng.integers(0, 2**63, h // 2).astype(np.uint64)
            other = np.sort(other)
            keys, counts = jaccard.part_keys(np.concatenate((base, other)), np.array([0, n, 2 * n]))
            assert not counts.any() or set(keys[: counts[0]].tolist()) & set(keys[counts[0] :].tolist())


def test_exactly_at_the_threshold(spark):
    words = [f"v{i}" for i in range(21)]  # 19 shingles
    inside = " ".join([*words, "extra"])  # 19 of 20 are common
    rows = [(1, " ".join(words)), (2, inside), (3, " ".join([*words, "a", "b"])), (4, " ".join([*words, "c", "d", "e"]))]
    got = {r.doc_id: r.component_id for r in jaccard.component_labels(documents(spark, rows)).collect()}
    assert got == {i: c for i, (_, c) in brute(rows).items()} and got[3] == 1 and got[4] == 4


def test_edges(spark):
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.component_labels(documents(spark)).collect())
    sizes = {t: len(shingles(t)) for _, t in EDGES}
    low = {}
    for i, t in EDGES:
        if i is not None and sizes[t]:
            low[lower(t)] = min(i, low.get(lower(t), i))
    want = collections.Counter((i, sizes[t], low.get(lower(t)) if sizes[t] else i) for i, t in EDGES)
    assert got == want
    assert jaccard.component_labels(documents(spark, [])).collect() == []


def test_one_document_of_each_group_stays(spark):
    rows = family_rows(2)[:150] + [(None, "x y z"), (None, None)]
    docs = documents(spark, rows)
    kept = jaccard.representatives(docs)
    want = brute([r for r in rows if r[0] is not None])
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([str(i) for i, (_, c) in want.items() if c == i] + ["None", "None"])


def test_components_of_long_paths(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(200)] + [(500, 400), (400, 450), (450, 500), (7, 7)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 450: 400, 500: 400}


@pytest.mark.parametrize("limit", [0, 10**6])
def test_a_hot_list_is_no_hot_partition(spark, monkeypatch, limit):
    """A third of all sets in one list: pivots come from a merged aggregation, and no exchange by list holds rows that cannot be split."""
    monkeypatch.setattr(texts, "BROADCAST_ROWS", limit)
    reps = spark.range(3000).selectExpr("id AS rep", "array(IF(id % 3 = 0, 7L, id + 100), id + 100000) AS keys")
    pairs = jaccard._star_pairs(reps)
    plan = pairs._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "REPARTITION_BY" not in plan
    assert {tuple(r) for r in pairs.collect()} == {(0, x) for x in range(3, 3000, 3)}


def test_blocks_hold_one_component_each(spark):
    """A thousand members of one component and one of another in a list: a thousand pairs, none inside the component."""
    schema = "p long, g long, x long, nx long, d long, linked boolean, at long"
    entries = spark.createDataFrame([(0, 1, x, 400, 20, False, 0) for x in range(1, 1001)] + [(0, 1, 5000, 400, 20, False, 0)], schema)
    labels = spark.createDataFrame([(x, 1) for x in range(1, 1001)], "node long, component long")
    pairs = {tuple(r) for r in jaccard._open_pairs(entries, labels, jaccard.CONTRACT).collect()}
    assert pairs == {(0, x, 5000) for x in range(1, 1001)}


@pytest.mark.parametrize("hot", [1, 10**9])
def test_entries_of_lists_move_once(spark, monkeypatch, hot):
    """However many lists there are, and with hot ones summed up where their rows lie."""
    monkeypatch.setattr(texts, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(jaccard, "HOT", hot)
    reps = spark.range(3000).selectExpr("id AS rep", "array(IF(id % 3 = 0, 7L, id + 100), id div 2 + 100000) AS keys")
    pairs = jaccard._star_pairs(reps)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(key") == 1 and "SortMergeJoin" not in plan
    assert {tuple(r) for r in pairs.collect()} == {(0, x) for x in range(3, 3000, 3)} | {(x, x + 1) for x in range(0, 3000, 2)}


@pytest.mark.parametrize("hot", [1, 4])
def test_frequent_elements_give_the_same_components(spark, monkeypatch, hot):
    monkeypatch.setattr(jaccard, "HOT", hot)
    rows = family_rows(4)[:200]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.component_labels(documents(spark, rows)).collect()} == brute(rows)


def test_only_members_of_a_pair_are_moved(spark):
    """Few pairs meet the members by a broadcast, whatever the members' size."""
    schema = "p long, x long, nx long, d long, diff array<long>"
    members = spark.createDataFrame([(0, x, 100, 3, [1, 2, x]) for x in range(3, 200)], schema)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links = jaccard._sides(spark.createDataFrame([(0, 5, 9)], "p long, x long, y long"), members, jaccard.CONTRACT)
        plan = links._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert plan.count("BroadcastHashJoin") == 2
    assert [tuple(r) for r in links.collect()] == [(5, 9)]
