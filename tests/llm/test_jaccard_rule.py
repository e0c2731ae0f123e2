"""Other rules than that of op2: five words and 0.8, as in the pipeline, against brute force."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.rows import documents, lower
from tests.llm.test_jaccard import family_rows
from tillsight.llm import jaccard


def brute(rows, rule):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        n = min(rule.shingle, max(len(words), 1))
        sets[i] = frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
    label = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and both and rule.den * both >= rule.num * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {i: low if c == high else c for i, c in label.items()}
    return {i: (len(sets[i]), label[i]) for i in sets}


def scattered(seed):
    """Texts of 50 to 400 words with copies of 1 to 8 scattered one-word replacements, around 0.8 by five words."""
    rng, texts = random.Random(seed), []
    for size in (30, 50, 100, 200, 400):
        base = [f"b{rng.randrange(10**6)}" for _ in range(size)]
        for edits in range(max(2, size // 25) + 2):
            for _ in range(4):
                words = list(base)
                for k in range(edits):
                    words[(k * 2 + 1) * size // (2 * edits)] = f"e{rng.randrange(10**6)}"
                texts.append(" ".join(words))
    rng.shuffle(texts)
    return list(enumerate(texts, 10))


@pytest.mark.parametrize("rule", [jaccard.NEAR, jaccard.Rule(2, 1, 2)])
def test_rules_against_brute_force(spark, rule):
    rows = family_rows(4)[:260] + [(i + 10_000, t) for i, t in scattered(5)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.component_labels(documents(spark, rows), rule).collect()}
    assert got == brute(rows, rule)


def test_the_stage_drops_near_copies_of_five_words_and_four_fifths(spark):
    rows = scattered(6)
    want = brute(rows, jaccard.NEAR)
    kept = sorted(r.doc_id for r in corpus_pipeline.ngram_jaccard(spark, documents(spark, rows), "").collect())
    assert kept == sorted(i for i, (_, c) in want.items() if i == c)
    assert kept != sorted(i for i, (_, c) in brute(rows, jaccard.CONTRACT).items() if i == c)


def test_linked_sets_share_a_list_under_any_rule():
    rng = np.random.default_rng(7)
    for rule in (jaccard.NEAR, jaccard.Rule(3, 1, 2), jaccard.CONTRACT):
        for n in (4, 7, 12, 25, 60, 300):
            for _ in range(100):
                base = rng.integers(0, 2**63, n).astype(np.uint64)
                swap = int(rng.integers(0, rule.apart(2 * n) // 2 + 1))
                other = base.copy()
                other[:swap] = rng.integers(0, 2**63, swap).astype(np.uint64)
                larger = np.concatenate((base, rng.integers(0, 2**63, int(rule.largest(n)) - n).astype(np.uint64)))
                for x in (other, larger):
                    if len(x) + len(base) and set(x.tolist()) != set(base.tolist()):
                        keys, counts = jaccard.part_keys(np.concatenate((np.sort(base), np.sort(x))), np.array([0, n, n + len(x)]), rule)
                        assert set(keys[: counts[0]].tolist()) & set(keys[counts[0] :].tolist())
