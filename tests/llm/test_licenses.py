import random
import re

import pytest

from tests.llm.rows import EDGES, documents, lower
from tillsight.llm import licenses
from tillsight.llm.licenses import Template
from tillsight.llm.queries import LICENSES, PHRASES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    found = WORD.findall(lower(text))
    places = {p.label: [i for i in range(len(found)) if found[i : i + len(p.text.split())] == p.text.split()] for p in PHRASES}
    starts = sorted(i for v in places.values() for i in v)
    return len(found), len(starts), starts[0] if starts else None, starts[-1] if starts else None, ",".join(sorted(k for k, v in places.items() if v))


def labels(spark, rows, templates=LICENSES):
    return licenses.label_documents(documents(spark, rows), PHRASES, templates).collect()


def test_base_against_brute_force(spark):
    rng = random.Random(7)
    parts = ["CC", "by", "cc-by", "General", "public", "LICENSE", "all", "rights", "reserved", "é", "x9", "\n", ".", "cc by cc by"]
    rows = list(enumerate(" ".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(400)))
    got = {r.doc_id: r for r in labels(spark, rows)}
    assert len(got) == 400
    for i, text in rows:
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels) == brute(text)
        assert set(filter(None, got[i].base_labels.split(","))) <= set(got[i].labels.split(","))


def test_notices_with_insertions_and_deletions(spark):
    mit = LICENSES[1].text.split()
    changed = " ".join([*mit[:9], "kindly", *mit[9:16], *mit[17:]])
    rows = [(0, "before " * 50 + changed + " after" * 30), (1, " ".join(mit[:10])), (2, "Licensed under CC BY-NC 4.0.")]
    got = {r.doc_id: r for r in labels(spark, rows)}
    assert got[0].labels == "mit" and 0.7 <= got[0].score < 1
    assert got[1].labels == "" and got[1].score == 0
    assert got[2].labels == "cc-by,cc-by-nc-4.0" and got[2].score == 1 and got[2].base_labels == "cc-by"


def test_edges(spark):
    got = labels(spark, EDGES)
    assert len(got) == len(EDGES) and all(r.score == 0 and r.labels == "" for r in got)
    assert labels(spark, []) == []
    with pytest.raises(ValueError):
        labels(spark, [], [Template("none", " . ")])
