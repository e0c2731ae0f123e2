import random

import pytest

from tests.llm.rows import EDGES, documents
from tillsight.llm import decontaminate, texts

QUESTION = "A train leaves Boston at 9 and travels 120 km while the other train leaves Denver with 35 passengers on board today"
ITEMS = [
    (1, QUESTION),
    (2, "the quick brown fox jumps over the lazy dog near the old stone bridge every single morning in spring"),
    (3, "five little words here now"),
    (4, "too short"),
    (5, None),
    (6, ""),
    (7, "Maria has 5 apples and gives 5 apples to John before Maria leaves the small market"),
]


def found(spark, texts, items=ITEMS):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(documents(spark, list(enumerate(texts))), bench).collect()
    return {(r.doc_id, r.item_id): r for r in got}


def test_verbatim_passages_in_any_case_and_spacing(spark):
    noise = "lorem ipsum dolor sit amet consectetur "
    got = found(spark, [noise + QUESTION + " " + noise, QUESTION.upper(), ITEMS[1][1].replace(" ", ",\n"), " ".join(ITEMS[1][1].split()[4:15]), noise * 50])
    assert set(got) == {(0, 1), (1, 1), (2, 2), (3, 2)}
    assert got[0, 1].verbatim and got[0, 1].coverage == 1 and got[1, 1].verbatim


def test_other_slot_values_are_caught_while_names_map_one_to_one(spark):
    other = QUESTION.replace("Boston", "Paris").replace("Denver", "Lyon").replace("120 km", "3,500.25 miles").replace("35", "77")
    apples = ITEMS[6][1]
    consistent = apples.replace("Maria", "Paula").replace("5", "8").replace("John", "Peter")
    mixed = apples.replace("gives 5", "gives 9").replace("before Maria", "before Susan").replace("has 5", "has 3").replace("apples to", "pears to")
    swapped = consistent.replace("gives 8", "gives 9")
    got = found(spark, ["x " + other, "x " + consistent, "x " + mixed, "x " + swapped])
    assert set(got) == {(0, 1), (1, 7), (3, 7)}  # numbers are drawn independently
    assert not got[0, 1].verbatim and not got[1, 7].verbatim


def test_short_items_must_occur_whole(spark):
    got = found(spark, ["so five little words here now end", "five little words here", "too short"])
    assert set(got) == {(0, 3)}


def brute_windows(text, size=8):
    words = decontaminate_words(text)
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


def decontaminate_words(text):
    import re

    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())


def test_random_passages_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "ü1"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(8, 30)))) for i in range(40)]
    texts = []
    for _ in range(120):
        words = rng.choices(vocabulary, k=40)
        item = rng.choice(items)[1].split()
        a = rng.randrange(len(item) - 7)
        words[20:20] = item[a : a + rng.randint(6, 20)]
        texts.append(" ".join(words))
    want = set()
    for d, text in enumerate(texts):
        places = {}
        for at, w in enumerate(brute_windows(text)):
            places.setdefault(w, []).append(at)
        for i, item in items:
            windows = brute_windows(item)
            diagonals = {}
            for k, w in enumerate(windows):
                for at in places.get(w, []):
                    diagonals.setdefault(at - k, set()).add(k)
            if any(len(v) >= min(3, len(windows)) for v in diagonals.values()):
                want.add((d, i))
    assert set(found(spark, texts, items)) == want and want


def test_edges_and_removal(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.leaks(documents(spark), bench).collect() == []
    assert decontaminate.leaks(documents(spark, []), bench).collect() == []
    assert decontaminate.leaks(documents(spark), bench.limit(0)).collect() == []
    docs = documents(spark, [*EDGES, (50, "y " + QUESTION), (None, QUESTION), (51, "clean text")])
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i in [*[i for i, _ in EDGES], 51])


def test_large_lists_of_leaks_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(texts, "BROADCAST_ROWS", 0)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents(spark, [(50, QUESTION), (None, QUESTION), (51, "clean text"), (None, "clean too")])
    assert sorted(str(r.doc_id) for r in decontaminate.decontaminate(docs, bench).collect()) == ["51", "None"]


@pytest.mark.parametrize("bits", [512, 1 << 24])
def test_a_full_filter_changes_nothing(spark, bits):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.leaks(documents(spark, [(0, QUESTION), (1, "nothing of the kind is said in this text at all")]), bench, bits).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(0, 1)]
