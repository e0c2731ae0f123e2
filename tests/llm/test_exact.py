import hashlib
from collections import defaultdict

from tests.llm.rows import EDGES, documents, lower
from tillsight.llm import exact


def expected(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[hashlib.sha256(lower(text).encode()).hexdigest()].append(i)
    return groups


def check(rows, got):
    groups = expected(rows)
    assert len(got) == len(rows)
    for digest, ids in groups.items():
        mine = [r for r in got if r.text_sha256 == digest]
        best = max((i for i in ids if i is not None), default=None)
        assert {r.keep_id for r in mine} == {best} and {r.group_size for r in mine} == {len(ids)}
        assert [r.doc_id for r in mine if r.kept] == [best]


def test_labels_of_edge_cases(spark):
    check(EDGES, exact.duplicate_labels(documents(spark)).collect())


def test_a_frequent_text_is_split_off_with_the_same_result(spark):
    rows = [(i, "Hot TEXT" if i % 3 else f"text {i // 2}") for i in range(9000)]
    docs = documents(spark, rows)
    assert "hot text" in [lower(r[0]) for r in exact.frequent(docs, "text").collect()]
    check(rows, exact.duplicate_labels(docs).collect())
    kept = exact.deduplicate(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(max(v) for v in expected(rows).values())


def test_deduplication_keeps_columns_and_one_of_repeated_rows(spark):
    docs = documents(spark)
    kept = exact.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(max(i for i in v if i is not None) for v in expected(EDGES).values())


def test_empty_table(spark):
    docs = documents(spark, [])
    assert exact.duplicate_labels(docs).collect() == [] and exact.deduplicate(docs).collect() == []


def test_no_python_in_the_plans(spark):
    for frame in (exact.duplicate_labels(documents(spark)), exact.deduplicate(documents(spark))):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
