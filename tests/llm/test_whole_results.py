"""Rows that must not be missing from results."""

from tests.llm.rows import documents
from tillsight.llm import language, quality
from tillsight.llm.queries import op6_quality

DATA = "/root/testdata/sf0.01"


def test_texts_too_short_for_an_n_gram_stay(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language.fit(docs.where(~language.held_out(docs)))
    rows = [(1, "Yes"), (2, "Oui"), (3, "a"), (4, "12"), (5, ""), (6, None), (7, "русский текст")]
    assert sorted(r.doc_id for r in language.identified(documents(spark, rows), model).collect()) == [1, 2, 3]


def test_the_quality_query_has_a_row_for_every_document(spark):
    got = op6_quality(spark, DATA).collect()
    assert len(got) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert {r.selected for r in got} == {True, False}
    assert all(r.selected == (r.tail_probability >= quality.SELECT_AT) for r in got)
