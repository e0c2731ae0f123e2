"""Language and quality models: accuracy on rows kept from training, and edge cases."""

from pyspark.sql import functions as F

from tests.llm.rows import EDGES, documents
from tillsight.llm import language, quality
from tillsight.llm.queries import op5_language_id

DATA = "/root/testdata/sf0.01"


def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = op5_language_id(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out]
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language.fit(docs.where(~language.held_out(docs)))
    assert sorted(model.languages) == model.languages and (model.false_rate < 0.2).all()
    got = language.predict(documents(spark), model).collect()
    assert len(got) == len(EDGES)
    assert {r.lang_pred for r in got if r.doc_id in (3, 4, 5)} == {"und"} and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert language.predict(documents(spark, []), model).collect() == []
    kept = language.identified(documents(spark, [(1, None), (2, "123 !"), (3, "русский текст"), (4, docs.first().text)]), model)
    assert [r.doc_id for r in kept.collect()] == [4] and kept.columns == documents(spark).columns
    nothing = language.fit(documents(spark).withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language.predict(documents(spark), nothing).collect()} == {"und"}


def test_false_positives_are_corrected():
    import numpy as np

    model = language.assemble([("a", g) for g in range(1000)] + [("b", g) for g in range(5000, 5100)], {"a": 1, "b": 1})
    values = np.arange(1000).astype(np.uint32)
    counts = model.counts(values, np.array([0, 1000]))
    assert abs(counts[0, 0] - 1000) < 1 and counts[0, 1] < 1


def test_quality_orders_grades_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    grades = labels.select("doc_id", F.when(F.col("toxic") == 1, 0).otherwise(F.col("quality") + 1).alias("grade"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    model = quality.fit(docs, grades.where(~held), levels=3)
    assert (model.thresholds[1:] >= model.thresholds[:-1]).all()
    got = quality.grade(docs, model).join(grades.where(held), "doc_id").collect()
    mean = {g: sum(r.expected_grade for r in got if r.grade == g) / sum(r.grade == g for r in got) for g in (0, 1, 2)}
    assert mean[0] < mean[2] and mean[1] < mean[2]
    good = [r for r in got if r.grade == 2]
    assert sum(r.tail_probability >= quality.SELECT_AT for r in good) / len(good) > 0.75
    assert all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in got)


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 2), (2, 0), (2, 0), (3, 1), (None, 1), (4, None), (5, 9), (77, 1)], "doc_id long, grade int")
    model = quality.fit(documents(spark), labels, levels=3)
    got = quality.grade(documents(spark), model).collect()
    assert len(got) == len(EDGES) and all(r.expected_grade is not None for r in got)
    assert quality.grade(documents(spark, []), model).collect() == []
    none = quality.fit(documents(spark), labels.limit(0), levels=3)
    assert {r.expected_grade for r in quality.grade(documents(spark), none).collect()} == {0.0}


def test_thresholds_separate_a_single_feature():
    import numpy as np

    rows = [np.array([k]) for k in (0, 1, 2) for _ in range(30)]
    grades = np.repeat([0, 1, 2], 30)
    weights, thresholds = quality.descend(rows, grades, np.zeros(3), np.array([-0.5, 0.5]))
    model = quality.Model(np.arange(3).astype(np.uint64), weights, thresholds)
    expected = model.tails(model.scores(np.arange(3).astype(np.uint64), np.arange(4))).sum(axis=1)
    assert expected[0] < 0.5 < 0.7 < expected[1] < 1.3 < 1.5 < expected[2]
