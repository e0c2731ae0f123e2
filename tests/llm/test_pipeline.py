import hashlib

import pytest

import corpus_pipeline
from tests.llm.rows import documents, lower
from tests.llm.test_bpe import WHOLE
from tests.llm.test_jaccard import brute
from tillsight.llm import queries

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Real documents with planted copies, near copies, leaks and texts in no language."""
    folder = tmp_path_factory.mktemp("corpus")
    real = spark.read.parquet(f"{DATA}/documents.parquet").limit(250).collect()
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first().text
    long = next(r.text for r in real if len(r.text.split()) > 150)
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in real]
    extra = [long.upper(), long.replace(long.split()[70], "changedword", 1), f"{real[0].text} {item} {real[1].text}", "12345 ???", None, ""]
    rows += [(10_000 + i, t, None, "planted", len(t or "")) for i, t in enumerate(extra)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_against_brute_force(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{planted}/benchmark.parquet").collect()]
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "ngram_jaccard", "decontamination", "byte_bpe"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    texts = {i: t for i, t in texts.items() if t and any(map(str.isalpha, t))}
    last = {}
    for i in sorted(texts):
        last[lower(texts[i])] = i
    texts = {i: texts[i] for i in last.values()}
    texts = {i: texts[i] for i, (_, c) in brute(list(texts.items())).items() if c == i}
    texts = {i: t for i, t in texts.items() if not any(x in t for x in items)}
    got = corpus_pipeline.run(spark, planted).collect()
    assert {r.doc_id: (r.n_tokens, r.ids, r.decoded_sha256) for r in got} == {
        i: (len(ids := WHOLE.encode_ordinary(t)), ids, hashlib.sha256(t.encode()).hexdigest()) for i, t in texts.items()
    }
    assert not {10_002, 10_003, 10_004, 10_005} & set(texts)


def test_stages_keep_the_columns_of_documents(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, planted).columns == docs.columns


def test_queries_are_registered():
    assert sorted(queries.register()) == sorted([
        "op1_decontamination", "op2_ngram_jaccard", "op3_byte_bpe", "op4_exact_dedup", "op5_language_id", "op6_quality", "op7_chat_format",
        "op8_secret_scan", "op9_url_filter", "op10_license_scan",
    ])


def test_clashing_columns_pass_through(spark):
    docs = documents(spark)
    from tillsight.llm import exact, jaccard

    assert exact.deduplicate(docs).columns == docs.columns and jaccard.representatives(docs).columns == docs.columns
