import random

import public_tokenizers
import pytest
import tiktoken

from tests.llm.rows import EDGES, documents
from tillsight.llm import bpe

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
WHOLE = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def run(spark, rows):
    encoded = bpe.encode(documents(spark, rows), RANKS, public_tokenizers.PATTERN)
    return bpe.decode(encoded, RANKS).collect()


def check(rows, got):
    want = sorted((str(i), WHOLE.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    assert sorted((str(r.doc_id), r.ids, bytes(r.decoded)) for r in got) == want


def test_edges_and_round_trip(spark):
    check(EDGES, run(spark, EDGES))
    assert run(spark, []) == []


def test_random_texts_in_small_blocks(spark, monkeypatch):
    rng = random.Random(2)
    parts = ["the", " The", "'s", "'", " '", "  ", "\n\n", "\t", "é", "😀", "日本語", "\u00a0", "\x1c", "123", " 4", "$$", "<|endoftext|>", "İ", "a\u0301"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 60)))) for i in range(300)]
    whole = run(spark, rows)
    check(rows, whole)
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 200)
    check(rows, run(spark, rows))


def test_unknown_ids_raise(spark):
    with pytest.raises(Exception, match="no token"):
        bpe.decode(spark.createDataFrame([([50256],)], "ids array<int>"), {**RANKS, b"\xff\xfe\xfd": 50300}).collect()


def test_numbers_pack():
    import numpy as np

    values = np.array([0, 1, 255, 256, 70_000, 2**32 - 1], np.uint32)
    assert bpe.unpack(bpe.pack(values)).tolist() == values.tolist() and bpe.unpack(bpe.pack(values[:0])).tolist() == []


def test_the_ascii_form_of_the_pattern_splits_alike():
    import regex

    rng = random.Random(8)
    whole, plain = regex.compile(public_tokenizers.PATTERN), bpe.ascii_pattern(public_tokenizers.PATTERN)
    for _ in range(3000):
        text = "".join(rng.choices([chr(i) for i in range(128)] + ["'s", "'ll", "  ", " a", " 1", "\r\n"], k=rng.randint(0, 30)))
        assert plain.findall(text) == whole.findall(text), text
    assert bpe.ascii_pattern(r"\p{Lu}+|[a-z]+") is None and bpe.ascii_pattern(r"(?i:x)|\s+") is None


def test_words_with_equal_hashes_have_one_order(monkeypatch):
    import numpy as np

    monkeypatch.setattr(bpe, "hash_spans", lambda data, starts, ends, fold: np.zeros(len(starts), np.uint64))
    one, two = bpe.Vocabulary(["b", "a", "c"], 4), bpe.Vocabulary(["c", "b", "a"], 4)
    assert list(map(str, one.by_bucket())) == list(map(str, two.by_bucket()))


def test_texts_are_split_in_one_scan_that_both_sides_read(spark):
    rows = [(i, f"some words {i} and others") for i in range(40)]
    encoded = bpe.encode(documents(spark, rows), RANKS, public_tokenizers.PATTERN)
    assert {r.doc_id: r.ids for r in encoded.collect()} == {i: WHOLE.encode_ordinary(t) for i, t in rows}
    done = encoded._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert done.count("MapInArrow deal") == 1 and "ReusedExchange" in done


def test_words_of_a_bucket_are_merged_once():
    import numpy as np

    calls = []

    class Counted:
        def encode_ordinary(self, word):
            calls.append(word)
            return WHOLE.encode_ordinary(word)

    known, words = bpe._Merged(Counted()), [b" the", b"xqz", "é".encode(), b" the"]
    for chosen in (words, words[1:], []):
        lengths = np.array([len(w) for w in chosen], np.uint32)
        counts, ids = known.ids_of(lengths, b"".join(chosen))
        want = [WHOLE.encode_ordinary(w.decode()) for w in chosen]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert sorted(calls) == [" the", "xqz", "é"]
