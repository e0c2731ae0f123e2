import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tests.llm.rows import EDGES, documents
from tokenizers import Tokenizer

from tillsight.llm import queries, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
with open(PATH, encoding="utf-8") as file:
    DEFINITION = file.read()
PIECES = ["a", "B", " ", "\t", "\n", " ", "́", "ͅ", "Σ", "ς", "İ", "ß", "'s", "<|endoftext|>", "1", "٣", "é", "é", "ᄀ", "ᅡ", "한", "中", "!", "‍", "😀",
          "\x1c", "\x85", "　", "_", "ǅ", "ı", "K", "Å"]


def library():
    made = Tokenizer.from_file(PATH)
    made.encode_special_tokens = True
    return made


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for high in (1, 2, 300, 49_408, 1 << 32):
        ids = rng.integers(0, high, token_files.BLOCK * 37, dtype=np.uint64).astype(np.uint32)
        ids[::77] = rng.integers(0, 1 << 32, len(ids[::77]), dtype=np.uint64)
        ids[: token_files.BLOCK] = 7
        data, sizes = token_files.pack_blocks(ids)
        assert sizes[0] == 6 and sizes.sum() == len(data)
        assert (token_files.unpack_blocks(data, np.cumsum(sizes) - sizes) == ids).all()
    ids = rng.integers(0, 200, token_files.BLOCK).astype(np.uint32)
    ids[5] = 1 << 30
    assert token_files.pack_blocks(ids)[1][0] == 6 + 16 * 8 + 5  # one exception in place of 30 bits for all


def expected(rows):
    """Rows in order with start, number and digest of ids, by the library itself."""
    made, out, at = library(), [], 0
    for doc_id, text in rows:
        ids = [*made.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("by_word", [True, False])
def test_files_hold_the_library_ids(spark, tmp_path, by_word):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40)))) for i in range(0, 900, 3)]
    folder = token_files.write_tokens(documents(spark, rng.sample(rows, len(rows))), DEFINITION, 2, f"file://{tmp_path}/ids", by_word)
    read = token_files.read_tokens(spark, folder).collect()
    got = sorted((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in read)
    assert got == expected(rows)
    manifest = spark.read.parquet(f"{folder}/manifest").orderBy("file").collect()
    assert len(manifest) > 1
    everything = np.concatenate([np.frombuffer(r.ids, "<u4") for r in sorted(read, key=lambda r: r.start)])
    at = 0
    for row in manifest:  # any part of a file is read without what stands before it
        file = token_files.TokenFile(row.path)
        for _ in range(20):
            a, b = sorted(rng.randint(0, file.n_ids) for _ in range(2))
            assert (file.ids(a, b) == everything[at + a : at + b]).all()
        at += file.n_ids
        file.close()


def test_nulls_ties_repeats_long_texts_and_empty_table(spark):
    read = token_files.read_tokens(spark, token_files.write_tokens(documents(spark), DEFINITION, 2)).collect()
    in_order = sorted(read, key=lambda r: r.start)
    assert [r.doc_id for r in in_order] == sorted((i for i, _ in EDGES), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in in_order] == [sum(x.n_tokens for x in in_order[:i]) for i in range(len(in_order))]
    tokens = {(i, n, c) for i, _, n, c in expected(EDGES)}
    assert {(r.doc_id, r.n_tokens, zlib.crc32(r.ids)) for r in read} == tokens
    assert token_files.read_tokens(spark, token_files.write_tokens(documents(spark, []), DEFINITION, 2)).count() == 0


def test_rows_of_one_id_fill_several_files(spark):
    rows = [(5, "same words here")] * 400 + [(i, f"text {i}") for i in range(20)]
    folder = token_files.write_tokens(documents(spark, rows).repartition(4), DEFINITION, 2)
    manifest = spark.read.parquet(f"{folder}/manifest").collect()
    assert max(r.documents for r in manifest) < 200
    assert sorted(r.doc_id for r in token_files.read_tokens(spark, folder).collect()) == sorted(i for i, _ in rows)


def test_files_of_lost_attempts_are_not_read(spark):
    folder = token_files.write_tokens(documents(spark, [(1, "one"), (2, "two")]), DEFINITION, 2)
    system, path = token_files._opened(folder)
    with system.open_output_stream(f"{path}/ids-0000000-lost.pfor") as out:
        out.write(b"half a fi")
    assert token_files.read_tokens(spark, folder).count() == 2


def test_query_equals_the_library(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join("".join(rng.choices("abcdeE.,'1é", k=rng.randint(1, 9))) for _ in range(rng.randint(0, 60)))) for i in range(300)] + [(300, None)]
    documents(spark, rng.sample(rows, len(rows))).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_token_files(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == expected(rows)


def test_words_of_low_characters_are_split_and_merged_outside_the_library_steps(monkeypatch):
    import pyarrow as pa

    rng = random.Random(12)
    low = [chr(i) for i in (*range(0x21, 0x7F), *range(0xA1, 0x250))]
    texts = [" ".join("".join(rng.choices(low, k=rng.randint(1, 12))) for _ in range(200)) for _ in range(40)] + ["".join(low), "naïve Übung's ½²ªº"]
    made, calls = library(), []
    encoder = token_files._Encoder(DEFINITION, True)
    monkeypatch.setattr(token_files, "LOW", lambda text, match=token_files.LOW: calls.append(bool(match(text))) or calls[-1])
    for column in (["".join(c for c in t if c < "\u0180" and c != "\u0130") for t in texts], texts, ["İ Ǆ e\u0301 中", "Ǉ \u00b5"]):
        encoder._forget()
        counts, ids = encoder(pa.array(column), 2)
        want = [[*made.encode(t, add_special_tokens=False).ids, 2] for t in column]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert set(calls) == {True, False}
    assert token_files._byte_level(texts[-2:]) == [made.pre_tokenizer[1].pre_tokenize_str(t)[0][0] for t in texts[-2:]]


def test_places_by_hash_with_hashes_that_agree_in_upper_bits():
    rng = np.random.default_rng(5)
    for hashes in (rng.integers(0, 1 << 63, 3000, dtype=np.uint64) // 7 * 7, rng.integers(0, 9, 3000, dtype=np.uint64), np.zeros(0, np.uint64), np.ones(1, np.uint64)):
        hashes = np.repeat(hashes, 2)
        order, ordered = token_files._by_hash(hashes)
        assert sorted(order.tolist()) == list(range(len(hashes))) and (hashes[order] == ordered).all()
        assert int((ordered[1:] != ordered[:-1]).sum()) + bool(len(hashes)) == len(np.unique(hashes))


def test_more_words_than_half_a_million_are_learned_once(monkeypatch):
    import pyarrow as pa

    encoder, learned = token_files._Encoder(DEFINITION, True), []
    learn = token_files._Encoder._learn
    monkeypatch.setattr(token_files._Encoder, "_learn", lambda self, words, printable: learned.append(len(words)) or learn(self, words, printable))
    slices = [pa.array([" ".join(f"{i:x}" for i in range(begin, begin + 100_000))]) for begin in range(0, 600_000, 100_000)]
    first = [encoder(column, 2)[1].tolist() for column in slices]
    assert learned == [100_000] * 6
    assert [encoder(column, 2)[1].tolist() for column in slices] == first and len(learned) == 6
    made = library()
    assert first[5] == [*made.encode(slices[5][0].as_py(), add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("hashes", [1, 3, 1 << 62])
def test_words_whose_hashes_agree_keep_their_ids(monkeypatch, hashes):
    import pyarrow as pa

    rng, made, find = random.Random(7), library(), token_files.words

    def clashing(*given):
        found = find(*given)
        found.hashes %= np.uint64(hashes)
        return found

    monkeypatch.setattr(token_files, "words", clashing)
    monkeypatch.setattr(token_files, "REMEMBERED", 90)
    monkeypatch.setattr(token_files, "REMEMBERED_PIECES", 20)
    encoder = token_files._Encoder(DEFINITION, True)
    for _ in range(12):
        texts = [" ".join("".join(rng.choices("abÉ.", k=rng.randint(1, 4))) for _ in range(rng.randint(0, 30))) for _ in range(5)] + [None]
        counts, ids = encoder(pa.array(texts, pa.string()), 2)
        want = [[*made.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
