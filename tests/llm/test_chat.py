import random

from tillsight.llm import chat

SCHEMA = "conv_id long, turn int, role string, text string, turns string, formatted string"
PARTS = ["<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "\\", "<", "[", "|", "/", "s>", "<|next|>", "<|end|>\n", "<|turn:user|>", "a", "é😀", "\n"]


def read(spark, rows):
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return {r.conv_id: r for r in chat.read_chats(chat.format_chats(table)).collect()}


def test_round_trip_of_control_strings(spark):
    rng = random.Random(3)
    make = lambda: "".join(rng.choices(PARTS, k=rng.randint(0, 12)))
    rows = [(c, t, rng.choice(["user", "assistant", "next", make()]), make()) for c in range(60) for t in range(rng.randint(1, 7))]
    got = read(spark, rng.sample(rows, len(rows)))
    for c in range(60):
        mine = [r for r in rows if r[0] == c]
        assert [tuple(t) for t in got[c].turns] == [(r[2], r[3]) for r in mine]
        assert got[c].loss_text == "".join(r[3] for r in mine if r[2] == "assistant")


def test_neighbouring_turns_of_a_role_share_a_block(spark):
    got = read(spark, [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "assistant", "d")])[1]
    assert got.formatted == "<|turn:user|>a<|next|>b<|end|>\n<|turn:assistant|>c<|next|>d<|end|>\n"
    assert [got.formatted[s.start : s.end] for s in got.loss_spans] == ["c", "d"]


def test_nulls_ties_repeats_and_empty_table(spark):
    rows = [(1, 1, "user", None), (1, 1, "user", None), (1, None, None, "first"), (None, 0, "assistant", "x"), (2, 0, "assistant", ""), (3, 5, "user", "x" * 200_000)]
    got = read(spark, rows)
    assert [tuple(t) for t in got[1].turns] == [("", "first"), ("user", ""), ("user", "")]
    assert got[None].loss_text == "x" and got[2].loss_text == "" and [tuple(t) for t in got[2].turns] == [("assistant", "")]
    assert got[3].turns[0].text == "x" * 200_000
    assert read(spark, []) == {}
