import hashlib
import itertools
import random
import re
import zlib

import pytest

from tillsight.llm import conversation_repair as cr
from tillsight.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, fault string, symbols string, audit string"
STRIP = " \t\n\x0b\x0c\r"


def brute(rows, most=3):
    """Cheapest (cost, audit, repaired) over all edit sequences; rows are (role, text, fault)."""
    best = None

    def step(i, cost, audit, out, inserted):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        pattern = "".join(role[:1] or "?" for role, _ in out)
        if not re.fullmatch(r"(s?(ua)*u?)", pattern):
            return
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", pattern) and (best is None or (cost, audit) < best[:2]):
            best = cost, audit, list(out)
        if inserted < most:
            for role in ("user", "assistant"):
                step(i, cost + 2, audit + "I", [*out, (role, "")], inserted + 1)
        if i == len(rows):
            return
        role, text, fault = rows[i]
        step(i + 1, cost + 3, audit + "D", out, 0)
        if fault not in ("blank", "duplicate"):
            extra = fault == "truncated"
            step(i + 1, cost + extra, audit + "K", [*out, (role, text)], 0)
            for new in ("user", "assistant"):
                step(i + 1, cost + extra + 2, audit + "R", [*out, (new, text)], 0)

    step(0, 0, "", [], 0)
    return best


def expected(rows):
    """Figures of one conversation from (turn, role, text) rows."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, marked = set(), []
    for _, role, text in rows:
        last = text.rstrip(STRIP)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else None if last in ".!?" else "truncated"
        seen.add((role, text))
        marked.append((role, text, fault))
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, repaired = brute(marked)
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{f: sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows)),
        "cost": cost, "audit": audit, "repaired": [f"{r}:{t}" for r, t in repaired],
    }


def some_conversations(rng, count, longest=6):
    texts = ["Fine.", "Well!", "no end", "", " \n", "ok?", "ends. ", "a "]
    for c in range(count):
        for turn in range(rng.randint(1, longest)):
            yield c, rng.choice([turn, turn, turn, turn + 3, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "umpire"]), rng.choice(texts)


def test_repairs_equal_brute_force(spark):
    rows = list(some_conversations(random.Random(7), 250))
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    got = {r.conv_id: r for r in cr.repair(table).collect()}
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        want = expected([x[1:] for x in rows if x[0] == c])
        assert {**{k: r[k] for k in want if k != "repaired"}, "repaired": [f"{t.role}:{t.text}" for t in r.repaired]} == want


def test_grammar_gives_what_single_rows_give(spark):
    rng = random.Random(3)
    strings = ["".join(rng.choices("uaUAsSoOx", [8, 8, 1, 1, 1, 1, 1, 1, 1], k=rng.randint(0, 60))) for _ in range(400)] + ["ua" * 300, "u" * 257, "x" * 99]
    rules = cr.grammar(spark.createDataFrame([(s, 1) for s in set(strings)], "symbols string, times long"))
    assert len(rules) == cr.MAX_RULES
    plain, packed = cr.Repairs([]), cr.Repairs(rules)
    assert len(packed.compress("ua" * 300)) < 60
    for s in strings:
        assert packed.cheapest(s) == plain.cheapest(s)


@pytest.mark.parametrize("length", range(5))
def test_all_short_symbol_strings(length):
    repairs = cr.Repairs([("ua", "Ā"), ("ĀĀ", "ā"), ("xx", "Ă"), ("au", "ă")])
    names = {"u": "user", "a": "assistant", "s": "system", "o": "tool", "x": "user"}
    for symbols in itertools.product("uasox" if length > 3 else "uasoxUASO", repeat=length):
        rows = [(names[s.lower()], "t", "blank" if s == "x" else "truncated" if s.isupper() else None) for s in symbols]
        assert repairs.cheapest("".join(symbols)) == brute(rows, 2)[:2]


def test_ropes_compare_as_strings():
    rng = random.Random(1)

    def rope(text):
        if len(text) < 2:
            return text or None
        cut = rng.randint(0, len(text))
        return cr.joined(rope(text[:cut]), rope(text[cut:])) if 0 < cut < len(text) else rope(text[:1]) if len(text) == 1 else cr.joined(text[0], rope(text[1:]))

    for _ in range(500):
        a, b = ("".join(rng.choices("KD", k=rng.randint(0, 7))) for _ in range(2))
        assert cr.less(rope(a), rope(b)) == (a < b) and "".join(cr.letters(rope(a))) == a


def test_nulls_repeats_long_conversations_and_empty_table(spark):
    rows = [(None, None, None, None), (1, 1, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "assistant", "x" * 300_000 + ".")]
    rows += [(2, i, "user" if i % 2 == 0 else "assistant", f"{i}.") for i in range(20_000)] + [(3, 2**63 - 1, "user", "a."), (3, -(2**63), "user", "b.")]
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    got = {r.conv_id: r for r in cr.repair(table).collect()}
    assert (got[None].audit, got[None].cost, got[None].gaps, got[None].blank) == ("D", 3, 0, 1)
    assert (got[1].audit, got[1].duplicate, got[1].cost) == ("KDK", 1, 3)
    assert (got[2].audit, got[2].cost, got[2].illegal) == ("K" * 20_000, 0, 0) and len(got[2].repaired) == 20_000
    assert got[3].illegal == 1 and got[3].gaps == 0  # beyond 64 bits
    assert cr.repair(table.limit(0)).count() == 0


def test_query_equals_brute_force(spark, tmp_path):
    rows = [(c, t, r or None, x or None) for c, t, r, x in some_conversations(random.Random(11), 300, 4)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op13_conversation_repair(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows}
    gone = 0
    for c in got:
        left = []
        for _, turn, role, text in (r for r in rows if r[0] == c):
            kind = zlib.crc32(f"{c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            left += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        want = expected(left)
        gone += not left
        repaired = hashlib.sha256("\n".join(want.pop("repaired")).encode()).hexdigest()
        assert {k: got[c][k] for k in want} == want and got[c].repaired_sha256 == repaired
    assert gone
