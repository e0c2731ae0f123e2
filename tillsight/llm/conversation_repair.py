"""Conversation structure repair: cheapest edits to well-formed turns, by dynamic programming over a grammar.

A repaired conversation has role initials ``(s?(ua)+)?``. Edits: Keep a row (cost 0), Rerole it to user or assistant (2),
Delete it (3), Insert an empty user or assistant turn anywhere (2); a truncated row that is not deleted adds 1, and blank or
repeated rows must be deleted. Of the cheapest edit sequences the one whose initials are ASCII-least is taken.

1. Every row becomes a symbol, for its role's initial and its first fault; a conversation becomes a string of symbols.
2. ``grammar`` finds Re-Pair rules over the distinct strings: Spark counts neighbouring pairs, the most frequent ones that
   cannot overlap become new symbols, round by round, until no pair repeats or ``MAX_RULES`` or ``MAX_ROUNDS`` is reached.
   Symbols left over are simply more factors, so these bounds cost time, never results.
3. Every rule has one min-plus transfer matrix over the states of the role pattern, with the audit of each entry as a rope:
   the product of the matrices of its two halves, made bottom-up once and shared by all conversations. A conversation is the
   product of the matrices of its compressed string. Equally cheap audits of one cell never continue each other (the same
   edits of the same rows end in the same state, and further inserts cost), so the least rope stays least in any context.
   Ropes share their halves, and comparing two skips what they share.

Defined results: rows are ordered by turn (NULL first), then role and text, so ties and repeated rows have one order; a NULL
role or text is empty; rows with a NULL ``conv_id`` form one conversation; an empty table gives an empty result. A
conversation is one value of the result, so its rows meet in one task by the nature of the result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.llm.texts import map_arrow, records_per_batch
from tillsight.session import stage

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES, ACCEPTED = range(4), (START, ASSISTANT)
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
#: Symbols of rows: must go; sound rows by role initial; truncated ones by role initial.
GONE, SOUND, CUT = "x", {"u": "u", "a": "a", "s": "s", "": "o"}, {"u": "U", "a": "A", "s": "S", "": "O"}
WHITE = " \t\n\x0b\x0c\r"
MAX_RULES, MAX_ROUNDS = 256, 12
FIRST_RULE = 0x100  # rule symbols are code points from here on
ROWS_PER_BATCH = 128
REMEMBERED = 1 << 16

Rope = None | str | tuple
Cell = tuple[int, Rope]
Matrix = dict[tuple[int, int], Cell]
Rules = list[tuple[str, str]]


def joined(left: Rope, right: Rope) -> Rope:
    return right if left is None else left if right is None else (left, right)


def letters(rope: Rope) -> Iterator[str]:
    pending = [rope]
    while pending:
        node = pending.pop()
        if isinstance(node, tuple):
            pending += (node[1], node[0])
        elif node is not None:
            yield node


def less(a: Rope, b: Rope) -> bool:
    """Whether rope ``a`` spells a smaller string than ``b``."""
    left, right = [a] if a is not None else [], [b] if b is not None else []
    while left and right:
        x, y = left.pop(), right.pop()
        if x is y:
            continue
        if isinstance(x, tuple):
            left += (x[1], x[0])
            right.append(y)
        elif isinstance(y, tuple):
            left.append(x)
            right += (y[1], y[0])
        elif x != y:
            return x < y
    return bool(right) and not left


def _lower(cells: Matrix, at: tuple[int, int], cost: int, rope: Rope) -> None:
    known = cells.get(at)
    if known is None or cost < known[0] or (cost == known[0] and less(rope, known[1])):
        cells[at] = (cost, rope)


def product(left: Matrix, right: Matrix) -> Matrix:
    """Min-plus product; ties go to the smaller audit."""
    out: Matrix = {}
    for (a, b), (cost, rope) in left.items():
        for c in STATES:
            if (b, c) in right:
                more, rest = right[b, c]
                _lower(out, (a, c), cost + more, joined(rope, rest))
    return out


def _next(state: int, role: str) -> int | None:
    """State after a turn whose role has that initial, or None where it may not stand."""
    if role == "u":
        return None if state == USER else USER
    if role == "a":
        return ASSISTANT if state == USER else None
    return SYSTEM if role == "s" and state == START else None


def _inserts() -> Matrix:
    """Up to two inserted turns; more would only go in circles."""
    out: Matrix = {(s, s): (0, None) for s in STATES}
    for state in STATES:
        at, rope = state, None
        for times in (1, 2):
            at, rope = (ASSISTANT if at == USER else USER), joined(rope, INSERT)
            if at != state:
                _lower(out, (state, at), times * INSERT_COST, rope)
    return out


INSERTS = _inserts()


def _row(symbol: str) -> Matrix:
    """Inserts before a row, then the row's own edit."""
    edits: Matrix = {(s, s): (DELETE_COST, DELETE) for s in STATES}
    if symbol != GONE:
        extra = TRUNCATED_COST if symbol.isupper() else 0
        for state in STATES:
            for role, edit, cost in ((symbol.lower(), KEEP, 0), ("u", REROLE, REROLE_COST), ("a", REROLE, REROLE_COST)):
                after = _next(state, role)
                if after is not None:
                    _lower(edits, (state, after), cost + extra, edit)
    return product(INSERTS, edits)


ROWS = {symbol: _row(symbol) for symbol in (GONE, *SOUND.values(), *CUT.values())}


class Repairs:
    """Matrices of all rules, and the cheapest edits of symbol strings."""

    def __init__(self, rules: Rules) -> None:
        self.rules = rules
        self.of = dict(ROWS)
        for pair, symbol in rules:
            self.of[symbol] = product(self.of[pair[0]], self.of[pair[1]])

    def compress(self, symbols: str) -> str:
        for pair, symbol in self.rules:
            symbols = symbols.replace(pair, symbol)
        return symbols

    def _matrix(self, symbols: str) -> Matrix:
        if len(symbols) < 2:
            return self.of[symbols] if symbols else {(s, s): (0, None) for s in STATES}
        half = len(symbols) // 2
        return product(self._matrix(symbols[:half]), self._matrix(symbols[half:]))

    def cheapest(self, symbols: str) -> tuple[int, str]:
        """Cost and audit of the whole string."""
        best: Matrix = {}
        for (begin, end), (cost, rope) in product(self._matrix(self.compress(symbols)), INSERTS).items():
            if begin == START and end in ACCEPTED:
                _lower(best, (START, START), cost, rope)
        cost, rope = best[START, START]
        return cost, "".join(letters(rope))


def apply_audit(audit: str, turns: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The turns after the edits of an audit."""
    out, state, rest = [], START, iter(turns)
    for edit in audit:
        role, text = ("", "") if edit == INSERT else next(rest)
        if edit == DELETE:
            continue
        if edit == KEEP:
            state = _next(state, role[:1])
        else:
            state = ASSISTANT if state == USER else USER
            role = ROLE_OF[state]
        out.append((role, text))
    return out


def faults(turns: DataFrame) -> DataFrame:
    """Rows with ``seen`` (which of equal role and text it is) and their first ``fault``: blank, duplicate, truncated or NULL.

    Rows of a conversation are brought together here, once; what follows reuses that exchange.
    """
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    last = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    earlier = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    counted = clean.repartition("conv_id").withColumn("seen", F.row_number().over(earlier))
    fault = F.when(last == "", "blank").when(F.col("seen") > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    return counted.withColumn("fault", fault)


def _symbol(turn: Column) -> Column:
    initial = F.substring(turn["role"], 1, 1)
    sound = F.when(initial.isin("u", "a", "s"), initial).otherwise(SOUND[""])
    gone, cut = turn["fault"].isin("blank", "duplicate"), turn["fault"] == "truncated"
    return F.when(gone, GONE).when(cut, F.upper(sound)).otherwise(sound)


def _with_fault(fault: str) -> Callable[[Column], Column]:
    return lambda turn: turn["fault"] == fault


def conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: its ordered ``turns`` (turn, role, text, seen, fault), figures of its state, and its ``symbols``.

    ``gaps`` are turn numbers missing between the first and the last; ``blank``, ``duplicate`` and ``truncated`` count rows by
    first fault; ``illegal`` counts neighbours whose role initials are not su, ua or au.
    """
    row = F.struct("turn", "role", "text", "seen", "fault")
    ordered = faults(turns).groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    numbers = F.array_distinct(F.filter(F.transform("turns", lambda t: t["turn"].cast("decimal(20,0)")), lambda n: n.isNotNull()))
    missing = F.array_max(numbers) - F.array_min(numbers) + 1 - F.size(numbers)
    initials = F.transform("turns", lambda t: F.substring(t["role"], 1, 1))
    pairs = F.greatest(F.size("turns") - 1, F.lit(0))
    neighbours = F.zip_with(F.slice(initials, F.lit(1), pairs), F.slice(initials, F.lit(2), pairs), lambda a, b: F.concat(a, b))
    counted = [F.size(F.filter("turns", _with_fault(f))).cast("long").alias(f) for f in ("blank", "duplicate", "truncated")]
    illegal = F.size(F.filter(neighbours, lambda pair: ~pair.isin("su", "ua", "au"))).cast("long")
    return ordered.select(
        "conv_id", "turns", F.coalesce(missing.try_cast("long"), F.lit(0)).alias("gaps"), *counted, illegal.alias("illegal"),
        F.array_join(F.transform("turns", _symbol), "").alias("symbols"),
    )


def grammar(strings: DataFrame) -> Rules:
    """Re-Pair rules (pair, new symbol) over distinct ``symbols``, each counted ``times``."""
    rules: Rules = []
    for _ in range(MAX_ROUNDS):

        def count(batches: Iterator[pa.RecordBatch], known: Rules = tuple(rules)) -> Iterator[pa.RecordBatch]:
            seen: Counter = Counter()
            for batch in batches:
                for symbols, times in zip(batch.column("symbols").to_pylist(), batch.column("times").to_pylist(), strict=True):
                    for pair, symbol in known:
                        symbols = symbols.replace(pair, symbol)
                    for pair, often in Counter(map("".join, zip(symbols, symbols[1:], strict=False))).items():
                        seen[pair] += often * times
            if seen:  # one row for each pair of symbols at most
                yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["pair", "times"])

        pairs = map_arrow(strings, count, "pair string, times long").groupBy("pair").agg(F.sum("times").alias("times"))
        firsts, seconds = set(), set()
        fresh = []
        for pair, _ in pairs.where("times > 1").orderBy(F.desc("times"), "pair").limit(MAX_RULES).collect():
            if pair[0] not in seconds and pair[1] not in firsts and len(rules) + len(fresh) < MAX_RULES:
                firsts.add(pair[0])
                seconds.add(pair[1])
                fresh.append((pair, chr(FIRST_RULE + len(rules) + len(fresh))))
        if not fresh:
            break
        rules += fresh
    return rules


def repair(turns: DataFrame) -> DataFrame:
    """``conversations`` with ``cost``, ``audit`` (initials of the cheapest edits) and ``repaired`` (array of role, text)."""
    found = stage(conversations(turns), "conversations")
    strings = stage(found.groupBy("symbols").agg(F.count("*").alias("times")), "symbol-strings")
    rules = grammar(strings)
    kind = found.schema["conv_id"].dataType.simpleString()
    carried = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal"]

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairs, known = Repairs(rules), {}
        for batch in batches:
            costs, audits, repaired = [], [], []
            for symbols, listed in zip(batch.column("symbols").to_pylist(), batch.column("turns"), strict=True):
                if symbols not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[symbols] = repairs.cheapest(symbols)
                cost, audit = known[symbols]
                costs.append(cost)
                audits.append(audit)
                repaired.append([{"role": r, "text": t} for r, t in apply_audit(audit, [(t["role"], t["text"]) for t in listed.as_py()])])
            turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            columns = [pa.array(costs, pa.int64()), pa.array(audits, pa.string()), pa.array(repaired, turn)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *columns], [*carried, "cost", "audit", "repaired"])

    figures = ", ".join(f"{c} long" for c in carried[1:])
    with records_per_batch(turns.sparkSession, ROWS_PER_BATCH):
        narrow = found.select(*carried, "symbols", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
        return map_arrow(narrow, mend, f"conv_id {kind}, {figures}, cost long, audit string, repaired array<struct<role:string,text:string>>")
