"""Exact order statistics without sorting: a mergeable sketch brackets each wanted position, counts place it, and only what lies inside is ranked.

A round takes two aggregations over the rows, both merged on the map side: quantile sketches give a pair of values around each
wanted position, and exact counts below and between them tell where the position falls. Whatever the sketch's error, a
bracket is kept only if the counts put the position inside it. A round leaves a few thousandths of the rows between the pair,
so rounds repeat on these until at most ``INSIDE`` rows are left, which one window ranks. If
more rows than that share one value, their keys are selected in the same way, a few bytes at a time.

What reaches the driver are the wanted positions and their brackets, a few numbers each.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The sketches' rank error is one in so many; brackets reach twice as far to both sides.
ACCURACY = 1000
#: Rows that one window ranks for one position.
INSIDE = 100_000
CHUNK = 6  # bytes of a key that a double holds


@dataclass
class Target:
    """A position (from 1) among the non-NULL values of a cell, and what is known of it."""

    cell: int
    position: int
    low: float
    high: float
    below: int
    inside: int

    def settled(self) -> bool:
        return self.inside <= INSIDE or self.low == self.high

    def holds(self, cells: Sequence[Column]) -> Column:
        return cells[self.cell].between(F.lit(self.low), F.lit(self.high))


def _narrow(rows: DataFrame, cells: Sequence[Column], targets: list[Target]) -> None:
    """One round: tighten the brackets of all targets that are not settled."""
    sketches = []
    for t in targets:
        share = (t.position - t.below) / t.inside
        shares = [max(0.0, share - 2 / ACCURACY), min(1.0, share + 2 / ACCURACY)]
        inside = F.when(t.holds(cells), cells[t.cell])
        sketches.append(F.percentile_approx(inside, shares, ACCURACY))
    pairs = rows.agg(*[s.alias(f"s{i}") for i, s in enumerate(sketches)]).first()
    counts = []
    for t, (low, high) in zip(targets, pairs, strict=True):
        cell = cells[t.cell]
        counts += [F.count(F.when(cell < F.lit(low), 1)), F.count(F.when(cell.between(F.lit(low), F.lit(high)), 1))]
    numbers = rows.agg(*[c.alias(f"c{i}") for i, c in enumerate(counts)]).first()
    for i, (t, (low, high)) in enumerate(zip(targets, pairs, strict=True)):
        below, inside = numbers[2 * i], numbers[2 * i + 1]
        if not (below < t.position <= below + inside and inside < t.inside):
            # The sketch missed, or cannot cut further: halve the values instead, which always ends.
            low, high, below, inside = _halved(rows, cells[t.cell], t)
        t.low, t.high, t.below, t.inside = low, high, below, inside


def _halved(rows: DataFrame, cell: Column, t: Target) -> tuple[float, float, int, int]:
    middle = t.low / 2 + t.high / 2
    if not t.low <= middle < t.high:  # neighbouring numbers, or one of them infinite
        middle = t.low
    first = rows.agg(
        F.count(F.when(cell < F.lit(t.low), 1)), F.count(F.when(cell.between(F.lit(t.low), F.lit(middle)), 1)),
        F.max(F.when(cell.between(F.lit(t.low), F.lit(middle)), cell)), F.min(F.when((cell > F.lit(middle)) & (cell <= F.lit(t.high)), cell)),
    ).first()
    below, left, last, following = first
    if t.position <= below + left:
        return t.low, last, below, left
    return following, t.high, below + left, t.inside - left


def _spans(rows: DataFrame, cells: Sequence[Column]) -> list[tuple[int, float, float]]:
    """Number of values, least and largest of each cell."""
    found = rows.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(cells) for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    return [tuple(found[3 * i : 3 * i + 3]) for i in range(len(cells))]


def _bracketed(rows: DataFrame, cells: Sequence[Column], wanted: Sequence[tuple[int, int]], spans) -> list[Target]:
    targets = [Target(cell, position, spans[cell][1], spans[cell][2], 0, spans[cell][0]) for cell, position in wanted]
    while open_ := [t for t in targets if not t.settled()]:
        _narrow(rows, cells, open_)
    return targets


def at_positions(rows: DataFrame, cells: Sequence[Column], wanted: Sequence[tuple[int, int]], spans=None, key: str | None = None) -> list[tuple]:
    """The (value, key) at each wanted (cell number, position from 1), by value and then by key.

    ``cells`` are numeric expressions over ``rows`` whose NULLs count for nothing; ``key`` names a text column that is unique.
    Without it the key of the answer is None. ``rows`` are read several times and should be stored.
    """
    cells = [c.cast("double") for c in cells]
    spans = spans or _spans(rows, cells)
    if key is None:  # the extremes are known
        ends = {w: spans[w[0]][1] if w[1] == 1 else spans[w[0]][2] for w in wanted if w[1] in (1, spans[w[0]][0])}
        rest = [w for w in wanted if w not in ends]
        found = dict(zip(rest, _selected(rows, cells, rest, spans, None), strict=True))
        return [found.get(w) or (ends[w], None) for w in wanted]
    return _selected(rows, cells, wanted, spans, key)


def _selected(rows: DataFrame, cells: Sequence[Column], wanted: Sequence[tuple[int, int]], spans, key: str | None) -> list[tuple]:
    targets = _bracketed(rows, cells, wanted, spans)
    answers: list[tuple | None] = [(t.low, None) if key is None and t.low == t.high else None for t in targets]
    for i, t in enumerate(targets):
        if answers[i] is None and t.inside > INSIDE:
            tied = rows.where(cells[t.cell] == F.lit(t.low)).select(key)
            answers[i] = t.low, _key_at(tied, key, t.position - t.below)
    open_ = {i: t for i, t in enumerate(targets) if answers[i] is None}
    if open_:
        order = ["value"] if key is None else ["value", "key"]
        listed = [
            F.when(t.holds(cells), F.struct(F.lit(i).alias("target"), F.lit(t.position - t.below).alias("place"), cells[t.cell].alias("value"),
                                            (F.col(key) if key else F.lit(None).cast("string")).alias("key")))
            for i, t in open_.items()
        ]
        inside = rows.select(F.explode(F.array_compact(F.array(*listed))).alias("x")).select("x.*")
        ranked = inside.withColumn("n", F.row_number().over(Window.partitionBy("target").orderBy(*order)))
        for r in ranked.where("n = place").collect():
            answers[r.target] = r.value, r.key
    return answers


def _key_at(keys: DataFrame, key: str, position: int) -> str:
    """The key at a position in byte order, found from its leading bytes on."""
    known = 0
    while True:
        chunk = F.rpad(F.substring(F.hex(F.col(key).cast("binary")), 2 * known + 1, 2 * CHUNK), 2 * CHUNK, "0")
        number = F.conv(chunk, 16, 10).cast("double")
        (t,) = _bracketed(keys, [number], [(0, position)], _spans(keys, [number]))
        keys = keys.where(number.between(F.lit(t.low), F.lit(t.high)))
        position -= t.below
        if t.inside <= INSIDE:
            ranked = keys.withColumn("n", F.row_number().over(Window.orderBy(key)))
            return ranked.where(F.col("n") == position).first()[0]
        known += CHUNK


def quantiles(measured: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """Exact linearly interpolated quantiles per ``metric`` of ``(metric, value)`` rows; metrics are few."""
    found = measured.where(F.col("value").isNotNull()).groupBy("metric").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).collect()
    cells = [F.when(F.col("metric").eqNullSafe(F.lit(r.metric)), F.col("value")) for r in found]
    wanted, ends = [], []
    for i, r in enumerate(found):
        for p in probabilities:
            spot = p * (r.n - 1)
            lower, upper = int(spot), -int(-spot // 1)
            ends.append((i, lower, upper, spot - lower))
            wanted += [(i, lower + 1), (i, upper + 1)]
    distinct = sorted(set(wanted))
    values = dict(zip(distinct, at_positions(measured, cells, distinct, [(r.n, r.lo, r.hi) for r in found]), strict=True)) if found else {}
    rows = {}
    for i, lower, upper, fraction in ends:
        lo, hi = values[i, lower + 1][0], values[i, upper + 1][0]
        rows.setdefault(i, []).append(lo + (hi - lo) * fraction)
    kind = measured.schema["metric"].dataType.simpleString()
    return measured.sparkSession.createDataFrame([(found[i].metric, q) for i, q in rows.items()], f"metric {kind}, quantiles array<double>")


def tiers(df: DataFrame, value: str, key: str, count: int, output: str) -> DataFrame:
    """Append the 1-based tier of one column; see ``tiers_of``."""
    return tiers_of(df, {output: value}, key, count)


def tiers_of(df: DataFrame, outputs: dict[str, str], key: str, count: int) -> DataFrame:
    """Append 1-based tiers, by output name, of numeric columns: ``count``-quantile bins of the first-come rank.

    Rank ties follow ``key``; a NULL value ranks first. With rank r of n, the tier is
    ``max(1, ceil((r - 1) * count / (n - 1)))``; so tier k ends at rank
    ``1 + floor(k * (n - 1) / count)``, and it is enough to find the rows at those
    ``count - 1`` ranks and compare every row with them. All columns are selected together.
    """
    cells = [F.coalesce(F.col(v).cast("double"), F.lit(float("-inf"))) for v in outputs.values()]
    spans = _spans(df, cells)
    wanted = [(i, k * (n - 1) // count + 1) for i, (n, _, _) in enumerate(spans) for k in range(1, count) if n]
    bounds = list(zip(wanted, at_positions(df, cells, wanted, spans, key), strict=True)) if wanted else []
    for i, (output, cell) in enumerate(zip(outputs, cells, strict=True)):
        tier = F.lit(1)
        for (of, _), (value, last) in bounds:
            if of == i:
                beyond = (cell > F.lit(value)) | ((cell == F.lit(value)) & (F.col(key) > F.lit(last)))
                tier = tier + F.when(beyond, 1).otherwise(0)
        df = df.withColumn(output, tier.cast("int"))
    return df
