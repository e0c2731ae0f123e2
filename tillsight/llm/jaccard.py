"""Exact n-gram Jaccard self-join of documents and the components of its links, by set relations.

A document's set holds its distinct shingles of some words. A ``Rule`` has their number and the least Jaccard
similarity as an integer ratio num / den: sets of sizes a and b link when their symmetric difference d has
``(den + num) * d <= (den - num) * (a + b)``. All bounds below derive from it. ``CONTRACT`` (three words, 0.9) is the
rule of op2, ``NEAR`` (five words, 0.8) that of the pipeline.

1. Equal sets become one class; its representative is the smallest id.
2. Index lists: the hash range is cut into one part more than two linked sets of a size class can differ in
   elements, so linked sets agree in at least one part, and some parts more for those that may be empty. A list holds the sets with the same content in the same part.
   A shared passage, a frequent word or line puts no sets into one list; near copies it does.
3. Each list has one pivot, its smallest id. The difference of every member to the pivot is computed once;
   it decides the link to the pivot, and it is all that later steps read: for members x and y of
   one pivot the symmetric difference of the sets is that of their differences. Answers of a set thus derive from
   those of a highly similar set. Members that both link to the pivot need no comparison.
   A member that shares little but that part with its pivot has a difference larger than its own set; such members, and all that
   meet them in a list, are compared by their own sets instead, each once for all its lists.
4. The other pairs of a pivot share an element of their differences (or sets). These are indexed (rarest element first,
   prefix filter), with the position of the element. Lists are cut into blocks of similar
   size and position; pairs of blocks whose positions leave no room for enough common elements are skipped
   whole. Each list first compares its members with its smallest difference; after components are formed
   only pairs across components are compared.

No step gathers a list in one task or emits all pairs of a group of linked sets; pairs below the
threshold are compared only if they share a rare enough element of their differences. Nothing but counts reaches the driver.

Defined results: a NULL, empty or blank text has an empty set and links with nothing; a text of fewer
words than a shingle has its word sequence as single shingle; rows with a NULL id get no component of their own
(``component_id`` is that of the equal sets with ids, else NULL) and never represent; repeated rows get equal results; rows that
repeat an id with another text are judged by their text; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.functions.skew import join_back
from tillsight.llm.bpe import gather
from tillsight.llm.components import components
from tillsight.llm.exact import frequent
from tillsight.llm.texts import NOT_SPACE, bounded, broadcast_if_small, list_array, map_arrow, mix, records_per_batch, unused, window_owners, windows, words
from tillsight.session import release_shuffles, stage, stage_path, staging_scope

BLOCK = 8
#: Lists of about so many entries or more are no group of rows in one task.
HOT = 4096

LAST_SCHEME = 2
RECORDS = 128

_PART, _CLASS, _SECOND, _SCHEME = (np.uint64(v) for v in mix(np.array([101, 102, 103, 104], np.uint64)))


@dataclass(frozen=True)
class Rule:
    """Sets of shingles of ``shingle`` words link from a Jaccard similarity of ``num / den`` on."""

    shingle: int
    num: int
    den: int

    def __post_init__(self) -> None:
        if self.shingle < 1 or not 0 < self.num <= self.den:
            raise ValueError(f"no shingle size and similarity: {self}")

    def largest(self, sizes: np.ndarray) -> np.ndarray:
        """Size of the largest set that links with one of each size."""
        return sizes * self.den // self.num

    def apart(self, both: np.ndarray) -> np.ndarray:
        """Most elements in which linked sets of ``both`` elements together differ."""
        return both * (self.den - self.num) // (self.den + self.num)

    def linked(self, d: Column | str, a: Column | str, b: Column | str) -> Column:
        d, a, b = (F.col(c) if isinstance(c, str) else c for c in (d, a, b))
        return d * (self.den + self.num) <= (a + b) * (self.den - self.num)

    def common(self, d: Column, sizes: Column) -> Column:
        """Elements that two differences of ``d`` elements together share at least if their sets, of ``sizes`` elements together, link."""
        return (d - sizes * (self.den - self.num) / (self.den + self.num)) / 2


CONTRACT = Rule(3, 9, 10)
NEAR = Rule(5, 4, 5)


def shingle_sets(column: pa.Array, size: int = CONTRACT.shingle) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and where each begins."""
    found = words(column, NOT_SPACE)
    counts = np.diff(found.first)
    starts, owner = window_owners(found.first, size)
    hashes, owners = [windows(found.hashes, size)[starts]], [owner]
    for short in range(1, size):
        texts = np.flatnonzero(counts == short)
        if len(texts):
            hashes.append(windows(found.hashes, short)[found.first[texts]])
            owners.append(texts)
    values, owner = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.concatenate(([0], np.cumsum(np.bincount(owner[new], minlength=len(counts)))))


def size_classes(largest: int) -> np.ndarray:
    """First size of each class, about a quarter apart, up to beyond ``largest``."""
    edges = [1]
    while edges[-1] <= largest:
        edges.append(edges[-1] + max(edges[-1] // 4, 1))
    return np.array([*edges, edges[-1] + max(edges[-1] // 4, 1)], np.int64)


def part_keys(values: np.ndarray, edges: np.ndarray, rule: Rule = CONTRACT) -> tuple[np.ndarray, np.ndarray]:
    """List keys of each set: keys one set after the other, and their number for each set.

    A set goes to its own size class, and to the next ones as far as a linked set can be in them. Classes
    in which only equal sets link need no keys.
    """
    sizes = np.diff(edges)
    bounds = size_classes(int(rule.largest(sizes.max(initial=1))))
    own = np.searchsorted(bounds, sizes, side="right") - 1
    partner = np.searchsorted(bounds, rule.largest(sizes), side="right") - 1
    steps = [np.flatnonzero((sizes > 0) & (partner - own >= k)) for k in range(int((partner - own).max(initial=0)) + 1)]
    doc = np.concatenate(steps)
    group = np.concatenate([own[found] + k for k, found in enumerate(steps)])
    parts = rule.apart(2 * (bounds[1:] - 1)) + 1
    spare = _spare_parts(parts, -(-bounds[:-1] * rule.num // rule.den))
    cut = parts[group] > 1
    doc, group = doc[cut], group[cut]
    doc, keys = _keys_of(values, edges, doc, group, (parts + spare)[group], spare[group], 0)
    order = np.argsort(doc, kind="stable")
    return keys[order], np.bincount(doc, minlength=len(sizes))


def _spare_parts(parts: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Parts beyond the necessary ones for each size class, about as many as are empty in its smallest sets (``least``)."""
    spare = np.zeros(len(parts), np.int64)
    for _ in range(4):
        empty = (parts + spare) * np.exp(-least / (parts + spare))
        spare = np.floor(empty + 2 * np.sqrt(empty)).astype(np.int64)
    return spare


def _keys_of(
    values: np.ndarray, edges: np.ndarray, doc: np.ndarray, group: np.ndarray, parts: np.ndarray, spare: np.ndarray, scheme: int
) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) for the parts of the given (set, size class) pairs.

    Linked sets agree in more than ``spare`` parts. If no more than these are empty in a set, it agrees in one with
    content, and empty parts, which all sets would share, need no list. Else a pair lists its other parts and is
    cut again by another hash; both sets that agree in nothing but empty parts are. The last scheme lists the empty
    parts of such sets.
    """
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sizes = np.diff(edges)[doc]
    first = np.cumsum(parts) - parts
    elements = gather(values, edges[:-1][doc], sizes)
    shift = np.uint64(int(_SCHEME) * scheme % 2**64)
    if scheme:
        elements = mix(elements + shift)
    wide = np.repeat(parts.astype(np.uint64), sizes)
    place = (((elements >> np.uint64(32)) * wide) >> np.uint64(32)).astype(np.int64) + np.repeat(first, sizes)
    if scheme:
        order = np.argsort(place, kind="stable")
        place, elements = place[order], elements[order]
    change = np.flatnonzero(np.diff(place, prepend=-1))
    sums, filled = np.zeros(int(parts.sum()), np.uint64), np.zeros(int(parts.sum()), bool)
    sums[place[change]] = np.add.reduceat(mix(elements), change)
    filled[place[change]] = True
    pair = np.repeat(np.arange(len(doc)), parts)
    number = (np.arange(len(sums)) - first[pair]).astype(np.uint64)
    keys = mix(sums + mix(number * _PART + group[pair].astype(np.uint64) * _CLASS + shift))
    lacking = np.bincount(pair, weights=~filled, minlength=len(doc)) > spare
    if scheme == LAST_SCHEME:
        filled |= lacking[pair]
    if scheme == LAST_SCHEME or not lacking.any():
        return doc[pair][filled], keys[filled]
    more = _keys_of(values, edges, doc[lacking], group[lacking], parts[lacking], spare[lacking], scheme + 1)
    return np.concatenate((doc[pair][filled], more[0])), np.concatenate((keys[filled], more[1]))


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sum of each set's values."""
    out = np.zeros(len(edges) - 1, np.uint64)
    full = np.flatnonzero(np.diff(edges))
    if len(full):
        out[full] = np.add.reduceat(values, edges[:-1][full])
    return out


def described(docs: DataFrame, rule: Rule = CONTRACT) -> DataFrame:
    """``doc_id``, set size ``n``, a 128-bit fingerprint (``s1``, ``s2``) and the list ``keys`` of each document."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            values, edges = shingle_sets(batch.column("text"), rule.shingle)
            keys, counts = part_keys(values, edges, rule)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(np.diff(edges)), pa.array(_sums(mix(values), edges).view(np.int64)),
                    pa.array(_sums(mix(values ^ _SECOND), edges).view(np.int64)), list_array(keys.view(np.int64), counts, pa.int64()),
                ],
                ["doc_id", "n", "s1", "s2", "keys"],
            )

    narrow = docs.select("doc_id", "text")
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return map_arrow(narrow, describe, f"doc_id {kind}, n long, s1 long, s2 long, keys array<long>")


def _with_groups(rows: DataFrame, key: str, name: str, value: Column) -> DataFrame:
    """``rows`` with the aggregate ``value`` of their ``key``'s group in the column ``name``. No row moves more than once.

    Groups that may have ``HOT`` rows or more are summed up where their rows lie, and the few sums are broadcast back to these. The
    other rows meet by key, where no group is large.
    """
    group = Window.partitionBy(key)
    hot = stage(frequent(rows, key, HOT), "hot")
    if hot.isEmpty():
        return rows.withColumn(name, value.over(group))
    sums = stage(rows.join(F.broadcast(hot), key, "left_semi").groupBy(key).agg(value.alias(name)), "hot_groups")
    heavy = rows.join(F.broadcast(sums), key)
    light = rows.join(F.broadcast(sums), key, "left_anti")
    return light.withColumn(name, value.over(group)).unionByName(heavy)


def _star_pairs(representatives: DataFrame) -> DataFrame:
    """Distinct (p, x): the pivot of a list and another member."""
    postings = representatives.select(F.explode("keys").alias("key"), F.col("rep").alias("x"))
    return _with_groups(postings, "key", "p", F.min("x")).where(F.col("x") != F.col("p")).select("p", "x").distinct()


def _differences(docs: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """For each pair (p, x), numbered ``m``: set sizes ``np`` and ``nx``, size ``d`` and elements ``diff`` of the difference, ``linked``.

    The elements of a difference that is larger than the set of x are left out (see ``FAR``).

    Texts meet their pairs where they are scanned by a broadcast of the pairs while these are few; only
    texts that occur in a pair are then shuffled.
    """
    listed, pivots = broadcast_if_small(pairs), broadcast_if_small(pairs.select("p").distinct())
    texts = docs.select("doc_id", "text")
    of_x = texts.join(listed, texts["doc_id"] == listed["x"]).select("p", "x", F.col("text").alias("text_x"))
    of_p = texts.join(pivots, texts["doc_id"] == pivots["p"]).select("p", F.col("text").alias("text_p"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text_x"):
            xs, x_edges = shingle_sets(batch.column("text_x"), rule.shingle)
            pivots = batch.column("text_p").dictionary_encode()  # the same pivot comes many times in a row
            ps, p_edges = shingle_sets(pivots.dictionary, rule.shingle)
            which = pivots.indices.to_numpy(zero_copy_only=False)
            diffs = [
                np.setxor1d(xs[x_edges[i] : x_edges[i + 1]], ps[p_edges[j] : p_edges[j + 1]], assume_unique=True)
                for i, j in enumerate(which.tolist())
            ]
            lengths, sizes = np.array([len(v) for v in diffs], np.int64), np.diff(x_edges)
            stored = np.where(lengths > sizes, 0, lengths)
            flat = np.concatenate([v[:n] for v, n in zip(diffs, stored.tolist(), strict=True)]).view(np.int64) if diffs else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("p"), batch.column("x"), pa.array(np.diff(p_edges)[which]), pa.array(sizes),
                    pa.array(lengths), list_array(flat, stored, pa.int64()),
                ],
                ["p", "x", "np", "nx", "d", "diff"],
            )

    kind = pairs.schema["p"].dataType.simpleString()
    joined = of_x.join(of_p, "p").select("p", "x", "text_x", "text_p")
    found = map_arrow(joined, compare, f"p {kind}, x {kind}, np long, nx long, d long, diff array<long>")
    found = found.withColumns({"linked": rule.linked("d", "np", "nx"), "m": F.monotonically_increasing_id()})
    with records_per_batch(docs.sparkSession, RECORDS):  # a pivot's text comes with each member
        return stage(found, "differences")


#: Whether a member differs from its pivot in more elements than it has.
FAR = "d > nx"


def _own_sets(docs: DataFrame, ids: DataFrame, rule: Rule) -> DataFrame:
    """The sets of the documents ``x`` in the form of differences to one pivot without elements."""
    texts = docs.select("doc_id", "text")
    wanted = texts.join(broadcast_if_small(ids), texts["doc_id"] == ids["x"]).select("x", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            values, edges = shingle_sets(batch.column("text"), rule.shingle)
            sizes = np.diff(edges)
            yield pa.RecordBatch.from_arrays([batch.column("x"), pa.array(sizes), list_array(values.view(np.int64), sizes, pa.int64())], ["x", "nx", "diff"])

    found = map_arrow(wanted, sets, f"x {ids.schema['x'].dataType.simpleString()}, nx long, diff array<long>")
    found = found.withColumns({"p": F.lit(0), "np": F.lit(0), "d": F.col("nx"), "linked": F.lit(False), "m": F.monotonically_increasing_id()})
    with records_per_batch(docs.sparkSession, 16 * RECORDS):
        return stage(found, "own_sets")


def _difference_lists(members: DataFrame, rule: Rule) -> DataFrame:
    """Entries of the second index: lists ``g`` of members of a pivot with one element among their rarest.

    ``at`` is the element's position in the member's order, rarest first, elements no other member
    has before all. A partner differs by at most ``h`` elements, so the first ``h + 1`` positions suffice.
    A list is known by the hash of pivot and element; a collision only adds pairs to verify.
    """
    elements = members.select("m", "p", F.explode("diff").alias("e")).select(F.xxhash64("p", "e").alias("g"), "m")
    own = Window.partitionBy("m")
    ranked = _with_groups(elements, "g", "df", F.count(F.lit(1))).where(F.col("df") > 1).select(
        "g", "m", F.count(F.lit(1)).over(own).alias("known"), (F.row_number().over(own.orderBy("df", "g")) - 1).alias("place")
    )
    both = F.col("nx") + F.expr(f"nx * {rule.den} div {rule.num}")
    h = F.floor(both * (rule.den - rule.num) / (rule.den + rule.num))
    entries = ranked.join(members.drop("diff", "np"), "m").withColumn("at", F.col("d") - F.col("known") + F.col("place"))
    return entries.where(F.col("at") <= h).select("p", "g", "x", "nx", "d", "linked", "at")


def _may_link(entries: DataFrame, other: DataFrame, keys: list[str], rule: Rule) -> DataFrame:
    """Pairs of entries of one list, of columns ``*_x`` and ``*_y``, whose positions leave room for enough common elements."""
    needed = rule.common(F.col("d_x") + F.col("d_y"), F.col("nx_x") + F.col("nx_y"))
    room = F.least(F.col("d_x") - F.col("at_x"), F.col("d_y") - F.col("at_y"))
    return entries.join(other, keys).where((F.col("x_x") != F.col("x_y")) & ~(F.col("linked_x") & F.col("linked_y")) & (needed <= room))


def _named(entries: DataFrame, side: str, names: tuple[str, ...]) -> DataFrame:
    return entries.select("p", "g", *[F.col(n).alias(f"{n}_{side}") for n in names])


def _sides(pairs: DataFrame, members: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (p, x, y) of one pivot that link, by their differences to it.

    The pairs are stored first: while they are few they meet the members where these lie, and only members of a pair are moved.
    """
    pairs = stage(pairs, "candidates")
    release_shuffles(pairs.sparkSession)
    listed, partners = broadcast_if_small(pairs), broadcast_if_small(pairs.select("p", "y").distinct())
    one = members.select("p", "x", F.col("nx").alias("n1"), F.col("d").alias("d1"), F.col("diff").alias("f1"))
    two = members.select("p", F.col("x").alias("y"), F.col("nx").alias("n2"), F.col("d").alias("d2"), F.col("diff").alias("f2"))
    apart = F.col("d1") + F.col("d2") - 2 * F.size(F.array_intersect("f1", "f2"))
    met = one.join(listed, ["p", "x"]).join(two.join(partners, ["p", "y"], "left_semi"), ["p", "y"])
    return met.where(rule.linked(apart, "n1", "n2")).select(F.col("x").alias("u"), F.col("y").alias("v"))


ENTRY = ("x", "nx", "d", "at", "linked")


def _list_stars(entries: DataFrame, rule: Rule) -> DataFrame:
    """Distinct (p, x, y): in each list the members x with the member y of smallest difference, where they may link."""
    low = entries.groupBy("p", "g").agg(F.min(F.struct("d", *[n for n in ENTRY if n != "d"])).alias("low"))
    low = low.select("p", "g", *[F.col(f"low.{n}").alias(f"{n}_y") for n in ENTRY])
    return _may_link(_named(entries, "x", ENTRY), low, ["p", "g"], rule).select("p", F.col("x_x").alias("x"), F.col("x_y").alias("y")).distinct()


def _open_pairs(entries: DataFrame, labels: DataFrame, rule: Rule) -> DataFrame:
    """Distinct pairs (p, x, y) of one list and different components that may link.

    A block holds members of one component, so blocks are paired, and no rows of one component with each other.
    """
    placed = join_back(entries, labels.withColumnRenamed("node", "x"), ["x"]).withColumn("component", F.coalesce("component", "x"))
    place = F.struct(F.col("component").alias("of"), F.floor(F.col("d") / BLOCK).alias("d"), F.floor(F.col("at") / BLOCK).alias("at"))
    blocked = stage(placed.withColumn("b", place), "blocks")
    blocks = blocked.groupBy("p", "g", "b").agg(
        F.min("d").alias("low"), F.max("nx").alias("most"), F.max(F.col("d") - F.col("at")).alias("room"), F.min("linked").alias("linked"),
    )
    names = ("b", "low", "most", "room", "linked")
    needed = rule.common(F.col("low_x") + F.col("low_y"), F.col("most_x") + F.col("most_y"))
    kept = _named(blocks, "x", names).join(_named(blocks, "y", names), ["p", "g"]).where(
        (F.col("b_x.of") < F.col("b_y.of")) & (needed <= F.least("room_x", "room_y")) & ~(F.col("linked_x") & F.col("linked_y"))
    ).select("p", "g", "b_x", "b_y")
    names = (*ENTRY, "b")
    pairs = _may_link(kept.join(_named(blocked, "x", names), ["p", "g", "b_x"]), _named(blocked, "y", names), ["p", "g", "b_y"], rule)
    return pairs.select("p", F.least("x_x", "x_y").alias("x"), F.greatest("x_x", "x_y").alias("y")).distinct()


def _links(docs: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """Components of the representatives that link with another one: ``node``, ``component``."""
    spark = docs.sparkSession
    diffs = _differences(docs, pairs, rule)
    release_shuffles(spark)
    stars = diffs.where("linked").select(F.col("p").alias("u"), F.col("x").alias("v"))
    near = diffs.where(f"NOT ({FAR})")
    unsettled = stage(near.where(~F.col("linked")).select("p").distinct(), "unsettled")
    groups = [near.join(broadcast_if_small(unsettled), "p", "left_semi")]
    mixed = stage(diffs.where(FAR).select("p").distinct(), "mixed")
    if not mixed.isEmpty():
        ids = stage(diffs.join(broadcast_if_small(mixed), "p", "left_semi").select("x").distinct(), "mixed_members")
        groups.append(_own_sets(docs, ids, rule))
        release_shuffles(spark)
    compared = []
    for members in groups:
        compared.append((members, stage(_difference_lists(members, rule), "entries")))
        release_shuffles(spark)
    for members, entries in compared:
        stars = stars.unionByName(_sides(_list_stars(entries, rule), members, rule))
    labels = components(stars)
    release_shuffles(spark)
    across = None
    for members, entries in compared:
        links = _sides(_open_pairs(entries, labels, rule), members, rule)
        across = links if across is None else across.unionByName(links)
    across = stage(across, "links")
    if across.isEmpty():
        return labels
    return components(labels.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(across))


def component_labels(docs: DataFrame, rule: Rule = CONTRACT) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every document.

    The list keys, which are most of what is stored, are removed once the pairs are known.
    """
    spark = docs.sparkSession
    paths = {name: stage_path(spark, name) for name in ("sets", "classes", "pairs")}
    keys = ["s1", "s2", "n"]
    with staging_scope(spark):
        with records_per_batch(spark, 16 * RECORDS):
            keyed = stage(described(docs, rule), "keyed_sets")
        sets = stage(keyed.drop("keys"), "sets", paths["sets"])
        classes = stage(sets.where(F.col("n") > 0).groupBy(keys).agg(F.min("doc_id").alias("rep")), "classes", paths["classes"])
        listed = keyed.select(*keys, "keys", F.col("doc_id").alias("rep")).where(F.size("keys") > 0)
        known = broadcast_if_small(classes)
        mine = listed.join(known, [*keys, "rep"]).select("rep", "keys")
        if known is classes:  # the join exchanges the keys, so its result is stored
            mine = stage(mine, "representatives")
            release_shuffles(spark)
        pairs = stage(_star_pairs(mine), "pairs", paths["pairs"])
    release_shuffles(spark)
    labels = _links(docs, pairs, rule)
    named = classes.join(labels, classes["rep"] == labels["node"], "left").select(*keys, F.coalesce("component", "rep").alias("component_id"))
    return join_back(sets.select("doc_id", *keys), named, keys, spread="doc_id").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def representatives(docs: DataFrame, rule: Rule = CONTRACT) -> DataFrame:
    """One document of each component, that with the smallest id, with all its columns."""
    key = unused(docs, "_gone")
    labels = component_labels(docs, rule)
    gone = labels.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(broadcast_if_small(stage(gone, "gone")), docs["doc_id"] == F.col(key), "left_anti")
