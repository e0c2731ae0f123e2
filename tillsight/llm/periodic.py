"""Periodic runs of words, found from the Lyndon arrays that suffix grouping yields.

A run is a stretch of words with smallest period q that no neighbouring word extends. Each run holds a Lyndon root: under
one of an order of the words and its reverse, the longest Lyndon word from some place of the run is q long. So:

1. ``lyndon_lengths`` sorts suffixes into groups as the first phase of Baier's suffix sorter does, from the highest group
   down: the nearest lower place before each member takes the member's Lyndon word to the end of its own and moves into a
   new group right above its old one, by how many members it takes. What a place has gathered when its group's turn comes
   is its longest Lyndon word; the suffix order itself is never needed. Both orders are grouped this way.
2. ``runs_of`` extends every Lyndon root to both sides by longest common extensions (galloping comparison of packed ids).

Words that lie in no long repeat are left out of 1 beforehand, which loses nothing: a run of length L and period q, with
L >= ``min_length`` and L >= ``min_periods`` * q, repeats its first L - q words q words later, so each of its words lies in a
window of ``repeat_width`` words that occurs twice in the text. Windows are compared by hash (more may pass, none is lost);
after that words are compared byte by byte.

Defined results: a NULL or blank text has no words, no runs and an empty collapsed text; repeated rows give repeated
results; NULL ids are kept; an empty table gives an empty result. A text is handled whole, in one task, in memory that
grows with the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tillsight.llm.texts import NOT_SPACE, bounded, map_arrow, mix, window_owners, windows, words

MIN_LENGTH, MIN_PERIODS = 24, 3
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def lyndon_lengths(ids: list[int], descending: bool = False) -> list[int]:
    """Length of the longest Lyndon word from each place, under the order of the ids or its reverse."""
    n = len(ids)
    sizes = [1] * n + [0]
    left, right = list(range(-1, n)), list(range(1, n + 2))  # places whose group is still to come; -1 stands for the last entry
    members: list[list[int]] = []
    below, above = [], []
    group = [0] * n
    by_id: dict[int, list[int]] = {}
    for place, word in enumerate(ids):
        by_id.setdefault(word, []).append(place)
    for number, word in enumerate(sorted(by_id, reverse=descending)):
        members.append(by_id[word])
        below.append(number - 1)
        above.append(number + 1)
        for place in by_id[word]:
            group[place] = number
    current = len(members) - 1
    while current >= 0:
        taken: dict[int, int] = {}
        for place in members[current]:
            if group[place] != current:
                continue
            before, after = left[place], right[place]
            right[before], left[after] = after, before
            if before >= 0:
                sizes[before] += sizes[place]
                taken[before] = taken.get(before, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for place, times in taken.items():
            moved.setdefault((-times, group[place]), []).append(place)
        for _, old in sorted(moved) if len(moved) > 1 else moved:  # most members first, so they end up highest
            places = moved[_, old]
            new = len(members)
            members.append(places)
            below.append(old)
            above.append(above[old])
            below[above[old]] = new
            above[old] = new
            for place in places:
                group[place] = new
        current = below[current]
    return sizes[:n]


def _common(packed: bytes, a: int, b: int, most: int) -> int:
    """How many of at most ``most`` words from ``a`` and from ``b`` on agree."""
    size, done = 8, 0
    while done < most:
        size = min(size, most - done)
        if packed[4 * (a + done) : 4 * (a + done + size)] == packed[4 * (b + done) : 4 * (b + done + size)]:
            done += size
            size *= 2
        elif size == 1:
            break
        else:
            size //= 2
    return done


def runs_of(ids: list[int], min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least that length and number of periods, by start, then period."""
    n = len(ids)
    forth = np.array(ids, np.uint32)
    packed, backward = forth.tobytes(), forth[::-1].tobytes()
    found: set[tuple[int, int, int]] = set()
    for descending in (False, True):
        period = np.array(lyndon_lengths(ids, descending), np.int64)
        place = np.arange(n)
        next_word, word_before = np.minimum(place + period, n - 1), np.maximum(place - 1, 0)
        longer = (place + period < n) & (forth[place] == forth[next_word]) if n else np.zeros(0, bool)
        if n:
            longer |= (place > 0) & (forth[word_before] == forth[np.minimum(word_before + period, n - 1)])
        longer &= period * min_periods <= n
        ends: dict[int, int] = {}
        for i, q in zip(place[longer].tolist(), period[longer].tolist(), strict=True):
            if i + q <= ends.get(q, 0):  # a later root of the run of this period seen last
                continue
            to_right = _common(packed, i, i + q, n - i - q)
            to_left = _common(backward, n - i, n - i - q, i)
            start, length = i - to_left, to_left + q + to_right
            ends[q] = start + length
            if length >= min_length and length >= min_periods * q:
                found.add((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def repeat_width(min_length: int, min_periods: int) -> int:
    """Words of the longest window that must occur twice wherever there is a run."""
    return max(1, -(-min_length * (min_periods - 1) // min_periods))


def _repeated(hashes: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Which words lie in a window of ``width`` words whose hash occurs twice in their text."""
    starts, owner = window_owners(first, width)
    covered = np.zeros(len(hashes) + 1, np.int64)
    if len(starts):
        keys = windows(hashes, width)[starts] ^ mix(owner.astype(np.uint64) + np.uint64(1))
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(covered, starts[twice], 1)
        np.add.at(covered, starts[twice] + width, -1)
    return np.cumsum(covered)[:-1] > 0


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> DataFrame:
    """Per document: ``doc_id``, ``n_words``, ``runs`` (array of start, length, period) and the ``collapsed`` text.

    Words are runs of bytes other than ASCII white space, numbered from 0 and compared as they are. The collapsed text has one
    space between words and keeps only the first period of every run. ``min_periods`` is 2 or more.
    """
    if min_periods < 2 or min_length < 1:
        raise ValueError("a run repeats at least once")
    width = repeat_width(min_length, min_periods)
    narrow = docs.select("doc_id", "text")
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            split = words(batch.column("text"), NOT_SPACE)
            inside = _repeated(split.hashes, split.first, width)
            counts, runs, collapsed = np.diff(split.first), [], []
            for number, text in enumerate(batch.column("text").to_pylist()):
                listed = text.encode().split() if text else []
                begin = int(split.first[number])
                mask = inside[begin : begin + len(listed)]
                mine: list[tuple[int, int, int]] = []
                if mask.any():
                    edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0)).tolist()
                    for a, b in zip(edges[::2], edges[1::2], strict=True):
                        number_of: dict[bytes, int] = {}
                        ids = [number_of.setdefault(w, len(number_of)) for w in listed[a:b]]
                        mine += [(a + start, length, period) for start, length, period in runs_of(ids, min_length, min_periods)]
                if mine:
                    dropped = np.zeros(len(listed) + 1, np.int64)
                    for start, length, period in mine:
                        dropped[start + period] += 1
                        dropped[start + length] -= 1
                    listed = [listed[i] for i in np.flatnonzero(np.cumsum(dropped)[:-1] == 0)]
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in mine])
                collapsed.append(b" ".join(listed).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(collapsed, pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    return map_arrow(narrow, find, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
