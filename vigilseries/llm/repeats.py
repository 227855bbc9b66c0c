"""Periodic runs of words, found as maximal pairs with bounded distance.

A run of smallest period ``q`` is a stretch whose words ``q`` apart are equal and that no neighbouring
word extends. Its start ``i`` and ``i + q`` are a maximal pair: the words before them differ, and they
agree for exactly ``length - q`` words. The other way round, a maximal pair at distance ``d`` that
agrees for at least ``2 d`` words spans a run whose period divides ``d``; of the pairs with the same
span the closest has the period itself. Nothing is extended word by word.

Pairs come from the tree of LCP intervals of the text's sorted suffixes, bottom up: an interval holds
the places of its suffixes in order, each labelled with its left word (its class); when two children
of an interval meet, the smaller list is put into the larger one, and a place is paired with its
neighbours on either side if their left words differ. The pair of a run is always of neighbouring
places, because an occurrence between them would give a smaller period, so no other pair is looked at.

A run of the wanted length agrees for at least two thirds of it; only suffixes that share so many words
with another one of their text enter the tree, and a text without such repeats costs one sort.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilseries.llm.text import column

LEAST = 24  # words of a run
TIMES = 3  # periods of a run

Run = tuple[int, int, int]  # start, length, period

_MIX = np.uint64(0x9E3779B97F4A7C15)


def numbered(words: list[bytes]) -> np.ndarray:
    known: defaultdict = defaultdict()
    known.default_factory = known.__len__
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return left * _MIX + (right ^ (right >> np.uint64(32)))


def _may_repeat(of: np.ndarray, width: int) -> bool:
    """Whether some ``width`` words come twice; by hashes, so rarely true when they do not."""
    windows = len(of) - width + 1
    if windows < 2:
        return False
    at = (of.astype(np.uint64) + np.uint64(1)) * _MIX
    full, done, step = np.zeros(windows, np.uint64), 0, 1
    while step <= width:  # the width as a sum of powers of two
        if width & step:
            full = _mixed(full, at[done : done + windows])
            done += step
        at = _mixed(at[:-step], at[step:])
        step *= 2
    full.sort()
    return bool((full[1:] == full[:-1]).any())


def _sorted_suffixes(of: np.ndarray, width: int) -> np.ndarray:
    """Places of the suffixes that share their first ``width`` words with another one, in the order
    of suffixes.

    Prefix doubling; a rank is the number of smaller suffixes as far as they are told apart."""
    n = len(of)
    rank = np.full(n + 1, -1, np.int64)
    rank[:n] = np.unique(of, return_inverse=True)[1]
    left, told, groups = np.arange(n), 1, None
    while len(left):
        after = rank[np.minimum(left + told, n)]
        order = np.lexsort((after, rank[left]))
        left, after = left[order], after[order]
        own = rank[left]
        group = np.r_[True, own[1:] != own[:-1]]
        new = group | np.r_[True, after[1:] != after[:-1]]
        if told == 1:  # ranks so far are of words, not of places
            rank[left] = np.flatnonzero(new)[np.cumsum(new) - 1]
        else:
            first = np.maximum.accumulate(np.where(group, np.arange(len(left)), 0))
            start = np.maximum.accumulate(np.where(new, np.arange(len(left)), 0))
            rank[left] = own + start - first
        told *= 2
        single = new & np.r_[new[1:], True]
        left = left[~single]
        if groups is None and told >= width:
            groups = left if told == width else _of_width(of, width)
            if not len(groups):
                break
            inside = np.zeros(n + 1, bool)
            inside[groups] = True
            left = left[inside[left]]
    if groups is None:
        groups = np.zeros(0, np.int64)
    return groups[np.argsort(rank[groups], kind="stable")]


def _of_width(of: np.ndarray, width: int) -> np.ndarray:
    """Of all places those that share ``width`` words with another one."""
    places = np.arange(len(of) - width + 1)
    key = np.zeros(len(places), np.int64)
    for k in range(width):  # exact: equal numbers so far and equal next words
        key = np.unique(key * (of.max() + 1) + of[places + k], return_inverse=True)[1]
    counts = np.bincount(key)
    return places[counts[key] > 1]


def _agreement(words: list[int], order: list[int], width: int) -> list[int]:
    """Words that agree with the suffix before in the order, 0 if fewer than ``width`` (Kasai and
    others: the next suffix of the text agrees for one word less at least)."""
    n = len(words)
    before = dict(zip(order[1:], order, strict=False))
    agree = {}
    h, last = 0, -2
    for i in sorted(order):
        # below the width the suffix before in the whole order may not be in this one
        h = h - 1 if i == last + 1 and h > width else 0
        last = i
        j = before.get(i)
        if j is None:
            h, agree[i] = 0, 0
            continue
        end = n - max(i, j)
        while h < end and words[i + h] == words[j + h]:
            h += 1
        agree[i] = h if h >= width else 0
    return [agree[i] for i in order]


def runs(of: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[Run]:
    """All runs of at least ``least`` words and ``times`` periods, by start and period."""
    # length = agreement + period <= agreement * times / (times - 1)
    width = -(-least * (times - 1) // times)
    if not _may_repeat(of, width):
        return []
    places = _sorted_suffixes(of, width)
    if not len(places):
        return []
    words, order = of.tolist(), places.tolist()
    agree = _agreement(words, order, width)
    found: dict[tuple[int, int], int] = {}

    def met(one: list[int], two: list[int], depth: int) -> list[int]:
        """Two children of an interval; places are in order."""
        large, small = (one, two) if len(one) >= len(two) else (two, one)
        most, fewest = depth // (times - 1), least - depth
        for x in small:
            at = bisect_left(large, x)
            for y in large[max(at - 1, 0) : at + 1]:
                d = abs(x - y)
                if fewest <= d <= most:
                    i, j = min(x, y), max(x, y)
                    if i == 0 or words[i - 1] != words[j - 1]:
                        span = (i, j + depth)
                        found[span] = min(d, found.get(span, d))
        if small[0] > large[-1]:
            large += small
        else:
            for x in small:
                large.insert(bisect_left(large, x), x)
        return large

    open_: list[tuple[int, list[int]]] = []
    current = [order[0]]
    for place, depth in zip([*order[1:], None], [*agree[1:], 0], strict=True):
        while open_ and open_[-1][0] > depth:
            above, waiting = open_.pop()
            current = met(waiting, current, above)
        if depth:
            if open_ and open_[-1][0] == depth:
                current = met(open_.pop()[1], current, depth)
            open_.append((depth, current))
        if place is not None:
            current = [place]
    return sorted((i, end - i, d) for (i, end), d in found.items())


def left_out(n: int, found: list[Run]) -> np.ndarray:
    """Words that a run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) > 0


def _found(least: int, times: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in (b.slice(at, 50) for b in batches for at in range(0, b.num_rows, 50)):
            sizes, all_runs, texts = [], [], []
            for text in rows.column(1).to_pylist():
                words = (text or "").encode("utf-8", "replace").split()
                of = runs(numbered(words), least, times) if len(words) >= least else []
                sizes.append(len(words))
                all_runs.append([{"start": s, "length": n, "period": p} for s, n, p in of])
                if of:
                    out = left_out(len(words), of).tolist()
                    words = [w for w, x in zip(words, out, strict=True) if not x]
                texts.append(b" ".join(words))
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0), pa.array(sizes, pa.int64()), pa.array(all_runs, kind),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                ],
                ["id", "n_words", "runs", "collapsed"],
            )

    return read


def periodic(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    least: int = LEAST,
    times: int = TIMES,
) -> DataFrame:
    """Every row with ``id, n_words, runs, collapsed``: its runs (``start, length, period`` in words,
    by start, then period) and its words without those that repeat a run's first period, joined by
    blanks.

    Words are compared as they are. A null text is empty and has no words; repeated rows each have
    their result; texts are read whole, one at a time. An empty table gives an empty result; other
    columns are not looked at. Rows never move between tasks.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(column(id_column).alias("id"), column(text_column).alias("text")).mapInArrow(
        _found(least, times),
        f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string",
    )


def greatest(found):
    """The run with the largest length in periods, ties by start, then period; null without runs."""

    def larger(a, b):
        # exact as long as lengths and periods stay below 2^31
        ahead = b["length"] * a["period"] > a["length"] * b["period"]
        return F.when(a.isNull() | ahead, b).otherwise(a)

    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    return F.aggregate(found, none, larger)
