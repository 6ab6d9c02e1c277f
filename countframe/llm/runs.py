"""Periodic run detection (operator 13): maximal pairs of the LCP-interval tree.

A run is a stretch of words with smallest period q, at least two periods and
``min_length`` words long, that no neighbouring word extends.  Two equal
stretches of l words at distance p that can be extended neither to the left
nor to the right are a maximal pair; if l >= p they are the two ends of one
stretch of p + l words with period p.  So the maximal pairs with
l >= max(p, min_length - p) are the runs, and nothing has to be extended.  A
run of smallest period q also shows at distances 2q, 3q, ...: same start and
length, of which the least distance is kept.

Per block of texts, inside tasks:

1.  Only nodes of at least ``min_length / 2`` words can hold such a pair, so
    texts in which no stretch of that many words occurs twice are left out.
2.  Suffixes are ordered by prefix doubling; common prefixes of neighbours are
    read off the doubling ranks.
3.  The LCP-interval tree is walked bottom-up.  A node holds its positions in
    order and by the word to their left (class lists).  Children are joined
    the smaller into the larger: from each position of the smaller one the
    positions of other classes within the node's length are read; stretches
    of the own class are jumped over with the class list, so a step is paid
    by a pair.  Such pairs are at most about 1.5 a word (the sum of the
    exponents of runs is linear).

Every document is worked off by itself: no shuffle, no driver data, and a
lost task is repeated alone.  Memory is a small multiple of a block or of
the longest text (4 bytes a word and doubling level).

Cases: null and empty texts, and texts without words, have no words, no runs
and an empty collapsed text.  Repeated rows are handled one by one, an empty
table gives an empty one; other columns pass through, input columns named
like an output are replaced.  Words are compared by 64-bit hashes within one
document.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countframe.llm import textarrays as ta
from countframe.session import ship_library

MIN_LENGTH = 12
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_OUT = "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


# 1., 2. suffixes -------------------------------------------------------------------
def suffix_order(value: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions in suffix order, words shared with the one before) of a
    sequence in which the suffix of position i ends before end[i]; suffixes
    that share less than ``least`` words with both neighbours are left out."""
    n = len(value)
    order = np.argsort(value, kind="stable")
    same = np.concatenate([[False], value[order[1:]] == value[order[:-1]]])
    slot = np.flatnonzero(~same)
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(slot, np.diff(np.append(slot, n)))
    tied = np.flatnonzero(same | np.append(same[1:], False))
    levels, h = [], 1
    while True:
        levels.append(rank.copy())
        if not len(tied):
            break
        p = order[tied]
        after = np.where(p + h < end[p], rank[np.minimum(p + h, n - 1)].astype(np.int64) + 1, 0)
        key = rank[p].astype(np.int64) * (n + 1) + after
        o = np.argsort(key, kind="stable")
        p, key = p[o], key[o]
        order[tied] = p
        same = np.concatenate([[False], key[1:] == key[:-1]])
        first = np.flatnonzero(~same)
        rank[p] = np.repeat(tied[first], np.diff(np.append(first, len(p))))
        tied = tied[same | np.append(same[1:], False)]
        h *= 2
    a, b = order[:-1], order[1:]
    floor = min(least.bit_length() - 1, len(levels) - 1)
    at = np.flatnonzero(levels[floor][a] == levels[floor][b])      # only these can share ``least`` words
    a, b = a[at], b[at]
    shared = np.zeros(len(at), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + shared, b + shared
        inside = (x < end[a]) & (y < end[b])
        x, y = np.where(inside, x, 0), np.where(inside, y, 0)
        shared[inside & (levels[k][x] == levels[k][y])] += 1 << k
    lcp = np.zeros(n + 1, np.int64)
    lcp[at + 1] = shared
    lcp[lcp < least] = 0
    kept = np.flatnonzero((lcp[:-1] > 0) | (lcp[1:] > 0))
    return order[kept], lcp[:-1][kept]


# 3. the tree -------------------------------------------------------------------------
def _stretch(every: list, i: int, own: list, m: int, step: int) -> int:
    """How many neighbours from every[i] on (upwards or downwards) are own[m] on."""
    most = min(len(every) - i, len(own) - m) if step > 0 else min(i, m) + 1
    lo, hi = 1, 2
    while hi < most and every[i + step * hi] == own[m + step * hi]:
        lo, hi = hi, 2 * hi
    hi = min(hi, most)
    while lo < hi:
        mid = (lo + hi) // 2
        if every[i + step * mid] == own[m + step * mid]:
            lo = mid + 1
        else:
            hi = mid
    return lo


class _Tree:
    """Nodes are [positions, {left word: positions}], both ascending."""

    def __init__(self, left: list, min_length: int):
        self.left, self.min_length, self.found = left, min_length, []

    def leaf(self, x: int):
        return [[x], {self.left[x]: [x]}]

    def pairs(self, node, x: int, size: int) -> None:
        """Maximal pairs of position x with a node's, ``size`` words long and at most that far apart."""
        every, classes = node
        word = self.left[x]
        own = classes.get(word)
        if own is not None and len(own) == len(every):
            return
        near = max(1, self.min_length - size)
        middle = bisect_left(every, x)
        for step, i in ((1, middle), (-1, middle - 1)):
            while 0 <= i < len(every):
                y = every[i]
                apart = abs(y - x)
                if apart > size:
                    break
                if self.left[y] == word:
                    i += step * _stretch(every, i, own, bisect_left(own, y), step)
                    continue
                if apart >= near:
                    self.found.append((min(x, y), apart + size, apart))
                i += step

    def join(self, a, b, size: int):
        if len(a[0]) < len(b[0]):
            a, b = b, a
        for x in b[0]:
            self.pairs(a, x, size)
        few = 16 * len(b[0]) < len(a[0]) or len(b[0]) == 1
        _merge(a[0], b[0], few)
        for word, places in b[1].items():
            own = a[1].get(word)
            if own is None:
                a[1][word] = places
            else:
                _merge(own, places, few)
        return a

    def walk(self, order: list, lcp: list) -> None:
        """Bottom-up over suffixes in order; lcp[k] is shared by order[k - 1] and order[k]."""
        open_nodes = []                          # [size, node], sizes ascending
        for k, x in enumerate(order):
            size = lcp[k + 1] if k + 1 < len(order) else 0
            node = self.leaf(x)
            while open_nodes and open_nodes[-1][0] > size:
                deep, before = open_nodes.pop()
                node = self.join(before, node, deep)
            if open_nodes and open_nodes[-1][0] == size:
                open_nodes[-1][1] = self.join(open_nodes[-1][1], node, size)
            elif size:
                open_nodes.append([size, node])


def _merge(into: list, places: list, few: bool) -> None:
    if few:
        for x in places:
            if x > into[-1]:
                into.append(x)
            else:
                insort(into, x)
    else:
        into.extend(places)
        into.sort()


def block_runs(words: ta.Words, min_length: int = MIN_LENGTH) -> np.ndarray:
    """(first word of the run, length, period) of all runs in a block, by
    first word, then period; words are numbered within the block."""
    none = np.zeros((0, 3), np.int64)
    least = max(1, (min_length + 1) // 2)
    by_row = lambda h, row: ta.mix64(h ^ ta.mix64(row.astype(np.uint64) + ta.U64(1)))
    at, h = ta.windows(words, least)
    key = by_row(h, words.row[at])
    order = np.argsort(key)
    again = key[order][1:] == key[order][:-1]
    if not again.any():
        return none
    rows = np.zeros(len(words.counts), bool)
    rows[words.row[at[order[1:][again]]]] = True
    some = np.flatnonzero(rows[words.row])
    row = words.row[some]
    _, value = np.unique(by_row(words.hash[some], row), return_inverse=True)
    head = np.concatenate([[True], row[1:] != row[:-1]])
    ends = np.append(np.flatnonzero(head)[1:], len(row))
    end = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
    places, lcp = suffix_order(value, end, least)
    left = np.concatenate([[-1], value[:-1]])
    left[head] = -1
    tree = _Tree(left.tolist(), min_length)
    tree.walk(places.tolist(), lcp.tolist())
    if not tree.found:
        return none
    found = np.array(tree.found, np.int64)
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    least_period = np.ones(len(found), bool)
    least_period[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[least_period]
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    found[:, 0] = some[found[:, 0]]
    return found


def described(text, min_length: int = MIN_LENGTH):
    """Column struct<n_words, runs, collapsed> of a text column."""

    @F.arrow_udf(_OUT)
    def describe(column: pa.Array) -> pa.Array:
        counts, firsts, runs, texts = [], [0], [], []
        for block in ta.blocks(column):
            words = ta.Words(block, ta.NON_SPACE, lower=False)
            found = block_runs(words, min_length)
            dropped = np.zeros(len(words.hash) + 1, np.int64)
            np.add.at(dropped, found[:, 0] + found[:, 2], 1)
            np.add.at(dropped, found[:, 0] + found[:, 1], -1)
            dropped = np.cumsum(dropped) > 0
            row = words.row[found[:, 0]] if len(found) else np.zeros(0, np.int64)
            touched = np.bincount(row, minlength=block.n)
            for r in range(block.n):
                parts = block.text(r).split()
                if touched[r]:
                    gone = dropped[words.first[r]:words.first[r + 1]]
                    parts = [w for w, g in zip(parts, gone) if not g]
                texts.append(b" ".join(parts))
            found[:, 0] -= words.first[row]
            counts.append(words.counts)
            firsts += (firsts[-1] + np.cumsum(touched)).tolist()
            runs.append(found)
        runs = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
        items = pa.StructArray.from_arrays([pa.array(runs[:, i]) for i in range(3)], fields=list(_RUN))
        return pa.StructArray.from_arrays(
            [pa.array(np.concatenate(counts) if counts else [], pa.int64()),
             pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), items),
             pa.array(texts, pa.binary()).cast(pa.string())], ["n_words", "runs", "collapsed"])

    return describe(text)


def detect(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """``docs`` plus n_words, runs (array<struct<start, length, period>> by
    start, then period; words are numbered from 0) and collapsed: the text
    without the words that a run repeats, its words joined by one space."""
    ship_library(docs.sparkSession)
    added = ("n_words", "runs", "collapsed")
    names = [c for c in docs.columns if c not in added]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), described(F.col(f"`{text}`").cast("string"), min_length).alias("found"))
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in names], *[F.col(f"found.{c}").alias(c) for c in added])
