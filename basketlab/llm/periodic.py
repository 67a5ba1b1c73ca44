"""Periodic runs of words: stretches in which a root of q words repeats at least four times.

A run is a stretch of consecutive words with smallest period q, at least ``max(LEAST, COPIES * q)``
words long, that no neighbouring word extends with that period. Runs come from the Lyndon roots of
both word orders (every run has a root whose longest Lyndon word, in one of the orders, is the root
itself); a root is extended to both sides by longest common extensions, which are lowest common
ancestors in the suffix trees (Ukkonen) of the words and of their reversal. The Euler tour of a tree
is kept as the least depth between one leaf and the next; a sparse table answers each extension in
constant time, for all roots of a batch at once.

Trees are built over the stretches that can hold a run and no others: inside a run every four
words stand q words after the same four words, so a run lies in a stretch of consecutive near
repeats at least three times as long as their distance. That is a necessary condition; it drops no run.

Results: null and empty texts have no words and no run, and a collapsed text ``''``. Equal rows get
equal results. A text may have any length; the trees of one stretch are held in memory (about 400 bytes a
word). A null id is kept. An empty table gives an empty result. Columns named ``runs`` or
``collapsed`` are replaced; all others, whatever their names, are carried.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlab.llm.common import add_columns, byte_list

# Fewest words of a run, and fewest copies of its root.
LEAST, COPIES = 6, 4
# Words of a gram whose repeats mark stretches; trees are built over about so many words at once.
GRAM, TREE_WORDS = 4, 20_000

RUNS = T.ArrayType(
    T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]), True
)
_RUNS = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))


class Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def suffix_tree(s: list[int]) -> tuple[list[int], list[int], list[dict | None]]:
    """Ukkonen's tree of ``s``, whose last symbol stands nowhere else.

    Node 0 is the root. The edge into node v is ``s[first[v]:stop[v]]``; leaves have no children
    and reach to the end.
    """
    n = len(s)
    first, stop, link, kids = [0], [0], [0], [{}]
    node = edge = length = pending = 0
    for i, c in enumerate(s):
        pending += 1
        last = 0
        while pending:
            if not length:
                edge = i
            children = kids[node]
            head = s[edge]
            v = children.get(head)
            if v is None:
                children[head] = len(first)
                first.append(i)
                stop.append(n)
                link.append(0)
                kids.append(None)
                if last:
                    link[last] = node
                    last = 0
            else:
                at = first[v]
                width = stop[v] - at
                if length >= width:
                    edge += width
                    length -= width
                    node = v
                    continue
                at += length
                if s[at] == c:
                    length += 1
                    if last:
                        link[last] = node
                    break
                middle = len(first)
                children[head] = middle
                first += (first[v], i)
                stop += (at, n)
                link += (0, 0)
                kids += ({c: middle + 1, s[at]: v}, None)
                first[v] = at
                if last:
                    link[last] = middle
                last = middle
            pending -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - pending + 1
    return first, stop, kids


class Extensions:
    """Longest common extensions of pairs of places, by lowest common ancestors of their leaves."""

    def __init__(self, s: list[int]):
        first, stop, kids = suffix_tree(s)
        order, low = [], []
        # Euler tour, children by symbol; ``least`` is the depth of the highest node since the last leaf.
        least = 0
        todo = [(0, 0, False)]
        while todo:
            v, above, turned = todo.pop()
            if turned:
                least = above
            children = kids[v]
            if children is None:
                order.append(first[v] - above)
                low.append(least)
                continue
            depth = above + stop[v] - first[v]
            symbols = sorted(children, reverse=True)
            todo += [(children[c], depth, True) for c in symbols[:-1]]
            todo.append((children[symbols[-1]], depth, False))
        n = len(s)
        self.rank = np.empty(n, np.int64)
        self.rank[np.array(order, np.int64)] = np.arange(n)
        self.table = [np.array(low, np.int32)]
        half = 1
        while 2 * half <= n:
            below = self.table[-1]
            self.table.append(np.minimum(below[:-half], below[half:]))
            half *= 2

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Symbols that agree from places ``i`` and ``j`` on; the places of a pair differ."""
        a, b = self.rank[i], self.rank[j]
        left, right = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp((right - left + 1).astype(np.float64))[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level):
            here = level == k
            row = self.table[k]
            out[here] = np.minimum(row[left[here]], row[right[here] - (1 << int(k)) + 1])
        return out


def _next_less(rank: list[int]) -> np.ndarray:
    """For each place the next one with a lower value, or the end: the longest Lyndon word from there."""
    n = len(rank)
    out = [n] * n
    waiting: list[int] = []
    for i, r in enumerate(rank):
        while waiting and rank[waiting[-1]] > r:
            out[waiting.pop()] = i
        waiting.append(i)
    return np.array(out, np.int64)


def runs_of(s: list[int]) -> np.ndarray:
    """(start, length, period) of all runs of ``s``, whose first and last symbol stand nowhere else."""
    n = len(s)
    ahead, back = Extensions(s), Extensions(s[::-1])
    rank = ahead.rank.tolist()
    found = []
    # No suffix is a prefix of another, so the order of the reversed alphabet is the reverse order.
    for ranks in (rank, [n - 1 - r for r in rank]):
        j = _next_less(ranks)
        i = np.flatnonzero((j < n) & (np.arange(n) > 0))
        j = j[i]
        period = j - i
        start = i - back.of(n - i, n - j)
        length = j + ahead.of(i, j) - start
        good = length >= np.maximum(LEAST, COPIES * period)
        found.append(np.stack([start[good], length[good], period[good]], 1))
    return np.unique(np.concatenate(found), axis=0)


def stretches(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(from, to) of disjoint parts of the documents ``words[starts:ends]`` that hold all runs."""
    n = len(words)
    if n < LEAST:
        return np.empty((0, 2), np.int64)
    own = np.repeat(np.arange(len(starts)), ends - starts)
    key = own.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(GRAM):
        part = words[k:].astype(np.uint64) + np.uint64(1)
        key[: n - k] = (key[: n - k] ^ part) * np.uint64(0x9E3779B97F4A7C15)
    at = np.arange(n)
    whole = at + GRAM <= ends[own]
    at = at[whole]
    order = np.argsort(key[whole], kind="stable")
    same = np.flatnonzero(key[whole][order[1:]] == key[whole][order[:-1]])
    later, earlier = at[order[same + 1]], at[order[same]]
    near = own[later] == own[earlier]
    later, gap = later[near], (later - earlier)[near]
    by_place = np.argsort(later, kind="stable")
    place, gap = later[by_place], gap[by_place]
    parts = []
    reach = 1
    longest = int((ends - starts).max())
    while len(place) and reach // 2 < max(longest // COPIES, 1):
        some = gap <= reach
        p = place[some]
        if len(p):
            breaks = np.flatnonzero((np.diff(p) != 1) | (np.diff(own[p]) != 0))
            low = p[np.concatenate([[0], breaks + 1])]
            high = p[np.concatenate([breaks, [len(p) - 1]])]
            # A run of period q in (reach / 2, reach] has so many grams q words after the same.
            q = reach // 2 + 1
            need = max(LEAST, COPIES * q) - q - GRAM + 1
            long_enough = high - low + 1 >= need
            low, high = low[long_enough], high[long_enough]
            doc = own[low]
            parts.append(np.stack([np.maximum(low - reach, starts[doc]), high + GRAM], 1))
        reach *= 2
    if not parts:
        return np.empty((0, 2), np.int64)
    parts = np.concatenate(parts)
    parts = parts[np.argsort(parts[:, 0], kind="stable")]
    if not len(parts):
        return parts
    top = np.maximum.accumulate(parts[:, 1])
    fresh = np.concatenate([[True], (parts[1:, 0] > top[:-1]) | (own[parts[1:, 0]] != own[parts[:-1, 0]])])
    heads = np.flatnonzero(fresh)
    return np.stack([parts[heads, 0], np.maximum.reduceat(parts[:, 1], heads)], 1)


def find(lists: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Runs of each list of words, by start, then period."""
    number = Numbers()
    ends = np.cumsum([len(w) for w in lists], dtype=np.int64)
    starts = ends - np.array([len(w) for w in lists], np.int64)
    words = np.fromiter((number[w] for ws in lists for w in ws), np.int64, int(ends[-1]) if len(ends) else 0)
    found: list[list[tuple[int, int, int]]] = [[] for _ in lists]
    parts = stretches(words, starts, ends).tolist()
    k = 0
    while k < len(parts):
        # Symbols past all words stand between the stretches, each once.
        mark = len(number)
        text, place = [mark], [-1]
        while k < len(parts) and (len(text) == 1 or len(text) + parts[k][1] - parts[k][0] < TREE_WORDS):
            a, b = parts[k]
            mark += 1
            text += words[a:b].tolist()
            text.append(mark)
            place += range(a, b)
            place.append(-1)
            k += 1
        got = runs_of(text)
        first = np.array(place, np.int64)[got[:, 0]]
        doc = np.searchsorted(ends, first, side="right")
        for d, at, length, period in zip(doc.tolist(), (first - starts[doc]).tolist(), got[:, 1].tolist(), got[:, 2].tolist()):
            found[d].append((at, length, period))
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that no run holds after its first root."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def scan(
    docs: DataFrame,
    text: str = "text",
    rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
    key: str = "doc_id",
) -> DataFrame:
    """``docs`` with the array ``runs`` of each text and ``collapsed``, its words with one root of each run.

    ``rewrite`` may change the words of a row, given its ``key``, before they are searched.
    """

    def start():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            lists = [t.split() for t in byte_list(batch.column(batch.schema.get_field_index(text)))]
            if rewrite:
                ids = batch.column(batch.schema.get_field_index(key)).to_pylist()
                lists = [rewrite(d, w) for d, w in zip(ids, lists)]
            found = find(lists)
            flat = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
            offsets = np.cumsum([0, *[len(r) for r in found]], dtype=np.int32)
            items = pa.StructArray.from_arrays(
                [pa.array(flat[:, c]) for c in range(3)], names=["start", "length", "period"]
            )
            runs = pa.ListArray.from_arrays(pa.array(offsets), items).cast(_RUNS)
            short = pa.array([b" ".join(collapse(w, r)) for w, r in zip(lists, found)], pa.binary())
            return [runs, short.cast(pa.string())]

        return work

    return add_columns(docs, start, [("runs", RUNS), ("collapsed", T.StringType())])


def digest(found: DataFrame) -> DataFrame:
    """Per document the number of runs, the longest one and the hashes of all runs and of the collapsed text."""
    runs = F.col("runs")
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))

    def better(best: Column, run: Column) -> Column:
        # Runs come by start, then period, so the first of the longest is the one.
        return F.when(best.isNull() | (run["length"] > best["length"]), run).otherwise(best)

    none = F.lit(None).cast(RUNS.elementType)
    top = F.aggregate(runs, none, better)
    return (
        found.withColumn("__top", top)
        .withColumn("__lines", F.array_join(lines, ""))
        .select(
            "doc_id",
            F.size(runs).cast("long").alias("n_runs"),
            *[F.col(f"__top.{c}").alias(c) for c in ("start", "length", "period")],
            F.expr("__top.length * 1000 div __top.period").alias("exponent_milli"),
            F.sha2(F.col("__lines").cast("binary"), 256).alias("runs_sha256"),
            F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        )
    )
