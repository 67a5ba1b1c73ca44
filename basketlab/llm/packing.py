"""Best-fit packing of tokenised documents into sequences of a fixed length.

Lengths are whole numbers up to the capacity, so the histogram of piece lengths says all that a
packing needs: it is gathered (at most ``capacity`` rows, however many documents there are) and
planned on the driver; the pieces themselves only look their places up.

1. Large pieces, in order of length, form groups of equal cardinality; each length is rounded up
   to the longest of its group, so few sizes are left.
2. A linear programme over configurations (which sizes share a sequence) is solved by column
   generation: a knapsack over the dual prices finds the next configuration. Whole multiples of
   the configurations are kept, what the fractions leave over goes to step 4.
3. The actual pieces take the places of the rounded sizes, longest first.
4. All other pieces are put in by best fit, longest first: the place with the least room that is
   enough, a new sequence if there is none.

All steps work on runs (so many pieces of a length in so many sequences), so the plan has a few
rows per length. A piece finds its run by (length, rank); ranks come from counts per task.

Null and empty texts are one piece that holds the end token alone. Repeated rows and ids are
packed one by one. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlab.llm.common import byte_list, cut

CAPACITY = 2048
# Pieces above capacity / k are large and grouped, the rest only fills gaps; k is the one of these
# whose plan has the fewest sequences.
LARGE = (2, 3, 4, 8)
GROUPS = 64
# Configurations tried at most; the plan is right, if a little longer, wherever the search ends.
COLUMNS = 3000

# Fixed value: the pattern that parts a text before the merges, in its possessive form.
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def encoding(path: str):
    """The byte-level BPE of a tokenizer file as a fast encoder of the text between added tokens."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    # Byte-level vocabularies write a byte as its own character if that is visible, else as one from 256 on.
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    byte = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
    merged = {a + b for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])}
    ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t in merged or len(t) == 1}
    return tiktoken.Encoding("pieces", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


# Fixed value: white space as the pattern knows it. Runs are cut that the pattern would backtrack through.
_LONG = 512
_SPACES = re.compile(r"[ \t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % _LONG)


def _parts(text: str) -> list[str]:
    """The text cut before the last sign of each long run of white space inside it, where the pattern cuts too."""
    # A run of twice the length fills one of these cells; shorter ones are harmless.
    if not any(text[k : k + _LONG].isspace() for k in range(0, len(text), _LONG)):
        return [text]
    cuts = [m.end() - 1 for m in _SPACES.finditer(text) if m.end() < len(text)]
    return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]


def _encode(encoder, text: str) -> list[np.ndarray]:
    return [encoder.encode_to_numpy(part, disallowed_special=()) for part in _parts(text)]


def tokens(encoder, text: bytes) -> np.ndarray:
    """Ids of a text and the end id 0, added tokens read as text."""
    return np.concatenate([*_encode(encoder, text.decode("utf-8", "replace")), [0]]).astype("<u4")


def tokenizer(path: str) -> Callable[[bytes], np.ndarray]:
    """Ids of a text as ``tokenizers`` gives them at its defaults, and the end id 0.

    Texts are cut at the file's added tokens first; each is one id.
    """
    encoder = encoding(path)
    with open(path, encoding="utf-8") as file:
        rows = json.load(file).get("added_tokens") or []
    if any(r.get(k) for r in rows for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens must stand for themselves alone")
    added = {r["content"]: r["id"] for r in rows}
    names = "|".join(map(re.escape, sorted(added, key=len, reverse=True)))
    cuts = re.compile(f"({names})" if names else "((?!))")

    def ids(text: bytes) -> np.ndarray:
        out: list = []
        for k, part in enumerate(cuts.split(text.decode("utf-8", "replace"))):
            out += [[added[part]]] if k % 2 else _encode(encoder, part)
        return np.concatenate([*out, [0]]).astype("<u4")

    return ids


def pieces(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """One row per piece, with its task and its rank among the pieces of its length in that task."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = tokenizer(path), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            out: list[tuple] = []
            for name, value in zip(batch["doc_id"].to_pylist(), byte_list(batch["text"])):
                ids = encode(value)
                first = len(ids) % capacity or capacity
                starts = [0, *range(first, len(ids), capacity)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    out.append((name, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), task, seen[b - a]))
                    seen[b - a] += 1
            columns = list(zip(*out)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"],
            )

    return rows.mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"
    )


def _best_configuration(sizes: list[int], price: np.ndarray, limit: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of highest price: a knapsack over the rounded sizes."""
    best = np.zeros(capacity + 1)
    steps = []
    for g, size in enumerate(sizes):
        if price[g] <= 1e-12:
            continue
        for _ in range(int(min(capacity // size, limit[g]))):
            offer = best[:-size] + price[g]
            better = offer > best[size:] + 1e-12
            if not better.any():
                break
            best[size:] = np.where(better, offer, best[size:])
            steps.append((g, size, better))
    room, column = capacity, np.zeros(len(sizes))
    for g, size, better in reversed(steps):
        if room >= size and better[room - size]:
            column[g] += 1
            room -= size
    return float(best[capacity]), column


def configurations(sizes: list[int], need: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often to use them, never more of a size than there is."""
    k = len(sizes)
    if not k:
        return []
    basis = np.diag([float(capacity // s) for s in sizes])
    for _ in range(COLUMNS):
        price = np.linalg.solve(basis.T, np.ones(k))
        worth, column = _best_configuration(sizes, price, need, capacity)
        if worth <= 1 + 1e-9:
            break
        amounts = np.linalg.solve(basis, need.astype(float))
        change = np.linalg.solve(basis, column)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(change > 1e-9, np.maximum(amounts, 0) / change, np.inf)
        leave = int(ratio.argmin())
        if not np.isfinite(ratio[leave]):
            break
        basis[:, leave] = column
    amounts = np.floor(np.maximum(np.linalg.solve(basis, need.astype(float)), 0) + 1e-9).astype(np.int64)
    left, out = need.astype(np.int64).copy(), []
    for j in np.argsort(-amounts, kind="stable"):
        column = basis[:, j].astype(np.int64)
        used = column > 0
        times = min(int(amounts[j]), int((left[used] // column[used]).min()))
        if times:
            left -= column * times
            out.append((column, times))
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> np.ndarray:
    """The shortest of the plans for the ``LARGE`` bounds."""
    return min((_plan(counts, capacity, groups, k) for k in LARGE), key=lambda p: p[0])[1]


def _plan(counts: dict[int, int], capacity: int, groups: int, divisor: int) -> tuple[int, np.ndarray]:
    """Sequences, and runs (length, first rank, first sequence, pieces per sequence, offset) for the counts.

    The piece of rank r of a run is in sequence first + (r - first rank) // per, at the offset plus
    length * ((r - first rank) % per).
    """
    left, taken = dict(counts), defaultdict(int)
    runs: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: (first sequence, sequences)
    sequences = 0

    def place(length: int, n: int, first: int, per: int, offset: int) -> None:
        runs.append((length, taken[length], first, per, offset))
        taken[length] += n
        left[length] -= n

    # Groups of equal cardinality over the large lengths, as lists of (length, pieces), longest first.
    large = sorted((s for s, n in counts.items() if s * divisor > capacity and n), reverse=True)
    total = sum(counts[s] for s in large)
    target = -(-total // groups) if total else 0
    grouped: list[list[list[int]]] = []
    space = 0
    for s in large:
        n = counts[s]
        while n:
            if not space:
                grouped.append([])
                space = target
            part = min(n, space)
            grouped[-1].append([s, part])
            n, space = n - part, space - part
    sizes = [g[0][0] for g in grouped]
    need = np.array([sum(n for _, n in g) for g in grouped], np.int64)
    for column, times in configurations(sizes, need, capacity):
        parts = [(0, times, 0)]  # (first sequence of the run, sequences, filled)
        for g in np.flatnonzero(column):
            for _ in range(column[g]):
                split = []
                for first, n, filled in parts:
                    while n:
                        s, have = grouped[g][0]
                        k = min(n, have)
                        place(s, k, sequences + first, 1, filled)
                        split.append((first, k, filled + s))
                        first, n = first + k, n - k
                        grouped[g][0][1] -= k
                        if have == k:
                            grouped[g].pop(0)
                parts = split
        for first, n, filled in parts:
            room[capacity - filled].append((sequences + first, n))
        sequences += times

    open_room = np.zeros(capacity + 1, bool)
    open_room[[r for r, x in room.items() if x]] = True
    for s in sorted((s for s, n in left.items() if n), reverse=True):
        while left[s]:
            fits = np.flatnonzero(open_room[s:])
            if len(fits):
                r = int(s + fits[0])
                first, n = room[r].pop()
                open_room[r] = bool(room[r])
            else:
                r = capacity
                first, n = sequences, -(-left[s] // (capacity // s))
                sequences += n
            per = r // s
            full = min(n, left[s] // per)
            if full:
                place(s, full * per, first, per, capacity - r)
                room[r - per * s].append((first, full))
                open_room[r - per * s] = True
            if full < n:
                rest = left[s]
                used = full
                if rest:  # fewer than one sequence takes
                    place(s, rest, first + full, rest, capacity - r)
                    room[r - rest * s].append((first + full, 1))
                    open_room[r - rest * s] = True
                    used += 1
                if used < n:
                    room[r].append((first + used, n - used))
                    open_room[r] = True
    return sequences, np.array(sorted(runs), np.int64).reshape(-1, 5)


def pack(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """Pieces with the sequence they are in and their offset there."""
    rows = cut(pieces(docs, path, doc_id, text, capacity))
    per_task = rows.groupBy("task", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    # Counts are small: written by as many tasks as run at once, not by one for each shuffle partition,
    # whose footers would outweigh the rows and turn the join below from a broadcast into a shuffle.
    at_once = docs.sparkSession.sparkContext.defaultParallelism
    per_task = cut(
        per_task.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).coalesce(at_once)
    )
    counts = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = plan(counts, capacity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (runs[:, 0] << 48) | runs[:, 1]
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy() + batch["before"].to_numpy()
            at = np.searchsorted(keys, (length << 48) | rank, side="right") - 1
            behind = rank - runs[at, 1]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")],
                    pa.array(runs[at, 2] + behind // runs[at, 3]),
                    pa.array(runs[at, 4] + behind % runs[at, 3] * length),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return rows.join(per_task.select("task", "length", "before"), ["task", "length"]).mapInArrow(
        run,
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
