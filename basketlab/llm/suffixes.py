"""Suffix-array dedup: remove bytes of passages that also start in an earlier document.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller
id. Strings are judged on the input, never across documents. The work is a merge sort of suffixes:

1. Copies of a whole text (known by hash) need no sorting: only the one with the smallest id counts.
2. Anchors. In every window of ``LENGTH`` bytes the ``GRAM``-byte string of least hash is an anchor,
   so two equal strings have an anchor at the same place. Documents form blocks; each block sends
   the sorted hashes of its anchors, front-coded as differences, to ranges of hashes, which answer
   with a bit per hash: does it occur in another block? Only anchors whose string occurs in two
   documents go on. This only saves work: which strings are equal is read off their bytes.
3. Suffixes. An anchor's suffix is the text from the anchor on, up to ``LENGTH`` bytes, then the
   bytes before it, read backwards. Each block sorts its distinct suffixes, keeps the smallest id of
   each (later documents of the block are answered on the spot), front-codes the sorted runs (length
   of the common prefix, then the rest) and sends them to ranges of suffixes.
4. Each range merges its runs with a loser tree. Its entries carry the length of the prefix they share
   with the last winner: entries of different lengths are ordered by these alone, and entries of equal
   length are compared from there on, so a known prefix is never read again. The merged
   suffixes come with their common prefixes, which say at once which strings around an anchor are
   equal and thus which have an earlier owner.
5. Each block marks its bytes from the answers. A string that repeats inside a document was answered
   once; its other places in that document are known by a 64-bit hash.

Ranges are cut by quantiles of a bounded sample of suffixes, so that a string's suffixes stay in one
range. Blocks hold about ``BLOCK`` bytes; a longer document is a block of its own.

Null and empty texts have no bytes. Repeated rows have the same result; rows of one id do not remove
each other's strings, since none is smaller. Null ids come before all others, as the smallest.
Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlab.llm.common import cut, discard, mix

LENGTH = 50
GRAM = 24
LEFT = LENGTH - GRAM
# Bytes of a suffix key: text on, text back, and the two lengths.
KEY = LENGTH + LEFT + 2
BLOCK = 8 << 20
# Suffixes a block adds to the sample that cuts the ranges; sampled blocks are bounded too.
SAMPLE, SAMPLED_BLOCKS = 64, 512
_BASE = 0x9E3779B97F4A7C15
_PIECE = 1 << 20


# ---------------------------------------------------------------- hashes of all strings of a length
def string_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """Hash of every string of ``length`` bytes, by doubling."""
    if len(data) < length:
        return np.empty(0, np.uint64)
    power, size = data.astype(np.uint64) + np.uint64(1), 1
    out, done, rest = None, 0, length
    while rest:
        if rest & 1:
            if out is None:
                out, done = power, size
            else:
                n = len(data) - done - size + 1
                out = out[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + power[done : done + n]
                done += size
        rest >>= 1
        if rest:
            n = len(data) - 2 * size + 1
            power = power[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + power[size : size + n]
            size *= 2
    return mix(out)


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Least or greatest of every run of ``width`` values."""
    size = 1
    while 2 * size <= width:
        values = pick(values[:-size], values[size:])
        size *= 2
    return pick(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of texts that stand one after the other (``ends``)."""
    width = LENGTH - GRAM + 1
    h = string_hashes(data, GRAM)
    if len(h) < width:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    least = _slide(h, width, np.minimum)
    # A window that runs past its text chooses nothing.
    inner = ends[ends < len(data)]
    for back in range(1, LENGTH):
        spot = inner - back
        spot = spot[(spot >= 0) & (spot < len(least))]
        least[spot] = 0
    none = np.zeros(width - 1, np.uint64)
    chosen = _slide(np.concatenate((none, least, none)), width, np.maximum)
    at = np.flatnonzero(h == chosen[: len(h)])
    return at, h[at]


class Block:
    """Texts of a block as one array of bytes, with the anchors of all of them."""

    def __init__(self, group: pa.Table):
        ids = group["doc_id"].to_pylist()
        hashes = group["text_hash"].to_pylist()
        texts = [v or b"" for v in group["text"].cast(pa.large_binary()).to_pylist()]
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0, hashes[k]))
        self.ids = [ids[k] for k in order]
        self.hashes = [hashes[k] for k in order]
        self.texts = [texts[k] for k in order]
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)

    def find_anchors(self) -> None:
        places, found = [], []
        first = 0
        while first < len(self.texts):
            # As many whole texts as make a piece that stays in the cache.
            last = int(np.searchsorted(self.ends, self.starts[first] + _PIECE))
            last = min(max(last, first + 1), len(self.texts))
            a, b = self.starts[first], self.ends[last - 1]
            at, h = anchors(self.data[a:b], self.ends[first:last] - a)
            places.append(at + a)
            found.append(h)
            first = last
        self.at = np.concatenate(places) if places else np.empty(0, np.int64)
        self.anchor = np.concatenate(found) if found else np.empty(0, np.uint64)
        self.owner = np.searchsorted(self.ends, self.at, side="right")
        self.rank = np.array([_rank(i) for i in self.ids], np.int64)

    def keys(self, pick: np.ndarray) -> np.ndarray:
        """Suffix keys of some anchors, one row of bytes each."""
        at, owner = self.at[pick], self.owner[pick]
        ahead = np.minimum(self.ends[owner] - at, LENGTH)
        behind = np.minimum(at - self.starts[owner], LEFT)
        out = np.zeros((len(at), KEY), np.uint8)
        padded = np.concatenate((np.zeros(LEFT, np.uint8), self.data, np.zeros(LENGTH, np.uint8)))
        for k in range(LENGTH):
            out[:, k] = np.where(k < ahead, padded[at + LEFT + k], 0)
        for k in range(LEFT):
            out[:, LENGTH + k] = np.where(k < behind, padded[at + LEFT - 1 - k], 0)
        out[:, KEY - 2], out[:, KEY - 1] = ahead, behind
        return out


# ---------------------------------------------------------------- front-coded runs
def code_hashes(sorted_hashes: np.ndarray) -> bytes:
    """Sorted hashes as differences, in four bytes each where these do, else in eight."""
    steps = np.diff(sorted_hashes, prepend=np.uint64(0))
    small = len(steps) < 2 or int(steps[1:].max()) < 1 << 32
    head = np.array([len(steps), small], "<u8").tobytes() + (steps[:1].astype("<u8").tobytes())
    return head + steps[1:].astype("<u4" if small else "<u8").tobytes()


def decode_hashes(blob: bytes) -> np.ndarray:
    n, small = np.frombuffer(blob, "<u8", 2)
    steps = np.concatenate(
        (np.frombuffer(blob, "<u8", 1, 16), np.frombuffer(blob, "<u4" if small else "<u8", int(n) - 1, 24))
    )
    return np.cumsum(steps.astype(np.uint64))


def common_prefixes(keys: np.ndarray) -> np.ndarray:
    """Length of the prefix each row shares with the row before (0 for the first)."""
    out = np.zeros(len(keys), np.uint8)
    if len(keys) > 1:
        differs = keys[1:] != keys[:-1]
        out[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), KEY)
    return out


def sort_rows(keys: np.ndarray) -> np.ndarray:
    """Order of rows of bytes."""
    words = -(-KEY // 8)
    wide = np.zeros((len(keys), words * 8), np.uint8)
    wide[:, :KEY] = keys
    columns = wide.view(">u8").astype(np.uint64)
    return np.lexsort(columns.T[::-1])


def code_run(keys: np.ndarray, docs: np.ndarray, places: np.ndarray) -> bytes:
    """A sorted run: common prefixes, then the rest of each key, owners and places."""
    prefix = common_prefixes(keys)
    rest = keys[np.arange(KEY) >= prefix[:, None]]
    parts = [np.array([len(keys)], "<u8"), prefix, docs.astype("<i8"), places.astype("<i8"), rest]
    return b"".join(p.tobytes() for p in parts)


def decode_run(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, "<u8", 1)[0])
    prefix = np.frombuffer(blob, np.uint8, n, 8)
    docs = np.frombuffer(blob, "<i8", n, 8 + n)
    places = np.frombuffer(blob, "<i8", n, 8 + 9 * n)
    rest = np.frombuffer(blob, np.uint8, -1, 8 + 17 * n)
    # Row k of a column is the last row whose coded part reaches that column.
    keys = np.zeros((n, KEY), np.uint8)
    own = np.arange(KEY) >= prefix[:, None]
    keys[own] = rest
    for c in range(KEY):
        source = np.maximum.accumulate(np.where(own[:, c], np.arange(n), 0))
        keys[:, c] = keys[source, c]
    return keys, prefix, docs, places


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """Merge sorted runs of (keys, common prefixes) by a loser tree.

    Returns run, row and length of the prefix shared with the row put out before. Each node keeps the
    loser of its match with the prefix length it shares with the winner; a challenger and a loser that
    both know how much they share with the last row put out need no look at those bytes.
    """
    live = [k for k, (keys, _) in enumerate(runs) if keys]
    width = 1
    while width < len(live):
        width *= 2
    row = [0] * len(runs)
    tree: list[tuple[int, int]] = [(-1, -1)] * width
    out_run: list[int] = []
    out_row: list[int] = []
    out_prefix: list[int] = []

    def shared(a: bytes, b: bytes, start: int) -> int:
        if a == b:
            return KEY
        while a[start] == b[start]:
            start += 1
        return start

    def play(a: tuple[int, int], b: tuple[int, int]) -> tuple[tuple[int, int], tuple[int, int]]:
        """(winner, loser); prefix lengths are against the last row put out."""
        if a[0] < 0:
            return b, a
        if b[0] < 0:
            return a, b
        if a[1] != b[1]:
            return (a, b) if a[1] > b[1] else (b, a)
        x, y = runs[a[0]][0][row[a[0]]], runs[b[0]][0][row[b[0]]]
        at = shared(x, y, a[1]) if a[1] < KEY else KEY
        if at == KEY or x[at] < y[at]:
            return a, (b[0], at)
        return b, (a[0], at)

    level = [(k, 0) for k in live] + [(-1, -1)] * (width - len(live))
    seat = {k: width + i for i, k in enumerate(live)}
    nodes = width
    while len(level) > 1:
        nodes //= 2
        above = []
        for i in range(0, len(level), 2):
            winner, loser = play(level[i], level[i + 1])
            tree[nodes + i // 2] = loser
            above.append(winner)
        level = above
    winner = level[0] if level else (-1, -1)
    while winner[0] >= 0:
        k, prefix = winner
        keys, prefixes = runs[k]
        r = row[k]
        out_run.append(k)
        out_row.append(r)
        out_prefix.append(prefix)
        r += 1
        row[k] = r
        # The next row of this run shares its own common prefix with the row just put out.
        winner = (k, prefixes[r]) if r < len(keys) else (-1, -1)
        node = seat[k] // 2
        while node:
            loser = tree[node]
            if loser[0] >= 0:
                if winner[0] < 0 or loser[1] > winner[1]:
                    tree[node], winner = winner, loser
                elif loser[1] == winner[1]:
                    winner, tree[node] = play(winner, loser)
            node //= 2
    return out_run, out_row, out_prefix


def owned_earlier(keys: np.ndarray, prefix: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Bits per suffix of a sorted table: bit j is set if the string of ``LENGTH`` bytes that starts j
    bytes before the anchor also starts in a document of smaller rank.

    Two such strings are equal if the suffixes share LENGTH - j bytes on and j bytes back. The first is
    read off the common prefixes; for the second the backward parts are sorted once.
    """
    n = len(keys)
    bits = np.zeros(n, np.int64)
    back = np.zeros((n, 32), np.uint8)
    back[:, :LEFT] = keys[:, LENGTH : LENGTH + LEFT]
    words = back.view(">u8").astype(np.uint64)
    order = np.lexsort(words.T[::-1])
    sorted_back = back[order]
    differs = sorted_back[1:] != sorted_back[:-1]
    shared = np.where(differs.any(axis=1), differs.argmax(axis=1), LEFT)
    ahead, behind = keys[:, KEY - 2], keys[:, KEY - 1]
    for j in range(LEFT + 1):
        valid = (behind >= j) & (ahead >= LENGTH - j)
        right = np.cumsum(prefix < LENGTH - j)
        left = np.empty(n, np.int64)
        left[order] = np.concatenate(([0], np.cumsum(shared < j)))
        rows = np.flatnonzero(valid)
        if not len(rows):
            continue
        string = right[rows] * np.int64(n + 1) + left[rows]
        by = np.argsort(string, kind="stable")
        value = string[by]
        first = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
        least = np.minimum.reduceat(docs[rows][by], first)
        owner = np.repeat(least, np.diff(np.append(first, len(value))))
        late = rows[by][docs[rows][by] > owner]
        bits[late] |= 1 << j
    return bits


# ---------------------------------------------------------------- the jobs
# The rank of a document without an id: before all others.
_ID = -(1 << 63)


def _rank(doc_id: int | None) -> int:
    return _ID if doc_id is None else doc_id


def _judge(docs: DataFrame, doc_id: str, text: str, with_text: bool) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row; kept is null if not asked for."""
    spark = docs.sparkSession
    rows = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(_ID)).alias("rank"),
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"),
    ).withColumn("text_hash", F.sha2("text", 256))
    firsts = cut(rows.groupBy("text_hash").agg(F.min("rank").alias("first"), F.max(F.length("text")).alias("size")))
    total = firsts.agg(F.sum("size")).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK))
    ranges = max(blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # One row per distinct text, with its smallest id, dealt to blocks.
    mine = rows.join(firsts.select("text_hash", F.col("first").alias("rank")), ["text_hash", "rank"])
    mine = mine.dropDuplicates(["text_hash"]).select(
        "doc_id", "text_hash", "text", F.pmod(F.xxhash64("text_hash"), F.lit(blocks)).cast("int").alias("block")
    )
    mine = cut(mine)

    def share_hashes(group: pa.Table) -> pa.Table:
        block = Block(group)
        block.find_anchors()
        every = np.unique(block.anchor)
        bound = np.searchsorted(every, _range_starts(ranges))
        out = [
            (r, group["block"][0].as_py(), code_hashes(every[a:b]))
            for r, (a, b) in enumerate(zip(bound, np.append(bound[1:], len(every))))
            if a < b
        ]
        number = group["block"][0].as_py()
        if number < SAMPLED_BLOCKS and len(every):
            # A few suffixes of distinct anchors, for the cuts of the suffix ranges.
            at = np.unique(block.anchor, return_index=True)[1]
            at = at[np.linspace(0, len(at) - 1, min(SAMPLE, len(at))).astype(int)]
            out += [(-1, number, k.tobytes()) for k in block.keys(at)[:, :GRAM]]
        return _table(out, [("range", pa.int32()), ("block", pa.int32()), ("blob", pa.binary())])

    sent = cut(mine.groupBy("block").applyInArrow(share_hashes, "range int, block int, blob binary"))

    def answer_hashes(group: pa.Table) -> pa.Table:
        runs = [decode_hashes(b) for b in group["blob"].to_pylist()]
        every = np.sort(np.concatenate(runs), kind="stable")
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        out = []
        for block, run in zip(group["block"].to_pylist(), runs):
            at = np.searchsorted(twice, run)
            hit = (at < len(twice)) & (twice[np.minimum(at, max(0, len(twice) - 1))] == run) if len(twice) else np.zeros(len(run), bool)
            out.append((block, group["range"][0].as_py(), np.packbits(hit).tobytes()))
        return _table(out, [("block", pa.int32()), ("range", pa.int32()), ("bits", pa.binary())])

    heads = sorted(bytes(r.blob) for r in sent.where("range < 0").select("blob").collect())
    cuts = sorted({heads[k * len(heads) // ranges] for k in range(1, ranges)}) if heads else []
    bits = cut(sent.where("range >= 0").groupBy("range").applyInArrow(answer_hashes, "block int, range int, bits binary"))

    discard(sent)

    def suffix_runs(group: pa.Table, answers: pa.Table) -> pa.Table:
        """Sorted suffix runs by range; range -1 holds the answers a block gives itself."""
        kinds = [("range", pa.int32()), ("block", pa.int32()), ("blob", pa.binary())]
        if not group.num_rows:
            return _table([], kinds)
        number = group["block"][0].as_py()
        block = Block(group)
        block.find_anchors()
        every, inverse = np.unique(block.anchor, return_inverse=True)
        bound = np.searchsorted(every, _range_starts(ranges))
        bound = np.append(bound, len(every))
        known = np.zeros(len(every), bool)
        for r, b in zip(answers["range"].to_pylist(), answers["bits"].to_pylist()):
            n = bound[r + 1] - bound[r]
            known[bound[r] : bound[r + 1]] = np.unpackbits(np.frombuffer(b, np.uint8), count=n)
        # Or in two documents of this block.
        low = np.full(len(every), len(block.ids))
        high = np.full(len(every), -1)
        np.minimum.at(low, inverse, block.owner)
        np.maximum.at(high, inverse, block.owner)
        pick = np.flatnonzero((known | (low < high))[inverse])
        keys = block.keys(pick)
        order = sort_rows(keys)
        keys, pick = keys[order], pick[order]
        prefix = common_prefixes(keys)
        first = np.flatnonzero(prefix < KEY)
        if not len(pick):
            return _table([], kinds)
        # The smallest document of each suffix stands for it (documents are in order of id).
        rank = block.rank[block.owner[pick]]
        sizes = np.diff(np.append(first, len(pick)))
        late = rank > np.repeat(rank[first], sizes)
        out = []
        if late.any():
            ahead, behind = keys[late, KEY - 2].astype(int), keys[late, KEY - 1].astype(int)
            j = np.arange(LEFT + 1)
            fits = (behind[:, None] >= j) & (ahead[:, None] >= LENGTH - j)
            whole = (fits * (np.int64(1) << j)).sum(axis=1)
            out.append((-1, number, _answer(block.at[pick[late]], whole)))
        # Equal suffixes stand in order of place, so the first is the smallest document's.
        keys, pick, rank = keys[first], pick[first], rank[first]
        heads = [k.tobytes() for k in keys[:, :GRAM]]
        edges = [bisect.bisect_left(heads, c) for c in cuts]
        for r, (a, b) in enumerate(zip([0, *edges], [*edges, len(heads)])):
            if a < b:
                out.append((r, number, code_run(keys[a:b], rank[a:b], block.at[pick[a:b]])))
        return _table(out, kinds)

    runs = cut(
        mine.groupBy("block")
        .cogroup(bits.groupBy("block"))
        .applyInArrow(suffix_runs, "range int, block int, blob binary")
    )

    def merge_runs(group: pa.Table) -> pa.Table:
        decoded = [decode_run(b) for b in group["blob"].to_pylist()]
        lists = [([k.tobytes() for k in keys], prefix.tolist()) for keys, prefix, _, _ in decoded]
        run, row, prefix = (np.array(x) for x in merge(lists))
        del lists
        start = np.cumsum([0] + [len(d[0]) for d in decoded])
        take = start[run] + row
        keys = np.concatenate([d[0] for d in decoded])[take]
        docs_of = np.concatenate([d[2] for d in decoded])[take]
        places = np.concatenate([d[3] for d in decoded])[take]
        prefix[:1] = 0
        # Strings that start with one gram only are alone: nothing to compare.
        alone = np.concatenate((prefix < GRAM, [True]))
        keep = ~(alone[:-1] & alone[1:])
        kept_prefix = prefix[keep].copy()
        found = owned_earlier(keys[keep], kept_prefix, docs_of[keep])
        number = np.array(group["block"].to_pylist())[run][keep]
        places = places[keep]
        out = []
        for b in np.unique(number[found > 0]).tolist():
            mine_now = (number == b) & (found > 0)
            out.append((b, _answer(places[mine_now], found[mine_now])))
        return _table(out, [("block", pa.int32()), ("blob", pa.binary())])

    merged = runs.where("range >= 0").groupBy("range").applyInArrow(merge_runs, "block int, blob binary")
    answers = cut(merged.union(runs.where("range < 0").select("block", "blob")))
    discard(runs)

    kinds = [
        ("text_hash", pa.string()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
        ("kept_sha256", pa.string()), ("kept", pa.binary()),
    ]

    def mark(group: pa.Table, said: pa.Table) -> pa.Table:
        if not group.num_rows:
            return _table([], kinds)
        block = Block(group)
        starts = np.zeros(len(block.data) + 1, bool)
        for blob in said["blob"].to_pylist():
            places, found = _read_answer(blob)
            for j in range(LEFT + 1):
                starts[places[(found >> j) & 1 == 1] - j] = True
        # A string that repeats in documents of one id was answered once: equal ones follow.
        judged: dict[int | None, list[np.ndarray]] = {}
        for k in np.unique(np.searchsorted(block.ends, np.flatnonzero(starts), side="right")).tolist():
            a, b = block.starts[k], block.ends[k]
            own = np.flatnonzero(starts[a:b])
            judged.setdefault(block.ids[k], []).append(string_hashes(block.data[a:b], LENGTH)[own])
        out = []
        for k, doc in enumerate(block.ids):
            part = block.data[block.starts[k] : block.ends[k]]
            spans = removed = 0
            if doc in judged:
                own = np.flatnonzero(np.isin(string_hashes(part, LENGTH), np.concatenate(judged[doc])))
                step = np.zeros(len(part) + 1, np.int32)
                np.add.at(step, own, 1)
                np.add.at(step, own + LENGTH, -1)
                gone = np.cumsum(step[:-1]) > 0
                spans = int((np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1).sum())
                removed = int(gone.sum())
                part = part[~gone]
            data = part.tobytes()
            out.append((block.hashes[k], removed, spans, hashlib.sha256(data).hexdigest(), data if with_text else None))
        return _table(out, kinds)

    marked = mine.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        mark, "text_hash string, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
    marked = cut(marked).join(firsts.select("text_hash", "first"), "text_hash")
    every = rows.select("doc_id", "rank", "text_hash", F.length("text").cast("long").alias("n_bytes"))
    both = every.join(marked, "text_hash")
    # A later copy of a whole text goes as a whole, if it is long enough to hold a string at all.
    copy = F.col("rank") > F.col("first")
    whole = copy & (F.col("n_bytes") >= LENGTH)
    own = lambda name, gone, stay: F.when(whole, gone).when(copy, stay).otherwise(F.col(name)).alias(name)
    return both.select(
        "doc_id",
        "n_bytes",
        own("n_removed", F.col("n_bytes"), F.lit(0).cast("long")),
        own("n_spans", F.lit(1).cast("long"), F.lit(0).cast("long")),
        own("kept_sha256", F.lit(hashlib.sha256(b"").hexdigest()), F.col("text_hash")),
        own("kept", F.lit(b""), F.col("kept")),
    )


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What would go from each document, and a hash of what stays."""
    return _judge(docs, doc_id, text, False).drop("kept")


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kept): the bytes of each document that stay."""
    return _judge(docs, doc_id, text, True).select("doc_id", "kept")


def _answer(places: np.ndarray, found: np.ndarray) -> bytes:
    return places.astype("<i8").tobytes() + found.astype("<u4").tobytes()


def _read_answer(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 12
    return np.frombuffer(blob, "<i8", n), np.frombuffer(blob, "<u4", n, 8 * n).astype(np.int64)


def _range_starts(ranges: int) -> np.ndarray:
    """First hash of each of so many equal ranges."""
    return np.array([(k << 64) // ranges for k in range(ranges)], np.uint64)


def _table(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, kinds)], names=[n for n, _ in kinds])
