"""Benchmark decontamination: a broadcast hash set of benchmark windows scanned over all texts.

A window is ``size`` consecutive words of a benchmark item; an item of fewer words, but not
none, is one window. The windows are dealt by hash into blocks of at most about ``BLOCK`` rows,
and each block is broadcast in turn, so no broadcast grows with the benchmark. Documents are
never shuffled: a bitmap over window hashes finds candidates, the words themselves decide.

Nulls, empty texts: no words, no hits. Null item ids count as no item but their windows still
hit. Repeated rows are kept, each with its own result. Extra columns pass through.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlab.llm.common import WordHashes, add_columns, alnum_words, byte_list, cut, keeping, window_hashes

SIZE = 10
# Rows (window, item) of one broadcast: some 20 MB of benchmark text.
BLOCK = 200_000

_SPANS = T.ArrayType(
    T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """Distinct (gram, item): the windows of every benchmark item, words joined by one space."""
    rows = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, ids = [], []
            for item, value in zip(batch["item"].to_pylist(), byte_list(batch["text"])):
                words = alnum_words(value)
                if not words:
                    continue
                for i in range(max(1, len(words) - size + 1)):
                    grams.append(b" ".join(words[i : i + size]))
                    ids.append(item)
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams, pa.binary()), pa.array(ids, pa.string())], names=["gram", "item"]
            )

    return rows.mapInArrow(run, "gram binary, item string").distinct()


class _Block:
    """Windows of a block by number of words, with a bitmap over their hashes."""

    def __init__(self, rows: list[tuple[bytes, str | None]]):
        self.items: dict[bytes, list[str]] = defaultdict(list)
        for gram, item in rows:
            self.items[bytes(gram)] += [] if item is None else [item]
        bits = max(16, len(self.items).bit_length() + 6)
        self.shift = np.uint64(64 - bits)
        self.maps: dict[int, np.ndarray] = {}
        hashes = WordHashes()
        for gram in self.items:
            words = gram.split(b" ")
            seen = self.maps.setdefault(len(words), np.zeros(1 << bits, bool))
            seen[window_hashes(hashes.of(words), len(words)) >> self.shift] = True

    def hits(self, words: list[bytes], hashes: WordHashes, covered: np.ndarray, found: set[str]) -> None:
        values = hashes.of(words)
        for size, seen in self.maps.items():
            for i in np.flatnonzero(seen[window_hashes(values, size) >> self.shift]).tolist():
                gram = b" ".join(words[i : i + size])
                if gram in self.items:
                    covered[i : i + size] = True
                    found.update(self.items[gram])


def _spans(covered: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0]))))
    return [{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()]


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = SIZE,
    block: int = BLOCK,
) -> DataFrame:
    """``docs`` with n_words, hit_spans (word numbers, end exclusive) and hit_items.

    The columns of these names are replaced if ``docs`` has them.
    """
    grams = cut(windows(benchmark, item_id, item_text, size))
    parts = max(1, -(-grams.count() // block))
    context = docs.sparkSession.sparkContext
    out = docs.drop("n_words", "hit_spans", "hit_items")
    for part in range(parts):
        rows = grams.where(F.pmod(F.xxhash64("gram", "item"), F.lit(parts)) == part).collect()
        sent = context.broadcast([(bytes(r.gram), r.item) for r in rows])

        def start(sent=sent, first=part == 0):
            known, hashes = _Block(sent.value), WordHashes()

            def work(batch: pa.RecordBatch) -> list[pa.Array]:
                counts, spans, items = [], [], []
                old = [] if first else batch["hit_spans"].to_pylist()
                had = [] if first else batch["hit_items"].to_pylist()
                for k, value in enumerate(byte_list(batch[text])):
                    words = alnum_words(value)
                    covered, found = np.zeros(len(words), bool), set()
                    if not first:
                        found.update(had[k])
                        for s in old[k]:
                            covered[s["start"] : s["end"]] = True
                    known.hits(words, hashes, covered, found)
                    counts.append(len(words))
                    spans.append(_spans(covered))
                    items.append(sorted(found))
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                return [
                    pa.array(counts, pa.int64()),
                    pa.array(spans, span),
                    pa.array(items, pa.list_(pa.string())),
                ]

            return work

        fields = [
            ("n_words", T.LongType()),
            ("hit_spans", _SPANS),
            ("hit_items", T.ArrayType(T.StringType())),
        ]
        out = add_columns(out, start, fields)
        if part < parts - 1:
            out = cut(out)
    return out


def digest(scanned: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Counts and a hash of the items per document."""
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return scanned.select(
        F.col(doc_id).alias("doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


ADDED = ("n_words", "hit_spans", "hit_items")


def drop_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any benchmark window, columns as they were."""
    clean = lambda d: scan(d, benchmark, **options).where(F.size("hit_spans") == 0)
    return keeping(docs, ADDED, clean)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """All documents, the hit words and what stands between them cut out of the text."""

    def start():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            out = []
            for old, value, spans in zip(
                batch[text].to_pylist(), byte_list(batch[text]), batch["hit_spans"].to_pylist()
            ):
                if not spans:
                    out.append(old)
                    continue
                at = [m.span() for m in _WORD.finditer(value)]
                kept, end = [], 0
                for s in spans:
                    kept.append(value[end : at[s["start"]][0]])
                    end = at[s["end"] - 1][1]
                out.append(b"".join([*kept, value[end:]]).decode("utf-8", "replace"))
            return [pa.array(out, pa.string())]

        return work

    def cleaned(own: DataFrame) -> DataFrame:
        done = add_columns(scan(own, benchmark, text=text, **options), start, [("__cut", T.StringType())])
        return done.withColumn(text, F.col("__cut"))

    return keeping(docs, ADDED, cleaned)
