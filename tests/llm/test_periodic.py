import hashlib
import random
import zlib

import numpy as np
import pytest

from basketlab.llm import periodic, queries


def plain_runs(w):
    """Every period tried at every place."""
    numbers: dict = {}
    v = np.array([numbers.setdefault(x, len(numbers)) for x in w], np.int64)
    found = []
    for q in range(1, len(w) // 4 + 1):
        same = np.concatenate([[0], (v[:-q] == v[q:]).astype(np.int8), [0]])
        edges = np.flatnonzero(np.diff(same)).reshape(-1, 2)
        for start, end in edges[edges[:, 1] - edges[:, 0] + q >= max(6, 4 * q)].tolist():
            part = v[start : end + q]
            if not any((part[r:] == part[:-r]).all() for r in range(1, q)):
                found.append((start, len(part), q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def noisy(rng, kinds, n):
    w = [b"%d" % rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n:
            a, p, m = rng.randrange(n), rng.randint(1, 9), rng.randint(1, 60)
            w[a:a] = (w[a : a + p] * 60)[:m]
    return w


@pytest.mark.parametrize("kinds", [1, 2, 3, 5, 40])
def test_runs_equal_brute_force(kinds):
    rng = random.Random(kinds)
    for _ in range(60):
        lists = [noisy(rng, kinds, rng.choice([0, 1, 5, 6, 7, 20, 60, 150])) for _ in range(rng.randint(1, 4))]
        assert periodic.find(lists) == [plain_runs(w) for w in lists]


def test_roots_with_repeats_inside():
    root = [b"a", b"b", b"c", b"d"] * 3 + [b"e"]
    for copies in (3, 4, 5):
        w = [b"x"] + root * copies + [b"y"]
        assert periodic.find([w]) == [plain_runs(w)]


def test_common_extensions():
    rng = random.Random(2)
    s = [-1] + [rng.randrange(2) for _ in range(300)] + [-2]
    numbered = [v + 2 for v in s]
    ext = periodic.Extensions(numbered)
    i, j = [5, 17, 100, 1, 250], [6, 200, 101, 299, 3]
    plain = []
    for a, b in zip(i, j):
        k = 0
        while max(a, b) + k < len(s) and s[a + k] == s[b + k]:
            k += 1
        plain.append(k)
    assert ext.of(np.array(i), np.array(j)).tolist() == plain


def expected(doc_id, text):
    w = [] if text is None else text.encode().split()
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n and doc_id is not None:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id, len(runs), *top, top[0] if top[0] is None else 1000 * top[1] // top[2],
        sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()),
        sha(b" ".join(x for i, x in enumerate(w) if i not in dropped)),
    )


def test_query_form_equals_brute_force(spark, docs_of):
    rng = random.Random(3)
    texts = [b" ".join(noisy(rng, rng.choice([2, 4, 300]), rng.choice([3, 30, 80]))).decode() for _ in range(60)]
    rows = [*enumerate(texts), (70, None), (71, ""), (72, " \t\n"), (73, "a\x0bb a b a b a b"), (None, "x x x x x x"), (0, texts[0])]
    rows += [(80 + k, "é ü\u00a0ß é ü\u00a0ß é ü\u00a0ß é ü\u00a0ß") for k in range(20)]
    got = periodic.digest(periodic.scan(docs_of(rows), rewrite=queries.with_planted_run))
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((expected(*r) for r in rows), key=key)
    assert got.dtypes[1:6] == [(c, "bigint") for c in ("n_runs", "start", "length", "period", "exponent_milli")]


def test_whole_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, queries.op11_periodic_runs(spark, folder).collect()))
    assert got == sorted(expected(r.doc_id, r.text) for r in docs)


def test_empty_table_and_own_columns(spark, docs_of):
    docs = docs_of([(1, "a a a a a a b")]).withColumnRenamed("bands", "period")
    row = periodic.scan(docs).first()
    assert row.period == "b" and row.collapsed == "a b" and [tuple(r) for r in row.runs] == [(0, 6, 1)]
    assert periodic.digest(periodic.scan(docs.limit(0))).count() == 0


def test_very_long_text():
    w = [b"%d" % (k % 50_000) for k in range(220_000)]
    assert periodic.find([[b"s", *w, b"t"]]) == [[(1, 220_000, 50_000)]]
