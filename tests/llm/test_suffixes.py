import hashlib
import random

import numpy as np

from basketlab.llm import suffixes


def brute(rows):
    """Every string of 50 bytes of every document, in order of id."""
    texts = sorted(((d if d is not None else -(1 << 63)), (t or "").encode()) for d, t in rows)
    owner = {}
    for d, t in texts:
        for i in range(len(t) - 49):
            owner.setdefault(t[i : i + 50], d)
    out = []
    for d, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - 49):
            if owner[t[i : i + 50]] < d:
                gone[i : i + 50] = True
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    rows = suffixes.report(df).collect()
    return sorted((r.doc_id if r.doc_id is not None else -(1 << 63), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)


def sample(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "of", "été", "ing", "xion", "a", "漢", "ther", "\n"]
    prose = lambda k: " ".join(rng.choice(words) + rng.choice(words) for _ in range(k))
    shared = [prose(rng.randint(6, 40)) for _ in range(6)]
    rows = []
    for k in range(n):
        parts = [prose(rng.randint(0, 30)) for _ in range(3)]
        if rng.random() < 0.6:
            parts.insert(rng.randint(0, 3), rng.choice(shared)[rng.randint(0, 5) :])
        rows.append((k * 3, " ".join(parts)))
    rows += [(1000 + k, rows[k][1]) for k in range(5)]
    rows += [(2000 + k, rows[k + 9][1][:-20] + "changed") for k in range(5)]
    rows += [(3000, "ab" * 300), (3001, "ab" * 200), (3002, "x" * 120 + "ab" * 60), (3003, "x" * 49), (3004, "x" * 49)]
    rows += [(3005, None), (3006, ""), (3007, "short"), (3008, "short")]
    return rows


def test_against_brute_force(docs_of, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 6000)
    for seed in (1, 2):
        rows = sample(seed)
        assert got(docs_of(rows)) == brute(rows)


def test_ids_that_repeat_or_are_null(docs_of):
    rng = random.Random(9)
    a, b = ("".join(rng.choices("abcdefgh ", k=200)) for _ in range(2))
    rows = [(1, a), (1, a), (1, b + a), (2, a + b), (None, b[:80]), (3, b)]
    assert got(docs_of(rows)) == brute(rows)
    assert got(docs_of([])) == []


def test_remove_returns_what_stays(docs_of):
    text = "0123456789" * 7
    rows = {r.doc_id: bytes(r.kept) for r in suffixes.remove(docs_of([(1, text + "é"), (2, "new " + text + " end")])).collect()}
    assert rows == {1: (text + "é").encode(), 2: b"new  end"}


def test_loser_tree_merges_and_knows_prefixes():
    rng = np.random.default_rng(3)
    for _ in range(30):
        runs = []
        for _ in range(rng.integers(1, 9)):
            keys = rng.integers(0, 3, (rng.integers(0, 30), suffixes.KEY)).astype(np.uint8)
            keys[:, 4:] = 0
            keys = keys[suffixes.sort_rows(keys)]
            runs.append(([k.tobytes() for k in keys], suffixes.common_prefixes(keys).tolist()))
        run, row, prefix = suffixes.merge(runs)
        out = [runs[a][0][b] for a, b in zip(run, row)]
        assert out == sorted(k for keys, _ in runs for k in keys)
        table = np.array([list(k) for k in out], np.uint8).reshape(-1, suffixes.KEY)
        assert prefix[1:] == suffixes.common_prefixes(table).tolist()[1:]


def test_runs_and_hashes_come_back():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 4, (200, suffixes.KEY)).astype(np.uint8)
    keys = keys[suffixes.sort_rows(keys)]
    docs, places = np.arange(200), np.arange(200) * 5
    back = suffixes.decode_run(suffixes.code_run(keys, docs, places))
    assert (back[0] == keys).all() and (back[2] == docs).all() and (back[3] == places).all()
    for size in (1, 2, 1000):
        h = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        assert (suffixes.decode_hashes(suffixes.code_hashes(h)) == h).all()
