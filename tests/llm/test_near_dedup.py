import random

import numpy as np

from basketlab.llm import near_dedup
from basketlab.llm.common import alnum_words, space_words


def brute(rows, size, words):
    sets = []
    for _, text in rows:
        w = words((text or "").encode())
        n = min(size, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    head = list(range(len(rows)))

    def find(k):
        while head[k] != k:
            k = head[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                head[max(a, b)] = min(a, b)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(d, least.get(find(k), d))
    return sorted(((d, len(s), least.get(find(k), d) if s else d) for k, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def got(df, **options):
    return sorted((tuple(r) for r in near_dedup.link_classes(df, **options).collect()), key=str)


def family(rng, base, n, edits):
    """Copies of a text with so many words changed, so that some are linked through others only."""
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"w{rng.random()}"
        out.append(" ".join(w))
    return out


def test_components_against_all_pairs(docs_of):
    rng = random.Random(8)
    vocabulary = [f"v{k}" for k in range(300)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    texts = family(rng, prose(120), 60, 12) + family(rng, prose(40), 30, 6) + [prose(rng.randint(1, 60)) for _ in range(60)]
    texts += [None, "", "one", "One", "one two", "a b", "b a"] + texts[:4]
    rng.shuffle(texts)
    rows = [(k * 5, t) for k, t in enumerate(texts)]
    assert got(docs_of(rows), size=2, words=space_words) == brute(rows, 2, space_words)
    assert got(docs_of(rows)) == brute(rows, 5, alnum_words)


def test_tiles_find_links_away_from_the_hub(docs_of, monkeypatch):
    monkeypatch.setattr(near_dedup, "TILE", 7)
    rng = random.Random(11)
    rows = list(enumerate(family(rng, " ".join(f"b{k}" for k in range(80)), 80, 9)))
    assert got(docs_of(rows), size=2, words=space_words) == brute(rows, 2, space_words)


def test_keep_first(docs_of):
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(3, text), (1, text + " end"), (2, "other words stand here now"), (4, None), (5, ""), (None, "z y x w v u")]
    docs = docs_of(rows)
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "4", "5", "None"]
    assert near_dedup.keep_first(docs_of([])).count() == 0


def test_keep_first_leaves_one_row_of_each_group(docs_of):
    a, b, c = (" ".join(f"{x}{k}" for k in range(50)) for x in "abc")
    rows = [(1, a), (1, a), (1, b + " end"), (0, b), (None, a), (None, c), (None, c), (None, c + " end"), (7, ""), (7, ""), (9, c + " x"), (None, None)]
    docs = docs_of(rows)
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert found == sorted([(1, a), (0, b), (9, c + " x"), (7, ""), (7, ""), (None, None)], key=str)
    alone = near_dedup.keep_first(docs_of([(None, c), (None, c)])).collect()
    assert [(r.doc_id, r.text) for r in alone] == [(None, c)]


def slow_super_minhash(items, registers):
    """One element and level after the other, without early stop."""
    from basketlab.llm.common import STEP, mix

    out = [(1 << 64) - 1] * registers
    for x in items:
        places = list(range(registers))
        for level in range(registers):
            seed = np.array([(int(x) + int(STEP) * (2 * level + 1)) & ((1 << 64) - 1)], np.uint64)
            draw = int(mix(seed)[0])
            pick = level + (((draw >> 32) * (registers - level)) >> 32)
            places[level], places[pick] = places[pick], places[level]
            out[places[level]] = min(out[places[level]], (level << 32) | (draw & 0xFFFFFFFF))
    return out


def test_signatures_equal_the_plain_algorithm_and_estimate():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (0, 1, 5, 40, 300)]
    fast = near_dedup.super_minhash(sets, 16)
    assert [row.tolist() for row in fast] == [slow_super_minhash(s, 16) for s in sets]
    a = np.unique(rng.integers(0, 1 << 63, 900).astype(np.uint64))
    x, y = near_dedup.super_minhash([a[:800], a[100:]], 240)
    assert abs((x == y).mean() - 7 / 9) < 0.1
