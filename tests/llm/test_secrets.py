import hashlib
import random
import re

import numpy as np
import pytest

from basketlab.llm import secrets

PATTERNS = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
]


def brute(text):
    out = []
    for k, (kind, pattern, passes) in enumerate(PATTERNS):
        out += [(m.start(), k, m.end(), kind) for m in pattern.finditer(text or "") if passes(m)]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out)]


def prose(rng, n):
    parts = "the of tion ing her ent and ly re ous ment al ith ver".split()
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    parts = ["password", "Token", "api_key", "APIKEY", '"', "'", " ", "=", ":", "abcdef0123456789", "AKIA", "AKIAABCDEFGHIJKLMN", "é", "🙂", "x.y-z", "0123456789ab", "secret = 'longlonglong1'", "\n"]
    rows = [(k, "".join(rng.choices(parts, k=rng.randint(0, 12)))) for k in range(400)]
    rows += [(1000 + k, prose(rng, 200)) for k in range(60)]
    key = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=40))
    rows += [(2000, prose(rng, 40) + " " + key + " " + prose(rng, 40)), (2001, None), (2002, ""), (None, "token=abcdefghijkl")]
    rows += [(2003, "token=abcdefghijkl")] * 2
    return rows


def test_base_against_plain_patterns(docs_of, texts):
    got = secrets.digest(secrets.scan(docs_of(texts))).collect()
    assert len(got) == len(texts)
    want = sorted(
        (str(d), hashlib.sha256(",".join(b := brute(t)).encode()).hexdigest(), *[sum(x.startswith(k) for x in b) for k in ("assign", "access", "hex")])
        for d, t in texts
    )
    assert want == sorted((str(r.doc_id), r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in got)
    by_id = {r.doc_id: r.spans for r in got}
    for d, t in texts:
        assert set(brute(t)) <= set(by_id[d].split(",")) | set() if brute(t) else True
    text = dict(texts)[2000]
    start = re.search(r"[A-Za-z0-9]{40}", text).start()
    assert f"random:{start}:{start + 40}" in by_id[2000].split(",")
    assert not any("random" in by_id[1000 + k] for k in range(60))


def test_redaction_keeps_the_rest(docs_of):
    rows = [(1, "a 🙂 token=abcdefghijkl end"), (2, None), (3, "plain"), (3, "plain")]
    got = secrets.redact(docs_of(rows))
    assert got.columns == docs_of(rows).columns
    assert sorted((r.doc_id, r.text) for r in got.where("text is not null").collect()) == [
        (1, "a 🙂 [SECRET] end"),
        (3, "plain"),
        (3, "plain"),
    ]
    assert secrets.redact(docs_of([])).count() == 0


def test_normal_tail(spark):
    from math import erfc, sqrt

    from pyspark.sql import functions as F

    from basketlab.llm.native import normal_tail

    rows = spark.range(-40, 41).select((F.col("id") / 10).alias("z")).select("z", normal_tail(F.col("z")).alias("p"))
    assert all(abs(r.p - erfc(r.z / sqrt(2)) / 2) < 2e-7 for r in rows.collect())


def plain_battery(token):
    """-log10 of the combined value, by numpy."""
    from math import erfc, sqrt

    low, high, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    kinds = [("[0-9a-f]+", digits + low[:6]), ("[0-9A-F]+", digits + high[:6]), ("[A-Z2-7]+=*", high + "234567"), ("[A-Z0-9]+", digits + high), ("[A-Za-z0-9]+", digits + high + low)]
    alphabet = next((a for p, a in kinds if re.fullmatch(p, token)), digits + high + low + "+/-_=")
    v = np.array([alphabet.find(x) + 1 for x in token], float)
    n, k, tail = len(v), len(alphabet), lambda z: erfc(z / sqrt(2)) / 2
    chi = k / n * (np.unique(v, return_counts=True)[1] ** 2.0).sum() - n
    f = k - 1
    uneven = ((max(chi, 0) / f) ** (1 / 3) - (1 - 2 / (9 * f))) / sqrt(2 / (9 * f))
    side = v * 2 > k
    upper, runs = side.sum(), 1 + (side[1:] != side[:-1]).sum()
    expected = 2 * upper * (n - upper) / n + 1
    variance = (expected - 1) * (expected - 2) / (n - 1)
    runs = (runs - expected) / sqrt(variance) if variance > 0 else 8.0
    d = v - v.mean()
    serial = ((d[1:] * d[:-1]).sum() / (d @ d) + 1 / n) * sqrt(n) if d @ d > 0 else 8.0
    two = lambda z: 2 * tail(min(abs(z), 8.0))
    value = min(1.0, 3 * min(tail(max(min(uneven, 8.0), -8.0)), two(runs), two(serial)))
    return -np.log10(max(value, 1e-16))


def test_battery_equals_numpy(spark):
    rng = random.Random(8)
    sets = ["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcXYZ019", "aB3+/_=-", "a", "qwertz0"]
    tokens = ["".join(rng.choices(rng.choice(sets), k=rng.randint(16, 90))) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in tokens], "token string")
    for r in secrets.battery(rows).collect():
        # The tail of the normal distribution is a polynomial, good to 1e-7.
        want = plain_battery(r.token)
        assert r.n == len(r.token) and abs(10**-r.doubt - 10**-want) < 1e-6 and abs(r.doubt - want) < 0.05, r.token


def test_discoveries_equal_a_plain_version(spark):
    rng = np.random.default_rng(9)
    rows = [(int(k), float(d + null), int(n), bool(null), not null) for k, (d, n, null) in enumerate(zip(rng.exponential(3, 3000), rng.integers(16, 90, 3000), rng.random(3000) < 0.6))]
    rows += [(5000 + k, 0.01, 60, False, True) for k in range(40)]
    table = spark.createDataFrame(rows, "k long, doubt double, n int, is_null boolean, is_candidate boolean")
    bins = lambda d: int(np.floor(d * 20))
    kind = lambda n: min(int(np.floor(np.log2(n))), 10)
    null = [(kind(n), bins(d)) for _, d, n, is_null, _ in rows if is_null]
    cand = [(k, bins(d), n) for k, d, n, _, c in rows if c]
    mean = np.mean([n for *_, n in cand])
    fine = {}
    for k, b, n in cand:
        peers = [x for c, x in null if c <= kind(n)]
        p = (1 + sum(x <= b for x in peers)) / (1 + len(peers))
        fine[k] = int(np.floor(-np.log(min(1.0, p * mean / n)) * 64))
    limits = [f for f in set(fine.values()) if np.exp(-f / 64) <= secrets.RATE * sum(x >= f for x in fine.values()) / len(fine)]
    want = {k for k, f in fine.items() if limits and f >= min(limits)}
    assert {r.k for r in secrets.discoveries(table).collect()} == want and want


def test_long_strings_and_many_strings(docs_of):
    rng = random.Random(10)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    long = "".join(rng.choices(letters, k=1_000_000))
    many = " ".join(f"token={''.join(rng.choices(letters, k=14))} {''.join(rng.choices(letters, k=24))}" for _ in range(50_000))
    plain = [(10 + k, prose(rng, 100)) for k in range(40)]
    one, two = docs_of([(1, "x " + long), *plain]), docs_of([(2, many), *plain])
    (found,) = secrets.scan(one).where("doc_id = 1").collect()
    assert [(s.start, s.end) for s in found.spans] == [(2, 1_000_002)]
    assert secrets.redact(one).where("doc_id = 1").first().text == "x [SECRET]"
    (found,) = secrets.scan(two).where("doc_id = 2").collect()
    assert [f"assign:{s.start}:{s.end}" for s in found.base] == brute(many)
    more = {(s.start, s.end) for s in found.spans if s.kind == 3}
    assert more <= {m.span() for m in re.finditer(r"(?<= )[A-Za-z0-9]{24}", many)}
    out, at = [], 0
    for s in found.spans:
        out += [many[at : s.start], "[SECRET]"]
        at = s.end
    assert secrets.redact(two).where("doc_id = 2").first().text == "".join(out) + many[at:]


def test_overlapping_spans_are_cut_as_one(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = [("a🙂bcdefghij", [(0, 2), (1, 4), (2, 3), (6, 8), (8, 9)]), ("abc", [(0, 3)]), ("abcdef", [(1, 5), (2, 3), (5, 6)])]
    table = spark.createDataFrame(rows, "text string, __spans array<struct<start:bigint,end:bigint>>")
    got = table.select("text", secrets._cut_out(F.col("text"), "#").alias("out")).collect()
    assert {r.text: r.out for r in got} == {"a🙂bcdefghij": "#de##ij", "abc": "#", "abcdef": "a##"}
