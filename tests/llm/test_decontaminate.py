import hashlib
import random
import re

from basketlab.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(AZ))


def brute(docs, items):
    grams = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            grams.setdefault(tuple(w[i : i + 10]), set()).add(item)
    out = []
    for d, text in docs:
        w = words(text)
        hit, found = set(), set()
        for size in {len(g) for g in grams}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in grams:
                    hit |= set(range(i, i + size))
                    found |= grams[tuple(w[i : i + size])] - {None}
        ids = ",".join(sorted(map(str, found)))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def tables(spark, docs_of):
    rng = random.Random(6)
    pool = ["a", "B", "c1", "é", "The", "x-y", "漢字"]
    prose = lambda n: " ".join(rng.choices(pool, k=n))
    items = [(k, prose(rng.randint(8, 16))) for k in range(30)] + [(100, "one two"), (100, "one two"), (101, ""), (102, None), (None, "lonely item of no id")]
    docs = [(k, prose(rng.randint(0, 60))) for k in range(40)]
    docs += [(40 + k, prose(9) + " " + rng.choice(items[:30])[1].upper() + " " + prose(5)) for k in range(40)]
    docs += [(200, None), (201, ""), (202, "one, TWO"), (202, "one, TWO"), (None, "a lonely item of no id here")]
    return docs, items, spark.createDataFrame(items, "item_id long, text string")


def digest(df):
    return sorted((tuple(r) for r in decontaminate.digest(df).collect()), key=str)


def test_scan_against_brute_force(spark, docs_of):
    docs, items, benchmark = tables(spark, docs_of)
    want = brute(docs, items)
    assert any(r[-1] for r in want) and not all(r[-1] for r in want)
    assert digest(decontaminate.scan(docs_of(docs), benchmark)) == want
    # Blocks of a few windows, broadcast in turn, say the same.
    assert digest(decontaminate.scan(docs_of(docs), benchmark, block=60)) == want


def test_removal(spark, docs_of):
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    docs = docs_of([(1, "x Alpha, beta -- gamma y"), (2, "alpha beta"), (3, None)])
    cleaned = decontaminate.remove_spans(docs, items)
    assert cleaned.columns == docs.columns
    assert {r.doc_id: r.text for r in cleaned.collect()} == {1: "x  y", 2: "alpha beta", 3: None}
    own = docs.selectExpr("*", "7 AS n_words", "'mine' AS hit_items")
    kept = decontaminate.drop_documents(own, items)
    assert kept.columns == own.columns and {(r.n_words, r.hit_items) for r in kept.collect()} == {(7, "mine")}
    kept = decontaminate.drop_documents(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert digest(decontaminate.scan(docs_of([]), none)) == []
    assert [r[2] for r in digest(decontaminate.scan(docs_of([(1, "a b")]), none))] == [0]
