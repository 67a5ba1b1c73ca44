import math
import random

import pytest
from helpers import joined_rows, nodes, values
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from basketlab.functions.text import tokens
from basketlab.plans.oracle import STOP_WORDS
from basketlab.operators import search

DOC = "doc_id long, text string"
ASK = "query_id long, text string"


def test_tokens_and_stop_words(spark):
    df = spark.createDataFrame([("Café_x 5 Brand#13 año the I of",)], "t string")
    assert df.select(tokens(F.col("t"))).first()[0] == ["café_x", "brand", "13", "año"]
    assert sorted(STOP_WORDS) == sorted(StopWordsRemover.loadDefaultStopWords("english"))


def test_idf_and_unit_length(spark):
    docs = spark.createDataFrame([(1, "red ring"), (2, "red bolt bolt"), (3, "red")], DOC)
    index = search.fit(docs)
    idf = {r.term: r.idf for r in index.terms.collect()}
    assert idf["red"] == pytest.approx(1.0)
    assert idf["ring"] == pytest.approx(math.log(4 / 2) + 1)
    sums = index.weights.groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("weight")))
    assert all(r[1] == pytest.approx(1.0) for r in sums.collect())
    asked = spark.createDataFrame([(1, "bolt nothing")], ASK)
    got = search.scores(index, asked).collect()
    a, b = 2 * idf["bolt"], 1.0
    assert [(r.doc_id) for r in got] == [2]
    assert got[0].nlp_score == pytest.approx(a / math.hypot(a, b))


@pytest.mark.parametrize("sent", [1_000_000, 5])
@pytest.mark.parametrize("repeated", [False, True])
def test_weights_are_built_where_the_documents_are(spark, monkeypatch, sent, repeated):
    """No posting is shuffled when the idf can be sent and ids differ."""
    draw = random.Random(5)
    rows = [(d, " ".join(draw.choices([f"w{k}" for k in range(40)], k=draw.randrange(30))) + f" only{d}") for d in range(60)]
    rows += [(60, None), (61, ""), (62, "the of"), (None, "w1 w1 w2")] + [(3, "w3 w3 other"), (None, "w9")] * repeated
    monkeypatch.setattr(search, "TERMS_SENT", sent, raising=False)
    index = search.fit(spark.createDataFrame(rows, DOC))
    counts = {}
    for d, text in rows:
        for w in (text or "").split():
            if w not in STOP_WORDS:
                counts.setdefault(d, {}).setdefault(w, 0)
                counts[d][w] += 1
    df = {}
    for found in counts.values():
        for w in found:
            df[w] = df.get(w, 0) + 1
    raw = {(d, w): n * (math.log((len(rows) + 1) / (df[w] + 1)) + 1) for d, found in counts.items() for w, n in found.items()}
    norm = {d: math.sqrt(sum(raw[d, w] ** 2 for w in found)) for d, found in counts.items()}
    got = {(r.doc_id, r.term): r.weight for r in index.weights.collect()}
    assert got == pytest.approx({k: x / norm[k[0]] for k, x in raw.items()})
    assert {r.term: r.df for r in index.terms.collect()} == df
    if sent > 5:
        assert not [n for n in nodes(index.weights) if "Exchange" in n.nodeName()]


def brute(docs, found, n):
    every = {d: found.get(d, 0.0) for d in docs}
    return sorted(every, key=lambda d: (-round(every[d], 9), d))[:n]


@pytest.mark.parametrize("n", [1, 3, 6])
def test_short_results_are_filled_and_negative_scores_sink(spark, n):
    docs = spark.createDataFrame([(d, "ring" if d in (9, 11) else "bolt") for d in range(12)], DOC)
    index = search.fit(docs)
    asked = spark.createDataFrame([(1, "ring"), (2, "unknown")], ASK)
    svd = spark.createDataFrame(
        [(1, 0, -0.5), (1, 1, -0.2), (1, 5, 0.4), (1, 9, 0.1)],
        "query_id long, doc_id long, svd_score double",
    )
    out = search.query(index, docs, asked, n, svd).orderBy("rank").collect()
    one = {9: 0.7 + 0.03, 11: 0.7, 5: 0.12, 0: -0.15, 1: -0.06}
    assert [r.doc_id for r in out if r.query_id == 1] == brute(range(12), one, n)
    assert [r.doc_id for r in out if r.query_id == 2] == list(range(n))


def test_a_text_is_searched_once_for_all_its_queries(spark):
    draw = random.Random(3)
    docs = spark.createDataFrame([(d, f"ring w{d % 7}x" if d % 5 else "bolt") for d in range(300)], DOC)
    index = search.fit(docs)
    texts = {u: ("ring", "w3x ring", "unknown")[u % 60 // 58 + u % 2 * (u % 60 == 59)] for u in range(200)}
    asked = spark.createDataFrame(list(texts.items()), ASK)
    out = search.query(index, docs, asked, 4)
    assert out.count() == 800 and max(joined_rows(out)) < 200 * 240 / 10
    # Lists of any length: the documents outside of them are the best that no list of the asking user holds.
    lists = {u: {d: draw.choice([-0.5, 0.0, 0.2, 0.6]) for d in draw.sample(range(300), draw.choice([1, 5, 60]))} for u in range(0, 200, 3)}
    lists[1000] = {5: 0.3}  # a list without a query
    svd = spark.createDataFrame([(u, d, x) for u, row in lists.items() for d, x in row.items()], "query_id long, doc_id long, svd_score double")
    words = spark.createDataFrame([(k, t) for k, t in enumerate(("ring", "w3x ring", "unknown"))], ASK)
    nlp = {(r.query_id, r.doc_id): r.nlp_score for r in search.scores(index, words).collect()}
    got = {}
    for r in search.query(index, docs, asked, 4, svd).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    for u, text in texts.items():
        k = ("ring", "w3x ring", "unknown").index(text)
        score = {d: 0.7 * nlp.get((k, d), 0.0) + 0.3 * lists.get(u, {}).get(d, 0.0) for d in range(300)}
        assert got[u] == brute(range(300), score, 4)
    assert got[1000] == [5] and len(got) == 201


def test_results_by_aisle(spark):
    star = spark.createDataFrame(
        [(1, "ring", "gems", "luxury"), (2, "big ring", "gems", "gifts"), (3, "bolt", "tools", "diy")],
        "product_id long, product_name string, aisle string, department string",
    )
    docs = search.product_text(star)
    found = search.query(search.fit(docs), docs, spark.createDataFrame([(1, "ring")], ASK))
    bought = spark.createDataFrame([(1, 2)], "query_id long, doc_id long")
    rows = search.products(found, star, bought)
    assert values(rows, "product_id", "previously_bought") == [(1, False), (2, True), (3, False)]
    got = {r.aisle: (r.n_products, r.product_names, r.department) for r in search.by_aisle(rows).collect()}
    assert got == {"gems": (2, ["ring", "big ring"], "luxury"), "tools": (1, ["bolt"], "diy")}


def test_index_by_term_reads_the_buckets_of_its_terms(spark):
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)]
    docs = spark.createDataFrame(
        [(d, " ".join(["common", *(words[(d * k) % 300] for k in range(1, 6))])) for d in range(400)], DOC
    )
    plain = search.stored(search.fit(docs))
    laid = search.stored(search.fit(docs), buckets=32)
    assert plain.buckets is None and laid.buckets == 32
    columns = ("doc_id", "term", "weight")
    assert values(laid.weights, *columns) == values(plain.weights, *columns)
    asked = spark.createDataFrame([(1, f"{words[7]} {words[8]}"), (2, "common nothing"), (3, "unheard"), (4, "")], ASK)
    got, want = (values(search.query(i, docs, asked, 5)) for i in (laid, plain))
    assert [r[:2] for r in got] == [r[:2] for r in want] and len(got) == 20
    # Two terms lie in two buckets at most, and other folders are not listed for the scan.
    terms = spark.createDataFrame([(words[7],), (words[8],)], "term string")
    read = search.postings(laid, terms)
    plan = read._jdf.queryExecution().executedPlan()
    read.collect()
    folders = {r[0].split("bucket=")[1].split("/")[0] for r in read.select(F.input_file_name()).distinct().collect()}
    assert 1 <= len(folders) <= 2 and "PartitionFilters: [" in plan.toString() and "bucket" in plan.toString()
    assert read.count() < laid.weights.count() / 4
    assert search.postings(laid, terms.limit(0)).count() == 0
