import hashlib
import random

from basketlab.llm import phrases


def brute(rows):
    """Next document in descending order of id, by hand."""
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for (doc_id, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        mine, theirs, follow = phrases.fingerprint([text, edited, after])
        out[doc_id] = (
            len(text),
            hashlib.sha256(edited.encode()).hexdigest(),
            mine,
            theirs,
            round(phrases.likeness(mine, theirs), 9),
            round(phrases.likeness(mine, follow), 9),
        )
    return out


def report(df):
    return {
        r.doc_id: (
            r.n_chars,
            r.edited_sha256,
            r.fingerprint,
            r.edited_fingerprint,
            round(r.near_edited, 9),
            round(r.near_next, 9),
        )
        for r in phrases.neighbour_report(df).collect()
    }


def test_against_brute_force(docs_of):
    rng = random.Random(3)
    words = ["été", "alpha", "beta", "漢字", "gamma", "🙂"]
    rows = [(i * 7, " ".join(rng.choices(words, k=rng.randint(0, 90)))) for i in range(150)]
    rows += [(2001, None), (2002, ""), (2003, "x" * 30000), (2004, "ab")]
    assert report(docs_of(rows)) == brute(rows)


def test_one_document_is_its_own_next(docs_of):
    assert report(docs_of([(5, "one two three")])) == brute([(5, "one two three")])


def test_empty_table(docs_of):
    assert report(docs_of([])) == {}


def test_repeated_and_null_ids_are_all_reported(docs_of):
    rows = [(1, "a b c"), (1, "a b c"), (1, "d"), (None, "e"), (None, None)]
    got = phrases.neighbour_report(docs_of(rows)).collect()
    assert sorted(r.n_chars for r in got) == [0, 1, 1, 5, 5]


def test_parse_is_lempel_ziv():
    text = b"abababababa"
    assert phrases.Parser().feed(text).ends == [1, 2, 4, 7, 9]
    parts = phrases.Parser().feed(text[:5]).feed(text[5:])
    assert parts.ends == [1, 2, 4, 7, 9]


def test_likeness_orders_edits():
    rng = random.Random(1)
    text = " ".join(rng.choice(["of", "the", "sand", "tion", "ing", "ery"]) + str(rng.random()) for _ in range(200))
    close, far = text[:-40] + "zzz", "".join(rng.choices("qwertyuiop", k=4000))
    a, b, c = phrases.fingerprint([text, close, far])
    assert phrases.likeness(a, b) > 0.7 > 0.3 > phrases.likeness(a, c)


def test_more_rows_than_a_batch_of_results(docs_of):
    rows = [(i, f"text {i} of some length {i * i}") for i in range(700)]
    df = docs_of(rows).coalesce(1)
    df.sparkSession.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert report(df) == brute(rows)
    finally:
        df.sparkSession.conf.set("spark.sql.shuffle.partitions", "4")


def test_many_ranges(docs_of):
    """With a thousand shuffle partitions there is a range per document or two; hot ids stay one row per sentinel."""
    rng = random.Random(4)
    rows = [(i * 3 - 200, f"text {i} " * rng.randint(0, 5)) for i in range(400)]
    df = docs_of(rows)
    df.sparkSession.conf.set("spark.sql.shuffle.partitions", "1000")
    df.sparkSession.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    try:
        assert report(df) == brute(rows)
    finally:
        df.sparkSession.conf.set("spark.sql.shuffle.partitions", "4")
        df.sparkSession.conf.unset("spark.sql.adaptive.coalescePartitions.parallelismFirst")


def test_hot_and_null_ids_in_the_ring(docs_of):
    rows = [(7, f"same id {i}") for i in range(60)] + [(None, f"no id {i}") for i in range(60)] + [(1, "one"), (9, "nine")]
    got = phrases.neighbour_report(docs_of(rows)).collect()
    assert len(got) == len(rows)
    # Every row is followed by another one: the rows form one ring.
    ids = sorted((r.doc_id, r.n_chars) for r in got if r.doc_id is not None)
    assert ids == sorted((i, len(t)) for i, t in rows if i is not None)
