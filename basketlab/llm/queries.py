"""The queries of the text operators, by name, and their SQL where SQL can say the same."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlab.llm import decontaminate, fixity, hard_negatives, licenses, main_text, near_dedup, packing, periodic, personal, phrases, quality, secrets, suffixes
from basketlab.llm.common import documents, space_words, table


def op1_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return decontaminate.digest(decontaminate.scan(docs, table(spark, sf_dir, "benchmark")))


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_file())


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(documents(spark, sf_dir))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(documents(spark, sf_dir)))


def op5_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.neighbour_report(documents(spark, sf_dir))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def held_out(doc_id):
    """Rows whose labels may not be read; a null id is not one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op6_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of held-out rows are never read."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), may_train=~held_out(F.col("__id")))
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of a replica with planted damage: one byte of ids 1 past each multiple of 97, none of ids 2 past."""
    pages = table(spark, sf_dir, "pages")
    place = F.pmod(F.col("page_id"), F.lit(97))
    flipped = F.concat(F.lit("!"), F.substring("html", 2, 1 << 30))
    replica = pages.where(place != 2).withColumn("html", F.when(place == 1, flipped).otherwise(F.col("html")))
    return fixity.audit(fixity.manifest(pages), fixity.manifest(replica))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word shingles of words between white space."""
    found = near_dedup.link_classes(documents(spark, sf_dir), size=2, words=space_words)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    field = personal.fit(personal.labelled_table(spark))
    return personal.digest(personal.scan(docs, field))


def with_planted_run(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """In one document of ten the words from a place on repeat the first few of them; a null id plants none."""
    g, tenth = divmod(zlib.crc32(str(doc_id).encode()), 10)
    n = len(words)
    if tenth or not n or doc_id is None:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    copies = -(-(n - a) // p)
    return words[:a] + (words[a : a + p] * copies)[: n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return periodic.digest(periodic.scan(docs, rewrite=with_planted_run))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = main_text.extract(pages)
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.col("n_main").alias("n_chars"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=moved)


QUERIES = {
    "op1_benchmark_hits": op1_benchmark_hits,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_secret_scan": op4_secret_scan,
    "op5_phrase_fingerprints": op5_phrase_fingerprints,
    "op6_quality_scores": op6_quality_scores,
    "op7_license_scan": op7_license_scan,
    "op8_merkle_audit": op8_merkle_audit,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_personal_data": op10_personal_data,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_main_text": op12_main_text,
    "op13_hard_negatives": op13_hard_negatives,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = {
    "op13_hard_negatives": """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
             CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 10
""",
    "op8_merkle_audit": r"""
WITH b AS (
  SELECT page_id, encode(coalesce(html, '')) AS body,
         'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) ||
         'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10) ||
         'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' ||
         CAST(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) ||
         coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS rec
  FROM pages),
m AS (SELECT DISTINCT page_id, CAST(strlen(rec) AS BIGINT) AS length, sha256(rec) AS record_sha256 FROM b),
o AS (SELECT *, CAST(floor(page_id / 4096) AS BIGINT) AS volume,
             CAST(sum(length) OVER (PARTITION BY floor(page_id / 4096) ORDER BY page_id, record_sha256) - length AS BIGINT) AS "offset"
      FROM m),
lost AS (SELECT volume, min(page_id) AS first FROM o WHERE page_id % 97 = 2 GROUP BY volume)
SELECT o.page_id, o.volume, o."offset", o.length, o.record_sha256,
       CASE WHEN page_id % 97 = 2 THEN 'missing' WHEN page_id % 97 = 1 THEN 'altered'
            WHEN page_id > lost.first THEN 'moved' ELSE 'intact' END AS status
FROM o LEFT JOIN lost USING (volume)
""",
    "op1_benchmark_hits": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(len(w), 10) AS m,
             array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS gram
      FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM g),
p AS (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, sizes WHERE len(w) >= m),
h AS (SELECT r, s, g.m, item FROM (SELECT r, s, m, array_to_string(w[s : s + m - 1], ' ') AS gram FROM p) q
      JOIN g ON g.m = q.m AND g.gram = q.gram),
c AS (SELECT r, count(DISTINCT pos) AS n FROM (SELECT r, unnest(range(s, s + m)) AS pos FROM h) GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS ids
      FROM h WHERE item IS NOT NULL GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n, 0) AS BIGINT) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256,
       coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
""",
    "op9_near_duplicates": r"""
WITH RECURSIVE
d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
      FROM documents),
s AS (SELECT DISTINCT r, CASE WHEN len(w) = 1 THEN w[1] ELSE w[k] || ' ' || w[k + 1] END AS g
      FROM (SELECT r, w, unnest(range(1, greatest(len(w), 2))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
o AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT r, r FROM d UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.b),
m AS (SELECT reach.a AS r, min(x.doc_id) AS component_id FROM reach JOIN d x ON x.r = reach.b GROUP BY reach.a)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d LEFT JOIN n USING (r) JOIN m USING (r)
""",
}
