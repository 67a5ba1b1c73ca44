"""TF-IDF text search over products or any (doc_id, text) table."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlab.functions.text import keep, raw_tokens, tokens
from basketlab.functions.topk import top_per_group
from basketlab.session import cut, new_folder

# Share of text similarity and of the recommender in the combined score.
TEXT_WEIGHT = 0.7
SVD_WEIGHT = 0.3
SVD_LIST = 1000
# Layout of a stored index: weights per bucket of terms, and buckets at most.
POSTINGS_PER_BUCKET = 2_000_000
MOST_BUCKETS = 4096
# Terms whose idf is sent to the tasks.
TERMS_SENT = 1_000_000


@dataclass(frozen=True)
class TextIndex:
    terms: DataFrame  # term, df, idf
    weights: DataFrame  # doc_id, term, weight (unit length per document)
    stop_words: list[str] | None
    buckets: int | None = None  # the weights are laid out by term in this many buckets


def product_text(star: DataFrame) -> DataFrame:
    """(doc_id, text) of products: name, aisle and department."""
    text = F.concat_ws(" ", "product_name", "aisle", "department")
    return star.select(F.col("product_id").alias("doc_id"), text.alias("text"))


def term_counts(docs: DataFrame, key: str = "doc_id", stop_words: list[str] | None = None) -> DataFrame:
    """(key, term, tf). Counts of a document are combined before they leave its task."""
    return (
        docs.select(key, F.explode(raw_tokens(F.col("text"))).alias("term"))
        .where(keep(F.col("term"), stop_words))
        .groupBy(key, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def _counted(docs: DataFrame, stop_words: list[str] | None) -> DataFrame:
    """(doc_id, terms, tfs): a row per document, counted where its text is read.

    Only where ids repeat are counts shuffled, since texts of one id are one document.
    """
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if not ids.where("n > 1").isEmpty():
        entry = F.sort_array(F.collect_list(F.struct("term", "tf")))
        rows = term_counts(docs, "doc_id", stop_words).groupBy("doc_id").agg(entry.alias("c"))
        return rows.select("doc_id", F.col("c.term").alias("terms"), F.col("c.tf").alias("tfs"))
    words = docs.select("doc_id", F.sort_array(tokens(F.col("text"), stop_words)).alias("words")).where(F.size("words") > 0)
    size, word = F.size("words"), lambda i: F.get("words", i)
    last = F.filter(F.sequence(F.lit(1), size), lambda i: (i == size) | (word(i - 1) != word(i)))
    ends = words.select("doc_id", "words", last.alias("ends"))
    return ends.select(
        "doc_id",
        F.transform("ends", lambda e: word(e - 1)).alias("terms"),
        F.transform("ends", lambda e, j: (e - F.coalesce(F.get("ends", j - 1), F.lit(0))).cast("long")).alias("tfs"),
    )


def _weights(counted: DataFrame, terms: DataFrame, once: float | None) -> DataFrame:
    """(doc_id, term, weight) from (doc_id, terms, tfs). ``once``: the idf of a term of one document.

    The idf of the most frequent terms, ``TERMS_SENT`` at most, are sent to the documents, so no
    count is shuffled for its idf or for the length of its document. Where more terms lie in several
    documents, the postings of the others are met through a shuffle.
    """
    context, kind = counted.sparkSession.sparkContext, dict(counted.dtypes)["doc_id"]
    least = 1
    if terms.where("df > 1").count() > TERMS_SENT:
        least = terms.orderBy(F.desc("df")).limit(TERMS_SENT).agg(F.min("df")).first()[0]
    table = terms.where(F.col("df") > least).select("term", "idf").toArrow()
    sent = context.broadcast([pa.concat_arrays(table[c].chunks) if len(table) else pa.array([], table[c].type) for c in ("term", "idf")])

    def known(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, pa.Array]:
        """Of all postings of the batch: term, row of its document, idf (null if not sent)."""
        names, idfs = sent.value
        flat = batch["terms"].flatten()
        row = pc.list_parent_indices(batch["terms"]).to_numpy(zero_copy_only=False)
        return flat, row, idfs.take(pc.index_in(flat, value_set=names.cast(flat.type)))

    def unknown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, row, idf = known(batch)
            counts = np.bincount(row, minlength=batch.num_rows)
            at = np.arange(len(row)) - (np.cumsum(counts) - counts)[row]
            rare = np.flatnonzero(idf.is_null().to_numpy(zero_copy_only=False))
            columns = [batch["doc_id"].take(pa.array(row[rare])), pa.array(at[rare], pa.int64()), flat.take(pa.array(rare))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "at", "term"])

    rows = counted.withColumn("rare", F.array().cast("array<struct<at:bigint,idf:double>>"))
    if least > 1:
        rare = counted.select("doc_id", "terms").mapInArrow(unknown, f"doc_id {kind}, at bigint, term string")
        rare = rare.join(terms.where(F.col("df").between(2, least)).select("term", "idf"), "term")
        rare = rare.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list(F.struct("at", "idf")).alias("rare"))
        rows = counted.join(rare, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").drop("_doc")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, row, idf = known(batch)
            idf = idf.fill_null(once or 0.0).to_numpy(zero_copy_only=False).copy()
            counts = np.bincount(row, minlength=batch.num_rows)
            cells = batch["rare"].flatten()
            of = pc.list_parent_indices(batch["rare"]).to_numpy(zero_copy_only=False)
            at, found = (cells.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            idf[(np.cumsum(counts) - counts)[of] + at] = found
            raw = batch["tfs"].flatten().to_numpy(zero_copy_only=False) * idf
            norm = np.sqrt(np.bincount(row, raw * raw, batch.num_rows))
            columns = [batch["doc_id"].take(pa.array(row)), flat, pa.array(raw / norm[row], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "term", "weight"])

    return rows.mapInArrow(weigh, f"doc_id {kind}, term string, weight double")


def fit(docs: DataFrame, stop_words: list[str] | None = None) -> TextIndex:
    """tf * (ln((1 + N) / (1 + df)) + 1), each document scaled to length 1.

    Counts are written once, a row per document, so the text is tokenised once for both uses of them.
    """
    counted = cut(_counted(docs, stop_words))
    n_docs = docs.agg(F.count(F.lit(1))).first()[0]
    df = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = cut(df.withColumn("idf", F.log((F.lit(n_docs) + 1) / (F.col("df") + 1)) + 1))
    once = terms.where("df = 1").agg(F.max("idf")).first()[0]
    return TextIndex(terms, _weights(counted, terms, once), stop_words)


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def stored(index: TextIndex, buckets: int | None = None) -> TextIndex:
    """The index as written tables, to be searched many times.

    The weights lie in a folder per bucket of terms, sorted by term in each file, so a search reads
    the buckets of its terms only. There is a bucket per POSTINGS_PER_BUCKET weights, unless
    ``buckets`` says otherwise. A frequent term spreads over several files of its bucket.
    """
    terms = index.terms
    if buckets is None:
        postings = terms.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
        buckets = min(MOST_BUCKETS, 1 + int(postings) // POSTINGS_PER_BUCKET)
    if buckets == 1:
        return TextIndex(terms, cut(index.weights), index.stop_words)
    spark = terms.sparkSession
    laid = index.weights.withColumn("bucket", _bucket(buckets))
    path = new_folder(spark, "postings")
    laid.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)
    weights = spark.read.schema(laid.schema).parquet(path)
    return TextIndex(terms, weights, index.stop_words, buckets)


def postings(index: TextIndex, wanted: DataFrame) -> DataFrame:
    """Weights that hold those of the terms in ``wanted``: the bucket numbers are at most MOST_BUCKETS."""
    if index.buckets is None:
        return index.weights
    numbers = wanted.agg(F.collect_set(_bucket(index.buckets))).first()[0]
    return index.weights.where(F.col("bucket").isin(numbers) if numbers else F.lit(False)).drop("bucket")


def scores(index: TextIndex, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, nlp_score) for documents sharing a term with the query.

    ``queries``: (query_id, text); words outside the vocabulary are ignored.
    """
    return _scores(index, term_counts(queries, "query_id", index.stop_words), "query_id")


def _scores(index: TextIndex, tf: DataFrame, key: str) -> DataFrame:
    raw = tf.join(index.terms, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    wanted = raw.select(key, "term", (F.col("raw") / norm).alias("q"))
    if index.buckets is not None:
        wanted = cut(wanted)
    return (
        postings(index, wanted)
        .join(wanted, "term")
        .groupBy(key, "doc_id")
        .agg(F.sum(F.col("q") * F.col("weight")).alias("nlp_score"))
    )


def _texts(index: TextIndex, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, text_id) of all queries, and (text_id, term, tf): queries with equal counts share a text."""
    tf = term_counts(queries, "query_id", index.stop_words)
    every = queries.select("query_id", F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("tf"))
    entry = F.when(F.col("term").isNotNull(), F.struct("term", "tf"))
    counts = cut(
        tf.select("query_id", "term", "tf").unionByName(every)
        .groupBy("query_id")
        .agg(F.sort_array(F.collect_list(entry)).alias("counts"))
    )
    texts = cut(counts.select("counts").distinct().withColumn("text_id", F.monotonically_increasing_id()))
    asked = cut(counts.join(texts, "counts").select("query_id", "text_id"))
    return asked, texts.select("text_id", F.explode("counts").alias("c")).select("text_id", "c.term", "c.tf")


def query(
    index: TextIndex,
    docs: DataFrame,
    queries: DataFrame,
    n: int = 10,
    svd: DataFrame | None = None,
) -> DataFrame:
    """Top ``n`` documents per query: 0.7 * text + 0.3 * recommender, missing scores count 0.

    ``svd``: (query_id, doc_id, svd_score), of any length per query. Documents scoring 0 on
    both sides can only fill the list from the lowest ids, so a short run of these joins the
    candidates instead of every document.

    A text is searched once, however many queries ask it. Its best ``n`` + (longest list) documents
    hold the best ``n`` outside the list of any of its queries; those inside are scored one by one.
    """
    asked, terms = _texts(index, queries)
    # A listed document may score below 0, so the filler must reach past the longest list.
    longest = 0
    if svd is not None:
        svd = cut(svd.select("query_id", "doc_id", "svd_score"))
        longest = svd.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    lowest = docs.select("doc_id").orderBy("doc_id").limit(2 * n + longest)
    run = lowest.agg(F.sort_array(F.collect_list("doc_id"))).scalar()
    padding = asked.select("text_id").distinct().select(
        "text_id", F.explode(run).alias("doc_id"), F.lit(0.0).alias("nlp_score")
    )
    found = _scores(index, terms, "text_id").unionByName(padding)
    found = found.groupBy("text_id", "doc_id").agg(F.sum("nlp_score").alias("nlp_score"))
    found = found if svd is None else cut(found)
    # Rounded before ranking: equal texts must tie whatever the order of their sums.
    combined = F.round(TEXT_WEIGHT * F.col("nlp_score") + SVD_WEIGHT * F.col("svd_score"), 9)
    order = [F.desc("combined_score"), F.asc("doc_id")]
    alone = found.withColumn("svd_score", F.lit(0.0)).withColumn("combined_score", combined)
    best = top_per_group(alone, ["text_id"], order, n + longest, "place")
    if svd is None:
        listed, places = None, F.sequence(F.lit(1), F.lit(n))
    else:
        best = cut(best)
        listed = cut(_listed(svd, asked, found, best).withColumn("combined_score", combined))
        own = listed.groupBy("query_id").agg(F.collect_set("place").alias("own"))
        own = own.withColumnRenamed("query_id", "_query")
        asked = asked.join(own, F.col("query_id").eqNullSafe(F.col("_query")), "left").drop("_query")
        taken = F.coalesce("own", F.array().cast("array<int>"))
        free = F.array_except(F.sequence(F.lit(1), F.size(taken) + n), taken)
        places = F.slice(free, 1, n)
    columns = ["query_id", "doc_id", "nlp_score", "svd_score", "combined_score"]
    merged = asked.select("query_id", "text_id", F.explode(places).alias("place")).join(best, ["text_id", "place"])
    merged = merged.select(*columns)
    if listed is not None:
        merged = merged.unionByName(listed.select(*columns))
    return top_per_group(merged, ["query_id"], order, n)


def _listed(svd: DataFrame, asked: DataFrame, found: DataFrame, best: DataFrame) -> DataFrame:
    """(query_id, doc_id, svd_score, nlp_score, place) of the lists' documents: place among the best
    of the query's text, null behind them."""
    known = found.unionByName(best.select("text_id", "doc_id", "nlp_score", "place"), allowMissingColumns=True)
    known = known.groupBy(F.col("text_id").alias("_text"), F.col("doc_id").alias("_doc")).agg(
        F.max("nlp_score").alias("nlp_score"), F.max("place").alias("place")
    )
    rows = svd.groupBy("query_id", "doc_id").agg(F.sum("svd_score").alias("svd_score"))
    of = asked.withColumnRenamed("query_id", "_query")
    rows = rows.join(of, F.col("query_id").eqNullSafe(F.col("_query")), "left")
    same = (F.col("text_id") == F.col("_text")) & F.col("doc_id").eqNullSafe(F.col("_doc"))
    missing = F.when(F.col("_text").isNotNull(), F.lit(0.0))
    return rows.join(known, same, "left").select(
        "query_id", "doc_id", F.coalesce("svd_score", missing).alias("svd_score"),
        F.coalesce("nlp_score", F.lit(0.0)).alias("nlp_score"), "place",
    )


def products(results: DataFrame, star: DataFrame, bought: DataFrame) -> DataFrame:
    """Results of :func:`query` with product columns and the previously_bought flag.

    ``bought``: (query_id, doc_id) of the products the asking user has bought.
    """
    flags = bought.select("query_id", "doc_id").distinct().withColumn("_b", F.lit(True))
    named = star.withColumnRenamed("product_id", "doc_id")
    return (
        results.join(named, "doc_id")
        .join(flags, ["query_id", "doc_id"], "left")
        .select(
            "query_id", "rank", F.col("doc_id").alias("product_id"), "product_name", "aisle",
            "department", "nlp_score", "svd_score", "combined_score",
            F.coalesce("_b", F.lit(False)).alias("previously_bought"),
        )
    )


def by_aisle(results: DataFrame) -> DataFrame:
    """Results per (query, aisle): number, names in rank order, department of the first."""
    return results.groupBy("query_id", "aisle").agg(
        F.count(F.lit(1)).alias("n_products"),
        F.array_sort(F.collect_list(F.struct("rank", "product_name")))
        .getField("product_name")
        .alias("product_names"),
        F.min_by("department", "rank").alias("department"),
    )
