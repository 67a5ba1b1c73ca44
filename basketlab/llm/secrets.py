"""Secret scans on DataFrame functions only: fixed patterns and a battery of randomness tests.

Patterns find assignments, access keys and hexadecimal strings. The battery looks at every string
of ``LEAST`` or more key characters. Its encoding is inferred (hexadecimal, base 32, capitals and
digits, letters and digits, base 64) and its characters, numbered in that alphabet, are tested:

* chi-squared: are all characters of the alphabet about as frequent?
* runs: do the upper and lower half of the alphabet alternate as by chance?
* serial correlation: does a character say something about the next one?

The three combine (Bonferroni) to one value of randomness. What ordinary text yields is measured, not
assumed: words of letters alone are the null sample, and a string's p-value is the share of null
words, of its length class or a shorter one, that look at least as random. Benjamini-Hochberg with
weights in proportion to the length (long strings carry more evidence) keeps the share of false
discoveries over the whole corpus below ``RATE``. Both distributions travel as histograms of a fixed
number of bins. A string is a candidate if it has digits as well as letters.

Null and empty texts have no spans. Repeated rows are kept; rows of one id and equal text share
their result. Extra columns are ignored. Offsets are code points, ends exclusive. Without null words
or candidates the battery adds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlab.llm.native import let, normal_tail, parted, places
from basketlab.llm.common import cut

KINDS = ("assign", "access", "hex", "random")
LEAST = 16
RATE = 0.05
# Spans up to which a text is cut span by span; more are cut by its array of characters.
FEW = 20

# The patterns. A match of too few characters is dropped, so runs may ask for them at
# once; an assignment must match first and is measured after.
ASSIGN = (
    r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"

_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _spans(found: Column, kind: int) -> Column:
    return F.transform(
        found, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"))
    ).cast(_SPAN)


def base_spans(text: Column) -> Column:
    """All pattern spans (start, kind number, end) in order."""
    parts = [places(text, ASSIGN, group=2, least=12), places(text, ACCESS), places(text, HEX)]
    return F.array_sort(F.concat(*[_spans(p, k) for k, p in enumerate(parts)]))


def candidates(rows: DataFrame) -> DataFrame:
    """(key columns, start, end, token) of every long string of key characters."""
    found = rows.select("doc_id", "text_hash", F.explode(places(F.col("text"), CANDIDATE)).alias("s"))
    return found.select(
        "doc_id", "text_hash", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.text").alias("token")
    )


def battery(tokens: DataFrame) -> DataFrame:
    """``tokens`` with n, is_null, is_candidate and doubt, -log10 of the combined p-value of randomness."""
    digits, low, high = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    token = F.col("token")
    alphabet = (
        F.when(token.rlike("^[0-9a-f]+$"), digits + low[:6])
        .when(token.rlike("^[0-9A-F]+$"), digits + high[:6])
        .when(token.rlike("^[A-Z2-7]+=*$"), high + digits[2:8])
        .when(token.rlike("^[A-Z0-9]+$"), digits + high)
        .when(token.rlike("^[A-Za-z0-9]+$"), digits + high + low)
        .otherwise(digits + high + low + "+/-_=")
    )
    rows = tokens.withColumn("n", F.length("token")).withColumn("alphabet", alphabet)
    rows = rows.withColumn("k", F.length("alphabet"))
    rows = rows.withColumn(
        "v", F.expr("transform(slice(split(token, ''), 1, n), x -> locate(x, alphabet))")
    )
    rows = rows.select(
        *[c for c in rows.columns],
        F.expr(
            # Of sorted characters: a run that grows from c to c + 1 adds 2 c + 1 to the sum of squares.
            "aggregate(sort_array(v), named_struct('p', -1, 'c', 0D, 's', 0D), (a, x) -> IF(x = a.p, "
            "named_struct('p', x, 'c', a.c + 1, 's', a.s + 2 * a.c + 1), named_struct('p', x, 'c', 1D, 's', a.s + 1)), a -> a.s)"
        ).alias("squares"),
        F.expr("aggregate(v, 0D, (a, x) -> a + x) / n").alias("mean"),
        F.expr("size(filter(v, x -> x * 2 > k))").cast("double").alias("upper"),
        F.expr(
            "aggregate(sequence(1, n - 1), 1D, (a, i) -> a + IF((v[i] * 2 > k) = (v[i - 1] * 2 > k), 0, 1))"
        ).alias("runs"),
    )
    rows = rows.select(
        *rows.columns,
        F.expr("aggregate(v, 0D, (a, x) -> a + power(x - mean, 2))").alias("spread"),
        F.expr(
            "aggregate(sequence(1, n - 1), 0D, (a, i) -> a + (v[i] - mean) * (v[i - 1] - mean))"
        ).alias("serial"),
    )
    n, k, upper = F.col("n").cast("double"), F.col("k").cast("double"), F.col("upper")
    chi = k / n * F.col("squares") - n
    freedom = k - 1
    # Wilson-Hilferty: the cube root of chi-squared is about normal.
    uneven = (F.pow(F.greatest(chi, F.lit(0.0)) / freedom, F.lit(1 / 3)) - (1 - 2 / (9 * freedom))) / F.sqrt(
        2 / (9 * freedom)
    )
    lower = n - upper
    expected = 2 * upper * lower / n + 1
    variance = (expected - 1) * (expected - 2) / (n - 1)
    runs = F.when(variance > 0, (F.col("runs") - expected) / F.sqrt(variance)).otherwise(8.0)
    serial = F.when(F.col("spread") > 0, (F.col("serial") / F.col("spread") + 1 / n) * F.sqrt(n)).otherwise(8.0)
    two_sided = lambda z: 2 * normal_tail(F.abs(z))
    value = F.least(F.lit(1.0), 3 * F.least(normal_tail(uneven), two_sided(runs), two_sided(serial)))
    return rows.select(
        *tokens.columns,
        "n",
        token.rlike("^[A-Za-z]+$").alias("is_null"),
        (token.rlike("[0-9]") & token.rlike("[A-Za-z]")).alias("is_candidate"),
        (-F.log10(F.greatest(value, F.lit(1e-16)))).alias("doubt"),
    )


def discoveries(tested: DataFrame, rate: float = RATE) -> DataFrame:
    """The candidates that false-discovery control lets pass."""
    # Bins of doubt (0 = as random as can be) and length classes: bounded tables, whatever the input.
    step = F.floor(F.col("doubt") * 20).cast("int")
    kind = F.least(F.floor(F.log2(F.col("n").cast("double"))), F.lit(10)).cast("int")
    rows = tested.withColumn("bin", step).withColumn("class", kind)
    null = rows.where("is_null").groupBy("class", "bin").agg(F.count("*").alias("c"))
    counts = rows.where("is_candidate").groupBy("class", "bin", "n").agg(F.count("*").alias("m"))
    shorter = null.select(F.col("class").alias("nc"), F.col("bin").alias("nb"), "c")
    cells = counts.select("class", "bin").distinct()
    share = (
        cells.join(F.broadcast(shorter), F.col("nc") <= F.col("class"), "left")
        .groupBy("class", "bin")
        .agg(
            F.sum(F.when(F.col("nb") <= F.col("bin"), F.col("c")).otherwise(0)).alias("above"),
            F.sum(F.coalesce("c", F.lit(0))).alias("whole"),
        )
        .select("class", "bin", ((1 + F.col("above")) / (1 + F.col("whole"))).alias("p"))
    )
    mean = counts.agg((F.sum(F.col("n") * F.col("m")) / F.sum("m")).alias("a")).first().a
    if mean is None:
        return rows.where(F.lit(False)).select(tested.columns)
    weighted = F.least(F.lit(1.0), F.col("p") * mean / F.col("n"))
    fine = F.floor(-F.log(weighted) * 64).cast("int")
    steps = counts.join(share, ["class", "bin"]).withColumn("fine", fine).groupBy("fine").agg(F.sum("m").alias("m"))
    # One row per fine bin (a few thousand at most): ranks from the smallest p-value on.
    ranked = steps.withColumn("rank", F.sum("m").over(Window.orderBy(F.desc("fine"))))
    total = F.sum("m").over(Window.partitionBy(F.lit(1)))
    ranked = ranked.withColumn("total", total).where(
        F.exp(-F.col("fine") / 64) <= rate * F.col("rank") / F.col("total")
    )
    limit = ranked.agg(F.min("fine").alias("x")).first().x
    if limit is None:
        return rows.where(F.lit(False)).select(tested.columns)
    return (
        rows.where("is_candidate")
        .join(F.broadcast(share), ["class", "bin"])
        .where(fine >= limit)
        .select(tested.columns)
    )


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """(doc_id, text_hash, base, spans): one row per input row; spans hold base ones and discoveries."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    base = rows.select("doc_id", "text_hash", base_spans(F.col("text")).alias("base"))
    tested = cut(battery(candidates(rows)))
    found = discoveries(tested, rate).select("doc_id", "text_hash", "start", "end").distinct()
    found = _apart(found, base)
    found = found.groupBy("doc_id", "text_hash").agg(
        F.collect_list(
            F.struct(F.col("start"), F.lit(KINDS.index("random")).alias("kind"), F.col("end"))
        ).alias("more")
    )
    found = found.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "more")
    both = base.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    more = F.coalesce(F.col("more").cast(_SPAN), F.array().cast(_SPAN))
    return both.select("doc_id", "text_hash", "base", F.array_sort(F.concat("base", more)).alias("spans"))


def _apart(found: DataFrame, base: DataFrame) -> DataFrame:
    """The discoveries that no pattern span of their text overlaps: sorted by start, each looks at the
    furthest end of pattern spans before it and at the next start after."""
    marks = found.select("doc_id", "text_hash").distinct().withColumnsRenamed({"doc_id": "d", "text_hash": "h"})
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))
    fixed = base.join(marks, same, "left_semi").dropDuplicates(["doc_id", "text_hash"])
    fixed = fixed.select("doc_id", "text_hash", F.explode("base").alias("s"))
    rows = found.withColumn("fixed", F.lit(False)).unionByName(
        fixed.select("doc_id", "text_hash", "s.start", "s.end", F.lit(True).alias("fixed"))
    )
    own = Window.partitionBy("doc_id", "text_hash").orderBy("start")
    before = F.max(F.when(F.col("fixed"), F.col("end"))).over(own.rangeBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(F.col("fixed"), F.col("start"))).over(own.rangeBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("before", before).withColumn("after", after)
    free = (F.coalesce("before", "start") <= F.col("start")) & (F.coalesce("after", "end") >= F.col("end"))
    return rows.where(~F.col("fixed") & free).select("doc_id", "text_hash", "start", "end")


def joined(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
    )
    return F.array_join(F.transform(spans, one), ",")


def digest(scanned: DataFrame) -> DataFrame:
    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    return scanned.select(
        "doc_id", *map(count, range(3)), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans")
    )


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """All documents, every span (overlapping ones as one) replaced by ``mark``; other columns as they were."""
    found = scan(docs, doc_id, text).where(F.size("spans") > 0)
    found = found.groupBy("doc_id", "text_hash").agg(F.first("spans").alias("__spans"))
    found = found.select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h"), "__spans")
    same = F.col(doc_id).eqNullSafe(F.col("__d")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("__h"))
    rows = docs.join(found, same, "left")
    source = F.col(text)

    def step(state: Column, span: Column) -> Column:
        start = F.greatest(state["at"], span["start"])
        inside = span["start"] < state["at"]
        piece = source.substr((state["at"] + 1).cast("int"), (start - state["at"]).cast("int"))
        out = F.when(inside, state["out"]).otherwise(F.concat(state["out"], piece, F.lit(mark)))
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), out.alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    rest = lambda s: F.concat(s["out"], source.substr((s["at"] + 1).cast("int"), F.length(source)))
    few = F.aggregate("__spans", zero, step, rest)
    cleaned = (
        F.when(F.col("__spans").isNull(), source).when(F.size("__spans") <= FEW, few).otherwise(_cut_out(source, mark))
    )
    return rows.select(*[cleaned.alias(c) if c == text else F.col(c) for c in docs.columns])


def _cut_out(source: Column, mark: str) -> Column:
    """``source`` with ``__spans`` replaced by way of its array of characters, which takes many spans at once.

    Spans are sorted by start; what stays lies between the furthest end so far and the next start.
    """
    n = F.length(source)
    ends = F.concat(F.array(F.lit(0).cast("long")), F.col("__spans.end"))
    starts = F.concat(F.col("__spans.start"), F.array(n.cast("long")))
    gaps = F.zip_with(starts, let(ends, _furthest), lambda start, reach: F.struct(start.alias("start"), reach.alias("reach")))

    def kept(chars: Column) -> Column:
        def piece(gap: Column) -> Column:
            part = F.slice(chars, (gap["reach"] + 1).cast("int"), (gap["start"] - gap["reach"]).cast("int"))
            return F.when(gap["start"] >= gap["reach"], F.array_join(part, ""))

        return F.transform(gaps, piece)

    # A gap without text between two overlapping spans is null and joins them under one mark.
    return F.array_join(let(F.slice(F.split(source, ""), F.lit(1), n), kept), mark)


def _furthest(ends: Column) -> Column:
    """Largest value up to each place, in parts so that no long array is copied for each member."""
    empty = F.array().cast("array<bigint>")

    def grow(state: Column, end: Column) -> Column:
        last = F.when(F.size(state) > 0, F.element_at(state, -1))
        return F.concat(state, F.array(F.greatest(last, end)))

    def joined_up(inside: Column) -> Column:
        tops = F.aggregate(
            inside,
            F.array(F.lit(0).cast("long")),
            lambda a, part: F.concat(a, F.array(F.greatest(F.element_at(a, -1), F.element_at(part, -1)))),
        )
        before = F.slice(tops, F.lit(1), F.size(inside))
        return F.flatten(F.zip_with(inside, before, lambda part, top: F.transform(part, lambda x: F.greatest(x, top))))

    return let(F.transform(parted(ends), lambda part: F.aggregate(part, empty, grow)), joined_up)
