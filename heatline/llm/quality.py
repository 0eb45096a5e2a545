"""Quality rules and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

The base rules count words, symbols, repeated lines and words in repeated 8-word windows (windows are
compared by 64-bit hashes). The method scores every document by the mean, over its words and word pairs,
of log(target / raw) between two multinomials over hashed n-grams: the trusted target (a bounded sample of
labelled rows, `trusted_rows`) and the whole raw corpus, both with add-one smoothing. A document is kept
if no base rule fails and its ratio reaches the threshold.

The counts are one aggregate with a row for each bucket and task, so no key is hot; the weights sent to the
executors are one number for each bucket. Defined results: null or empty text has no words and fails the
base rules; null doc_ids are scored but never trusted; repeated rows count as often as they come; with no
trusted rows every ratio is against the smoothed uniform distribution; texts of any length are read whole; columns of
any name pass unchanged; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, quoted, read_table

BUCKETS = 1 << 14
TRUSTED_ROWS = 20_000
THRESHOLD = -0.075
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = r"[#*$%&|<>]"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def joined(hashes: Column, n: Column, step: int) -> Column:
    """Hashes of spans twice as long: each hash with the one `step` places on. n: how many come out."""
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))


def repeated_words(windows: Column) -> Column:
    """How many words the windows cover that have an equal one elsewhere; windows: their hashes in order."""

    def cover(s: Column) -> Column:
        twin = F.filter(s, lambda x, i: F.coalesce((x["h"] == F.get(s, i - 1)["h"]), F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)))
        starts = F.array_sort(F.transform(twin, lambda x: x["i"]))
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-WINDOW).cast("long").alias("at"))
        return F.aggregate(starts, start, lambda acc, x: F.struct((acc["sum"] + F.least(F.lit(WINDOW).cast("long"), x - acc["at"])).alias("sum"), x.alias("at")), lambda acc: acc["sum"])

    order = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(order, cover))


def with_hashes(docs: DataFrame) -> DataFrame:
    """docs with their words and hashes of words (h1) and of word pairs (h2)."""
    out = docs.withColumn("__hl_text", F.coalesce(F.col("text"), F.lit(""))).withColumn("__hl_words", words_of(F.col("__hl_text"))).withColumn("__hl_n", F.size("__hl_words"))
    out = out.withColumn("__hl_h1", F.transform("__hl_words", lambda w: F.xxhash64(w)))
    return out.withColumn("__hl_h2", joined(F.col("__hl_h1"), F.greatest(F.col("__hl_n") - 1, F.lit(0)), 1))


def trusted(labels: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    good = labels.where("quality = 1 and toxic = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("__hl_trusted_id")).distinct()
    return good.orderBy(F.xxhash64("__hl_trusted_id"), "__hl_trusted_id").limit(rows)


def weights(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, rows: int = TRUSTED_ROWS) -> list[float]:
    """log(target / raw) of each bucket."""
    hashed = with_hashes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    marked = hashed.join(F.broadcast(trusted(labels, rows)), F.col("doc_id") == F.col("__hl_trusted_id"), "left")
    grams = marked.select(F.col("__hl_trusted_id").isNotNull().cast("long").alias("t"), F.explode(F.concat("__hl_h1", "__hl_h2")).alias("h"))
    counted = grams.groupBy(F.pmod("h", F.lit(buckets)).cast("int").alias("b")).agg(F.count("*").alias("raw"), F.sum("t").alias("target")).collect()
    raw, target = [1] * buckets, [1] * buckets
    for r in counted:
        raw[r["b"]] += r["raw"]
        target[r["b"]] += r["target"]
    level = math.log(sum(raw)) - math.log(sum(target))
    return [math.log(t) - math.log(r) + level for t, r in zip(target, raw, strict=True)]


def judged(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, rows: int = TRUSTED_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """docs with the counts of the base rules, `ratio`, base_failed and kept."""
    table = F.split(F.lit(",".join(f"{w:.7f}" for w in weights(docs, labels, buckets, rows))), ",").cast("array<double>")
    n = F.col("__hl_n")
    out = with_hashes(docs)
    out = out.withColumn("__hl_h4", joined(F.col("__hl_h2"), F.greatest(n - 3, F.lit(0)), 2))
    out = out.withColumn("__hl_windows", joined(F.col("__hl_h4"), F.greatest(n - 7, F.lit(0)), 4))
    lines = F.filter(F.split("__hl_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    total = F.aggregate(F.concat("__hl_h1", "__hl_h2"), F.lit(0.0), lambda acc, h: acc + F.get(table, F.pmod(h, F.lit(buckets)).cast("int")))
    out = out.withColumn("__hl_lines", lines).select(
        *[F.col(c) for c in docs.columns],
        n.cast("long").alias("__hl_n_words"),
        F.length(F.array_join("__hl_words", "")).cast("long").alias("__hl_word_chars"),
        (F.length("__hl_text") - F.length(F.regexp_replace("__hl_text", SYMBOLS, ""))).cast("long").alias("__hl_n_symbols"),
        (F.size("__hl_lines") - F.size(F.array_distinct("__hl_lines"))).cast("long").alias("__hl_n_dup_lines"),
        F.when(n < WINDOW, F.lit(0).cast("long")).otherwise(repeated_words(F.col("__hl_windows"))).alias("__hl_n_repeat_words"),
        F.try_divide(total, F.greatest(2 * n - 1, F.lit(1))).alias("__hl_ratio"),
    )
    failed = (F.col("__hl_n_words") < MIN_WORDS) | (100 * F.col("__hl_n_repeat_words") > REPEAT_PERCENT * F.col("__hl_n_words"))
    return out.withColumn("__hl_base_failed", failed).withColumn("__hl_kept", ~F.col("__hl_base_failed") & (F.col("__hl_ratio") >= threshold))


VERDICT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio")


def rules(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id and the verdict on every row."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return judged(slim, labels, **options).select("doc_id", *(F.col(f"__hl_{c}").alias(c) for c in VERDICT))


def kept(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that are kept, with their own columns."""
    own = {f"__hl_own_{k}": c for k, c in enumerate(docs.columns)}
    apart = docs.select("doc_id", "text", *[quoted(c).alias(k) for k, c in own.items()])
    # The mark is not deterministic, so the filter stays above the columns it reads; pushed below them, it would
    # hold every one of their expressions written out, shared parts many times over. Rows don't depend on it.
    marked = judged(apart, labels, **options).withColumn("__hl_mark", F.monotonically_increasing_id())
    return marked.where(F.col("__hl_kept") & (F.col("__hl_mark") >= 0)).select(*[F.col(k).alias(c) for k, c in own.items()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
