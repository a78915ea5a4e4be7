"""Document quality: base rules, and a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed to ``BUCKETS`` buckets and counted in trusted documents and
in the whole corpus.  The trusted multinomial is smoothed towards the corpus one: it gets
``PRIOR`` counts a bucket on average, in proportion to the corpus's shares.  So few trusted
documents say little, and nothing is rejected for the size of the tables.  A document's own
counts are left out of both models.  Its score is the mean of log(trusted / corpus) over its
hashed n-grams, so it does not grow with length; documents below ``THRESHOLD`` go.

Everything on the way is a DataFrame expression.  Counts are aggregated before they are
shuffled; they are kept as one row of arrays of fixed length, which the scoring plan gets by
scalar subqueries.  As literals these arrays would be in every printed plan, megabytes each
time, and Spark's driver prints and keeps plans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.store import own_columns, write_table

BUCKETS = 1 << 16
THRESHOLD = -0.2  # mean log-likelihood ratio below which a document goes
PRIOR = 2.0  # pseudo-counts of the trusted model, for each bucket on average
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
TRUSTED = 20_000  # bound of labelled documents that the trusted model is fitted on: those of smallest hash
_SPACE = r"[\x20\x09-\x0D]+"


def with_ngrams(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` and ``__words`` (array of words) and ``__pairs`` (a 64-bit hash of each two neighbouring words)."""
    words = F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), _SPACE), "")
    pairs = F.zip_with(
        F.slice("__words", F.lit(1), F.greatest(F.size("__words") - 1, F.lit(0))), F.slice("__words", F.lit(2), F.greatest(F.size("__words") - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b)
    )
    return docs.withColumn("__words", words).withColumn("__pairs", pairs)


def buckets(n: int) -> Column:
    """Buckets of the words and the pairs; ``n`` is a power of two, so the lowest bits of a hash are its remainder (and never null)."""
    if n & (n - 1):
        raise ValueError("the number of buckets must be a power of two")
    low = lambda h: h.bitwiseAND(F.lit(n - 1).cast("long")).cast("int")
    return F.concat(F.transform("__words", lambda w: low(F.xxhash64(w))), F.transform("__pairs", low))


def _windows() -> Column:
    """A 64-bit hash of each three neighbouring words."""
    return F.zip_with(F.slice("__pairs", F.lit(1), F.greatest(F.size("__pairs") - 1, F.lit(0))), F.slice("__words", F.lit(3), F.greatest(F.size("__words") - 2, F.lit(0))), lambda p, w: F.xxhash64(p, w))


def _covered(ordered: Column) -> Column:
    """Number of words in windows found at least twice, from (hash, place) of all windows in order."""
    same = lambda x, j: F.coalesce(F.get(ordered, j)["h"] == x["h"], F.lit(False))
    first = F.transform(F.filter(ordered, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"])
    return F.size(F.array_distinct(F.concat(first, F.transform(first, lambda i: i + 1), F.transform(first, lambda i: i + 2))))


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` (with n-grams) and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, all prefixed with ``__``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    placed = F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumn("__windows", _windows()).withColumn("__lines", lines)
    out = out.withColumn("__placed", F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), placed))
    out = out.withColumns(
        {
            "__n_words": F.size("__words").cast("long"),
            "__word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "__n_symbols": F.length(F.regexp_replace(whole, r"[^#*$%&|<>]+", "")).cast("long"),
            "__n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__n_repeat_words": F.coalesce(F.when(F.col("__placed").isNotNull(), _covered(F.col("__placed"))), F.lit(0)).cast("long"),
        }
    )
    failed = (F.col("__n_words") < MIN_WORDS) | (100 * F.col("__n_repeat_words") > MAX_REPEAT_PERCENT * F.col("__n_words"))
    return out.withColumn("__base_failed", failed).drop("__windows", "__lines", "__placed")


def trusted_ids(labels: DataFrame, most: int = TRUSTED) -> DataFrame:
    """(__trusted): up to ``most`` ids, by hash, of documents that all their labels call good."""
    good = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("quality")).filter("quality = 1")
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("__trusted"))


def _with_trusted(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """``docs`` and ``__trusted``: the document's id if it is trusted, else null."""
    return docs.join(F.broadcast(trusted_ids(labels, most)), F.col("doc_id") == F.col("__trusted"), "left")


def bucket_counts(docs: DataFrame, labels: DataFrame, n: int = BUCKETS, most: int = TRUSTED) -> DataFrame:
    """One row, written: n-grams in each bucket, ``corpus`` of all documents and ``trusted`` of trusted ones (array<double>), and the sums ``n_corpus`` and ``n_trusted``."""
    rows = with_ngrams(_with_trusted(docs.select("doc_id", "text"), labels, most))
    counted = rows.select(F.explode(buckets(n)).alias("bucket"), F.lit(1).cast("long").alias("corpus"), F.col("__trusted").isNotNull().cast("long").alias("trusted"))
    none = docs.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("corpus"), F.lit(0).cast("long").alias("trusted"))
    found = counted.unionAll(none).groupBy("bucket").agg(F.sum("corpus").alias("corpus"), F.sum("trusted").alias("trusted"))
    one = found.agg(F.sort_array(F.collect_list(F.struct("bucket", "corpus", "trusted"))).alias("all"), F.sum("corpus").alias("n_corpus"), F.sum("trusted").alias("n_trusted"))  # n buckets
    return write_table(one.select(*(F.col(f"all.{c}").cast("array<double>").alias(c) for c in ("corpus", "trusted")), "n_corpus", "n_trusted"), "bucket_counts")


def log_ratios(n: int, n_corpus: int, n_trusted: int) -> Column:
    """Of the arrays of counts: log(trusted / corpus) for each bucket with one count added, to six decimals; zeros if no document is trusted."""
    if not n_trusted:
        return F.transform("corpus", lambda c: F.lit(0.0))
    shift = math.log(n_corpus + n) - math.log(n_trusted + n)
    return F.zip_with("trusted", "corpus", lambda t, c: F.round(F.log(t + 1) - F.log(c + 1) + shift, 6))


def _with_mean_ratio(rows: DataFrame, counts: DataFrame, n: int, n_corpus: int, n_trusted: int, prior: float) -> DataFrame:
    """``rows`` (with buckets and ``__trusted``) and ``__mean``: its mean log ratio with ``prior``, its own counts left out.

    Buckets that a document has once need one look-up and one logarithm each; the ratios of
    the counts without that one are made beforehand.  Only the others are counted.

    Array functions take no subqueries, so the arrays are columns of a projection of their own,
    kept apart from the steps before.  Each is used at one place: Spark then puts the subquery
    there, and no row holds the array.
    """
    is_trusted, smooth = F.col("__trusted").isNotNull(), F.lit(prior * n)
    own = F.when(is_trusted, F.lit(1.0)).otherwise(F.lit(0.0))
    rows = rows.withColumns({"__sorted": F.sort_array("__buckets"), "__size": F.size("__buckets"), "__own": own})
    rows = rows.withColumns(
        {
            "__again": F.filter("__sorted", lambda b, i: b == F.get("__sorted", i + 1)),  # one entry less than the document has, of each bucket
            "__others": F.lit(float(n_corpus + n)) - F.col("__size"),
        }
    )
    ends = F.filter(F.sequence(F.lit(0), F.size("__again") - 1), lambda i: F.coalesce(F.get("__again", i) != F.get("__again", i + 1), F.lit(True)))
    rows = rows.withColumns({"__once": _as_it_is(F.array_except("__sorted", "__again")), "__ends": F.when(F.size("__again") > 0, ends)})

    def ratios(left: int) -> Column:
        return F.zip_with("trusted", "corpus", lambda t, c: F.when(c > 0, (t - left) / c).otherwise(F.lit(0.0)))

    arrays = {"__ratios0": ratios(0), "__ratios1": ratios(1), "__in_corpus": F.col("corpus"), "__in_trusted": F.col("trusted")}
    rows = rows.withColumns({k: counts.select(v).scalar() for k, v in arrays.items()})

    def of_once(left: int) -> Column:
        return F.aggregate("__once", F.lit(0.0), lambda a, b: a + F.log(F.get(f"__ratios{left}", b) * F.col("__others") + smooth))

    def of_again(i: Column, j: Column) -> Column:
        times, b = (i - F.coalesce(F.get("__ends", j - 1), F.lit(-1)) + 1).cast("double"), F.get("__again", i)
        left = (F.get("__in_trusted", b) - times * F.col("__own")) / (F.get("__in_corpus", b) - times + 1.0)
        return times * F.log(left * F.col("__others") + smooth)

    once = F.when(is_trusted, of_once(1)).otherwise(of_once(0))
    again = F.coalesce(F.aggregate(F.transform("__ends", of_again), F.lit(0.0), lambda a, x: a + x), F.lit(0.0))
    mean = (once + again) / F.col("__size") - F.log(F.lit(n_trusted + prior * n) - F.col("__own") * F.col("__size"))
    return rows.withColumn("__mean", mean).drop("__sorted", "__size", "__own", "__again", "__others", "__once", "__ends", *arrays)


def with_verdict(docs: DataFrame, labels: DataFrame, n: int = BUCKETS, threshold: float = THRESHOLD, prior: float | None = None) -> DataFrame:
    """``docs`` and, prefixed with ``__``: the base columns, ``__score`` and ``__kept``.

    ``prior`` smooths as the module's text says (production: ``PRIOR``); without it both
    models have one count added to every bucket and hold the document itself.

    A null or empty text has no words: it fails the base rules, its score is 0.  Each row
    gives one row, also if rows repeat.  Rows without a doc_id are scored like any other.
    """
    counts = bucket_counts(docs, labels, n)
    sums = counts.select("n_corpus", "n_trusted").first()
    if prior is None:
        rows = with_base(with_ngrams(docs)).withColumn("__buckets", _as_it_is(buckets(n)))
        rows = rows.withColumn("__weights", counts.select(log_ratios(n, *sums)).scalar())
        rows = rows.withColumn("__mean", F.aggregate("__buckets", F.lit(0.0), lambda a, b: a + F.get("__weights", b)) / F.size("__buckets")).drop("__weights")
    else:
        rows = with_base(with_ngrams(_with_trusted(docs, labels, TRUSTED))).withColumn("__buckets", buckets(n))
        rows = _with_mean_ratio(rows, counts, n, *sums, prior).drop("__trusted")
    scored = rows.withColumn("__score", F.when(F.size("__buckets") > 0, F.col("__mean")).otherwise(F.lit(0.0)))
    scored = scored.withColumn("__kept", ~F.col("__base_failed") & (F.col("__score") >= threshold)).drop("__words", "__pairs", "__buckets", "__mean")
    return scored.withColumns({c: _as_it_is(c) for c in scored.columns if c not in docs.columns})


def _as_it_is(column: str | Column) -> Column:
    """The column, behind a condition that always holds but that the optimizer can't know.

    Otherwise a filter on the column would be pushed below the steps that make the word
    arrays, and every element of an array would make the array anew; and the step above
    would be drawn into the one that makes the column.
    """
    return F.when(F.spark_partition_id() >= 0, F.col(column) if isinstance(column, str) else column)


@own_columns
def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with its own columns, without the documents that the rules reject."""
    return with_verdict(docs, labels, prior=PRIOR).filter("__kept").select(*(f"`{c}`" for c in docs.columns))
