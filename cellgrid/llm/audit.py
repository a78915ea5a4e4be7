"""What a chain of filters removes in every order of its filters, by recursion over prefixes.

Each document becomes a mask: one bit for each filter that it fails.  Documents are counted
by part and mask; these cells are all that later steps read.

A recursive query starts from the empty prefix with every mask.  Each level extends the
prefixes by a filter that they do not hold yet, and carries the bits applied so far, so a
row tells what that step does to the documents of a mask: remove them, find them removed
already, or keep them.  The walk has the same rows for every input (prefixes times masks);
it meets the cells by mask and is summed by part and prefix.

"Identical to an earlier text" is the only filter that looks at other documents.  Texts are
compared by 128-bit hashes.  Hashes with a thousandth of all rows are a thousand at most
and are broadcast; the others meet their documents by a shuffle.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.llm.store import drop_table, write_table
from cellgrid.operators.skew import no_match

MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT, SYMBOLS = 50, 65, 5, "[#$%&*|]"
FILTERS = "ABCDE"
COPY = "E"  # the filter that compares texts
SHARE = 1_000
METRICS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def text_failures(text: Column) -> dict[str, Column]:
    """Failure of each filter that looks at one text; a null text is empty."""
    whole = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(whole, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(whole) - F.length(F.translate(whole, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < MIN_DISTINCT_PERCENT * F.size(words).cast("long"),
        "C": 100 * capitals.cast("long") > MAX_CAPITAL_PERCENT * F.length(whole).cast("long"),
        "D": whole.rlike(SYMBOLS),
    }


def _labels(labels: DataFrame) -> DataFrame:
    """(doc, good, toxic): one row for each labelled id; it is good (toxic) if any of its labels says so."""
    said = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    return labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc")).agg(said("quality").alias("good"), said("toxic").alias("toxic"))


def mask_cells(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, mask, documents, good, toxic): documents by part and by the filters that they fail.

    Rows that repeat count each; a document fails the copy filter if a smaller doc_id has
    the same text.  Rows without a doc_id have no label, fail no copy filter and are no one's
    original.  A null part is the empty string.
    """
    text, failures = F.coalesce(F.col("text"), F.lit("")), text_failures(F.col("text"))
    bit = lambda f: 1 << FILTERS.index(f)
    mask = sum((F.when(c, F.lit(bit(f))).otherwise(F.lit(0)) for f, c in failures.items()), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("text"), text).alias("h2"), mask.alias("mask"))
    rows = write_table(rows.withColumn("doc_", no_match(F.col("doc"), "h1", F.monotonically_increasing_id())), "masks")
    known = _labels(labels).select(F.col("doc").alias("doc_"), "good", "toxic").hint("merge")
    rows_labelled = write_table(rows.join(known, "doc_", "left").drop("doc_"), "labelled")
    drop_table(rows)
    texts = rows_labelled.groupBy("h1", "h2").agg(F.min("doc").alias("original"), F.count("*").alias("copies")).filter("copies > 1 and original is not null")
    texts = write_table(texts, "copied_texts")
    total = rows_labelled.count()
    hot = texts.filter(F.col("copies") * SHARE >= total)  # SHARE rows at most
    rest = rows_labelled.join(F.broadcast(hot.select("h1", "h2")), ["h1", "h2"], "left_anti")
    cold = texts.filter(F.col("copies") * SHARE < total).hint("merge")
    columns = ["part", "mask", "doc", "original", "good", "toxic"]
    both = rows_labelled.join(F.broadcast(hot), ["h1", "h2"]).select(*columns).unionByName(rest.join(cold, ["h1", "h2"], "left").select(*columns))
    copy = F.when(F.col("doc") > F.col("original"), F.lit(bit(COPY))).otherwise(F.lit(0))
    counted = both.groupBy("part", (F.col("mask") + copy).alias("mask")).agg(
        F.count("*").alias("documents"), F.count(F.when(F.col("good"), 1)).alias("good"), F.count(F.when(F.col("toxic"), 1)).alias("toxic")
    )
    cells = write_table(counted, "cells")
    drop_table(rows_labelled)
    drop_table(texts)
    return cells


def walk(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """(prefix, step, applied, bit, mask): every ordered choice of filters, the bits applied before its last one, that one's bit, for every mask."""
    letters = ", ".join(f"named_struct('letter', '{f}', 'bit', {1 << i})" for i, f in enumerate(filters))
    steps = spark.sql(f"""
        WITH RECURSIVE walk(prefix, step, applied, bit, mask) AS (
          SELECT '', 0, 0, 0, mask FROM (SELECT explode(sequence(0, {(1 << len(filters)) - 1})) AS mask)
          UNION ALL
          SELECT concat(prefix, next.letter), step + 1, applied | bit, next.bit, mask
          FROM walk LATERAL VIEW explode(filter(array({letters}), l -> ((applied | bit) & l.bit) = 0)) t AS next
        )
        SELECT * FROM walk WHERE step > 0""")
    return steps


def step_metrics(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, prefix, and METRICS): what the last filter of each prefix does in each part."""
    meets = F.broadcast(write_table(walk(cells.sparkSession, filters), "walk"))  # as many rows as prefixes times masks
    fails, before = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("applied")) != 0
    count = lambda when, of="documents": F.sum(F.when(when, F.col(of)).otherwise(F.lit(0)))
    return cells.join(meets, "mask").groupBy("part", "prefix").agg(
        count(~fails & ~before).alias("kept"), count(fails & ~before).alias("removed"), count(fails & before).alias("redundant"),
        count(F.col("mask") == F.col("bit")).alias("unique_fails"), count(fails & ~before, "good").alias("good_lost"), count(fails & ~before, "toxic").alias("toxic_lost"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """Per part, order of all filters and step: the metrics of that step, and its filter's removals summed over all orders (``shapley``).

    Texts may be null, empty (they fail A alone, and E as copies) or of any length; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    metrics = write_table(step_metrics(mask_cells(docs, labels, part)), "step_metrics")
    orders = ["".join(p) for p in permutations(FILTERS)]
    places = spark.createDataFrame([(o, i, o[:i]) for o in orders for i in range(1, len(FILTERS) + 1)], "filter_order string, step int, prefix string")
    steps = metrics.join(F.broadcast(places), "prefix")
    letter = F.substring("prefix", -1, 1)
    shares = steps.groupBy("part", letter.alias("letter")).agg(F.sum("removed").alias("shapley"))
    placed = steps.withColumn("letter", letter).join(shares, ["part", "letter"])
    return placed.select("part", "filter_order", "step", *METRICS, "shapley")
