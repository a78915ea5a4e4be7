"""Lines that many documents share, as bitmaps of the lines to keep; texts themselves are not moved.

1. Each line that is not blank becomes a record: a 128-bit hash of its key (blanks at both
   ends stripped, A-Z lower-cased), its document and its position.
2. Records are partitioned by ranges of (hash, document) and sorted there by position too.
   A line that a third of all documents hold so fills several ranges.  In this order the
   first record of each hash in each document is its first occurrence there.
3. First occurrences are counted by hash, with partial sums.  Hashes found in ``least``
   documents are common.
4. Records of common hashes are brought together by document and give its bitmap: the
   runs of lines that stay.  Hashes that hold a thousandth of all records are a thousand
   at most; they are broadcast, and only the others meet their records by a shuffle.

All steps are DataFrame expressions.

A document is a row; rows with equal doc_id and equal text are one document that was read
again and get equal results.  Rows without a doc_id are told apart by their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgrid.llm.store import drop_table, unused, write_table

LEAST = 10
SHARE = 1_000  # a hash with one record in so many is broadcast
BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DOCUMENT, HASH = ["doc", "twin"], ["h1", "h2"]


def line_key(line: Column) -> Column:
    """What equal lines have in common."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), _UPPER, _LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def document_key(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """(doc, twin): the id and 64 bits of the text, or 128 bits of the text where there is no id."""
    whole = F.coalesce(docs[text], F.lit(""))
    return [F.coalesce(docs[doc_id].cast("long"), F.xxhash64(whole, F.lit("no id"))).alias("doc"), F.xxhash64(F.lit("twin"), whole).alias("twin")]


def occurrences(docs: DataFrame) -> DataFrame:
    """(h1, h2, doc, twin, pos, first): every line that is not blank; ``first`` marks the first of its hash in its document.

    Ordered by hash, document and position inside ranges of (hash, document).
    """
    split = docs.select(*document_key(docs), F.posexplode(_lines(docs["text"])).alias("pos", "line")).withColumn("line", line_key(F.col("line")))
    records = write_table(split.filter("line <> ''").select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"), *DOCUMENT, "pos"), "line_records")
    by = [*HASH, *DOCUMENT]
    before = F.lag("pos").over(Window.partitionBy(*by).orderBy("pos"))
    stream = write_table(records.repartitionByRange(*by).select(*by, "pos", before.isNull().alias("first")), "line_stream")
    drop_table(records)
    return stream


def dropped_lines(docs: DataFrame, least: int = LEAST, keep_first: bool = False) -> DataFrame:
    """(doc, twin, dropped): for each document that loses lines their positions in order."""
    stream = occurrences(docs)
    counts = stream.groupBy(*HASH).agg(F.count(F.when(F.col("first"), 1)).alias("documents"), F.count("*").alias("lines"), F.min(F.struct(*DOCUMENT, "pos")).alias("at"))
    common = write_table(counts.filter(F.col("documents") >= least), "common_lines")
    total = stream.count()
    hot = common.filter(F.col("lines") * SHARE >= total)  # SHARE rows at most
    rare = common.filter(F.col("lines") * SHARE < total).hint("merge")
    found = stream.join(F.broadcast(hot), HASH).unionByName(stream.join(F.broadcast(hot.select(*HASH)), HASH, "left_anti").join(rare, HASH))
    if keep_first:
        found = found.filter(F.struct(*DOCUMENT, "pos") != F.col("at"))
    dropped = write_table(found.groupBy(*DOCUMENT).agg(F.sort_array(F.collect_set("pos")).alias("dropped")), "dropped_lines")
    drop_table(stream)
    drop_table(common)
    return dropped


def _kept_runs(dropped: Column, n_lines: Column) -> Column:
    """Runs (first, length) of the lines between the dropped ones."""
    edges = F.concat(F.array(F.lit(-1)), dropped, F.array(n_lines.cast("int")))
    gaps = F.zip_with(F.slice(edges, F.lit(1), F.size(edges) - 1), F.slice(edges, F.lit(2), F.size(edges) - 1), lambda a, b: F.struct((a + 1).alias("first"), (b - a - 1).alias("length")))
    return F.filter(gaps, lambda r: r["length"] > 0)


def with_bitmap(docs: DataFrame, columns: list[str], names: tuple[str, str, str] = ("n_lines", "n_dropped", "keep"), least: int = LEAST, keep_first: bool = False) -> DataFrame:
    """``columns`` of ``docs`` and, under ``names``: lines, dropped lines, and the bitmap as runs of kept lines.

    A null or empty text is one empty line, which stays; so do all blank lines.  Lines
    that occur often in fewer than ``least`` documents stay.  With ``keep_first`` the first
    occurrence of each common line (by doc_id, then position) stays.  An empty table gives
    no rows.  A text of any length is one row; its bitmap grows with its runs, not its lines.
    Positions count from 0 up to 2**31.
    """
    n_lines, n_dropped, keep = names
    dropped = dropped_lines(docs, least, keep_first)
    doc, twin, gone = (unused(docs.columns, k) for k in (*DOCUMENT, "dropped"))
    own = [c.alias(n) for c, n in zip(document_key(docs), (doc, twin), strict=True)]
    text = F.coalesce(docs["text"], F.lit(""))
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    count, have = unused([*docs.columns, *names], "count"), [docs[c] for c in columns]
    rows = docs.select(*have, *own, lines.cast("long").alias(count))
    joined = rows.join(dropped.select(F.col("doc").alias(doc), F.col("twin").alias(twin), F.col("dropped").alias(gone)).hint("merge"), [doc, twin], "left")
    empty = F.array().cast("array<int>")
    cut = F.coalesce(F.col(gone), empty)
    return joined.select(*(joined[c] for c in columns), F.col(count).alias(n_lines), F.size(cut).cast("long").alias(n_dropped), _kept_runs(cut, F.col(count)).alias(keep))


def kept_text(text: Column, keep: Column) -> Column:
    """The lines that stay, joined by newlines.  The outer array of one element holds the lines, which are split once and not for each run."""
    one = F.array(F.struct(_lines(text).alias("lines"), keep.alias("keep")))
    parts = F.transform(one, lambda t: F.flatten(F.transform(t["keep"], lambda r: F.slice(t["lines"], r["first"] + 1, r["length"]))))
    return F.array_join(F.get(parts, F.lit(0)), "\n")


def line_bitmaps(docs: DataFrame, least: int = LEAST, keep_first: bool = False) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, keep (runs of kept lines).  See :func:`with_bitmap`."""
    return with_bitmap(docs.select("doc_id", "text"), ["doc_id"], least=least, keep_first=keep_first)


def drop_lines(docs: DataFrame, least: int = LEAST, keep_first: bool = False) -> DataFrame:
    """``docs`` with its own columns and without common lines.  A null text stays null; a text may become empty."""
    names = tuple(unused(docs.columns, k) for k in ("n_lines", "n_dropped", "keep"))
    made = with_bitmap(docs, docs.columns, names, least, keep_first)
    cut = F.when(made[names[1]] > 0, kept_text(made["text"], made[names[2]])).otherwise(made["text"])
    return made.select(*(cut.alias(c) if c == "text" else made[c] for c in docs.columns))
