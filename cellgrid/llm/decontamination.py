"""Benchmark decontamination with a suffix automaton of the test items.

The normalised words of all items go into one generalised suffix automaton (in blocks of
bounded size), which is broadcast.  Documents stream through it: after every word the
automaton's state tells the longest run of words ending there that occurs in an item.
Runs as long as a window are hits.  Only stretches in which every two neighbouring words
also follow each other in some item are walked, as no other can hold a hit.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellgrid.llm.automaton import Matcher
from cellgrid.llm.cutting import cut_bytes, merged
from cellgrid.llm.store import arrow_map, own_columns, write_table
from cellgrid.llm.words import Lexer, find_words, slices, text_buffer

WINDOW, COVERAGE = 13, 20  # words in a window; a document is contaminated from one hit word in 20
BLOCK_WORDS = 200_000  # item words in one automaton: bounds what is broadcast
WORDS = Lexer("alnum", lower=True)

_SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))
_SPANS_ARROW = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_FOUND = {"__n_words": T.LongType(), "__spans": _SPANS, "__items": T.ArrayType(T.StringType())}


def _blocks(benchmark: DataFrame, window: int, block_words: int):
    """Matchers over consecutive items, each with ``block_words`` words or one item."""
    held: list = []
    size = 0
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), "text").filter("id is not null and text is not null")
    for row in items.toLocalIterator():
        hashes = find_words(pa.array([row["text"]]), WORDS).hash
        if held and size + len(hashes) > block_words:
            yield Matcher(held, window)
            held, size = [], 0
        held.append((row["id"], hashes))
        size += len(hashes)
    yield Matcher(held, window)


def find_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """All columns of ``docs`` and ``__n_words``, ``__spans`` (disjoint ranges of hit words), ``__items`` (ids, sorted as strings).

    A null or empty text has no words.  Items without an id or without words are none;
    rows that repeat an item count once.  Each row of ``docs`` gives one row.  Columns of
    ``docs`` must not have these names.
    """
    schema = T.StructType([*docs.schema.fields, *(T.StructField(k, t) for k, t in _FOUND.items())])
    spark = docs.sparkSession
    for number, matcher in enumerate(_blocks(benchmark, window, block_words)):
        shared = spark.sparkContext.broadcast(matcher)
        docs = write_table(docs, "spans") if number else docs.withColumns({k: F.lit(None).cast(t) for k, t in _FOUND.items()})

        def each(batch: pa.RecordBatch, shared=shared):
            for piece in slices(batch, "text"):
                words = find_words(piece.column(piece.schema.get_field_index("text")), WORDS)
                spans, items = shared.value.match(words)
                n = piece.num_rows
                before = {k: piece.column(piece.schema.get_field_index(k)) for k in _FOUND}
                all_spans = [[(s["first"], s["last"]) for s in x] if x else [] for x in before["__spans"].to_pylist()]
                all_items = [set(x or ()) for x in before["__items"].to_pylist()]
                for first, last in spans:
                    d = int(words.doc[first])
                    all_spans[d].append((first - int(words.first[d]), last - int(words.first[d])))
                for d, names in items.items():
                    all_items[d] |= names
                made = {
                    "__n_words": pa.array(words.first[1:] - words.first[:-1]) if n else pa.array([], pa.int64()),
                    "__spans": pa.array([[{"first": a, "last": b} for a, b in merged(x)] for x in all_spans], _SPANS_ARROW),
                    "__items": pa.array([sorted(x) for x in all_items], pa.list_(pa.string())),
                }
                yield pa.RecordBatch.from_arrays([made.get(f.name, piece.column(i)) for i, f in enumerate(piece.schema)], [f.name for f in piece.schema])

        docs = arrow_map(docs, each, schema)
    return docs


def n_hit(spans: str = "__spans"):
    return F.aggregate(F.col(spans), F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)


def contaminated(coverage: int = COVERAGE):
    return (n_hit() > 0) & (coverage * n_hit() >= F.col("__n_words"))


@own_columns
def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE) -> DataFrame:
    """``docs`` without contamination, with its own columns.

    Spans beyond the length limit (a window) are cut out of the text; documents beyond
    the coverage limit go as a whole.  Documents without a hit stay as they are.
    """
    names = docs.columns
    found = find_spans(docs, benchmark, window).filter(~contaminated(coverage))

    def cut(batch: pa.RecordBatch):
        for piece in slices(batch, "text"):
            at, spans = piece.schema.get_field_index("text"), piece.column(piece.schema.get_field_index("__spans")).to_pylist()
            texts = piece.column(at)
            if any(spans):
                words, values, offsets = find_words(texts, WORDS), texts.to_pylist(), text_buffer(texts)[1]
                for d in (d for d, x in enumerate(spans) if x):
                    first = int(words.first[d])
                    base = int(offsets[d])
                    ranges = [(int(words.start[first + s["first"]]) - base, int(words.end[first + s["last"]]) - base) for s in spans[d]]
                    values[d] = cut_bytes(values[d].encode(), ranges)
                values = [v.decode() if isinstance(v, bytes) else v for v in values]
                texts = pa.array(values, texts.type)
            yield pa.RecordBatch.from_arrays([texts if i == at else piece.column(i) for i in range(len(names))], names)

    return arrow_map(found, cut, docs.schema)
