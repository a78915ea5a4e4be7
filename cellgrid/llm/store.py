"""Tables between steps, Arrow maps, and row keys shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.session import work_dir


BATCH_BYTES = 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Python tasks get Arrow batches of bounded size, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


_written: ContextVar[list[DataFrame] | None] = ContextVar("written", default=None)


@contextmanager
def temporary() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that :func:`write_table` makes in this block are deleted at its end, but for those given to the yielded function.

    Those that stay belong to the block around this one, if there is one.
    """
    outer, made, stay = _written.get(), [], []
    token = _written.set(made)
    try:
        yield lambda df: stay.append(df._stored_at) or df
    finally:
        _written.reset(token)
        for table in made:
            if table._stored_at not in stay:
                drop_table(table)
            elif outer is not None:
                outer.append(table)


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: lineage ends there.

    Shuffle files of the finished job are dropped, as nothing reads them again.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    made = _written.get()
    if made is not None:
        made.append(out)
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table of :func:`write_table` that no later step reads."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def arrow_map(df: DataFrame, each: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` for a function of one batch that gives one batch or several."""

    def run(batches):
        for batch in batches:
            made = each(batch)
            if isinstance(made, pa.RecordBatch):
                yield made
            else:
                yield from made

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores before it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def own_columns(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For stages that return the columns of ``docs``: whatever the others are called, the stage sees them under names it never uses."""

    @wraps(stage)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        inside = docs.toDF(*(c if c in ("doc_id", "text") else f"column{i}" for i, c in enumerate(docs.columns)))
        return stage(inside, *args, **options).toDF(*docs.columns)

    return run


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """(``__id`` long, ``__th`` int), equal for two rows if and only if doc_id and text are equal.

    Documents without an id are told apart by their texts; rows that share an id, by
    a hash of the text.  Joins of documents with what was found in them use this pair.
    """
    text_ = F.coalesce(F.col(text), F.lit(""))
    return [F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(text_, F.lit("no id"))).alias("__id"), F.hash(text_).alias("__th")]
