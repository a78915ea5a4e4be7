"""Large text documents written as ordered gzip parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_parts(path: str, body: DataFrame, head: list[str], tail: list[str]) -> None:
    """Write ``head`` lines, the lines of ``body`` and ``tail`` lines below ``path``.

    Executors write the body; folders ``0-head``, ``1-body``, ``2-tail`` read in name
    order give the document, and so does their byte-wise concatenation.
    """
    spark = body.sparkSession
    for name, lines in (("0-head", head), ("2-tail", tail)):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}", compression="gzip")
    body.write.mode("overwrite").text(f"{path}/1-body", compression="gzip")


def join_parts(spark: SparkSession, path: str, target: str) -> None:
    """Concatenate the gzip parts into the single file some tools insist on.

    Copies bytes through a fixed buffer of the file systems that hold the parts and the
    target, for results small enough for one file.
    """
    hadoop = spark._jvm.org.apache.hadoop
    conf = spark._jsc.hadoopConfiguration()
    at = hadoop.fs.Path(target)
    out = at.getFileSystem(conf).create(at, True)
    for name in ("0-head", "1-body", "2-tail"):
        folder = hadoop.fs.Path(f"{path}/{name}")
        fs = folder.getFileSystem(conf)
        parts = {s.getPath().getName(): s.getPath() for s in fs.listStatus(folder)}
        for _, part in sorted(x for x in parts.items() if x[0].startswith("part-")):
            stream = fs.open(part)
            hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
            stream.close()
    out.close()
