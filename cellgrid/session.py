"""Session settings and durable intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def make_session(master: str = "local[*]", app: str = "cellgrid", **conf: str) -> SparkSession:
    """Session with the settings the operators are written for.

    Adaptive execution picks shuffle partition counts, splits skewed join
    partitions and switches to broadcast joins only after it has seen the
    real size of a side.
    """
    cores = os.environ.get("BENCH_CPUS", "8")
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if master.startswith("local"):
        settings["spark.sql.shuffle.partitions"] = cores
        settings["spark.driver.memory"] = "12g"
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, as named by ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="cellgrid-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir() or folder


_current: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


class Scratch:
    """Tables written while the block runs, so that superseded ones can be deleted."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, set[str]()

    def __enter__(self) -> Scratch:
        self._token = _current.set(self)
        return self

    def __exit__(self, *exc) -> None:
        _current.reset(self._token)

    def release(self, keep: Iterable[DataFrame | None]) -> None:
        """Delete every table of this block that none of the frames in ``keep`` reads."""
        used = {os.path.basename(os.path.dirname(f)) for df in keep if df is not None for f in df.inputFiles()}
        for path in [p for p in self.paths if os.path.basename(p) not in used]:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
            self.paths.discard(path)


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage of iterative plans; survives the loss of any executor, and
    the file sizes give the next plan true statistics.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    scratch = _current.get()
    if scratch is not None:
        scratch.paths.add(path)
    return spark.read.schema(df.schema).parquet(path)
