"""Binned-count input: a sparse matrix of square x gene counts plus square positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.operators.prep import exclude_genes

BINNED = "square_002um"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one text file with their 1-based number.

    A gzip file is one input split, so the generated ids of its lines are
    consecutive; a plain file may be split and is numbered as an array instead.
    """
    if path.endswith(".gz"):
        lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), "value")
        return lines.select((F.col("at") + 1).alias("idx"), F.col("value").alias("line"))
    text = spark.read.text(path, wholetext=True)
    lines = F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n")
    return text.select(F.posexplode(lines).alias("pos", "line")).select((F.col("pos") + 1).cast("bigint").alias("idx"), "line")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Gene names: second column of the headerless feature table."""
    return numbered_lines(spark, path).select("idx", F.split("line", "\t")[1].alias("gene"))


def read_barcodes(spark: SparkSession, path: str) -> DataFrame:
    return numbered_lines(spark, path).select("idx", F.split("line", "\t")[0].alias("barcode"))


def read_scale(spark: SparkSession, path: str) -> float:
    """Microns per pixel from the scale-factor document."""
    row = spark.read.json(path, multiLine=True).select(F.col("microns_per_pixel").cast("double")).first()
    return row[0]


def place_barcodes(positions: DataFrame, microns_per_pixel: float) -> DataFrame:
    """Square centres in microns; x follows pixel rows, y pixel columns."""
    s = F.lit(float(microns_per_pixel))
    return positions.select("barcode", (F.col("pxl_row_in_fullres") * s).alias("x"), (F.col("pxl_col_in_fullres") * s).alias("y"))


def place_counts(triplets: DataFrame, placed: DataFrame) -> DataFrame:
    """Counts by (barcode, gene) at the position of their square, all at depth 0."""
    return triplets.join(placed, "barcode").select("barcode", "gene", "x", "y", F.lit(0.0).alias("z"), F.col("n").cast("bigint"))


def read_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Size header and ``(gene_idx, square_idx, n)`` entries of a coordinate-format matrix.

    The header is the first line with three fields that is not a comment; it is
    told apart from entries by its position in the file.
    """
    lines = spark.read.text(path).where("value NOT LIKE '\\%%' AND trim(value) <> ''")
    f = F.split(F.trim("value"), "\\s+")
    rows = lines.select(
        f[0].cast("bigint").alias("gene_idx"), f[1].cast("bigint").alias("square_idx"), f[2].cast("bigint").alias("n"),
        F.monotonically_increasing_id().alias("at"),
    )
    header = rows.orderBy("at").limit(1)
    at = header.first()
    if at is None:
        raise ValueError(f"{path} has no size line")
    return header.drop("at"), rows.where(F.col("at") != F.lit(at["at"])).drop("at")


def read_binned(spark: SparkSession, path: str, excluded: str | None = None, partitions: int | None = None) -> DataFrame:
    """Transcripts with multiplicities from a binned-output folder.

    Raises if the matrix size disagrees with the feature and barcode tables.
    """
    root = f"{path.rstrip('/')}/{BINNED}"
    features = read_features(spark, f"{root}/raw_feature_bc_matrix/features.tsv.gz")
    barcodes = read_barcodes(spark, f"{root}/raw_feature_bc_matrix/barcodes.tsv.gz")
    size, entries = read_matrix(spark, f"{root}/raw_feature_bc_matrix/matrix.mtx.gz")
    want = size.first()
    if (features.count(), barcodes.count()) != (want["gene_idx"], want["square_idx"]):
        raise ValueError("matrix size does not match its feature and barcode tables")
    scale = read_scale(spark, f"{root}/spatial/scalefactors_json.json")
    positions = spark.read.parquet(f"{root}/spatial/tissue_positions.parquet")
    placed = place_barcodes(positions, scale).join(barcodes, "barcode").select(F.col("idx").alias("square_idx"), "barcode", "x", "y")
    genes = exclude_genes(features, excluded).withColumnRenamed("idx", "gene_idx")
    # one gzip stream is one input split: spread the entries before joining
    spread = entries.repartition(partitions) if partitions else entries.repartition("square_idx")
    return (
        spread.join(genes, "gene_idx").join(placed, "square_idx")
        .select("barcode", "gene", "x", "y", F.lit(0.0).alias("z"), "n")
    )
